"""Queries: job transitions, quota, retention and refresh, versions, accounts, cuts, word lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts as X, jobs as J, lifecycle as L
from ..sources.store import Table
from .bindings import EXECUTIONS_SQL, ORDERS_SQL, TOPICS_SQL, counts_sql
from .kernels import STATUS, STOP, WORDS_SQL, now, queue
from .registrar import query
from .reports import DEFAULT, RUNS, runs, topics, videos

NOW = "TIMESTAMP '2024-01-20'"
QUEUE = f"SELECT event_id AS job_id, user_id % 3 AS kind, {STATUS} AS status, ts AS created_at, floor(value)::BIGINT % 7 AS attempts, user_id AS tenant_id FROM events"
STAGE = "CASE kind WHEN 0 THEN 'coleta' WHEN 1 THEN 'inferencia' ELSE 'topicos' END"


def stage():
    return F.when(F.col("kind") == 0, "coleta").when(F.col("kind") == 1, "inferencia").otherwise("topicos")


# Job transitions ----------------------------------------------------------------------------------------------
@query("state_defer", f"SELECT job_id, 'pendente' AS status, created_at::TIMESTAMP + INTERVAL 1 DAY AS available_at, 0::BIGINT AS attempts FROM ({QUEUE}) WHERE status = 'processando'")
def _(v):
    running = queue(v).where("status = 'processando'")
    done = J.deferred(running, F.col("created_at") + F.expr("INTERVAL 1 DAY"))
    return done.select("job_id", "status", F.col("available_at").cast("timestamp_ntz"), "attempts")


@query("state_attempt", f"SELECT job_id, 'processando' AS status, attempts + 1 AS attempts FROM ({QUEUE}) WHERE status = 'pendente' AND created_at <= {NOW}")
def _(v):
    return J.attempted(queue(v).where((F.col("status") == "pendente") & (F.col("created_at") <= now())), now()).select("job_id", "status", "attempts")


@query("state_retry_budget", f"SELECT job_id, CASE WHEN attempts >= {L.MAX_ATTEMPTS} THEN 'dlq' ELSE 'pendente' END AS becomes FROM ({QUEUE}) WHERE status = 'erro'")
def _(v):
    return J.failed(queue(v).where("status = 'erro'"), F.lit("failed")).select("job_id", "becomes")


@query("state_complete", f"""
SELECT job_id, CASE WHEN kind = 2 THEN 'run finished' ELSE 'job published' END AS event, CASE kind WHEN 0 THEN 'inferencia' WHEN 1 THEN 'topicos' END AS next
FROM ({QUEUE}) WHERE status = 'concluida'
""")
def _(v):
    return J.completed(queue(v).where("status = 'concluida'"), stage())


@query("state_quota_gate", """
WITH j AS (SELECT user_id AS tenant_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE AS day, event_id, ts, floor(value)::BIGINT + 1 AS cost FROM events),
d AS (SELECT tenant_id, day, list(cost ORDER BY ts, event_id) AS costs, count(*)::BIGINT AS jobs FROM j GROUP BY ALL),
f AS (SELECT tenant_id, day, jobs, list_reduce(list_prepend({'spent': 0::BIGINT, 'ran': 0::BIGINT}, list_transform(costs, lambda c: {'spent': c, 'ran': 1::BIGINT})),
  lambda a, x: CASE WHEN a.spent + x.spent <= 60 THEN {'spent': a.spent + x.spent, 'ran': a.ran + 1} ELSE a END) AS r FROM d)
SELECT tenant_id AS tenant, day, r.ran AS ran, r.spent AS spent, jobs - r.ran AS deferred FROM f
""")
def _(v):
    jobs = v.jobs.select("job_id", "tenant_id", (F.col("units") + 1).alias("cost"), "at")
    gated = J.quota_gate(jobs, "tenant_id", "cost", "at", 60)
    return gated.groupBy("tenant", "day").agg(F.count_if("runs").alias("ran"), F.sum(F.when(F.col("runs"), F.col("cost")).otherwise(0)).alias("spent"), F.count_if(F.col("available_at").isNotNull()).alias("deferred"))


SPENT = "SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE AS day, sum(floor(value)::BIGINT)::BIGINT AS units FROM events GROUP BY ALL"


@query("state_quota_exhausted", f"SELECT day, greatest(units, 1000000)::BIGINT AS units FROM ({SPENT}) WHERE day % 2 = 0".replace("day % 2", "day(day) % 2"))
def _(v):
    """Days that the service calls exhausted count as spent to the limit once the adjustment is added."""
    spent = v.jobs.groupBy(L.quota_day(F.col("at")).alias("day")).agg(F.sum("units").alias("units"))
    full = spent.where(F.dayofmonth("day") % 2 == 0).select("day")
    deltas = Table(v.spark).append(spent).append(J.exhausted(spent, full, 1_000_000)).read()
    return deltas.groupBy("day").agg(F.sum("units").alias("units")).where(F.dayofmonth("day") % 2 == 0)


@query("state_idempotent_topics", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT execution_id, execution_id % 3 = 0 AS anew FROM executions WHERE execution_id % 2 = 1 OR execution_id % 3 = 0")
def _(v):
    """Runs to compute: those without topics, and those asked for again."""
    runs = v.executions.select("execution_id", (F.col("execution_id") % 3 == 0).alias("anew"))
    has = runs.where("execution_id % 2 = 0").select("execution_id")
    return runs.where(~F.col("anew")).join(has, "execution_id", "left_anti").union(runs.where("anew"))


@query("state_enqueue_recalc", f"""WITH {ORDERS_SQL}, {EXECUTIONS_SQL}
SELECT execution_id, CASE WHEN execution_id % 10 < 3 THEN 'texts purged' WHEN model_id = 1 THEN 'already queued' ELSE 'to queue' END AS outcome FROM executions""")
def _(v):
    e = v.executions
    return J.recalculation(e.select("execution_id"), e.where("execution_id % 10 < 3"), e.where("model_id = 1"))


# Retention and refresh ----------------------------------------------------------------------------------------
@query("ret_video_metadata", f"""WITH {ORDERS_SQL}, f AS (SELECT youtube_id, execution_id, max(published_at) AS fetched_at FROM orders_v GROUP BY ALL)
SELECT execution_id, CASE WHEN fetched_at >= TIMESTAMP '1998-01-01' - INTERVAL {L.COMMENT_DAYS} DAYS THEN youtube_id END AS title FROM f""")
def _(v):
    f = v.orders.groupBy("youtube_id", "execution_id").agg(F.max("published_at").alias("fetched_at"))
    return L.blank_metadata(f.withColumn("title", F.col("youtube_id")), "fetched_at", F.expr("timestamp_ntz '1998-01-01'"), ["title"]).select("execution_id", "title")


@query("ret_refresh", f"""WITH {ORDERS_SQL}, f AS (SELECT model_id % 2 AS tenant_id, youtube_id, execution_id, max(published_at) AS fetched_at FROM orders_v GROUP BY ALL),
due AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY fetched_at, youtube_id, execution_id) AS r FROM f WHERE fetched_at < TIMESTAMP '1998-01-01' - INTERVAL {L.REFRESH_DAYS} DAYS)
SELECT tenant_id, youtube_id, execution_id, ceil(r / 50)::BIGINT AS call FROM due WHERE r <= 100""")
def _(v):
    """What a refresh with two calls of 50 ids a tenant takes, oldest first; the budget is the feature."""
    f = v.orders.groupBy((F.col("model_id") % 2).alias("tenant_id"), "youtube_id", "execution_id").agg(F.max("published_at").alias("fetched_at"))
    return L.refresh_calls(f, "tenant_id", "fetched_at", ["youtube_id", "execution_id"], F.expr("timestamp_ntz '1998-01-01'"), 2).select("tenant_id", "youtube_id", "execution_id", "call")


@query("dt_result_retention", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT execution_id, completed_at + INTERVAL {L.RESULT_DAYS} DAYS AS until FROM executions")
def _(v):
    return v.executions.select("execution_id", (F.col("completed_at") + F.expr(f"INTERVAL {L.RESULT_DAYS} DAYS")).alias("until"))


@query("dt_backoff", f"SELECT job_id, attempts, pow(2, attempts)::BIGINT AS least, pow(2, attempts)::BIGINT + 1 AS most FROM ({QUEUE})")
def _(v):
    wait = L.backoff(F.col("attempts"), F.col("job_id"))
    return queue(v).select("job_id", "attempts", F.floor(wait).alias("least"), F.ceil(wait).alias("most"))


# Accounts, cuts, projections ----------------------------------------------------------------------------------
@query("flt_pending_invites", "SELECT c_nationkey AS tenant_id, c_custkey AS invite FROM customer WHERE c_custkey % 3 <> 0 AND c_acctbal > 0")
def _(v):
    i = v.table("customer").select(F.col("c_nationkey").alias("tenant_id"), F.col("c_custkey").alias("invite"), (F.col("c_custkey") % 3 == 0).alias("used"), (F.col("c_acctbal") <= 0).alias("expired"))
    return i.where(~F.col("used") & ~F.col("expired")).select("tenant_id", "invite")


@query("agg_seats_reserved", "SELECT c_nationkey AS tenant_id, (count(*) FILTER (c_mktsegment = 'BUILDING') + count(*) FILTER (c_mktsegment = 'MACHINERY' AND c_acctbal > 0))::BIGINT AS seats FROM customer GROUP BY ALL")
def _(v):
    owner, invited = F.col("c_mktsegment") == "BUILDING", (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") > 0)
    return v.table("customer").groupBy(F.col("c_nationkey").alias("tenant_id")).agg((F.count_if(owner) + F.count_if(invited)).alias("seats"))


@query("prj_my_data", """
SELECT user_id, 'accepted' AS kind, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS place FROM events WHERE event_type = 'signup'
UNION ALL
SELECT user_id, 'model', event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER FROM events WHERE event_type = 'purchase'
""")
def _(v):
    from pyspark.sql import Window as W

    rows = lambda kind, name, *order: v.jobs.where(F.col("event_type") == kind).select(F.col("tenant_id").alias("user_id"), F.lit(name).alias("kind"), F.col("job_id").alias("id"), F.row_number().over(W.partitionBy("tenant_id").orderBy(*order)).alias("place"))
    return rows("signup", "accepted", "at", "job_id").union(rows("purchase", "model", "job_id"))


@query("prj_wait_attach", f"""
WITH q AS ({QUEUE}), w AS (SELECT tenant_id, min(created_at) AS resumes FROM q WHERE status = 'pendente' AND created_at > {NOW} GROUP BY ALL)
SELECT job_id, status, CASE WHEN status = 'pendente' THEN resumes END AS resumes FROM q LEFT JOIN w USING (tenant_id)
""")
def _(v):
    q = queue(v).withColumnRenamed("model_id", "tenant_id")
    w = q.where((F.col("status") == "pendente") & (F.col("created_at") > now())).groupBy("tenant_id").agg(F.min("created_at").alias("resumes"))
    return q.join(w, "tenant_id", "left").select("job_id", "status", F.when(F.col("status") == "pendente", F.col("resumes").cast("timestamp_ntz")).alias("resumes"))


RAW_SQL = """
SELECT event_id AS job_id, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN '"many"' WHEN 2 THEN '900' ELSE (props->>'$.k') END AS asked,
       CASE event_id % 4 WHEN 0 THEN '2024-13-45' WHEN 1 THEN '' ELSE strftime(ts, '%Y-%m-%d') END AS since, CASE WHEN event_id % 6 = 0 THEN '  ' ELSE ' ' || event_type || ' ' END AS term FROM events
"""


def raw_cuts(v):
    k, at = F.col("job_id"), F.date_format("at", "yyyy-MM-dd")
    asked = F.when(k % 5 == 0, "true").when(k % 5 == 1, '"many"').when(k % 5 == 2, "900").otherwise(F.get_json_object("props", "$.k"))
    since = F.when(k % 4 == 0, "2024-13-45").when(k % 4 == 1, "").otherwise(at)
    term = F.when(k % 6 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return v.jobs.select("job_id", asked.alias("asked"), since.alias("since"), term.alias("term"))


@query("flt_cut_interpretation", f"""
SELECT job_id, nullif(trim(term), '') AS term, TRY_CAST(nullif(since, '') AS DATE) AS since, least(coalesce(n, 500), 500)::BIGINT AS applied,
       concat_ws(',', CASE WHEN since <> '' AND TRY_CAST(since AS DATE) IS NULL THEN 'date' END, CASE WHEN n IS NULL THEN 'limit' END) AS warnings
FROM (SELECT *, CASE WHEN regexp_matches(asked, '^[0-9]+$') THEN asked::BIGINT END AS n FROM ({RAW_SQL}))
""")
def _(v):
    return L.cut(raw_cuts(v), 500)


@query("prj_cost_estimate", f"SELECT job_id, least(2000, ceil(least(coalesce(CASE WHEN regexp_matches(asked, '^[0-9]+$') THEN asked::BIGINT END, 500), 500) / 100.0)::BIGINT + ceil(10 / 50.0)::BIGINT + 10)::BIGINT AS units FROM ({RAW_SQL})")
def _(v):
    wanted = F.least(F.coalesce(L.plain_int("asked"), F.lit(500).cast("long")), F.lit(500).cast("long"))
    return raw_cuts(v).select("job_id", L.cost(wanted, F.lit(10)).alias("units"))


@query("json_filters_to_db", """
SELECT job_id, CASE WHEN term IS NOT NULL AND since IS NOT NULL THEN '{"term":"' || term || '","since":"' || since || '"}' WHEN term IS NOT NULL THEN '{"term":"' || term || '"}'
  WHEN since IS NOT NULL THEN '{"since":"' || since || '"}' ELSE '{}' END AS filters
FROM (SELECT job_id, nullif(trim(term), '') AS term, TRY_CAST(nullif(since, '') AS DATE)::VARCHAR AS since FROM (""" + RAW_SQL + "))")
def _(v):
    c = L.cut(raw_cuts(v), 500)
    return c.select("job_id", F.to_json(F.struct("term", F.col("since").cast("string").alias("since"))).alias("filters"))


# Words --------------------------------------------------------------------------------------------------------
@query("str_filter_fold", "SELECT source, count(DISTINCT strip_accents(lower(text)))::BIGINT AS texts FROM documents GROUP BY ALL")
def _(v):
    return v.table("documents").groupBy("source").agg(F.count_distinct(T.fold(F.lower("text"))).alias("texts"))


@query("str_lexicon_key", "SELECT doc_id, md5(nfc_normalize(lower(text))) AS key FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.md5(T.lexicon_key(F.col("text")).cast("binary")).alias("key"))


@query("join_lexicon_lookup", f"""
WITH l AS (SELECT lower(p_type) AS form, (min(p_size) % 3 - 1)::INTEGER AS polarity FROM part GROUP BY ALL UNION SELECT unnest(['the', 'und', 'que', 'les']), 1),
w AS (SELECT doc_id, unnest({WORDS_SQL.format('lower(text)')}) AS form FROM documents)
SELECT doc_id, count(*)::BIGINT AS matched, sum(polarity)::BIGINT AS score FROM w JOIN l USING (form) GROUP BY ALL
""")
def _(v):
    """Tokens meet the lexicon by key; adaptive execution broadcasts it if it is small."""
    types = v.table("part").groupBy(F.lower("p_type").alias("form")).agg((F.min("p_size") % 3 - 1).cast("int").alias("polarity"))
    more = v.spark.range(1).select(F.explode(F.array(*map(F.lit, ("the", "und", "que", "les")))).alias("form"), F.lit(1).alias("polarity"))
    words = v.table("documents").select("doc_id", F.explode(T.words(F.lower("text"))).alias("form"))
    counted = words.groupBy("doc_id", "form").agg(F.count("*").alias("n"))
    return counted.join(types.union(more).distinct(), "form").groupBy("doc_id").agg(F.sum("n").alias("matched"), F.sum(F.col("n") * F.col("polarity")).alias("score"))


@query("str_stopwords", f"SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest({WORDS_SQL.format('lower(text)')}) AS token FROM documents) WHERE token IN ({', '.join(repr(s) for s in STOP)}) GROUP BY ALL")
def _(v):
    words = v.table("documents").select(F.explode(T.words(F.lower("text"))).alias("token"))
    return words.where(F.array_contains(F.array(*map(F.lit, STOP)), F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query("str_brand_candidates", f"""
SELECT DISTINCT p_brand AS video, w AS candidate FROM (SELECT p_brand, unnest({WORDS_SQL.format("strip_accents(lower(p_name || ' ' || p_type))")}) AS w FROM part)
WHERE length(w) >= 3 AND w NOT IN ({', '.join(repr(s) for s in STOP)})
""")
def _(v):
    titles = v.table("part").select(F.col("p_brand").alias("video"), F.explode(T.words(T.fold(F.lower(F.concat_ws(" ", "p_name", "p_type"))))).alias("candidate")).distinct()
    return titles.where((F.length("candidate") >= T.MIN_TOKEN) & ~F.col("candidate").isin(*STOP))


#: The tables hold no symbols, so every text gets up to three of one kind behind it.
SIGNED_SQL = "SELECT doc_id, text || repeat(['⭐', '🐈', '🔥'][doc_id % 3 + 1], (doc_id % 4)::INT) AS text FROM documents"


def signed(v):
    sign = F.element_at(F.array(*map(F.lit, "⭐🐈🔥")), (F.col("doc_id") % 3 + 1).cast("int"))
    return v.table("documents").select("doc_id", F.concat("text", F.repeat(sign, (F.col("doc_id") % 4).cast("int"))).alias("text"))


@query("agg_emoji_frequency", rf"""
SELECT e AS symbol, count(*)::BIGINT AS occurrences, count(DISTINCT doc_id)::BIGINT AS texts
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{So}}\x{{1F300}}-\x{{1FAFF}}\x{{1F1E6}}-\x{{1F1FF}}\x{{2600}}-\x{{27BF}}]')) AS e FROM ({SIGNED_SQL})) GROUP BY ALL
""")
def _(v):
    found = signed(v).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(T.EMOJI_PATTERN), F.lit(0))).alias("symbol"))
    per = found.groupBy("symbol", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("symbol").agg(F.sum("n").alias("occurrences"), F.count("*").alias("texts"))


@query("str_is_emoji", rf"""
SELECT doc_id, length(regexp_replace(text, '[^\p{{So}}\x{{1F300}}-\x{{1FAFF}}\x{{1F1E6}}-\x{{1F1FF}}\x{{2600}}-\x{{27BF}}]', '', 'g'))::INTEGER AS symbols FROM ({SIGNED_SQL})
""")
def _(v):
    return signed(v).select("doc_id", F.length(F.regexp_replace("text", T.EMOJI_PATTERN.replace("[", "[^", 1), "")).alias("symbols"))


# Facts --------------------------------------------------------------------------------------------------------
def admitted_sql(name: str, t: X.Thresholds) -> str:
    enough = "(SELECT count(*) FROM {0} x WHERE x.execution_id = runs.execution_id AND x.total >= {1})::BIGINT AS {0}_enough"
    return f"""SELECT '{name}' AS config, execution_id, total >= {t.run_min} AS run_enough, total >= {t.compared_run_min} AS compared_enough,
  {enough.format('topics', t.topic_min)}, {enough.format('videos', t.video_min)} FROM runs"""


#: The configuration that facts use, and one that asks for twice its samples.
CONFIGS = {"default": DEFAULT, "twice": X.Thresholds(topic_min=60, video_min=60, run_min=200, compared_run_min=200)}


@query("fact_config", f"{RUNS} {' UNION ALL '.join(admitted_sql(*c) for c in CONFIGS.items())}")
def _(v):
    """What each configuration admits in every run."""
    each = [X.admitted(runs(v), topics(v), videos(v), t).withColumn("config", F.lit(name)) for name, t in CONFIGS.items()]
    return each[0].unionByName(each[1])


@query("arr_keywords_norm", f"""WITH {TOPICS_SQL}
SELECT execution_id, array_to_string(list_sort(list(DISTINCT strip_accents(lower(trim(topic))))), ',') AS keywords FROM topic_links WHERE topic LIKE 'Brand%' GROUP BY ALL""")
def _(v):
    named = v.topic_links.where("topic like 'Brand%'").groupBy("execution_id").agg(F.collect_set("topic").alias("raw"))
    return named.select("execution_id", F.array_join(F.sort_array(X.keywords(F.col("raw"))), ",").alias("keywords"))


@query("map_fact_values", f"""WITH {TOPICS_SQL}, t AS ({counts_sql('topic_links', 'execution_id, topic')})
SELECT execution_id, topic, '{{"topic":"' || topic || '","sample":' || total || ',"negative":' || negative || '}}' AS fact_values FROM t""")
def _(v):
    from ..operators import aggregates as A

    t = A.distribution(v.topic_links, "execution_id", "topic")
    return t.select("execution_id", "topic", F.to_json(F.struct("topic", F.col("total").alias("sample"), "negative")).alias("fact_values"))
