"""Queries: matching, limits, exports, registry of versions, selection rules, gauges."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import text as T
from ..operators import lifecycle as L, matching as M, sampling as S, selection as ML
from ..sources.store import Table
from .bindings import ORDERS_SQL, TOPICS_SQL
from .kernels import PAIRS_SQL, found_topics, pairs
from .registrar import query


TOPIC_WORDS = f"""WITH {TOPICS_SQL.replace("p_type AS topic", "p_type AS topic, p_name").replace("p_brand FROM", "p_brand, p_name FROM").replace("t.topic, sentiment", "t.topic, sentiment, t.p_name")},
k AS (SELECT DISTINCT model_id, execution_id, topic, unnest(string_split(p_name, ' ')) AS w FROM topic_links),
n AS (SELECT execution_id, topic, count(*) AS n FROM k GROUP BY ALL)"""


def keyworded(v, before: int):
    """Topics of runs with the words of their parts' names; pair: the run whose topics are matched with the next run's."""
    p = v.table("part").select("p_partkey", "p_name", F.explode(F.array("p_type", "p_brand")).alias("topic"))
    named = v.comments.select("execution_id", "partkey").distinct().join(p, F.col("partkey") == F.col("p_partkey"))
    words = named.select("execution_id", "topic", F.explode(F.split("p_name", " ")).alias("w")).groupBy("execution_id", "topic").agg(F.collect_set("w").alias("keywords"))
    return words.select((F.col("execution_id") - before).alias("pair"), "topic", "keywords")


@query("join_topic_pairs", f"""{TOPIC_WORDS}
SELECT x.execution_id AS pair, x.topic AS a, y.topic AS b, count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)) AS similarity
FROM k x JOIN k y ON y.execution_id = x.execution_id + 1 AND y.w = x.w JOIN n p ON p.execution_id = x.execution_id AND p.topic = x.topic JOIN n q ON q.execution_id = y.execution_id AND q.topic = y.topic
GROUP BY x.execution_id, x.topic, y.topic HAVING count(*)::DOUBLE / (any_value(p.n) + any_value(q.n) - count(*)) >= 0.3
""")
def _(v):
    return M.topic_pairs(keyworded(v, 0), keyworded(v, 1))


@query("join_topic_match")
def _(v):
    """Topics of each run and the next; keywords come from whole texts."""
    t = found_topics(v).select("execution_id", "topic", "keywords").distinct()
    before, after = (t.select((F.col("execution_id") - k).alias("pair"), "topic", "keywords") for k in (0, 1))
    return M.greedy_one_to_one(M.topic_pairs(before, after))


@query("win_sliding_rate_limit", """
WITH e AS (SELECT user_id, list({'t': epoch(ts::TIMESTAMP)::DOUBLE, 'kept': []::DOUBLE[], 'refused': 0::BIGINT} ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)
SELECT user_id AS tenant_id, len(x)::BIGINT AS events, list_reduce(list_prepend({'t': 0::DOUBLE, 'kept': []::DOUBLE[], 'refused': 0::BIGINT}, x), lambda a, b:
  CASE WHEN len(list_filter(a.kept, lambda k: k > b.t - 86400)) < 3
    THEN {'t': b.t, 'kept': list_append(list_filter(a.kept, lambda k: k > b.t - 86400), b.t), 'refused': a.refused}
    ELSE {'t': b.t, 'kept': list_filter(a.kept, lambda k: k > b.t - 86400), 'refused': a.refused + 1} END).refused AS refused
FROM e
""")
def _(v):
    return M.sliding_limit(v.jobs, "tenant_id", "at", 3, 86400)


ANSWERED = """
  SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'odd' ELSE 'neutro' END AS label FROM labels UNION ALL SELECT page_id, 'neutro' FROM pages
"""


@query("set_batch_contract", f"""
WITH s AS (SELECT doc_id AS id FROM documents WHERE lang = 'en'), n AS (SELECT id, count(*) AS n, bool_or(label = 'neutro') AS known FROM ({ANSWERED}) GROUP BY ALL)
SELECT coalesce(s.id, n.id) AS id, CASE WHEN n IS NULL THEN 'missing' WHEN s.id IS NULL THEN 'foreign' WHEN n > 1 THEN 'repeated' ELSE 'label' END AS reason
FROM s FULL JOIN n ON s.id = n.id WHERE n IS NULL OR s.id IS NULL OR n > 1 OR NOT known
""")
def _(v):
    """All English documents are sent; labels and pages answer."""
    label = F.when(F.col("toxic") == 1, "odd").otherwise("neutro")
    got = v.table("labels").select(F.col("doc_id").alias("id"), label.alias("label")).union(v.table("pages").select("page_id", F.lit("neutro")))
    return M.batch_contract(v.table("documents").where("lang = 'en'").select(F.col("doc_id").alias("id")), got, ("positivo", "neutro", "negativo"))


@query("sink_corpus", r"""
WITH c AS (SELECT doc_id, source AS video, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents),
l AS (SELECT *, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Latin}]', '', 'g')) AS latin FROM c WHERE text <> ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5('42:' || doc_id), doc_id) AS place FROM l WHERE letters = 0 OR latin >= 0.5 * letters)
SELECT doc_id, video, md5(text) AS digest FROM placed WHERE place <= 400
""")
def _(v):
    """Canonical texts, without empty and non-Latin ones, at most 400 a video by seeded order (the export's own rule), written and read."""
    d = v.documents.select("doc_id", F.col("source").alias("video"), T.canonical(F.col("text")).alias("text"))
    kept = d.where((F.col("text") != "") & T.latin_share_ok(F.col("text")))
    place = F.row_number().over(W.partitionBy("video").orderBy(S.order_hash("doc_id"), "doc_id"))
    exported = kept.withColumn("place", place).where("place <= 400").select("doc_id", "video", "text", T.model_text(F.col("text")).alias("model_text"))
    return Table(v.spark).append(exported).read().select("doc_id", "video", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("agg_video_counts_export", "SELECT source AS video, count(*)::BIGINT AS raw, count(*) FILTER (n_chars > 100)::BIGINT AS kept FROM documents GROUP BY ALL")
def _(v):
    return v.table("documents").groupBy(F.col("source").alias("video")).agg(F.count("*").alias("raw"), F.count_if(F.col("n_chars") > 100).alias("kept"))


@query("sink_quota_upsert", "SELECT CAST(ts AS DATE) AS day, user_id AS tenant_id, sum(floor(value)::BIGINT)::BIGINT AS units FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY ALL")
def _(v):
    """Spending is added as rows, summed when read; old days are pruned."""
    spent = v.jobs.select(F.to_date("at").alias("day"), "tenant_id", "units", (F.col("job_id") % 2).alias("half"))
    t = Table(v.spark)
    for half in (0, 1):
        t.append(spent.where(F.col("half") == half).groupBy("day", "tenant_id").agg(F.sum("units").alias("units")))
    return t.read().where("day >= date '2024-01-25'").groupBy("day", "tenant_id").agg(F.sum("units").alias("units"))


VERSIONS = "SELECT source || '@' || lang AS version, min(doc_id) AS first FROM documents GROUP BY ALL"


@query("version_register", f"""
WITH w AS ({VERSIONS}), old AS (SELECT version, row_number() OVER (ORDER BY version) AS id FROM w WHERE first % 2 = 0),
new AS (SELECT version, (SELECT count(*) FROM old) + row_number() OVER (ORDER BY version) AS id FROM w WHERE version NOT IN (SELECT version FROM old))
SELECT version, id::BIGINT AS id FROM old UNION ALL SELECT version, id::BIGINT FROM new
""")
def _(v):
    """Versions that are registered keep their id, others get the next ones."""
    w = v.table("documents").groupBy(F.concat("source", F.lit("@"), "lang").alias("version")).agg(F.min("doc_id").alias("first"))
    t = Table(v.spark).append(L.registered(w.where("first % 2 = 0").select("version"), None))
    return t.append(L.registered(w.select("version"), t.read())).read()


@query("version_activate", "SELECT n_nationkey, CASE WHEN n_nationkey = 7 THEN 'ativo' ELSE 'arquivado' END AS status FROM nation")
def _(v):
    t = Table(v.spark).append(v.table("nation").select("n_nationkey", F.when(F.col("n_nationkey") == 3, "ativo").otherwise("arquivado").alias("status")))
    return t.rewrite(L.activated(t.read(), F.col("n_nationkey") == 7)).read()


GRID = "SELECT user_id % 12 AS config, avg(value) AS f1 FROM events GROUP BY ALL"


@query("top_grid_best", f"SELECT config FROM ({GRID}) ORDER BY round(f1, 9) DESC, config LIMIT 1")
def _(v):
    g = v.jobs.join(v.table("events").select(F.col("event_id").alias("job_id"), "value"), "job_id").groupBy((F.col("tenant_id") % 12).alias("config")).agg(F.avg("value").alias("f1"))
    return g.agg(F.max_by("config", F.struct(F.round("f1", 9), -F.col("config"))).alias("config"))


@query("top_median_seed", f"SELECT config FROM (SELECT config, row_number() OVER (ORDER BY round(f1, 9), config) AS r, count(*) OVER () AS n FROM ({GRID})) WHERE r = n // 2 + 1")
def _(v):
    g = v.table("events").groupBy((F.col("user_id") % 12).alias("config")).agg(F.avg("value").alias("f1"))  # a row a configuration
    order = F.sort_array(F.collect_list(F.struct(F.round("f1", 9).alias("f"), "config")))
    return g.agg(order.alias("o")).select(F.element_at("o", (F.floor(F.size("o") / 2) + 1).cast("int"))["config"].alias("config"))


@query("st_adoption_rule", f"SELECT config, f1 - (SELECT f1 FROM ({GRID}) WHERE config = 0) >= 0.010::DOUBLE AS adopt FROM ({GRID})")
def _(v):
    """Against the simplest configuration."""
    g = v.table("events").groupBy((F.col("user_id") % 12).alias("config")).agg(F.avg("value").alias("f1"))
    simple = g.where("config = 0").select(F.col("f1").alias("_f"))
    return g.crossJoin(F.broadcast(simple)).select("config", (F.col("f1") - F.col("_f") >= ML.ADOPT).alias("adopt"))


@query("st_drop_reading", f"SELECT config, CASE WHEN (SELECT f1 FROM ({GRID}) WHERE config = 0) - f1 >= 0.03::DOUBLE THEN 'relevant' ELSE 'small' END AS reading FROM ({GRID})")
def _(v):
    g = v.table("events").groupBy((F.col("user_id") % 12).alias("config")).agg(F.avg("value").alias("f1"))
    simple = g.where("config = 0").select(F.col("f1").alias("_f"))
    return g.crossJoin(F.broadcast(simple)).select("config", F.when(F.col("_f") - F.col("f1") >= ML.RELEVANT, "relevant").otherwise("small").alias("reading"))


USED = "SELECT CAST(ts AS DATE) AS day, sum(floor(value)::BIGINT)::BIGINT AS units FROM events GROUP BY ALL"


@query("ui_quota_gauge", f"SELECT day, least(100.0::DOUBLE, units * 100.0::DOUBLE / 10000) AS used FROM ({USED})")
def _(v):
    u = v.jobs.groupBy(F.to_date("at").alias("day")).agg(F.sum("units").alias("units"))
    return u.select("day", F.least(F.lit(100.0), F.col("units") * F.lit(100.0) / 10000).alias("used"))


@query("ui_quota_bars", f"SELECT day, CASE WHEN units = 0 THEN 0.0 ELSE greatest(2.0::DOUBLE, units * 100.0::DOUBLE / (SELECT max(units) FROM ({USED}))) END AS height FROM ({USED})")
def _(v):
    u = v.jobs.groupBy(F.to_date("at").alias("day")).agg(F.sum("units").alias("units"))
    peak = u.agg(F.max("units").alias("peak"))
    return u.crossJoin(F.broadcast(peak)).select("day", F.when(F.col("units") == 0, 0.0).otherwise(F.greatest(F.lit(2.0), F.col("units") * F.lit(100.0) / F.col("peak"))).alias("height"))


@query("join_waiting_jobs", "SELECT user_id AS tenant_id, count(DISTINCT floor(value)::BIGINT)::BIGINT AS runs FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-20' GROUP BY ALL")
def _(v):
    w = v.jobs.where((F.col("event_type") == "view") & (F.col("at") > F.lit("2024-01-20").cast("timestamp")))
    return w.groupBy("tenant_id").agg(F.count_distinct("units").alias("runs"))


@query("join_videos_to_refresh", f"WITH {ORDERS_SQL} SELECT model_id % 2 AS tenant_id, youtube_id, min(published_at) AS oldest FROM orders_v WHERE published_at < TIMESTAMP '1998-01-01' - INTERVAL 25 DAYS GROUP BY ALL")
def _(v):
    old = v.orders.where(F.col("published_at") < F.expr("timestamp_ntz '1998-01-01' - INTERVAL 25 DAYS"))
    return old.groupBy((F.col("model_id") % 2).alias("tenant_id"), "youtube_id").agg(F.min("published_at").alias("oldest"))


@query("prj_metrics_extraction", """
SELECT event_id AS job_id, coalesce(p->>'$.evaluation.k', p->>'$.k')::INT AS k
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"evaluation": ' || props || '}' ELSE props END AS p FROM events)
""")
def _(v):
    """A figure of the evaluation, or of the older layout without one; every other payload has the newer layout."""
    nested = F.concat(F.lit('{"evaluation": '), "props", F.lit("}"))
    rows = v.jobs.select("job_id", F.when(F.col("job_id") % 2 == 0, nested).otherwise(F.col("props")).alias("p"))
    return rows.select("job_id", F.coalesce(F.get_json_object("p", "$.evaluation.k"), F.get_json_object("p", "$.k")).cast("int").alias("k"))


@query("prj_collection_cut", """
WITH j AS (SELECT user_id, arg_max(props->>'$.k', event_id)::INT AS cut_limit FROM events WHERE event_type = 'purchase' GROUP BY ALL),
o AS (SELECT user_id AS viewer, count(*) AS collected FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT c_custkey AS tenant_id, cut_limit, user_id IS NOT NULL AS registered, coalesce(collected, 0)::BIGINT AS collected,
  coalesce(cut_limit > 0 AND coalesce(collected, 0) >= cut_limit, false) AS limit_reached
FROM customer LEFT JOIN j ON user_id = c_custkey LEFT JOIN o ON viewer = c_custkey
""")
def _(v):
    """Cut of each tenant's latest collection; tenants without one are not registered."""
    latest = v.jobs.where("event_type = 'purchase'").groupBy("tenant_id").agg(F.max_by("props", "job_id").alias("props"))
    cut = latest.select("tenant_id", F.get_json_object("props", "$.k").cast("int").alias("cut_limit"), F.lit(True).alias("registered"))
    have = v.jobs.where("event_type = 'view'").groupBy("tenant_id").agg(F.count("*").alias("collected"))
    tenants = v.table("customer").select(F.col("c_custkey").alias("tenant_id"))
    rows = tenants.join(cut, "tenant_id", "left").join(have, "tenant_id", "left").na.fill(0, ["collected"]).na.fill(False, ["registered"])
    reached = (F.col("cut_limit") > 0) & (F.col("collected") >= F.col("cut_limit"))
    return rows.select("tenant_id", "cut_limit", "registered", "collected", F.coalesce(reached, F.lit(False)).alias("limit_reached"))


@query("agg_members", "SELECT c_nationkey AS tenant_id, count(*)::BIGINT AS members FROM customer GROUP BY ALL")
def _(v):
    return v.table("customer").groupBy(F.col("c_nationkey").alias("tenant_id")).agg(F.count("*").alias("members"))


@query("scan_test_set", f"WITH {PAIRS_SQL} SELECT p.doc_id, md5(text) AS digest FROM pairs p JOIN documents USING (doc_id) WHERE fold = 0")
def _(v):
    d = v.table("documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return pairs(v).where("fold = 0").select("doc_id").join(d, "doc_id")


@query("scan_unlabelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50")
def _(v):
    return v.table("documents").select("doc_id").join(v.table("labels"), "doc_id", "left_anti").orderBy("doc_id").limit(50)


@query("top_collection_order", f"WITH {ORDERS_SQL} SELECT execution_id, youtube_id, row_number() OVER (PARTITION BY execution_id ORDER BY count(*), youtube_id)::INT AS place FROM orders_v GROUP BY execution_id, youtube_id")
def _(v):
    n = v.orders.groupBy("execution_id", "youtube_id").agg(F.count("*").alias("n"))
    return n.select("execution_id", "youtube_id", F.row_number().over(W.partitionBy("execution_id").orderBy("n", "youtube_id")).alias("place"))
