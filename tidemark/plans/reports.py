"""Queries: scans, joins, aggregates, windows, facts and pages of runs and campaigns."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..operators import aggregates as A, facts as X, sampling as S, windows as N
from .bindings import COMMENTS_SQL, EXECUTIONS_SQL, ORDERS_SQL, SENTIMENTS, TEXTS_SQL, TOPICS_SQL, counts_sql
from .registrar import ORACLES, query

WC, WT, WO = "WITH " + COMMENTS_SQL, "WITH " + TOPICS_SQL, "WITH " + ORDERS_SQL
RELAXED = X.Thresholds(video_multiple=1.1, z=0.5)
DEFAULT = X.Thresholds()
def new_first():
    return F.desc("completed_at"), F.desc("execution_id")


def runs(v):
    return A.distribution(v.comments, "model_id", "execution_id").join(v.executions.select("execution_id", "completed_at"), "execution_id")


def topics(v):
    return A.distribution(v.topic_links, "execution_id", "topic")


def videos(v):
    return A.distribution(v.comments, "execution_id", "youtube_id")


RUNS = f"{WT}, {EXECUTIONS_SQL}, r AS ({counts_sql('comments', 'model_id, execution_id')}), runs AS (SELECT r.*, completed_at FROM r JOIN executions USING (model_id, execution_id)), topics AS ({counts_sql('topic_links', 'execution_id, topic')}), videos AS ({counts_sql('comments', 'execution_id, youtube_id')})"


@query("agg_sentiment_by_execution", f"{WC} {counts_sql('comments', 'execution_id')}")
def _(v):
    return A.distribution(v.comments, "execution_id")


@query("agg_sentiment_by_video", f"{WC} {counts_sql('comments', 'execution_id, youtube_id')}")
def _(v):
    return videos(v)


@query("agg_sentiment_by_topic", f"{WT} {counts_sql('topic_links', 'execution_id, topic')}")
def _(v):
    return topics(v)


@query("agg_distribution", f"{WC}, d AS ({counts_sql('comments', 'execution_id')}) SELECT execution_id, " + ", ".join(f"coalesce({s}::DOUBLE / nullif(total, 0), 0) AS {s}_share" for s in SENTIMENTS) + ", total FROM d")
def _(v):
    return A.distribution(v.comments, "execution_id").select("execution_id", *[A.fraction(s, "total").alias(f"{s}_share") for s in SENTIMENTS], "total")


@query("st_fraction", f"{WC}, d AS ({counts_sql('comments', 'execution_id, youtube_id')}) SELECT execution_id, youtube_id, coalesce(negative::DOUBLE / nullif(total, 0), 0) AS negative_share FROM d")
def _(v):
    return videos(v).select("execution_id", "youtube_id", A.fraction("negative", "total").alias("negative_share"))


REACH = f"{WC}, vv AS (SELECT execution_id, sum(views)::BIGINT AS views, count(*)::BIGINT AS likes FROM orders_v GROUP BY ALL), cc AS (SELECT execution_id, count(*)::BIGINT AS comments FROM comments GROUP BY ALL)"


@query("agg_reach", f"{REACH} SELECT execution_id, views, likes, coalesce(comments, 0) AS comments, CASE WHEN views = 0 THEN 0.0 ELSE round_even(coalesce(comments, 0)::DOUBLE / (views / 1000.0), 2) END AS per_thousand_views FROM vv LEFT JOIN cc USING (execution_id)")
def _(v):
    per_video = v.orders.groupBy("execution_id", "youtube_id").agg(F.sum("views").alias("views"), F.count("*").alias("likes"))
    return A.reach(per_video, v.comments, "execution_id")


@query("join_in_memory_lookup", f"{WC}, d AS ({counts_sql('comments', 'execution_id, youtube_id')}) SELECT s.execution_id, s.youtube_id, " + ", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in (*SENTIMENTS, "total")) + " FROM (SELECT DISTINCT execution_id, youtube_id FROM orders_v) s LEFT JOIN d USING (execution_id, youtube_id)")
def _(v):
    spine = v.orders.select("execution_id", "youtube_id").distinct()
    return A.with_empty(spine, videos(v), ["execution_id", "youtube_id"])


@query("agg_available_results", f"{RUNS} SELECT tenant_id, model_id, execution_id, completed_at, positive, neutral, negative, total, (SELECT count(*) FROM videos v WHERE v.execution_id = runs.execution_id)::BIGINT AS videos, (SELECT count(*) FROM topics t WHERE t.execution_id = runs.execution_id)::BIGINT AS topics FROM runs JOIN executions USING (model_id, execution_id, completed_at)")
def _(v):
    return A.available_results(v.executions, v.comments, videos(v).select("execution_id", "youtube_id"), topics(v).select("execution_id", "topic"))


@query("agg_distinct_videos", f"{WO} SELECT model_id, count(DISTINCT youtube_id)::BIGINT AS videos FROM orders_v GROUP BY ALL")
def _(v):
    return v.orders.groupBy("model_id").agg(F.count_distinct("youtube_id").alias("videos"))


@query("agg_dashboard", f"{WC}, {EXECUTIONS_SQL} SELECT tenant_id, count(DISTINCT e.model_id)::BIGINT AS models, count(DISTINCT e.execution_id)::BIGINT AS runs, count(DISTINCT youtube_id)::BIGINT AS videos, count(*)::BIGINT AS comments, arg_max(e.execution_id, e.completed_at) AS highlight FROM executions e JOIN comments c USING (execution_id) GROUP BY tenant_id")
def _(v):
    """Totals of a tenant over what has comments. Of runs completed last at the same time the one whose comment comes first in the files
    is the highlight: arg_max keeps the first it finds, and one thread of DuckDB reads the line items in that order."""
    lines = v.table("lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    per_video = v.comments_of(lines, "place").groupBy("execution_id", "youtube_id").agg(F.count("*").alias("n"), F.min("place").alias("place"))
    late = F.when(F.col("completed_at").isNotNull(), F.struct(-F.unix_micros(F.col("completed_at").cast("timestamp")), "place"))
    return v.executions.join(per_video, "execution_id").groupBy("tenant_id").agg(
        F.count_distinct("model_id").alias("models"), F.count_distinct("execution_id").alias("runs"), F.count_distinct("youtube_id").alias("videos"),
        F.sum("n").alias("comments"), F.min_by("execution_id", late).alias("highlight"),
    )


@query("agg_model_version", f"{WC}, n AS (SELECT execution_id, partkey % 3 AS version, count(*)::BIGINT AS n, min(published_at) AS first_at FROM comments GROUP BY ALL) SELECT execution_id, version, n, first_at FROM n QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY n DESC, version) = 1")
def _(v):
    return A.most_used(v.comments.withColumn("version", F.col("partkey") % 3), "execution_id", "version", "published_at")


@query("agg_failure_reason", "SELECT user_id AS tenant_id, arg_max(props, event_id) AS reason FROM events WHERE event_type = 'error' GROUP BY ALL")
def _(v):
    return v.jobs.where("event_type = 'error'").groupBy("tenant_id").agg(F.max_by("props", "job_id").alias("reason"))


@query("agg_quota_day", "SELECT CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day, user_id AS tenant_id, sum(floor(value)::BIGINT)::BIGINT AS units FROM events GROUP BY ALL")
def _(v):
    day = F.to_date(F.from_utc_timestamp("at", "America/Los_Angeles"))
    return v.jobs.groupBy(day.alias("day"), "tenant_id").agg(F.sum("units").alias("units"))


@query("agg_quota_used_today", "SELECT sum(floor(value)::BIGINT)::BIGINT AS units FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events)")
def _(v):
    last = v.jobs.agg(F.max(F.to_date("at")).alias("d"))
    return v.jobs.join(F.broadcast(last), F.to_date("at") == F.col("d")).agg(F.sum("units").alias("units"))


SPINE = "SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day"


@query("agg_quota_admin", f"SELECT day, coalesce(units, 0)::BIGINT AS units, coalesce(tenants, 0)::BIGINT AS tenants FROM ({SPINE}) LEFT JOIN (SELECT CAST(ts AS DATE) AS day, sum(floor(value)::BIGINT) AS units, count(DISTINCT user_id) AS tenants FROM events GROUP BY ALL) USING (day)")
def _(v):
    return A.daily_quota(v.jobs.withColumn("d", F.to_date("at")), "d", "tenant_id", "units", "2023-12-28", "2024-02-03")


@query("dt_daily_spine", SPINE)
def _(v):
    return v.spark.range(1).select(F.explode(F.sequence(F.lit("2023-12-28").cast("date"), F.lit("2024-02-03").cast("date"))).alias("day"))


@query("top_sort_admin", "SELECT user_id AS tenant_id, sum(floor(value)::BIGINT)::BIGINT AS units FROM events GROUP BY ALL ORDER BY units DESC, tenant_id")
def _(v):
    return v.jobs.groupBy("tenant_id").agg(F.sum("units").alias("units")).orderBy(F.desc("units"), "tenant_id")


@query("scan_run_comments", f"{WC} SELECT execution_id, youtube_id, sentiment, l_orderkey, l_linenumber FROM comments WHERE execution_id = 11996")
def _(v):
    return v.comments.where("execution_id = 11996").select("execution_id", "youtube_id", "sentiment", "l_orderkey", "l_linenumber")


@query("scan_run_videos", f"{WO} SELECT DISTINCT execution_id, youtube_id FROM orders_v WHERE execution_id IN (11996, 21997)")
def _(v):
    return v.orders.where(F.col("execution_id").isin(11996, 21997)).select("execution_id", "youtube_id").distinct()


@query("scan_run_topics", f"{WT} SELECT DISTINCT execution_id, topic FROM topic_links WHERE execution_id IN (11996, 21997)")
def _(v):
    return v.topic_links.where(F.col("execution_id").isin(11996, 21997)).select("execution_id", "topic").distinct()


@query("scan_analyzed_comments", "SELECT doc_id AS comment_id, source AS video, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(v):
    return v.texts.join(v.table("labels"), F.col("comment_id") == F.col("doc_id")).select("comment_id", "video", "quality", "toxic")


@query("scan_pending_inference", "SELECT doc_id AS comment_id, floor((row_number() OVER (PARTITION BY doc_id % 16 ORDER BY doc_id) - 1) / 500)::BIGINT AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(v):
    left = v.texts.join(v.table("labels").withColumnRenamed("doc_id", "comment_id"), "comment_id", "left_anti")
    placed = S.numbered(left.select("comment_id", (F.col("comment_id") % 16).alias("lane")), ["lane"], F.shiftright("comment_id", 16), [F.col("comment_id")])
    return placed.select("comment_id", F.floor((F.col("place") - 1) / 500).alias("batch"))


@query("join_anti_unanalyzed", "SELECT doc_id AS comment_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(v):
    return v.texts.join(v.table("labels").withColumnRenamed("doc_id", "comment_id"), "comment_id", "left_anti").select("comment_id")


@query("join_semi_topic", f"{WC} SELECT execution_id, l_orderkey, l_linenumber, partkey FROM comments WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = partkey AND p_brand = 'Brand#12')")
def _(v):
    p = v.table("part").where("p_brand = 'Brand#12'")
    return v.comments.join(p, F.col("partkey") == F.col("p_partkey"), "left_semi").select("execution_id", "l_orderkey", "l_linenumber", "partkey")


@query("flt_by_topic_exists", f"{WC} SELECT execution_id, count(*)::BIGINT AS n FROM comments WHERE partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY') GROUP BY ALL")
def _(v):
    p = v.table("part").where("p_type = 'ECONOMY'")
    return v.comments.join(p, F.col("partkey") == F.col("p_partkey"), "left_semi").groupBy("execution_id").agg(F.count("*").alias("n"))


@query("join_star_comment", f"{WC} SELECT model_id, youtube_id, count(*)::BIGINT AS n FROM comments GROUP BY ALL")
def _(v):
    return v.comments.groupBy("model_id", "youtube_id").agg(F.count("*").alias("n"))


@query("join_topic_sentiment", f"{WT} SELECT topic, sentiment, count(*)::BIGINT AS n FROM topic_links GROUP BY ALL")
def _(v):
    return v.topic_links.groupBy("topic", "sentiment").agg(F.count("*").alias("n"))


LINKS = "SELECT doc_id AS comment_id, 'L:' || lang AS topic, ((doc_id * 37) % 101) / 100.0::DOUBLE AS weight, text FROM documents UNION ALL SELECT doc_id, 'S:' || source, ((doc_id * 53) % 101) / 100.0::DOUBLE, text FROM documents"


def links(v):
    w = lambda k: (F.col("comment_id") * k % 101) / F.lit(100.0)
    pair = F.explode(F.array(F.struct(F.concat(F.lit("L:"), "lang").alias("topic"), w(37).alias("weight")), F.struct(F.concat(F.lit("S:"), "video").alias("topic"), w(53).alias("weight"))))
    return v.texts.select("comment_id", "text", pair.alias("x")).select("comment_id", "text", "x.*")


@query("join_comment_topics", f"SELECT comment_id, string_agg(topic, ' / ' ORDER BY weight DESC, topic) AS topics FROM ({LINKS}) GROUP BY ALL")
def _(v):
    order = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "topic")))
    return links(v).groupBy("comment_id").agg(F.array_join(F.transform(order, lambda x: x["topic"]), " / ").alias("topics"))


@query("join_run_to_tenant", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT execution_id, tenant_id FROM executions")
def _(v):
    return v.executions.select("execution_id", "tenant_id")


@query("flt_tenant_scope", f"{WC} SELECT execution_id, count(*)::BIGINT AS n FROM comments WHERE model_id % 2 = 1 GROUP BY ALL")
def _(v):
    mine = v.executions.where("tenant_id = 1")
    return v.comments.join(mine, "execution_id", "left_semi").groupBy("execution_id").agg(F.count("*").alias("n"))


@query("flt_owned_run", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT execution_id, completed_at FROM executions WHERE execution_id = 11996 AND tenant_id = 1")
def _(v):
    return v.executions.where("execution_id = 11996 and tenant_id = 1").select("execution_id", "completed_at")


@query("flt_owned_model", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT DISTINCT model_id FROM executions WHERE tenant_id = 0")
def _(v):
    return v.executions.where("tenant_id = 0").select("model_id").distinct()


@query("flt_status_active", "SELECT event_id AS job_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def _(v):
    return v.jobs.where(F.col("event_type").isin("view", "click")).select("job_id", "event_type")


@query("top_list_runs", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT tenant_id, execution_id, completed_at, row_number() OVER (PARTITION BY tenant_id ORDER BY completed_at DESC, execution_id DESC)::INT AS place FROM executions")
def _(v):
    return v.executions.select("tenant_id", "execution_id", "completed_at", F.row_number().over(W.partitionBy("tenant_id").orderBy(*new_first())).alias("place"))


@query("top_list_models", "SELECT r_regionkey::BIGINT AS model_id, r_name AS name FROM region ORDER BY model_id DESC")
def _(v):
    return v.table("region").select(F.col("r_regionkey").cast("long").alias("model_id"), F.col("r_name").alias("name")).orderBy(F.desc("model_id"))


@query("top_comment_page", f"WITH {TEXTS_SQL} SELECT comment_id, video, sentiment FROM texts WHERE execution_id = 1 AND sentiment = 'negative' AND text ILIKE '%on%' AND text IS NOT NULL ORDER BY comment_id LIMIT 20 OFFSET 20")
def _(v):
    found = v.texts.where("execution_id = 1 and text is not null").where((F.col("sentiment") == "negative") & F.col("text").ilike("%on%"))
    return found.orderBy("comment_id").offset(20).limit(20).select("comment_id", "video", "sentiment")


@query("top_comment_chips", f"WITH {TEXTS_SQL} {counts_sql('(SELECT * FROM texts WHERE text ILIKE $$%on%$$)', 'execution_id')}".replace("$$", "'"))
def _(v):
    return A.distribution(v.texts.where(F.col("text").ilike("%on%")), "execution_id")


@query("win_topic_representative", f"SELECT topic, comment_id, weight FROM ({LINKS}) QUALIFY row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN length(text) >= 40 THEN 0 ELSE 1 END, weight DESC, comment_id) = 1")
def _(v):
    return N.topic_representative(links(v), "topic").select("topic", "comment_id", "weight")


@query("win_median_representative", f"WITH {TEXTS_SQL}, k AS (SELECT execution_id, sentiment, comment_id, row_number() OVER (PARTITION BY execution_id, sentiment ORDER BY length(text), comment_id) AS pos, count(*) OVER (PARTITION BY execution_id, sentiment) AS n FROM texts) SELECT execution_id, sentiment, comment_id FROM k WHERE 2 * pos IN (n, n + 1)")
def _(v):
    return N.median_representative(v.texts, "execution_id").select("execution_id", "sentiment", "comment_id")


@query("win_run_order", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT model_id, execution_id, row_number() OVER (PARTITION BY model_id ORDER BY completed_at NULLS LAST, execution_id)::INT AS place FROM executions")
def _(v):
    return v.executions.select("model_id", "execution_id", F.row_number().over(N.run_order()).alias("place"))


PAIRS = f"{RUNS}, pairs AS (SELECT *, lag(execution_id) OVER w AS before_execution_id, lag(negative) OVER w AS before_negative, lag(total) OVER w AS before_total FROM runs WINDOW w AS (PARTITION BY model_id ORDER BY completed_at NULLS LAST, execution_id))"


@query("win_campaign_pairwise", f"{PAIRS} SELECT model_id, before_execution_id, execution_id, negative, before_negative FROM pairs WHERE before_execution_id IS NOT NULL")
def _(v):
    return N.consecutive(runs(v), ["execution_id", "negative", "total"]).select("model_id", "before_execution_id", "execution_id", "negative", "before_negative")


@query("win_last_run_per_model", f"WITH {ORDERS_SQL}, {EXECUTIONS_SQL} SELECT model_id, execution_id, completed_at FROM executions QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY completed_at DESC, execution_id DESC) = 1")
def _(v):
    return N.first_of(v.executions, "model_id", *new_first()).select("model_id", "execution_id", "completed_at")


@query("win_cumulative_concentration", f"{RUNS} SELECT execution_id, topic, negative FROM (SELECT *, sum(negative) OVER (PARTITION BY execution_id) AS t, coalesce(sum(negative) OVER (PARTITION BY execution_id ORDER BY negative DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM topics) WHERE t > 0 AND b < t * 0.6::DOUBLE")
def _(v):
    return N.concentration(topics(v), "execution_id", "topic", "negative", 0.6).select("execution_id", "topic", "negative")


@query("win_last_n_failures", "SELECT user_id AS tenant_id, event_id AS job_id, epoch_us(ts) AS at_us FROM (SELECT *, lag(ts, 4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events) WHERE f IS NOT NULL AND epoch_us(ts) - epoch_us(f) <= 86400000000")
def _(v):
    return N.nth_within(v.jobs, "tenant_id", "at", 5, 86400).select("tenant_id", "job_id", F.unix_micros("at").alias("at_us"))


@query("win_trailing_count", "SELECT event_id AS job_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def _(v):
    return v.jobs.select("job_id", N.trailing_count(v.jobs, "tenant_id", "at", 3600).alias("n"))


@query("win_first_of_duplicates", "SELECT text_md5, doc_id FROM (SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY ALL)")
def _(v):
    return v.texts.groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.min("comment_id").alias("doc_id"))


def extreme_sql(side: str) -> str:
    return f"{RUNS}, best AS (SELECT *, {side}::DOUBLE / total AS share FROM topics WHERE total >= 30 QUALIFY row_number() OVER (PARTITION BY execution_id ORDER BY {side}::DOUBLE / total DESC, topic) = 1) SELECT b.execution_id, b.topic, round_even(b.share * 100, 1) AS percent, b.total AS sample, round_even(r.{side}::DOUBLE / r.total * 100, 1) AS run_percent FROM best b JOIN runs r USING (execution_id) WHERE b.{side} > 0 AND r.total >= 100"


@query("fact_most_criticized_topic", extreme_sql("negative"))
def _(v):
    return X.topic_extreme(topics(v), runs(v), "negative", DEFAULT)


@query("fact_best_received_topic", extreme_sql("positive"))
def _(v):
    return X.topic_extreme(topics(v), runs(v), "positive", DEFAULT)


NUM = "regexp_replace(replace(printf('%.1f', {}), '.', ','), ',0$', '')"


@query("str_s_most_criticized", f"WITH f AS ({extreme_sql('negative')}) SELECT execution_id, 'O tema “' || topic || '” é o que mais concentra críticas: ' || {NUM.format('percent')} || '% dos ' || sample || ' comentários ligados a ele são negativos, contra ' || {NUM.format('run_percent')} || '% na execução inteira.' AS sentence FROM f")
def _(v):
    return X.topic_extreme(topics(v), runs(v), "negative", DEFAULT).select("execution_id", X.sentence_topic("negative").alias("sentence"))


@query("str_s_best_received", f"WITH f AS ({extreme_sql('positive')}) SELECT execution_id, 'O tema “' || topic || '” é o mais bem recebido: ' || {NUM.format('percent')} || '% dos ' || sample || ' comentários ligados a ele são positivos, contra ' || {NUM.format('run_percent')} || '% na execução inteira.' AS sentence FROM f")
def _(v):
    return X.topic_extreme(topics(v), runs(v), "positive", DEFAULT).select("execution_id", X.sentence_topic("positive").alias("sentence"))


def video_sql(multiple: float) -> str:
    return f"{RUNS} SELECT v.execution_id, v.youtube_id, round_even(v.negative::DOUBLE / v.total * 100, 1) AS percent, v.total AS sample, round_even(r.negative::DOUBLE / r.total * 100, 1) AS run_percent, round_even((v.negative::DOUBLE / v.total) / (r.negative::DOUBLE / r.total), 1) AS multiple FROM videos v JOIN runs r USING (execution_id) WHERE v.total >= 30 AND r.total >= 100 AND r.negative > 0 AND v.negative::DOUBLE / v.total >= (r.negative::DOUBLE / r.total) * {multiple}::DOUBLE"


for _name, _t in (("", DEFAULT), ("_relaxed", RELAXED)):

    @query("fact_very_negative_video" + _name, video_sql(_t.video_multiple))
    def _(v, t=_t):
        return X.very_negative_videos(videos(v), runs(v), t)


@query("ui_outlier_video", f"{RUNS} SELECT v.execution_id, v.youtube_id FROM videos v JOIN runs r USING (execution_id) WHERE v.total > 0 AND r.negative > 0 AND v.negative::DOUBLE / v.total >= (r.negative::DOUBLE / r.total) * 1.1::DOUBLE")
def _(v):
    return X.very_negative_videos(videos(v), runs(v), X.Thresholds(video_min=1, run_min=1, video_multiple=1.1)).select("execution_id", "youtube_id")


def concentrated_sql(share: float, most: float) -> str:
    return f"{RUNS}, few AS (SELECT execution_id, topic, negative FROM (SELECT *, sum(negative) OVER (PARTITION BY execution_id) AS t, coalesce(sum(negative) OVER (PARTITION BY execution_id ORDER BY negative DESC, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM topics) WHERE t > 0 AND b < t * {share}::DOUBLE), a AS (SELECT execution_id, count(*) AS topics, sum(negative) AS negatives FROM topics GROUP BY ALL), g AS (SELECT execution_id, count(*) AS pointed, sum(negative) AS s, string_agg(topic, ', ' ORDER BY negative DESC, topic) AS labels FROM few GROUP BY ALL) SELECT execution_id, pointed::BIGINT AS pointed, topics::BIGINT AS topics, round_even(s::DOUBLE / negatives * 100, 1) AS percent, labels FROM g JOIN a USING (execution_id) WHERE pointed <= topics * {most}::DOUBLE"


@query("fact_concentration", concentrated_sql(0.6, 0.5))
def _(v):
    return X.concentrated(topics(v), DEFAULT)


@query("str_s_concentration", f"WITH f AS ({concentrated_sql(0.6, 0.5)}) SELECT execution_id, 'As críticas estão concentradas: ' || pointed || ' ' || CASE WHEN pointed > 1 THEN 'temas concentram' ELSE 'tema concentra' END || ' ' || {NUM.format('percent')} || '% dos comentários negativos da execução, de um total de ' || topics || ' temas (' || labels || ').' AS sentence FROM f")
def _(v):
    return X.concentrated(topics(v), DEFAULT).select("execution_id", X.sentence_concentration().alias("sentence"))


def shift_sql(z: float) -> str:
    return f"{PAIRS}, s AS (SELECT *, negative::DOUBLE / total AS a, before_negative::DOUBLE / before_total AS b FROM pairs WHERE before_total >= 100 AND total >= 100), m AS (SELECT *, {z}::DOUBLE * sqrt(a * (1 - a) / total + b * (1 - b) / before_total) AS mg FROM s) SELECT model_id, before_execution_id, execution_id, round_even(b * 100, 1) AS percent_before, round_even(a * 100, 1) AS percent_after, round_even((a - b) * 100, 1) AS difference, round_even(mg * 100, 1) AS margin, least(total, before_total) AS sample FROM m WHERE abs(a - b) > mg"


def evolution_sql(z: float) -> str:
    return f"{PAIRS}, s AS (SELECT p.model_id, n.youtube_id, p.before_execution_id, p.execution_id, n.negative::DOUBLE / n.total AS a, o.negative::DOUBLE / o.total AS b, n.total AS tn, o.total AS tb FROM pairs p JOIN videos n ON n.execution_id = p.execution_id JOIN videos o ON o.execution_id = p.before_execution_id AND o.youtube_id = n.youtube_id WHERE n.total >= 30 AND o.total >= 30), m AS (SELECT *, {z}::DOUBLE * sqrt(a * (1 - a) / tn + b * (1 - b) / tb) AS mg FROM s) SELECT model_id, youtube_id, before_execution_id, execution_id, round_even(b * 100, 1) AS percent_before, round_even(a * 100, 1) AS percent_after, round_even((a - b) * 100, 1) AS difference, round_even(mg * 100, 1) AS margin, least(tn, tb) AS sample FROM m WHERE abs(a - b) > mg"


for _name, _t in (("", DEFAULT), ("_relaxed", RELAXED)):

    @query("fact_sentiment_shift" + _name, shift_sql(_t.z))
    def _(v, t=_t):
        return X.sentiment_shift(runs(v), t)

    @query("fact_video_evolution" + _name, evolution_sql(_t.z))
    def _(v, t=_t):
        return X.video_evolution(videos(v), runs(v), t)


@query("join_cross_run_video", f"{PAIRS} SELECT p.model_id, n.youtube_id, p.before_execution_id, p.execution_id, o.negative AS before_negative, n.negative FROM pairs p JOIN videos n ON n.execution_id = p.execution_id JOIN videos o ON o.execution_id = p.before_execution_id AND o.youtube_id = n.youtube_id")
def _(v):
    pairs = N.consecutive(runs(v), ["execution_id"]).select("model_id", "execution_id", "before_execution_id")
    now, old = videos(v).select("execution_id", "youtube_id", "negative"), videos(v).select(F.col("execution_id").alias("before_execution_id"), "youtube_id", F.col("negative").alias("before_negative"))
    return pairs.join(now, "execution_id").join(old, ["before_execution_id", "youtube_id"]).select("model_id", "youtube_id", "before_execution_id", "execution_id", "before_negative", "negative")


@query("str_s_shift", f"WITH f AS ({shift_sql(0.5)}) SELECT model_id, execution_id, 'A rejeição ' || CASE WHEN difference > 0 THEN 'subiu' ELSE 'caiu' END || ' entre as duas coletas: ' || {NUM.format('percent_before')} || '% para ' || {NUM.format('percent_after')} || '% de comentários negativos, uma diferença de ' || {NUM.format('abs(difference)')} || ' pontos que excede a margem de incerteza de ' || {NUM.format('margin')} || ' pontos.' AS sentence FROM f")
def _(v):
    return X.sentiment_shift(runs(v), RELAXED).select("model_id", "execution_id", X.sentence_shift().alias("sentence"))


@query("str_s_video_evolution", f"WITH f AS ({evolution_sql(0.5)}) SELECT youtube_id, execution_id, 'O vídeo “' || youtube_id || '” ' || CASE WHEN difference > 0 THEN 'piorou' ELSE 'melhorou' END || ' entre as coletas: ' || {NUM.format('percent_before')} || '% para ' || {NUM.format('percent_after')} || '% de comentários negativos, uma diferença de ' || {NUM.format('abs(difference)')} || ' pontos acima da margem de ' || {NUM.format('margin')} || ' pontos.' AS sentence FROM f")
def _(v):
    return X.video_evolution(videos(v), runs(v), RELAXED).select("youtube_id", "execution_id", X.sentence_evolution().alias("sentence"))


@query("str_s_negative_video", f"WITH f AS ({video_sql(1.1)}) SELECT execution_id, youtube_id, 'O vídeo “' || youtube_id || '” recebe proporcionalmente muito mais crítica que os demais: ' || {NUM.format('percent')} || '% dos ' || sample || ' comentários dele são negativos, ' || {NUM.format('multiple')} || 'x a marca da execução (' || {NUM.format('run_percent')} || '%).' AS sentence FROM f")
def _(v):
    return X.very_negative_videos(videos(v), runs(v), RELAXED).select("execution_id", "youtube_id", X.sentence_video().alias("sentence"))


@query("fact_run_bundle")
def _(v):
    return X.run_bundle(runs(v), topics(v), videos(v), RELAXED)


@query("fact_campaign_bundle")
def _(v):
    a = X.sentiment_shift(runs(v), RELAXED).select("model_id", "execution_id", F.lit("sentiment_shift").alias("kind"), X.sentence_shift().alias("sentence"))
    b = X.video_evolution(videos(v), runs(v), RELAXED).select("model_id", "execution_id", F.lit("video_evolution").alias("kind"), X.sentence_evolution().alias("sentence"))
    return a.unionByName(b)


@query("fact_attention_point")
def _(v):
    return X.topic_extreme(topics(v), runs(v), "negative", DEFAULT).select("execution_id", F.col("topic").alias("attention"), "percent", "sample")


SENTENCES = ("str_s_most_criticized", "str_s_best_received", "str_s_negative_video", "str_s_concentration", "str_s_shift", "str_s_video_evolution")


@query("str_fact_sentence", " UNION ALL ".join(f"SELECT '{name.removeprefix('str_s_')}' AS kind, execution_id, sentence FROM ({ORACLES[name]})" for name in SENTENCES))
def _(v):
    """The sentence of every fact of every kind."""
    each = [
        X.topic_extreme(topics(v), runs(v), "negative", DEFAULT).select("execution_id", X.sentence_topic("negative").alias("sentence")),
        X.topic_extreme(topics(v), runs(v), "positive", DEFAULT).select("execution_id", X.sentence_topic("positive").alias("sentence")),
        X.very_negative_videos(videos(v), runs(v), RELAXED).select("execution_id", X.sentence_video().alias("sentence")),
        X.concentrated(topics(v), DEFAULT).select("execution_id", X.sentence_concentration().alias("sentence")),
        X.sentiment_shift(runs(v), RELAXED).select("execution_id", X.sentence_shift().alias("sentence")),
        X.video_evolution(videos(v), runs(v), RELAXED).select("execution_id", X.sentence_evolution().alias("sentence")),
    ]
    out = None
    for name, df in zip(SENTENCES, each, strict=True):
        named = df.select(F.lit(name.removeprefix("str_s_")).alias("kind"), "execution_id", "sentence")
        out = named if out is None else out.unionByName(named)
    return out


@query("st_two_proportions", f"{PAIRS}, s AS (SELECT *, negative::DOUBLE / total AS a, before_negative::DOUBLE / before_total AS b FROM pairs WHERE before_total IS NOT NULL) SELECT model_id, execution_id, round(1.96::DOUBLE * sqrt(a * (1 - a) / total + b * (1 - b) / before_total), 9) AS margin, abs(a - b) > 1.96::DOUBLE * sqrt(a * (1 - a) / total + b * (1 - b) / before_total) AS significant FROM s")
def _(v):
    p = N.consecutive(runs(v), ["negative", "total"])
    a, b = A.fraction("negative", "total"), A.fraction("before_negative", "before_total")
    m = X.margin(b, F.col("before_total"), a, F.col("total"), 1.96)
    return p.select("model_id", "execution_id", F.round(m, 9).alias("margin"), (F.abs(a - b) > m).alias("significant"))


@query("st_se_proportion", f"{RUNS} SELECT execution_id, round(sqrt((negative::DOUBLE / total) * (1 - negative::DOUBLE / total) / total), 9) AS se FROM runs")
def _(v):
    return runs(v).select("execution_id", F.round(X.standard_error(A.fraction("negative", "total"), F.col("total")), 9).alias("se"))


@query("st_percent_points", f"{RUNS} SELECT execution_id, round_even(negative::DOUBLE / total * 100, 1) AS percent FROM runs")
def _(v):
    return runs(v).select("execution_id", X.points(A.fraction("negative", "total")).alias("percent"))


@query("str_number_pt", f"{RUNS} SELECT execution_id, {NUM.format('round_even(negative::DOUBLE / total * 100, 1)')} AS shown FROM runs")
def _(v):
    return runs(v).select("execution_id", X.number_pt(X.points(A.fraction("negative", "total"))).alias("shown"))


@query("st_topic_count", f"{RUNS} SELECT execution_id, greatest(3, least(8, least(total // 30, round_even(sqrt(total::DOUBLE) / 4, 0)::BIGINT)))::BIGINT AS k FROM runs")
def _(v):
    n = F.col("total")
    k = F.greatest(F.lit(3), F.least(F.lit(8), F.floor(n / 30), F.bround(F.sqrt(n.cast("double")) / 4).cast("long")))
    return runs(v).select("execution_id", k.cast("long").alias("k"))


@query("ui_percent_triplet", f"{RUNS} SELECT execution_id, floor(positive::DOUBLE / total * 100 + 0.5)::BIGINT AS p, floor(neutral::DOUBLE / total * 100 + 0.5)::BIGINT AS n, greatest(0, 100 - floor(positive::DOUBLE / total * 100 + 0.5)::BIGINT - floor(neutral::DOUBLE / total * 100 + 0.5)::BIGINT)::BIGINT AS m FROM runs")
def _(v):
    p, n = (F.floor(A.fraction(c, "total") * 100 + 0.5) for c in ("positive", "neutral"))
    return runs(v).select("execution_id", p.alias("p"), n.alias("n"), F.greatest(F.lit(0).cast("long"), 100 - p - n).alias("m"))


@query("ui_percent", f"{RUNS} SELECT execution_id, floor(negative::DOUBLE / total * 100 + 0.5)::BIGINT AS percent FROM runs")
def _(v):
    return runs(v).select("execution_id", F.floor(A.fraction("negative", "total") * 100 + 0.5).alias("percent"))


@query("ui_abbreviate", f"{REACH} SELECT execution_id, CASE WHEN views >= 1000000 THEN replace(printf('%.1f', views / 1000000.0), '.', ',') || ' mi' WHEN views >= 1000 THEN floor(views / 1000.0 + 0.5)::BIGINT || ' mil' ELSE views::VARCHAR END AS shown FROM vv")
def _(v):
    x = F.col("views")
    shown = F.when(x >= 1_000_000, F.concat(F.replace(F.format_string("%.1f", x / 1_000_000.0), F.lit("."), F.lit(",")), F.lit(" mi")))
    shown = shown.when(x >= 1000, F.concat(F.floor(x / 1000.0 + 0.5).cast("string"), F.lit(" mil"))).otherwise(x.cast("string"))
    return v.orders.groupBy("execution_id").agg(F.sum("views").alias("views")).select("execution_id", shown.alias("shown"))
