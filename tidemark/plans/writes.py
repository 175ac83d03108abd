"""Queries that write and read again, and those over files: sources, sinks, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import aggregates as A, evaluation as E, jobs as J, sampling as S
from ..sources import files
from ..sources.store import Table, markdown, through_csv, through_json, through_text
from .bindings import ORDERS_SQL, TEXTS_SQL, TOPICS_SQL
from .kernels import CLASSES, LEX, PAIRS_SQL, RATINGS_SQL, VOTES, WORDS_SQL, pairs, ratings
from .registrar import query

W_ORDERS, W_TOPICS, W_TEXTS = f"WITH {ORDERS_SQL}", f"WITH {TOPICS_SQL}", f"WITH {TEXTS_SQL}"


# Sources ------------------------------------------------------------------------------------------------------
LINES_SQL = """
  SELECT p_name AS form, p_size % 3 - 1 AS n0, p_size % 5 - 2 AS n1, p_partkey FROM part
"""
POLARITY_SQL = "CASE WHEN n0 <> 0 THEN n0 WHEN n1 IN (-1, 1) THEN n1 ELSE n0 END"


def lexicon_lines(v):
    n0, n1 = F.col("p_size") % 3 - 1, F.col("p_size") % 5 - 2
    line = F.format_string("%s,%s.PoS=N;FLEX=ms;TG=HUM;POL:N0=%d;POL:N1=%d", "p_name", "p_name", n0, n1)
    noise = F.when(F.col("p_partkey") % 10 == 0, F.concat(F.lit("# "), line)).when(F.col("p_partkey") % 10 == 1, F.lit("")).when(F.col("p_partkey") % 10 == 2, F.col("p_name")).otherwise(line)
    return v.table("part").select(noise.alias("value"))


@query("src_lexicon_file", f"""
SELECT form, ({POLARITY_SQL})::INTEGER AS polarity, CASE WHEN form LIKE '% %' THEN 'multiword' ELSE 'ok' END AS kind
FROM ({LINES_SQL}) WHERE p_partkey % 10 > 2
""")
def _(v):
    return files.parse_lexicon(through_text(lexicon_lines(v)))


@query("udf_lexicon_polarity", f"""
SELECT n0, n1, ({POLARITY_SQL})::INTEGER AS polarity, count(*)::BIGINT AS n
FROM (SELECT (p_size % 3 - 1)::INTEGER AS n0, (p_size % 5 - 2)::INTEGER AS n1 FROM part) GROUP BY ALL
""")
def _(v):
    """A line for every part goes through the parser; its form names the two polarities, so each parsed value is told apart."""
    n0, n1 = F.col("p_size") % 3 - 1, F.col("p_size") % 5 - 2
    lines = v.table("part").select(F.format_string("w%d:%d,w.PoS=N;POL:N0=%d;POL:N1=%d", n0, n1, n0, n1).alias("value"))
    parsed = files.parse_lexicon(lines).groupBy("form", "polarity").agg(F.count("*").alias("n"))
    said = F.split(F.substring("form", 2, 10), ":")
    return parsed.select(said[0].cast("int").alias("n0"), said[1].cast("int").alias("n1"), "polarity", "n")


SHEET_SQL = """
  SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE doc_id::VARCHAR END AS id,
         CASE WHEN doc_id % 17 = 0 THEN 'maybe' WHEN doc_id % 5 = 0 THEN 'NEUTRO' WHEN doc_id % 7 = 0 THEN ' positivo' ELSE 'negativo' END AS label
  FROM labels
"""


@query("src_rater_sheet", f"""
SELECT doc_id AS id, CASE WHEN lower(trim(label)) IN ('positivo', 'neutro', 'negativo') THEN lower(trim(label)) END AS label,
       CASE WHEN lower(trim(label)) NOT IN ('positivo', 'neutro', 'negativo') THEN 'unknown'
            WHEN label <> lower(trim(label)) THEN 'normalized' END AS note
FROM ({SHEET_SQL}) WHERE id <> ''
""")
def _(v):
    d = F.col("doc_id")
    label = F.when(d % 17 == 0, "maybe").when(d % 5 == 0, "NEUTRO").when(d % 7 == 0, " positivo").otherwise("negativo")
    sheet = v.table("labels").select(F.when(d % 13 == 0, "").otherwise(d.cast("string")).alias("id"), F.lit("").alias("text"), label.alias("label"), F.lit("").alias("doubt"), F.lit("").alias("note"))
    return files.rater_sheet(through_csv(sheet))


@query("src_examples_csv", "SELECT doc_id AS id, source AS video, md5(text) AS digest FROM documents")
def _(v):
    path = v.table("documents").select(F.col("doc_id").alias("id"), F.col("source").alias("video"), "text")
    back = files.required(through_csv(path), ["id", "video", "text"])
    return back.select(F.col("id").cast("long"), "video", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("src_tokens_corpus", r"""
SELECT doc_id AS id, length(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^ ]', '', 'g'))::INTEGER + 1 AS words FROM documents
""")
def _(v):
    d = v.table("documents").select(F.col("doc_id").alias("id"), T.canonical(F.col("text")).alias("text"), T.model_text(F.col("text")).alias("model_text"))
    back = files.required(through_csv(d), ["id", "text", "model_text"])
    return back.select(F.col("id").cast("long"), (F.length(F.regexp_replace("text", "[^ ]", "")) + 1).alias("words"))


@query("src_llm_json", """
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'neutro' ELSE 'positivo' END AS label FROM documents WHERE doc_id // 10 % 7 <> 0
""")
def _(v):
    d = F.col("doc_id")
    item = F.struct(d.alias("id"), F.when(d % 3 == 0, "neutro").otherwise("positivo").alias("label"))
    answer = v.table("documents").groupBy(F.floor(d / 10).alias("batch")).agg(F.to_json(F.collect_list(item)).alias("json"))
    body = F.when(F.col("batch") % 7 == 0, "no answer").when(F.col("batch") % 2 == 0, F.concat(F.lit("```json\n"), "json", F.lit("\n```"))).otherwise(F.col("json"))
    return files.llm_labels(answer.select(body.alias("answer")), "answer")


@query("src_model_card", """
SELECT n_nationkey AS card, CASE WHEN n_nationkey % 4 = 1 THEN 'key missing' WHEN n_nationkey % 4 = 2 THEN 'ids not contiguous'
       WHEN n_nationkey % 4 = 3 THEN 'unknown label' END AS problem FROM nation
""")
def _(v):
    k = F.col("n_nationkey") % 4
    labels = F.when(k == 2, F.lit('{"0": "negativo", "2": "neutro"}')).when(k == 3, F.lit('{"0": "negativo", "1": "talvez"}')).otherwise(F.lit('{"0": "negativo", "1": "neutro", "2": "positivo"}'))
    name = F.when(k == 1, F.lit("")).otherwise(F.lit('"name": "m", "version": "1", '))
    cards = v.table("nation").select(F.concat(F.lit('{"card": '), F.col("n_nationkey").cast("string"), F.lit(", "), name, F.lit('"labels": '), labels, F.lit("}")).alias("value"))
    return files.model_cards(through_text(cards), ["name", "version"]).select(F.col("card").cast("int"), "problem")


@query("src_artifact_check", "SELECT 'absent.bin' AS path, 'missing' AS state UNION ALL SELECT 'region.parquet', 'different'")
def _(v):
    have = v.spark.read.format("binaryFile").load([f"{v.sf_dir}/region.parquet", f"{v.sf_dir}/nation.parquet"])
    right = have.where(F.col("path").endswith("nation.parquet")).select(F.lit("nation.parquet").alias("path"), F.sha2("content", 256).alias("sha256"))
    wrong = v.spark.range(2).select(F.when(F.col("id") == 0, "region.parquet").otherwise("absent.bin").alias("path"), F.lit("0" * 64).alias("sha256"))
    return files.manifest_check(have, right.union(wrong))


@query("src_fold_assignment", "SELECT source AS video, min(doc_id) % 5 AS fold, 1::BIGINT AS folds FROM documents GROUP BY ALL")
def _(v):
    fold = v.table("documents").groupBy(F.col("source").alias("video")).agg((F.min("doc_id") % 5).alias("fold"))
    report = through_json(fold.groupBy("fold").agg(F.collect_list("video").alias("videos")), "fold long, videos array<string>")
    return files.fold_assignment(report)


@query("src_videos_api", f"""{W_ORDERS}
SELECT execution_id, youtube_id, max(views)::BIGINT AS views, CASE WHEN execution_id % 4 = 0 THEN NULL ELSE count(*) END::BIGINT AS comments,
       CASE WHEN execution_id % 3 = 0 THEN 0 ELSE count(*) END::BIGINT AS likes
FROM orders_v GROUP BY execution_id, youtube_id
""")
def _(v):
    per = v.orders.groupBy("execution_id", "youtube_id").agg(F.max("views").cast("string").alias("viewCount"), F.count("*").cast("string").alias("n"))
    hidden = lambda k: F.when(F.col("execution_id") % k != 0, F.col("n"))
    landed = per.select("execution_id", "youtube_id", F.struct("viewCount", hidden(4).alias("commentCount"), hidden(3).alias("likeCount")).alias("statistics"))
    back = through_json(landed, "execution_id long, youtube_id string, statistics struct<viewCount:string,commentCount:string,likeCount:string>")
    return files.video_metadata(back, "execution_id", "youtube_id")


@query("src_api_metering", """
SELECT tenant_id, count(*) FILTER (before < 20)::BIGINT AS made, least(20, sum(cost))::BIGINT AS units FROM (
  SELECT user_id AS tenant_id, (event_type <> 'signup')::INT AS cost,
         coalesce(sum((event_type <> 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM events) GROUP BY ALL
""")
def _(v):
    free = F.col("event_type") == "signup"
    made = J.metered(v.jobs, "tenant_id", ["job_id"], free, 20)
    return made.groupBy("tenant_id").agg(F.count_if("made").alias("made"), F.count_if(F.col("made") & ~free).alias("units"))


# Scans --------------------------------------------------------------------------------------------------------
@query("scan_topic_corpus", f"{W_TEXTS} SELECT execution_id, comment_id, video, md5(text) AS digest FROM texts WHERE length(trim(text)) > 0")
def _(v):
    t = v.texts.where(F.length(F.trim("text")) > 0)
    return t.sortWithinPartitions("execution_id", "comment_id").select("execution_id", "comment_id", "video", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("scan_train_pool", f"WITH {PAIRS_SQL} SELECT doc_id, gold AS weak, md5(trim(text)) AS digest FROM pairs JOIN documents USING (doc_id) WHERE fold > 1 AND trim(text) <> ''")
def _(v):
    pool = pairs(v).where("fold > 1").join(v.table("documents").select("doc_id", "text"), "doc_id")
    return pool.where((F.trim("text") != "") & F.col("gold").isin(*CLASSES)).select("doc_id", F.col("gold").alias("weak"), F.md5(F.trim("text").cast("binary")).alias("digest"))


@query("scan_leak_corpus", f"""WITH {PAIRS_SQL}
SELECT d.doc_id, source AS video, CASE WHEN fold = 0 THEN 'test' END AS split, predicted AS weak, CASE WHEN fold = 0 THEN gold END AS human
FROM documents d LEFT JOIN pairs p ON d.doc_id = p.doc_id
""")
def _(v):
    test = F.col("fold") == 0
    d = v.table("documents").select("doc_id", F.col("source").alias("video"))
    return d.join(pairs(v), "doc_id", "left").select("doc_id", "video", F.when(test, "test").alias("split"), F.col("predicted").alias("weak"), F.when(test, F.col("gold")).alias("human"))


@query("scan_labels_column", f"WITH {PAIRS_SQL} SELECT doc_id, gold AS label FROM pairs WHERE fold = 0")
def _(v):
    return files.label_column(pairs(v).where("fold = 0"), "doc_id", "gold", ("gold", "predicted"))


@query("scan_sampleable", f"WITH {PAIRS_SQL} SELECT doc_id, predicted AS weak FROM pairs WHERE fold > 1")
def _(v):
    return pairs(v).withColumn("split", F.when(F.col("fold") <= 1, "test")).where("split is null and predicted is not null").select("doc_id", F.col("predicted").alias("weak"))


@query("scan_rater_sample", f"WITH {PAIRS_SQL} SELECT doc_id, length(text)::INTEGER AS n FROM pairs JOIN documents USING (doc_id) WHERE fold = 0")
def _(v):
    return pairs(v).where("fold = 0").select("doc_id").join(v.table("documents").select("doc_id", F.length("text").alias("n")), "doc_id")


@query("scan_lexicon_test", f"WITH {PAIRS_SQL} SELECT doc_id, md5(text) AS digest, gold FROM pairs JOIN documents USING (doc_id) WHERE fold = 0")
def _(v):
    return pairs(v).where("fold = 0").join(v.table("documents").select("doc_id", "text"), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "gold")


# Sinks --------------------------------------------------------------------------------------------------------
def collected(v):
    return v.orders.groupBy("execution_id", "youtube_id").agg(F.count("*").alias("videos"), F.sum("views").alias("views"))


@query("sink_collection", f"""{W_ORDERS}
SELECT execution_id, youtube_id, count(*)::BIGINT AS videos, sum(views)::BIGINT AS views, CASE WHEN execution_id % 10 = 5 THEN 2 ELSE 1 END AS attempt
FROM orders_v WHERE execution_id % 10 <> 5 OR youtube_id <> 'BUILDING' GROUP BY ALL
""")
def _(v):
    """A second collection of some runs, which finds fewer videos, takes the place of the first."""
    t = Table(v.spark, "execution_id").replace(collected(v).withColumn("attempt", F.lit(1)))
    again = collected(v).where("execution_id % 10 = 5 and youtube_id <> 'BUILDING'").withColumn("attempt", F.lit(2))
    return t.replace(again).replace(again).read().select(F.col("execution_id").cast("long"), "youtube_id", "videos", "views", "attempt")


@query("sink_drop_collection", f"{W_ORDERS} SELECT execution_id, youtube_id, count(*)::BIGINT AS videos FROM orders_v WHERE execution_id % 10 <> 5 GROUP BY ALL")
def _(v):
    t = Table(v.spark, "execution_id").replace(collected(v))
    gone = v.executions.where("execution_id % 10 = 5").select("execution_id")
    return t.drop(gone).read().select(F.col("execution_id").cast("long"), "youtube_id", "videos")


@query("sink_inference", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS batch, CASE WHEN n_chars % 3 = 0 THEN 'neutro' ELSE 'positivo' END AS label FROM documents")
def _(v):
    """A load that ended halfway is taken up: only rows without a result are added."""
    d = v.table("documents").select("doc_id", F.when(F.col("n_chars") % 3 == 0, "neutro").otherwise("positivo").alias("label"))
    checked = d.where(F.col("label").isin(*files.LABELS))
    t = Table(v.spark).append(checked.where("doc_id % 2 = 0").withColumn("batch", F.lit(1)))
    return t.append_missing(checked.withColumn("batch", F.lit(2)), "doc_id").read().select("doc_id", "batch", "label")


@query("sink_topics", f"{W_TOPICS} SELECT execution_id, topic, count(*)::BIGINT AS links FROM topic_links WHERE execution_id % 2 = 0 OR topic LIKE 'Brand%' GROUP BY ALL")
def _(v):
    """Topics of odd runs are computed anew, from brands alone, and replace those of types and brands."""
    n = v.topic_links.groupBy("execution_id", "topic").agg(F.count("*").alias("links"))
    t = Table(v.spark, "execution_id").replace(n)
    return t.replace(n.where("execution_id % 2 = 1 and topic like 'Brand%'")).read().select(F.col("execution_id").cast("long"), "topic", "links")


@query("sink_drop_topics", f"{W_TOPICS} SELECT execution_id, count(DISTINCT topic)::BIGINT AS topics FROM topic_links WHERE execution_id % 2 = 0 GROUP BY ALL")
def _(v):
    t = Table(v.spark, "execution_id").replace(v.topic_links.select("execution_id", "topic").distinct())
    kept = t.drop(v.executions.where("execution_id % 2 = 1").select("execution_id")).read()
    return kept.groupBy(F.col("execution_id").cast("long").alias("execution_id")).agg(F.count("*").alias("topics"))


@query("sink_weak_labels", f"WITH {PAIRS_SQL} SELECT d.doc_id, p.predicted AS weak FROM documents d LEFT JOIN pairs p USING (doc_id)")
def _(v):
    t = Table(v.spark).rewrite(v.table("documents").select("doc_id", F.lit(None).cast("string").alias("weak")))
    return t.update(pairs(v).select("doc_id", F.col("predicted").alias("weak")), "doc_id").read()


@query("sink_gold", f"""{VOTES} SELECT d.doc_id, CASE WHEN negative >= 2 THEN 'negative' WHEN neutral >= 2 THEN 'neutral' WHEN positive >= 2 THEN 'positive' END AS gold
FROM documents d LEFT JOIN votes v USING (doc_id)""")
def _(v):
    """The majority label; ties clear what was there."""
    t = Table(v.spark).rewrite(v.table("documents").select("doc_id", F.lit(None).cast("string").alias("gold")))
    return t.update(A.majority(ratings(v), "doc_id", "label").select("doc_id", F.col("majority").alias("gold")), "doc_id").read()


@query("sink_lexicon_predictions", f"""
SELECT doc_id, CASE WHEN score > 0 THEN 'positive' WHEN score < 0 THEN 'negative' ELSE 'neutral' END AS label, md5(terms) AS terms FROM (
  SELECT doc_id, coalesce(list_sum(list_transform(found, lambda x: m[x])), 0) AS score, array_to_string(list_transform(found, lambda x: x || ':' || m[x]), '|') AS terms FROM (
    SELECT doc_id, m, list_filter(w, lambda x: m[x] IS NOT NULL) AS found FROM (
      SELECT doc_id, {WORDS_SQL.format('lower(text)')} AS w, MAP {{{", ".join(f"'{k}': {p}" for k, p in LEX.items())}}} AS m FROM documents)))
""")
def _(v):
    lexicon = F.create_map(*[F.lit(x) for kv in LEX.items() for x in kv])
    s = v.table("documents").select("doc_id", T.lexicon_score(T.words(F.lower("text")), lexicon).alias("s"))
    packed = F.array_join(F.transform("s.terms", lambda t: F.concat(t["word"], F.lit(":"), t["polarity"].cast("string"))), "|")
    back = through_csv(s.select("doc_id", "s.label", packed.alias("terms")))
    return back.select(F.col("doc_id").cast("long"), "label", F.md5(F.coalesce("terms", F.lit("")).cast("binary")).alias("terms"))


@query("sink_bert_predictions", "SELECT vec_id, CASE WHEN s >= 0.5 THEN 'positive' ELSE 'negative' END AS label, round_even(greatest(s, 1 - s), 4) AS confidence FROM (SELECT vec_id, 1 / (1 + exp(-embedding[1]::DOUBLE)) AS s FROM embeddings)")
def _(v):
    s = 1 / (1 + F.exp(-F.get("embedding", 0).cast("double")))
    scored = v.table("embeddings").select("vec_id", s.alias("s")).select("vec_id", F.when(F.col("s") >= 0.5, "positive").otherwise("negative").alias("label"), F.bround(F.greatest("s", 1 - F.col("s")), 4).alias("confidence"))
    return through_csv(scored).select(F.col("vec_id").cast("long"), "label", F.col("confidence").cast("double"))


PRF_SQL = f"""WITH {PAIRS_SQL},
hits AS (
  SELECT class, count(*) FILTER (gold = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) AS pp, count(*) FILTER (gold = class) AS s
  FROM pairs, (SELECT unnest(['negative', 'neutral', 'positive']) AS class) GROUP BY ALL),
metrics AS (
  SELECT class, coalesce(tp::DOUBLE / nullif(pp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(s, 0), 0) AS recall, s::BIGINT AS support FROM hits),
scores AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM metrics)"""


def metric_rows(v):
    return E.prf(pairs(v), "gold", "predicted", CLASSES)


@query("sink_metric_tables", f"{PRF_SQL} SELECT '| ' || class || ' | ' || printf('%.4f', precision) || ' | ' || printf('%.4f', recall) || ' | ' || printf('%.4f', f1) || ' |' AS line FROM scores")
def _(v):
    four = [F.format_string("%.4f", c).alias(c) for c in ("precision", "recall", "f1")]
    back = through_csv(metric_rows(v).select("class", *four))
    return through_text(back.select(markdown(["class", "precision", "recall", "f1"]).alias("value"))).select(F.col("value").alias("line"))


@query("sink_metric_report", f"{PRF_SQL} SELECT class, precision, recall, f1, support FROM scores")
def _(v):
    return through_json(metric_rows(v).select("class", "precision", "recall", "f1", "support"), "class string, precision double, recall double, f1 double, support long")


AGREEMENT_SQL = f"""{VOTES},
per AS (SELECT *, (negative * (negative - 1) + neutral * (neutral - 1) + positive * (positive - 1))::DOUBLE / (raters * (raters - 1)) AS agree FROM votes),
total AS (SELECT count(*)::BIGINT AS items, avg(agree) AS observed, pow(sum(negative) / sum(raters), 2) + pow(sum(neutral) / sum(raters), 2) + pow(sum(positive) / sum(raters), 2) AS expected,
  count(*) FILTER (greatest(negative, neutral, positive) = 3)::BIGINT AS unanimous, count(*) FILTER (greatest(negative, neutral, positive) = 2)::BIGINT AS majority,
  count(*) FILTER (greatest(negative, neutral, positive) = 1)::BIGINT AS ties FROM per)
SELECT items, round(observed, 9) AS observed, round((observed - expected) / (1 - expected), 9) AS kappa, unanimous, majority, ties FROM total"""


def agreement(v):
    votes = E.vote_counts(ratings(v), "doc_id", "label", CLASSES)
    top = F.greatest(*CLASSES)
    kinds = votes.agg(F.count("*").alias("items"), *[F.count_if(top == n).alias(c) for n, c in ((3, "unanimous"), (2, "majority"), (1, "ties"))])
    k = E.fleiss(votes, CLASSES).select(F.round("observed", 9).alias("observed"), F.round("kappa", 9).alias("kappa"))
    return kinds.crossJoin(F.broadcast(k)).select("items", "observed", "kappa", "unanimous", "majority", "ties")  # one row each


@query("agg_agreement", AGREEMENT_SQL)
def _(v):
    return agreement(v)


@query("sink_agreement_report", AGREEMENT_SQL)
def _(v):
    return through_json(agreement(v), "items long, observed double, kappa double, unanimous long, majority long, ties long")


@query("sink_tiebreak_agenda", f"""{VOTES} SELECT doc_id, negative || '/' || neutral || '/' || positive AS votes,
CASE WHEN greatest(negative, neutral, positive) = 1 THEN 'tie' ELSE 'doubt' END AS reason FROM votes
WHERE greatest(negative, neutral, positive) = 1 OR doc_id % 11 = 0""")
def _(v):
    votes = E.vote_counts(ratings(v), "doc_id", "label", CLASSES)
    tie = F.greatest(*CLASSES) == 1
    agenda = votes.where(tie | (F.col("doc_id") % 11 == 0)).select("doc_id", F.concat_ws("/", *CLASSES).alias("votes"), F.when(tie, "tie").otherwise("doubt").alias("reason"))
    return through_csv(agenda).select(F.col("doc_id").cast("long"), "votes", "reason")


@query("sink_rater_sheets", f"""WITH {PAIRS_SQL}, sheets AS (SELECT unnest([42, 43, 44]) AS seed)
SELECT seed::INTEGER AS sheet, doc_id, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || ':' || doc_id), doc_id)::INTEGER AS place FROM pairs, sheets WHERE fold = 0""")
def _(v):
    """A sheet for each of three raters, each in an order of its own."""
    test = pairs(v).where("fold = 0").select("doc_id").withColumn("one", F.lit(1))
    every = [S.within(test, "one", "doc_id", seed).select(F.lit(seed).alias("sheet"), "doc_id", "place") for seed in (42, 43, 44)]
    return through_csv(every[0].union(every[1]).union(every[2])).select(F.col("sheet").cast("int"), F.col("doc_id").cast("long"), F.col("place").cast("int"))


@query("sink_sensitivity_table", f"{PRF_SQL} SELECT '| ' || class || ' | ' || replace(printf('%.3f', f1), '.', ',') || ' |' AS line FROM scores")
def _(v):
    rows = metric_rows(v).select("class", F.replace(F.format_string("%.3f", "f1"), F.lit("."), F.lit(",")).alias("f1"))
    return through_text(rows.select(markdown(["class", "f1"]).alias("value"))).select(F.col("value").alias("line"))


@query("sink_dlq", "SELECT doc_id AS job_id, md5(substr(text, 1, 2000)) AS error FROM documents WHERE doc_id % 6 >= 4")
def _(v):
    """Errors of jobs without attempts left; the cut is the table's own rule."""
    jobs = v.table("documents").select(F.col("doc_id").alias("job_id"), (F.col("doc_id") % 6).alias("attempts"), "text")
    dead = J.failed(jobs, F.col("text")).where("becomes = 'dlq'")
    return Table(v.spark).append(dead).read().select("job_id", F.md5(F.col("error").cast("binary")).alias("error"))
