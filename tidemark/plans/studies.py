"""Queries: samples, resamples, model selection, leakage, batch classification, the result screen."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E, matching as M, sampling as S, selection as ML
from .bindings import EXECUTIONS_SQL, TOPICS_SQL, counts_sql
from .kernels import CLASSES, LEX, LEX_SQL, PAIRS_SQL, WORDS_SQL, pairs
from .registrar import ORACLES, query
from .reports import runs, topics

ORDER = "md5('42:' || doc_id), doc_id"
WITHIN = f"WITH {PAIRS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY {ORDER}) AS place, count(*) OVER (PARTITION BY gold) AS size FROM pairs)"


def f1_sql(source: str, keys: str) -> str:
    """keys and macro F1 of a source with gold and predicted."""
    by = f"{keys}, " if keys else ""
    return f"""(SELECT {by}sum(coalesce(2.0::DOUBLE * tp / nullif(b, 0), 0)) / 3 AS macro_f1 FROM (
      SELECT {by}class, count(*) FILTER (gold = class AND predicted = class) AS tp, count(*) FILTER (predicted = class) + count(*) FILTER (gold = class) AS b
      FROM {source}, (SELECT unnest(['negative', 'neutral', 'positive']) AS class) GROUP BY ALL) {'GROUP BY ALL' if keys else ''})"""


# Samples ------------------------------------------------------------------------------------------------------
ORACLES["st_stratified_split"] = f"{WITHIN} SELECT doc_id, gold, CASE WHEN place <= round_even(size * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS side FROM placed"
ORACLES["st_stratified_folds"] = f"""{WITHIN}, sizes AS (SELECT gold, count(*) AS n FROM pairs GROUP BY ALL),
starts AS (SELECT gold, coalesce(sum(n) OVER (ORDER BY gold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes)
SELECT doc_id, gold, ((start + place - 1) % 5)::INTEGER AS deal FROM placed JOIN starts USING (gold)"""
ORACLES["st_round_robin_quota"] = f"{WITHIN} SELECT doc_id, gold, place::INTEGER AS place FROM placed ORDER BY place, gold LIMIT 60"
ORACLES["st_even_share"] = """
WITH w AS (SELECT c_custkey, list_transform(range(1, c_custkey % 5 + 2), lambda i: (i * i * 7)::BIGINT) AS wanted FROM customer),
r AS (SELECT c_custkey, list_reduce(list_prepend({'n': 40::BIGINT, 'taken': []::BIGINT[]}, list_transform(wanted, lambda x: {'n': x, 'taken': []::BIGINT[]})),
  lambda a, x: {'n': a.n - least(x.n, ceil(a.n / (len(wanted) - len(a.taken)))::BIGINT), 'taken': list_append(a.taken, least(x.n, ceil(a.n / (len(wanted) - len(a.taken)))::BIGINT))}) AS s FROM w)
SELECT c_custkey, s.taken AS taken FROM r
"""


@query("st_cochran", f"SELECT source, count(*)::BIGINT AS population, ceil({1.96 * 1.96 * 0.5 * 0.5 / (0.05 * 0.05)!r}::DOUBLE / (1 + {1.96 * 1.96 * 0.5 * 0.5 / (0.05 * 0.05) - 1!r}::DOUBLE / count(*)))::BIGINT AS sample FROM documents GROUP BY ALL")
def _(v):
    n = v.table("documents").groupBy("source").agg(F.count("*").alias("population"))
    return n.select("source", "population", S.cochran_size(F.col("population")).alias("sample"))


@query("agg_population_labelled", f"WITH {PAIRS_SQL} SELECT count(*)::BIGINT AS population FROM pairs WHERE gold IS NOT NULL")
def _(v):
    return pairs(v).where("gold is not null").agg(F.count("*").alias("population"))


@query("prj_split_reconstruct", f"""{WITHIN.replace("FROM pairs)", "FROM pairs WHERE fold <> 0)")}
SELECT doc_id, CASE WHEN place <= round_even(size * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS side FROM placed UNION ALL SELECT doc_id, 'test' FROM pairs WHERE fold = 0""")
def _(v):
    return ML.round_partition(pairs(v), "gold", "doc_id", F.col("fold") == 0).select("doc_id", "side")


# Resamples and weights ----------------------------------------------------------------------------------------
@query("st_bootstrap_paired")
def _(v):
    other = F.when(F.col("doc_id") % 3 == 0, "neutral").otherwise(F.col("predicted"))
    return E.bootstrap_paired(pairs(v).withColumn("other", other), "gold", "predicted", "other", CLASSES)


@query("st_bootstrap_strata")
def _(v):
    n = pairs(v).groupBy("predicted").agg(F.count("*").alias("N")).withColumnRenamed("predicted", "weak")
    sample = pairs(v).where("fold < 5").withColumn("weak", F.col("predicted"))
    return E.bootstrap_strata(sample, "gold", "predicted", CLASSES, "weak", n)


@query("st_weighted_confusion", f"""WITH {PAIRS_SQL}, w AS (SELECT predicted, count(*)::DOUBLE / count(*) FILTER (fold < 5) AS weight FROM pairs GROUP BY ALL)
SELECT gold, predicted, count(*) * weight AS weighted FROM pairs JOIN w USING (predicted) WHERE fold < 5 GROUP BY gold, predicted, weight""")
def _(v):
    w = pairs(v).groupBy("predicted").agg((F.count("*").cast("double") / F.count_if(F.col("fold") < 5)).alias("weight"))
    cells = pairs(v).where("fold < 5").groupBy("gold", "predicted").agg(F.count("*").alias("n"))
    return cells.join(F.broadcast(w), "predicted").select("gold", "predicted", (F.col("n") * F.col("weight")).alias("weighted"))  # a row a class


@query("st_drop_subset", f"WITH {PAIRS_SQL}, kept AS (SELECT * FROM pairs WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'es')) SELECT (SELECT count(*) FROM kept)::BIGINT AS n, macro_f1 FROM {f1_sql('kept', '')}")
def _(v):
    kept = pairs(v).join(v.table("documents").where("lang = 'es'").select("doc_id"), "doc_id", "left_anti").withColumn("one", F.lit(1))
    n = kept.groupBy("one").agg(F.count("*").alias("n"))
    return ML.fold_scores(kept, "gold", "predicted", CLASSES, "one").join(n, "one").select("n", "macro_f1")


FOLDED = f"WITH {PAIRS_SQL}, folded AS (SELECT p.*, doc_id % 5 AS random_fold, n_chars % 5 AS video_fold FROM pairs p JOIN documents USING (doc_id))"


@query("st_fold_drop", f"{FOLDED}, a AS (SELECT avg(macro_f1) AS f FROM {f1_sql('folded', 'random_fold')}), b AS (SELECT avg(macro_f1) AS f FROM {f1_sql('folded', 'video_fold')}) SELECT a.f - b.f AS drop_mean, CASE WHEN a.f - b.f >= 0.03 THEN 'relevant' ELSE 'small' END AS reading FROM a, b")
def _(v):
    d = v.table("documents").select("doc_id", (F.col("doc_id") % 5).alias("random_fold"), (F.col("n_chars") % 5).alias("video_fold"))
    folded = pairs(v).join(d, "doc_id")
    mean = lambda k: ML.fold_scores(folded, "gold", "predicted", CLASSES, k).agg(F.avg("macro_f1").alias(k))
    drop = F.col("random_fold") - F.col("video_fold")
    return mean("random_fold").crossJoin(F.broadcast(mean("video_fold"))).select(drop.alias("drop_mean"), F.when(drop >= ML.RELEVANT, "relevant").otherwise("small").alias("reading"))


@query("agg_latency_p95_index", "SELECT event_type, value AS at_share FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = least(floor(0.95::DOUBLE * n), n - 1)")
def _(v):
    n = v.table("events").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    return E.index_percentile(n, "value", "n", 0.95, "event_type")


# Classifiers --------------------------------------------------------------------------------------------------
WORDS = regex.compile(T.WORD)


def by_words(x: pd.Series) -> pd.DataFrame:
    """A classifier of batches: the sign of the sum of known words' polarities, with the sum as its reason."""
    sums = [sum(LEX.get(w, 0) for w in WORDS.findall(t.lower())) for t in x.fillna("")]
    return pd.DataFrame({"label": ["positive" if k > 0 else "negative" if k < 0 else "neutral" for k in sums], "justification": [f"soma {k:+d}" for k in sums]})


@query("udf_classifier_api", f"""
SELECT doc_id, CASE WHEN s > 0 THEN 'positive' WHEN s < 0 THEN 'negative' ELSE 'neutral' END AS label, 'soma ' || CASE WHEN s < 0 THEN '' ELSE '+' END || s AS justification, 'words' AS classifier
FROM (SELECT doc_id, ({LEX_SQL})::INT AS s FROM (SELECT doc_id, {WORDS_SQL.format("lower(coalesce(text, ''))")} AS w FROM documents))""")
def _(v):
    chosen = [None, ML.Classifier("words", 1, by_words)]
    return ML.classify(v.table("documents").select("doc_id", "text"), "text", chosen, 1).select("doc_id", "label", "justification", "classifier")


@query("udf_classifier_fallback", f"SELECT classifier, count(*)::BIGINT AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'old' ELSE 'fallback' END AS classifier FROM documents) GROUP BY ALL")
def _(v):
    """Each run takes the first classifier that knows its version of the text; chosen at start, one for the whole run."""
    old, late = ML.Classifier("old", 1, by_words), ML.Classifier("fallback", 2, by_words)
    d = v.table("documents").select("doc_id", "text", "lang")
    both = ML.classify(d.where("lang = 'en'"), "text", [old, late], 1).union(ML.classify(d.where("lang <> 'en' or lang is null"), "text", [old, late], 2))
    return both.groupBy("classifier").agg(F.count("*").alias("n"))


SOFT = "SELECT vec_id, [list_sum(list_filter(e, lambda x, i: i % 3 = 1)), list_sum(list_filter(e, lambda x, i: i % 3 = 2)), list_sum(list_filter(e, lambda x, i: i % 3 = 0))] AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def logits():
    """Three logits of an embedding: a linear head whose weights are one for every third component, all of which it reads."""
    e = F.col("embedding").cast("array<double>")
    one = lambda c: F.aggregate(F.filter(e, lambda x, i: i % 3 == c), F.lit(0.0), lambda a, x: a + x)
    return F.array(one(0), one(1), one(2))


@query("udf_transformer", f"SELECT vec_id, ['negative', 'neutral', 'positive'][list_position(z, list_max(z))] AS label, round(1 / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))), 9) AS confidence FROM ({SOFT})")
def _(v):
    """The last step of a transformer over given logits; weights are pluggable."""
    return v.table("embeddings").select("vec_id", ML.argmax_softmax(logits(), CLASSES).alias("p")).select("vec_id", "p.label", F.round("p.confidence", 9).alias("confidence"))


@query("ml_batch_predict", f"SELECT ['negative', 'neutral', 'positive'][list_position(z, list_max(z))] AS label, count(*)::BIGINT AS n FROM ({SOFT}) GROUP BY ALL")
def _(v):
    return v.table("embeddings").select(ML.argmax_softmax(logits(), CLASSES).alias("p")).groupBy(F.col("p.label").alias("label")).agg(F.count("*").alias("n"))


@query("ml_llm_stable_name", r"SELECT name, NOT regexp_matches(lower(name), 'preview|exp(?:erimental)?\b|latest') AS stable FROM (SELECT lower(p_name) || CASE p_partkey % 4 WHEN 0 THEN '-preview' WHEN 1 THEN '-exp' WHEN 2 THEN '-2.0' ELSE '-Latest' END AS name FROM part)")
def _(v):
    k = F.col("p_partkey") % 4
    name = F.concat(F.lower("p_name"), F.when(k == 0, "-preview").when(k == 1, "-exp").when(k == 2, "-2.0").otherwise("-Latest"))
    return v.table("part").select(name.alias("name")).select("name", ML.stable_name(F.col("name")).alias("stable"))


@query("ml_llm_calibration", f"WITH {PAIRS_SQL} SELECT fold, count(*) FILTER (gold <> predicted)::BIGINT AS errors, count(*) FILTER (gold <> predicted) <= 3 AS passes FROM pairs GROUP BY ALL")
def _(v):
    n = pairs(v).groupBy("fold").agg(F.count_if(F.col("gold") != F.col("predicted")).alias("errors"))
    return n.select("fold", "errors", (F.col("errors") <= 3).alias("passes"))


# Leakage and coverage -----------------------------------------------------------------------------------------
@query("agg_coverage", r"""
WITH s AS (SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda x: x IN ('the', 'que'))) AS up, len(list_filter(string_split(lower(text), ' '), lambda x: x IN ('and', 'der'))) AS down FROM documents)
SELECT CASE WHEN up > down THEN 'positive' WHEN up < down THEN 'negative' ELSE 'neutral' END AS label, count(*)::BIGINT AS n, count(*) FILTER (up + down = 0)::BIGINT AS absent, count(*) FILTER (up = down AND up > 0)::BIGINT AS tied FROM s GROUP BY ALL""")
def _(v):
    lexicon = F.create_map(*[F.lit(x) for kv in {"the": 1, "que": 1, "and": -1, "der": -1}.items() for x in kv])
    s = v.table("documents").select(T.lexicon_score(F.split(F.lower("text"), " "), lexicon).alias("s")).select("s.*")
    none, even = F.size("terms") == 0, (F.col("score") == 0) & (F.size("terms") > 0)
    return s.groupBy("label").agg(F.count("*").alias("n"), F.count_if(none).alias("absent"), F.count_if(even).alias("tied"))


@query("join_raters_same_ids", """
WITH r AS (SELECT unnest([1, 2, 3]) AS rater), s AS (SELECT doc_id, rater FROM labels, r WHERE (doc_id + rater) % 9 <> 0), ids AS (SELECT DISTINCT doc_id FROM s)
SELECT rater, doc_id FROM ids, r WHERE (doc_id, rater) NOT IN (SELECT (doc_id, rater) FROM s)""")
def _(v):
    """Ids that another rater has and this one doesn't."""
    s = v.table("labels").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rater")).where("(doc_id + rater) % 9 <> 0")
    return M.missing_by_rater(s, "doc_id", "rater", (1, 2, 3))


# Strings over characters, representatives, the screen ----------------------------------------------------------
SIGNS = {"❤": "coração", "🐈": "animal", "⭐": "estrela", "🔥": "fogo", "👋": "mão", "😀": "rosto", "☂": "emoji"}


@query("str_emoji_class", f"SELECT doc_id, CASE doc_id % {len(SIGNS)} " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(SIGNS.values())) + " END AS class FROM documents")
def _(v):
    sign = F.element_at(F.array(*map(F.lit, SIGNS)), (F.col("doc_id") % len(SIGNS) + 1).cast("int"))
    classes = v.spark.createDataFrame([(s, T.emoji_class(s)) for s in SIGNS], "sign string, class string")
    return v.table("documents").select("doc_id", sign.alias("sign")).join(F.broadcast(classes), "sign").select("doc_id", "class")


ORACLES["str_emoji_to_words"] = "SELECT doc_id, md5(trim(regexp_replace(replace(replace(text, '…', '...'), '´', ''''), '\\s+', ' ', 'g') || ' ' || CASE doc_id % 5 WHEN 0 THEN 'positivo' WHEN 1 THEN 'coração' WHEN 2 THEN 'bandeira do Brasil' WHEN 3 THEN 'animal' ELSE 'estrela' END)) AS digest FROM documents"
ORACLES["fact_attention_point"] = f"SELECT execution_id, topic AS attention, percent, sample FROM ({ORACLES['fact_most_criticized_topic']})"
ORACLES["fact_campaign_bundle"] = f"""SELECT model_id, execution_id, 'sentiment_shift' AS kind, sentence FROM ({ORACLES['str_s_shift']})
UNION ALL SELECT execution_id // 10000 AS model_id, execution_id, 'video_evolution' AS kind, sentence FROM ({ORACLES['str_s_video_evolution']})"""


@query("top_topic_representative_mem", f"WITH {TOPICS_SQL}, t AS ({counts_sql('topic_links', 'execution_id, topic')}) SELECT execution_id, arg_min(topic, (-total, topic)) AS topic, max(total)::BIGINT AS total FROM t GROUP BY execution_id")
def _(v):
    return topics(v).groupBy("execution_id").agg(F.min_by("topic", F.struct(-F.col("total"), "topic")).alias("topic"), F.max("total").alias("total"))


@query("fact_result_screen", f"""WITH {TOPICS_SQL}, {EXECUTIONS_SQL}, r AS ({counts_sql('comments', 'model_id, execution_id')}),
t AS (SELECT execution_id, count(DISTINCT topic)::BIGINT AS topics FROM topic_links GROUP BY ALL), w AS (SELECT execution_id, count(DISTINCT youtube_id)::BIGINT AS videos, sum(views)::BIGINT AS views FROM orders_v GROUP BY ALL)
SELECT r.execution_id, r.model_id, positive, neutral, negative, total, coalesce(topics, 0) AS topics, videos, views, (SELECT count(*) FROM executions e WHERE e.model_id = r.model_id AND e.completed_at <= x.completed_at)::BIGINT AS campaign
FROM r JOIN executions x ON x.execution_id = r.execution_id LEFT JOIN t ON t.execution_id = r.execution_id JOIN w ON w.execution_id = r.execution_id""")
def _(v):
    """What the screen of a run shows, and its place in the campaign: the model's runs up to it, itself included."""
    from pyspark.sql import Window as W

    t = v.topic_links.groupBy("execution_id").agg(F.count_distinct("topic").alias("topics"))
    w = v.orders.groupBy("execution_id", "youtube_id").agg(F.sum("views").alias("views")).groupBy("execution_id").agg(F.count("*").alias("videos"), F.sum("views").alias("views"))
    place = v.executions.select("execution_id", F.count("*").over(W.partitionBy("model_id").orderBy("completed_at").rangeBetween(W.unboundedPreceding, 0)).alias("campaign"))
    r = runs(v).select("execution_id", "model_id", "positive", "neutral", "negative", "total")
    return r.join(t, "execution_id", "left").join(w, "execution_id").join(place, "execution_id").select("execution_id", "model_id", "positive", "neutral", "negative", "total", F.coalesce("topics", F.lit(0).cast("long")).alias("topics"), "videos", "views", "campaign")
