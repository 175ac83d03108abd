"""Queries: twins of texts, and what a study's test shares with the rows it was trained on.

The test is every document whose id is divisible by 20; the pool is all others, of which four fifths are the training rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import aggregates as A, neardup, selection as ML
from .kernels import PAIRS_SQL, pairs
from .registrar import query
from .studies import WITHIN
from .writes import markdown, through_text

#: Normalised texts and their sets of trigrams; runs of one character are cut by looking at the character before.
SETS_SQL = r"""
letters AS (SELECT doc_id, string_split(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]+', ' ', 'g'), '') AS c FROM documents WHERE text IS NOT NULL),
normed AS (SELECT doc_id, trim(array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '')) AS norm FROM letters),
padded AS (SELECT doc_id, norm, string_split(' ' || norm || ' ', '') AS p FROM normed),
sets AS (
  SELECT doc_id AS id, norm, CASE WHEN norm = '' THEN [] ELSE list_distinct(list_transform(range(1, len(p) - 1), lambda i: p[i] || p[i + 1] || p[i + 2])) END AS g FROM padded
)"""


def twins_sql(name: str, queries: str, reference: str) -> str:
    """The best twin of each query, as a table expression: an equal text before a similar one, then the smallest id."""
    return f"""
{name}_pairs AS (
  SELECT q.id, r.id AS twin, q.norm = r.norm AS same, len(list_intersect(q.g, r.g)) AS c, len(q.g) AS n, len(r.g) AS m
  FROM (SELECT * FROM sets WHERE norm <> '' AND {queries}) AS q JOIN (SELECT * FROM sets WHERE norm <> '' AND {reference}) AS r
    ON q.id <> r.id AND len(r.g) >= 0.8 * len(q.g) - 1e-9 AND len(q.g) >= 0.8 * len(r.g) - 1e-9
),
{name} AS (
  SELECT id, twin, CASE WHEN same THEN 1.0 ELSE c::DOUBLE / (n + m - c) END AS similarity, CASE WHEN same THEN 'exact' ELSE 'quasi' END AS level
  FROM {name}_pairs WHERE same OR c::DOUBLE / (n + m - c) >= 0.8
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY same DESC, c::DOUBLE / (n + m - c) DESC, twin) = 1
)"""


TEST, POOL, TRAIN = "id % 20 = 0", "id % 20 <> 0", "id % 20 <> 0 AND id % 5 <> 1"


def corpus(v) -> DataFrame:
    return v.documents.select(F.col("doc_id").alias("id"), "text")


@query("str_twin_normalize", f"WITH {SETS_SQL} SELECT doc_id, norm FROM normed UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL")
def _(v):
    return v.documents.select("doc_id", T.twin_normalize(F.col("text")).alias("norm"))


@query("str_char_ngrams", f"WITH {SETS_SQL} SELECT id AS doc_id, len(g)::INTEGER AS grams FROM sets UNION ALL SELECT doc_id, 0 FROM documents WHERE text IS NULL")
def _(v):
    return v.documents.select("doc_id", F.size(T.char_ngrams(T.twin_normalize(F.col("text")))).alias("grams"))


@query("join_near_duplicate", f"WITH {SETS_SQL}, {twins_sql('t', TEST, 'true')} SELECT id, twin, similarity::DOUBLE AS similarity, level FROM t")
def _(v):
    s = neardup.sets(corpus(v))
    return neardup.twins_of(s.where(TEST), s)


@query("agg_twin_summary", f"""WITH {SETS_SQL}, {twins_sql('t', TEST, 'true')}
SELECT level, count(*)::BIGINT AS n, avg(similarity)::DOUBLE AS mean, count(*) FILTER (a.source IS NOT DISTINCT FROM b.source)::BIGINT AS same_video,
  count(*) FILTER (len(regexp_extract_all(a.text, '\\S+')) <= 3)::BIGINT AS short
FROM t JOIN documents AS a ON a.doc_id = t.id JOIN documents AS b ON b.doc_id = t.twin GROUP BY level""")
def _(v):
    """Twins by level: how many, how similar, of the same video, of at most three words."""
    s = neardup.sets(corpus(v))
    about = v.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("video"), (F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))) <= 3).alias("short"))
    t = neardup.twins_of(s.where(TEST), s).join(about, "id").join(about.select(F.col("id").alias("twin"), F.col("video").alias("other")), "twin")
    return t.groupBy("level").agg(
        F.count("*").alias("n"), F.avg("similarity").alias("mean"), F.count_if(F.col("video").eqNullSafe(F.col("other"))).alias("same_video"), F.count_if("short").alias("short")
    )


@query("set_leak_filter", f"WITH {SETS_SQL}, {twins_sql('t', POOL, TEST)} SELECT doc_id AS id FROM documents WHERE doc_id % 20 <> 0 AND doc_id NOT IN (SELECT id FROM t)")
def _(v):
    d = corpus(v)
    s = neardup.sets(d)
    return d.where(POOL).select("id").join(neardup.twins_of(s.where(POOL), s.where(TEST)).select("id"), "id", "left_anti")


LEAKS = f"WITH {SETS_SQL}, {twins_sql('pool', TEST, POOL)}, {twins_sql('train', TEST, TRAIN)}"
GROUPS_SQL = f"""{LEAKS}, tested AS (SELECT doc_id FROM documents WHERE doc_id % 20 = 0),
groups AS (
  SELECT 'all' AS kind, doc_id FROM tested UNION ALL SELECT 'with', id FROM pool UNION ALL SELECT 'without', doc_id FROM tested WHERE doc_id NOT IN (SELECT id FROM pool)
  UNION ALL SELECT 'exact', id FROM pool WHERE level = 'exact' UNION ALL SELECT 'in train', id FROM train
)"""


def test_groups(v) -> DataFrame:
    """kind and doc_id: all test rows, those with a twin in the pool, without one, with an equal text, with a twin among the training rows."""
    d = corpus(v)
    s = neardup.sets(d)
    test = s.where(TEST)
    pool = neardup.twins_of(test, s.where(POOL)).select("id", "level")
    train = neardup.twins_of(test, s.where(TRAIN)).select("id", F.lit(True).alias("trained"))
    tagged = d.where(TEST).select("id").join(pool, "id", "left").join(train, "id", "left")
    kinds = F.array(
        F.lit("all"), F.when(F.col("level").isNull(), "without").otherwise("with"), F.when(F.col("level") == "exact", "exact"), F.when(F.col("trained"), "in train")
    )
    return tagged.select(F.explode(F.array_compact(kinds)).alias("kind"), F.col("id").alias("doc_id"))


@query("set_test_without_twin", f"{GROUPS_SQL} SELECT doc_id FROM groups WHERE kind = 'without'")
def _(v):
    d = corpus(v)
    s = neardup.sets(d)
    return d.where(TEST).select("id").join(neardup.twins_of(s.where(TEST), s.where(POOL)).select("id"), "id", "left_anti").withColumnRenamed("id", "doc_id")


@query("set_groups", f"{GROUPS_SQL} SELECT kind, doc_id FROM groups")
def _(v):
    return test_groups(v)


@query("sink_leak_table", f"{GROUPS_SQL} SELECT '| ' || kind || ' | ' || count(*) || ' |' AS line FROM groups GROUP BY kind")
def _(v):
    n = test_groups(v).groupBy("kind").agg(F.count("*").alias("n"))
    return through_text(n.select(markdown(["kind", "n"]).alias("value"))).select(F.col("value").alias("line"))


@query("agg_label_repetition", f"""{LEAKS}, {PAIRS_SQL}
SELECT count(*)::BIGINT AS twins, count(*) FILTER (a.gold = b.gold)::BIGINT AS gold_repeats, count(*) FILTER (a.predicted = b.gold)::BIGINT AS method_repeats
FROM train JOIN pairs AS a ON a.doc_id = train.id JOIN pairs AS b ON b.doc_id = train.twin""")
def _(v):
    """How often a test row's own label, and the method's, is the label of its twin among the training rows."""
    s, p = neardup.sets(corpus(v)), pairs(v)
    own, other = p.select(F.col("doc_id").alias("id"), "gold", "predicted"), p.select(F.col("doc_id").alias("twin"), F.col("gold").alias("label"))
    t = neardup.twins_of(s.where(TEST), s.where(TRAIN)).join(own, "id").join(other, "twin")
    return t.agg(F.count("*").alias("twins"), F.count_if(F.col("gold") == F.col("label")).alias("gold_repeats"), F.count_if(F.col("predicted") == F.col("label")).alias("method_repeats"))


LABELLED_TEST, LABELLED_REST = "id IN (SELECT doc_id FROM pairs WHERE fold = 0)", "id IN (SELECT doc_id FROM pairs WHERE fold <> 0)"


def labelled_sides(v) -> tuple[DataFrame, DataFrame]:
    """Texts of the labelled test rows and of the other labelled rows."""
    d = corpus(v).join(pairs(v).select(F.col("doc_id").alias("id"), "fold"), "id")
    return d.where("fold = 0").drop("fold"), d.where("fold <> 0").drop("fold")


@query("ml_round_partition", f"""WITH {SETS_SQL}, {PAIRS_SQL}, {twins_sql('leak', LABELLED_REST, LABELLED_TEST)}, {WITHIN.split(", ", 1)[1].split("predicted FROM labels), ", 1)[1].replace("FROM pairs)", "FROM pairs WHERE fold <> 0 AND doc_id NOT IN (SELECT id FROM leak))")}
SELECT doc_id, CASE WHEN place <= round_even(size * 0.15::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS side FROM placed UNION ALL SELECT doc_id, 'test' FROM pairs WHERE fold = 0""")
def _(v):
    """Rows with a twin in the test are left out of the round."""
    test, rest = labelled_sides(v)
    leak = neardup.twins(rest, test).select(F.col("id").alias("doc_id"))
    return ML.round_partition(pairs(v), "gold", "doc_id", F.col("fold") == 0, leak).select("doc_id", "side")


@query("agg_best_similarity_histogram", f"""WITH {SETS_SQL}, {PAIRS_SQL},
scored AS (
  SELECT q.id, max(CASE WHEN r.id IS NULL OR len(q.g) + len(r.g) = 0 THEN 0 ELSE len(list_intersect(q.g, r.g))::DOUBLE / (len(q.g) + len(r.g) - len(list_intersect(q.g, r.g))) END) AS s
  FROM (SELECT doc_id AS id, coalesce(g, []) AS g FROM documents LEFT JOIN sets ON sets.id = doc_id WHERE doc_id IN (SELECT doc_id FROM pairs WHERE fold = 0)) AS q
    LEFT JOIN (SELECT * FROM sets WHERE {LABELLED_REST}) AS r ON q.id <> r.id GROUP BY q.id
)
SELECT b::INT AS bucket, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(20)) AS b)
LEFT JOIN (SELECT least(floor(s / 0.05::DOUBLE), 19)::INT AS k, count(*) AS n FROM scored GROUP BY ALL) ON b = k""")
def _(v):
    """The labelled test rows by their best similarity with the other labelled rows."""
    test, rest = labelled_sides(v)
    return A.histogram(neardup.best_similarity(test, rest).select(F.col("similarity").alias("s")), "s", 0.05, 20)
