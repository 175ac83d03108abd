"""Risk-controlled quality rules, in DataFrame functions only.

Each document gets exact counts, a fixed base rule and a learned verdict. The learned part is a
set of one-sided rules (feature above or below a cutoff). Cutoffs come from a fixed grid; on the
labelled rows of a stratum (language) a cutoff is admissible when an exact binomial test shows,
at level DELTA / (number of hypotheses), that it rejects fewer than RISK / (number of rules) of the good
documents. Among admissible cutoffs the one that separates best is taken. A stratum is judged by
its own labels alone: one with too few of them, or without an admissible cutoff, gets no learned rule.

Edge cases: null text counts as empty (n_words 0, so the base rule fails it); a null language is a
stratum of its own; repeated rows are judged alike, each once; of a doc_id with several texts the least row of counts
is learned from; an empty table gives an empty result; without labels only the base rule decides; further columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
FEW = 16  # repeated windows up to which a text is searched for them, instead of sorted
RISK = 0.06  # share of good documents that the learned rules together may reject in a stratum
DELTA = 0.05  # probability that the limit is missed anywhere
BROADCAST = 10_000  # rows up to which the table of thresholds is broadcast; beyond, it is joined by a shuffle
GOOD_WEIGHT = 2.0  # a good document rejected weighs as much as so many bad ones

#: rule -> (+1: rejects above the cutoff, -1: below; cutoffs from loose to strict)
RULES: dict[str, tuple[int, list[float]]] = {
    "symbols_per_word": (1, [2.0, 1.5, 1.2, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1]),
    "upper_share": (1, [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "dup_line_share": (1, [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15]),
    "repeat_share": (1, [0.19, 0.18, 0.17, 0.16, 0.15, 0.14, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02]),
    "word_length": (1, [40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0]),
    "word_shortness": (-1, [1.2, 1.4, 1.6, 1.8, 2.0, 2.2, 2.4, 2.6, 2.8, 3.0, 3.2, 3.4]),
}


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column) -> Column:
    """Words of a text; one pass of split(), which costs less than extracting matches."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _union_length(p: Column) -> Column:
    """Words under the 5-word windows that start at p, ascending."""
    gaps = F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1), x + 5) - x))
    return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)


def _covered(windows: Column) -> Column:
    """Words under 5-word windows that occur twice or more; windows: array of window hashes."""
    repeated = lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (F.get(s, i - 1) == x)))

    def few(d: Column) -> Column:
        at = F.transform(windows, lambda h, i: F.when(F.array_contains(d, h), i))
        return let(F.filter(at, lambda i: i.isNotNull()), _union_length)

    def many(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(
            s,
            lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == e["h"])),
        )
        return let(F.sort_array(F.transform(same, lambda e: e["i"])), _union_length)

    indexed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(F.sort_array(windows), repeated), lambda d: F.when(F.size(d) <= FEW, few(d)).otherwise(let(indexed, many)))


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns and the exact counts of each whole text; a narrow projection, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    lost = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    a = docs.select(
        *keep,
        split_words(text).alias("_w"),
        lines.alias("_lines"),
        lost(r"[#*$%&|<>]+").cast("long").alias("n_symbols"),
        lost(r"\p{Lu}+").cast("long").alias("n_upper"),
    )
    w = F.col("_w")
    b = a.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_upper",
        F.transform(w, lambda x: F.xxhash64(x)).alias("_g"),
    )
    g = F.col("_g")
    windows = F.transform(g, lambda x, i: F.xxhash64(x, *[F.get(g, i + k) for k in range(1, 5)]))
    c = b.withColumn("_h", F.when(F.size(g) >= 5, F.slice(windows, 1, F.greatest(F.size(g) - 4, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    h = F.col("_h")
    repeats = F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)).otherwise(0).cast("long")
    # the optimizer would copy the counts' expressions into a filter above, and into its lambdas; it does not move
    # filters below a projection with a nondeterministic column, as long as the filter or a parent uses that column
    return c.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"), "n_lines", "n_upper", F.spark_partition_id().alias("_fixed"))


def _features() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "word_length": share("word_chars", "n_words"),
        "word_shortness": share("word_chars", "n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail_log(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term in log space."""
    first = n.cast("double") * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p / (1 - p)))

    def step(s: Column, j: Column) -> Column:
        term = s["t"] + F.log((n - j + 1).cast("double") / j) + odds
        total = F.greatest(s["a"], term) + F.log1p(F.exp(-F.abs(s["a"] - term)))
        return F.struct(term.alias("t"), total.alias("a"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("t"), first.alias("a")), step, lambda s: s["a"])


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """One row for each stratum with an admissible cutoff: a map from rule to cutoff. Counts per stratum, rule and grid place
    are made in one aggregation and checkpointed; all else runs over that small table."""
    truth = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_good"))
    used = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
    fair = measured.where(~base_failed()).select("doc_id", F.struct(*used, F.col(stratum).alias("_stratum")).alias("_r"))
    held = fair.join(truth, F.col("doc_id") == F.col("_id")).groupBy("doc_id").agg(F.min("_r").alias("_r"), F.first("_good").alias("_good")).select("_r.*", "_good")
    f = _features()
    passed = lambda rule: F.size(F.filter(F.array(*map(F.lit, RULES[rule][1])), lambda c: (f[rule] > c) if RULES[rule][0] > 0 else (f[rule] < c)))
    counts = (
        held.select("_stratum", (F.col("_good") == 1).alias("_g"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), passed(r).alias("passed")) for r in RULES])).alias("x"))
        .groupBy("_stratum", "x.rule", "x.passed")
        .agg(F.count_if("_g").alias("good"), F.count_if(~F.col("_g")).alias("bad"))
    ).checkpoint()
    cell = W.partitionBy("_stratum", "rule")
    grid = F.create_map(*[x for r, (_, c) in RULES.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    hypotheses = sum(len(c) for _, c in RULES.values())
    limit = risk / len(RULES)
    reached = (
        counts.withColumn("n", F.sum("good").over(cell))
        .withColumn("false_rejects", F.sum("good").over(cell.orderBy(F.desc("passed"))))
        .withColumn("hits", F.sum("bad").over(cell.orderBy(F.desc("passed"))))
        .where("passed > 0")
    )
    # strata with so few good documents that no cutoff could pass test nothing; the number of documents alone tells
    sizes = counts.where(F.col("rule") == F.lit(next(iter(RULES)))).groupBy("_stratum").agg(F.sum("good").alias("n"))
    strata = sizes.where(F.col("n") * F.log1p(F.lit(-limit)) <= F.log(F.lit(delta / hypotheses))).agg(F.greatest(F.count("*"), F.lit(1)).alias("_strata"))
    fits = F.when(
        F.col("false_rejects") < F.col("n") * limit,
        binomial_tail_log(F.col("n"), F.col("false_rejects"), limit) <= F.log(F.lit(delta / hypotheses) / F.col("_strata")),
    ).otherwise(False)
    # rows that the strictest so many cutoffs reject: places of the grid count from its end; of equal gains the loosest is taken
    gain = F.col("hits") - GOOD_WEIGHT * F.col("false_rejects")
    return (
        reached.crossJoin(F.broadcast(strata))
        .where(fits & (gain > 0))
        .groupBy("_stratum", "rule")
        .agg(F.max_by(F.element_at(grid[F.col("rule")], -F.col("passed")), F.struct(gain, "passed")).alias("cutoff"))
        .groupBy("_stratum")
        .agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cut"))
    )


def judge(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """measured with base_failed and kept."""
    cuts = cuts.checkpoint()
    f = _features()
    hit = F.lit(False)
    for rule, (side, _) in RULES.items():
        cut = F.col("_cut")[rule]
        hit = hit | F.coalesce((f[rule] > cut) if side > 0 else (f[rule] < cut), F.lit(False))
    return (
        measured.join(F.broadcast(cuts) if cuts.count() <= BROADCAST else cuts, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~hit)
        .drop("_stratum", "_cut")
    )


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, counts, base_failed and kept of each row. The counts are checkpointed: texts are read once."""
    measured = measure(docs, ["doc_id", "lang"]).checkpoint()
    return judge(measured, thresholds(measured, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper"
    )
