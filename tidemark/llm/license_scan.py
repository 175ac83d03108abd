"""License scan by ordered signature rules, in DataFrame functions only.

A prefilter by the rules' contexts, over any run of what stands between words, decides whether a document is scanned
at all; each rule is further gated by contexts and keywords of its own, substrings of the normalised text
(lower-case words joined by one space), of which every match holds one. Rules that pass run their
regular expression over that text, so gates save work and change no label. Every match is an interval with the tier of its rule;
an interval inside one of a better or equal tier that starts no later is suppressed, so
'gnu lesser general public license' doesn't also count as a plain GPL mention.

Edge cases: null text counts as empty; no word gives n_words 0, null word positions and empty labels;
repeated rows are scanned alike; the work is one narrow projection, so no group can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .license_rules import BARE, BASE, RULES, TIER_SCORE
from .quality_rules import let

#: what stands between words, before lower-casing
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: "licen" also stands for the base phrases; bare names count as whole words only
CONTEXTS = {"licen"} | {c for r in RULES for c in r[0] if "licen" not in c}
PREFILTER = "(?i)" + "|".join(rf"(?<![a-z0-9]){c}(?![a-z0-9])" if c in BARE else c for c in sorted(CONTEXTS)).replace(" ", BETWEEN)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _base_places(words: Column) -> Column:
    """Starts and labels of the base phrases, in word order."""

    def at(i: Column) -> Column:
        hit = F.lit(None).cast("string")
        for phrase, label in BASE:
            parts = phrase.split()
            cond = F.lit(True)
            for k, part in enumerate(parts):
                cond = cond & (F.get(words, i + k) == part)
            hit = F.when(cond, F.lit(label)).otherwise(hit)
        return F.struct(i.cast("long").alias("at"), hit.alias("label"))

    every = F.transform(F.sequence(F.lit(0), F.size(words) - 1), at)
    return F.filter(every, lambda e: e["label"].isNotNull())


BLOCK = 128  # numbers summed in one go


def running(numbers: Column) -> Column:
    """The sums of the numbers up to each of them. Blocks are summed and then moved by the sum of those before, since an array that
    grows element by element is copied each time."""
    none = F.array().cast("array<bigint>")

    def sums(xs: Column) -> Column:
        step = lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"] + x)).alias("all"))
        return F.aggregate(xs, F.struct(F.lit(0).cast("bigint").alias("sum"), none.alias("all")), step)

    def blocks(xs: Column) -> Column:
        block = lambda k: F.transform(F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, F.size(xs)) - 1), lambda i: F.get(xs, i))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda k: sums(block(k)))

    def moved(blocks: Column) -> Column:
        before = sums(F.transform(blocks, lambda b: b["sum"]))["all"]
        return let(before, lambda at: F.flatten(F.transform(blocks, lambda b, i: F.when(i == 0, b["all"]).otherwise(F.transform(b["all"], lambda x: x + F.get(at, i - 1))))))

    return F.when(F.size(numbers) == 0, none).otherwise(let(numbers, lambda xs: let(blocks(xs), moved)))


def _intervals(norm: Column, rule: Column, order: Column) -> Column:
    """Matches of one rule as (start, -end, tier, order, label)."""
    found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    parts = F.split(norm, rule["pattern"])

    def place(m: Column, p: Column) -> Column:
        lengths = F.transform(m, lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("bigint"))
        item = lambda end, i: F.struct(
            (end - F.length(F.get(m, i))).cast("int").alias("start"), (-end).cast("int").alias("neg_end"), rule["tier"].alias("tier"), order.alias("rule"), rule["label"].alias("label")
        )
        return let(running(lengths), lambda ends: F.transform(ends, item))

    none = F.array().cast("array<struct<start:int,neg_end:int,tier:int,rule:int,label:string>>")
    return let(F.struct(found.alias("m"), parts.alias("p")), lambda x: F.when(F.size(x["m"]) > 0, place(x["m"], x["p"])).otherwise(none))


def _surviving(found: Column) -> Column:
    """(labels, best tier) of the intervals that no earlier interval of a better or equal tier contains."""
    tiers = sorted(TIER_SCORE)

    def step(s: Column, e: Column) -> Column:
        inside = F.lit(False)
        for t in tiers:
            inside = inside | ((e["tier"] >= t) & (s[f"m{t}"] >= -e["neg_end"]))
        out = [F.when((e["tier"] == t) & (-e["neg_end"] > s[f"m{t}"]), -e["neg_end"]).otherwise(s[f"m{t}"]).alias(f"m{t}") for t in tiers]
        labels = F.when(inside, s["labels"]).otherwise(F.array_union(s["labels"], F.array(e["label"])))
        return F.struct(*out, labels.alias("labels"), F.when(inside, s["best"]).otherwise(F.least(s["best"], e["tier"])).alias("best"))

    start = F.struct(*[F.lit(-1).alias(f"m{t}") for t in tiers], F.array().cast("array<string>").alias("labels"), F.lit(99).alias("best"))
    return F.aggregate(F.sort_array(found), start, step, lambda s: F.struct(s["labels"].alias("labels"), s["best"].alias("best")))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: word count, base places and labels, all labels, score."""
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.select("doc_id", text.rlike(PREFILTER).alias("_hot"), F.split(text, BETWEEN).alias("_parts"))
    edge = lambda i: (F.element_at("_parts", i) == "").cast("int")
    n = F.when(F.size("_parts") == 1, 1 - edge(1)).otherwise(F.size("_parts") - edge(1) - edge(-1))
    words = F.filter("_parts", lambda x: x != "")
    lowered = F.split(F.translate(F.array_join(words, " "), UPPER, LOWER), " ")
    b = a.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.when(F.col("_hot") & (n > 0), lowered).alias("_words"),
    )
    keywords = F.array(*[F.lit(k) for k in sorted({k for r in RULES for k in (*r[0], *r[1])})])
    texts = lambda x: F.array(*[F.lit(k) for k in x])
    table = F.array(*[F.struct(texts(c).alias("contexts"), texts(k).alias("keywords"), F.lit(t).alias("tier"), F.lit(label).alias("label"), F.lit(p).alias("pattern"), F.lit(i).alias("rule")) for i, (c, k, t, label, p) in enumerate(RULES)])
    normed = b.select("*", F.when(F.col("_words").isNotNull(), _base_places(F.col("_words"))).alias("_base"), F.array_join("_words", " ").alias("_norm"))
    c = normed.select("*", F.when(F.col("_norm").isNotNull(), F.filter(keywords, lambda k: F.contains(F.col("_norm"), k))).alias("_keys"))
    gated = F.filter(table, lambda r: F.arrays_overlap(F.col("_keys"), r["contexts"]) & F.arrays_overlap(F.col("_keys"), r["keywords"]))
    found = F.flatten(F.transform(gated, lambda r: _intervals(F.col("_norm"), r, r["rule"])))
    d = c.select("doc_id", "n_words", "_base", F.when(F.size("_keys") > 0, _surviving(found)).alias("_found"))
    base = F.coalesce(F.array_distinct(F.transform("_base", lambda e: e["label"])), F.array().cast("array<string>"))
    extra = F.coalesce(F.col("_found.labels"), F.array().cast("array<string>"))
    tier_score = F.lit(0.0)
    for t, s in TIER_SCORE.items():
        tier_score = F.when(F.col("_found.best") == t, F.lit(s)).otherwise(tier_score)
    has_base = F.coalesce(F.size("_base"), F.lit(0)) > 0
    return d.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda e: e["at"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda e: e["at"])).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, extra)), ",").alias("labels"),
        F.greatest(F.when(has_base, F.lit(TIER_SCORE[2])).otherwise(0.0), F.coalesce(tier_score, F.lit(0.0))).alias("score"),
    )
