"""How filters interact: what each removes in every order of application, by one product of count and incidence matrices.

A document fails a set of the filters, one of 2^k masks. Whether it is kept, removed, redundant or failed alone at a step of an
order depends on its mask only, so each outcome is an integer matrix with a row a mask and a column a step of an order (32 by 600
for five filters). Counts of masks of each part (all documents, good ones, toxic ones) are stacked as rows and multiplied by them.

Masks are counted on Spark. What depends on the text alone goes with its digest, so the filter "identical to the text of a smaller
doc_id" needs no join of documents: rows of equal text are combined per part before they move, and the smallest doc_id of the whole
table is compared with that of the part. Texts never move.

Edge cases: null text counts as empty, null part as the empty part; repeated rows count each and aren't copies of themselves; a row
without doc_id is in all counts, has no label and is no copy, nor the first of copies; labels of a repeated doc_id count if any of
its rows says so; further columns of any name are left aside; an empty table has no part, hence no row.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
COPY = "E"
STACK = 512  # parts of one product
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def incidence(filters: str = FILTERS) -> dict[str, np.ndarray]:
    """The outcome matrices, masks by (order, step); bit i of a mask is filter i."""
    order = np.array([[filters.index(f) for f in o] for o in orders(filters)])
    own = 1 << order
    earlier = np.cumsum(own, axis=1) - own
    masks = np.arange(1 << len(filters))[:, None, None]
    fails, gone = masks & own != 0, masks & earlier != 0
    each = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == own}
    return {name: m.reshape(len(masks), -1).astype(np.int64) for name, m in each.items()}


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """Filters that look at one text: short, repetitive, loud, with signs."""
    distinct, capitals = F.size(F.array_distinct(words)), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.lit(100) * distinct < F.lit(65) * F.size(words),
        "C": F.lit(100) * capitals > F.lit(5) * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of each set of failures, labelled ones among them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    split = read.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    bits = [F.when(c, 1 << FILTERS.index(f)).otherwise(0) for f, c in text_failures(F.col("text"), F.col("words")).items()]
    digest = F.unhex(F.sha2("text", 256))
    # rows without doc_id are dealt by text and meet no label
    rows = split.select(
        F.coalesce("doc_id", F.xxhash64("text")).alias("id"), F.col("doc_id").isNull().alias("nameless"), "part", digest.alias("digest"),
        sum(bits[1:], bits[0]).cast("int").alias("mask"),
    )
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("long").alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long").alias("toxic")
    )
    once = rows.groupBy("id", "nameless", "part", "digest", "mask").agg(F.count("*").alias("n"))
    judged = once.join(said.withColumn("nameless", F.lit(False)), ["id", "nameless"], "left")
    n = {"n": F.col("n"), "good": F.coalesce(F.col("good"), F.lit(0)) * F.col("n"), "toxic": F.coalesce(F.col("toxic"), F.lit(0)) * F.col("n")}
    first = F.min(F.when(~F.col("nameless"), F.struct("id", *[c.alias(k) for k, c in n.items()]))).alias("first")
    equal = judged.groupBy("digest", "part", "mask").agg(*[F.sum(c).alias(k) for k, c in n.items()], F.sum(F.col("nameless").cast("long") * F.col("n")).alias("unnamed"), first)
    table = equal.withColumn("root", F.min("first.id").over(Window.partitionBy("digest")))
    leads = F.col("first.id") == F.col("root")
    alone = {k: F.when(leads, F.col("first")[k]).otherwise(0) + (F.col("unnamed") if k == "n" else 0) for k in n}
    copy = 1 << FILTERS.index(COPY)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), *[c.cast("long").alias(k) for k, c in alone.items()]),
        F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(k) - c).cast("long").alias(k) for k, c in alone.items()]),
    )
    return table.select("part", F.explode(both).alias("x")).groupBy("part", "x.mask").agg(*[F.sum(f"x.{k}").alias(k) for k in n])


def interactions(counts: DataFrame) -> DataFrame:
    """Outcomes of every part, order and step from mask_counts()."""
    listed = counts.groupBy("part").agg(*[F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")])  # 32 masks a part at most

    def product(batches):
        by, names = incidence(), orders()
        k = len(FILTERS)
        letters = np.array([FILTERS.index(f) for o in names for f in o])
        turn = np.zeros((len(letters), k), np.int64)  # sums the steps of a filter over all orders
        turn[np.arange(len(letters)), letters] = 1
        for batch in batches:
            for at in range(0, batch.num_rows, STACK):
                some = batch.slice(at, STACK)
                parts = some.column(0).to_pylist()
                stacked = np.zeros((3, len(parts), 1 << k), np.int64)
                masks = some.column(1)
                row = np.repeat(np.arange(len(parts)), masks.value_lengths().to_numpy())
                for i in range(3):
                    np.add.at(stacked[i], (row, masks.flatten().to_numpy()), some.column(2 + i).flatten().to_numpy())
                flat = stacked.reshape(-1, 1 << k)
                removed = (flat @ by["removed"]).reshape(3, len(parts), -1)
                out = [stacked[0] @ by["kept"], removed[0], stacked[0] @ by["redundant"], stacked[0] @ by["unique_fails"], removed[1], removed[2], (removed[0] @ turn)[:, letters]]
                step = np.tile(np.arange(1, k + 1, dtype=np.int32), len(parts) * len(names))
                order = np.tile(np.repeat(np.array(names, object), k), len(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(parts, object), len(letters)), pa.string()), pa.array(order, pa.string()), pa.array(step), *[pa.array(x.ravel()) for x in out]],
                    ["part", "filter_order", "step", *COUNTS],
                )

    return listed.select("part", "mask", "n", "good", "toxic").mapInArrow(product, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order of filters and step."""
    return interactions(mask_counts(docs, labels, part))
