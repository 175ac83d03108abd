"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return rows of
the documents' own columns. Extra columns, whatever their names, pass through.

Edge cases are those of the operators that the stages call. Rows of one doc_id with different texts are different documents to
near-dedup: each goes only with its own component; rows without doc_id pass through it.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import packing, quality_rules, simhash, substring, toxicity
from tidemark.llm.io import partitions, released, shared_dir, table
from tidemark.llm.registry import tokenizer_path

#: No SQL can express the learned, the fingerprint and the packing stages; tests hold run() against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the cutoffs of their stratum. Counts are made twice instead of moving texts."""
    shared_dir(spark)
    counts = quality_rules.measure(docs, ["doc_id", "lang"]).checkpoint()
    cuts = quality_rules.thresholds(counts, table(spark, sf_dir, "labels"))
    rows = docs.select("text", "lang", F.struct("*").alias("_row"))
    return quality_rules.judge(quality_rules.measure(rows, ["lang", "_row"]), cuts).where("kept and _fixed >= 0").select("_row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the toxicity threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.crc_fold("doc_id", 3) != 1)
    return toxicity.clean(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that with the smallest doc_id, among rows of one doc_id by digests of text and row.

    Which row stays depends on the rows alone, not on their order. Of rows that agree in every column one stays.
    Rows without doc_id stay and are dealt by text."""
    shared_dir(spark)
    id_, own, key, where, repeated = (free(docs, c) for c in ("_id", "_own", "_key", "_where", "_again"))
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]  # kinds that can be hashed
    text = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    named = docs.withColumn(own, F.concat(text, F.lpad(F.hex(F.xxhash64(*plain)), 16, "0")))
    kept = simhash.representatives(named, own).select(F.col("doc_id").alias(id_), F.col(own).alias(key))
    # rows that agree in every column: few, and only they are remembered
    again = named.groupBy(F.col("doc_id").alias(id_), F.col(own).alias(key)).agg((F.count("*") > 1).alias(repeated)).where(repeated)
    chosen = kept.join(again, [id_, key], "left")
    dealt = named.withColumn(where, F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))).repartition(partitions(spark), where)
    met = dealt.join(chosen, (F.col(where) == F.col(id_)) & (F.col(own) == F.col(key)), "left")
    rows = met.where(F.col(id_).isNotNull() | F.col("doc_id").isNull()).select(*docs.columns, F.when(F.col("doc_id").isNotNull() & F.col(repeated), F.col(own)).alias(repeated))

    def once(batches):
        seen: set[str] = set()  # of this partition, which holds all rows of a doc_id
        for b in batches:
            keep = []
            for mark in b.column(b.num_columns - 1).to_pylist():
                keep.append(mark is None or mark not in seen)
                seen.add(mark)
            out = b.select(list(range(b.num_columns - 1)))
            yield out if all(keep) else out.filter(pa.array(keep))

    return rows.mapInArrow(released(once), docs.schema)


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that start earlier in the corpus."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("_rest")) if others else docs.select("doc_id", "text")
    done = substring.remove(packed)
    return done.select(*[F.col(c) if c in ("doc_id", "text") else F.col("_rest")[c].alias(c) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    shared_dir(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    shared_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
