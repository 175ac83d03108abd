"""Readers and writers: lexicon lines, label tables with problem rows, manifests, partition overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

LABELS = ("positivo", "neutro", "negativo")  # fixed values


def polarity_of(first: Column | str, second: Column | str) -> Column:
    """The first polarity if it isn't zero, else the second if that isn't, else the first; values outside -1 to 1 count as missing."""
    n0, n1 = (F.when(x.isin(-1, 0, 1), x) for x in (F.col(c) if isinstance(c, str) else c for c in (first, second)))
    return F.when(F.coalesce(n0, F.lit(0)) != 0, n0).when(F.coalesce(n1, F.lit(0)) != 0, n1).otherwise(n0)


def parse_lexicon(lines: DataFrame, column: str = "value") -> DataFrame:
    """form, polarity and kind ('ok', 'multiword', 'invalid') of lines 'form,lemma.PoS=...;POL:N0=...;POL:N1=...'."""
    x = F.trim(F.col(column))
    at = F.instr(x, ".PoS=")
    rows = lines.where((x != "") & ~x.startswith("#") & (at > 0))
    form = F.trim(F.substring_index(F.substr(x, F.lit(1), at - 1), ",", 1))
    fields = F.str_to_map(F.substr(x, at + 1), F.lit(";"), F.lit("="))
    value = lambda k: F.when(F.expr("try_cast(1 as int)").isNotNull(), fields[k].try_cast("int"))
    polarity = polarity_of(value("POL:N0"), value("POL:N1"))
    kind = F.when(form.contains(" "), "multiword").when(polarity.isNull(), "invalid").otherwise("ok")
    return rows.select(form.alias("form"), polarity.alias("polarity"), kind.alias("kind"))


def validate_labels(rows: DataFrame, key: str, label: str, order: str, classes: tuple[str, ...] = LABELS) -> tuple[DataFrame, DataFrame]:
    """(valid, problems): every bad row with its reason; of a repeated key the first row counts."""
    first = F.row_number().over(W.partitionBy(key).orderBy(order)) == 1
    ident = F.col(key).try_cast("long")
    reason = F.when(ident.isNull(), "bad id").when(F.trim(F.coalesce(F.col(label), F.lit(""))) == "", "empty").when(~F.col(label).isin(*classes), "unknown label")
    judged = rows.withColumn("_reason", reason.when(~first, "repeated"))
    return judged.where("_reason is null").drop("_reason"), judged.where("_reason is not null").withColumnRenamed("_reason", "reason")


def llm_labels(answers: DataFrame, column: str) -> DataFrame:
    """(id, label) items of JSON arrays, also inside a markdown fence; unparsable answers give none."""
    body = F.coalesce(F.nullif(F.regexp_extract(column, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit("")), F.col(column))
    return answers.select(F.explode(F.from_json(body, "array<struct<id:bigint,label:string>>")).alias("x")).select("x.*")


def manifest_check(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries (path, sha256) that are missing or differ; files as of the binaryFile source."""
    have = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "different")
    return manifest.join(have, "path", "left").withColumn("state", state).where("state is not null").select("path", "state")


def overwrite_runs(df: DataFrame, path: str, key: str = "execution_id") -> None:
    """Replaces the partitions of the runs in df and no others; rerunning a run is idempotent."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def api_error(status: Column, reason: Column) -> Column:
    """Class of a failed call."""
    return (
        F.when((status == 429) | (status >= 500) | reason.isin("rateLimitExceeded", "userRateLimitExceeded", "backendError"), "transient")
        .when(reason.isin("quotaExceeded", "dailyLimitExceeded"), "quota")
        .when(reason == "commentsDisabled", "empty")
        .otherwise("permanent")
    )


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, all of which df must have."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*columns)


def read_corpus(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header that must hold the columns."""
    return required(spark.read.option("header", True).option("multiLine", True).csv(path), columns)


def label_column(df: DataFrame, key: str, name: str, known: tuple[str, ...]) -> DataFrame:
    """One label column, of those that may be read."""
    if name not in known:
        raise ValueError(f"no label column: {name}")
    return df.select(key, F.col(name).alias("label"))


def rater_sheet(sheet: DataFrame) -> DataFrame:
    """id, label and note of the rows with an id: labels that differ in case or blanks are put right and noted, others refused."""
    plain = F.lower(F.trim("label"))
    known = plain.isin(*LABELS)
    note = F.when(~known, "unknown").when(F.col("label") != plain, "normalized")
    return sheet.where(F.trim(F.coalesce("id", F.lit(""))) != "").select(F.col("id").cast("long").alias("id"), F.when(known, plain).alias("label"), note.alias("note"))


def model_cards(lines: DataFrame, keys: list[str]) -> DataFrame:
    """card and problem of JSON model cards: keys missing, label ids with a gap, labels outside the set."""
    card = F.from_json("value", "map<string,string>")
    labels = F.from_json(F.get_json_object("value", "$.labels"), "map<string,string>")
    ids = F.array_sort(F.transform(F.map_keys(labels), lambda k: k.cast("int")))
    gap = ids != F.sequence(F.lit(0), F.size(labels) - 1)
    missing = F.size(F.array_except(F.array(*map(F.lit, keys)), F.map_keys(card))) > 0
    strange = F.exists(F.map_values(labels), lambda x: ~x.isin(*LABELS))
    problem = F.when(missing, "key missing").when(gap, "ids not contiguous").when(strange, "unknown label")
    return lines.select(card["card"].alias("card"), problem.alias("problem"))


def fold_assignment(report: DataFrame) -> DataFrame:
    """video, its fold and in how many folds it is listed, of rows (fold, videos); more than one is an error of the report."""
    return report.select("fold", F.explode("videos").alias("video")).groupBy("video").agg(F.min("fold").alias("fold"), F.count("*").alias("folds"))


def video_metadata(landed: DataFrame, *keys: str) -> DataFrame:
    """Counters of landed video records, which come as strings: hidden ones are 0, a hidden comment counter is null."""
    s = lambda name: F.col(f"statistics.{name}").try_cast("long")
    return landed.select(*keys, F.coalesce(s("viewCount"), F.lit(0).cast("long")).alias("views"), s("commentCount").alias("comments"), F.coalesce(s("likeCount"), F.lit(0).cast("long")).alias("likes"))
