"""Readers of corpus text, JSONL, JSON results, CSV, logs and token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, path: str, strip: bool = False) -> DataFrame:
    """text, file: records separated by a blank line. strip: drop white space around records, and empty ones."""
    rows = spark.read.option("lineSep", "\n\n").text(path).select(F.col("value").alias("text"), F.input_file_name().alias("file"))
    if not strip:
        return rows
    return rows.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).filter("text <> ''")


def corpus_strict(spark: SparkSession, path: str) -> DataFrame:
    """text, file, place: the records that a blank line ends; what stands behind the last blank line of a file is left out. A file is
    one row on the way, so it must fit a task."""
    whole = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file"))
    parts = F.split("value", "\n\n", -1)
    return whole.select("file", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("place", "text")).select("text", "file", "place")


def shards(spark: SparkSession, pattern: str) -> DataFrame:
    """file, shard: the files that a pattern finds, numbered in order of their names."""
    files = spark.read.format("binaryFile").load(pattern).select(F.col("path").alias("file")).orderBy("file").collect()
    return spark.createDataFrame([(r.file, i) for i, r in enumerate(files)], "file string, shard int")


def by_language(spark: SparkSession, paths: dict[str, str], schema: str = "code string, nl string") -> DataFrame:
    """The rows of JSONL files with the language that each path stands for; rows without code are left out."""
    out = None
    for lang, path in paths.items():
        rows = jsonl(spark, path, schema).filter(F.trim("code") != "").withColumn("lang", F.lit(lang))
        out = rows if out is None else out.unionByName(rows)
    return out


def vocabulary_sizes(spark: SparkSession, json_path: str | None = None, lines_path: str | None = None) -> tuple[int, ...]:
    """Entries of a trained tokenizer's JSON (an object at model.vocab), and lines of a vocabulary text, of those that are given."""
    out = []
    if json_path:
        vocab = F.from_json(F.get_json_object("value", "$.model.vocab"), "map<string,bigint>")
        out.append(spark.read.text(json_path, wholetext=True).select(F.size(vocab).alias("n")).first().n)
    if lines_path:
        out.append(spark.read.text(lines_path).count())
    return tuple(out)


def jsonl(spark: SparkSession, path: str, schema: str = "code string, label int, index int") -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a file; model falls back to the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("model", F.coalesce("model", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields may hold line ends, quotes and tabs."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def log_grid(grid: DataFrame, logs: DataFrame) -> DataFrame:
    """Accuracy by (variant, job, step, task): 0 where a log is missing."""
    keys = ["variant", "job", "step", "task"]
    parsed = logs.withColumn("accuracy", F.regexp_extract("line", r"hard-accuracy:\s*\d+\s*=\s*([\d.]+)%", 1).try_cast("double")).select(*keys, "accuracy")
    return grid.join(parsed, keys, "left").withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0)))


def token_file(spark: SparkSession, path: str, width: int = 1) -> DataFrame:
    """file, ids: a flat file of unsigned numbers of one byte, or two (most significant first)."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.hex("content").alias("h"), (F.length("content") / width).cast("int").alias("n"))
    ids = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.conv(F.substring(F.col("h"), i * (2 * width) + 1, F.lit(2 * width)), 16, 10).cast("int"))
    return raw.select("file", F.when(F.col("n") > 0, ids).otherwise(F.array().cast("array<int>")).alias("ids"))
