"""Corpus operators: dedup, ordinals, splits, shards, filters, histograms."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomwork.functions import text as T


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder that the driver and all executors share (spark.checkpoint.dir) and read back: what led to it isn't
    run again. Only where all of Spark runs on this machine and nothing is set, that is a local folder."""
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place.rstrip('/')}/loomwork-settled-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_ordinal(df: DataFrame, key: str, name: str = "rn", then: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """Adds the 1-based rank by key, ties by the columns in then, and returns the number of rows too. Nulls come first.

    Ranges of the order go to tasks as Spark's range partitioner deals them, are ranked each in a task of its own and shifted by the sizes
    of those before: one number for each range is all that meets."""
    order = [key, *then]
    dealt = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1))).collect())
    shift, starts = 0, []
    for p, n in sizes:
        starts.append((p, shift))
        shift += n
    start = df.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    ranked = dealt.withColumn(name, F.row_number().over(W.partitionBy("_part").orderBy(*order))).join(F.broadcast(start), "_part")
    return ranked.withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start"), shift


def with_running(df: DataFrame, value: str, name: str, key: str, then: tuple[str, ...] = ()) -> DataFrame:
    """Adds rn and the sum of value (a whole number) up to each row in the order of key and then, by ranges as with_ordinal does."""
    order = [key, *then]
    dealt = settled(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    starts, n, total = [], 0, 0
    for p, rows, own in sorted((r[0], r[1], r[2]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)), F.coalesce(F.sum(value), F.lit(0))).collect()):
        starts.append((p, n, total))
        n, total = n + rows, total + own
    start = df.sparkSession.createDataFrame(starts, "_part int, _n bigint, _sum bigint")
    w = W.partitionBy("_part").orderBy(*order)
    run = dealt.withColumn("rn", F.row_number().over(w)).withColumn(name, F.coalesce(F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    run = run.join(F.broadcast(start), "_part")
    return run.withColumn("rn", F.col("rn") + F.col("_n")).withColumn(name, F.col(name) + F.col("_sum")).drop("_part", "_n", "_sum")


def dedup_keep_first(df: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Of rows with equal texts the first by order. Only hashes and keys are aggregated (combined before they move), then met with rows."""
    hashed = df.withColumn("h", F.sha2(F.col(text), 256))
    first = hashed.groupBy("h").agg(F.min(order).alias(order))
    return hashed.join(first, ["h", order], "left_semi").drop("h")


def split_test_first(rn: Column, test: int, val: int, train: int) -> Column:
    return F.when(rn <= test, "test").when(rn <= test + val, "val").when(rn <= test + val + train, "train")


def split_train_first(rn: Column, n: int, val: int, test: int) -> Column:
    return F.when(rn > n - test, "test").when(rn > n - test - val, "val").otherwise("train")


def split_fraction(rn: Column, n: int, train: float = 0.8, val: float = 0.1) -> Column:
    a, b = int(train * n), int(val * n)
    return F.when(rn <= a, "train").when(rn <= a + b, "val").otherwise("test")


def route_by_span(df: DataFrame, block: int = 512, text: str = "text") -> DataFrame:
    """status valid or rejected, reason, span: rejected if two steps together exceed the block; the first such span is told."""
    over = lambda bounds: F.try_element_at(F.filter(T.two_back_spans(bounds), lambda x: x > block), F.lit(1))
    cut = df.select("*", T.once(T.boundaries_of(F.col(text)), over).alias("span"))
    return cut.withColumn("status", F.when(F.col("span").isNull(), "valid").otherwise("rejected")).withColumn("reason", F.when(F.col("span").isNotNull(), F.concat(F.lit("Pair length too long: "), F.col("span").cast("string"))))


def histogram(df: DataFrame, value: Column, size: int) -> DataFrame:
    """bucket, n for each bucket from 0 to size - 1; larger values count in the last."""
    counts = df.groupBy(F.least(value, F.lit(size - 1)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def merge_histograms(df: DataFrame, array: str, *keys: str) -> DataFrame:
    """Sums arrays place by place."""
    per = df.select(*keys, F.posexplode(array).alias("pos", "v")).groupBy(*keys, "pos").agg(F.sum("v").alias("v"))
    return per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(array))


def structure_ok(line_count: Column, if_count: Column, most_lines: int = 10, most_ifs: int = 2) -> Column:
    return (line_count <= most_lines) & F.forall(if_count, lambda x: x <= most_ifs)
