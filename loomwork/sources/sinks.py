"""Writers: corpus text, routed and sharded text, token files, CSV, JSON."""

from __future__ import annotations

import os

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def write_corpus(rows: DataFrame, path: str, text: str = "text") -> None:
    """Each record ends with a blank line."""
    rows.select(text).write.option("lineSep", "\n\n").text(path)


def write_routed(rows: DataFrame, path: str, by: str) -> None:
    """A folder for each value of by, in one pass."""
    rows.write.partitionBy(by).parquet(path)


def write_shards(rows: DataFrame, path: str, per_file: int) -> None:
    rows.write.option("maxRecordsPerFile", per_file).text(path, lineSep="\n\n")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_token_files(rows: DataFrame, path: str, width: int = 1, ids: str = "ids") -> None:
    """Token ids as unsigned numbers of width bytes (two: most significant first), one flat file for each task, named by its place.
    ValueError in the task for an id that doesn't fit. Files get their names when they are whole, so a task that runs again does no
    harm. path: a URI or path that all executors reach by pyarrow's file systems."""
    kind = {1: "u1", 2: ">u2"}[width]

    def write(batches):
        where, top = _place(path)
        task = TaskContext.get()
        name = f"{top}/part-{task.partitionId():06d}.bin"
        part, n = f"{name}.{task.taskAttemptId()}", 0
        where.create_dir(top, recursive=True)
        with where.open_output_stream(part) as f:
            for batch in batches:
                values = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                if len(values) and (values.min() < 0 or values.max() >= 1 << (8 * width)):
                    raise ValueError(f"an id doesn't fit {width} bytes")
                f.write(values.astype(kind).tobytes())
                n += len(values)
        where.move(part, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.select(ids).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def merge_files(path: str, to: str, chunk: int = 64 << 20) -> int:
    """Puts the files of write_token_files one behind the other, in order of their names; the number of bytes."""
    where, top = _place(path)
    parts = sorted(f.path for f in where.get_file_info(fs.FileSelector(top)) if f.path.endswith(".bin"))
    there, out = _place(to)
    n = 0
    with there.open_output_stream(out) as f:
        for part in parts:
            with where.open_input_stream(part) as g:
                while data := g.read(chunk):
                    f.write(data)
                    n += len(data)
    return n


def _place(path: str):
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")


def write_vocab_size(spark: SparkSession, size: int, path: str) -> None:
    """One line: the number of keywords."""
    spark.createDataFrame([(str(size),)], "value string").coalesce(1).write.text(path)


def write_results(rows: DataFrame, path: str, by: str = "model") -> None:
    """JSON rows in a folder for each model; reading the folder above gives all of them, with the model as a column."""
    rows.write.partitionBy(by).json(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Adds rows to a table of losses; those before stay."""
    rows.write.mode("append").parquet(path)


def append_outcomes(rows: DataFrame, path: str, order: str, outcome: str = "outcome") -> None:
    """Adds a batch of classified rows to a table by outcome, with idx going on where that outcome's rows before ended."""
    spark = rows.sparkSession
    try:
        before = spark.read.parquet(path).groupBy(outcome).agg(F.max("idx").alias("_last"))
    except AnalysisException:  # nothing there yet
        before = spark.createDataFrame([], f"{outcome} string, _last bigint")
    idx = F.row_number().over(W.partitionBy(outcome).orderBy(order)) + F.coalesce("_last", F.lit(-1))
    rows.join(F.broadcast(before), outcome, "left").withColumn("idx", idx.cast("long")).drop("_last").write.mode("append").parquet(path)
