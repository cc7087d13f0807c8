"""The stateless corpus steps over a stream of text files: an extension; the batch operators are the parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwork.functions import text as T
from loomwork.operators.corpus import route_by_span


def stream_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.option("lineSep", "\n\n").text(path).select(F.col("value").alias("text"))


def filtered(rows: DataFrame, block: int = 512) -> DataFrame:
    return route_by_span(rows.withColumn("n_tok", F.size(T.tokens(F.col("text")))), block)


def to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Both branches in one pass, a folder for each status."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("status").trigger(availableNow=True).start()
