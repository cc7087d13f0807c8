"""What the operators of this subpackage share: reading tables, the shared work folder, splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; words are runs of anything else.
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Stands for a null id where ids are compared; turned back into null in results.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session doesn't set it and all of Spark runs on this machine (tests), a local folder is set."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not place:
        import tempfile

        place = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: its lineage ends there,
    so a lost executor costs one task of the next step and not the whole job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwork-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwork_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Removes tables made by stored() that no result needs any more."""
    for df in frames:
        path = getattr(df, "_loomwork_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def id_split(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts. A null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % parts


def word_count(text: Column) -> Column:
    """Number of runs of non-white characters; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")
