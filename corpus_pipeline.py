"""From documents to token ids: toxicity, line dedup, near-duplicates, source mix, byte-level BPE.

Each stage is (name, function); function(spark, docs, sf_dir) returns what the next one gets as docs. All
but the last return the columns of documents. Rows of a stage are documents of its input; a text
changes only in line dedup, and n_chars with it. The mix repeats documents that it takes several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe_tree, cube_mix, line_dedup, minhash_join, weak_toxicity
from loomwork.llm.common import discard, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC, COMMON_LINE, ALIKE_PERCENT = 0.7, 10, 80


def _with_key(docs: DataFrame) -> DataFrame:
    """Rows are known by id and a hash of their text: no id is lost if ids repeat or are null."""
    return docs.withColumn("k_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("k_body", F.xxhash64(F.coalesce("text", F.lit(""))))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among docs and drops those with a score of at least TOXIC."""
    labels = weak_toxicity.split_training(table(spark, sf_dir, "labels"))
    model = weak_toxicity.train(docs, labels)
    return weak_toxicity.keep_clean(docs, model, TOXIC)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least COMMON_LINE documents go from all of them. No document goes."""
    bitmaps = line_dedup.line_keep_bitmaps(docs, COMMON_LINE)
    kept = line_dedup.apply_keep_bitmaps(docs, bitmaps, carry=("lang", "source"))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group (five-word shingles, a similarity of at least ALIKE_PERCENT) stays: the one with the
    least id. Groups are of rows: with ids repeated or null, unlike texts are different documents and equal rows are copies."""
    return minhash_join.keep_one(docs.select(*COLUMNS), percent=ALIKE_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Of rows with equal id, source and text the one whose other columns are
    least is repeated as often as the mix takes them all."""
    mix = cube_mix.mix_sources(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("k_id"), F.col("body").alias("k_body"), F.col("source").alias("k_source"), "copies")
    mix = stored(mix.groupBy("k_id", "k_body", "k_source").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).filter("copies > 0"), "mix")
    own = _with_key(docs)
    met = lambda left, right: left.join(right, (left["k_id"] == right["k_id"]) & (left["k_body"] == right["k_body"]) & left["source"].eqNullSafe(right["k_source"]))
    taken = met(own, mix.filter("rows = 1")).select(*COLUMNS, "copies")
    several = mix.filter("rows > 1")
    if several.limit(1).count():
        least = met(own, several).groupBy(own["k_id"], own["k_body"], own["source"], "copies").agg(F.min(F.struct("doc_id", "text", "lang", "n_chars")).alias("row"))
        taken = taken.unionByName(least.select("row.*", "source", "copies"))
    # in chunks, so that no row becomes an array of unbounded length
    chunk = taken.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / cube_mix.CHUNK))))
    again = F.sequence(F.col("chunk") * cube_mix.CHUNK + 1, F.least((F.col("chunk") + 1) * cube_mix.CHUNK, F.col("copies")))
    return chunk.withColumn("again", F.explode(again)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix."""
    import public_tokenizers

    ranks = bpe_tree.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe_tree.encode_documents(docs, ranks, public_tokenizers.PATTERN, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near-duplicates", drop_near_duplicates),
    ("source mix", mix_sources),
    ("byte-level BPE", encode),
]

#: The stages' models and samples can't be stated in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows stored in the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        before, docs = docs, stored(out, f"stage-{k}")
        discard(before)
    return docs
