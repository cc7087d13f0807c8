"""The query of each operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe_tree, brown_lm, chat_parts, cube_mix, line_dedup, minhash_join, quality_net, simhash, tiff_media, weak_toxicity
from loomwork.llm.common import id_split, table

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", id_split("doc_id", 10) == 0)
    model = brown_lm.train(docs.filter(~F.col("held_out")))
    scored = brown_lm.score_documents(docs, model, carry=("held_out",))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = cube_mix.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but formatted_chars is read back from the formatted text."""
    own = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")) for i, role in enumerate(("user", "assistant"))))).alias("r")).select("r.*")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    chats = chat_parts.format_conversations(turns.select("conv_id", "turn", "role", chat_parts.text_message(F.col("text")).alias("parts")))
    told = F.array_join(F.transform(chat_parts.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(chat_parts.read_masked(F.col("formatted"), F.col("loss_mask")), "")
    read = chats.select("conv_id", F.size(chat_parts.read_turns(F.col("formatted"))).cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 32 + length(role) + length(text)
    + len(regexp_extract_all(role, '<\||</?s>|\[/?INST\]|\\')) + len(regexp_extract_all(text, '<\||</?s>|\[/?INST\]|\\')) AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op4_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_net.train(docs, quality_net.split_training(table(spark, sf_dir, "labels")))
    scored = quality_net.score_documents(docs, model)
    return scored.select("doc_id", (id_split("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprints_with_edits(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_OP6_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT doc_id, pos, line, key IN (SELECT key FROM common) AS gone FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


def op7_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_media.texts_as_tiff(table(spark, sf_dir, "documents"), with_media=False)


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


_OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = weak_toxicity.train(docs, weak_toxicity.split_training(table(spark, sf_dir, "labels")))
    scored = weak_toxicity.score_documents(docs, model)
    return scored.select("doc_id", (id_split("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe_tree.load_ranks(public_tokenizers.path(TOKENIZER))
    return bpe_tree.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_mix_sources, op3_chat_format, op4_quality_net, op5_simhash, op6_line_dedup, op7_tiff_media, op8_minhash_join, op9_weak_toxicity, op10_bpe_tree)}
ORACLE_SQL = {"op3_chat_format": _OP3_SQL, "op6_line_dedup": _OP6_SQL, "op8_minhash_join": _OP8_SQL}
