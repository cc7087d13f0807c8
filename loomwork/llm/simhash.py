"""SimHash fingerprints, and the search for all within a Hamming radius by permuted block tables.

Terms are words and pairs of neighbouring words (A-Z lower-cased); a term weighs 1 + log of its
count, pairs twice as much. Each term's 64-bit hash votes with its weight on each bit.

Search: 64 bits are cut into radius + 2 blocks. Two fingerprints within the radius differ in at most
radius blocks, so they agree on at least two: there is a table for each pair of blocks, keyed
by those two blocks, and equal keys in any table are candidates, whose distance is then counted.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import NULL_ID

BITS = 64
#: Bits of each byte value, most significant first, as +1 and -1.
_SIGNS = 2.0 * np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def fingerprint(text: str, words: WordHash) -> int:
    """0 for texts without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    one = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    two = _mixed(one[:-1] * _MIX + one[1:])
    votes = np.zeros(BITS)
    for terms, weight in ((_mixed(one), 1.0), (two, 2.0)):
        if len(terms):
            terms, n = np.unique(terms, return_counts=True)
            w = weight * (1 + np.log(n))
            parts = terms.astype(">u8").view(np.uint8).reshape(-1, 8)
            flat = np.bincount((parts + np.arange(8) * 256).ravel(), np.repeat(w, 8), 2048).reshape(8, 256)
            votes += (flat @ _SIGNS).ravel()
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def _cuts(docs: DataFrame, parts: int) -> list[int]:
    """Ids that cut the table into about equal ranges; nulls come last in descending order."""
    found = docs.select(F.col("id")).approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    return sorted({int(x) for x in found})


def fingerprints_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text of a document is its text with the last floor(n/2) code points replaced by the first as many (or all)
    of the next document's, in descending order of id; after the last comes the first. Null texts are empty; null ids come
    last; rows that share an id are ordered by text; repeated rows are rows of their own; an empty table gives an
    empty table; other columns are not read.

    Ranges of ids go to tasks, so each text moves once; the first document of each range (one a range: a number that
    doesn't grow with the rows) goes to the range before it too."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(id_col).alias("given"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(base.select("id"), n)
    # ranges in descending order of id: 0 holds the largest ids
    where = F.lit(len(cuts)) - F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("id"))) if cuts else F.lit(0)
    where = where.cast("int")
    heads = sorted((r.part, r.head) for r in base.select("id").withColumn("part", where).groupBy("part").agg(F.max("id").alias("head")).collect())
    # the head of each range follows the last row of the range before; that of the first follows the last row of all
    before = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    copy = F.try_element_at(F.create_map(*(F.lit(x).cast("long") if i % 2 == 0 else F.lit(x) for pair in before for i, x in enumerate(pair))), F.col("id")) if before else F.lit(None).cast("int")
    places = F.array_compact(F.array(F.struct(where.alias("part"), F.lit(0).alias("extra")), F.when(copy.isNotNull(), F.struct(copy.alias("part"), F.lit(1).alias("extra")))))
    dealt = base.withColumn("p", F.explode(places)).select("given", "text", "p.part", "p.extra", "id").repartitionById(max(len(heads), 1), F.col("part")).sortWithinPartitions("part", "extra", F.desc("id"), "text")

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        words, held = WordHash(), None
        for batch in batches:
            ids, rows, keep = batch.column(0), [], []
            for i, (text, part, extra) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)))):
                own = fingerprint(text, words)
                if held is not None and held[3] == part and not held[4]:
                    key, before_, mark = held[:3]
                    half = len(before_) // 2
                    edited = before_[: len(before_) - half] + text[:half]
                    other = fingerprint(edited, words)
                    keep.append(key)
                    rows.append((len(before_), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), f"{mark:016x}", f"{other:016x}", likeness(mark, other), likeness(mark, own)))
                held = (ids.slice(i, 1), text, own, part, extra)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(keep), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    return dealt.select("given", "text", "part", "extra").mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, query_col: str = "fingerprint", index_col: str = "fingerprint") -> DataFrame:
    """query, found (16 hex digits each), distance: all pairs of distinct values within the radius, each once.

    Works on distinct fingerprints: copies meet again through them, and no group of copies becomes pairs. Nulls are
    left out. radius: up to 14."""
    blocks = radius + 2
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [sum(((1 << (edges[b + 1] - edges[b])) - 1) << (BITS - edges[b + 1]) for b in pair) for pair in combinations(range(blocks), 2)]
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    number = lambda c: F.expr(f"cast(conv({c}, 16, -10) as bigint)")

    def keyed(df, col, name):
        own = df.select(F.col(col).alias("h")).dropna().distinct().select(F.col("h").alias(name), number("h").alias(f"{name}_n"))
        keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"{name}_n").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(signed)))
        return own.withColumn("k", F.explode(keys)).select(name, f"{name}_n", "k.t", "k.key")

    both = keyed(queries, query_col, "query").join(keyed(index, index_col, "found"), ["t", "key"])
    distance = F.bit_count(F.col("query_n").bitwiseXOR(F.col("found_n")))
    return both.withColumn("distance", distance).filter(F.col("distance") <= radius).select("query", "found", "distance").distinct()
