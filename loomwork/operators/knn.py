"""Nearest neighbours over vectors, by blocks; MAP@R, top-1 accuracy and retention."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.corpus import settled

#: Queries in a block, at most and (if that makes more tasks) at least; places that a block keeps; vectors that meet a block at once, at least.
BLOCK, LEAST_BLOCK, HELD, PIECE = 4096, 128, 4_000_000, 2048
#: Products are of whole tiles: at ragged edges the same pair could get other last bits, and equal vectors wouldn't tie.
TILE = 64


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return df.withColumn("v", v).withColumn("norm", norm).withColumn("v", F.transform("v", lambda x: x / F.greatest(F.col("norm"), F.lit(1e-10)))).drop("norm", vector)


def _stored(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v as a stored table; every BLOCK-th row of a part of it, its first among them, carries a block along when a task reads it."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) % BLOCK == 0
    return settled(vectors.select("vec_id", "label", "v").coalesce(max(1, vectors.count() // BLOCK)).withColumn("carries", first))


def _search(queries: DataFrame, gallery: DataFrame, most: int, finish, schema: str, block: int) -> DataFrame:
    """finish(q_id, q_label, k, ids, labels, scores) -> columns of rows, for each query (vec_id, label, v, k): its k (at most most) gallery
    vectors (vec_id, label, v) of the highest scores, the query's own id left out, ties by the smaller id, highest first.

    Queries are dealt out to blocks once, a row each; each block's task reads the gallery, as _stored has it, from where it lies and never
    holds it, so nothing is copied on disk for a block. A task keeps k places for each of its queries, so blocks are smaller where k is large."""
    n = queries.count()
    spark = queries.sparkSession
    parts = max(1, -(-n // max(1, min(block, HELD // max(most, 1)))), min(spark.sparkContext.defaultParallelism, n // LEAST_BLOCK))
    where = F.lit(parts).cast("long")
    dealt = queries.select("vec_id", "label", F.col("k").cast("long").alias("k"), "v", F.pmod(F.xxhash64("vec_id"), where).cast("int").alias("b")).repartitionById(parts, F.col("b"))
    names = ["q_id", "q_label", "q_k", "q_v"]

    def pack(batches):
        held = [x for x in batches if x.num_rows]
        if held:
            all_ = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            flat = [*all_.columns[:3], all_.column(3).flatten()]
            yield pa.RecordBatch.from_arrays([pa.array([True, False]), *(pa.ListArray.from_arrays(pa.array([0, len(x), len(x)], pa.int32()), x, mask=pa.array([False, True])) for x in flat)], ["brings", *names])

    blocks = dealt.mapInArrow(pack, "brings boolean, q_id array<long>, q_label array<int>, q_k array<long>, q_v array<double>")
    # The gallery streams on the left; on the right a task holds two rows: its block, which only few vectors meet since each pair is a copy, and one without it.
    met = gallery.coalesce(1).join(blocks.hint("shuffle_replicate_nl"), F.col("carries") == F.col("brings")).select(*names, "vec_id", "label", "v")

    def run(batches):
        asked, waiting, rows, size = None, [], 0, max(PIECE, most)
        for batch in batches:
            if asked is None and len(at := np.flatnonzero(batch.column(0).is_valid())):
                asked = _asked(*(batch.column(c).slice(at[0], 1).flatten().to_numpy(zero_copy_only=False) for c in range(4)))
            waiting.append(batch.select(["vec_id", "label", "v"]))
            rows += batch.num_rows
            if asked is not None and rows >= size:
                _pieces(asked, waiting, size)
                waiting, rows = [], 0
        if asked is not None:
            _pieces(asked, waiting, size)
            yield from finish(asked["id"], asked["label"], asked["k"], *_ordered(asked))

    return met.mapInArrow(run, schema)


def _asked(ids: np.ndarray, labels: np.ndarray, k: np.ndarray, v: np.ndarray) -> dict:
    """A block of queries without places taken; least: what a score must reach to take one."""
    n = len(ids)
    return {"id": ids, "label": labels, "k": k, "v": _tiles(v.reshape(n, -1)), "least": np.full(n, np.finfo(float).min), "ids": [np.zeros(0, ids.dtype)] * n, "labels": [np.zeros(0, labels.dtype)] * n, "scores": [np.zeros(0)] * n}


def _tiles(v: np.ndarray) -> np.ndarray:
    return np.concatenate([v, np.zeros((-len(v) % TILE, v.shape[1]))])


def _pieces(asked: dict, batches: list, size: int) -> None:
    for batch in pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []:
        for at in range(0, batch.num_rows, size):
            ids, labels = (batch.column(c).slice(at, size).to_numpy(zero_copy_only=False) for c in (0, 1))
            _meet(asked, ids, labels, batch.column(2).slice(at, size).flatten().to_numpy().reshape(len(ids), -1))


def _meet(asked: dict, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
    """Puts what a piece of the gallery, in whatever order, has for each query among its best, which stay unordered."""
    score = (asked["v"] @ _tiles(v).T)[: len(asked["id"]), : len(ids)]
    same = np.flatnonzero(np.isin(ids, asked["id"]))
    score[:, same] = np.where(asked["id"][:, None] == ids[same], -np.inf, score[:, same])
    for q in np.flatnonzero(score.max(axis=1) >= asked["least"]):
        k, new = int(asked["k"][q]), np.flatnonzero(score[q] >= asked["least"][q])
        own = {name: np.concatenate([asked[name][q], more[new]]) for name, more in (("scores", score[q]), ("ids", ids), ("labels", labels))}
        if len(own["scores"]) >= k:
            keep = _best(own["scores"], own["ids"], k)
            own = {name: x[keep] for name, x in own.items()}
            asked["least"][q] = own["scores"].min()
        for name, x in own.items():
            asked[name][q] = x


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores are; at the last place ties go to the smaller id."""
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    over, ties = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
    if len(over) + len(ties) > k:
        ties = ties[np.argsort(ids[ties], kind="stable")[: k - len(over)]]
    return np.concatenate([over, ties])


def _ordered(asked: dict) -> tuple[list, list, list]:
    """ids, labels, scores: each query's places, the highest score first, ties by the smaller id."""
    for q, (ids, scores) in enumerate(zip(asked["ids"], asked["scores"])):
        order = np.argsort(-scores)
        if (np.diff(scores[order]) == 0).any():
            order = np.lexsort((ids, -scores))
        for name in ("ids", "labels", "scores"):
            asked[name][q] = asked[name][q][order]
    return asked["ids"], asked["labels"], asked["scores"]


def neighbours(queries: DataFrame, gallery: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """q_id, q_label, c_id, c_label, score, rank: the k gallery vectors (vec_id, label, v) nearest to each query, the query's own id
    left out; ties go to the smaller id. The search is exact: each query meets each vector, in memory alone."""

    def finish(q_id, q_label, k, ids, labels, scores):
        n = np.array([len(x) for x in ids], np.int64)
        if n.sum():
            rank = np.concatenate([np.arange(1, m + 1) for m in n])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, n)), pa.array(np.repeat(q_label, n)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(labels)), pa.array(np.concatenate(scores)), pa.array(rank, pa.int32())], ["q_id", "q_label", "c_id", "c_label", "score", "rank"])

    return _search(queries.withColumn("k", F.lit(k)), _stored(gallery), k, finish, "q_id long, q_label int, c_id long, c_label int, score double, rank int", block)


def map_at_r(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row (n_queries, map_at_r): for each query the mean over its class size - 1 = R best ranks of hits so far / rank at hits.

    Each query has its own R; a task gives one number for each query, and no pair becomes a row."""
    vectors = _stored(vectors)
    r = vectors.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("k")).filter("k > 0")
    most = r.agg(F.max("k")).first()[0] or 1

    def finish(q_id, q_label, k, ids, labels, scores):
        out = []
        for own, n, found in zip(q_label, k, labels):
            hit = found == own
            out.append(float((np.cumsum(hit) / np.arange(1, len(hit) + 1))[hit].sum() / n))
        yield pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(out, pa.float64())], ["q_id", "part"])

    per = _search(vectors.join(r, "label"), vectors, int(most), finish, "q_id long, part double", block)
    return per.agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("part"), 8).alias("map_at_r"))
