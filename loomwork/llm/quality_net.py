"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Each word has a sparse random index vector (a few +1 and -1). A word's vector is the sum of the index vectors of its
neighbours over the whole corpus, in integers, so the order of summing doesn't matter. Whole words are hashed to a fixed
number of rows, so the matrix has the same size for any corpus; each task sums its own, groups of tasks' sums are summed
by slices, then all groups'. A document is the mean of its words' unit vectors and index vectors. The network is trained
in numpy on a bounded sample of labelled documents and its temperature is set on rows that it was not trained on.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, id_split, stored, text_bytes

ROWS, WIDTH, NONZERO, WINDOW, SLICES = 65_536, 64, 2, 2, 64
MOST_LABELLED = 20_000
#: Tasks' sums meet in so many groups first.
GROUPS = 32
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\s]")


class FormRow(dict):
    """The matrix row of a token, by a hash of the whole token."""

    def __init__(self, rows: int = ROWS, most: int = 500_000):
        super().__init__()
        self.rows, self.most = rows, most

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[token] = zlib.crc32(token) % self.rows
        return got

    def of(self, raw: bytes) -> list[int]:
        return list(map(self.__getitem__, _TOKEN.findall(raw)))


def index_vectors(rows: int = ROWS, width: int = WIDTH, nonzero: int = NONZERO, seed: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector."""
    rng = np.random.default_rng(seed)
    places = np.stack([rng.permutation(width)[:nonzero] for _ in range(rows)])
    return places, rng.choice(np.array([-1, 1]), (rows, nonzero))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """[ROWS, WIDTH] sums over all documents. The driver receives this one matrix (4 MB)."""

    def gather(batches):
        rows, (places, signs) = FormRow(), index_vectors()
        total = np.zeros(ROWS * WIDTH, np.int64)
        for batch in batches:
            ids: list[int] = []
            for raw in batch.column(0).to_pylist():
                ids += rows.of(raw)
                ids += [-1] * WINDOW
                if len(ids) > 2_000_000:
                    total += near(np.array(ids), places, signs)
                    ids = []
            if ids:
                total += near(np.array(ids), places, signs)
        group = TaskContext.get().partitionId() % GROUPS
        for k, part in enumerate(np.array_split(total, SLICES)):
            if part.any():
                yield coded(group, k, part)

    def coded(group, k, part):
        small = part.astype(np.int32 if np.abs(part).max() < 2**31 else np.int64)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([k], pa.int32()), pa.array([zlib.compress(small.tobytes(), 1)], pa.binary()), pa.array([len(part)], pa.int32())], ["g", "k", "part", "n"])

    def near(ids, places, signs):
        out = np.zeros(ROWS * WIDTH, np.int64)
        for off in range(1, WINDOW + 1):
            a, b = ids[:-off], ids[off:]
            ok = (a >= 0) & (b >= 0)
            a, b = a[ok], b[ok]
            for x, y in ((a, b), (b, a)):
                for j in range(NONZERO):
                    flat = x * WIDTH + places[y, j]
                    plus = signs[y, j] > 0
                    out += np.bincount(flat[plus], minlength=len(out)) - np.bincount(flat[~plus], minlength=len(out))
        return out

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for g, k, part, n in zip(*(c.to_pylist() for c in batch.columns)):
                data = zlib.decompress(part)
                x = np.frombuffer(data, np.int32 if len(data) == 4 * n else np.int64)
                sums[g, k] = sums[g, k] + x if (g, k) in sums else x.astype(np.int64)
        for (g, k), x in sums.items():
            yield coded(g, k, x)

    schema = "g int, k int, part binary, n int"
    parts = docs.select(text_bytes(text_col).alias("raw")).mapInArrow(gather, schema).repartition(4 * SLICES, "g", "k").mapInArrow(add, schema)
    parts = parts.withColumn("g", F.lit(0)).repartition(SLICES, "k").mapInArrow(add, schema)
    total = np.zeros(ROWS * WIDTH, np.int64)
    starts = np.cumsum([0, *(len(p) for p in np.array_split(total, SLICES))])
    for r in parts.toLocalIterator():
        data = zlib.decompress(r.part)
        total[starts[r.k] : starts[r.k + 1]] += np.frombuffer(data, np.int32 if len(data) == 4 * r.n else np.int64)
    return total.reshape(ROWS, WIDTH)


def unit_vectors(sums: np.ndarray) -> np.ndarray:
    """Rows with their common direction taken out, of length 1; then index vectors beside them."""
    x = sums.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1)
    seen = sums.any(axis=1)
    x = x - (x[seen].mean(axis=0) if seen.any() else 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x[~seen] = 0
    places, signs = index_vectors()
    own = np.zeros((ROWS, WIDTH), np.float32)
    np.put_along_axis(own, places, signs.astype(np.float32), axis=1)
    return np.concatenate([x, own], axis=1)


def pooled(ids: list[int], vectors: np.ndarray) -> np.ndarray:
    """The mean of the words' vectors, and how far the mean rests on few of them: its squared length in both halves, the sum of
    squared shares of words, the largest share."""
    out = np.zeros(vectors.shape[1] + 4, np.float32)
    if ids:
        rows, n = np.unique(np.array(ids), return_counts=True)
        mean = (n.astype(np.float32) @ vectors[rows]) / np.float32(len(ids))
        share = n / len(ids)
        out[:-4] = mean
        out[-4:] = (mean[:WIDTH] ** 2).sum(), (mean[WIDTH:] ** 2).sum(), (share**2).sum(), share.max()
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        # float64 throughout and one row at a time in effect: a row's score doesn't depend on its batch
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 4) -> QualityModel:
    """Adam on cross entropy; every fifth row is kept for the temperature."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-4
    kept = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), bool)
    z, t = (x[~kept] - mean) / scale, y[~kept].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3)))]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for lo in range(0, len(z), 256):
            rows = order[lo : lo + 256]
            h = np.tanh(z[rows] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[rows]) / len(rows)
            back = np.outer(err, p[2]) * (1 - h**2)
            grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ err + 1e-4 * p[2], err.sum()]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    model = QualityModel(vectors, mean, scale, *p[:3], float(p[3]), 1.0)
    if kept.any():
        raw, want = model.logits(x[kept]), y[kept]

        def loss(temp):
            q = np.clip(1 / (1 + np.exp(-np.clip(raw / temp, -30, 30))), 1e-9, 1 - 1e-9)
            return -(want * np.log(q) + (1 - want) * np.log(1 - q)).mean()

        model.temperature = float(min(np.geomspace(0.5, 8, 61), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, seed: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Word vectors from all docs; the network from at most most_labelled rows of labels (id_col, label_col), those whose
    hashed ids are smallest. Null ids and labels are left out; an id with several labels is good if all are.
    With no labels, or labels of one kind, the score is a constant."""
    vectors = unit_vectors(word_vectors(docs, text_col))
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.min("y").alias("y"))
    chosen = given.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most_labelled)
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        rows = FormRow()
        for batch in batches:
            x = [pooled(rows.of(raw), held.value).tobytes() for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.binary())], ["id", "y", "x"])

    sample = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw")).join(F.broadcast(chosen), "id").select("id", "raw", "y")
    # an id may have many rows: the bound holds for rows, too
    sample = stored(sample, "quality-sample")
    if sample.count() > most_labelled:
        whole, sample = sample, stored(sample.orderBy(F.xxhash64(F.lit(seed), "id", "raw"), "raw").limit(most_labelled), "quality-sample")
        discard(whole)
    got = sorted(sample.mapInArrow(features, f"id {dict(sample.dtypes)['id']}, y int, x binary").collect(), key=lambda r: (zlib.crc32(str(r.id).encode()), str(r.id), r.x))
    held.unpersist()
    discard(sample)
    y = np.array([r.y for r in got])
    if not len(got) or y.min() == y.max():
        flat = np.zeros(2 * WIDTH + 4)
        return QualityModel(vectors, flat, flat + 1, np.zeros((len(flat), 1)), np.zeros(1), np.zeros(1), 0.0 if not len(got) else 6.0 if y[0] else -6.0, 1.0)
    return fit_network(np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float), y, vectors)


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1, higher: better) for every row of docs, from whole texts. Null and empty texts pool to zeros;
    repeated rows are scored each; empty tables give empty tables; other columns are not read."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        rows, net = FormRow(), held.value
        for batch in batches:
            x = [pooled(rows.of(raw), net.vectors) for raw in batch.column(1).to_pylist()]
            p = net.probability(np.stack(x).astype(float)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], [id_col, "score"])

    return docs.select(id_col, text_bytes(text_col).alias("raw")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def split_training(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows to learn from: crc32 of the id modulo 5 is not 0."""
    return labels.filter(id_split(id_col, 5) != 0)
