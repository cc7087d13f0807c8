"""Toxicity by weak supervision.

Many voters look at a document: words, and beginnings that two different words share, that the training labels clearly
associate with toxicity, each a voter; the absence of all of those; and fixed surface patterns. A generative label model
estimates by expectation maximisation how often each voter votes what on toxic and on clean documents (the given label is one
voter more, whose accuracy is estimated like any other's) and the correlations of voters within a class, by which voters that
say the same count less. Its posterior labels train a linear classifier over words and word beginnings, which scores every
document. All that is fitted is fitted in one executor task over a sample of labelled rows of a stated bound;
the driver gets weights by feature.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, id_split, stored, text_bytes

#: Bound of what is learned from: labelled rows.
MOST_LABELLED = 20_000
#: A feature is one of the classifier's if it is in so many rows and its log odds are so many deviations from 0; it
#: is a voter, too, if they are at least VOTER_Z and it is so many times likelier in toxic rows.
LEAST_ROWS, LEAST_Z, VOTER_Z, LEAST_TIMES = 4, 2.5, 5, 9
STRIP = b".,;:!?\"'()[]{}<>*%$#&|-_"
BEGINNINGS = range(4, 11)


class FeaturesOf(dict):
    """The features of a token: the word, and its beginnings of some lengths (in bytes). chosen: indexes by
    feature, or None for all features as they are."""

    def __init__(self, chosen: dict[bytes, int] | None = None, most: int = 500_000):
        super().__init__()
        self.chosen, self.most = chosen, most
        known = chosen or {}
        #: By a beginning's index, the index of the same beginning found twice.
        self.twin = {i: known[b"2" + f[1:]] for f, i in known.items() if f[:1] == b"b" and b"2" + f[1:] in known}

    def __missing__(self, token: bytes):
        if len(self) >= self.most:
            self.clear()
        word = token.strip(STRIP)
        all_ = ([b"w " + word] if word else []) + [b"b " + word[:n] for n in BEGINNINGS if len(word) > n]
        got = self[token] = tuple(all_ if self.chosen is None else (self.chosen[f] for f in all_ if f in self.chosen))
        return got

    def of(self, raw: bytes) -> set:
        """Distinct features; a beginning that two different words share also counts as found twice."""
        seen: dict = {}
        for found in map(self.__getitem__, set(raw.lower().split())):
            for f in found:
                seen[f] = f in seen
        twice = [self.twice(f) for f, again in seen.items() if again]
        return {*seen, *(f for f in twice if f is not None)}

    def twice(self, f):
        if self.chosen is None:
            return b"2" + f[1:] if f[:1] == b"b" else None
        return self.twin.get(f)


#: Surface patterns that also vote; the label model finds out what they are worth.
PATTERNS = (rb"!{2,}", rb"\b[A-Z]{4,}\b", rb"\b[Yy]ou (?:are|\'re)\b", rb"[*#@$%&]{3,}", rb"(.)\1{4,}")


def surface_votes(raw: bytes) -> list[int]:
    return [1 if re.search(p, raw) else 0 for p in PATTERNS]


@dataclass
class LabelModel:
    """P(vote | class) of each voter, from votes in -1, 0, 1 and given labels."""

    table: np.ndarray = field(default=None)  # [voter, class, vote + 1]
    prior: float = 0.5
    worth: np.ndarray = field(default=None)
    correlation: np.ndarray = field(default=None)

    def fit(self, votes: np.ndarray, given: np.ndarray, rounds: int = 25, trust: float | None = 0.97) -> LabelModel:
        """trust: how often a given label is right, if that is known; None: it is estimated like the accuracy of any voter."""
        all_votes = self._with_labels(votes, given)
        q = np.clip(given.astype(float), 0.05, 0.95)
        said = [(all_votes == v).astype(np.float32) for v in range(3)]
        for _ in range(rounds):
            counts = np.stack([np.stack([w.astype(np.float32) @ x for x in said], axis=1) for w in (1 - q, q)], axis=1).astype(float) + 0.5
            self.table = counts / counts.sum(axis=2, keepdims=True)
            if trust is not None:
                self.table[-1] = [[trust, 1e-6, 1 - trust], [1 - trust, 1e-6, trust]]
            self.prior = float(np.clip(q.mean(), 1e-3, 1 - 1e-3))
            self.correlation = self._correlation(all_votes, q)
            tied = np.where(self.correlation > 0.1, self.correlation, 0).sum(axis=1)
            self.worth = 1 / (1 + tied)
            self.worth[-1] = 1
            fresh = self.posterior(votes, given)
            if np.abs(fresh - q).max() < 1e-4:
                break
            q = fresh
        return self

    @staticmethod
    def _with_labels(votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Votes 0, 1 (abstained), 2; the given labels are the last voter."""
        return np.concatenate([votes, (2 * given - 1)[:, None]], axis=1).astype(np.int8) + np.int8(1)

    def _correlation(self, all_votes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Between voters within a class: what they share beyond the label."""
        x = all_votes.astype(np.float32)
        out = np.zeros((x.shape[1],) * 2)
        for w in (1 - q, q):
            share = w.sum() / len(q)
            z = (x - ((w @ x) / max(w.sum(), 1e-9)).astype(np.float32)) * np.sqrt(w).astype(np.float32)[:, None]
            cov = z.T @ z / max(w.sum(), 1e-9)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            out += share * np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0)
        np.fill_diagonal(out, 0)
        return np.abs(out)

    def posterior(self, votes: np.ndarray, given: np.ndarray) -> np.ndarray:
        all_votes = self._with_labels(votes, given)
        ratio = np.log(self.table[:, 1] / self.table[:, 0])
        ratio[:, 1] = 0  # who abstains says nothing; the voters on absence speak for what isn't there
        odds = np.log(self.prior / (1 - self.prior)) + sum((all_votes == v) @ (ratio[:, v] * self.worth) for v in (0, 2))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class ToxicityModel:
    """Weights by feature and the intercept. Without labels of both kinds there are no features."""

    weights: dict[bytes, float]
    intercept: float


def _logistic(rows: list[np.ndarray], target: np.ndarray, n: int, decay: float = 0.05, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Adam over all rows at once, on soft labels; rows: indexes of present features."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols = np.concatenate(rows) if len(at) else np.zeros(0, np.int64)
    p = np.append(np.zeros(n), np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for k in range(1, rounds + 1):
        err = 1 / (1 + np.exp(-np.clip(p[-1] + np.bincount(at, p[cols], len(rows)), -30, 30))) - target
        g = np.append(np.bincount(cols, err[at], n), err.sum()) + decay * np.append(p[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p - 0.1 * (1 - 0.9 * k / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return p[:-1], float(p[-1])


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, seed: int = 9, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """labels: id_col and label_col (1: toxic) of rows to learn from; null ids and labels are left out, an id with
    several labels is toxic if one of them says so. At most most_labelled rows are used, those whose hashed ids are smallest."""
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = given.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most_labelled)
    texts = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    # an id may have many rows: the bound holds for rows, too
    met = texts.join(F.broadcast(chosen), "id").select("y", "raw")
    sample = stored(met, "toxic-sample")
    if sample.count() > most_labelled:
        whole, sample = sample, stored(sample.orderBy(F.xxhash64(F.lit(seed), "raw"), "raw").limit(most_labelled), "toxic-sample")
        discard(whole)
    size, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not size or positive in (0, size):
        discard(sample)
        return ToxicityModel({}, 6.0 if size and positive else -6.0)

    def counts(batches):
        features = FeaturesOf()
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in features.of(raw):
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([v[1] for v in seen.values()], pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64())], ["f", "a", "b"])

    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (positive - F.col("a") + 0.5)) - F.log(b / (size - positive - F.col("b") + 0.5))
    per = sample.mapInArrow(counts, "f binary, a bigint, b bigint").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    told = per.filter(F.col("a") + F.col("b") >= LEAST_ROWS).withColumn("z", odds / F.sqrt(1 / a + 1 / b)).filter(F.abs("z") > LEAST_Z)
    times = (a / positive) / (b / (size - positive))
    votes = (F.col("z") > VOTER_Z) & (times > LEAST_TIMES) & F.substring("f", 1, 1).cast("string").isin("w", "2")
    best = told.select("f", F.when(votes, F.col("f")).alias("voter")).toArrow().sort_by("f")
    names, own = best.column("f").to_pylist(), best.column("voter").to_pylist()
    index = {f: i for i, f in enumerate(names)}
    voters = {v: i for i, v in enumerate(v for v in own if v is not None)}
    voter_of = np.array([-1 if v is None else voters[v] for v in own], np.int32)
    sc = docs.sparkSession.sparkContext
    held = sc.broadcast((index, voter_of, [v[:1] for v in voters]))
    rows = sample.mapInArrow(_seen(held), "y int, found array<int>, surface array<int>, mark bigint")
    fitted = rows.repartition(1).mapInArrow(_fit(held), "weights binary, intercept double").first()
    held.unpersist()
    discard(sample)
    return ToxicityModel(dict(zip(names, np.frombuffer(fitted.weights).tolist())), fitted.intercept)


def _fit(held):
    """One task over the sample's rows (y, found, surface, mark): the label model, then the classifier on its posteriors."""

    def run(batches):
        _, voter_of, kinds = held.value
        table = pa.Table.from_batches(list(batches)).combine_chunks().sort_by([("mark", "ascending"), ("y", "ascending")])
        places = table.column("found").combine_chunks()
        bounds, values = places.offsets.to_numpy(), places.values.to_numpy()
        found = [np.sort(values[lo:hi]) for lo, hi in zip(bounds, bounds[1:])]
        y = table.column("y").to_numpy().astype(np.int64)
        lexicon = np.zeros((len(y), len(kinds)), np.int8)
        for i, f in enumerate(found):
            at = voter_of[f]
            lexicon[i, at[at >= 0]] = 1

        def absence(of: bytes) -> np.ndarray:
            """-1 where no voter of these kinds votes; nobody votes if there are no such voters."""
            own = [j for j, k in enumerate(kinds) if k in of]
            return np.where(lexicon[:, own].any(axis=1), 0, -1) if own else np.zeros(len(y), np.int64)

        surface = table.column("surface").combine_chunks().flatten().to_numpy().reshape(-1, len(PATTERNS))
        votes = np.concatenate([lexicon, np.stack([absence(k) for k in (b"w", b"2", b"w2")], axis=1), surface], axis=1).astype(np.int8)
        model = LabelModel().fit(votes, y, trust=None)
        weights, intercept = _logistic(found, model.posterior(votes, y), len(voter_of))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([intercept], pa.float64())], ["weights", "intercept"])

    return run


def _seen(held):
    """The features of each row of (y, raw), by index, its surface votes, and a hash of its text."""

    def run(batches):
        features = FeaturesOf(held.value[0])
        for batch in batches:
            raws = batch.column(1).to_pylist()
            marks = [int.from_bytes(hashlib.blake2b(r, digest_size=8).digest(), "big", signed=True) for r in raws]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(features.of(r)) for r in raws], pa.list_(pa.int32())), pa.array([surface_votes(r) for r in raws], pa.list_(pa.int32())), pa.array(marks, pa.int64())], ["y", "found", "surface", "mark"])

    return run


def _scorer(docs: DataFrame, model: ToxicityModel):
    """batch -> scores of its first column (binary texts), made once per task."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        weight = list(held.value.weights.values())
        features = FeaturesOf({f: i for i, f in enumerate(held.value.weights)})

        def score(batch):
            z = np.array([held.value.intercept + sum(map(weight.__getitem__, sorted(features.of(raw)))) for raw in batch.column(0).to_pylist()])
            return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

        return score

    return make


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score (0 to 1) for every row of docs, from whole texts. Null and empty texts get the score of a text
    without features; repeated rows are scored each; empty tables give empty tables; other columns are not read."""
    make = _scorer(docs, model)

    def run(batches):
        score = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(score(batch), pa.float64())], [id_col, "score"])

    return docs.select(text_bytes(text_col).alias("raw"), id_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score under the threshold, all columns as they are."""
    make = _scorer(docs, model)

    def run(batches):
        score = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).filter(pa.array(score(batch) < threshold))

    names = [f"c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    raw = text_bytes(names[docs.columns.index(text_col)]).alias("raw")
    return renamed.select(raw, *names).mapInArrow(run, renamed.schema).toDF(*docs.columns)


def split_training(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labelled rows to learn from: crc32 of the id modulo 3 is not 1."""
    return labels.filter(id_split(id_col, 3) != 1)
