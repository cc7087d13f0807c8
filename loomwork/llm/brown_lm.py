"""Brown class-based bigram model: exchange clustering, class transitions and word emissions.

P(word | class before) = P(class | class before) * P(word | class). The emission of a word is its share of its
class in the smoothed unigram distribution u(w) = (c + 0.1) / (N + 0.1 (V + 1)), so a text's score is its unigram
score plus the sum over tokens of log10(transition / class mass).

Clustering begins with the most frequent words and, for all others, groups by their ending: exchange until none moves.
Then every further word with a count of at least LEAST gets a unit of its own, so units grow with the corpus. It begins in
its group's class; how often it has neighbours of each class, on either side, is counted over the corpus, and all such words go to
the class that fits their neighbours best, sweep by sweep until none moves. In these sweeps a neighbour counts by the class
it has before them. Groups by ending are left to words below LEAST and to those that training doesn't have. Class transitions
are then counted over the corpus by the final classes.

The corpus is cut into words twice in training: to count them, and, when the words with units are known, to turn texts into units.
The units are a table in the shared folder, from which neighbours of units and of classes are counted.

Executors know the further words by 64-bit hashes (17 bytes a word with class and score). The word table may be of any size:
it stays a table in the shared folder, and a text's words below LEAST meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import discard, stored, text_bytes

ADD = 0.1
FREQUENT, ENDINGS = 2047, 1024
UNITS = FREQUENT + ENDINGS + 1
#: The unit that ends a text and stands before its first word.
END = UNITS - 1
CLASSES, SLICES, PRIOR = 64, 16, 5.0
#: Least count of a word with a unit of its own beyond the most frequent ones; such words in a slice of their contexts.
LEAST, SPAN = 10, 8192


class UnitOf(dict):
    """The unit of a word. grown: sorted hashes of the words that have units from UNITS on. Only words with units of their own
    are kept here, at most so many: rare words would make it large and slow, and their group is soon told."""

    def __init__(self, frequent: list[bytes], grown: np.ndarray | None = None, most: int = 500_000):
        self.known, self.grown, self.most = {w: i for i, w in enumerate(frequent)}, grown if grown is not None and len(grown) else None, most
        super().__init__(self.known)

    def __missing__(self, word: bytes) -> int:
        return int(self._look_up([word])[0])

    def of(self, words: list[bytes]) -> np.ndarray:
        """The units of words."""
        ids = np.fromiter(map(self.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(ids < 0)
        if len(new):
            ids[new] = self._look_up([words[i] for i in new.tolist()])
        return ids

    def of_texts(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts with an end after each, and the place of each end."""
        ends = np.cumsum([len(words) for words in texts])
        return np.insert(self.of(list(chain.from_iterable(texts))), ends, END), ends + np.arange(len(texts))

    def _look_up(self, words: list[bytes]) -> np.ndarray:
        ids, rest = np.empty(len(words), np.int32), range(len(words))
        if self.grown is not None:
            h = hashes(words)
            at = np.minimum(self.grown.searchsorted(h), len(self.grown) - 1)
            found = self.grown[at] == h
            ids[found] = UNITS + at[found]
            if len(self) + np.count_nonzero(found) > max(self.most, len(self.known)):
                self.clear()
                self.update(self.known)
            self.update(zip((words[i] for i in np.flatnonzero(found).tolist()), ids[found].tolist()))
            rest = np.flatnonzero(~found).tolist()
        ids[rest] = [group_of(words[i]) for i in rest]
        return ids


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def group_of(word: bytes) -> int:
    return FREQUENT + zlib.crc32(word[-4:] + (b"." if len(word) > 9 else b"")) % ENDINGS


def word_hash(word: bytes) -> np.int64:
    return hashes([word])[0]


def words_of(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def count_words(docs: DataFrame) -> DataFrame:
    """word binary, c bigint over docs (raw binary); each task sums up before rows move."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                seen.update(words_of(raw))
                if len(seen) > 1_000_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("raw").mapInArrow(run, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def encoded(docs: DataFrame, frequent: list[bytes], grown: np.ndarray) -> DataFrame:
    """x: int32 units of some whole texts of docs (raw binary), with ends around each text. Every neighbourhood lies in one row."""
    held = docs.sparkSession.sparkContext.broadcast((frequent, grown))

    def run(batches):
        for ids in _chunks(batches, UnitOf(*held.value)):
            yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary())], ["x"])

    return stored(docs.select("raw").mapInArrow(run, "x binary"), "lm-units")


def _rows(batches):
    """Arrays of units from batches of encoded(), many rows at a time; the end between two texts stands once."""
    held, size = [], 0
    for batch in batches:
        for x in batch.column(0):
            ids = np.frombuffer(x.as_buffer(), np.int32)
            held.append(ids[1:] if held else ids)
            size += len(ids)
            if size > 1_000_000:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def pair_counts(units: DataFrame, group: np.ndarray) -> np.ndarray:
    """[UNITS, UNITS] counts of neighbouring units, further words counting as their groups (group, by place); tasks' sums are
    summed by slices, the driver gets one matrix of fixed size."""
    held = units.sparkSession.sparkContext.broadcast(group.astype(np.int16))
    high = UNITS // SLICES

    def gather(batches):
        total, fold = np.zeros(UNITS * UNITS, np.uint32), np.append(np.arange(UNITS, dtype=np.int32), held.value)
        for ids in _rows(batches):
            x = fold[ids]
            np.add.at(total, x[:-1] * UNITS + x[1:], np.uint32(1))
        for k in range(SLICES):
            part = total[k * high * UNITS : (k + 1) * high * UNITS if k < SLICES - 1 else None]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["k", "part"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(zlib.decompress(part), np.uint32)
                if k in sums:
                    sums[k] += x
                else:
                    sums[k] = x.astype(np.float64)
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.astype(np.float32).tobytes(), 1)], pa.binary())], ["k", "part"])

    out = np.zeros(UNITS * UNITS, np.float32)
    parts = units.mapInArrow(gather, "k int, part binary").repartition(SLICES, "k").mapInArrow(add, "k int, part binary")
    for r in parts.collect():
        x = np.frombuffer(zlib.decompress(r.part), np.float32)
        out[r.k * high * UNITS : r.k * high * UNITS + len(x)] += x
    held.destroy()
    return out.reshape(UNITS, UNITS)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int | None = None) -> np.ndarray:
    """The class of each unit. Each unit in turn, frequent ones first, goes to the class where the likelihood of class
    bigrams is highest, until none moves (or for so many sweeps). The last unit (the end) has class 0 for itself."""
    n = len(pairs)
    columns = np.ascontiguousarray(pairs.T)
    mass = pairs.sum(axis=1) + pairs.sum(axis=0)
    order = [w for w in np.lexsort((np.arange(n), -mass)).tolist() if w != n - 1]
    of = np.zeros(n, np.int64)
    for rank, w in enumerate(order):
        of[w] = 1 + rank % (classes - 1)
    of[n - 1] = 0
    m = np.zeros((classes, classes))
    np.add.at(m, (of[:, None].repeat(n, 1).ravel(), np.tile(of, n)), pairs.ravel())
    eye = np.eye(classes, dtype=bool)
    least = 1e-9 + 1e-12 * float(_f(m.sum()))  # above rounding, or moves of no gain might never end
    for _ in count() if sweeps is None else range(sweeps):
        moved = 0
        for w in order:
            if not mass[w]:
                continue
            a, self_ = of[w], float(pairs[w, w])
            r, l = np.bincount(of, pairs[w], classes), np.bincount(of, columns[w], classes)
            m[a] -= r
            m[:, a] -= l
            m[a, a] += self_
            r[a] -= self_
            l[a] -= self_
            np.maximum(m, 0, out=m)
            base = _f(m)
            diag = np.diag(m)
            across = np.where(eye, 0, _f(m + r[None, :]) - base).sum(axis=1)
            down = np.where(eye, 0, _f(m + l[:, None]) - base).sum(axis=0)
            rows, cols = m.sum(axis=1) + l, m.sum(axis=0) + r  # wherever the unit goes, its neighbours count in their own classes' sums
            gain = across + down + _f(diag + r + l + self_) - _f(diag) - (_f(rows + r.sum() + self_) - _f(rows)) - (_f(cols + l.sum() + self_) - _f(cols))
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + least:
                b = a
            m[b] += r
            m[:, b] += l
            m[b, b] += self_
            of[w] = b
            moved += b != a
        if not moved:
            break
    return of


def _texts(batches):
    """Words of texts, some texts at a time."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            held.append(words_of(raw))
            size += len(raw)
            if size > 1_000_000:
                yield held
                held, size = [], 0
    if held:
        yield held


def _chunks(batches, unit: UnitOf):
    """Arrays of units of whole texts, with ends around each text."""
    for texts in _texts(batches):
        ids, ends = unit.of_texts(texts)
        start = 0
        for a, b in zip(ends.tolist(), [*ends[1:].tolist(), 0]):
            if a - start > 65_536 or not b:  # small rows: Parquet writers and readers hold some hundred of them
                yield np.append(np.int32(END), ids[start : a + 1])
                start = a + 1


def grown_words(counts: DataFrame, frequent: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the words with a count of at least LEAST that are not among the frequent ones, their groups and their counts."""
    held = counts.sparkSession.sparkContext.broadcast(set(frequent))

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            at = [i for i, w in enumerate(words) if w not in held.value]
            yield pa.RecordBatch.from_arrays([pa.array(hashes([words[i] for i in at])), pa.array([group_of(words[i]) for i in at], pa.int16()), batch.column(1).take(pa.array(at, pa.int64()))], ["h", "g", "c"])

    t = counts.filter(F.col("c") >= LEAST).select("word", "c").mapInArrow(run, "h bigint, g smallint, c bigint").toArrow()
    held.unpersist()
    h, first = np.unique(t.column("h").to_numpy(), return_index=True)
    return h, t.column("g").to_numpy()[first].astype(np.int64), t.column("c").to_numpy()[first]


def contexts(units: DataFrame, n_grown: int, class_of: np.ndarray) -> DataFrame:
    """k, x: for SPAN grown words from k * SPAN on, int32 [SPAN, 2 * CLASSES] of how often each class stands after and before them."""
    held = units.sparkSession.sparkContext.broadcast(class_of.astype(np.uint8))
    wide = 2 * CLASSES

    def gather(batches):
        own = held.value
        for ids in _rows(batches):
            at = np.flatnonzero(ids >= UNITS)
            place, near = (ids[at].astype(np.int64) - UNITS) * wide, own[ids]
            keys, n = np.unique(np.concatenate([place + near[at + 1], place + CLASSES + near[at - 1]]), return_counts=True)
            ks, starts = np.unique(keys // (SPAN * wide), return_index=True)
            for k, a, b in zip(ks.tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]):
                part = keys[a:b] - k * SPAN * wide
                coded = zlib.compress(np.diff(part, prepend=0).astype(np.int32).tobytes() + n[a:b].astype(np.int32).tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([coded], pa.binary())], ["k", "x"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, coded in zip(*(c.to_pylist() for c in batch.columns)):
                steps, n = np.frombuffer(zlib.decompress(coded), np.int32).reshape(2, -1)
                if k not in sums:
                    sums[k] = np.zeros(SPAN * wide, np.int32)
                sums[k][np.cumsum(steps)] += n
        for k, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["k", "x"])

    slices = -(-n_grown // SPAN)
    return stored(units.mapInArrow(gather, "k int, x binary").repartition(slices, "k").mapInArrow(add, "k int, x binary"), "lm-contexts")


def place(table: DataFrame, of: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, int]:
    """The classes of the grown words, from the classes they begin with and the class bigrams m, and the number of sweeps.

    All words go at once to the class under which their neighbours are likeliest, then the classes' neighbours are counted
    anew; neither step lowers the likelihood of the neighbours, so the sweeps end."""
    sc = table.sparkSession.sparkContext
    both = np.concatenate([m, m.T], axis=1)  # by class: the classes after, the classes before
    of = of.astype(np.uint8)
    for sweep in count(1):
        after, before = both[:, :CLASSES] + ADD, both[:, CLASSES:] + ADD
        fit = np.log(np.concatenate([after / after.sum(axis=1, keepdims=True), before / before.sum(axis=1, keepdims=True)], axis=1)).T
        fit[:, 0] = -1e9  # the end's own class
        held = sc.broadcast((of, fit))

        def step(batches):
            of, fit = held.value
            change, moved = np.zeros((CLASSES, 2 * CLASSES)), 0
            for batch in batches:
                for k, coded in zip(*(c.to_pylist() for c in batch.columns)):
                    old = of[k * SPAN : (k + 1) * SPAN]
                    x = np.frombuffer(zlib.decompress(coded), np.int32).reshape(SPAN, -1)[: len(old)].astype(float)
                    score = x @ fit
                    new, rows = score.argmax(axis=1).astype(np.uint8), np.arange(len(old))
                    go = np.flatnonzero(score[rows, new] > score[rows, old] * (1 - 1e-11) + 1e-9)
                    if len(go):
                        np.add.at(change, new[go], x[go])
                        np.subtract.at(change, old[go], x[go])
                        moved += len(go)
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([go.astype(np.int32).tobytes()], pa.binary()), pa.array([new[go].tobytes()], pa.binary())], ["k", "at", "new"])
            if moved:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([b""], pa.binary()), pa.array([change.tobytes()], pa.binary())], ["k", "at", "new"])

        rows = table.mapInArrow(step, "k int, at binary, new binary").collect()
        held.destroy()
        if not rows:
            return of.astype(np.int64), sweep
        of, both = of.copy(), both.copy()
        for r in rows:
            if r.k < 0:
                both += np.frombuffer(r.new).reshape(CLASSES, -1)
            else:
                of[r.k * SPAN + np.frombuffer(r.at, np.int32)] = np.frombuffer(r.new, np.uint8)
        np.maximum(both, 0, out=both)


def class_pairs(units: DataFrame, class_of: np.ndarray) -> np.ndarray:
    """[CLASSES, CLASSES] counts of neighbouring classes."""
    held = units.sparkSession.sparkContext.broadcast(class_of.astype(np.uint8))

    def run(batches):
        own = held.value
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for ids in _rows(batches):
            c = own[ids].astype(np.int64)
            total += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = units.mapInArrow(run, "m binary").collect()
    held.destroy()
    return sum((np.frombuffer(r.m, np.int64) for r in parts), np.zeros(CLASSES * CLASSES, np.int64)).reshape(CLASSES, CLASSES).astype(float)


@dataclass
class BrownModel:
    frequent: list[bytes]
    #: Sorted hashes of the further words with units of their own.
    grown: np.ndarray
    class_of: np.ndarray
    #: log10(transition / mass of the class after) by class before, class after.
    gain: np.ndarray
    #: log10 u of each frequent word (by place), of the end, and of a word that training doesn't have.
    frequent_score: np.ndarray
    end_score: float
    unknown_score: float
    #: log10 u of each further word.
    grown_score: np.ndarray
    tokens: int
    types: int
    #: Table (word, c) of all training words.
    counts: DataFrame

    def log_u(self, c):
        return F.log10((c + F.lit(ADD)) / F.lit(self.tokens + ADD * (self.types + 1)))


def train(docs: DataFrame, text_col: str = "text") -> BrownModel:
    """Learns from all rows of docs. Null and empty texts are just an end; a corpus without rows gives a model that knows no token."""
    raw = docs.select(text_bytes(text_col).alias("raw"))
    counts = stored(count_words(raw), "word-counts")
    n_docs = docs.count()
    n_words, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, types = n_words + n_docs, n_types + bool(n_docs)
    best = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    frequent = [bytes(r.word) for r in best]
    grown, group, grown_count = grown_words(counts, frequent)
    units = encoded(raw, frequent, grown)
    pairs = pair_counts(units, group)
    pairs[END, END] = max(0.0, pairs[END, END])
    class_of = exchange(pairs)
    m = np.zeros((CLASSES, CLASSES))
    np.add.at(m, (class_of[:, None].repeat(UNITS, 1).ravel(), np.tile(class_of, UNITS)), pairs.ravel())
    del pairs
    if len(grown):
        first = class_of[group]
        near = contexts(units, len(grown), np.append(class_of, first))
        placed, _ = place(near, first, m)
        discard(near)
        class_of = np.append(class_of, placed)
        m = class_pairs(units, class_of)
    discard(units)
    held = docs.sparkSession.sparkContext.broadcast((frequent, grown, class_of.astype(np.uint8)))

    def by_class(batches):
        frequent, grown, own = held.value
        unit = UnitOf(frequent, grown)
        for batch in batches:
            words = batch.column(0).to_pylist()
            k = own[unit.of(words)]
            c = batch.column(1).to_numpy()
            found = np.unique(k)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.bincount(k, c, CLASSES)[found].astype(np.int64)), pa.array(np.bincount(k, minlength=CLASSES)[found])], ["k", "c", "n"])

    whole = tokens + ADD * (types + 1)
    mass = np.full(CLASSES, ADD / whole)  # a word that training doesn't have can be of any class
    for r in counts.mapInArrow(by_class, "k bigint, c bigint, n bigint").groupBy("k").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect():
        mass[r.k] += (r.c + ADD * r.n) / whole
    end_u = (n_docs + ADD) / whole
    mass[class_of[END]] += end_u if n_docs else 0
    share = mass / mass.sum()
    transition = (m + PRIOR * share[None, :]) / (m.sum(axis=1, keepdims=True) + PRIOR)
    score = np.log10((np.array([r.c for r in best], float) + ADD) / whole)
    return BrownModel(frequent, grown, class_of, np.log10(transition / mass[None, :]), score, float(np.log10(end_u)) if n_docs else float(np.log10(ADD / whole)), float(np.log10(ADD / whole)), np.log10((grown_count + ADD) / whole), tokens, types, counts)


def score_documents(docs: DataFrame, model: BrownModel, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, carry..., n_tokens, n_known, base_score, score, perplexity for every row of docs, from whole texts.

    Null and empty texts are an end; repeated rows are scored each (rows are told apart by where they were stored, not by
    id); an empty table gives an empty table; other columns are not read."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.frequent, model.grown, model.class_of.astype(np.uint8), model.gain, model.frequent_score, model.grown_score, model.end_score))
    has_end = model.tokens > 0
    kinds = dict(docs.dtypes)
    kept = "".join(f"`{c}` {kinds[c]}, " for c in (id_col, *carry))

    def run(batches):
        frequent, grown, class_of, gain, frequent_score, grown_score, end_score = held.value
        unit, n_frequent = UnitOf(frequent, grown), len(frequent)
        row = TaskContext.get().partitionId() << 40
        padded = np.concatenate([frequent_score, np.zeros(UNITS - n_frequent), grown_score])
        padded[END] = end_score
        for batch in batches:
            n, known, base, gains, rare_words, rare_n, offsets = [], [], [], [], [], [], [0]
            for texts in _texts([batch]):
                ids, ends = unit.of_texts(texts)
                starts = np.append(0, ends[:-1] + 1)
                own = class_of[ids]
                rare_at = np.flatnonzero((ids >= n_frequent) & (ids < END))  # known by their group alone
                of = ends.searchsorted(rare_at)
                n.append(ends - starts + 1)
                known.append(ends - starts + has_end - np.bincount(of, minlength=len(texts)))
                base.append(np.add.reduceat(padded[ids], starts))
                gains.append(np.add.reduceat(gain[np.append(class_of[END], own[:-1]), own], starts))
                bounds = of.searchsorted(np.arange(len(texts) + 1)).tolist()
                places = (rare_at - starts[of]).tolist()
                for words, a, b in zip(texts, bounds, bounds[1:]):
                    if a < b:
                        rare = Counter([words[i] for i in places[a:b]])
                        rare_words += rare.keys()
                        rare_n += rare.values()
                    offsets.append(len(rare_words))
            n, known, base, gains = (np.concatenate(x) if x else np.zeros(0) for x in (n, known, base, gains))
            at = np.arange(row, row + len(n))
            row += len(n)
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, t)) for v, t in ((rare_words, pa.binary()), (rare_n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(at), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(gains, pa.float64()), *lists], names)

    names = [id_col, *carry, "row", "n_tokens", "known", "base", "gain", "words", "times"]
    rows = docs.select(text_bytes(text_col).alias("raw"), id_col, *carry).mapInArrow(run, f"{kept}row bigint, n_tokens bigint, known bigint, base double, gain double, words array<binary>, times array<int>")
    rows = stored(rows, "lm-rows")
    met = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", F.col("r.words").alias("word"), F.col("r.times").alias("times"))
    met = met.join(model.counts.filter(F.col("c") < LEAST), "word", "left")  # all words with more have been met above
    c = F.coalesce("c", F.lit(0))
    rare = met.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * model.log_u(c)).alias("rare_base"))
    out = rows.drop("words", "times").join(rare, "row", "left")
    base_score = F.col("base") + F.coalesce("rare_base", F.lit(0.0))
    score = base_score + F.col("gain")
    return out.select(id_col, *carry, "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), base_score.alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
