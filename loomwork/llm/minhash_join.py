"""MinHash near-duplicates by a multi-index Hamming join.

A distinct set of shingles has a signature of SYMBOLS minima, BITS bits each. Two signatures' distance is the number of
symbols that differ. Signatures are cut into CHUNKS chunks and each chunk is allowed a number of errors, so many that the
numbers, one added to each, exceed the distance looked at: then a pair within the distance has a chunk with no more
errors than it is allowed (pigeonhole). Errors are enumerated by leaving out each set of so many symbols of a chunk in
turn: two signatures with such a chunk share a key (chunk, places left out, other symbols). So all pairs
within the distance share a key; links are confirmed on full sets.

No group becomes all its pairs:
1. equal sets become one node;
2. in each key's bucket each node is held against the bucket's least node, and confirmed links make components;
3. only buckets that still hold several components are searched further. In each, chains of pairs
   within the signature distance make trees, whose links (fewer than nodes) make families; a family's sets meet once,
   and pairs of different components within the distance are confirmed on them, in memory. Only links that
   join two components leave a task. Large buckets and families are cut into parts, each pair of parts a task of its own.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import NULL_ID, discard, stored, text_bytes
from loomwork.llm.components import components
from loomwork.llm.simhash import WordHash, _mixed

SYMBOLS, BITS, CHUNKS = 60, 16, 12
WIDE = SYMBOLS // CHUNKS
#: The least distance looked at: one error in each chunk. (At a similarity of 0.8 the mean distance is 12, the deviation 3.1.)
GUARANTEED = CHUNKS * 2 - 1
#: A pair at the threshold is farther than the distance looked at with this probability, at most.
MISS = 1e-7
#: Rows of a bucket's part; rows and bytes of shingle sets of a family's part.
BLOCK, BLOCK_ROWS, BLOCK_BYTES = 4096, 1024, 16_000_000
#: Node ids up to this number are broadcast (8 MB at most); more go through a shuffle join.
MOST_BROADCAST = 1_000_000

_rng = np.random.default_rng(8)
_A = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(16)], np.uint64)


def shingle_set(raw: bytes, words: WordHash, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of words (A-Z lower-cased); fewer words make one shingle."""
    tokens = raw.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    x = np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens))
    n = min(width, len(x))
    out = np.full(len(x) - n + 1, n, np.uint64)
    for k in range(n):
        out += _mixed(x[k : len(x) - n + 1 + k] + _POWERS[k]) * _POWERS[k + 1]
    return np.unique(_mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, 2**64 - 1, np.uint64)
    for lo in range(0, len(shingles), 1024):
        part = shingles[lo : lo + 1024]
        least = np.minimum(least, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1))
    return (_mixed(least) >> np.uint64(64 - BITS)).astype(np.uint16)


def distance_for(percent: int) -> int:
    """The distance to look at for a similarity: GUARANTEED, or more if MISS asks for it."""
    p, far = 1 - percent / 100, 1.0
    for d in range(SYMBOLS + 1):
        far -= math.comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
        if far <= MISS:
            return max(d, GUARANTEED)
    return SYMBOLS


def allowed_errors(most: int) -> list[int]:
    """Errors allowed in each chunk, so that all pairs up to the distance most have a chunk with no more."""
    every, more = divmod(max(most, GUARANTEED) + 1, CHUNKS)
    return [min(WIDE - 1, every - 1 + (k < more)) for k in range(CHUNKS)]


def chunk_keys(sig: np.ndarray, most: int = GUARANTEED) -> np.ndarray:
    """[n, keys] of [n, SYMBOLS] signatures: one for each chunk and set of places left out."""
    mixed = _mixed((sig.reshape(-1, CHUNKS, WIDE).astype(np.uint64) + np.uint64(1)) * _POWERS[1 : WIDE + 1])
    out, n = [], 0
    for k, errors in enumerate(allowed_errors(most)):
        for left in combinations(range(WIDE), errors):
            n += 1
            kept = [i for i in range(WIDE) if i not in left]
            out.append(_mixed(mixed[:, k, kept].sum(axis=1, dtype=np.uint64) + _mixed(np.array([n], np.uint64))))
    return np.stack(out, axis=1).view(np.int64)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id (null: NULL_ID), given (as it is), raw."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(id_col).alias("given"), text_bytes(text_col).alias("raw"))


def _profiles(docs: DataFrame, width: int) -> DataFrame:
    """id, given, n, digest, sig for each row of docs (id, given, raw)."""

    def run(batches):
        words = WordHash()
        for batch in batches:
            n, digests, sigs = [], [], []
            for raw in batch.column(2).to_pylist():
                s = shingle_set(raw, words, width)
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["id", "given", "n", "digest", "sig"])

    return docs.select("id", "given", "raw").mapInArrow(run, f"id bigint, given {dict(docs.dtypes)['given']}, n bigint, digest binary, sig binary")


def _keys(nodes: DataFrame, most: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = chunk_keys(_signatures(batch.column(1)), most)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def _grouped(n_marks: int, work):
    """Streams rows sorted by their first n_marks columns; work gets the rows of one group after the other, as a table."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        mark = None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(k).to_numpy() for k in range(n_marks)]
            cuts = (np.flatnonzero(np.logical_or.reduce([m[1:] != m[:-1] for m in marks])) + 1).tolist()
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
                now = tuple(m[lo] for m in marks)
                if held and now != mark:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
                mark = now
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """[len(a), len(b)] whether the distance is at most most."""
    out = np.empty((len(a), len(b)), bool)
    step = max(1, 4_000_000 // (SYMBOLS * max(1, len(b))))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = (a[lo : lo + step, None, :] != b[None, :, :]).sum(axis=2, dtype=np.uint8) <= most
    return out


def _forests(most: int):
    """For each part of a bucket (key, i, j, side, node, comp, sig): links that connect all nodes which chains of close pairs
    connect, at most one less than nodes, and only where several components are connected."""

    def work(rows: pa.Table):
        node, comp = rows.column(4).to_numpy(), rows.column(5).to_numpy()
        if len(node) < 2 or (comp == comp[0]).all():
            return
        close = _near(sig := _signatures(rows.column(6)), sig, most)
        left, a, b = np.ones(len(node), bool), [], []
        for start in range(len(node)):
            if not left[start]:
                continue
            left[start], tree, queue, comps = False, [], [start], {comp[start]}
            while queue:
                u = queue.pop()
                fresh = np.flatnonzero(close[u] & left)
                left[fresh] = False
                queue += fresh.tolist()
                comps.update(comp[fresh].tolist())
                tree += [(u, v) for v in fresh.tolist()]
            if len(comps) > 1:
                a += [node[u] for u, _ in tree]
                b += [node[v] for _, v in tree]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _grouped(3, work)


def _links_within(most: int, percent: int):
    """For each pair of parts of a family (family, i, j, side, node, comp, sig, shingles): links confirmed on full sets, only
    those that join components that nothing before has joined. side 0: both parts are one; 1 and 2: the first and second."""

    def work(rows: pa.Table):
        side, node, comp = (rows.column(k).to_numpy() for k in (3, 4, 5))
        names, root = np.unique(comp, return_inverse=True)
        if len(names) < 2:
            return
        sig = _signatures(rows.column(6))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column(7).to_pylist()]
        size = np.array([len(x) for x in sets])
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(size)))
        first, second = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
        marked = np.zeros(int(flat.max()) + 1, bool)
        a, b = [], []
        for x in first.tolist():
            others = second[(root[second] != root[x]) & (100 * np.minimum(size[second], size[x]) >= percent * np.maximum(size[second], size[x]))]
            if len(others):
                others = others[(sig[others] != sig[x]).sum(axis=1) <= most]
            if not len(others):
                continue
            own = flat[starts[x] : starts[x + 1]]
            marked[own] = True
            at = np.concatenate([np.arange(starts[o], starts[o + 1]) for o in others.tolist()])
            shared = np.add.reduceat(marked[flat[at]].astype(np.int64), np.concatenate(([0], np.cumsum(size[others])[:-1])))
            marked[own] = False
            for y in others[100 * shared >= percent * (size[x] + size[others] - shared)].tolist():
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    a.append(node[x])
                    b.append(node[y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _grouped(3, work)


def _parted(rows: DataFrame) -> DataFrame:
    """Rows with blocks: each row goes to the pairs of blocks that its own is part of, as i, j, side."""
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j"), F.when(o == F.col("own"), 0).when(F.col("own") < o, 1).otherwise(2).alias("side")))
    return rows.withColumn("t", F.explode(to))


def _shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """id, shingles of the documents (id, raw) in wanted (id). Only their texts move."""
    few = wanted.count() <= MOST_BROADCAST
    texts = docs.select("id", "raw").join(F.broadcast(wanted) if few else wanted, "id", "left_semi")

    def sets(batches):
        words = WordHash()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(raw, words, width).tobytes() for raw in batch.column(1).to_pylist()], pa.binary())], ["id", "shingles"])

    return stored(texts.mapInArrow(sets, "id bigint, shingles binary").filter(F.octet_length("shingles") > 0).distinct(), "shingle-sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    wanted = stored(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    full = _shingle_sets(docs, wanted, width)

    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                least, all_ = min(len(x), len(y)), len(x) + len(y)
                if 100 * least < percent * (all_ - least):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (all_ - shared))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    both = pairs.hint("merge").join(full.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").hint("merge").join(full.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    out = stored(both.select("a", "b", "x", "y").mapInArrow(verify, "a bigint, b bigint").distinct(), "confirmed")
    discard(full, wanted)
    return out


def _close(pairs: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """Pairs whose signatures are within the distance."""
    def far(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
                mask = pa.array((x != y).sum(axis=1) <= most)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    sig = nodes.select("node", "sig")
    both = pairs.hint("merge").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").hint("merge").join(sig.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(far, "a bigint, b bigint")


def _linked(docs: DataFrame, percent: int, width: int, most_distance: int | None, block: int, block_rows: int, block_bytes: int) -> DataFrame:
    """id, given, n, component for each row of docs (id, given, raw). Rows that share an id are one document."""
    most = distance_for(percent) if most_distance is None else most_distance
    profiles = stored(_profiles(docs, width), "profiles")
    nodes = stored(profiles.filter("n > 0").groupBy("digest").agg(F.min("id").alias("node"), F.first("sig").alias("sig")), "nodes")
    rows = stored(profiles.drop("sig").hint("merge").join(nodes.select("digest", "node"), "digest", "left").drop("digest"), "rows")
    discard(profiles)
    keys = _keys(nodes, most)
    buckets = stored(keys.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count(F.lit(1)).alias("size")).filter("a < b"), "buckets")
    members = stored(keys.hint("merge").join(buckets.filter("size > 2").select("key", "a"), "key"), "members")
    stars = buckets.filter("size = 2").select("a", "b").unionByName(members.filter("node <> a").select("a", F.col("node").alias("b"))).distinct()
    near = stored(_close(stars, nodes, most), "stars")
    links = _confirmed(near, docs, percent, width)
    discard(buckets, near)
    # a document whose rows have several texts ties their sets together
    several = stored(rows.filter("n > 0").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b"), "several")
    all_links = links
    if several.limit(1).count():
        all_links = links.unionByName(rows.hint("merge").join(several.select("id", "a"), "id").filter("node <> a").select("a", F.col("node").alias("b")))
    first = components(all_links)
    # buckets that still hold several components
    placed = stored(members.hint("merge").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp")), "placed")
    discard(members)
    open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo < hi").select("key", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    open_ = stored(open_, "open")
    final, done = first, not open_.limit(1).count()
    if not done:
        parts = _parted(placed.hint("merge").join(open_, "key").hint("merge").join(nodes.select("node", "sig"), "node")).select("key", "t.i", "t.j", "t.side", "node", "comp", "sig")
        forest = stored(parts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_forests(most), "a bigint, b bigint").distinct(), "forest")
        done = not forest.limit(1).count()
    if not done:
        family = components(forest).select("node", F.col("component").alias("family"))
        sets = _shingle_sets(docs, family.select(F.col("node").alias("id")), width)
        own = family.hint("merge").join(first, "node", "left").select("node", "family", F.coalesce("component", "node").alias("comp"))
        own = stored(own.hint("merge").join(nodes.select("node", "sig"), "node").hint("merge").join(sets.withColumnRenamed("id", "node"), "node"), "family-sets")
        sizes = own.groupBy("family").agg(F.greatest(F.ceil(F.sum(F.octet_length("shingles")) / block_bytes), F.ceil(F.count(F.lit(1)) / block_rows)).cast("int").alias("blocks"))
        sizes = stored(sizes, "family-sizes")  # a table on either side of the join: Spark splits a large family
        parts = _parted(own.hint("merge").join(sizes, "family")).select("family", "t.i", "t.j", "t.side", "node", "comp", "sig", "shingles")
        late = stored(parts.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(_links_within(most, percent), "a bigint, b bigint").distinct(), "late-links")
        if late.limit(1).count():
            final = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))
        discard(family, sets, own, sizes, forest, late)
    whole = rows.hint("merge").join(final, "node", "left")
    out = stored(whole.select("id", "given", "n", F.coalesce("component", "node", "id").alias("component")), "near-duplicates")
    discard(nodes, rows, links, several, first, placed, open_, final)
    return out


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, most_distance: int | None = None, block: int = BLOCK, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept, one row per row of docs.

    Links: 100 * intersection >= percent * union of the sets of width-word shingles. All pairs within most_distance
    differing symbols (distance_for(percent) unless given: a pair at the threshold is farther with a probability of 1e-7)
    become candidates, and every candidate is confirmed on full sets. component_id: the least id reachable.
    Texts without words are linked with nothing. Rows that share an id are one document: their links are joined. Null ids
    are one document, less than all others (component_id null). Repeated rows are returned each;
    empty tables give empty tables; other columns are not read."""
    linked = _linked(_prepared(docs, id_col, text_col), percent, width, most_distance, block, block_rows, block_bytes)
    component = F.col("component")
    return linked.select(F.col("given").alias(id_col), F.col("n").alias("n_shingles"), F.when(component != NULL_ID, component).alias("component_id"), (component == F.col("id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without all but one of each group of near-duplicates, all columns as they are.

    Groups are of rows, not of ids: rows with one id and unlike texts are different documents here, and a null id is like any other. Of a
    group the row with the least id stays (null first), of rows with equal ids and texts the one whose other columns are least.
    Texts without words stay, each row. Ids and texts are told apart by a hash of 64 bits. Empty tables give empty tables."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    renamed = docs.toDF(*names)
    key = F.xxhash64(F.col(own), F.coalesce(text, F.lit("")))
    rows = _linked(renamed.select(key.alias("id"), F.col(own).cast("long").alias("given"), text_bytes(text).alias("raw")), percent, width, None, BLOCK, BLOCK_ROWS, BLOCK_BYTES).filter("n > 0")
    stay = stored(rows.groupBy("component").agg(F.min(F.struct("given", "id")).alias("first")).select(F.col("first.id").alias("id")), "stay")
    gone = rows.select("id").distinct().hint("merge").join(stay, "id", "left_anti")
    again = stored(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").hint("merge").join(stay, "id", "left_semi").select("id"), "again")
    left = renamed.withColumn("id", key).join(gone, "id", "left_anti")
    if again.limit(1).count():
        once = left.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct(*names)).alias("row")).select("row.*")
        left = left.join(again, "id", "left_anti").select(*names).unionByName(once)
    return left.select(*names).toDF(*docs.columns)
