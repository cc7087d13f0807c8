"""Line dedup: range-partitioned line hashes, streamed in order of document and position.

Lines become (128-bit hash of the key, document, position) rows, dealt out by range of hash *and*
document: a line that a third of all documents hold is spread over many tasks. Each task streams
its sorted rows, counts distinct documents per hash and gives back only the places of lines to
drop; it holds the rows of at most min_docs - 1 documents of a line. A hash that is cut by the
border of two tasks is settled afterwards from the counts at the borders (two per task at most).
Places become one compressed bitmap of kept lines per document; texts move once, to meet theirs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import NULL_ID, stored

_PLACE = "h1 bigint, h2 bigint, doc bigint, body bigint, pos int, n_lines int"


def _keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row is known by its id and a hash of its text: repeated rows are alike, rows that share an id aren't mixed up."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("body"), text.alias("text"), F.col(id_col).alias("given_id"), F.struct(*carry).alias("carried") if carry else F.lit(None).cast("int").alias("carried"))


def _line_hashes(batches):
    """(128-bit hash of the key, document, position) of each line with a key. bytes.strip() and lower() know ASCII only."""
    import xxhash

    for batch in batches:
        digests, at, pos, sizes = [], [], [], []
        for i, raw in enumerate(batch.column(2).to_pylist()):
            lines = raw.split(b"\n")
            sizes.append(len(lines))
            keys = [(k, key) for k, line in enumerate(lines) if (key := line.strip())]
            digests += [xxhash.xxh3_128_digest(key.lower()) for _, key in keys]
            pos += [k for k, _ in keys]
            at += [i] * len(keys)
        h, at = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.array(at, np.int64)
        doc, body = (batch.column(k).to_numpy()[at] for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[:, 0], h[:, 1], doc, body, np.array(pos, np.int32), np.array(sizes, np.int32)[at])], ["h1", "h2", "doc", "body", "pos", "n_lines"])


def _stream(min_docs: int):
    """Streams rows sorted by hash, document, position. kind 0: drop this line. kind 1: drop it if its hash
    is found common. kind 2: documents counted here for a hash that other tasks may hold too."""
    names = ["h1", "h2", "doc", "body", "pos", "n_lines"]

    def run(batches):
        key = last_doc = None
        held: list[list[np.ndarray]] = []  # rows of the current hash while it has less than min_docs documents
        count, held_rows, first, spilled = 0, 0, True, False

        def out(kind, rows, n_docs=0):
            size = len(rows[0])
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *(pa.array(c) for c in rows), pa.array(np.full(size, n_docs, np.int64))], ["kind", *names, "n_docs"])

        def flush(kind):
            nonlocal held, held_rows
            if held:
                yield out(kind, [np.concatenate(c) for c in zip(*held)])
            held, held_rows = [], 0

        def end(last=False):
            if first or last or spilled:
                yield from flush(1)
                yield out(2, [np.array([v], t) for v, t in zip((*key, 0, 0, 0, 0), (np.int64,) * 4 + (np.int32,) * 2)], count)
            else:
                yield from flush(0 if count >= min_docs else -1)

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            h1, h2, doc = cols[:3]
            new = np.ones(len(h1), bool)
            new[0] = key is None or (h1[0], h2[0]) != key
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            fresh = new.copy()  # rows that begin a document of their hash
            fresh[0] |= doc[0] != last_doc
            fresh[1:] |= doc[1:] != doc[:-1]
            last_doc = doc[-1]
            starts = np.union1d([0], np.flatnonzero(new))
            docs = np.add.reduceat(fresh.astype(np.int64), starts)
            bounds = np.append(starts, len(h1))
            inner = np.ones(len(starts), bool)
            inner[[0, -1]] = False  # hashes that begin and end within the batch
            common = np.repeat(inner & (docs >= min_docs), np.diff(bounds))
            if common.any():
                yield out(0, [c[common] for c in cols])
            for k in sorted({0, len(starts) - 1}):
                lo, hi = bounds[k], bounds[k + 1]
                if new[lo]:
                    if key is not None:
                        for rows in end():
                            yield rows
                        first = False
                    key, count, spilled = (h1[lo], h2[lo]), 0, False
                if k and len(starts) > 2:
                    first = False
                count += int(docs[k])
                held.append([c[lo:hi] for c in cols])
                held_rows += hi - lo
                if count >= min_docs:
                    yield from flush(0)
                elif held_rows > 65536:  # few documents, very many lines
                    yield from flush(1)
                    spilled = True
        if key is not None:
            yield from end(last=True)

    def without_empty(batches):
        for rows in run(batches):
            if rows.num_rows and rows.column(0)[0].as_py() >= 0:
                yield rows

    return without_empty


def line_keep_bitmaps(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """doc, body, n_lines int, keep binary for each document that loses lines.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys of at least one
    code point found in at least min_docs documents lose all their lines. keep: zlib of a bitmap
    with 1 for lines that stay, in order. Documents are known by id: rows that share an id count
    once; null ids count as one document. Null and empty texts are one empty line, which always stays."""
    spark = docs.sparkSession
    places = _keyed(docs, id_col, text_col).select("doc", "body", F.col("text").cast("binary").alias("raw")).mapInArrow(_line_hashes, _PLACE)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = places.repartitionByRange(n, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "body", "pos")
    found = stored(dealt.mapInArrow(_stream(min_docs), f"kind int, {_PLACE}, n_docs bigint"), "line-places")
    # at most two rows a task, and one for each hash with over 65,536 lines in a few documents
    bordering = found.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).filter(F.col("n") >= min_docs)
    late = found.filter("kind = 1").join(bordering.select("h1", "h2"), ["h1", "h2"], "left_semi")
    drops = found.filter("kind = 0").select("doc", "body", "n_lines", "pos").unionByName(late.select("doc", "body", "n_lines", "pos"))
    per_doc = drops.groupBy("doc", "body", "n_lines").agg(F.collect_list("pos").alias("gone"))

    def pack(batches):
        for batch in batches:
            bitmaps = []
            for n_lines, gone in zip(batch.column(2).to_pylist(), batch.column(3)):
                keep = np.ones(n_lines, bool)
                keep[gone.values.to_numpy(zero_copy_only=False)] = False
                bitmaps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bitmaps, pa.binary())], ["doc", "body", "n_lines", "keep"])

    return per_doc.mapInArrow(pack, "doc bigint, body bigint, n_lines int, keep binary")


def apply_keep_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id_col, carry..., kept_text, n_lines, n_dropped for every row of docs: the lines that stay, joined by newlines."""
    kind = dict(docs.dtypes)[id_col]
    both = _keyed(docs, id_col, text_col, carry).join(bitmaps.drop("n_lines"), ["doc", "body"], "left").select(F.col("given_id").alias(id_col), "text", "keep", "carried")

    def run(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = text.split("\n")
                n_lines.append(len(lines))
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                    lines = [lines[i] for i in np.flatnonzero(bits).tolist()]
                texts.append("\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [id_col, "carried", "kept_text", "n_lines", "n_dropped"])

    out = both.mapInArrow(run, f"`{id_col}` {kind}, carried {dict(both.dtypes)['carried']}, kept_text string, n_lines bigint, n_dropped bigint")
    return out.select(id_col, *(F.col(f"carried.`{c}`").alias(c) for c in carry), "kept_text", "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line dedup of every whole text: one row per row of docs, see apply_keep_bitmaps.

    Empty tables give empty tables; repeated rows are treated alike and each returned; other columns
    are not read."""
    return apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_docs, id_col, text_col), id_col, text_col)
