"""Byte-level BPE by monoid tree reduction.

Two monoids are reduced as balanced trees:

* pieces: a text's matches of the splitting pattern. A half is matched by itself; joining two
  neighbours re-matches a window from the last matches of the left half that could not have seen
  what follows, into the right half, until a match ends where a match of the right half begins.
  Matching from a place depends only on what comes after it, so all later matches stand.
* tokens: a piece's byte-pair tokens. A sequence of tokens is the encoding of its bytes if and only
  if each neighbouring pair is the encoding of its own bytes. Joining re-encodes a growing window
  around the boundary until the pairs at the window's two edges are such pairs: then all tokens
  outside stand.

Decoding concatenates bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import text_bytes

#: Longest look-ahead of the pattern behind the end of a match ('re: two more characters).
LOOK_AHEAD = 2


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class _Pieces(dict):
    """Ids by piece. Emptied when full: it saves time and never changes results."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        return ids


class TreeBpe:
    """Encodes and decodes by ranks. leaf_chars, leaf_bytes: halves up to these sizes are leaves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = 8192, leaf_bytes: int = 24, cached: int = 400_000):
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.find = regex.compile(pattern).findall
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache = _Pieces(self.encode_piece, cached)

    # -- tokens of one piece -------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """The lowest rank first, the leftmost of equal ones first."""
        if len(data) > 64:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        n, ranks = len(data), self.ranks
        end = list(range(1, n + 1))  # of the part that begins here; 0: no part begins here
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stands(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        back = ahead = 1
        while True:
            a, b = max(0, len(left) - back), min(len(right), ahead)
            window = self.merge(b"".join(self.bytes_of[t] for t in chain(left[a:], right[:b])))
            left_stands = a == 0 or self.stands(left[a - 1], window[0])
            right_stands = b == len(right) or self.stands(window[-1], right[b])
            if left_stands and right_stands:
                return left[:a] + window + right[b:]
            back, ahead = back * (1 if left_stands else 2), ahead * (1 if right_stands else 2)

    def _tokens(self, data: bytes) -> list[int]:
        if len(data) <= self.leaf_bytes:
            return self.merge(data)
        half = len(data) // 2
        return self.join_tokens(self._tokens(data[:half]), self._tokens(data[half:]))

    def encode_piece(self, data: bytes) -> list[int]:
        """A piece that is itself a token is that token, whether or not merges lead to it."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._tokens(data)

    # -- pieces of a text ----------------------------------------------------------------------

    def join_pieces(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        keep, loose = len(left), 0
        while keep and loose < LOOK_AHEAD:
            keep -= 1
            loose += len(left[keep])
        tail, take = "".join(left[keep:]), 4
        while True:
            taken = right[:take]
            window = tail + "".join(taken)
            whole = take >= len(right)
            starts, at = {}, len(tail)
            for k, piece in enumerate(taken):
                starts[at] = k
                at += len(piece)
            at, fresh = 0, []
            for piece in self.find(window):
                if at in starts:
                    return left[:keep] + fresh + right[starts[at] :]
                at += len(piece)
                if not whole and at + LOOK_AHEAD > len(window):
                    break  # it has not seen enough of what follows
                fresh.append(piece)
            else:
                return left[:keep] + fresh + right[len(taken) :]
            take *= 2

    def pieces(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.find(text)
        half = len(text) // 2
        return self.join_pieces(self.pieces(text[:half]), self.pieces(text[half:]))

    # -- whole texts ---------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, self.pieces(text))))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 16384:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n_tokens, [token_ids,] ids_sha256, decoded_sha256.

    ids_sha256 digests the decimal ids joined by commas, decoded_sha256 the bytes decoded from the
    ids. with_ids=False leaves token_ids out, for callers that only need the digests. Null and
    empty texts have no tokens; repeated rows are encoded each; an empty table gives an empty
    table; other columns are not read. The ranks (one vocabulary file) go to executors as a broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast((ranks, pattern))
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        bpe = TreeBpe(*held.value)
        for batch in batches:
            n, ids_all, sums, decoded = [], [], [], []
            for raw in batch.column(1).to_pylist():
                ids = bpe.encode(raw.decode("utf-8", "replace"))
                n.append(len(ids))
                sums.append(hashlib.sha256(",".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    ids_all.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), *([pa.array(ids_all, pa.list_(pa.int32()))] if with_ids else []), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", *(["token_ids"] if with_ids else []), "ids_sha256", "decoded_sha256"]
    schema = f"`{id_col}` {kind}, n_tokens bigint, {'token_ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string"
    return docs.select(docs[id_col], text_bytes(text_col).alias("raw")).mapInArrow(run, schema)
