"""TIFF media columns: reading pages from TIFF bytes, and storing pixels or bytes as TIFF.

read_pages walks the chain of image directories, decodes each strip or tile (none, PackBits, LZW,
deflate), undoes horizontal differencing and puts the pieces together. Samples have 1, 8 or 16 bits. Sizes are
checked against the bytes there are before memory is taken, and no piece is unpacked beyond its pixels.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.common import text_bytes

#: Fixed values of the format: compressions, tags, sizes of field types.
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, FILL_ORDER, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 266, 322, 323, 324, 325
#: No compression makes more of a byte than this (LZW: codes of 12 bits for up to 4,094 bytes).
MOST_RATIO = 4096
#: What damaged bytes make of reading them.
DAMAGE = (struct.error, KeyError, IndexError, ValueError, OverflowError, ZeroDivisionError, TypeError, MemoryError)
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}


class TiffError(ValueError):
    """The bytes are not a TIFF that can be read."""


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more as runs, the rest as they are."""
    out, plain = bytearray(), bytearray()

    def put_plain():
        for i in range(0, len(plain), 128):
            part = plain[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        plain.clear()

    for value, run in groupby(data):
        n = sum(1 for _ in run)
        while n:
            take = min(n, 128)
            if take < 3:
                plain.extend(bytes([value]) * take)
            else:
                put_plain()
                out.append(257 - take)
                out.append(value)
            n -= take
    put_plain()
    return bytes(out)


def lzw_decode(data: bytes, most: int | None = None) -> bytes:
    """Most significant bit first, widths change one code early. Ends when there are most bytes."""
    out: list[bytes] = []
    made = 0
    entries: list[bytes] = []
    width, acc, bits, last = 9, 0, 0, None
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            entries, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            if code >= len(entries):
                raise TiffError("LZW data doesn't begin with a clear code")
            word = entries[code]
        else:
            if code < len(entries):
                word = entries[code]
            elif code == len(entries):
                word = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            entries.append(last + word[:1])
            if len(entries) + 1 >= 1 << width and width < 12:
                width += 1
        out.append(word)
        last = word
        made += len(word)
        if most is not None and made >= most:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 256, 9, 9
    table, n, word = {bytes([i]): i for i in range(256)}, 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        acc, bits = (acc << width) | table[word], bits + width
        table[longer] = n
        n += 1
        if n >= 1 << width and width < 12:
            width += 1
        if n >= 4094:
            acc, bits = (acc << width) | 256, bits + width
            table, n, width = {bytes([j]): j for j in range(256)}, 258, 9
        out += (acc >> (bits % 8)).to_bytes(bits // 8, "big")
        bits %= 8
        acc &= (1 << bits) - 1
        word = data[i : i + 1]
    if word:
        acc, bits = (acc << width) | table[word], bits + width
        n += 1
        if n >= 1 << width and width < 12:
            width += 1
    acc, bits = (acc << width) | 257, bits + width
    pad = -bits % 8
    return bytes(out + (acc << pad).to_bytes((bits + pad) // 8, "big"))


def _decompress(data: bytes, compression: int, most: int) -> bytes:
    """The first most bytes of a piece."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, max(most, 1))
        except zlib.error as e:
            raise TiffError(str(e)) from None
    if compression == LZW:
        return lzw_decode(data, most)
    if compression == PACKBITS:
        return unpack_bits(data)
    raise TiffError(f"compression {compression} is not supported")


def _directories(data: bytes, order: str) -> Iterator[dict[int, tuple]]:
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if (code := FIELDS.get(kind)) is None:
                continue
            size = struct.calcsize(order + code) * count
            place = at + 10 + 12 * k
            if size > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def walk_pages(data: bytes) -> Iterator[tuple[int, np.ndarray | None, int, int, str | None]]:
    """(page, pixels[height, width, samples], compression, bits, error) in order of the directories. A page that can't be decoded
    has no pixels and an error, and the walk goes on. TiffError if the bytes aren't a TIFF, or a directory can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise TiffError("no TIFF header")
        for page, tags in enumerate(_directories(data, order)):
            px = error = None
            try:
                px = _pixels(data, order, tags)
            except TiffError as e:
                error = str(e)
            except DAMAGE as e:
                error = f"{type(e).__name__}: {e}"
            yield page, px, (tags.get(COMPRESSION) or (NONE,))[0], (tags.get(BITS) or (1,))[0], error
    except TiffError:
        raise
    except DAMAGE as e:
        raise TiffError(f"{type(e).__name__}: {e}") from None


def read_pages(data: bytes) -> Iterator[tuple[int, np.ndarray, int]]:
    """(page, pixels[height, width, samples], compression) in order of the directories.
    TiffError at the first page that can't be decoded, or if the bytes aren't a TIFF."""
    for page, px, compression, _, error in walk_pages(data):
        if px is None:
            raise TiffError(error)
        yield page, px, compression


def _pixels(data: bytes, order: str, tags: dict[int, tuple]) -> np.ndarray:
    first = lambda tag, default=None: tags[tag][0] if default is None or tag in tags else default
    width, height, samples = first(WIDTH), first(HEIGHT), first(SAMPLES, 1)
    bits, compression, predictor, planar = first(BITS, 1), first(COMPRESSION, NONE), first(PREDICTOR, 1), first(PLANAR, 1)
    if len(set(tags.get(BITS, (1,)))) > 1 or bits not in (1, 8, 16) or predictor not in ((1,) if bits == 1 else (1, 2)):
        raise TiffError(f"{bits} bits a sample, predictor {predictor}")
    kind = np.dtype(order + "u2" if bits == 16 else "u1")
    tiled = TILE_OFFSETS in tags
    wide, high = (first(TILE_WIDTH), first(TILE_HEIGHT)) if tiled else (width, min(height, first(ROWS_PER_STRIP, height)))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    if min(width, height, samples, wide, high) < 1:
        raise TiffError("a size is 0")
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) != len(counts) or len(offsets) != across * down * planes:
        raise TiffError(f"{len(offsets)} offsets and {len(counts)} counts for {across * down * planes} strips or tiles")
    line = (wide * deep * bits + 7) // 8  # bytes of a row of a piece
    there = sum(max(0, min(count, len(data) - offset)) for offset, count in zip(offsets, counts))
    if max(height * width * samples * bits // 8, across * line * high if tiled else 0) > MOST_RATIO * there:
        raise TiffError(f"{height} x {width} x {samples} pixels can't be in {there} bytes")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        plane, place = divmod(k, across * down)
        y, x = place // across * high, place % across * wide
        rows = high if tiled else min(high, height - y)
        raw = _decompress(data[offset : offset + count], compression, rows * line)
        if len(raw) < rows * line:
            raise TiffError("a strip or tile is cut short")
        if bits == 1:
            lines = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
            block = np.unpackbits(lines, axis=1, bitorder="little" if first(FILL_ORDER, 1) == 2 else "big")[:, : wide * deep].reshape(rows, wide, deep)
        else:
            block = np.frombuffer(raw, kind, rows * wide * deep).reshape(rows, wide, deep).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = block[: height - y, : width - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane if planes > 1 else 0 : plane + 1 if planes > 1 else samples] = part
    return out


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 256, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """TIFF with a page for each array[height, width, samples] of uint8 or uint16; tile: (width, height)."""
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + bytes(4))
    link = 4
    encode = {NONE: bytes, DEFLATE: lambda d: zlib.compress(d, 1), LZW: lzw_encode, PACKBITS: pack_bits}[compression]
    for px in pages:
        height, width, samples = px.shape
        wide, high = tile or (width, min(rows_per_strip, height))
        offsets, counts = [], []
        for y in range(0, height, high):
            for x in range(0, width, wide):
                block = px[y : y + high, x : x + wide]
                if tile and block.shape[:2] != (high, wide):
                    block = np.pad(block, ((0, high - block.shape[0]), (0, wide - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                coded = encode(np.ascontiguousarray(block.astype(px.dtype.newbyteorder(order))).tobytes())
                offsets.append(len(out))
                counts.append(len(coded))
                out += coded
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * px.dtype.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples >= 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_WIDTH, 4, [wide]), (TILE_HEIGHT, 4, [high]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [high]), (STRIP_COUNTS, 4, counts)]
        entries = bytearray()
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"{order}{len(values)}{FIELDS[kind]}", *values)
            if len(packed) > 4:
                out += bytes(len(out) % 2)
                place, packed = len(out), packed
                out += packed
                packed = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        out += bytes(len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def tiff_pages(media: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """One row per page of each TIFF: id_col, page, width, height, samples, bits, compression, pixels, error.

    pixels: the samples row by row, little-endian; samples of 1 bit are a byte each. A page that cannot be decoded gives a row
    with its number, the reason in error and nulls elsewhere, and the pages after it follow. Nulls, bytes that are no TIFF and
    a chain of directories that breaks give such a row with page -1, after the pages that were read. Repeated rows give
    repeated pages, empty tables empty tables; other columns are not read."""
    kind = dict(media.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                key, rows = batch.column(0).slice(i, 1), []
                try:
                    for page, px, compression, bits, error in walk_pages(data or b""):
                        yield row(key, (page, None, None, None, None, None, None, error) if px is None else (page, px.shape[1], px.shape[0], px.shape[2], bits, compression, px.astype(px.dtype.newbyteorder("<")).tobytes(), None))
                except TiffError as e:
                    yield row(key, (-1, None, None, None, None, None, None, str(e)))
                del rows

    def row(key, values):
        kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([key, *(pa.array([v], t) for v, t in zip(values, kinds))], [id_col, "page", "width", "height", "samples", "bits", "compression", "pixels", "error"])

    return media.select(id_col, bytes_col).mapInArrow(run, f"`{id_col}` {kind}, page int, width int, height int, samples int, bits int, compression int, pixels binary, error string")


def bytes_to_tiff(payload: bytes, rows_per_page: int = 4096) -> bytes:
    """Bytes (a positive multiple of 192) as pages 64 pixels wide with 3 samples of 8 bits."""
    px = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3)
    return write_tiff([px[i : i + rows_per_page] for i in range(0, len(px), rows_per_page)])


def feature_of(pages: list[np.ndarray]) -> str:
    """Mean of each channel, and an 8 x 8 average hash of the brightness, over all pages as one picture."""
    px = np.concatenate(pages)
    light = px.sum(axis=2, dtype=np.int64)
    h = len(light)
    edges = np.arange(9) * h // 8 if h >= 8 else None
    rows = np.stack([light[edges[i] : edges[i + 1]].mean(axis=0) for i in range(8)]) if h >= 8 else light[np.arange(8) * h // 8].astype(float)
    cells = rows.reshape(8, 8, 8).mean(axis=2)
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    means = px.reshape(-1, 3).mean(axis=0)
    return f"{bits}:{':'.join(f'{m:.3f}' for m in means)}"


def texts_as_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Stores each whole text as a TIFF and reads it back: id_col, n_bytes, [media,] payload_bytes, payload_sha256,
    tail_crc32, media_bytes, media_sha256, feature.

    The payload is the UTF-8 bytes and spaces up to a positive multiple of 192 (null: empty text); all but n_bytes
    is computed from what was read back from the TIFF. Equal texts give equal values. Repeated rows are
    treated each; an empty table gives an empty table; other columns are not read."""
    kind = dict(docs.dtypes)[id_col]
    names = [id_col, "n_bytes", *(["media"] if with_media else []), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), *([pa.binary()] if with_media else []), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                media = bytes_to_tiff(raw.ljust(max(192, -(-len(raw) // 192) * 192), b" "))
                pages = [px for _, px, _ in read_pages(media)]
                back = b"".join(px.tobytes() for px in pages)
                rows.append((len(raw), *([media] if with_media else []), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(pages)))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return docs.select(id_col, text_bytes(text_col).alias("raw")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, {'media binary, ' * with_media}payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
