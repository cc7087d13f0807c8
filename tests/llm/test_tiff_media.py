import numpy as np
import pytest

from loomwork.llm import tiff_media as T

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_pages_come_back(compression, predictor, tile, order):
    pages = [RNG.integers(0, 4, (37, 29, 3)).astype(np.uint8), np.tile(np.arange(90, dtype=np.uint16)[None, :, None] * 700, (40, 1, 1)), RNG.integers(0, 256, (200, 64, 1)).astype(np.uint8)]
    back = [px for _, px, _ in T.read_pages(T.write_tiff(pages, compression, predictor, 8, tile, order))]
    assert len(back) == 3 and all((a == b).all() for a, b in zip(pages, back))


def test_codecs_on_plain_bytes():
    for data in (b"", b"a", b"ab" * 9000, bytes(range(256)) * 40, b"\0" * 5000, RNG.integers(0, 256, 20000).astype(np.uint8).tobytes()):
        assert T.unpack_bits(T.pack_bits(data)) == data
        assert T.lzw_decode(T.lzw_encode(data)) == data


def test_other_decoders_agree_on_lzw_start():
    assert T.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])


def test_one_row_per_page_and_damaged_files(spark):
    good = T.write_tiff([np.zeros((2, 3, 1), np.uint8), np.ones((5, 4, 3), np.uint8)])
    rows = [(1, good), (2, None), (3, b"junk"), (4, good[:-30]), (5, b"II*\0\xff\xff\xff\x7f")]
    got = T.tiff_pages(spark.createDataFrame(rows, "id int, data binary"), "id", "data").collect()
    assert [(r.page, r.width, r.height, r.samples) for r in got if r.id == 1] == [(0, 3, 2, 1), (1, 4, 5, 3)]
    assert all(r.error for r in got if r.page == -1) and {r.id for r in got if r.page == -1} == {2, 3, 4, 5}


def test_a_ring_of_directories_ends():
    data = bytearray(T.write_tiff([np.zeros((1, 1, 1), np.uint8)]))
    data[-4:] = data[4:8]
    with pytest.raises(T.TiffError):
        list(T.read_pages(bytes(data)))


def test_texts_round_trip(spark):
    import hashlib
    import zlib

    texts = ["", None, "x", "ü" * 96, "long " * 200_000, "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as feature", "2 as raw", "3 as media")
    got = {r.doc_id: r for r in T.texts_as_tiff(docs).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert got[2][1:] == got[5][1:]
    assert T.texts_as_tiff(docs.limit(0)).count() == 0


def tiff_of(tags, data=b"", nexts=0):
    """One directory of (tag, kind, value) entries behind the data, which begins at byte 8."""
    import struct

    at = 8 + len(data) + len(data) % 2
    out = b"II*\0" + struct.pack("<I", at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags))
    for tag, kind, value in sorted(tags):
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return out + struct.pack("<I", nexts)


def page(width=4, height=2, rows=2, count=8, bits=8, compression=1, samples=1):
    return [(T.WIDTH, 4, width), (T.HEIGHT, 4, height), (T.BITS, 3, bits), (T.COMPRESSION, 3, compression), (T.SAMPLES, 3, samples), (T.STRIP_OFFSETS, 4, 8), (T.ROWS_PER_STRIP, 4, rows), (T.STRIP_COUNTS, 4, count)]


def test_damaged_headers_give_an_error_and_no_crash(spark):
    good = tiff_of(page(), bytes(range(8)))
    assert [px.tobytes() for _, px, _ in T.read_pages(good)] == [bytes(range(8))]
    bad = [page(width=0), page(rows=0), page(width=2**31, height=2**31), page(height=9), page(samples=0), page(bits=7), page(compression=9), page(count=3), [x for x in page() if x[0] != T.STRIP_COUNTS], page(compression=8)]
    rows = [(i, tiff_of(tags, bytes(range(8)))) for i, tags in enumerate(bad)]
    got = T.tiff_pages(spark.createDataFrame(rows, "id int, data binary"), "id", "data").collect()
    assert sorted((r.id, r.page) for r in got) == [(i, 0) for i in range(len(bad))] and all(r.error and r.pixels is None for r in got)


def test_any_damage_is_an_error_or_a_page():
    import random

    rng = random.Random(5)
    for compression in (T.NONE, T.LZW, T.DEFLATE, T.PACKBITS):
        good = T.write_tiff([np.arange(60, dtype=np.uint8).reshape(5, 4, 3), np.zeros((9, 7, 1), np.uint8)], compression, rows_per_strip=2)
        for _ in range(300):
            data = bytearray(good)
            for _ in range(rng.randrange(1, 4)):
                data[rng.randrange(4, len(data))] = rng.choice([0, 1, 255, rng.randrange(256)])
            try:
                for _, px, _, _, error in T.walk_pages(bytes(data)):
                    assert (px is None) == bool(error)
            except T.TiffError:
                pass


def test_a_bomb_is_not_unpacked():
    import zlib

    data = zlib.compress(bytes(50_000_000), 9)
    (px,) = [px for _, px, _ in T.read_pages(tiff_of(page(count=len(data), compression=8), data))]
    assert px.shape == (2, 4, 1) and not px.any()
    assert len(T._decompress(data, T.DEFLATE, 8)) == 8


def test_bilevel_pages_and_pages_behind_a_damaged_one(spark):
    import struct

    bits = np.array([[1, 0, 1, 1, 0, 0, 0, 1, 1, 0], [0, 1, 1, 0, 1, 0, 0, 0, 0, 1]], np.uint8)
    packed = T.pack_bits(np.packbits(bits, axis=1).tobytes())
    one = tiff_of(page(width=10, bits=1, compression=T.PACKBITS, count=len(packed)), packed)
    assert [px[:, :, 0].tolist() for _, px, _ in T.read_pages(one)] == [bits.tolist()]
    bad = bytearray(tiff_of(page(bits=7), bytes(range(8))))
    struct.pack_into("<I", bad, len(bad) - 4, len(bad))
    second = page()
    bad += struct.pack("<H", len(second)) + b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)) for t, k, v in sorted(second)) + bytes(4)
    got = sorted(T.tiff_pages(spark.createDataFrame([(1, bytes(bad)), (2, one)], "id int, data binary"), "id", "data").collect(), key=lambda r: (r.id, r.page))
    assert [(r.id, r.page, bool(r.error), r.bits) for r in got] == [(1, 0, True, None), (1, 1, False, 8), (2, 0, False, 1)]
    assert bytes(got[1].pixels) == bytes(range(8))
