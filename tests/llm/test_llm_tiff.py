import hashlib
import struct
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tiff as T


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600) | st.builds(lambda a, n: a * n, st.binary(min_size=1, max_size=3), st.integers(1, 3000)))
def test_codecs_round_trip(data):
    assert T.unpack_packbits(T.pack_packbits(data)) == data
    assert T.unpack_lzw(T.pack_lzw(data)) == data


def test_lzw_full_table():
    data = np.random.default_rng(0).integers(0, 256, 40_000, np.uint8).tobytes()
    assert T.unpack_lzw(T.pack_lzw(data)) == data


def test_known_streams():
    assert T.unpack_packbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert T.unpack_lzw(bytes.fromhex("80018046A0E0A0")[:0]) == b""
    with pytest.raises(T.TiffError):
        T.unpack_lzw(bytes([0x80, 0x7F, 0xFF, 0xFF]))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [T.NONE, T.LZW, T.DEFLATE, T.PACKBITS, T.OLD_DEFLATE])
@pytest.mark.parametrize("layout", [{}, {"rows_per_strip": 3}, {"tile": (16, 16)}])
def test_pages_round_trip(order, predictor, compression, layout):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 256, shape, np.uint8) for shape in ((7, 5, 3), (20, 33, 1), (1, 1, 3))]
    data = T.encode_tiff(pages, compression, predictor, order=order, **layout)
    got = [T.decode_page(data, o, tags) for o, tags in T.directories(data)]
    assert [g["pixels"] for g in got] == [p.tobytes() for p in pages]
    assert [(g["height"], g["width"], g["samples"]) for g in got] == [p.shape for p in pages]


def test_sixteen_bits_and_planes():
    """Written by hand: two planes of 16-bit samples, big-endian, in a big TIFF."""
    planes = [(np.arange(6).reshape(2, 3) * n + 1).astype(">u2") for n in (300, 7)]
    out = bytearray(b"MM" + struct.pack(">HHHQ", 43, 8, 0, 0))
    places = []
    for p in planes:
        places.append(len(out))
        out += p.tobytes()
    at = len(out)
    out += struct.pack(">2Q", *places)
    short = lambda t, *v: struct.pack(">HHQ", t, 3, len(v)) + struct.pack(f">{len(v)}H", *v).ljust(8, b"\0")
    entries = [short(256, 3), short(257, 2), short(258, 16, 16), short(259, 1), struct.pack(">HHQQ", 273, 16, 2, at), short(277, 2), short(278, 2), short(279, 12, 12), short(284, 2)]
    struct.pack_into(">Q", out, 8, len(out))
    out += struct.pack(">Q", len(entries)) + b"".join(entries) + struct.pack(">Q", 0)
    (order, tags), = T.directories(bytes(out))
    page = T.decode_page(bytes(out), order, tags)
    want = np.stack(planes, axis=2).astype("=u2")
    assert page["pixels"] == want.tobytes() and page["bits"] == 16


def test_rows_per_page_and_errors(spark):
    r = np.random.default_rng(2)
    pages = [r.integers(0, 256, (4, 4, 1), np.uint8) for _ in range(3)]
    good = T.encode_tiff(pages)
    cycle = bytearray(good)
    last = list(T.directories(good))
    assert len(last) == 3
    rows = [(1, bytearray(good), "x", 0), (2, bytearray(b"nope"), "x", 0), (3, None, "x", 0), (4, bytearray(b""), "x", 0), (5, bytearray(good[:200]), "x", 0), (6, bytearray(cycle[:60]), "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, media binary, pixels string, page int")
    got = sorted(T.tiff_pages(df).collect(), key=lambda x: (x["doc_id"], x["page"]))
    assert [(x["doc_id"], x["page"], x["error"] is None) for x in got if x["doc_id"] < 5] == [(1, 0, True), (1, 1, True), (1, 2, True), (2, 0, False)]
    assert [bytes(x["pixels"]) for x in got[:3]] == [p.tobytes() for p in pages]
    assert {x["doc_id"] for x in got if x["error"]} == {2, 5, 6}
    assert T.tiff_pages(df.limit(0)).count() == 0


def test_texts(spark):
    texts = ["", None, "é😀" * 100, "x" * 192, "x" * 193, "\x00\x1f", "y" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = T.store_texts(df)
    for r in T.tiff_pages(stored).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = bytes(r["pixels"])
        assert r["error"] is None and r["n_bytes"] == len(raw)
        assert len(payload) % 192 == 0 and len(payload) >= max(192, len(raw)) and len(payload) - max(len(raw), 1) < 192
        assert payload == raw.ljust(len(payload), b" ")
        assert sum(r["histogram"]) == len(payload)


def test_query_columns(spark, small):
    from millrace.llm.queries import op10_tiff

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op10_tiff(spark, small).collect():
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        media = T.text_to_tiff(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest())


def test_pages_behind_an_unreadable_one_stay(spark):
    pages = [np.full((4, 5, 1), v, np.uint8) for v in (1, 2, 3)]
    data = bytearray(T.encode_tiff(pages))
    at = struct.unpack_from("<I", data, 4)[0]
    at = struct.unpack_from("<I", data, at + 2 + 12 * struct.unpack_from("<H", data, at)[0])[0]
    bits = next(at + 2 + 12 * k for k in range(10) if struct.unpack_from("<H", data, at + 2 + 12 * k)[0] == 258)
    struct.pack_into("<H", data, bits + 8, 32)
    rows = spark.createDataFrame([(1, bytes(data))], "id long, media binary")
    got = sorted(T.tiff_pages(rows).collect(), key=lambda r: r["page"])
    assert [r["page"] for r in got] == [0, 1, 2]
    assert [r["pixels"] for r in got] == [pages[0].tobytes(), None, pages[2].tobytes()]
    assert "32 bits" in got[1]["error"] and got[0]["error"] is None and got[2]["error"] is None


def test_a_blank_page_may_grow_far(monkeypatch):
    """24 MB of zeros in 12 KB of LZW codes that keep a full table: more than any deflate."""
    zeros = np.zeros((4000, 6000, 1), np.uint8)
    monkeypatch.setitem(T._PACK, T.DEFLATE, lambda b: zlib.compress(b, 9))
    data = T.encode_tiff([zeros], T.DEFLATE, 1)
    assert zeros.size > 900 * len(data)
    page = T.decode_page(data, *next(T.directories(data)))
    assert page["pixels"] == zeros.tobytes()
    huge = bytearray(data)
    for tag in (256, 257):  # the header claims a hundred times more than there is
        at = huge.find(struct.pack("<HHI", tag, 4, 1)) + 8
        struct.pack_into("<I", huge, at, struct.unpack_from("<I", huge, at)[0] * 3)
    tracemalloc.start()
    with pytest.raises((T.TiffError, ValueError)):
        T.decode_page(bytes(huge), *next(T.directories(bytes(huge))))
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_samples_of_few_bits(bits):
    image = np.random.default_rng(bits).integers(0, 2**bits, (7, 13, 1)).astype(np.uint8)
    rows = [np.packbits(np.unpackbits(r[:, None], axis=1)[:, 8 - bits :].reshape(-1)).tobytes() for r in image[:, :, 0]]
    tags = {256: (13,), 257: (7,), 258: (bits,), 259: (T.PACKBITS,), 273: (0,), 279: (10_000,), 278: (7,)}
    page = T.decode_page(T.pack_packbits(b"".join(rows)), "<", tags)
    assert page["pixels"] == image.tobytes() and page["bits"] == bits
