"""TIFF media columns: walk image directories, decode strips and tiles, one row per page.

Reads classic and big TIFF of either byte order; samples of 1, 2, 4, 8 or 16 bits, strips
or tiles, chunky or planar, uncompressed, PackBits, LZW or deflate, with or
without the horizontal predictor.  A page of another kind gives an error row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import small_batches

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}


#: Bytes of a page's samples that a row can hold; a larger page gives an error row.
MOST_BYTES = 1 << 30


class TiffError(ValueError):
    """The bytes aren't a TIFF that this reader understands."""


def unpack_packbits(data: bytes, need: int = MOST_BYTES) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < need:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


def pack_packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < len(data) and end - at < 128 and not (end + 1 < len(data) and data[end] == data[end + 1]):
            end += 1
        out += bytes((end - at - 1,)) + data[at:end]
        at = end
    return bytes(out)


def unpack_lzw(data: bytes, need: int = MOST_BYTES) -> bytes:
    """Codes of 9 to 12 bits, high bit first, that widen one code early; 256 clears and 257 ends.  ``need`` bytes are enough."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, width, last, bits, held, made = [], 9, None, 0, 0, 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW: a first code beyond the letters")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("LZW: a code before its entry")
            table.append(last + entry[:1])
        out.append(entry)
        made += len(entry)
        if made >= need:
            break
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes, width, bits, held, out = {}, 9, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held)
            bits &= (1 << held) - 1

    def clear() -> None:
        nonlocal codes, width
        put(256)
        codes, width = {bytes((i,)): i for i in range(256)}, 9

    clear()
    prefix = b""
    for byte in data:
        longer = prefix + bytes((byte,))
        if longer in codes:
            prefix = longer
            continue
        put(codes[prefix])
        codes[longer] = len(codes) + 2
        prefix = longer[-1:]
        if len(codes) + 2 >= (1 << width) - 0 and width < 12:
            width += 1
        if len(codes) + 2 >= 4094:
            put(codes[prefix])
            prefix = b""
            clear()
    if prefix:
        put(codes[prefix])
        if len(codes) + 3 >= (1 << width) and width < 12:
            width += 1
    put(257)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


_PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda b: zlib.compress(b, 1), OLD_DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_packbits}


def unpack_deflate(data: bytes, need: int = MOST_BYTES) -> bytes:
    return zlib.decompressobj().decompress(data, need)


_UNPACK = {NONE: lambda b, need: b[:need], LZW: unpack_lzw, DEFLATE: unpack_deflate, OLD_DEFLATE: unpack_deflate, PACKBITS: unpack_packbits}


def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of shape (height, width, samples), uint8, as one classic TIFF."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        high, wide, samples = page.shape
        rows = min(rows_per_strip or high, high)
        blocks = []
        if tile:
            for y in range(0, high, tile[1]):
                for x in range(0, wide, tile[0]):
                    block = np.zeros((tile[1], tile[0], samples), np.uint8)
                    part = page[y : y + tile[1], x : x + tile[0]]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            blocks = [page[y : y + rows] for y in range(0, high, rows)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
            packed = _PACK[compression](np.ascontiguousarray(block).tobytes())
            places.append(len(out))
            sizes.append(len(packed))
            out += packed + b"\0" * (len(packed) & 1)
        tags = [(256, 4, [wide]), (257, 4, [high]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples == 3 else 1]), (277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor])]
        tags += [(322, 4, [tile[0]]), (323, 4, [tile[1]]), (324, 4, places), (325, 4, sizes)] if tile else [(273, 4, places), (278, 4, [rows]), (279, 4, sizes)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(raw) > 4:
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), len(out)))
                out += raw + b"\0" * (len(raw) & 1)
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """(byte order, tags) of each image directory, in file order; a cycle ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(order + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at, seen = struct.unpack_from(order + word, data, 8 if big else 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        at += struct.calcsize("=" + count)
        tags = {}
        for k in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at + entry * k)
            many = struct.unpack_from(order + word, data, at + entry * k + 4)[0]
            if kind not in _CODES:
                continue
            value = at + entry * k + (12 if big else 8)
            if many * _SIZES[kind] > (8 if big else 4):
                value = struct.unpack_from(order + word, data, value)[0]
            tags[tag] = struct.unpack_from(f"{order}{many}{_CODES[kind]}", data, value)
        yield order, tags
        at = struct.unpack_from(order + word, data, at + entry * n)[0]


def decode_page(data: bytes, order: str, tags: dict[int, tuple]) -> dict:
    """Size, layout and samples of one page: pixels are rows of interleaved samples, of a byte each or, at 16 bits, two.

    Strips and tiles are decoded no further than their part of the page, and
    before room is made for the page, so a header that claims more than its bytes
    hold costs nothing.
    """
    one = lambda tag, default: tags.get(tag, (default,))[0]
    wide, high, samples = one(256, 0), one(257, 0), one(277, 1)
    bits, compression, predictor, planar = one(258, 1), one(259, 1), one(317, 1), one(284, 1)
    if bits not in (1, 2, 4, 8, 16) or bits < 8 and predictor != 1 or compression not in _UNPACK or predictor not in (1, 2) or not wide or not high:
        raise TiffError(f"not supported: {bits} bits, compression {compression}, predictor {predictor}, {wide} x {high}")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    if wide * high * samples * kind.itemsize > MOST_BYTES:
        raise TiffError(f"a page of more than {MOST_BYTES} bytes")
    tiled = 324 in tags
    across, down = (one(322, 0), one(323, 0)) if tiled else (wide, min(one(278, high), high))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    planes, inner = (samples, 1) if planar == 2 else (1, samples)
    spots_many = planes * -(-high // max(1, down)) * -(-wide // max(1, across))
    if not down or not across or len(places) < spots_many or len(sizes) < spots_many:
        raise TiffError("strips or tiles are missing")
    spots = [(p, y, x) for p in range(planes) for y in range(0, high, down) for x in range(0, wide, across)]
    line = -(-across * inner * bits // 8)  # bytes of a row, which starts anew at a byte
    parts = []
    for (_, y, _), place, size in zip(spots, places, sizes, strict=False):
        rows = down if tiled else min(down, high - y)
        raw = _UNPACK[compression](data[place : place + size], rows * line)
        if len(raw) < rows * line:
            raise TiffError("a strip or tile is too short")
        parts.append(raw)
    out = np.zeros((high, wide, samples), kind.newbyteorder("="))
    for (p, y, x), raw in zip(spots, parts, strict=True):
        rows = down if tiled else min(down, high - y)
        if bits < 8:
            each = np.unpackbits(np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line), axis=1)[:, : across * inner * bits]
            block = (each.reshape(rows, across, inner, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        else:
            block = np.frombuffer(raw, kind, rows * across * inner).reshape(rows, across, inner).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        part = block[: high - y, : wide - x]
        out[y : y + part.shape[0], x : x + part.shape[1], p : p + inner] = part
    return {"width": wide, "height": high, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "pixels": out.tobytes(), "error": None}


PAGE = "page int, width long, height long, samples int, bits int, compression int, predictor int, histogram array<long>, pixels binary, error string"


def tiff_pages(rows: DataFrame, media: str = "media") -> DataFrame:
    """One row per page of the TIFF in column ``media``; the other columns come along.

    page counts from 0.  histogram counts pixel bytes by their upper three bits.
    Bytes that are no TIFF, or whose directories break off, give a row whose
    error says so and whose further columns are null; pages before that stay.  So
    does a page that can't be decoded, and the pages behind it are read.  A null or
    empty medium, having no pages, gives no row.  Columns of ``rows`` that have
    the name of a page column are dropped.  Repeated rows give repeated rows, an
    empty table an empty one.
    """
    small_batches(rows.sparkSession)
    made = T._parse_datatype_string(PAGE)
    keep = [f for f in rows.schema.fields if f.name not in {*made.names, media}]

    broken = (ValueError, KeyError, IndexError, struct.error, zlib.error)

    def decode(data: bytes) -> Iterator[dict]:
        done = 0
        wrong = lambda e: dict.fromkeys(made.names) | {"page": done, "error": f"{type(e).__name__}: {e}"}
        try:
            for order, tags in directories(data):
                try:
                    page = decode_page(data, order, tags)
                    shown = np.bincount(np.frombuffer(page["pixels"], np.uint8) >> 5, minlength=8)
                    row = {"page": done, "histogram": shown.tolist()} | page
                except broken as e:
                    row = wrong(e)
                yield row
                done += 1
        except broken as e:
            yield wrong(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.string()]
        for batch in batches:
            at, pages = [], []
            for i, data in enumerate(batch.column(batch.num_columns - 1)):
                for page in decode(data.as_py()) if data.is_valid and len(data.as_buffer()) else ():
                    at.append(i)
                    pages.append(page)
            kept = batch.take(pa.array(at, pa.int64())).columns[:-1]
            columns = [pa.array([p[n] for p in pages], k) for n, k in zip(made.names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*(f.name for f in keep), *made.names])

    return rows.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{media}`")).mapInArrow(run, T.StructType([*keep, *made.fields]))


#: Pixels in a row: three samples each, so a row has 192 bytes.
ROW_PIXELS = 64
STRIP_ROWS = 256


def text_to_tiff(payload: bytes) -> bytes:
    """A one-page RGB image of ``payload`` (whole rows of 192 bytes): deflated strips with the horizontal predictor."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW_PIXELS, 3)
    return encode_tiff([image], DEFLATE, 2, STRIP_ROWS)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of ``docs`` (doc_id, text); a null text is empty.

    The payload is the UTF-8 text, whole, filled with spaces to a positive multiple
    of 192 bytes.  Repeated rows give repeated results, an empty table an empty
    one; further columns of any name are left out.
    """
    small_batches(docs.sparkSession)
    row = 3 * ROW_PIXELS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            media = [text_to_tiff(x.ljust(max(1, -(-len(x) // row)) * row)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")
