"""WARC archives: a writer through Spark's own commit protocol and a splittable reader.

Each record is a gzip member of its own.  The writer hands members to Spark's
text sink, whose line separator is here an empty gzip member: the file stays a
valid sequence of members, may live in any store that Spark writes to, and a
task that is lost or run twice leaves nothing behind.

The reader cuts files into byte ranges.  A task looks for the gzip magic in its
range, takes a candidate only if it decodes as a member and is followed by
another one or by the end of the file, reads on past the end of the range to
finish it, and owns exactly the records whose member starts inside.  A
member whose bytes hold the magic by chance is no problem: the scan goes on
behind the member, and a range that starts within one finds a candidate that
doesn't decode.  A member that was stored uncompressed can hold whole members:
what a task finds behind the start of its range counts only if ``LOOK`` members
follow one another there, or all up to the end of the file.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import materialize, pick, scratch, settled, small_batches

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
SPLIT_BYTES = 8 << 20
PIECE = 16 << 10
LEVEL = 3
#: Members that must follow one another before a range that doesn't start a file trusts them.
LOOK = 16
#: Revisits that may be broadcast to the writers, of less than a hundred bytes each.
BROADCAST_ROWS = 200_000


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _clean(value: str) -> str:
    """A header value: control characters would end it."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id: str | None, url: str | None, payload: bytes, digest: str, owner: str | None) -> bytes:
    """A response record, or, where ``owner`` names another page, a revisit without payload."""
    revisit = owner is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{base32_sha1(digest)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{owner}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[dict]:
    """Fields of each record of a member, one behind the other; what doesn't start as a record ends them."""
    at = 0
    while True:
        while data[at : at + 1] in (b"\r", b"\n"):
            at += 1
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            return
        fields: dict[str, str] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = fields.get("content-length", "")
        at = end + 4 + int(length) if length.isascii() and length.isdigit() else len(data)  # without a length, all that follows
        yield _record(fields, data[end + 4 : at])


def _record(fields: dict[str, str], block: bytes) -> dict:
    payload, declared = block, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.decode("latin-1").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            if name.strip().lower() == "content-length" and value.strip().isdigit():
                declared = int(value)
    kind = fields.get("warc-type")
    digest = fields.get("warc-payload-digest", "").rpartition(":")[2]
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": declared if kind == "revisit" and declared is not None else len(payload),
        "payload_digest": digest if kind == "revisit" else found,
        "intact": kind == "revisit" or not digest or digest == found,
        "payload": None if kind == "revisit" else payload,
    }


def records_between(read_at: Callable[[int, int], bytes], start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded member) of each member with records that starts in [start, end)."""
    data = memoryview(whole := read_at(start, end - start + len(MAGIC) - 1))
    at, trusted = 0, start == 0
    held: list[tuple[int, bytes]] = []  # of a chain of members that isn't trusted yet
    chain = 0
    while 0 <= (found := whole.find(MAGIC, at)) < end - start:
        if chain and found > at:  # the chain broke off
            held, chain = [], 0
        at = found
        got = _decode(data, at, read_at, start)
        follower = got and _bytes(data, at + got[0], len(MAGIC), read_at, start)
        if got is None or follower not in (MAGIC, b"") and not trusted:
            if got is None and held and _breaks_off(data, at, read_at, start):
                yield from held
            held, chain = [], 0
            at += 1
            continue
        length, record = got
        if record:
            held.append((start + at, record))
        chain += 1
        at += length
        if trusted or chain >= LOOK or follower == b"":
            trusted = True
            yield from held
            held = []
    if held and _goes_on(data, at, read_at, start, LOOK - chain):
        yield from held


def _goes_on(data: memoryview, at: int, read_at: Callable[[int, int], bytes], base: int, members: int) -> bool:
    """Whether so many members follow one another from ``at``, or all up to the end of the file, be it that the last breaks off."""
    for _ in range(members):
        if not _bytes(data, at, 1, read_at, base):
            return True
        got = _decode(data, at, read_at, base)
        if got is None:
            return _breaks_off(data, at, read_at, base)
        at += got[0]
    return True


def _breaks_off(data: memoryview, at: int, read_at: Callable[[int, int], bytes], base: int) -> bool:
    """Whether a member starts at ``at`` that the file's end cuts."""
    unpacker, pos = zlib.decompressobj(31), at
    try:
        while not unpacker.eof:
            if not (piece := _bytes(data, pos, PIECE, read_at, base)):
                return True
            unpacker.decompress(piece)
            pos += len(piece)
    except zlib.error:
        pass
    return False


def _bytes(data: memoryview, at: int, n: int, read_at: Callable[[int, int], bytes], base: int) -> bytes:
    return bytes(data[at : at + n]) if at + n <= len(data) else read_at(base + at, n)


def _decode(data: memoryview, at: int, read_at: Callable[[int, int], bytes], base: int) -> tuple[int, bytes] | None:
    """Length of the member at ``at`` and its content if that starts as a record, else nothing; None if there is no whole member."""
    unpacker, out, pos, first = zlib.decompressobj(31), [], at, b""
    try:
        while not unpacker.eof:
            piece = data[pos : pos + PIECE] if pos < len(data) else read_at(base + pos, PIECE)  # a view, not a copy
            if not len(piece):
                return None
            out.append(unpacker.decompress(piece))
            pos += len(piece)
            if len(first) < 5:
                first = b"".join(out)[:5]
            if first != b"WARC/"[: len(first)]:
                out = []  # not a record, but a member all the same
    except zlib.error:
        return None
    return pos - at - len(unpacker.unused_data), b"".join(out) if first == b"WARC/" else b""


@contextmanager
def _opened(path: str) -> Iterator[Callable[[int, int], bytes]]:
    """A reader of byte ranges of a file, whatever characters its name has."""
    scheme, found, rest = path.partition("://")
    if not found or scheme == "file":
        f = open(rest if found else path.removeprefix("file:"), "rb")  # noqa: SIM115
    else:
        from pyarrow import fs

        host, _, key = rest.partition("/")
        store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        f = store.open_input_file(f"{base.rstrip('/')}/{key}")

    def read_at(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    try:
        yield read_at
    finally:
        f.close()


RECORD = (
    "path string, offset long, number int, record_id string, record_type string, target_uri string, refers_to string, "
    "payload_bytes long, payload_digest string, intact boolean, payload binary"
)


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """One row per record of all gzip files in ``path``, whatever their names; each task takes byte ranges of ``split_bytes``.

    ``path`` is a folder or a file, open to the workers (a shared mount, or a store
    that pyarrow can read).  offset is where a record's member starts, number its
    place in the member.  payload is null for revisits and if ``payloads`` is
    false.  A member that breaks off, or that has no record, gives no row.  A file
    that is one member is read by one task, as gzip can't be entered within a
    member.  Files whose names start with a dot or an underscore are left out; an
    empty folder gives an empty table.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    splits = files.select("path", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(split_bytes))).alias("start"), "length")
    total = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    splits = splits.repartition(int(min(total, 100_000)), "path", "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                with _opened(row["path"]) as read_at:
                    for offset, data in records_between(read_at, row["start"], min(row["start"] + split_bytes, row["length"])):
                        for number, record in enumerate(parse_records(data)):
                            if not payloads:
                                record["payload"] = None
                            rows.append({"path": row["path"], "offset": offset, "number": number} | record)
                            held += len(record["payload"] or b"") + 500
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                                rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return splits.mapInArrow(scan, RECORD)


ARROW = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("number", pa.int32()), ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary()),
])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) below ``path``.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the
    least page_id is a response and the others are revisits of it.  A null html
    is an empty payload; a null url leaves its header out; a row without page_id
    is never the least if another row has one, and rows that share the least
    page_id are all responses.  Payloads are told apart by their SHA-1.  Repeated
    rows are written as often as they are there, payloads of any length whole, and
    an empty table writes no record.  Further columns of any name are left out.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit(""))).withColumn("digest", F.sha1("html"))

    def others() -> DataFrame:
        ids = materialize(rows.where(F.octet_length("html") >= min_bytes).select("page_id", "digest"), "ids")
        owners = ids.groupBy("digest").agg(F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").drop("n")
        return ids.join(owners, "digest").where("not (page_id <=> owner)").select(F.col("page_id").alias("rp"), F.col("digest").alias("rd"), "owner").distinct()

    with scratch(spark):
        _write(rows, settled(spark, "revisits", others), path)


def _write(rows: DataFrame, revisits: DataFrame, path: str) -> None:
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    marked = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("rp")) & (F.col("digest") == F.col("rd")), "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [gzip_member(build_record(*row)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    packed = marked.select(F.col("page_id").cast("string"), "url", F.col("html").cast("binary"), "digest", F.col("owner").cast("string")).mapInArrow(pack, "member binary")
    packed.select(F.col("member").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
