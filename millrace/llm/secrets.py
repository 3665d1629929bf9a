"""Secret scans with multipart credential linking, in DataFrame expressions only.

Base spans (assignments, access keys, long hex strings) are always reported.
Identifiers, bare key-like strings and endpoints are weak candidates: one is
reported only where no more than ``SCOPE`` characters of the same text lie
between it and a complementary part, found by an interval join over the spans of
a text: ordered by start, the furthest end before and the nearest start behind.

A text is split and matched by regular expressions only if a cheap test says
that it may hold something.  Positions are running sums of the lengths of
pieces and matches.  Only those lengths are shuffled, never texts, and copies
of a text are worked on once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import materialize, pick, settled

SCOPE = 200
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
IDENTIFIER = r"""(?i)(user(?:name)?|login|client_?id|account|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
KEYLIKE = r"[A-Za-z0-9+/]{32,}"
ENDPOINT = r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x09-\x0D\x20"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{2,5})?"""
#: Kind, pattern, group whose length counts, least length; the first three are base kinds.
KINDS = [
    ("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32),
    ("linked_identifier", IDENTIFIER, 2, 3), ("linked_secret", KEYLIKE, 0, 40), ("linked_endpoint", ENDPOINT, 0, 1),
]
MASK = "[SECRET]"
#: Texts with spans, and spans, that may be broadcast: some 20 MB.
BROADCAST_TEXTS, BROADCAST_SPANS = 100_000, 400_000


def _any(low: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def _hits(text: Column, pattern: str, group: int) -> Column:
    """Of each match: length of the piece before it, of the match, of the group, and whether it mixes letters and digits."""
    pieces, whole, part = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(whole)).alias("a"), whole.alias("b"), part.alias("c")),
        lambda x: F.struct(
            F.length(x["a"]).alias("gap"), F.length(x["b"]).alias("len"), F.length(x["c"]).alias("part"),
            (x["b"].rlike("[A-Z]") & x["b"].rlike("[a-z]") & x["b"].rlike("[0-9]")).alias("mixed"),
        ),
    )


def _marked(docs: DataFrame) -> DataFrame:
    """``docs`` plus columns m0 to m5, which say for what kinds a text is worth matching."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = docs.withColumn("__low", F.lower(text))
    ident = _any(F.col("__low"), "user", "login", "client_id", "clientid", "account", "access_key", "accesskey")
    flags = low.select(
        *docs.columns,
        _any(F.col("__low"), "password", "passwd", "secret", "token", "api_key", "apikey").alias("m0"),
        F.contains(text, F.lit("AKIA")).alias("m1"),
        text.rlike("[0-9a-f]{32}").alias("m2"),
        ident.alias("m3"),
        (F.contains(text, F.lit("://")) | text.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]")).alias("m5"),
    )
    return flags.withColumn("m4", F.col("m1") | F.col("m3") | F.col("m5"))


def _lists(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, key (md5 of a text that may hold something, else null) and the matches of each kind, h0 to h5."""
    worth = F.col("m0") | F.col("m1") | F.col("m2") | F.col("m3") | F.col("m4")
    lists = [F.when(F.col(f"m{i}"), _hits(F.col("text"), pattern, group)).alias(f"h{i}") for i, (_, pattern, group, _) in enumerate(KINDS)]
    return _marked(docs).select("doc_id", *also, F.when(worth, F.md5("text")).alias("key"), *lists)


def _linked(hits: DataFrame) -> DataFrame:
    """Spans by text: (key, found: array of (start, rank, end)); texts without a span are absent."""
    rows = None
    for i in range(len(KINDS)):
        part = hits.where(F.size(f"h{i}") > 0).select("key", F.lit(i).alias("rank"), F.posexplode(f"h{i}").alias("at", "h")).select("key", "rank", "at", "h.*")
        rows = part if rows is None else rows.union(part)
    rows = rows.dropDuplicates(["key", "rank", "at"])
    before = Window.partitionBy("key", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("start", F.col("end") - F.col("len"))
    enough = F.lit(False)
    for i, (_, _, _, least) in enumerate(KINDS):
        enough = enough | ((F.col("rank") == i) & (F.col("part") >= least))
    spans = spans.where(enough & ((F.col("rank") != 4) | F.col("mixed"))).select("key", "rank", "start", "end")

    by = Window.partitionBy("key").orderBy("start")
    so_far, from_here = by.rangeBetween(Window.unboundedPreceding, 0), by.rangeBetween(0, Window.unboundedFollowing)
    base, rank = F.col("rank") < 3, F.col("rank")

    def near(kind: Column) -> Column:
        before = F.max(F.when(kind, F.col("end"))).over(so_far) >= F.col("start") - SCOPE
        behind = F.min(F.when(kind, F.col("start"))).over(from_here) <= F.col("end") + SCOPE
        return F.coalesce(before, F.lit(False)) | F.coalesce(behind, F.lit(False))

    linked = spans.select(
        "*",
        near(rank.isin(0, 2, 4)).alias("secret"),
        near(rank.isin(1, 3, 5)).alias("other"),
        (F.coalesce(F.max(F.when(base, F.col("end"))).over(so_far), F.lit(-1)) > F.col("start")).alias("inside"),
        (F.coalesce(F.min(F.when(base, F.col("start"))).over(from_here), F.lit(2**62)) < F.col("end")).alias("across"),
    )
    weak = ~F.col("inside") & ~F.col("across") & F.when(rank == 4, F.col("other")).otherwise(F.col("secret"))
    kept = linked.where(base | weak)
    return kept.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("found"))


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs`` (doc_id, text).

    Positions count code points, ends are exclusive; spans are in order of
    start, then kind, then end.  A null or empty text has none.  Repeated rows
    give repeated results; rows without doc_id are treated like any other.
    """
    whole = materialize(_lists(pick(docs, "doc_id", "text")), "scanned")
    found = _linked(whole)
    some = whole.where("key is not null").select("doc_id", "key").join(found, "key", "left").select("doc_id", "found")
    none = whole.where("key is null").select("doc_id", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    rows = some.union(none).withColumn("found", F.coalesce("found", F.array().cast(found.schema["found"].dataType)))
    base = F.filter("found", lambda s: s["rank"] < 3)
    number = lambda i: F.size(F.filter("found", lambda s: s["rank"] == i)).cast("bigint")
    return rows.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_shown(base), 256).alias("base_sha256"), _shown(F.col("found")).alias("spans"))


def _masked(text: Column, found: Column) -> Column:
    """``text`` with each stretch that spans cover replaced by one mask."""
    ends = F.transform(found, lambda s: s["end"].cast("int"))
    done = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.array_max(F.slice(ends, F.lit(1), F.greatest(i, F.lit(1)))))  # noqa: E731  where the spans before the i-th end
    parts = F.transform(
        found,
        lambda s, i: F.when(s["start"] >= done(i), F.concat(text.substr(done(i) + 1, (s["start"] - done(i)).cast("int")), F.lit(MASK))).otherwise(F.lit("")),
    )
    return F.concat(F.array_join(parts, ""), text.substr(F.array_max(ends) + 1, F.length(text)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of :func:`scan` masked in text, and n_chars counted anew where there is such a column.

    Spans that overlap share one mask.  All rows stay, repeated ones as often as
    they are there; a null or empty text stays as it is, and so does an empty table.
    """
    hits = lambda: materialize(_lists(pick(docs, "doc_id", "text")).where("key is not null").drop("doc_id"), "scanned")
    found = settled(docs.sparkSession, "found", lambda: _linked(hits())).select(F.col("key").alias("__key"), F.col("found").alias("__found"))
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("__found")), F.lit(0))).first()
    worth = F.col("m0") | F.col("m1") | F.col("m2") | F.col("m3") | F.col("m4")
    keyed = _marked(docs).select(*docs.columns, F.when(worth, F.md5("text")).alias("__own"))
    if size[0] <= BROADCAST_TEXTS and size[1] <= BROADCAST_SPANS:
        rows = keyed.join(F.broadcast(found), keyed["__own"] == found["__key"], "left")
    else:  # only texts that may hold something are shuffled
        some = keyed.where("__own is not null").join(found, F.col("__own") == F.col("__key"), "left")
        rows = some.unionByName(keyed.where("__own is null"), allowMissingColumns=True)
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col("__found")))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return rows.select(*docs.columns)
