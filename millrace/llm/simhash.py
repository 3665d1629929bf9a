"""SimHash fingerprints and their exact near-duplicate classes by vantage-point trees.

Two 64-bit fingerprints that differ in at most four bits agree to within one
bit on at least two of their four 16-bit quarters.  So each quarter gets a
vantage-point tree under the Hamming distance of that quarter, searched with
radius one, and a pair is accepted on the distance of all 64 bits.  A node of
a tree has a vantage point and a median distance ``mu``: a fingerprint lives on
one side, and a query also visits the other side when the triangle inequality
can't exclude it (distance ``mu`` or ``mu + 1``).  The top levels, built on the
driver from a bounded sample, are the shards; each fingerprint is sent to its
home shard and to the shards whose boundary its ball overlaps.  The lower
levels are built inside a shard.  The search is exact: the sample only decides
where boundaries lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components
from millrace.llm.shared import materialize, pick, settled, small_batches

RADIUS = 4
#: Fingerprints for which a shard is home, on average, at most.
SHARD_ROWS = 262_144
#: Fingerprints the driver sees to place boundaries; a bound, whatever the input.
SAMPLE_ROWS = 16_384
LEAST_DEPTH = 3
#: Comparisons that a leaf makes at once.
BLOCK = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(raw: bytes | None, k: int = 4) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text (None and no words: 0)."""
    words = raw.translate(_LOWER).split() if raw else []  # bytes split at \x20 and \x09-\x0D, nothing else
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - k + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(text[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        part = hashes[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, k: int = 4, *also: str) -> DataFrame:
    """(doc_id, fp: long), and the columns ``also``, of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array((simhash(x.as_py(), k) for x in batch.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], names=["doc_id", "fp", *also])

    shape = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType()), *(docs.schema[n] for n in also)])
    return docs.select(F.col("doc_id"), F.col("text").cast("binary"), *also).mapInArrow(run, shape)


def _quarter(fps: np.ndarray, q: int) -> np.ndarray:
    return ((fps.view(np.uint64) >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.uint16)


def _vantage(points: np.ndarray, tries: int = 6) -> tuple[int, int]:
    """The vantage point and median distance of the split with the thinnest boundary."""
    best = (np.inf, 0, 0)
    for p in points[np.linspace(0, len(points) - 1, min(tries, len(points))).astype(int)]:
        seen = np.bincount(np.bitwise_count(points ^ p), minlength=18)
        inside = np.cumsum(seen)
        mu = int(np.argmin(np.abs(inside - len(points) / 2)))
        cost = abs(inside[mu] - len(points) / 2) + (seen[mu] + seen[mu + 1]) / 2
        best = min(best, (cost, int(p), mu))
    return best[1], best[2]


def _top_tree(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and distances of a full binary tree, by heap position."""
    pivot, mu = np.zeros(2**depth, np.uint16), np.full(2**depth, 8, np.int8)
    parts = {1: points}
    for node in range(1, 2**depth):
        mine = parts.pop(node, points[:0])
        if len(mine):
            pivot[node], mu[node] = _vantage(mine)
            near = np.bitwise_count(mine ^ pivot[node]) <= mu[node]
            parts[2 * node], parts[2 * node + 1] = mine[near], mine[~near]
    return pivot, mu


def _route(fps: np.ndarray, trees: list[tuple[np.ndarray, np.ndarray]], depth: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards that the ball around each fingerprint overlaps: (shard, fp, home); for fingerprints ``of`` that ``fps`` names, their names."""
    shards, whose, homes = [], [], []
    for q, (pivot, mu) in enumerate(trees):
        value = _quarter(fps if of is None else of, q)
        row, node, home = np.arange(len(fps)), np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for _ in range(depth):
            d = np.bitwise_count(value[row] ^ pivot[node]).astype(np.int8)
            near, edge = d <= mu[node], (d == mu[node]) | (d == mu[node] + 1)
            row = np.concatenate((row, row[edge]))
            home = np.concatenate((home, np.zeros(int(edge.sum()), bool)))
            node = np.concatenate((2 * node + ~near, 2 * node[edge] + near[edge]))
        shards.append(node - 2**depth + q * 2**depth)
        whose.append(fps[row])
        homes.append(home)
    return np.concatenate(shards), np.concatenate(whose), np.concatenate(homes)


class _Sets:
    """Union-find over positions; keeps the links that joined two sets."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _sweep(fps: np.ndarray, home: np.ndarray, all_: np.ndarray, sets: _Sets, radius: int) -> None:
    """Breadth-first search that removes what it reaches, so dense groups cost few passes."""
    rest = all_
    seeds = dict.fromkeys(home.tolist())
    while seeds:
        seed, _ = seeds.popitem()
        queue = [seed]
        rest = rest[rest != seed]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= radius
            if near.any():
                for y in rest[near].tolist():
                    sets.join(x, y)
                    seeds.pop(y, None)
                    queue.append(y)
                rest = rest[~near]


def _search(fps: np.ndarray, home: np.ndarray, all_: np.ndarray, q: int, left: tuple[int, ...], sets: _Sets, radius: int) -> None:
    """Link each of ``home`` to the partners among ``all_`` by a tree over quarter ``q``.

    Where a quarter can't be split any more, trees over the quarters ``left`` go
    on.  Of ``m`` quarters that are still to come, one at least differs in no
    more than a ``m``-th of ``radius``: that is how far the tree reaches.
    """
    value = _quarter(fps, q)
    reach = radius // (len(left) + 1)
    stack = [(home, all_)]
    while stack:
        home, all_ = stack.pop()
        if not len(home) or len(all_) < 2:
            continue
        if len(home) * len(all_) <= BLOCK:
            hit = np.bitwise_count(fps[home][:, None] ^ fps[all_][None, :]) <= radius
            for i, j in zip(*np.nonzero(hit), strict=True):
                if home[i] != all_[j]:
                    sets.join(int(home[i]), int(all_[j]))
            continue
        pivot, mu = _vantage(value[home])
        dh, da = np.bitwise_count(value[home] ^ np.uint16(pivot)), np.bitwise_count(value[all_] ^ np.uint16(pivot))
        parts = [(home[dh <= mu], all_[da <= mu + reach]), (home[dh > mu], all_[da > mu - reach])]
        if max(len(h) * len(a) for h, a in parts) > 0.9 * len(home) * len(all_):
            if left:
                for at, other in enumerate(left):
                    _search(fps, home, all_, other, left[:at] + left[at + 1 :], sets, radius)
            else:
                _sweep(fps, home, all_, sets, radius)
            continue
        stack += parts


def shard_links(fps: np.ndarray, home: np.ndarray, q: int, radius: int = RADIUS) -> np.ndarray:
    """A spanning forest of a shard: pairs of fingerprints, fewer than there are fingerprints."""
    order = np.argsort(~home, kind="stable")
    fps, first = np.unique(fps[order], return_index=True)
    fps = fps.view(np.uint64)  # bits are counted of the absolute value of signed numbers
    home = home[order][first]
    sets = _Sets(len(fps))
    everyone = np.arange(len(fps))
    _search(fps, everyone[home], everyone, q, tuple(x for x in range(4) if x != q), sets, radius)
    pairs = np.array(sets.links, np.int64).reshape(-1, 2)
    return fps.view(np.int64)[pairs]


def _crowded(dealt: DataFrame, most: int) -> np.ndarray:
    """Shards that are home to more than ``most`` fingerprints; there are no more of them than four for each ``most`` rows."""
    return np.array([r[0] for r in dealt.where("home").groupBy("shard").count().where(F.col("count") > most).select("shard").collect()], np.int64)


def links(nodes: DataFrame, shard_rows: int = SHARD_ROWS, most: int | None = None) -> DataFrame:
    """(a, b) of distinct fingerprints ``nodes`` (fp): a forest with the classes of all pairs in reach.

    A shard that is home to over ``most`` fingerprints is dealt out anew by the trees of the
    three other quarters: a pair that meets there agrees to within one bit on one
    more quarter, which is one of these.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    most = most or 4 * shard_rows
    depth = min(16, max(LEAST_DEPTH, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE_ROWS).collect()], np.int64)
    trees = [_top_tree(_quarter(sample, q), depth) for q in range(4)]
    sent = spark.sparkContext.broadcast(trees)  # 2^depth entries of three bytes for each quarter
    shape = "shard int, sub int, fp long, home boolean"

    def deal(batches: Iterator[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, fp, home = _route(batch.column(0).to_numpy(zero_copy_only=False), sent.value, depth)
            sub = np.full(len(shard), -1)
            full = np.flatnonzero(np.isin(shard, crowded))
            if len(full):
                again, whose, at_home = _route(np.arange(len(full)), sent.value, depth, fp[full])
                other = again >> depth != shard[full][whose] >> depth
                again, whose, at_home = again[other], full[whose[other]], at_home[other]
                rest = np.flatnonzero(~np.isin(shard, crowded))
                sub = np.concatenate((sub[rest], again))
                shard, fp, home = np.concatenate((shard[rest], shard[whose])), np.concatenate((fp[rest], fp[whose])), np.concatenate((home[rest], home[whose] & at_home))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(sub.astype(np.int32)), pa.array(fp), pa.array(home)], names=["shard", "sub", "fp", "home"])

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = shard_links(rows["fp"].to_numpy(), rows["home"].to_numpy(), int(key[0]) >> depth)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    fps = nodes.select("fp")
    crowded = np.zeros(0, np.int64)
    if n > most:  # else no shard can have so many: a fingerprint has one home in each quarter
        crowded = _crowded(fps.mapInArrow(lambda batches: deal(batches, np.zeros(0, np.int64)), shape), most)
    dealt = fps.mapInArrow(lambda batches: deal(batches, crowded), shape)
    return dealt.groupBy("shard", "sub").applyInPandas(link, "a long, b long").distinct()


def _grouped(marked: DataFrame, first: Column) -> DataFrame:
    """(fp, first) of the fingerprints of ``marked`` (fp, ...) in classes of several rows: the least ``first`` of the class."""

    def make() -> DataFrame:
        spark = marked.sparkSession
        nodes = materialize(marked.groupBy("fp").agg(F.min(first).alias("first"), F.count("*").alias("n")), "nodes")
        linked = settled(spark, "linked", lambda: components(links(nodes)))
        named = linked.join(nodes, linked["node"] == nodes["fp"]).select("node", "root", "first")
        named = named.join(named.groupBy("root").agg(F.min("first").alias("least")), "root").select(F.col("node").alias("fp"), F.col("least").alias("first"))
        alone = nodes.where("n > 1").join(linked, nodes["fp"] == linked["node"], "left_anti").select("fp", "first")
        return named.union(alone)

    return settled(marked.sparkSession, "grouped", make)


def classes(docs: DataFrame, k: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the least doc_id reachable over fingerprints that differ in
    at most four bits.  Null and wordless texts have fingerprint 0 and are linked
    like any other.  Rows without doc_id take part by their fingerprint but never
    name a class (component_id null if a class has no doc_id at all).  Texts of any
    length are read whole.  Repeated rows come out as often as they went in; an
    empty table gives an empty result; further columns of any name are left out.
    """
    marked = materialize(fingerprints(pick(docs, "doc_id", "text"), k), "fingerprints")
    grouped = _grouped(marked, F.col("doc_id")).select("fp", F.col("first").alias("component_id"), F.lit(True).alias("known"))
    return marked.join(grouped, "fp", "left").select(
        "doc_id", "fp", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def hex16(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


#: Rows to drop that may be broadcast, of eight bytes each.
BROADCAST_ROWS = 1_000_000


def _key() -> list[Column]:
    """128 bits that tell rows apart by doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("__k1"), F.xxhash64("text", "doc_id", F.lit("row")).alias("__k2")]


def keep_one(docs: DataFrame, k: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate class: the one with the least doc_id.

    Of rows that share that doc_id, and of a class without any, the one with the
    least hash of doc_id and text stays; of rows equal in both, one.  The columns
    are those of ``docs``, whatever their names.  An empty table stays empty.
    """
    spark = docs.sparkSession
    names = ["__k1", "__k2"]

    def fates() -> DataFrame:
        marked = materialize(fingerprints(docs.select("doc_id", "text", *_key()), k, *names), "fingerprints")
        grouped = _grouped(marked, F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *names))
        rows = marked.join(grouped, "fp").select(*names, ((F.col("__k1") == F.col("first")["__k1"]) & (F.col("__k2") == F.col("first")["__k2"])).alias("stays"))
        return rows.groupBy(*names, "stays").agg(F.count("*").alias("n")).where("n > 1 or not stays")

    found = settled(spark, "fates", fates)
    gone, repeated = (found.where(c).select(*[F.col(n).alias(f"_{n}") for n in names]) for c in ("not stays", "stays"))
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = docs.select("*", *_key())
    same = [F.col("__k1") == F.col("___k1"), F.col("__k2") == F.col("___k2")]
    kept = keyed.join(gone, same, "left_anti")
    if repeated.isEmpty():
        return kept.drop(*names)
    once = kept.join(repeated, same, "left_semi").dropDuplicates(names)
    return kept.join(repeated, same, "left_anti").unionByName(once).drop(*names)
