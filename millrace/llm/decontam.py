"""Benchmark decontamination by greedy string tiling.

Windows of five tokens of the benchmark items are seeds.  A document's tokens
are numbered by the benchmark's vocabulary and hashed with a rolling
(Karp-Rabin) hash; an item whose seeds in the document could cover enough of it
is tiled: the longest stretch that is unmarked on both sides is found by
bisection over its length, comparing the hashes of all windows of a length, and
checked token by token; it is marked, and so on until no stretch of five tokens
is left.  An item is leaked into a document if the tiles cover enough of the
item; their order doesn't matter.

Work and memory follow the length of a text, not its product with an item's, so
texts that say one word over and over are no problem.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import pick, small_batches

MIN_MATCH = 5
MIN_COVERAGE = 0.8
#: Characters of benchmark text that are sent to the workers at once; larger benchmarks go in several blocks.
BLOCK_CHARS = 16_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A run of word characters; in scripts that are written without spaces, each letter.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_TOKEN = re.compile(rf"[{_UNSPACED}]|(?:(?![{_UNSPACED}])\w)+")


_WORD, _LETTER = re.compile(r"\w+"), re.compile(f"[{_UNSPACED}]")


def tokens(text: str) -> list[str]:
    low = text.lower()
    return (_WORD if low.isascii() or not _LETTER.search(low) else _TOKEN).findall(low)


class _Hashes:
    """Polynomial hashes, modulo 2^64, of the windows of any length of a sequence of numbers."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.power = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, _BASE), out=self.power[1:])
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        # weighed by falling powers, sums of stretches differ by a power; dividing by it is a product with the inverse
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(spread * self.power[:n], out=self.sums[1:])
        self.inverse = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, np.uint64(pow(int(_BASE), -1, 2**64))), out=self.inverse[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def _free(marked: np.ndarray, length: int) -> np.ndarray:
    """Places where a window of ``length`` has nothing marked."""
    sums = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(sums[length:] == sums[: len(sums) - length]) if len(marked) >= length else np.zeros(0, np.int64)


def tile(item: np.ndarray, doc: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length) of ``k`` tokens or more: longest first, then by place in the item, then in the document."""
    mine, theirs = _Hashes(item), _Hashes(doc)
    used_item, used_doc, tiles = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    most = min(len(item), len(doc))

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Free windows that have an equal on the other side: places and hashes, in the item and in the document."""
        a, b = _free(used_item, length), _free(used_doc, length)
        ha, hb = mine.at(a, length), theirs.at(b, length)
        inside = np.isin(hb, ha)
        b, hb = b[inside], hb[inside]
        inside = np.isin(ha, hb)
        return a[inside], ha[inside], b, hb

    while most >= k:
        low, high = k - 1, most  # a match of low is known, of more than high there is none
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(shared(middle)[0]) else (low, middle - 1)
        if low < k:
            break
        a, ha, b, hb = shared(low)
        order = np.argsort(hb, kind="stable")
        b, hb = b[order], hb[order]
        first, last = np.searchsorted(hb, ha, "left").tolist(), np.searchsorted(hb, ha, "right").tolist()
        tried: dict[int, int] = {}  # how far the places of a hash are used up
        behind = 0
        for place, lo, hi in zip(a.tolist(), first, last, strict=True):
            if place < behind:
                continue  # the tile before covers its start
            at = tried.get(lo, lo)
            skipped = False
            while at < hi:
                there = int(b[at])
                if used_doc[there] or used_doc[there + low - 1]:  # tiles are no shorter than this, so one end is covered if any part is
                    at += 1
                    continue
                if (item[place : place + low] == doc[there : there + low]).all():
                    tiles.append((place, there, low))
                    used_item[place : place + low] = used_doc[there : there + low] = True
                    behind = place + low
                    at += 1
                    break
                skipped = True  # another text of the same hash
                at += 1
            if not skipped:
                tried[lo] = at
        most = low - 1
    return tiles


class Seeds:
    """The windows of a block of benchmark items, by hash; an item of fewer tokens is one window."""

    def __init__(self, items: list[tuple[int, str]], k: int = MIN_MATCH) -> None:
        self.k, self.number = k, {}
        self.ids, self.items = [], []
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(t, len(self.number) + 1) for t in tokens(text)], np.int64)
            if not len(ids):
                continue
            n = min(k, len(ids))
            found.setdefault(n, []).append((_Hashes(ids).at(np.arange(len(ids) - n + 1), n), len(self.items)))
            self.items.append(item)
            self.ids.append(ids)
        #: By length of the windows: hashes in order, and the items and places that have them.
        self.tables = {}
        for n, parts in found.items():
            hashes = np.concatenate([h for h, _ in parts])
            order = np.argsort(hashes, kind="stable")
            owners = np.concatenate([np.full(len(h), o) for h, o in parts])
            places = np.concatenate([np.arange(len(h)) for h, _ in parts])
            self.tables[n] = hashes[order], owners[order], places[order]

    def leaks(self, text: str | None, least: float = MIN_COVERAGE) -> list[tuple[int, float, int, int, int, int]]:
        """(item, coverage, tiles, longest, matched, item tokens) of each item covered enough."""
        if not text or not self.tables:
            return []
        get = self.number.get
        doc = np.array([get(t, 0) for t in tokens(text)], np.int64)
        unknown = np.concatenate(([0], np.cumsum(doc == 0)))
        hashes, out = None, []
        for n, (known, owners, places) in sorted(self.tables.items()):
            starts = np.flatnonzero(unknown[n:] == unknown[: len(unknown) - n]) if len(doc) >= n else ()
            if not len(starts):
                continue
            hashes = hashes or _Hashes(doc)
            mine = hashes.at(starts, n)
            found = known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine
            if not found.any():
                continue
            hits = np.isin(known, mine[found])
            owner, place = owners[hits], places[hits]
            order = np.argsort(owner, kind="stable")
            bounds = np.flatnonzero(np.diff(owner[order], prepend=-1, append=-1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                at = int(owner[order[a]])
                ids = self.ids[at]
                covered = np.zeros(len(ids) + 1, np.int64)
                np.add.at(covered, place[order[a:b]], 1)
                np.add.at(covered, place[order[a:b]] + n, -1)
                if (np.cumsum(covered[:-1]) > 0).sum() < least * len(ids):
                    continue  # what its seeds reach bounds what tiles can cover
                inside = np.zeros(len(doc) + 1, np.int64)
                near = starts[np.isin(mine, known[hits][order[a:b]])]
                np.add.at(inside, near, 1)
                np.add.at(inside, near + n, -1)
                tiles = tile(ids, _gathered(doc, np.cumsum(inside[:-1]) > 0), n)
                matched = sum(x for _, _, x in tiles)
                if tiles and matched / len(ids) >= least:
                    out.append((self.items[at], matched / len(ids), len(tiles), max(x for _, _, x in tiles), matched, len(ids)))
        return out


def _gathered(doc: np.ndarray, reached: np.ndarray) -> np.ndarray:
    """The stretches of ``doc`` that seeds reach, in order, with a number that is no token's between them."""
    end = reached & ~np.append(reached[1:], False)
    at = np.flatnonzero(reached)
    return np.insert(doc[at], np.flatnonzero(end[at]) + 1, -1)


@lru_cache(2)
def _seeds(items: tuple[tuple[int, str], ...], k: int) -> Seeds:
    return Seeds(list(items), k)


def _blocks(benchmark: DataFrame) -> Iterator[tuple[tuple[int, str], ...]]:
    """The benchmark in blocks of about BLOCK_CHARS characters, each small enough for driver and workers.

    Every block is one more pass over the documents.
    """
    rows = pick(benchmark, "item_id", "text").where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_CHARS))
    for i in range(n):
        mine = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield tuple(sorted({(r[0], r[1]) for r in mine.collect()}, key=str))


LEAK = "item_id long, coverage double, n_tiles int, longest int, matched_tokens int, item_tokens int"


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per pair of a document and a benchmark item that its tiles cover to ``min_coverage`` or more.

    doc_id, item_id, coverage, n_tiles, longest (tokens of the longest tile),
    matched_tokens, item_tokens.  Tokens are runs of word characters of the
    lower-cased text, and single letters of scripts without spaces.  An item of
    fewer than ``min_match`` tokens leaks where its whole sequence of tokens
    stands (so one of a single common word names many documents).  Null texts,
    empty ones and those without a token match nothing, on either side.  Of tiles
    of one length the first in the item, then in the document, is marked.
    Texts of any length are worked on whole.  Repeated documents each give their
    rows, repeated items count once, and an empty table on either side gives an
    empty result.  Further columns of any name are left out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)  # BLOCK_CHARS characters

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(sent.value, min_match)
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for leak in seeds.leaks(text, min_coverage):
                        at.append(i)
                        rows.append(leak)
                if rows:
                    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    names = ["doc_id", "item_id", "coverage", "n_tiles", "longest", "matched_tokens", "item_tokens"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *columns], names=names)

        part = pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, {LEAK}")
        out = part if out is None else out.union(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """``docs`` without the rows whose text :func:`leaks` names; the columns stay as they are.

    Each row is judged by its own text, so repeated rows go or stay together; an
    empty table stays empty, and without benchmark items all rows stay.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.columns.index("text")
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(sent.value, min_match)
            for batch in batches:
                yield batch.filter(pa.array([not seeds.leaks(x, min_coverage) for x in batch.column(text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
