"""Nearest neighbours: exact, and by an inverted file of cells.

A block of queries goes to every task; a task reads its rows once, multiplies
them with the block and keeps the best ``k`` of each query.  What meets in the
shuffle is ``k`` rows for each query and task, whatever the number of vectors.
Queries beyond a block are searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from millrace.functions.vectors import EPSILON
from millrace.sources.work import empty

#: Bytes of query vectors that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20
#: Scores that a task works out at once, of eight bytes each.
SCORES = 1 << 22
#: Bytes of vectors that a task compares at once, however small its batches are.
ROW_BYTES = 4 << 20
#: Decimals that count in ranking, so that the order of additions doesn't.
RANK_DECIMALS = 9


def _rows(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the rows with ``dimension`` numbers; others can't be compared."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # without null rows
    ok = lengths == dimension
    if ok.all():
        return np.arange(len(lengths)), flat.reshape(-1, dimension)
    at = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))[:-1]
    places = np.flatnonzero(ok)
    return places, flat[at[places][:, None] + np.arange(dimension)]


def _together(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the rows that can be compared, of as many batches at once as make about :data:`ROW_BYTES`."""
    ids: list[np.ndarray] = []
    held: list[np.ndarray] = []
    for batch in batches:
        places, v = _rows(batch.column(1), dimension)
        if len(places):
            ids.append(batch.column(0).to_numpy(zero_copy_only=False)[places])
            held.append(v)
        if sum(x.nbytes for x in held) >= ROW_BYTES:
            yield np.concatenate(ids), np.concatenate(held)
            ids, held = [], []
    if held:
        yield np.concatenate(ids), np.concatenate(held)


def _score(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Higher is nearer: cosine, or the negative squared distance."""
    if metric == "cosine":
        n = np.linalg.norm(queries, axis=1, keepdims=True)
        q = queries / np.where(n > 0, n, 1)
        return q @ (vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + EPSILON)).T
    d = (queries**2).sum(1)[:, None] + (vectors**2).sum(1)[None] - 2 * queries @ vectors.T
    return -np.maximum(d, 0)


class _Best:
    """The best ``k`` of each query so far: rounded score, then id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores: list[np.ndarray] = [np.zeros(0)] * n
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        if len(s) > self.k:
            key = np.round(s, RANK_DECIMALS)
            cut = np.partition(key, len(key) - self.k)[len(key) - self.k]
            keep = np.flatnonzero(key >= cut)
            keep = keep[np.lexsort((i[keep], -key[keep]))][: self.k]
            s, i = s[keep], i[keep]
        self.scores[q], self.ids[q] = s, i

    def compare(self, who: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, metric: str) -> None:
        """Add rows to the queries at the places ``who``, so many at once that the scores stay few."""
        step = max(1, SCORES // max(1, len(queries)))
        for at in range(0, len(vectors), step):
            s = _score(queries, vectors[at : at + step], metric)
            for j, i in enumerate(who):
                self.add(i, s[j], ids[at : at + step])


def _blocks(queries: DataFrame, qid: str, vector: str) -> Iterator[tuple[list[int], np.ndarray]]:
    """The queries, block by block: each is of one dimension, and small enough for driver and tasks."""
    rows = queries.select(F.col(qid).cast("bigint").alias("q"), F.col(vector).alias("v")).where(F.size("v") > 0)
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect()
    for width, count in sizes:
        n = max(1, -(-width * count * 8 // BLOCK_BYTES))
        mine = rows.where(F.size("v") == width)
        for b in range(n):
            got = mine.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b) if n > 1 else mine
            got = got.orderBy("q").toArrow()
            places, block = _rows(got["v"].combine_chunks(), width)
            if len(places):
                yield got["q"].take(places).to_pylist(), block


HITS = "query_id long, id long, score double"


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", qid: str = "query_id", vid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` nearest rows to each query, itself included.

    ``metric`` is ``cosine`` or ``l2`` (score: negative squared distance).  Ties go to
    the least id.  A query is compared with the vectors of its own length; null
    and empty vectors have no neighbours and are no one's.  Rows that repeat an
    id are rows.
    """
    spark = vectors.sparkSession
    found = empty(spark, HITS)
    for ids, block in _blocks(queries, qid, vector):
        sent = spark.sparkContext.broadcast((np.array(ids), block))  # BLOCK_BYTES

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            best = _Best(len(q), k)
            for vid_, v in _together(batches, q.shape[1]):
                best.compare(np.arange(len(q)), q, v, vid_, metric)
            yield _hits(names, best)

        found = found.union(vectors.select(F.col(vid).cast("bigint"), F.col(vector)).mapInArrow(run, HITS))
    return _ranked(found, k)


def _hits(names: np.ndarray, best: _Best) -> pa.RecordBatch:
    n = [len(x) for x in best.ids]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(names, n), pa.int64()), pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*best.scores, np.zeros(0)]), pa.float64())],
        names=["query_id", "id", "score"],
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", RANK_DECIMALS)), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_cells(vectors: DataFrame, centers: np.ndarray, vector: str = "embedding") -> DataFrame:
    """``vectors`` with the cell of the nearest center; every row gets one, -1 if its vector can't be compared."""
    sent = vectors.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            cells = np.full(batch.num_rows, -1, np.int32)
            places, v = _rows(batch.column(at), c.shape[1])
            step = max(1, SCORES // len(c))
            for a in range(0, len(places), step):
                cells[places[a : a + step]] = np.argmax(_score(v[a : a + step], c, "l2"), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, "cell"])

    at = vectors.columns.index(vector)
    return vectors.mapInArrow(run, StructType([*vectors.schema.fields, StructField("cell", IntegerType())]))


def train_cells(vectors: DataFrame, cells: int, sample_rows: int = 20_000, rounds: int = 12, vector: str = "embedding", vid: str = "vec_id") -> np.ndarray:
    """Centers by k-means over a sample of at most about ``sample_rows`` rows, chosen by a hash of the id."""
    rows = vectors.select(F.col(vid), F.col(vector).alias("v")).where("v is not null")
    n = max(1, rows.count())
    draw = F.pmod(F.xxhash64(F.col(vid)), F.lit(1_000_003))
    got = rows.where(draw < min(1_000_003, 1_000_003 * sample_rows // n)).orderBy(vid).toArrow()
    if not got.num_rows:
        return np.zeros((1, 1))
    width = max(len(x) for x in got["v"].to_pylist())
    x = _rows(got["v"].combine_chunks(), width)[1]
    centers = x[np.random.default_rng(0).permutation(len(x))[: min(cells, len(x))]]
    for _ in range(rounds):
        mine = np.argmax(_score(x, centers, "l2"), axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, mine, x)
        many = np.bincount(mine, minlength=len(centers))[:, None]
        centers = np.where(many > 0, sums / np.maximum(many, 1), centers)
    return centers


def nearest_in_cells(queries: DataFrame, indexed: DataFrame, centers: np.ndarray, k: int, probes: int, qid: str = "query_id", vid: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """:func:`nearest` by cosine among the rows of each query's ``probes`` nearest cells only.

    ``indexed`` has a column ``cell``; kept as its partition column on disk, cells
    that no query of a block probes aren't read.  A crowded cell is no more than
    many rows for many tasks.
    """
    spark = indexed.sparkSession
    found = empty(spark, HITS)
    for ids, block in _blocks(queries, qid, vector):
        if block.shape[1] != centers.shape[1]:
            continue  # no row of this dimension has a cell
        near = np.argsort(-_score(block, centers, "l2"), axis=1, kind="stable")[:, :probes]
        sent = spark.sparkContext.broadcast((np.array(ids), block, near))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q, probed = sent.value
            best = _Best(len(q), k)
            for batch in batches:
                places, v = _rows(batch.column(1), q.shape[1])
                vid_, cell = (batch.column(j).to_numpy(zero_copy_only=False)[places] for j in (0, 2))
                for c in np.unique(cell):
                    who, rows = np.flatnonzero((probed == c).any(axis=1)), np.flatnonzero(cell == c)
                    if len(who):
                        best.compare(who, q[who], v[rows], vid_[rows], "cosine")
            yield _hits(names, best)

        rows = indexed.select(F.col(vid).cast("bigint"), F.col(vector), "cell").where(F.col("cell").isin(np.unique(near).tolist()))
        found = found.union(rows.mapInArrow(run, HITS))
    return _ranked(found, k)


def probes_for(indexed: DataFrame, centers: np.ndarray, k: int, target: float = 0.95, sample_rows: int = 64, vid: str = "vec_id", vector: str = "embedding") -> int:
    """How many cells to probe so that ``target`` of the ``k`` exact neighbours are found.

    Measured on ``sample_rows`` rows as queries, chosen by a hash of the id,
    against all rows: one exact search says in which of a query's cells, by
    nearness, its neighbours are.
    """
    asked = indexed.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(vid)), vid).limit(sample_rows).select(F.col(vid).alias("query_id"), F.col(vector).alias("embedding"))
    found = nearest(asked, indexed, k, vid=vid, vector=vector)
    cells = found.join(indexed.select(F.col(vid).alias("id"), "cell"), "id").select("query_id", "cell").toArrow()  # at most sample_rows * k rows
    place = {}
    for ids, block in _blocks(asked, "query_id", "embedding"):
        if block.shape[1] != centers.shape[1]:
            continue
        order = np.argsort(np.argsort(-_score(block, centers, "l2"), axis=1, kind="stable"), axis=1)
        place |= dict(zip(ids, order, strict=True))
    ranks = [int(place[q][c]) for q, c in zip(cells["query_id"].to_pylist(), cells["cell"].to_pylist(), strict=True) if c >= 0 and q in place]
    if not ranks:
        return len(centers)
    share = np.cumsum(np.bincount(ranks, minlength=len(centers))) / len(ranks)
    return int(np.searchsorted(share, target)) + 1


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(query_id, n, hit, recall): the share of each query's exact neighbours that the other search found."""
    both = exact.select("query_id", "id").join(approximate.select("query_id", "id", F.lit(1).alias("got")), ["query_id", "id"], "left")
    sums = both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("got").alias("hit"))
    return sums.withColumn("recall", F.col("hit") / F.col("n"))
