"""Quality by perplexity under an interpolated modified Kneser-Ney character model.

The model has order four over code points as they are: no two characters share
a symbol, so it grows with what it is trained on, and it stays in tables.  Counts
come from all trusted texts: each task sums its own, the sums are combined by
n-gram.  Texts are dealt into blocks; the different four-grams of each block are
joined to the counts of n-grams and contexts of all orders, and the answers go
to where the block's texts lie, packed and in buckets, so that each text is
scored whole and written once.  A text is kept if its perplexity is no more than
a quantile of trusted texts of its language that the model hasn't seen: half of
them train it, and the other half gives the quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import in_buckets, materialize, pick, scratch, settled, small_batches

ORDER = 4
#: Symbols: each code point plus one; 0 pads and ends a text.  Three of them fit into 63 bits.
CODES = 0x110001
QUANTILE = 0.995
#: Trusted ids that may be broadcast, of eight bytes each.
BROADCAST_IDS = 2_000_000
#: N-grams that a task holds before it passes its counts on.
FLUSH = 1 << 21
#: Bytes of text from which on a block is full; a block asks once for each of its four-grams, so larger ones ask less.
BLOCK = 1 << 24


def _windows(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The four symbols of each four-gram of the texts, padded before, with one pad as their end, and the number of four-grams of each text."""
    parts = [np.frombuffer(t.encode("utf-32-le", "replace"), np.int32) for t in texts]
    sizes = np.array([len(x) + 1 for x in parts], np.int64)
    pad = np.zeros(ORDER - 1, np.int32)
    codes = np.concatenate([y for x in parts for y in (pad, x + 1, pad[:1])] + [pad[:0]])
    inside = np.ones(len(codes), bool)  # the last three symbols of a text start no four-gram
    ends = np.cumsum(sizes + ORDER - 1)
    for j in range(1, ORDER):
        inside[ends - j] = False
    starts = np.flatnonzero(inside)
    return [codes[starts + j] for j in range(ORDER)], sizes


def _context(symbols: list[np.ndarray]) -> np.ndarray:
    a, b, c = (x.astype(np.int64) for x in symbols[:3])
    return (a * CODES + b) * CODES + c


def _coder(symbols: list[np.ndarray]) -> Callable[[list[np.ndarray]], np.ndarray]:
    """What makes one sortable key of each four-gram of these symbols."""
    there = np.zeros(CODES, bool)
    for x in symbols:
        there[x] = True
    alphabet = np.flatnonzero(there)
    n = len(alphabet)
    if n**ORDER >= 1 << 63:
        return lambda four: np.stack(four, axis=1).astype(">i4").view(f"S{4 * ORDER}")[:, 0]
    place = np.zeros(CODES, np.int64)
    place[alphabet] = np.arange(n)
    return lambda four: ((place[four[0]] * n + place[four[1]]) * n + place[four[2]]) * n + place[four[3]]


def _distinct(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, symbol, count) of the different four-grams of the texts."""
    four, _ = _windows(texts)
    _, first, c = np.unique(_coder(four)(four), return_index=True, return_counts=True)
    four = [x[first] for x in four]
    return _context(four), four[3], c


def grams(text: str) -> list[int]:
    """Ids of the four-grams of a text: its symbols as digits to the base of ``CODES``."""
    four, _ = _windows([text])
    return [int(context) * CODES + int(symbol) for context, symbol in zip(_context(four), four[3], strict=True)]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """doc_ids whose every label says quality 1."""
    return pick(labels, "doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def counts(texts: DataFrame) -> DataFrame:
    """(gram: its context and symbol, c: long) over all rows of ``texts`` (text)."""
    small_batches(texts.sparkSession)
    names = ["context", "symbol", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by(names[:2], use_threads=False).aggregate([("c", "sum")]).select(["context", "symbol", "c_sum"]).rename_columns(names)

        for batch in batches:
            part = [x for x in batch.column(0).to_pylist() if x]
            if not part:
                continue
            held.append(pa.Table.from_arrays([pa.array(x) for x in _distinct(part)], names=names))
            size += len(held[-1])
            if size > FLUSH:
                held = [summed()]
                if len(held[0]) > FLUSH // 2:
                    yield from held[0].to_batches()
                    held = []
                size = sum(map(len, held))
        if held:
            yield from summed().to_batches()

    got = texts.select("text").mapInArrow(run, "context long, symbol int, c long").groupBy("context", "symbol").agg(F.sum("c").alias("c"))
    return got.select(F.struct("context", "symbol").alias("gram"), "c")


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and more; 0.5 a count where there are too few to tell."""
    n = table.agg(*[F.coalesce(F.sum(F.when(F.col("c") == i, 1)), F.lit(0)) for i in (1, 2, 3, 4)]).first()
    if not all(n):
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)]


def _discount(d: list[float], c: str = "c") -> Column:
    return F.when(F.col(c) == 1, d[0]).when(F.col(c) == 2, d[1]).otherwise(d[2])


#: For each order: counts of n-grams (context, symbol, c), sums of contexts (context, total, held) and discounts.
Model = list[tuple[DataFrame, DataFrame, list[float]]]


def fit(texts: DataFrame) -> Model:
    """The model of all rows of ``texts`` (text).  Its tables stay where they were written; the driver only gets the discounts."""
    orders = [materialize(counts(texts).select("gram.*", "c"), "grams")]
    for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before
        shorter = orders[0].groupBy((F.col("context") % CODES ** (k - 1)).alias("context"), "symbol").agg(F.count("*").alias("c"))
        orders.insert(0, materialize(shorter, "grams"))
    out = []
    for seen in orders:
        d = _discounts(seen)
        totals = seen.groupBy("context").agg(F.sum("c").alias("total"), F.sum(_discount(d)).alias("held"))
        out.append((seen, materialize(totals, "contexts"), d))
    return out


def probabilities(asked: DataFrame, model: Model) -> DataFrame:
    """(context, symbol, p) for the different four-grams ``asked`` (context, symbol): a join by n-gram, context and suffix for each order."""
    levels = [materialize(asked.select("context", "symbol").distinct(), "asked")]
    for k in range(ORDER - 1, 0, -1):
        shorter = levels[0].select((F.col("context") % CODES ** (k - 1)).alias("context"), "symbol").distinct()
        levels.insert(0, materialize(shorter, "asked"))
    below = None
    for k, (level, (seen, totals, d)) in enumerate(zip(levels, model, strict=True), 1):
        parts = level.join(seen, ["context", "symbol"], "left").join(totals, "context", "left")
        if below is None:
            parts = parts.withColumn("below", F.lit(1 / CODES))
        else:
            shorter = below.select(F.col("context").alias("suffix"), "symbol", F.col("p").alias("below"))
            parts = parts.withColumn("suffix", F.col("context") % CODES ** (k - 2)).join(shorter, ["suffix", "symbol"])
        p = F.coalesce((F.col("c") - _discount(d)) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("held") / F.col("total"), F.lit(1.0)) * F.col("below")
        below = materialize(parts.select("context", "symbol", p.alias("p")), "kn")
    return below


class _Rows:
    """log p of all symbols, a row for each context of four-grams that was seen, in order."""

    def __init__(self, table: SmallTable) -> None:
        self.table = table

    def __getitem__(self, which: slice) -> np.ndarray:
        return np.log(np.stack([self.table.row(context) for context in sorted(self.table.totals[-1])[which]]))


class SmallTable:
    """A model that fits into memory, for a look at single probabilities; queries don't use it."""

    def __init__(self, model: Model) -> None:
        self.totals = [{r["context"]: (r["total"], r["held"]) for r in totals.collect()} for _, totals, _ in model]
        self.shares: list[dict[int, dict[int, float]]] = []
        for (seen, _, d), totals in zip(model, self.totals, strict=True):
            shares: dict[int, dict[int, float]] = {}
            for r in seen.collect():
                shares.setdefault(r["context"], {})[r["symbol"]] = (r["c"] - d[min(r["c"], 3) - 1]) / totals[r["context"]][0]
            self.shares.append(shares)

    def row(self, context: int) -> np.ndarray:
        out = np.full(CODES, 1 / CODES)
        for k, (totals, shares) in enumerate(zip(self.totals, self.shares, strict=True), 1):
            at = context % CODES ** (k - 1)
            if at in totals:
                out *= totals[at][1] / totals[at][0]
                out[list(shares[at])] += list(shares[at].values())
        return out

    def __getitem__(self, gram: int) -> float:
        return math.log(self.row(gram // CODES)[gram % CODES])

    def reshape(self, *shape: int) -> _Rows:
        if shape != (-1, CODES):
            raise ValueError("rows of all symbols only")
        return _Rows(self)


def log_table(model: Model) -> SmallTable:
    """log p of any four-gram of a small model."""
    return SmallTable(model)


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, packed, context, symbol): a row for each block with its packed rows of ``docs``, and one for each of its different four-grams."""
    kind = pa.schema([("block", pa.int64()), ("packed", pa.binary()), ("context", pa.int64()), ("symbol", pa.int32())])

    names = ["context", "symbol"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        sink = stream = None
        held: list[pa.Table] = []

        def sent() -> Iterator[pa.RecordBatch]:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([block], [sink.getvalue().to_pybytes()], [None], [None]), kind, strict=True)], schema=kind)
            if held:
                for part in pa.concat_tables(held).group_by(names, use_threads=False).aggregate([]).to_batches():
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), part["context"], part["symbol"]], schema=kind)

        for batch in batches:
            if stream is None:
                sink, held, size = pa.BufferOutputStream(), [], 0
                stream = pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            stream.write_batch(batch)
            if texts := [x for x in batch.column(2).to_pylist() if x]:
                held.append(pa.Table.from_arrays([pa.array(x) for x in _distinct(texts)[:2]], names=names))
            size += batch.column(2).nbytes
            if size >= BLOCK:
                yield from sent()
                block, stream = block + 1, None
        if stream is not None:
            yield from sent()

    return pick(docs, "doc_id", "lang", "text").mapInArrow(run, "block long, packed binary, context long, symbol int")


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, perplexity) for every row; a null or empty text has none."""
    small_batches(docs.sparkSession)
    blocks = in_buckets(_blocks(docs), "blocks", "block")
    asked = blocks.where("context is not null").select(F.col("block").alias("of"), "context", "symbol")
    answers = asked.join(probabilities(asked, model), ["context", "symbol"]).select("of", "context", "symbol", F.log("p").alias("p"))

    def score(packed: pa.Table, answers: pa.Table) -> pa.Table:
        context, symbol = answers["context"].to_numpy(), answers["symbol"].to_numpy()
        known = [context // CODES**2, context // CODES % CODES, context % CODES, symbol]
        key = _coder(known)
        known = key(known)
        order = np.argsort(known)
        known, p = known[order], answers["p"].to_numpy()[order]
        parts = []
        for batch in (b for x in packed["packed"].to_pylist() for b in pa.ipc.open_stream(x)):
            texts = batch.column(2).to_pylist()
            out = np.full(len(texts), np.nan)
            there = [i for i, x in enumerate(texts) if x]
            if there:
                four, sizes = _windows([texts[i] for i in there])
                out[there] = np.exp(-np.add.reduceat(p[np.searchsorted(known, key(four))], np.cumsum(sizes) - sizes) / sizes)
            parts.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64(), from_pandas=True)], names=["doc_id", "lang", "perplexity"]))
        return pa.Table.from_batches(parts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = blocks.where("packed is not null").select("block", "packed").groupBy("block")
    return texts.cogroup(answers.groupBy("of")).applyInArrow(score, f"doc_id {kind}, lang string, perplexity double")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, keep) for every row of ``docs`` (doc_id, text, lang).

    Trusted texts are those whose doc_id has quality 1 in ``labels`` (doc_id,
    quality; of contradicting labels the lower counts).  A hash of doc_id puts
    half of them into the model and the other half into the thresholds: threshold
    is the quantile of their perplexities in the row's lang, null being a lang
    like any other; a lang without such texts takes the quantile of all of them,
    and without any every text is kept.  A perplexity equal to the threshold is
    kept; a null or empty text has no perplexity and isn't.  Texts of any length
    are scored whole.  Repeated rows give repeated results, an empty table an
    empty one; further columns of any name are left out.
    """
    rows = pick(docs, "doc_id", "text", "lang")
    return _classified(settled(docs.sparkSession, "scored", lambda: _scored(rows, labels)), quantile)


def _trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, teaches): the trusted ids, and which of them train the model."""
    return trusted_ids(labels).withColumn("teaches", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0)


def _scored(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, perplexity, held_out): held_out if the text is trusted and not in the model."""
    ids = materialize(_trusted(labels), "trusted")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    model = fit(rows.join(ids.where("teaches"), "doc_id", "left_semi"))
    held_out = ids.where("not teaches").select("doc_id", F.lit(True).alias("held_out"))
    return perplexities(rows, model).join(held_out, "doc_id", "left").withColumn("held_out", F.coalesce("held_out", F.lit(False)))


def _classified(scored: DataFrame, quantile: float) -> DataFrame:
    trusted = scored.where("held_out and perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = trusted.groupBy(F.col("lang").alias("__lang")).agg(cut.alias("own"))
    overall = trusted.agg(cut).first()[0]
    joined = scored.join(by_lang, scored["lang"].eqNullSafe(F.col("__lang")), "left")
    limit = F.coalesce("own", F.lit(overall).cast("double"))
    return joined.select("doc_id", "lang", "perplexity", limit.alias("threshold"), (F.coalesce(F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))), F.lit(False))).alias("keep"))
