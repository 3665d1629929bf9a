"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source with target weight ``w`` and ``n`` of all ``N`` documents is repeated
``w * N / n`` times on average.  Each document draws its own count by inverting
the Poisson distribution with that mean at a uniform number that is a hash of
seed, doc_id and text: the same document gets the same count in every run and on
every machine.  Copies are then dealt out by a second hash, which is also their
order, so that the whole set is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import materialize, settled

SEED = 17
#: Default target weight of a source: its share of documents to this power, scaled.
POWER = 0.5
#: A mean above this is drawn as a sum of several draws, so that exp(-mean) stays exact.
CHUNK = 32.0
TABLE = 128
#: Sources whose table of a kilobyte each may be broadcast.
BROADCAST_SOURCES = 20_000


def _hash(digits: int, *parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, digits), 16, 10).cast("bigint")


def _cdf(mean: Column) -> Column:
    """P(X <= k) for k in 0..TABLE-1."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), start, step, lambda s: s["all"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER) -> DataFrame:
    """(source, n, rate, chunks, cdf) of each source of ``docs``; rows without source form one of their own.

    ``weights`` gives target weights by source, scaled to sum to one (a source that it
    leaves out has weight 0); by default a weight is the document count to ``power``.
    """
    counts = materialize(docs.groupBy("source").agg(F.count("*").alias("n")), "sources")
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(power))))
    else:
        w = F.lit(0.0)
        for name, weight in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(w)
        weighed = counts.withColumn("w", w)
    total = weighed.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    rate = F.col("w") / F.lit(total["w"]) * F.lit(total["n"]) / F.col("n") if total["w"] else F.lit(0.0)
    found = weighed.withColumn("rate", rate)
    found = found.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int"))
    return found.select("source", "n", "rate", "chunks", _cdf(F.col("rate") / F.col("chunks")).alias("cdf"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, power: float = POWER, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with each row as often as it is drawn, shuffled, plus copy_no, rate and shuffle_key.

    text may be null, empty or of any length.
    Draw and place come from doc_id and text together, so that rows without
    doc_id, and others that share one, draw each for itself unless they are equal.
    Rows of one shuffle_key are ordered by doc_id and copy_no.  An empty table
    gives an empty result.  Columns of ``docs`` named copy_no, rate
    or shuffle_key are replaced.
    """
    docs = docs.drop("copy_no", "rate", "shuffle_key")
    table = settled(docs.sparkSession, "rates", lambda: rates(docs, weights, power)).select(F.col("source").alias("__source"), "rate", F.col("chunks").alias("__chunks"), F.col("cdf").alias("__cdf"))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))

    # numbers first: inside the filter they would be worked out for each entry of the table
    numbers = F.transform(F.sequence(F.lit(0), F.col("__chunks") - 1), lambda j: (_hash(13, F.lit(f"{seed}:poisson"), F.col("__name"), j.cast("string")) + F.lit(0.5)) / F.lit(float(2**52)))
    drawn = F.aggregate(numbers, F.lit(0), lambda sum_, u: sum_ + F.size(F.filter(F.col("__cdf"), lambda c: c < u)))
    mixed = docs.withColumn("__name", name).join(table, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__count", drawn).where("__count > 0")
    copies = mixed.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__count")))).drop("__source", "__chunks", "__cdf", "__count")
    keyed = copies.withColumn("shuffle_key", _hash(15, F.lit(f"{seed}:shuffle"), F.col("__name"), F.col("copy_no").cast("string"))).drop("__name")
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy_no")
