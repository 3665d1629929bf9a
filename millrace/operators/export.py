"""The portable form of an index: vectors in order, and a manifest of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources.work import drop_path, fresh_path, written

FORMAT_VERSION = "1.0"
#: Keys of a metadata map that belong to the export itself.
RESERVED = ("ordered_ids", "id_to_idx")
#: Rows of one range of keys, about; a task sorts one range.
RANGE_ROWS = 1_000_000


def _sorted_ranges(vectors: DataFrame, key: str, per_range: int, path: str) -> DataFrame:
    """``vectors`` dealt by ranges of ``key`` and sorted, with ``__at``: range in the upper bits, place in it in the lower 33.

    Written once: rows and counts of the ranges must come from one exchange, as
    each exchange draws its own sample and so its own bounds.
    """
    n = max(1, -(-vectors.count() // per_range))
    dealt = vectors.repartitionByRange(int(n), key).sortWithinPartitions(key)
    return written(dealt.withColumn("__at", F.monotonically_increasing_id()), path)


def _numbered(dealt: DataFrame) -> DataFrame:
    place, part = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("__at", 33)
    counts = dealt.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))  # one row for each range
    firsts = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__first"))
    both = dealt.withColumn("__q", part).join(F.broadcast(firsts), F.col("__q") == F.col("__p"))
    return both.withColumn("ordinal", F.col("__first") + place).drop("__at", "__p", "__q", "__first")


def with_ordinals(vectors: DataFrame, key: str = "chunk_id", per_range: int = RANGE_ROWS) -> DataFrame:
    """``vectors`` with ordinal, their place by key from 0; rows that share a key follow one another.

    The rows are sorted by ranges and kept in the shared folder; a count of
    each range gives its first ordinal, so that no task sees more than its range.
    """
    return _numbered(_sorted_ranges(vectors, key, per_range, fresh_path(vectors.sparkSession, "ordinals")))


def content_metadata(metadata: str = "metadata"):
    """A metadata map without reserved keys and keys that start with an underscore."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(*RESERVED) & ~F.startswith(k, F.lit("_")))


def summary(vectors: DataFrame, model: str, index_type: str = "flat", embedding: str = "embedding") -> DataFrame:
    """One row about an index: version, counts, dimension, model."""
    return vectors.agg(F.count("*").alias("total_vectors"), F.max(F.size(embedding)).alias("vector_dimension")).select(
        F.lit(FORMAT_VERSION).alias("format_version"), "total_vectors", "vector_dimension", F.lit(index_type).alias("index_type"), F.lit(model).alias("embedding_model")
    )


def stats(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """One row: vectors, their dimension and their size in megabytes at four bytes a number."""
    total, width = F.count("*"), F.coalesce(F.max(F.size(embedding)), F.lit(0))
    return vectors.agg(total.alias("total_vectors"), width.alias("dimension"), F.round(F.coalesce(F.sum(F.size(embedding)), F.lit(0)) * 4 / 1048576.0, 4).alias("size_mb"))


def write(vectors: DataFrame, path: str, model: str, completed_at: str, key: str = "chunk_id", index_type: str = "flat", per_range: int = RANGE_ROWS) -> None:
    """Vectors with their ordinals as Parquet in ``path``/vectors, the summary as JSON in ``path``/manifest."""
    spark = vectors.sparkSession
    work = fresh_path(spark, "ordinals")
    _numbered(_sorted_ranges(vectors, key, per_range, work)).write.mode("overwrite").parquet(f"{path}/vectors")
    drop_path(spark, work)
    stored = spark.read.parquet(f"{path}/vectors")
    about = summary(stored, model, index_type).withColumn("completion_timestamp", F.lit(completed_at))
    about.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")  # one row


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Row]:
    """(vectors with vec_id, their ordinal; the manifest's row) of what :func:`write` left in ``path``.

    Raises ValueError where the manifest is of another version, or doesn't agree
    with the vectors about their number or dimension.
    """
    about = spark.read.json(f"{path}/manifest").first()
    vectors = spark.read.parquet(f"{path}/vectors")
    if about is None or about["format_version"] != FORMAT_VERSION:
        raise ValueError(f"{path}: no manifest of version {FORMAT_VERSION}")
    found = summary(vectors, about["embedding_model"]).first()
    for what in ("total_vectors", "vector_dimension"):
        said = about[what] if what in about else None  # JSON leaves nulls out
        if found[what] != said:
            raise ValueError(f"{path}: {what} is {found[what]}, the manifest says {said}")
    return vectors.withColumn("vec_id", F.col("ordinal")), about
