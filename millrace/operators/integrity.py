"""Whether vectors and their metadata belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import strip

SAMPLE = 10
PROBLEMS = ("missing_metadata", "orphan_metadata", "empty_content")


def check(vectors: DataFrame, metadata: DataFrame, key: str = "chunk_id", content: str = "chunk_content") -> DataFrame:
    """(key, problem) of each key that isn't well: ``missing_metadata``, ``orphan_metadata``, ``empty_content`` or ``valid``.

    One full outer join on the key; repeated keys on a side are taken once.
    """
    v = vectors.select(key).distinct().withColumn("__v", F.lit(True))
    m = metadata.groupBy(key).agg(F.max(F.coalesce(F.length(strip(F.col(content))), F.lit(0))).alias("__n"))
    both = v.join(m, key, "full_outer")
    problem = (
        F.when(F.col("__n").isNull(), "missing_metadata").when(F.col("__v").isNull(), "orphan_metadata").when(F.col("__n") == 0, "empty_content").otherwise("valid")
    )
    return both.select(key, problem.alias("problem"))


def report(vectors: DataFrame, metadata: DataFrame, key: str = "chunk_id", content: str = "chunk_content") -> DataFrame:
    """One row of counts, with the least ten keys of each problem and whether all is well.

    The samples are a top-ten of each problem, cut down before the shuffle.
    """
    found = check(vectors, metadata, key, content)
    n = lambda p: F.count_if(F.col("problem") == p)
    samples = [f"{p}_sample" for p in PROBLEMS]
    none = F.lit(None).cast(f"array<{found.schema[key].dataType.simpleString()}>")
    counts = found.agg(
        F.count_if(F.col("problem") != "orphan_metadata").alias("total_vectors"), F.count_if(F.col("problem") != "missing_metadata").alias("total_metadata"),
        n("valid").alias("valid_mappings"), n("missing_metadata").alias("missing_metadata_count"), n("orphan_metadata").alias("orphan_metadata_count"), n("empty_content").alias("empty_contents_count"),
    )
    names = counts.columns
    order = F.row_number().over(Window.partitionBy("problem").orderBy(key))
    worst = found.where("problem <> 'valid'").withColumn("__r", order).where(F.col("__r") <= SAMPLE)
    worst = worst.agg(*[F.sort_array(F.collect_list(F.when(F.col("problem") == p, F.col(key)))).alias(f"{p}_sample") for p in PROBLEMS])
    both = counts.select("*", *[none.alias(s) for s in samples]).unionByName(worst, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in (*names, *samples)])
    return one.withColumn("is_healthy", (F.col("missing_metadata_count") + F.col("orphan_metadata_count") + F.col("empty_contents_count")) == 0)
