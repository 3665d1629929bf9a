"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import drop_path, fresh_path, written


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v) plus m, the least of u and of all v of u.  The minimum is combined map-side."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): root is the least node reachable.

    Self loops and repeated edges are harmless; an empty input gives an empty
    result.  No group is ever collected: each step is a minimum per node and a
    join, whose hot keys the adaptive skew join can split.  Each round is
    written to the shared folder, and the one before it removed.  Nodes without an edge are absent.
    """
    spark = edges.sparkSession
    path = fresh_path(spark, "edges")
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), path)
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _min_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _min_neighbour(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        hooked = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        done, path = path, fresh_path(spark, "edges")
        now = written(hooked.where("u <> v").distinct(), path)
        drop_path(spark, done)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
