"""Reading tables, tables that last for a while, and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import work
from millrace.sources.work import drop_path, small_batches, written

__all__ = ["drop_path", "fresh_path", "in_buckets", "materialize", "pick", "scratch", "settled", "small_batches", "table", "written"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Paths of tables that are still there, in the order in which they were asked for.
_MADE: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    _MADE.append(work.fresh_path(spark, label))
    return _MADE[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables whose paths were asked for inside."""
    first = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[first:]:
            drop_path(spark, path)
        del _MADE[first:]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back; see :func:`written`."""
    return written(df, fresh_path(df.sparkSession, label))


def in_buckets(df: DataFrame, label: str, column: str) -> DataFrame:
    """:func:`materialize` in as many buckets by ``column`` as a shuffle has partitions: what groups by it reads a bucket in a task, and moves no row.

    Spark keeps buckets of named tables only; the name is gone when this
    returns, the files go with the other tables.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    name = path.rpartition("/")[2].replace("-", "_")
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"drop table {name}")


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """:func:`materialize` of what ``make`` gives; the tables that it made on the way are removed."""
    path = fresh_path(spark, label)
    with scratch(spark):
        return written(make(), path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of any name can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
