"""Tables that last for one run, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch handed to Python.  Texts are long, so a batch stays small.
BATCH_ROWS = 512
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds at a time.

    Plans read the setting when they run, so it can't be put back before; a
    session that asks for smaller batches keeps its own.
    """
    if not 0 < int(spark.conf.get(_SETTING)) <= BATCH_ROWS:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


def empty(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """A table without rows; unlike one made of an empty list, it starts no Python."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and one JVM does all the work (local tests) a
    temporary folder takes its place; it is then put into the session so that
    later calls use the same one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table at ``path``, of which the caller can dispose.

    Cuts the lineage: a lost executor costs a reread of files, not a
    recomputation, and several consumers share one evaluation.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table that :func:`written` gave."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)
