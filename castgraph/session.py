"""Session helpers: reading tables, and cutting lineage in a folder that every executor shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, None] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named parquet table; a file or a folder of part files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. A session on one machine may lack it and then gets its own; a cluster may not."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="castgraph-"))
    return context.getCheckpointDir().get()


def _located(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from a table written to the shared folder, so that a lost executor costs no recomputation.

    Unlike a checkpoint it is computed once, and its later readers see its size and only its columns they need. The table is deleted
    by `release`, by `clean`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _located(spark, path)
    files.deleteOnExit(where)
    _written[path] = None
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames that `cut` gave; nothing that reads them may still be waiting to be computed."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path in _written:
            del _written[path]
            files, where = _located(df.sparkSession, path)
            files.delete(where, True)


def clean(spark: SparkSession) -> None:
    """Delete all tables written by `cut`; results that were not yet computed can't be afterwards."""
    while _written:
        files, where = _located(spark, _written.popitem()[0])
        files.delete(where, True)
