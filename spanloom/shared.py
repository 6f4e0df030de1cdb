"""Relations that several branches of a plan read are written once, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which the whole cluster shares. Unset, it is an error but in local mode, where a private folder is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanloom-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote, wherever it is."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read from there, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Splits a core from which on a table's files are dealt out as they are.
SPLITS = 2


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files may not give so many tasks: a row group is read by one, however many splits its file has.

    Up to SPLITS splits a core the rows are dealt out evenly; larger tables have many row groups, and stay as they are.
    """
    wanted = SPLITS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


#: Most rows that a side may have to be broadcast; each caller's rows are under 200 bytes.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most so many rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows
