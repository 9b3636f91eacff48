"""Intermediate results that several parts of a plan read, and tables small enough to be broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a table is broadcast.
SMALL_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A local session without one gets a folder of its own on this machine; on a cluster, whose executors could not see
    that, the setting is demanded.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not named:
            import tempfile

            named = tempfile.mkdtemp("checkpoints")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """``df`` computed once: written as a table in the shared folder, and read again with its true size."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read any more."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        if "/tables/" in file and folder.rpartition("/")[2] in file:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path.getParent(), True)
            return


def sized(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` staged, and marked for broadcast if it has ``most`` rows at most; else joins shuffle it."""
    from pyspark.sql import functions as F

    kept = staged(df)
    return F.broadcast(kept) if kept.count() <= most else kept
