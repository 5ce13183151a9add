"""Cutting lineage with tables that every executor can read again, whichever of them are lost."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`. Where none is set, a session on this machine alone gets a temporary folder; on a cluster that raises."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        set_at = context._jsc.sc().getCheckpointDir()
        if set_at.isDefined():
            folder = set_at.get()
        elif context.master.startswith("local["):
            context.setCheckpointDir(tempfile.mkdtemp())
            folder = context._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can read")
    return folder.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """`df` written as Parquet below the shared folder and read from there, columns pruned as by any scan; removed when the session ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
