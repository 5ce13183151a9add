"""Structured Streaming over profile samples and events.

`summarize_batch` runs a stream of files to its end and gives its result as a table, so that the
same plan serves a live folder and a check against SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators.lineage import shared_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of an events file or folder; event time is a zoned timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") and not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each kind of event in tumbling windows; later events than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def fresh_only(samples: DataFrame, most: float) -> DataFrame:
    """Samples whose probe is fresh."""
    return samples.where(F.coalesce(F.col("age_seconds") <= most, F.lit(False)))


def to_table(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and give its result (of the size of its groups)."""
    name = "stream_" + uuid.uuid4().hex
    folder = f"{shared_folder(spark)}/{name}"
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return spark.table(name)
