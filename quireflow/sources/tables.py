"""Readers for the parquet tables of a dataset directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` below `sf_dir`; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, stamp: str = "loaded_at") -> DataFrame:
    """One row per `key`, the one delivered last. Rows with a null key stay as they are.

    The rows of one key are equal but for the stamp, so the aggregate is combined on the
    map side and a key delivered very often does not meet in one task.
    """
    cols = [c for c in df.columns if c != key]
    packed = F.max_by(F.struct(*cols), F.coalesce(F.col(stamp), F.lit("1900-01-01").cast("timestamp_ntz")))
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(packed.alias("_r")).select(key, "_r.*")
    return keyed.select(*df.columns).unionByName(df.where(F.col(key).isNull()))


def blocks(pages: DataFrame, *fields: str, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per block of `parsing_res_list` with its 1-based place in the page.

    Null arrays give no row, nor do elements that are null or hold nothing in any of the named fields. Only these fields
    are read from the files: each is taken out of the array before the array is opened.
    """
    apart = pages.select(*keep, *[F.col(f"parsing_res_list.{f}").alias(f"_f{k}") for k, f in enumerate(fields)])
    e: Column = F.posexplode(F.arrays_zip(*[f"_f{k}" for k in range(len(fields))])).alias("_p", "_b")
    some = " OR ".join(f"_b._f{k} IS NOT NULL" for k in range(len(fields)))
    return apart.select(*keep, e).where(some).select(*keep, (F.col("_p") + 1).cast("int").alias("ord"), *[F.col(f"_b._f{k}").alias(f) for k, f in enumerate(fields)])


def spread(df: DataFrame) -> DataFrame:
    """`df`, a scan or a narrow plan over one, in at least as many parts as the session runs tasks at once.

    For work that costs far more time a row than moving the row does. Scans of a real corpus have
    more parts than that and are left as they are.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= n else df.repartition(n)
