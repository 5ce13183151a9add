"""Keyed tables in Parquet: content-addressed keys, upserts, resumption, verified publication.

A keyed table is a folder of versions. A version is written whole beside the others and becomes
the current one when its name is written into `CURRENT`, which is one atomic rename; readers see
the old version or the new one, never a part. One driver writes a table at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that would leave their folder, private names and forms of credentials.
UNSAFE_KEY = "(^|[/\\\\])\\.\\.([/\\\\]|$)|^[/\\\\]|^[A-Za-z]:|\\x00|^$"


def content_key(*columns: Column) -> Column:
    """Hash of a canonical JSON of the columns; scheduling settings must not be among them."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def checked(artifacts: DataFrame) -> DataFrame:
    """(name, content, sha256) with the content verified; one false checksum fails the query."""
    ok = F.sha2("content", 256) == F.col("sha256")
    return artifacts.withColumn("content", F.when(ok, F.col("content")).otherwise(F.raise_error(F.concat(F.lit("checksum of "), "name"))))


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows of both, the latest of each key; of equal stamps the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(F.col(stamp), F.col("_new")))
    return both.groupBy(key).agg(best.alias("_r")).select(key, "_r.*").select(*old.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """`old` and the rows of `new` under new keys. Different values under one key fail the query."""
    both = old.select(key, value, F.lit(0).alias("_new")).unionByName(new.select(key, value, F.lit(1).alias("_new")))
    g = both.groupBy(key).agg(F.min_by(value, "_new").alias(value), F.min(value).alias("_a"), F.max(value).alias("_b"))
    kept = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.col(value)).otherwise(F.raise_error(F.concat(F.lit("conflict under "), F.col(key))))
    return g.select(key, kept.alias(value))


def pending(requests: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Requests without an answer, each once."""
    return requests.dropDuplicates([key] if isinstance(key, str) else key).join(done, key, "left_anti")


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, path: str) -> str | None:
    fs, hpath = _fs(spark, path)
    if not fs.exists(hpath(f"{path}/CURRENT")):
        return None
    stream = fs.open(hpath(f"{path}/CURRENT"))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(df: DataFrame, path: str, version: str, check=None) -> DataFrame:
    """Write `df` as `version`, read it again, let `check` judge it, then make it current.

    If the check returns false or raises, the candidate stays beside the current version and
    the published table is as it was.
    """
    spark = df.sparkSession
    fs, hpath = _fs(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/{version}")
    written = spark.read.parquet(f"{path}/{version}")
    if check is not None and not check(written):
        raise ValueError(f"version {version} was not published: its check failed")
    mark = f"{path}/CURRENT.{version}.{uuid.uuid4().hex}"
    out = fs.create(hpath(mark), True)
    out.write(bytearray(version.encode()))
    out.close()
    # One rename that replaces what is there: a reader finds the old mark or the new one, at no time none.
    jvm = spark._jvm
    over = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    kinds = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    kinds[0] = over
    target = fs.makeQualified(hpath(f"{path}/CURRENT"))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(hpath(mark)), target, kinds)
    return written


def read_current(spark: SparkSession, path: str) -> DataFrame | None:
    version = current_version(spark, path)
    return spark.read.parquet(f"{path}/{version}") if version else None


def staged(current: DataFrame, pending: DataFrame, published: DataFrame, key: str, owner: str) -> DataFrame:
    """`current` with the pending rows of owners that were published in place of theirs; other pending rows wait."""
    taken = pending.join(published.select(owner).distinct(), owner, "left_semi")
    return current.join(taken.select(owner).distinct(), owner, "left_anti").unionByName(taken)


def same_content(before: DataFrame, after: DataFrame, key: str, value: str) -> bool:
    """Whether two tables hold equal values under equal keys, each as often; decided without bringing rows to the driver."""
    both = before.select(key, value, F.lit(1).alias("_n")).unionByName(after.select(key, value, F.lit(-1).alias("_n")))
    return both.groupBy(key, value).agg(F.sum("_n").alias("_n")).where("_n <> 0").isEmpty()


def resolve(references: DataFrame, stores: DataFrame) -> DataFrame:
    """(ref, db, key, way) of each `ref`; `stores` has one `name` for each store.

    `store::key` names both (way store, or missing where there is no such store); a path below a folder that has a store is a
    key of it (parent); any other path stands for itself (path).
    """
    p = F.split("ref", "::", 2)
    named = F.size(p) == 2
    cut = F.instr("ref", "/")
    r = references.select("ref", named.alias("_named"), F.when(named, p[0]).otherwise(F.expr("substring(ref, 1, instr(ref, '/') - 1)")).alias("_db"), F.when(named, F.get(p, F.lit(1))).otherwise(F.substr("ref", cut + 1)).alias("_key"))
    j = r.join(stores.select(F.col("name").alias("_db"), F.lit(True).alias("_there")), "_db", "left")
    there = F.coalesce("_there", F.lit(False))
    way = F.when(F.col("_named"), F.when(there, "store").otherwise("missing")).when(there, "parent").otherwise("path")
    return j.select("ref", F.when(there, F.col("_db")).alias("db"), F.when(there, F.col("_key")).otherwise(F.col("ref")).alias("key"), way.alias("way"))


#: Endings of a document's artifacts and reviews, and files of a cache kept apart by source.
ARTIFACTS = ("_report.json", "_layout.json", ".md", "_layout_review.json", "_line_ocr_review.json")
CACHED = ("pruned.json", "text.md", "meta.json", "partial.json")


def compaction(files: DataFrame, reports: DataFrame, stem: str) -> DataFrame:
    """(stem, name) of the files to pack into a document's table.

    `files`: (stem, name). Chosen are artifacts and reviews by name, other JSON and Markdown of the document with `_layout_` in
    the name, shards of its boundary checkpoint, and the files of a cache kept apart by source if one of the document's own
    `reports` (stem, fingerprint) names it; caches of other documents stay.
    """
    name, own = F.col("name"), F.col(stem)
    rest = F.when(F.startswith(name, own), F.expr(f"substring(name, length(`{stem}`) + 1)"))
    text = name.rlike("[.](json|md)$")
    by_name = rest.isin(*ARTIFACTS) | (F.startswith(rest, F.lit("_")) & F.contains(name, F.lit("_layout_")) & text) | (F.startswith(rest, F.lit("_boundary_cache.json.pages/")) & F.endswith(name, F.lit(".json")))
    named = files.where(F.coalesce(by_name, F.lit(False))).select(stem, "name")
    part = F.split("name", "/")
    apart = files.where((F.size(part) == 3) & (part[0] == ".ocr_cache") & part[2].isin(*CACHED)).withColumn("fingerprint", part[1])
    return named.unionByName(apart.join(reports, [stem, "fingerprint"], "left_semi").select(stem, "name")).distinct()
