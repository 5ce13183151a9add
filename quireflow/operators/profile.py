"""Profiles of runs: metric texts, sample freshness, regions between stage markers, engine and resource peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRIC = "^([A-Za-z_:][A-Za-z0-9_:]*)(\\{[^}]*\\})?\\s+([0-9.eE+-]+|NaN)\\s*$"


def parse_metrics(texts: DataFrame, key: str = "sample", text: str = "text") -> DataFrame:
    """(key, metric, reason, value): values of a metric summed over its labels, apart by finish reason.

    Comments, buckets and lines of another form are left out; a metric that is not there gives no row.
    """
    lines = texts.select(key, F.explode(F.split(F.col(text), "\n")).alias("l")).where(~F.col("l").startswith("#") & F.col("l").rlike(METRIC))
    name = F.regexp_extract("l", METRIC, 1)
    reason = F.regexp_extract("l", 'finished_reason="([^"]*)"', 1)
    rows = lines.select(key, name.alias("metric"), F.when(reason != "", reason).alias("reason"), F.regexp_extract("l", METRIC, 3).cast("double").alias("v"))
    return rows.where(~F.col("metric").endswith("_bucket")).groupBy(key, "metric", "reason").agg(F.sum("v").alias("value"))


def gpu_values(line: Column) -> Column:
    """ARRAY of the four numbers of a sample line, else null."""
    v = F.transform(F.split(line, ","), lambda x: F.when(F.trim(x).rlike("^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), F.trim(x)).cast("double"))
    return F.when((F.size(v) == 4) & F.forall(v, lambda x: x.isNotNull()), v)


def fresh(age: Column, most: float = 10.0) -> Column:
    """Whether a probe is fresh; one without an age is not."""
    return F.coalesce(age <= most, F.lit(False))


def markers(events: DataFrame, kinds: list[str], group: str, at: str, kind: str) -> DataFrame:
    """(group, kind, start, stop): first event of each kind in the given order and the start of the next kind there is.

    Kinds that never came give no row; a marker before the one it should follow fails the query.
    """
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    first = events.where(F.col(kind).isin(kinds)).groupBy(group, kind).agg(F.min(at).alias("start")).withColumn("_o", place)
    w = Window.partitionBy(group).orderBy("_o")
    nxt = F.lead("start").over(w)
    stop = F.when(nxt < F.col("start"), F.raise_error(F.lit("stage markers out of order"))).otherwise(nxt)
    return first.withColumn("stop", stop).drop("_o")


def exact_median(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the exact median of `value` for each key that has one, the null key too, however many rows it has.

    An approximate quantile with a rank error of a ten-thousandth brackets the middle; only the values within the bracket,
    about two in a thousand, meet in a task, and the count below it says which of them is the median.
    """
    v = df.where(F.col(value).isNotNull()).select(F.struct(F.col(key).alias("key")).alias("k"), F.col(value).cast("double").alias("v"))
    near = v.groupBy("k").agg(F.percentile_approx("v", F.array(F.lit(0.499), F.lit(0.501)), 10_000).alias("q"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # Few rows are their own bracket.
    near = near.select("k", "n", F.when(F.col("n") < 5000, F.col("lo")).otherwise(F.col("q")[0]).alias("lo"), F.when(F.col("n") < 5000, F.col("hi")).otherwise(F.col("q")[1]).alias("hi"))
    inside = v.join(near, "k").groupBy("k").agg(F.first("n").alias("n"), F.count_if(F.col("v") < F.col("lo")).alias("below"), F.array_sort(F.collect_list(F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.col("v")))).alias("m"))
    at = lambda i: F.get("m", (i - F.col("below")).cast("int"))
    return inside.select(F.col("k.key").alias(key), ((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias(name))


def by_key(key: str, *parts: DataFrame) -> DataFrame:
    """Tables of one row a key side by side; the null key is a key, and a column that a table lacks is null."""
    columns = [c for p in parts for c in p.columns if c != key]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p, allowMissingColumns=True)
    return whole.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])
