"""Queries: profiles in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import profile as P
from quireflow.sources.tables import table
from quireflow.streaming import profile as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events")


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS INT))::BIGINT AS k FROM events GROUP BY event_type")
def jsonl_samples(s: SparkSession, d: str) -> DataFrame:
    """Samples kept as JSON, read with a declared schema."""
    k = F.from_json("props", "k INT", {"mode": "FAILFAST"})["k"]
    return events(s, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))


@query("SELECT user_id AS sample, 'requests_' || event_type AS metric, NULL::VARCHAR AS reason, round(sum(CAST(round(value, 2) AS DOUBLE)), 4) AS value FROM events WHERE event_type <> 'error' GROUP BY ALL UNION ALL SELECT user_id, 'success_total', event_type, round(sum(CAST(round(value, 2) AS DOUBLE)), 4) FROM events WHERE event_type = 'error' GROUP BY ALL")
def prometheus_sum(s: SparkSession, d: str) -> DataFrame:
    """Metric texts written from events and parsed again."""
    v = F.round("value", 2).cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit('success_total{finished_reason="error",engine="'), F.col("event_id").cast("string"), F.lit('"} '), v)).otherwise(F.concat(F.lit("requests_"), "event_type", F.lit('{engine="'), F.col("event_id").cast("string"), F.lit('"} '), v))
    t = events(s, d).select(F.col("user_id").alias("sample"), F.concat(F.lit("# HELP x\nlatency_bucket{le=\"1\"} 7\n"), line).alias("text"))
    return P.parse_metrics(t).select("sample", "metric", "reason", F.round("value", 4).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN round(value, 2) + event_id % 100 END AS total FROM events")
def gpu_lines(s: SparkSession, d: str) -> DataFrame:
    """Four numbers of a line, or nothing."""
    v = F.round("value", 2).cast("decimal(10,2)").cast("string")
    line = F.when(F.col("event_id") % 3 > 0, F.concat_ws(", ", v, (F.col("event_id") % 100).cast("string"), F.lit("0"), F.lit("0.0"))).otherwise(F.concat_ws(", ", v, F.lit("[N/A]"), F.lit("0"), F.lit("0.0")))
    g = P.gpu_values(line)
    return events(s, d).select("event_id", (g[0] + g[1]).alias("total"))


AGE = "CASE WHEN CAST(json_extract(props, '$.k') AS INT) % 7 > 0 THEN CAST(json_extract(props, '$.k') AS INT) / 5.0 END"


def aged(s: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k INT")["k"]
    return events(s, d).withColumn("age_seconds", F.when(k % 7 > 0, k / 5))


@query(f"SELECT event_type, count(*) AS samples, count(*) FILTER (WHERE {AGE} <= 10) AS fresh FROM events GROUP BY event_type")
def fresh_samples(s: SparkSession, d: str) -> DataFrame:
    """Probes no older than ten seconds; one without an age is not fresh."""
    return aged(s, d).groupBy("event_type").agg(F.count("*").alias("samples"), F.count_if(P.fresh(F.col("age_seconds"))).alias("fresh"))


REGION = """WITH f AS (SELECT user_id, event_type, min(ts) AS start FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase') GROUP BY ALL), o AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start, event_type) AS stop FROM f)"""


@query(f"{REGION} SELECT o.user_id, o.event_type AS stage, count(*) AS samples, count(*) FILTER (WHERE e.value <= 10) AS idle, count(*) FILTER (WHERE e.value >= 90) AS busy, round(avg(e.value), 6) AS mean, min(e.value) AS least FROM o JOIN events e ON e.user_id = o.user_id AND e.ts >= o.start AND (o.stop IS NULL OR e.ts < o.stop) GROUP BY ALL")
def profile_regions(s: SparkSession, d: str) -> DataFrame:
    """Samples in the regions between the first markers of each stage.

    Every sample finds its region in one ordered pass over its group: the last marker before it.
    """
    from pyspark.sql.window import Window

    e = events(s, d)
    f = e.where("event_type IN ('signup', 'view', 'click', 'purchase')").groupBy("user_id", "event_type").agg(F.min("ts").alias("start"))
    f = f.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("start", "event_type"))).alias("m"))
    j = e.join(f, "user_id").withColumn("stage", F.expr("get(filter(m, x -> x.start <= ts), size(filter(m, x -> x.start <= ts)) - 1).event_type")).where("stage IS NOT NULL")
    return j.groupBy("user_id", "stage").agg(F.count("*").alias("samples"), F.count_if(F.col("value") <= 10).alias("idle"), F.count_if(F.col("value") >= 90).alias("busy"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"))


@query("SELECT user_id, event_type, min(ts)::VARCHAR AS start FROM events WHERE event_type IN ('signup', 'view') GROUP BY ALL")
def stage_markers(s: SparkSession, d: str) -> DataFrame:
    """The first event of each stage."""
    f = events(s, d).where("event_type IN ('signup', 'view')").groupBy("user_id", "event_type").agg(F.min("ts").alias("start"))
    return f.select("user_id", "event_type", F.rtrim(F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("0")).alias("start"))


@query(f"SELECT event_type AS engine, user_id AS process, count(*) FILTER (WHERE value > 0) AS records, max(value) AS peak FROM events WHERE {AGE} <= 10 GROUP BY ALL")
def engine_attribution(s: SparkSession, d: str) -> DataFrame:
    """Records and peak of each engine and process, fresh samples only; engines are never summed."""
    return aged(s, d).where(P.fresh(F.col("age_seconds"))).groupBy(F.col("event_type").alias("engine"), F.col("user_id").alias("process")).agg(F.count_if(F.col("value") > 0).alias("records"), F.max("value").alias("peak"))


@query("SELECT date_trunc('day', ts)::DATE AS day, max(value) AS peak, round(median(value), 6) AS middle, max(value) FILTER (WHERE event_type = 'error') AS worst_error FROM events GROUP BY 1")
def resource_peaks(s: SparkSession, d: str) -> DataFrame:
    """Peaks and medians by day; null where a counter never came."""
    e = events(s, d).withColumn("day", F.to_date("ts"))
    peaks = e.groupBy("day").agg(F.max("value").alias("peak"), F.max(F.when(F.col("event_type") == "error", F.col("value"))).alias("worst_error"))
    return P.by_key("day", peaks, P.exact_median(e, "day", "value", "middle")).select("day", "peak", F.round("middle", 6).alias("middle"), "worst_error")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def profile_stream(s: SparkSession, d: str) -> DataFrame:
    """Q10, Q12: daily windows by kind of event, run as a stream over the files that are there."""
    t = W.to_table(s, W.windowed(W.event_stream(s, f"{d}/events.parquet")))
    return t.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
