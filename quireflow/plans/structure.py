"""Queries: destinations of printed contents over whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import similarity as S
from quireflow.functions import text as T
from quireflow.operators import structure as B
from quireflow.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def rows(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "layout_pages").dropDuplicates(["page_id"]).where("run_id IS NOT NULL AND page IS NOT NULL")
    return B.page_rows(p.withColumn("doc", F.col("run_id").cast("string")).dropDuplicates(["doc", "page"]))


def printed_entries(s: SparkSession, d: str) -> DataFrame:
    """Entries printed on each page that holds a contents marker or block."""
    r = rows(s, d)
    some = r.where("label = 'content'").select("doc", "page").distinct()
    return B.printed_entries(r.join(some, ["doc", "page"], "left_semi")).select("doc", "page", "place", "title", "printed")


def plan_bookmarks(s: SparkSession, d: str) -> DataFrame:
    """The plan of every run."""
    return B.plan_bookmarks(rows(s, d))


QUERIES |= {"printed_entries": printed_entries, "plan_bookmarks": plan_bookmarks}


def outline_check(s: SparkSession, d: str) -> DataFrame:
    """Whether a written outline is the planned one (here: every 23rd entry was written to the next page)."""
    e = table(s, d, "entries").dropDuplicates(["entry_id"]).where("page IS NOT NULL AND title IS NOT NULL AND run_id IS NOT NULL")
    plan = e.select(F.col("run_id").alias("doc"), F.col("entry_id").alias("i"), "title", F.lit(True).alias("accepted"), F.col("raw_rank").alias("level"), "page", F.lit(0.5).alias("y"))
    written = plan.select("doc", "i", "title", "level", F.when(F.col("i") % 23 == 0, F.col("page") + 1).otherwise(F.col("page")).alias("page"), F.lit(0.55).alias("y"))
    return B.verify_bookmarks(plan, written)


def kept_outlines(s: SparkSession, d: str) -> DataFrame:
    """An outline that is there stays whole unless it is our own (here: warnings, made by fast runs)."""
    r = table(s, d, "run_reports").dropDuplicates(["run_id"])
    kept = B.kept_outline(F.col("warnings"), F.array("status"), F.col("options")["fast"])
    return r.select("run_id", F.array_join(kept, ",").alias("outline"))


def refresh_gate(s: SparkSession, d: str) -> DataFrame:
    """A new version of a book may be published if all pages' sources are those of its last report."""
    p = table(s, d, "layout_pages").select("run_id", "page_id", "source_sha256").distinct()
    r = table(s, d, "run_reports").groupBy("run_id").agg(F.max("source_sha256").alias("want"))
    return p.join(r, "run_id").groupBy("run_id").agg(F.count("*").alias("pages"), F.bool_and(F.col("source_sha256").eqNullSafe(F.col("want"))).alias("publish"))


def title_similarity(s: SparkSession, d: str) -> DataFrame:
    """Likeness of each title and the next one's in its run; 0 where digits or signs differ."""
    from pyspark.sql.window import Window

    e = table(s, d, "entries").dropDuplicates(["entry_id"]).where("title IS NOT NULL")
    t = e.select("entry_id", T.lexical_key(F.col("title")).alias("a"), T.lexical_key(F.lead("title").over(Window.partitionBy("run_id").orderBy("entry_id"))).alias("b")).where("b IS NOT NULL")
    digits = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    signs = lambda c: F.regexp_replace(c, "(?U)[\\p{L}\\p{N}]", "")
    like = (digits("a") == digits("b")) & (signs("a") == signs("b"))
    return t.select("entry_id", F.round(F.coalesce(S.similarity(F.when(like, F.col("a")), F.when(like, F.col("b"))), F.lit(0.0)), 6).alias("likeness"))


QUERIES |= {"outline_check": outline_check, "kept_outlines": kept_outlines, "refresh_gate": refresh_gate, "title_similarity": title_similarity}
SQL |= {
    "outline_check": "SELECT run_id AS doc, count(*) FILTER (WHERE entry_id % 23 = 0) = 0 AS same FROM (SELECT DISTINCT ON (entry_id) * FROM entries) WHERE page IS NOT NULL AND title IS NOT NULL AND run_id IS NOT NULL GROUP BY run_id",
    "kept_outlines": "SELECT run_id, array_to_string(CASE WHEN len(warnings) > 0 AND NOT coalesce(options['fast'], false) THEN warnings ELSE [status] END, ',') AS outline FROM (SELECT DISTINCT ON (run_id) * FROM run_reports)",
    "refresh_gate": "SELECT run_id, count(*) AS pages, bool_and(l.source_sha256 IS NOT DISTINCT FROM want) AS publish FROM (SELECT DISTINCT run_id, page_id, source_sha256 FROM layout_pages) l JOIN (SELECT run_id, max(source_sha256) AS want FROM run_reports GROUP BY run_id) USING (run_id) GROUP BY run_id",
}
