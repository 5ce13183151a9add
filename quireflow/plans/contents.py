"""Queries: joins, order-dependent logic, ranking and sets over contents, headings and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import text as T
from quireflow.operators.extract import norm_box
from quireflow.plans.extract import BLOCKS, BOX, CLEAN, TITLES, flat, titles
from quireflow.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CROPS = "SELECT DISTINCT request_id, unnest(images) AS image_key FROM recognition_requests"
HELD = "SELECT image_key, min(decision_id) AS decision_id FROM (SELECT decision_id, unnest(image_keys) AS image_key FROM decisions) GROUP BY image_key"


def crops(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "recognition_requests").select("request_id", F.explode("images").alias("image_key")).distinct()


def held(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "decisions").select("decision_id", F.explode("image_keys").alias("image_key")).groupBy("image_key").agg(F.min("decision_id").alias("decision_id"))


@query(f"SELECT c.request_id, c.image_key, h.decision_id FROM ({CROPS}) c LEFT JOIN ({HELD}) h USING (image_key)")
def indexed_response(s: SparkSession, d: str) -> DataFrame:
    """Answer to each crop; a crop without one keeps its key."""
    return crops(s, d).join(held(s, d), "image_key", "left").select("request_id", "image_key", "decision_id")


@query(f"SELECT DISTINCT image_key FROM ({CROPS}) WHERE image_key NOT IN (SELECT image_key FROM ({HELD}) WHERE image_key IS NOT NULL)")
def missing_requests(s: SparkSession, d: str) -> DataFrame:
    """Crops to ask for, each once."""
    return crops(s, d).select("image_key").distinct().join(held(s, d), "image_key", "left_anti")


@query("WITH c AS (SELECT run_id, (count(DISTINCT page) // 10) * 10 AS completed FROM layout_pages GROUP BY run_id) SELECT DISTINCT l.run_id, l.page FROM layout_pages l JOIN c USING (run_id) WHERE l.page > c.completed")
def resume_tail(s: SparkSession, d: str) -> DataFrame:
    """Pages beyond the last whole batch."""
    p = table(s, d, "layout_pages").select("run_id", "page").distinct()
    c = p.groupBy("run_id").agg(F.expr("(count(*) div 10) * 10").alias("completed"))
    return p.join(c, "run_id").where("page > completed").select("run_id", "page")


#: Pages with exactly one arabic number at their edge, and that number.
FOLIOS = f"""SELECT run_id, page, min(v) AS folio FROM (SELECT DISTINCT run_id, page, CAST(trim(content) AS INT) AS v FROM ({BLOCKS}) WHERE regexp_matches(trim(content), '^[0-9]{{1,5}}$') AND label IN ('number', 'page_number', 'footer', 'text')) GROUP BY ALL HAVING count(*) = 1"""


def folios(s: SparkSession, d: str) -> DataFrame:
    t = F.trim("content")
    f = flat(s, d, t.rlike("^[0-9]{1,5}$") & F.col("label").isin("number", "page_number", "footer", "text"), "label content run_id page").select("run_id", "page", t.cast("int").alias("v")).distinct()
    return f.groupBy("run_id", "page").agg(F.min("v").alias("folio"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"SELECT e.entry_id, f.page AS target FROM ({TITLES}) e JOIN ({FOLIOS}) f ON f.run_id = e.run_id AND f.folio = e.folio_value WHERE e.folio_style = 'arabic'")
def folio_join(s: SparkSession, d: str) -> DataFrame:
    """Pages that print an entry's number, of pages with one number only."""
    e = titles(s, d).where("folio_style = 'arabic'").select("entry_id", "run_id", F.col("folio_value").alias("folio"))
    return e.join(folios(s, d), ["run_id", "folio"]).select("entry_id", F.col("page").alias("target"))


@query(f"""WITH k AS (SELECT entry_id, run_id, page AS wanted, regexp_replace(lower({CLEAN}), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS key FROM ({TITLES}) WHERE title IS NOT NULL),
  h AS (SELECT run_id, page, page_id, ord, label, regexp_replace(lower({CLEAN}), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS key FROM (SELECT *, content AS title FROM ({BLOCKS}) WHERE label IN ('doc_title', 'paragraph_title', 'text') AND length(content) <= 180))
  SELECT entry_id, page_id, ord, 100 + 10 * (label <> 'text')::INT AS score FROM k JOIN h ON k.run_id = h.run_id AND k.key = h.key AND h.page >= k.wanted - 2 AND h.page < k.wanted + 3 WHERE k.key <> ''""")
def scored_match(s: SparkSession, d: str) -> DataFrame:
    """J06, B04 (exact branch): headings with an entry's key within a range of pages, scored."""
    k = titles(s, d).where("title IS NOT NULL").select("entry_id", "run_id", F.col("page").alias("wanted"), T.title_key(F.col("title")).alias("key")).where("key <> ''")
    h = flat(s, d, "label IN ('doc_title', 'paragraph_title', 'text') AND length(content) <= 180", "label content run_id page").select("run_id", "page", "page_id", "ord", "label", T.title_key(F.col("content")).alias("key"))
    j = k.join(h, ["run_id", "key"]).where("page >= wanted - 2 AND page < wanted + 3")
    return j.select("entry_id", "page_id", "ord", (100 + 10 * (F.col("label") != "text").cast("int")).alias("score"))


@query(f"""WITH f AS ({FOLIOS}), e AS (SELECT entry_id, run_id, folio_value AS v FROM ({TITLES}) WHERE folio_style = 'arabic' AND folio_value IS NOT NULL)
  SELECT entry_id, (SELECT max(folio) FROM f WHERE f.run_id = e.run_id AND folio < v) AS below, (SELECT min(folio) FROM f WHERE f.run_id = e.run_id AND folio > v) AS above FROM e""")
def folio_neighbours(s: SparkSession, d: str) -> DataFrame:
    """Nearest printed numbers below and above an entry's own, by one ordered pass instead of a range join."""
    e = titles(s, d).where("folio_style = 'arabic' AND folio_value IS NOT NULL").select("run_id", F.col("folio_value").alias("v"), "entry_id")
    both = e.unionByName(folios(s, d).select("run_id", F.col("folio").alias("v")), allowMissingColumns=True)
    printed = F.when(F.col("entry_id").isNull(), F.col("v"))
    w = Window.partitionBy("run_id").orderBy("v")
    both = both.withColumn("below", F.max(printed).over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("above", F.min(printed).over(w.rangeBetween(1, Window.unboundedFollowing)))
    return both.where("entry_id IS NOT NULL").select("entry_id", "below", "above")


@query(f"""WITH e AS (SELECT *, CASE WHEN folio_style = 'arabic' AND page IS NOT NULL THEN page - folio_value END AS o FROM ({TITLES})),
  w AS (SELECT *, last_value(o IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(o IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY entry_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM e)
  SELECT entry_id, folio_value + b AS bridged FROM w WHERE page IS NULL AND folio_style = 'arabic' AND a = b""")
def anchor_bridge(s: SparkSession, d: str) -> DataFrame:
    """Destination between neighbours whose page and number differ by the same."""
    o = F.when((F.col("folio_style") == "arabic") & F.col("page").isNotNull(), F.col("page") - F.col("folio_value"))
    w = Window.partitionBy("run_id").orderBy("entry_id")
    e = titles(s, d).withColumn("o", o).withColumn("b", F.last("o", True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("a", F.first("o", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return e.where("page IS NULL AND folio_style = 'arabic' AND a = b").select("entry_id", (F.col("folio_value") + F.col("b")).alias("bridged"))


@query(f"""WITH c AS (SELECT run_id, ident, min(page) AS start FROM ({TITLES}) WHERE kind = 'chapter' AND page IS NOT NULL GROUP BY ALL), n AS (SELECT *, (SELECT min(start) FROM c x WHERE x.run_id = c.run_id AND x.start > c.start) AS stop FROM c)
  SELECT e.entry_id, n.start, n.stop, coalesce(e.page >= n.start AND (n.stop IS NULL OR e.page < n.stop), false) AS inside FROM ({TITLES}) e JOIN n ON n.run_id = e.run_id AND n.ident = e.chapter WHERE e.kind <> 'chapter'""")
def chapter_range(s: SparkSession, d: str) -> DataFrame:
    """Pages of an entry's chapter, up to the next chapter's start."""
    c = titles(s, d).where("kind = 'chapter' AND page IS NOT NULL").groupBy("run_id", "ident").agg(F.min("page").alias("start"))
    later = Window.partitionBy("run_id").orderBy("start").rangeBetween(1, Window.unboundedFollowing)
    c = c.withColumn("stop", F.min("start").over(later)).withColumnRenamed("ident", "chapter")
    inside = (F.col("page") >= F.col("start")) & (F.col("stop").isNull() | (F.col("page") < F.col("stop")))
    return titles(s, d).where("kind <> 'chapter'").join(c, ["run_id", "chapter"]).select("entry_id", "start", "stop", F.coalesce(inside, F.lit(False)).alias("inside"))


BOXED = f"SELECT page_id, ord, block_id, label, content, box.x0 AS x0, box.y0 AS y0, box.x1 AS x1, box.y1 AS y1 FROM (SELECT *, {BOX} AS box FROM ({BLOCKS})) WHERE box IS NOT NULL"


def boxed(s: SparkSession, d: str) -> DataFrame:
    return flat(s, d, "bbox IS NOT NULL", "block_id label content bbox").withColumn("box", norm_box(F.col("bbox"))).where("box IS NOT NULL").select("page_id", "ord", "block_id", "label", "content", "box.*")


@query(f"""WITH b AS ({BOXED}) SELECT a.page_id, a.ord AS left_ord, min(c.ord) AS right_ord FROM b a JOIN b c ON a.page_id = c.page_id AND c.x0 >= a.x1 AND abs((c.y0 + c.y1) / 2 - (a.y0 + a.y1) / 2) <= 0.4 * least(a.y1 - a.y0, c.y1 - c.y0) GROUP BY ALL HAVING count(*) = 1""")
def nearest_on_row(s: SparkSession, d: str) -> DataFrame:
    """The only block right of another on its row. Pairs stay within a page."""
    a = boxed(s, d)
    c = a.select("page_id", *[F.col(x).alias(f"r_{x}") for x in ("ord", "x0", "y0", "x1", "y1")])
    mid = F.abs((F.col("r_y0") + F.col("r_y1")) / 2 - (F.col("y0") + F.col("y1")) / 2) <= 0.4 * F.least(F.col("y1") - F.col("y0"), F.col("r_y1") - F.col("r_y0"))
    j = a.join(c, "page_id").where((F.col("r_x0") >= F.col("x1")) & mid)
    return j.groupBy("page_id", F.col("ord").alias("left_ord")).agg(F.min("r_ord").alias("right_ord"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"""WITH b AS ({BOXED}) SELECT a.page_id, a.ord AS number_ord, min(c.ord) AS title_ord FROM b a JOIN b c ON a.page_id = c.page_id AND a.ord <> c.ord AND abs(c.x0 - a.x0) < 40 AND c.y0 - a.y0 > 0 AND c.y0 - a.y0 <= 2 * (a.y1 - a.y0) WHERE a.label IN ('doc_title', 'paragraph_title') GROUP BY ALL HAVING count(*) = 1""")
def heading_partner(s: SparkSession, d: str) -> DataFrame:
    """The only block directly below a heading."""
    a = boxed(s, d).where("label IN ('doc_title', 'paragraph_title')")
    c = boxed(s, d).select("page_id", *[F.col(x).alias(f"r_{x}") for x in ("ord", "x0", "y0")])
    j = a.join(c, "page_id").where("ord <> r_ord AND abs(r_x0 - x0) < 40 AND r_y0 - y0 > 0 AND r_y0 - y0 <= 2 * (y1 - y0)")
    return j.groupBy("page_id", F.col("ord").alias("number_ord")).agg(F.min("r_ord").alias("title_ord"), F.count("*").alias("n")).where("n = 1").drop("n")


@query(f"""WITH b AS ({BOXED}) SELECT a.page_id, a.ord, count(c.ord) AS overlaps FROM b a LEFT JOIN b c ON a.page_id = c.page_id AND a.ord <> c.ord AND least(a.x1, c.x1) > greatest(a.x0, c.x0) AND least(a.y1, c.y1) > greatest(a.y0, c.y0) AND (least(a.x1, c.x1) - greatest(a.x0, c.x0)) * (least(a.y1, c.y1) - greatest(a.y0, c.y0)) > 1 GROUP BY ALL""")
def box_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Neighbours whose boxes overlap by more than one unit."""
    one = F.struct("ord", "x0", "y0", "x1", "y1")
    b = boxed(s, d)
    near = b.groupBy("page_id").agg(F.collect_list(one).alias("o"))
    wide = lambda o: F.least("x1", o["x1"]) - F.greatest("x0", o["x0"])
    high = lambda o: F.least("y1", o["y1"]) - F.greatest("y0", o["y0"])
    hits = F.filter("o", lambda o: (o["ord"] != F.col("ord")) & (wide(o) > 0) & (high(o) > 0) & (wide(o) * high(o) > 1))
    return b.join(near, "page_id").select("page_id", "ord", F.size(hits).cast("long").alias("overlaps"))


@query(f"""WITH b AS ({BOXED}), r AS (SELECT page_id, block_id, unnest(rects) AS r FROM (SELECT DISTINCT ON (decision_id) decision_id, page_id, block_id, rects FROM decisions)), c AS (SELECT page_id, block_id, (r[1] + r[3]) / 2 AS x, (r[2] + r[4]) / 2 AS y FROM r)
  SELECT b.page_id, b.block_id, round(avg((c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1)::INT), 6) AS inside FROM c JOIN b USING (page_id, block_id) WHERE c.x IS NOT NULL GROUP BY ALL""")
def centres_inside(s: SparkSession, d: str) -> DataFrame:
    """Share of a block's lines whose centre lies in its box."""
    r = table(s, d, "decisions").select("decision_id", "page_id", "block_id", "rects").dropDuplicates(["decision_id"]).select("page_id", "block_id", F.explode("rects").alias("r"))
    c = r.select("page_id", "block_id", ((F.get("r", F.lit(0)) + F.get("r", F.lit(2))) / 2).alias("x"), ((F.get("r", F.lit(1)) + F.get("r", F.lit(3))) / 2).alias("y")).where("x IS NOT NULL")
    j = c.join(boxed(s, d).withColumnsRenamed({"x0": "bx0", "x1": "bx1", "y0": "by0", "y1": "by1"}), ["page_id", "block_id"])
    inside = F.col("x").between(F.col("bx0"), F.col("bx1")) & F.col("y").between(F.col("by0"), F.col("by1"))
    return j.groupBy("page_id", "block_id").agg(F.round(F.avg(inside.cast("int")), 6).alias("inside"))


@query(f"SELECT run_id, toc_page, title, count(*) AS hits, count(*) = 1 AS usable FROM ({TITLES}) WHERE title IS NOT NULL GROUP BY ALL")
def review_targets(s: SparkSession, d: str) -> DataFrame:
    """Entries a correction by contents page and title would hit; only one may."""
    g = titles(s, d).where("title IS NOT NULL").groupBy("run_id", "toc_page", "title").agg(F.count("*").alias("hits"))
    return g.withColumn("usable", F.col("hits") == 1)


KEYED = "SELECT block_key, md5(string_agg(DISTINCT original, chr(10) ORDER BY original)) AS h FROM decisions WHERE {} AND original IS NOT NULL AND block_key IS NOT NULL GROUP BY block_key"


@query(f"""WITH a AS ({KEYED.format("engine = 'line-a'")}), b AS ({KEYED.format("engine = 'line-b'")}) SELECT count(*) FILTER (WHERE a.h IS NOT NULL AND b.h IS NOT NULL) AS shared, count(*) FILTER (WHERE a.h <> b.h) AS differing, count(*) FILTER (WHERE b.h IS NULL) AS baseline_only, count(*) FILTER (WHERE a.h IS NULL) AS candidate_only FROM a FULL JOIN b USING (block_key)""")
def response_variation(s: SparkSession, d: str) -> DataFrame:
    """Keys two engines share, answer differently, or have alone."""
    t = table(s, d, "decisions").where("original IS NOT NULL AND block_key IS NOT NULL")
    keyed = lambda e, c: t.where(F.col("engine") == e).groupBy("block_key").agg(F.md5(F.array_join(F.array_sort(F.collect_set("original")), "\n")).alias(c))
    j = keyed("line-a", "a").join(keyed("line-b", "b"), "block_key", "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("a") != F.col("b")).alias("differing"), F.count_if(F.col("b").isNull()).alias("baseline_only"), F.count_if(F.col("a").isNull()).alias("candidate_only"))


TEXTS = f"SELECT doc_key, run_id, page, md5(string_agg(coalesce(content, ''), chr(10) ORDER BY page_id, ord)) AS h FROM (SELECT b.*, p.doc_key FROM ({BLOCKS}) b JOIN (SELECT DISTINCT page_id, doc_key FROM layout_pages) p USING (page_id)) GROUP BY ALL"


@query(f"""WITH t AS ({TEXTS}), r AS (SELECT doc_key, min(run_id) AS a, max(run_id) AS b FROM t GROUP BY doc_key HAVING count(DISTINCT run_id) > 1)
  SELECT r.doc_key, x.page, x.h IS NOT DISTINCT FROM y.h AS same FROM r JOIN t x ON x.run_id = r.a AND x.doc_key = r.doc_key LEFT JOIN t y ON y.run_id = r.b AND y.doc_key = r.doc_key AND y.page = x.page""")
def run_comparison(s: SparkSession, d: str) -> DataFrame:
    """Pages of a book's first run whose text the last run repeats."""
    p = table(s, d, "layout_pages").where("size(parsing_res_list) > 0")
    text = F.array_join(F.transform("parsing_res_list.block_content", lambda c: F.coalesce(c, F.lit(""))), "\n")
    per = p.select("doc_key", "run_id", "page", "page_id", text.alias("t")).dropDuplicates(["page_id"])
    t = per.groupBy("doc_key", "run_id", "page").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "t"))), lambda x: x["t"]), "\n")).alias("h"))
    r = t.groupBy("doc_key").agg(F.min("run_id").alias("a"), F.max("run_id").alias("b")).where("a <> b")
    x = t.join(r, "doc_key").where("run_id = a").select("doc_key", "page", F.col("h").alias("hx"))
    y = t.join(r, "doc_key").where("run_id = b").select("doc_key", "page", F.col("h").alias("hy"))
    return x.join(y, ["doc_key", "page"], "left").select("doc_key", "page", F.col("hx").eqNullSafe(F.col("hy")).alias("same"))


@query("""WITH a AS (SELECT DISTINCT run_id, doc_key, pages FROM run_reports), b AS (SELECT run_id, doc_key, count(DISTINCT page)::INT AS pages FROM layout_pages GROUP BY ALL)
  SELECT (SELECT count(*) FROM a) AS first, (SELECT count(*) FROM b) AS second, (SELECT count(*) FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.run_id = b.run_id AND a.doc_key IS NOT DISTINCT FROM b.doc_key AND a.pages IS NOT DISTINCT FROM b.pages)) AS only_first,
  (SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.run_id = b.run_id AND a.doc_key IS NOT DISTINCT FROM b.doc_key AND a.pages IS NOT DISTINCT FROM b.pages)) AS only_second""")
def corpora_equal(s: SparkSession, d: str) -> DataFrame:
    """Whether two corpora hold the same runs, by id, book and number of pages; what only one of them has is counted."""
    a = table(s, d, "run_reports").select("run_id", "doc_key", "pages").distinct()
    b = table(s, d, "layout_pages").groupBy("run_id", "doc_key").agg(F.countDistinct("page").cast("int").alias("pages"))
    both = a.withColumn("a", F.lit(1)).withColumn("b", F.lit(0)).unionByName(b.withColumn("a", F.lit(0)).withColumn("b", F.lit(1)))
    g = both.groupBy("run_id", "doc_key", "pages").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return g.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("first"), F.coalesce(F.sum("b"), F.lit(0)).alias("second"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_first"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_second"))


@query("SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT doc_id) > 1)")
def duplicate_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Documents that share a fingerprint with another."""
    t = table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("h"))
    often = t.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("h")
    return t.join(often, "h", "left_semi").select("doc_id")


@query("WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), g AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, event_type ORDER BY i) AS island FROM e) SELECT user_id, event_type, min(i) AS first, max(i) AS last, count(*) AS n FROM g GROUP BY user_id, event_type, island")
def runs_islands(s: SparkSession, d: str) -> DataFrame:
    """Stretches of equal flags."""
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(s, d, "events").withColumn("i", i)
    e = e.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("i")))
    return e.groupBy("user_id", "event_type", "island").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n")).drop("island")


@query("WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) > 0 AS ink FROM embeddings), g AS (SELECT vec_id, i, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS island FROM v WHERE NOT ink) SELECT vec_id, min(i) - 1 AS start, max(i) AS stop FROM g GROUP BY vec_id, island HAVING count(*) >= 2")
def blank_runs(s: SparkSession, d: str) -> DataFrame:
    """Blank stretches of two or more columns of a mask."""
    v = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).where("NOT x > 0")
    v = v.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy("vec_id").orderBy("i")))
    return v.groupBy("vec_id", "island").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"), F.count("*").alias("n")).where("n >= 2").select("vec_id", "start", "stop")


@query(f"""WITH e AS (SELECT entry_id, run_id, raw_rank, page IS NOT NULL AS ok, row_number() OVER (PARTITION BY run_id ORDER BY entry_id) AS i FROM ({TITLES}) WHERE raw_rank IS NOT NULL)
  SELECT a.entry_id, 1 + (SELECT count(*) FROM e j WHERE j.run_id = a.run_id AND j.i < a.i AND j.ok AND j.raw_rank < (SELECT min(k.raw_rank) FROM e k WHERE k.run_id = a.run_id AND k.i > j.i AND k.i <= a.i)) AS level FROM e a WHERE a.ok""")
def dense_hierarchy(s: SparkSession, d: str) -> DataFrame:
    """Level of each accepted entry, one below its accepted ancestors; a missing parent adopts nobody.

    A run's entries (one book's contents, thousands at most) are walked in order with the entries above the present one as
    the state; ranks need not be few.
    """
    e = titles(s, d).where("raw_rank IS NOT NULL").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("entry_id", "raw_rank", F.col("page").isNotNull().alias("ok")))).alias("e"))
    kind = "struct<above:array<struct<rank:int,ok:boolean>>,out:array<struct<entry_id:bigint,level:bigint,ok:boolean>>>"

    def step(acc, x):
        above = F.filter(acc["above"], lambda o: o["rank"] < x["raw_rank"])
        level = F.size(F.filter(above, lambda o: o["ok"])).cast("long") + 1
        here = F.struct(x["raw_rank"].cast("int").alias("rank"), x["ok"].alias("ok"))
        return F.struct(F.concat(above, F.array(here)).alias("above"), F.concat(acc["out"], F.array(F.struct(x["entry_id"].cast("long").alias("entry_id"), level.alias("level"), x["ok"].alias("ok")))).alias("out")).cast(kind)

    start = F.struct(F.array().cast("array<struct<rank:int,ok:boolean>>").alias("above"), F.array().cast("array<struct<entry_id:bigint,level:bigint,ok:boolean>>").alias("out")).cast(kind)
    walked = e.select(F.explode(F.aggregate("e", start, step, lambda acc: acc["out"])).alias("o")).select("o.*")
    return walked.where("ok").select("entry_id", "level")


@query(f"SELECT entry_id, last_value(CASE WHEN kind = 'chapter' THEN ident END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chapter_so_far FROM ({TITLES})")
def carry_forward(s: SparkSession, d: str) -> DataFrame:
    """Chapter in which each entry stands."""
    w = Window.partitionBy("run_id").orderBy("entry_id").rowsBetween(Window.unboundedPreceding, 0)
    return titles(s, d).select("entry_id", F.last(F.when(F.col("kind") == "chapter", F.col("ident")), True).over(w).alias("chapter_so_far"))


LINES = f"""SELECT page_id, ord, line, trim(raw) AS t FROM (SELECT page_id, ord, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM ({BLOCKS}) WHERE label IN ('content', 'text'))"""
NUMBER = "^([0-9]{1,5}|[ivxlcdmIVXLCDM]{1,12})$"


def lines(s: SparkSession, d: str) -> DataFrame:
    b = flat(s, d, "label IN ('content', 'text') AND content IS NOT NULL", "label content")
    return b.select("page_id", "ord", F.posexplode(F.split("content", "\n")).alias("line", "raw")).select("page_id", "ord", (F.col("line") + 1).alias("line"), F.trim("raw").alias("t"))


@query(f"SELECT page_id, ord, line FROM (SELECT *, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2 FROM ({LINES}) WINDOW w AS (PARTITION BY page_id, ord ORDER BY line)) WHERE NOT regexp_matches(t, '{NUMBER}') AND regexp_matches(n1, '{NUMBER}') AND NOT coalesce(regexp_matches(n2, '{NUMBER}'), false)")
def lookahead_pairs(s: SparkSession, d: str) -> DataFrame:
    """Lines followed by one line that is a number, not by two."""
    w = Window.partitionBy("page_id", "ord").orderBy("line")
    t = lines(s, d).withColumn("n1", F.lead("t").over(w)).withColumn("n2", F.lead("t", 2).over(w))
    return t.where(~F.col("t").rlike(NUMBER) & F.col("n1").rlike(NUMBER) & ~F.coalesce(F.col("n2").rlike(NUMBER), F.lit(False))).select("page_id", "ord", "line")


@query(f"SELECT page_id, ord, line, before || ' ' || t AS joined FROM (SELECT *, lag(t) OVER (PARTITION BY page_id, ord ORDER BY line) AS before FROM ({LINES})) WHERE regexp_matches(t, '^[a-z]') AND NOT regexp_matches(before, '[.!?0-9]$') AND before <> ''")
def wrapped_lines(s: SparkSession, d: str) -> DataFrame:
    """Lines that go on in lower case from the one before."""
    before = F.lag("t").over(Window.partitionBy("page_id", "ord").orderBy("line"))
    t = lines(s, d).withColumn("before", before)
    return t.where(F.col("t").rlike("^[a-z]") & ~F.col("before").rlike("[.!?0-9]$") & (F.col("before") != "")).select("page_id", "ord", "line", F.concat("before", F.lit(" "), "t").alias("joined"))


@query(f"SELECT run_id, regexp_replace(lower(content), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS key, count(DISTINCT page) AS pages FROM ({BLOCKS}) WHERE height > 0 AND len(bbox) = 4 AND (least(bbox[2], bbox[4]) < 0.1 * height OR least(bbox[2], bbox[4]) > 0.9 * height) AND content IS NOT NULL GROUP BY ALL HAVING count(DISTINCT page) >= 3")
def running_headers(s: SparkSession, d: str) -> DataFrame:
    """Texts at the edge of three or more pages of a run."""
    y = F.least(F.get("bbox", F.lit(1)), F.get("bbox", F.lit(3)))
    b = flat(s, d, (F.col("height") > 0) & (F.size("bbox") == 4) & ((y < 0.1 * F.col("height")) | (y > 0.9 * F.col("height"))) & F.col("content").isNotNull(), "content bbox run_id page height")
    return b.groupBy("run_id", T.dense(F.col("content"), fold=True).alias("key")).agg(F.countDistinct("page").alias("pages")).where("pages >= 3")


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING), 4) AS width FROM lineitem")
def prefix_sums(s: SparkSession, d: str) -> DataFrame:
    """Running widths."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 4).alias("width"))


@query("SELECT vec_id, round(count(*) FILTER (WHERE ink <> before) / count(*), 6) AS churn FROM (SELECT *, lag(ink) OVER (PARTITION BY vec_id ORDER BY i) AS before FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) > 0 AS ink FROM embeddings)) GROUP BY vec_id")
def column_churn(s: SparkSession, d: str) -> DataFrame:
    """Flips from row to row by height, on the array itself."""
    ink = F.transform("embedding", lambda x: x > 0)
    flips = F.size(F.filter(F.zip_with(F.slice(ink, F.lit(1), F.size(ink) - 1), F.slice(ink, F.lit(2), F.size(ink) - 1), lambda a, b: a != b), lambda x: x))
    return table(s, d, "embeddings").select("vec_id", F.round(flips / F.size("embedding"), 6).alias("churn"))


@query("SELECT doc_key, pages, rank() OVER (ORDER BY pages, lower(doc_key)) AS place FROM (SELECT doc_key, max(pages) AS pages FROM run_reports GROUP BY doc_key) ORDER BY place LIMIT 40")
def document_order(s: SparkSession, d: str) -> DataFrame:
    """The forty smallest documents by pages, then name. `document_places` has all of them."""
    g = table(s, d, "run_reports").groupBy("doc_key").agg(F.max("pages").alias("pages")).orderBy(F.asc_nulls_last("pages"), F.lower("doc_key")).limit(40)
    # Forty rows at most are ranked.
    return g.select("doc_key", "pages", F.rank().over(Window.orderBy(F.asc_nulls_last("pages"), F.lower("doc_key"))).cast("long").alias("place"))


@query(f"""WITH s AS (SELECT e.entry_id, f.page, 100 - abs(f.page - coalesce(e.page, f.page)) AS score FROM ({TITLES}) e JOIN ({FOLIOS}) f ON f.run_id = e.run_id AND abs(f.folio - e.folio_value) <= 9 WHERE e.folio_style = 'arabic'), r AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, page) AS n, lead(score) OVER (PARTITION BY entry_id ORDER BY score DESC, page) AS next FROM s)
  SELECT entry_id, page, score, coalesce(score - next < 8, false) AS ambiguous FROM r WHERE n = 1""")
def best_candidate(s: SparkSession, d: str) -> DataFrame:
    """The best of the candidates, and whether the next is too near."""
    e = titles(s, d).where("folio_style = 'arabic' AND folio_value IS NOT NULL").select("entry_id", "run_id", "folio_value", F.col("page").alias("wanted"))
    f = folios(s, d)
    # A range join by buckets of ten: each number meets entries of its bucket and the two beside it.
    f = f.withColumn("near", F.explode(F.array(*[F.floor(F.col("folio") / 10) + k for k in (-1, 0, 1)])))
    j = e.withColumn("near", F.floor(F.col("folio_value") / 10)).join(f, ["run_id", "near"]).where("abs(folio - folio_value) <= 9")
    j = j.withColumn("score", 100 - F.abs(F.col("page") - F.coalesce("wanted", "page")))
    w = Window.partitionBy("entry_id").orderBy(F.desc("score"), "page")
    r = j.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("n = 1")
    return r.select("entry_id", "page", "score", F.coalesce(F.col("score") - F.col("next") < 8, F.lit(False)).alias("ambiguous"))


@query("SELECT doc_key, pages, rank() OVER (ORDER BY pages, lower(doc_key)) AS place FROM (SELECT doc_key, max(pages) AS pages FROM run_reports GROUP BY doc_key)")
def document_places(s: SparkSession, d: str) -> DataFrame:
    """Every document with its place by pages, then name.

    Books of one size are ranked by name among themselves and moved on by the books of smaller sizes, so
    that the only window over everything is one over the different sizes.
    """
    g = table(s, d, "run_reports").groupBy("doc_key").agg(F.max("pages").alias("pages"))
    size = g.groupBy("pages").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.asc_nulls_last("pages")).rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(F.col("pages").alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.rank().over(Window.partitionBy("pages").orderBy(F.asc_nulls_last(F.lower("doc_key"))))
    return g.withColumn("own", own).join(size, F.col("pages").eqNullSafe(F.col("size"))).select("doc_key", "pages", (F.col("before") + F.col("own")).cast("long").alias("place"))


@query(f"SELECT run_id, string_agg(CAST(page_id AS VARCHAR) || ':' || ord, ' ' ORDER BY page, page_id, ord) AS headings FROM ({BLOCKS}) WHERE label IN ('doc_title', 'paragraph_title') GROUP BY run_id")
def heading_order(s: SparkSession, d: str) -> DataFrame:
    """Headings of a run in reading order."""
    b = flat(s, d, "label IN ('doc_title', 'paragraph_title')", "label run_id page").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("page", "page_id", "ord"))).alias("h"))
    return b.select("run_id", F.array_join(F.transform("h", lambda x: F.concat(x["page_id"].cast("string"), F.lit(":"), x["ord"].cast("string"))), " ").alias("headings"))


@query("SELECT run_id, array_to_string(list_sort(list_distinct(warnings)), ',') AS warnings FROM (SELECT DISTINCT ON (run_id) * FROM run_reports)")
def sorted_warnings(s: SparkSession, d: str) -> DataFrame:
    """Warnings of a run, each once, in order."""
    return table(s, d, "run_reports").dropDuplicates(["run_id"]).select("run_id", F.array_join(F.array_sort(F.array_distinct("warnings")), ",").alias("warnings"))


@query(f"SELECT page_id, coalesce(nullif(trim(content), ''), label) AS text, CASE WHEN nullif(trim(content), '') IS NOT NULL THEN 'content' ELSE 'label' END AS key FROM ({BLOCKS}) WHERE ord = 1")
def first_key(s: SparkSession, d: str) -> DataFrame:
    """The first of several fields that holds something."""
    t = F.when(F.trim("content") != "", F.trim("content"))
    return flat(s, d, "ord = 1", "label content").select("page_id", F.coalesce(t, "label").alias("text"), F.when(t.isNotNull(), "content").otherwise("label").alias("key"))


@query("SELECT doc_key FROM entries WHERE doc_key IS NOT NULL INTERSECT SELECT doc_key FROM documents WHERE doc_key IS NOT NULL")
def shared_books(s: SparkSession, d: str) -> DataFrame:
    """Books in both tables."""
    return table(s, d, "entries").select("doc_key").where("doc_key IS NOT NULL").intersect(table(s, d, "documents").select("doc_key"))


@query("SELECT l_partkey AS part, count(*) AS n FROM (SELECT l_partkey FROM lineitem EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 25) GROUP BY ALL")
def bag_difference(s: SparkSession, d: str) -> DataFrame:
    """Parts left when others are taken away, with repeats."""
    t = table(s, d, "lineitem")
    return t.select("l_partkey").exceptAll(t.where("l_quantity > 25").select("l_partkey")).groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT decision_id, list_has_all(regexp_extract_all(array_to_string(candidate, ' '), '[0-9]+'), regexp_extract_all(original, '[0-9]+')) AS kept FROM (SELECT DISTINCT ON (decision_id) * FROM decisions) WHERE original IS NOT NULL AND candidate IS NOT NULL")
def numbers_kept(s: SparkSession, d: str) -> DataFrame:
    """Whether every number of the original is in the second reading."""
    n = lambda c: F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))
    t = table(s, d, "decisions").dropDuplicates(["decision_id"]).where("original IS NOT NULL AND candidate IS NOT NULL")
    return t.select("decision_id", (F.size(F.array_except(n(F.col("original")), n(F.array_join("candidate", " ")))) == 0).alias("kept"))


@query("SELECT run_id, kind, count(*) AS n FROM (SELECT DISTINCT run_id, entry_id AS id, 'entry' AS kind FROM entries UNION ALL SELECT DISTINCT run_id, request_id, 'request' FROM recognition_requests) GROUP BY ALL")
def joined_lists(s: SparkSession, d: str) -> DataFrame:
    """Two lists one after the other."""
    a = table(s, d, "entries").select("run_id", F.col("entry_id").alias("id")).distinct().withColumn("kind", F.lit("entry"))
    b = table(s, d, "recognition_requests").select("run_id", F.col("request_id").alias("id")).distinct().withColumn("kind", F.lit("request"))
    return a.unionByName(b).groupBy("run_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT lower(title) AS stem, count(*) AS n FROM (SELECT DISTINCT entry_id, title FROM entries WHERE title IS NOT NULL) GROUP BY ALL HAVING count(*) > 1")
def duplicate_stems(s: SparkSession, d: str) -> DataFrame:
    """Names that differ in case at most."""
    return table(s, d, "entries").where("title IS NOT NULL").select("entry_id", "title").distinct().groupBy(F.lower("title").alias("stem")).agg(F.count("*").alias("n")).where("n > 1")
