"""Queries: geometry, raster kernels and text layout. Rasters are the whole arrays of the embeddings table here, 8 by 8."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from quireflow.functions import layout as L
from quireflow.functions import raster as R
from quireflow.functions import tables as B
from quireflow.functions.fonts import repaired_map
from quireflow.operators.extract import norm_box
from quireflow.plans.extract import flat
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


def gray(values) -> np.ndarray:
    """An 8 by 8 gray raster: ink where the number is above 0."""
    return np.where(np.asarray(values[:64]).reshape(8, 8) > 0, 0, 255).astype(np.uint8)


@query("SELECT page_id, CASE WHEN greatest(width, height) < 1600 THEN 1.0 ELSE round(greatest(width, height) / 792, 6) END AS scale FROM (SELECT DISTINCT ON (page_id) page_id, width, height FROM layout_pages) WHERE width > 0 AND height > 0")
def coordinate_scale(s: SparkSession, d: str) -> DataFrame:
    """Scale of lengths on a page."""
    p = table(s, d, "layout_pages").select("page_id", "width", "height").dropDuplicates(["page_id"]).where("width > 0 AND height > 0")
    edge = F.greatest("width", "height")
    return p.select("page_id", F.when(edge < 1600, 1.0).otherwise(F.round(edge / 792, 6)).alias("scale"))


@query("WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings) WHERE i < 64 AND v > 0), g AS (SELECT *, x - row_number() OVER (PARTITION BY vec_id, y ORDER BY x) AS island FROM p), r AS (SELECT vec_id, count(*) AS n FROM g GROUP BY vec_id, y, island) SELECT e.vec_id, coalesce(sum(n) FILTER (WHERE n >= 3), 0)::BIGINT AS kept FROM embeddings e LEFT JOIN r USING (vec_id) GROUP BY e.vec_id")
def long_runs_kernel(s: SparkSession, d: str) -> DataFrame:
    """Pixels in horizontal runs of three or more."""

    @F.pandas_udf(IntegerType())
    def kept(v: pd.Series) -> pd.Series:
        return v.map(lambda a: int(R.long_runs(gray(a) < 128, 3).sum()))

    return table(s, d, "embeddings").select("vec_id", kept("embedding").cast("long").alias("kept"))


@query()
def line_detection(s: SparkSession, d: str) -> DataFrame:
    """Boxes of lines found in each raster."""

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def lines(v: pd.Series) -> pd.Series:
        return v.map(lambda a: [list(map(float, b)) for b in R.detect_lines(np.kron(gray(a), np.ones((6, 6), np.uint8)))])

    return table(s, d, "embeddings").select("vec_id", F.explode(lines("embedding")).alias("box"))


@query()
def table_layouts(s: SparkSession, d: str) -> DataFrame:
    """Cells of table blocks, with whether the table is regular."""
    cell = StructType([StructField("row", IntegerType()), StructField("col", IntegerType()), StructField("text", StringType()), StructField("span", IntegerType()), StructField("regular", StringType())])

    @F.pandas_udf(ArrayType(cell))
    def cells(v: pd.Series) -> pd.Series:
        def one(t):
            rows, regular = B.parse_table(t)
            return [{"row": i, "col": j, "text": c, "span": n, "regular": str(regular)} for i, r in enumerate(rows) for j, (c, n) in enumerate(r)]

        return v.map(one)

    b = flat(s, d, F.contains(F.lower("content"), F.lit("<table")), "block_id content")
    return b.select("page_id", "block_id", F.explode(cells("content")).alias("c")).select("page_id", "block_id", "c.*")


@query()
def expanded_boxes(s: SparkSession, d: str) -> DataFrame:
    """A box in the middle of each raster grown along its ink."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def grown(v: pd.Series) -> pd.Series:
        return v.map(lambda a: R.expand_box(np.kron(gray(a), np.ones((6, 6))) < 128, (16, 16, 32, 32), (12, 12)))

    return table(s, d, "embeddings").select("vec_id", grown("embedding").alias("box"))


@query("""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v > 0 AS k FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings) WHERE i < 64),
  e AS (SELECT a.vec_id, a.x, a.y, bool_or(a.k <> b.k) AS ink FROM p a JOIN p b ON a.vec_id = b.vec_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY ALL) SELECT vec_id, count(*) FILTER (WHERE ink) AS ink, count(*) FILTER (WHERE ink AND (x > 4 OR y > 4)) AS outside FROM e GROUP BY vec_id""")
def ink_coverage(s: SparkSession, d: str) -> DataFrame:
    """Ink by local contrast, and how much of it lies outside a block."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def ink(v: pd.Series) -> pd.Series:
        return v.map(lambda a: list(R.ink_coverage(gray(a), [(0, 0, 2, 2)])))

    e = table(s, d, "embeddings").select("vec_id", ink("embedding").alias("n"))
    return e.select("vec_id", F.col("n")[0].cast("long").alias("ink"), F.col("n")[1].cast("long").alias("outside"))


@query("""WITH p AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, v > 0 AS k FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS v FROM embeddings) WHERE i < 64),
  e AS (SELECT a.vec_id, a.x, a.y, bool_or(a.k <> b.k) AS ink FROM p a JOIN p b ON a.vec_id = b.vec_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)) GROUP BY ALL), n AS (SELECT vec_id, count(*) FILTER (WHERE ink) AS ink, count(*) FILTER (WHERE ink AND (x > 4 OR y > 4)) AS outside FROM e GROUP BY vec_id)
  SELECT vec_id, ink, round(outside / ink, 3) AS fraction FROM n WHERE ink > 20 AND round(outside / ink, 3) > 0.12 ORDER BY fraction DESC, ink DESC, vec_id LIMIT 40""")
def coverage_audit(s: SparkSession, d: str) -> DataFrame:
    """The forty pages with the largest share of ink outside their blocks, of those with enough ink (over 20 pixels
    of a raster of this size) and a share over 0.12."""
    n = ink_coverage(s, d).withColumn("fraction", F.round(F.col("outside") / F.col("ink"), 3))
    return n.where("ink > 20 AND fraction > 0.12").orderBy(F.desc("fraction"), F.desc("ink"), "vec_id").limit(40).select("vec_id", "ink", "fraction")


@query()
def table_cell_boxes(s: SparkSession, d: str) -> DataFrame:
    """Cells of regular tables laid over the boxes of their printed lines (here an even grid over the block)."""
    cell = StructType([StructField("place", IntegerType()), StructField("box", ArrayType(DoubleType())), StructField("text", StringType())])

    @F.pandas_udf(ArrayType(cell))
    def laid(t: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        def one(text, a, b, c, e):
            rows, _ = B.parse_table(text)
            wide = max((sum(n for _, n in r) for r in rows), default=0)
            if not wide:
                return []
            w, h = (c - a) / wide, (e - b) / len(rows)
            lines = [(a + j * w + 0.05 * w, b + i * h, a + (j + 1) * w - 0.05 * w, b + (i + 1) * h) for i in range(len(rows)) for j in range(wide)]
            return [{"place": k, "box": [float(v) for v in box], "text": u} for k, (box, u) in enumerate(B.layout_table(text, (a, b, c, e), lines) or [])]

        return pd.Series([one(*r) for r in zip(t, x0, y0, x1, y1)], dtype=object)

    b = flat(s, d, F.contains(F.lower("content"), F.lit("<table")), "block_id content bbox").withColumn("box", norm_box(F.col("bbox"))).where("box IS NOT NULL")
    return b.select("page_id", "block_id", F.explode(laid("content", "box.x0", "box.y0", "box.x1", "box.y1")).alias("c")).select("page_id", "block_id", "c.*")


@query("""WITH e AS (SELECT DISTINCT entry_id, 128512 + entry_id % 200 AS cp FROM entries), u AS (SELECT *, list_transform([0, 1, 2], lambda k: '<' || format('{:04x}{:04x}', 55296 + ((cp + k - 65536) // 1024), 56320 + ((cp + k - 65536) % 1024)) || '>') AS t FROM e)
  SELECT entry_id, array_to_string(['1 beginbfchar', '<0041> ' || t[1], 'endbfchar', '1 beginbfrange', '<0010> <0012> [' || t[1] || ' ' || t[2] || ' ' || t[3] || ']', 'endbfrange', '1 begincodespacerange', '<0000> <FFFF> <12345>', 'endcodespacerange'], chr(10)) AS map FROM u""")
def font_maps(s: SparkSession, d: str) -> DataFrame:
    """Character maps with destinations beyond the basic plane as UTF-16 (here a map made for each entry)."""
    cp = F.lower(F.hex(F.lit(128512) + F.col("entry_id") % 200))
    lines = ["1 beginbfchar", F.concat(F.lit("<0041> <"), cp, F.lit(">")), "endbfchar", "1 beginbfrange", F.concat(F.lit("<0010> <0012> <"), cp, F.lit(">")), "endbfrange", "1 begincodespacerange", "<0000> <FFFF> <12345>", "endcodespacerange"]
    e = table(s, d, "entries").select("entry_id").distinct().where("entry_id IS NOT NULL")
    data = F.encode(F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]), "UTF-8")
    return e.select("entry_id", F.decode(repaired_map(data), "UTF-8").alias("map"))


@query("SELECT decision_id, i, round(greatest(r[1] - 1, 0), 3) AS x0, round(greatest(r[2] - 0.7, 0), 3) AS y0, round(r[3] + 1, 3) AS x1, round(r[4] + 0.7, 3) AS y1 FROM (SELECT decision_id, generate_subscripts(rects, 1) - 1 AS i, unnest(rects) AS r FROM (SELECT DISTINCT ON (decision_id) decision_id, rects FROM decisions))")
def crop_rects(s: SparkSession, d: str) -> DataFrame:
    """lines' boxes with their margin, cut to the page."""
    r = table(s, d, "decisions").select("decision_id", "rects").dropDuplicates(["decision_id"]).select("decision_id", F.posexplode("rects").alias("i", "r"))
    g = lambda k: F.get("r", F.lit(k))
    return r.select("decision_id", "i", F.round(F.greatest(g(0) - 1, F.lit(0.0)), 3).alias("x0"), F.round(F.greatest(g(1) - 0.7, F.lit(0.0)), 3).alias("y0"), F.round(g(2) + 1, 3).alias("x1"), F.round(g(3) + 0.7, 3).alias("y1"))


@query()
def split_lines(s: SparkSession, d: str) -> DataFrame:
    """Pieces of a raster that is too wide, with what goes between them."""

    @F.pandas_udf(StringType())
    def pieces(v: pd.Series) -> pd.Series:
        def one(a):
            p, between = R.split_line(np.kron(gray(a).reshape(2, 32), np.ones((4, 8), np.uint8)))
            return "|".join(f"{x.shape[1]}" for x in p) + "/" + "|".join(map(repr, between))

        return v.map(one)

    return table(s, d, "embeddings").select("vec_id", pieces("embedding").alias("pieces"))


@query("SELECT vec_id, sha256(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')) AS pixels FROM embeddings")
def pixel_identity(s: SparkSession, d: str) -> DataFrame:
    """Identity of a raster by its pixels."""
    return table(s, d, "embeddings").select("vec_id", F.sha2(F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), ""), 256).alias("pixels"))


@query("SELECT page_id, CASE run_id % 4 WHEN 0 THEN 10 WHEN 1 THEN height - 20 WHEN 2 THEN width - 10 ELSE 20 END AS x, CASE run_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 10 WHEN 2 THEN height - 20 ELSE width - 10 END AS y FROM (SELECT DISTINCT ON (page_id) page_id, run_id, width, height FROM layout_pages)")
def bookmark_points(s: SparkSession, d: str) -> DataFrame:
    """The place (10, 20) of a page turned by quarter turns (here by run)."""
    p = table(s, d, "layout_pages").select("page_id", "run_id", "width", "height").dropDuplicates(["page_id"])
    turn = F.col("run_id") % 4
    x = F.when(turn == 0, 10.0).when(turn == 1, F.col("height") - 20).when(turn == 2, F.col("width") - 10).otherwise(20.0)
    y = F.when(turn == 0, 20.0).when(turn == 1, 10.0).when(turn == 2, F.col("height") - 20).otherwise(F.col("width") - 10)
    return p.select("page_id", x.alias("x"), y.alias("y"))


@query("SELECT cp, min_by(font, ord) AS font FROM (SELECT DISTINCT unicode(c) AS cp FROM (SELECT unnest(string_split(title, '')) AS c FROM entries WHERE title IS NOT NULL) WHERE c <> '') JOIN (VALUES (1, 'latin', 32, 591), (2, 'hangul', 44032, 55203), (3, 'cjk', 12288, 40959), (4, 'any', 0, 1114111)) f(ord, font, lo, hi) ON cp BETWEEN lo AND hi GROUP BY cp")
def font_choice(s: SparkSession, d: str) -> DataFrame:
    """The first font of a list that has a character."""
    cp = F.expr("ascii(c)")
    c = table(s, d, "entries").where("title IS NOT NULL").select(F.explode(F.split("title", "(?!^)(?=.)")).alias("c")).distinct().where("c <> ''").select(cp.alias("cp"))
    font = F.when(F.col("cp").between(32, 591), "latin").when(F.col("cp").between(44032, 55203), "hangul").when(F.col("cp").between(12288, 40959), "cjk").otherwise("any")
    return c.distinct().select("cp", font.alias("font"))


@query()
def split_texts(s: SparkSession, d: str) -> DataFrame:
    """Texts of decisions divided over their lines' boxes."""

    @F.pandas_udf(ArrayType(StringType()))
    def pieces(t: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([L.split_text(x, [float(b[2] - b[0]) for b in y]) for x, y in zip(t, r)], dtype=object)

    ok = "original IS NOT NULL AND size(rects) > 0 AND forall(rects, r -> size(r) = 4)"
    return table(s, d, "decisions").where(ok).select("decision_id", "original", "rects").dropDuplicates(["decision_id"]).select("decision_id", pieces("original", "rects").alias("pieces"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(least(greatest(10 * l_quantity / greatest(l_extendedprice / 100, 1e-9), 1), greatest(1, least(1.35 * l_discount * 100, 60))), 6) AS size FROM lineitem")
def fitted_sizes(s: SparkSession, d: str) -> DataFrame:
    """Font size that fills a box (widths and heights from the line items)."""
    size = F.least(F.greatest(10 * F.col("l_quantity") / F.greatest(F.col("l_extendedprice") / 100, F.lit(1e-9)), F.lit(1.0)), F.greatest(F.lit(1.0), F.least(1.35 * F.col("l_discount") * 100, F.lit(60.0))))
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(size, 6).alias("size"))
