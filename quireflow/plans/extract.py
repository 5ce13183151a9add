"""Queries: scans, schema extraction, projections and text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import similarity as S
from quireflow.functions import text as T
from quireflow.operators import extract as X
from quireflow.sources.tables import blocks, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PAGES = "SELECT DISTINCT ON (page_id) page_id, run_id, doc_key, page, width, height, parsing_res_list FROM layout_pages"
BLOCKS = f"""SELECT page_id, run_id, page, width, height, ord, b.block_id AS block_id, b.block_label AS label, b.block_content AS content, b.block_bbox AS bbox, b.block_order AS block_order
  FROM (SELECT page_id, run_id, page, width, height, unnest(parsing_res_list) AS b, generate_subscripts(parsing_res_list, 1) AS ord FROM ({PAGES}))"""
BOX = """CASE WHEN len(list_filter(bbox, lambda v: v IS NOT NULL)) >= 4 THEN {'x0': list_min(list_filter(bbox, lambda v, i: i % 2 = 1)), 'y0': list_min(list_filter(bbox, lambda v, i: i % 2 = 0)),
  'x1': list_max(list_filter(bbox, lambda v, i: i % 2 = 1)), 'y1': list_max(list_filter(bbox, lambda v, i: i % 2 = 0))} END"""


#: Names of the block fields in the queries.
NAMES = {"block_label": "label", "block_content": "content", "block_bbox": "bbox"}
PAGE_FIELDS = ("run_id", "page", "width", "height")


def flat(s: SparkSession, d: str, where: Column | str | None = None, fields: str = "block_id label content bbox block_order run_id page width height") -> DataFrame:
    """Blocks with page_id, ord and the named fields, of those that `where` keeps.

    Pages delivered twice are equal, so blocks are filtered first and only what is left is made distinct by page and place:
    filters and the choice of fields reach the files, and no more text is shuffled than the query needs.
    """
    wanted = fields.split()
    inner = [k for k in ("block_id", "block_label", "block_content", "block_bbox", "block_order") if NAMES.get(k, k) in wanted]
    b = blocks(table(s, d, "layout_pages"), *inner, keep=("page_id", *[f for f in PAGE_FIELDS if f in wanted])).withColumnsRenamed(NAMES)
    return (b if where is None else b.where(where)).dropDuplicates(["page_id", "ord"])


def sizes(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "layout_pages").select("page_id", "width", "height").dropDuplicates(["page_id"])


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


@query("SELECT doc_key, coalesce(max(page), 0) AS pages FROM layout_pages GROUP BY doc_key")
def page_count(s: SparkSession, d: str) -> DataFrame:
    """Pages of each book, 0 if unknown."""
    return table(s, d, "layout_pages").groupBy("doc_key").agg(F.coalesce(F.max("page"), F.lit(0)).alias("pages"))


@query("SELECT run_id, (page - 1) // 10 AS batch, min(page) AS first_page, max(page) AS last_page, count(DISTINCT page) AS pages FROM layout_pages GROUP BY ALL")
def batch_chunks(s: SparkSession, d: str) -> DataFrame:
    """Consecutive batches of ten pages."""
    return table(s, d, "layout_pages").groupBy("run_id", F.expr("(page - 1) div 10").alias("batch")).agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.countDistinct("page").alias("pages"))


@query("WITH t AS (SELECT DISTINCT run_id, (page - 1) // 10 AS batch FROM layout_pages), l AS (SELECT *, lag(batch) OVER (PARTITION BY run_id ORDER BY batch) AS before FROM t) SELECT run_id, count(*) AS batches, count(*) FILTER (WHERE coalesce(before, -1) + 1 <> batch) AS gaps FROM l GROUP BY run_id")
def batch_contiguity(s: SparkSession, d: str) -> DataFrame:
    """Whether each batch follows the one before."""
    b = table(s, d, "layout_pages").select("run_id", F.expr("(page - 1) div 10").alias("batch")).distinct()
    before = F.lag("batch").over(Window.partitionBy("run_id").orderBy("batch"))
    return b.withColumn("before", F.coalesce(before, F.lit(-1))).groupBy("run_id").agg(F.count("*").alias("batches"), F.count_if(F.col("before") + 1 != F.col("batch")).alias("gaps"))


@query("SELECT doc_key, coalesce(bool_or(width > height), false) AS needs_flattening, count(DISTINCT page_id) FILTER (WHERE width > height) AS turned FROM layout_pages GROUP BY doc_key")
def needs_flattening(s: SparkSession, d: str) -> DataFrame:
    """Books with any turned page (here: wider than tall)."""
    turned = F.col("width") > F.col("height")
    return table(s, d, "layout_pages").groupBy("doc_key").agg(F.coalesce(F.bool_or(turned), F.lit(False)).alias("needs_flattening"), F.countDistinct(F.when(turned, F.col("page_id"))).alias("turned"))


@query("SELECT doc_id, sha256(text) AS identity FROM documents WHERE text IS NOT NULL")
def source_identity(s: SparkSession, d: str) -> DataFrame:
    """Content hash of each source."""
    return docs(s, d).where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("identity"))


@query("SELECT page_id, CAST(ceil(width) AS BIGINT) * CAST(ceil(height) AS BIGINT) * 3 * 8 + 134217728 AS bytes, row_number() OVER (PARTITION BY run_id ORDER BY page, page_id) AS place FROM (SELECT DISTINCT ON (page_id) page_id, run_id, page, width, height FROM layout_pages) WHERE width > 0 AND height > 0")
def frame_plan(s: SparkSession, d: str) -> DataFrame:
    """Memory of each frame and its place in its file."""
    p = table(s, d, "layout_pages").select("page_id", "run_id", "page", "width", "height").dropDuplicates(["page_id"]).where("width > 0 AND height > 0")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("page", "page_id"))
    return p.select("page_id", (F.ceil("width") * F.ceil("height") * 3 * 8 + 134217728).alias("bytes"), place.alias("place"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 600.0 WHEN page_id % 3 = 0 THEN 118.0 * 2.54 WHEN width > 0 THEN 300.0 ELSE 600.0 END AS dpi, page_id % 5 <> 0 AND page_id % 3 <> 0 AND NOT coalesce(width > 0, false) AS warned,
  round(width / CASE WHEN page_id % 5 = 0 THEN 600.0 WHEN page_id % 3 = 0 THEN 118.0 * 2.54 WHEN width > 0 THEN 300.0 ELSE 600.0 END * 72, 6) AS points
  FROM (SELECT DISTINCT ON (page_id) page_id, width FROM layout_pages)""")
def dpi_resolution(s: SparkSession, d: str) -> DataFrame:
    """Resolution by override, unit (cm to inch) or default with a warning; width in points."""
    p = table(s, d, "layout_pages").select("page_id", "width").dropDuplicates(["page_id"])
    override, cm = F.when(F.col("page_id") % 5 == 0, 600.0), F.when(F.col("page_id") % 3 == 0, 118.0)
    tag = F.when(F.col("width") > 0, 300.0)
    dpi = F.coalesce(override, cm * 2.54, tag, F.lit(600.0))
    return p.select("page_id", dpi.alias("dpi"), (override.isNull() & cm.isNull() & tag.isNull()).alias("warned"), F.round(F.col("width") / dpi * 72, 6).alias("points"))


@query(f"SELECT page_id, string_agg(content, chr(10) ORDER BY ord) AS text FROM ({BLOCKS}) WHERE content IS NOT NULL AND trim(content, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY page_id")
def page_text(s: SparkSession, d: str) -> DataFrame:
    """Contents of a page that are not blank, one below the other, in array order."""
    keep = F.filter("parsing_res_list.block_content", lambda c: F.regexp_replace(c, "[ \\t\\n\\r]+", "") != "")
    p = table(s, d, "layout_pages").select("page_id", F.array_join(keep, "\n").alias("text"), F.size(keep).alias("n"))
    return p.where("n > 0").drop("n").dropDuplicates(["page_id"])


@query("SELECT source, string_agg(CAST(page AS VARCHAR), chr(10) || chr(10) || '---PAGE---' || chr(10) || chr(10) ORDER BY page) AS joined, count(*) AS pages FROM (SELECT DISTINCT source, page FROM documents WHERE source IS NOT NULL AND page IS NOT NULL) GROUP BY source")
def page_separators(s: SparkSession, d: str) -> DataFrame:
    """Pages joined by the separator and counted by splitting again."""
    sep = "\n\n---PAGE---\n\n"
    p = docs(s, d).where("source IS NOT NULL AND page IS NOT NULL").select("source", "page").distinct()
    j = p.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("page")), lambda x: x.cast("string")), sep).alias("joined"))
    return j.withColumn("pages", F.size(F.split("joined", sep)).cast("long"))


@query(f"SELECT page_id, block_id, box.x0 AS x0, box.y0 AS y0, box.x1 AS x1, box.y1 AS y1 FROM (SELECT page_id, block_id, {BOX} AS box FROM ({BLOCKS}))")
def norm_bbox(s: SparkSession, d: str) -> DataFrame:
    """Boxes in order, polygons as their bounds."""
    return flat(s, d, fields="block_id bbox").select("page_id", "block_id", X.norm_box(F.col("bbox")).alias("box")).select("page_id", "block_id", "box.*")


FOUND = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, text, box ORDER BY ord) AS n FROM (SELECT *, trim(regexp_replace(content, '[ \\t\\r\\n\\f\\v]+', ' ', 'g')) AS text, {BOX} AS box FROM ({BLOCKS})) WHERE box IS NOT NULL AND text <> '') WHERE n = 1"""


def found(s: SparkSession, d: str) -> DataFrame:
    return X.find_blocks(flat(s, d, "content IS NOT NULL AND bbox IS NOT NULL").withColumnsRenamed({"content": "block_content", "bbox": "block_bbox"}))


@query(f"SELECT page_id, block_id, text FROM ({FOUND})")
def find_blocks_dedupe(s: SparkSession, d: str) -> DataFrame:
    """Blocks of a page, one of those with the same text and box."""
    return found(s, d).select("page_id", "block_id", "text")


SCALE = f"SELECT p.page_id, coalesce(width, w) AS w, coalesce(height, h) AS h FROM ({PAGES}) p LEFT JOIN (SELECT page_id, max(box.x1) AS w, max(box.y1) AS h FROM ({FOUND}) GROUP BY page_id) e USING (page_id)"


@query(f"SELECT page_id, w, h FROM ({SCALE})")
def page_size(s: SparkSession, d: str) -> DataFrame:
    """Size of a page, else the farthest edges of its blocks."""
    return X.page_scale(sizes(s, d), found(s, d))


def placed(s: SparkSession, d: str) -> DataFrame:
    b = found(s, d)
    return b.join(X.page_scale(sizes(s, d), b), "page_id")


@query(f"SELECT page_id, block_id, round(greatest(box.x0, 0), 3) AS x0, round(greatest(box.y0, 0), 3) AS y0, round(least(box.x1, w), 3) AS x1, round(least(box.y1, h), 3) AS y1 FROM ({FOUND}) JOIN ({SCALE}) USING (page_id) WHERE trim(replace(text, chr(65533), '')) <> '' AND least(least(box.x1, w) - greatest(box.x0, 0), least(box.y1, h) - greatest(box.y0, 0)) >= 1")
def page_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks cut to their page."""
    return X.on_page(placed(s, d)).select("page_id", "block_id", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(f"""SELECT page_id, ord, line, round(x, 6) AS x, round(y, 6) AS y, single FROM (SELECT page_id, ord, box.x0 / w AS x, (box.y0 + (box.y1 - box.y0) / len(lines) * line) / h AS y, len(lines) = 1 AS single, line, raw
  FROM (SELECT *, unnest(lines) AS raw, generate_subscripts(lines, 1) - 1 AS line FROM (SELECT *, string_split(content, chr(10)) AS lines FROM ({FOUND}) JOIN ({SCALE}) USING (page_id)
  WHERE w > 0 AND h > 0 AND 0 <= box.x0 AND box.x0 < box.x1 AND box.x1 <= w AND 0 <= box.y0 AND box.y0 < box.y1 AND box.y1 <= h AND NOT contains(lower(content), '<table')))
  WHERE label IN ('doc_title', 'paragraph_title') AND regexp_replace(raw, '[ \\t]', '', 'g') <> '')""")
def heading_rows(s: SparkSession, d: str) -> DataFrame:
    """Lines of heading blocks with places as shares of the page."""
    b = placed(s, d).where("label IN ('doc_title', 'paragraph_title')").drop("text").withColumnRenamed("block_content", "text")
    return X.text_rows(b).select("page_id", "ord", "line", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "single")


@query("SELECT run_id, pages AS expected, count(DISTINCT l.page) AS got, pages = count(DISTINCT l.page) AS complete FROM (SELECT DISTINCT ON (run_id) run_id, pages FROM run_reports) r JOIN layout_pages l USING (run_id) GROUP BY run_id, pages")
def result_counts(s: SparkSession, d: str) -> DataFrame:
    """Whether a run returned as many pages as it was to."""
    r = table(s, d, "run_reports").select("run_id", "pages").dropDuplicates(["run_id"])
    got = table(s, d, "layout_pages").groupBy("run_id").agg(F.countDistinct("page").alias("got"))
    return r.join(got, "run_id").select("run_id", F.col("pages").alias("expected"), "got", (F.col("pages") == F.col("got")).alias("complete"))


@query(f"SELECT page_id, count(*) AS n_blocks, sha256(string_agg(concat_ws('|', block_id, coalesce(label, ''), coalesce(content, '')), chr(10) ORDER BY ord)) AS snapshot FROM ({BLOCKS}) GROUP BY page_id")
def block_snapshots(s: SparkSession, d: str) -> DataFrame:
    """Hash of what a page's blocks hold."""
    one = F.transform("parsing_res_list", lambda b: F.concat_ws("|", b["block_id"].cast("string"), F.coalesce(b["block_label"], F.lit("")), F.coalesce(b["block_content"], F.lit(""))))
    p = table(s, d, "layout_pages").where("size(parsing_res_list) > 0")
    return p.select("page_id", F.size("parsing_res_list").cast("long").alias("n_blocks"), F.sha2(F.array_join(one, "\n"), 256).alias("snapshot")).dropDuplicates(["page_id"])


@query(f"""SELECT page_id, CASE WHEN page_id % 7 = 0 AND width > 0 AND height > 0 THEN 1 ELSE len(parsing_res_list) END AS n_blocks, CASE WHEN page_id % 7 = 0 AND width > 0 AND height > 0 THEN 'Page ' || page_id ELSE parsing_res_list[1].block_content END AS first_text,
  CASE WHEN page_id % 7 = 0 AND width > 0 AND height > 0 THEN 'reviewed_line' ELSE parsing_res_list[1].block_label END AS first_label FROM ({PAGES}) WHERE parsing_res_list IS NOT NULL""")
def reviewed_layouts(s: SparkSession, d: str) -> DataFrame:
    """Pages with the lines of their reviews in place of their blocks (here every seventh page that has a size was
    reviewed as one line)."""
    one = F.transform("parsing_res_list", lambda b: F.struct(b["block_content"].alias("block_content"), b["block_bbox"].alias("block_bbox"), b["block_label"].alias("block_label")))
    p = table(s, d, "layout_pages").where("page_id IS NOT NULL AND parsing_res_list IS NOT NULL").select(F.col("page_id").cast("string").alias("source_sha256"), "page_id", "page", "width", "height", one.alias("blocks")).dropDuplicates(["page_id"])
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("width") / 2, F.col("height") / 2)
    reviews = p.where("page_id % 7 = 0 AND width > 0 AND height > 0").select("source_sha256", "page", F.lit("cut off").alias("reason"), F.col("blocks").alias("original"), F.array(F.struct(F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("text"), box.alias("bbox"))).alias("lines"))
    r = X.review_layouts(p, reviews)
    return r.select("page_id", F.size("blocks").cast("long").alias("n_blocks"), F.get("blocks", F.lit(0))["block_content"].alias("first_text"), F.get("blocks", F.lit(0))["block_label"].alias("first_label"))


@query("SELECT DISTINCT ON (decision_id) decision_id, CASE WHEN len(selected) > 0 AND accepted THEN array_to_string(before, chr(10)) ELSE original END AS upstream FROM decisions")
def undo_repair(s: SparkSession, d: str) -> DataFrame:
    """The text before an accepted change, else the original."""
    t = table(s, d, "decisions").select("decision_id", "selected", "accepted", "before", "original").dropDuplicates(["decision_id"])
    return t.select("decision_id", F.when((F.size("selected") > 0) & F.col("accepted"), F.array_join("before", "\n")).otherwise(F.col("original")).alias("upstream"))


@query(f"SELECT page_id, block_id, label, length(content) AS chars FROM ({BLOCKS}) WHERE page = 3")
def inspect_blocks(s: SparkSession, d: str) -> DataFrame:
    """X11: blocks of one page number."""
    return flat(s, d, "page = 3", "block_id label content page").select("page_id", "block_id", "label", F.length("content").cast("long").alias("chars"))


TAGS = "(?i)</?(table|tr|td|th|p|div|br|span|b|strong|i|em|img)[\\s/>]"


@query(f"SELECT page_id, block_id FROM ({BLOCKS}) WHERE regexp_matches(content, '{TAGS}')")
def tagged_blocks(s: SparkSession, d: str) -> DataFrame:
    """Blocks with a known element."""
    return flat(s, d, T.has_markup(F.col("content")), "block_id content").select("page_id", "block_id")


UNITS = """list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'), '(?i)</?(td|th|tr|p|div|br)(\\s[^<>]*|/)?/?>', chr(10), 'g'), '(?i)</?(table|tr|td|th|p|div|br|span|b|strong|i|em|img)(\\s[^<>]*|/)?/?>', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\n\\f\\v]+', ' ', 'g'))), lambda x: x <> '')"""


@query(f"SELECT page_id, block_id, len({UNITS}) AS n_units, array_to_string({UNITS}, chr(10)) AS units FROM ({BLOCKS}) WHERE content IS NOT NULL")
def html_units(s: SparkSession, d: str) -> DataFrame:
    """Lines of marked-up text by expressions (entities stay)."""
    b = flat(s, d, "content IS NOT NULL", "block_id content").withColumn("u", T.units_sql(F.col("content")))
    return b.select("page_id", "block_id", F.size("u").cast("long").alias("n_units"), F.array_join("u", "\n").alias("units"))


@query()
def html_units_exact(s: SparkSession, d: str) -> DataFrame:
    """Lines and plain text of marked-up text, exactly."""
    b = flat(s, d, "content IS NOT NULL", "block_id content").withColumn("u", T.units(F.col("content")))
    return b.select("page_id", "block_id", F.size("u").alias("n_units"), F.array_join("u", " ").alias("plain"))


@query()
def flat_math(s: SparkSession, d: str) -> DataFrame:
    """Flat inline formulas as signs."""
    b = flat(s, d, F.contains("content", F.lit("$")), "block_id content")
    return b.select("page_id", "block_id", T.math_flattened(F.col("content")).alias("text"))


@query("""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[가-힣]')) > len(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ヿ]')) THEN 'korean' END AS language FROM documents WHERE text IS NOT NULL""")
def line_language(s: SparkSession, d: str) -> DataFrame:
    """Korean if Hangul outnumber Han and kana."""
    return docs(s, d).where("text IS NOT NULL").select("doc_id", T.line_language(F.col("text")).alias("language"))


#: A title without what stands around it; the SQL engine has no look-ahead, so bars are told by cases.
BARE = f"regexp_replace(regexp_replace(title, '{T.LEAD}', ''), '{T.TAIL}', '')"
CLEAN = f"""trim(CASE WHEN regexp_replace({BARE}, '^[|]|[|]$|[ ]', '', 'g') IN ({", ".join(f"'{x}'" for x in T.DECORATED)}) THEN regexp_replace({BARE}, '^[|]|[|]$|[ ]', '', 'g') WHEN regexp_matches({BARE}, '\\s[|]$') THEN left({BARE}, -1) ELSE {BARE} END)"""
TITLES = "SELECT DISTINCT ON (entry_id) entry_id, run_id, doc_key, title, toc_page, printed_page, folio_style, folio_value, kind, ident, chapter, raw_rank, page FROM entries"


def cleaned(title: Column) -> Column:
    """CLEAN as an expression, whatever white space a title holds. `T.clean_title` joins no words of a decorated title and takes all blanks before a bar."""

    def judge(bare: Column) -> Column:
        whole = F.regexp_replace(bare, T.sql_pattern("^[|]|[|]$|[ ]"), "")
        return F.when(whole.isin(*T.DECORATED), whole).otherwise(F.regexp_replace(bare, T.sql_pattern("(?<=\\s)[|]$"), ""))

    bare = F.regexp_replace(F.regexp_replace(title, T.sql_pattern(T.LEAD), ""), T.sql_pattern(T.TAIL), "")
    return F.trim(F.transform(F.array(bare), judge)[0], F.lit(T.SPACES))


def titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "entries").dropDuplicates(["entry_id"])


@query(f"SELECT entry_id, {CLEAN} AS cleaned, regexp_replace(lower({CLEAN}), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS key FROM ({TITLES}) WHERE title IS NOT NULL")
def title_keys(s: SparkSession, d: str) -> DataFrame:
    """Cleaned titles and their keys."""
    return titles(s, d).where("title IS NOT NULL").select("entry_id", T.clean_title(F.col("title")).alias("cleaned"), T.title_key(F.col("title")).alias("key"))


@query()
def exact_title_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys by composition and case folding."""
    return titles(s, d).where("title IS NOT NULL").select("entry_id", T.exact_key(T.clean_title(F.col("title"))).alias("key"))


@query(f"SELECT page_id, block_id FROM (SELECT page_id, block_id, regexp_replace(lower({CLEAN}), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS key FROM (SELECT *, content AS title FROM ({BLOCKS}))) WHERE key IN ('목차', '차례', 'contents', 'tableofcontents', 'contents(continued)', 'contentscontinued')")
def contents_markers(s: SparkSession, d: str) -> DataFrame:
    """Blocks that announce printed contents."""
    return flat(s, d, T.is_marker(F.col("content")), "block_id content").select("page_id", "block_id")


ROMAN = "^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


@query(f"""WITH t AS (SELECT DISTINCT printed_page AS token FROM entries WHERE printed_page IS NOT NULL), r AS (SELECT token, upper(token) AS u FROM t)
  SELECT token, CASE WHEN regexp_matches(token, '^[0-9]{{1,5}}$') AND TRY_CAST(token AS INT) > 0 THEN 'arabic' WHEN u <> '' AND regexp_matches(u, '{ROMAN}') THEN 'roman' END AS style,
  CASE WHEN regexp_matches(token, '^[0-9]{{1,5}}$') AND TRY_CAST(token AS INT) > 0 THEN TRY_CAST(token AS INT) WHEN u <> '' AND regexp_matches(u, '{ROMAN}') THEN
    (list_sum(list_transform(string_split(u, ''), lambda c: CASE c WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 ELSE 1000 END))
     - 2 * (len(regexp_extract_all(u, 'I[VX]')) + 10 * len(regexp_extract_all(u, 'X[LC]')) + 100 * len(regexp_extract_all(u, 'C[DM]'))))::INT END AS value FROM r""")
def folio_parse(s: SparkSession, d: str) -> DataFrame:
    """Printed page numbers as style and value."""
    t = table(s, d, "entries").where("printed_page IS NOT NULL").select(F.col("printed_page").alias("token")).distinct()
    return t.withColumn("f", T.folio(F.col("token"))).select("token", "f.style", "f.value")


GROUPS = ", ".join(f"regexp_extract(t, '{T.LEADING}', {k}) AS g{k}" for k in range(1, 6))
HEAD = f"SELECT entry_id, t, {GROUPS}, regexp_extract(t, '{T.LETTERED}') AS sec FROM (SELECT entry_id, {CLEAN} AS t FROM ({TITLES}) WHERE title IS NOT NULL)"


@query(f"""WITH h AS ({HEAD}), k AS (SELECT *, CASE WHEN lower(g1) IN ('부록', 'appendix') AND regexp_matches(g2, '^[A-Za-z]$') AND g3 <> '' AND g4 || g5 <> '' THEN 1 WHEN regexp_matches(g1, '^[A-Za-z]{{2,7}}$') AND regexp_matches(g2, '^[0-9]+$') AND g3 <> '' AND g4 || g5 <> '' THEN 2
    WHEN g1 IN ('', '제') AND regexp_matches(g2, '^[0-9]+$') AND g4 <> '' THEN 3 WHEN lower(g1) = 'lab' AND regexp_matches(g2, '^[0-9]+[.]') THEN 4 WHEN g1 = '' AND regexp_matches(g2, '^[0-9]+[.]') THEN 5 WHEN sec <> '' THEN 6 ELSE 7 END AS rule FROM h)
  SELECT entry_id, CASE WHEN rule <= 3 THEN 'chapter' WHEN rule = 4 THEN 'lab' WHEN rule <= 6 THEN 'section' ELSE 'plain' END AS kind, CASE rule WHEN 1 THEN upper(g2) WHEN 2 THEN regexp_replace(g2, '^0+(.)', '\\1') WHEN 3 THEN regexp_replace(g2, '^0+(.)', '\\1') WHEN 4 THEN g2 WHEN 5 THEN g2 WHEN 6 THEN sec END AS ident,
  CASE rule WHEN 1 THEN g4 || g5 WHEN 2 THEN g4 || g5 WHEN 3 THEN ltrim(g5) WHEN 4 THEN g4 || g5 WHEN 5 THEN g4 || g5 WHEN 6 THEN ltrim(t[length(sec) + 1:]) ELSE t END AS lexical FROM k""")
def heading_identity(s: SparkSession, d: str) -> DataFrame:
    """What the numbering of a title says it is."""
    return titles(s, d).where("title IS NOT NULL").select("entry_id", T.identity(cleaned(F.col("title"))).alias("i")).select("entry_id", "i.*")


@query(f"SELECT entry_id, translate(regexp_replace(lower({CLEAN}), '[ \\t\\r\\n\\f\\v]+', '', 'g'), '：–—', ':--') AS key FROM ({TITLES}) WHERE title IS NOT NULL")
def lexical_keys(s: SparkSession, d: str) -> DataFrame:
    """Keys with one colon and one dash."""
    return titles(s, d).where("title IS NOT NULL").select("entry_id", T.lexical_key(F.col("title")).alias("key"))


@query("SELECT doc_id, length(text) - length(replace(text, chr(65533), '')) AS undecodable, length(replace(text, '〜', '～')) AS chars FROM documents WHERE text IS NOT NULL")
def undecodable(s: SparkSession, d: str) -> DataFrame:
    """Replacement characters counted, equal signs folded."""
    t = F.col("text")
    return docs(s, d).where("text IS NOT NULL").select("doc_id", (F.length(t) - F.length(F.replace(t, F.lit(chr(0xFFFD)), F.lit("")))).cast("long").alias("undecodable"), F.length(F.translate(t, "〜", "～")).cast("long").alias("chars"))


@query("SELECT doc_id, regexp_replace(lower(text), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS dense FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '^[\\x20-\\x7e\\s]*$')")
def dense_text(s: SparkSession, d: str) -> DataFrame:
    """ASCII texts without white space and case; `dense_text_whole` has all."""
    return docs(s, d).where(F.col("text").rlike("^[\\x20-\\x7e\\s]*$")).select("doc_id", T.dense(F.col("text"), fold=True).alias("dense"))


@query()
def dense_text_whole(s: SparkSession, d: str) -> DataFrame:
    """Every text without markup, white space and case."""
    return docs(s, d).where("text IS NOT NULL").select("doc_id", S.dense_folded(F.col("text")).alias("dense"))


HEADS = f"""SELECT page_id, page, run_id, ord, line, length(regexp_extract(raw, '^(#{{1,4}})\\s+(.+)$', 1)) AS level, trim(regexp_replace(regexp_extract(raw, '^(#{{1,4}})\\s+(.+)$', 2), '[*_`]', '', 'g')) AS title
  FROM (SELECT *, trim(unnest(string_split(content, chr(10)))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM ({BLOCKS}) WHERE content IS NOT NULL) WHERE regexp_matches(raw, '^#{{1,4}}\\s+.+$')"""


@query(f"SELECT page_id, ord, level, CAST(i + least(0, min(level - i) OVER (PARTITION BY run_id ORDER BY i)) AS BIGINT) AS clamped, title FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY page, page_id, ord, line) AS i FROM ({HEADS}) WHERE length(title) BETWEEN 2 AND 80)")
def markdown_toc(s: SparkSession, d: str) -> DataFrame:
    """Markdown headings of a run, no level more than one below the one before."""
    b = flat(s, d, F.contains("content", F.lit("#")), "content run_id page").select("*", F.posexplode(F.split("content", "\n")).alias("line", "raw")).withColumn("raw", F.trim("raw"))
    pattern = "^(#{1,4})\\s+(.+)$"
    h = b.where(F.col("raw").rlike(pattern)).withColumn("level", F.length(F.regexp_extract("raw", pattern, 1)).cast("long"))
    h = h.withColumn("title", F.trim(F.regexp_replace(F.regexp_extract("raw", pattern, 2), "[*_`]", ""))).where("length(title) BETWEEN 2 AND 80")
    h = h.withColumn("i", F.row_number().over(Window.partitionBy("run_id").orderBy("page", "page_id", "ord", "line")))
    least = F.min(F.col("level") - F.col("i")).over(Window.partitionBy("run_id").orderBy("i"))
    return h.select("page_id", "ord", "level", (F.col("i") + F.least(F.lit(0), least)).cast("long").alias("clamped"), "title")


@query(f"SELECT page_id, block_id, starts_with(lower(trim(content)), '<table') AS is_table, (length(lower(content)) - length(replace(lower(content), '<table', ''))) // 6 AS tables FROM ({BLOCKS}) WHERE contains(lower(content), '<table')")
def table_sources(s: SparkSession, d: str) -> DataFrame:
    """Blocks that are one table."""
    low = F.lower("content")
    return flat(s, d, F.contains(low, F.lit("<table")), "block_id content").select("page_id", "block_id", F.startswith(F.lower(F.trim("content")), F.lit("<table")).alias("is_table"), F.expr("(length(lower(content)) - length(replace(lower(content), '<table', ''))) div 6").alias("tables"))


@query("""SELECT source, count(*) AS texts, sum(length(regexp_replace(text, '[ \\t\\r\\n\\f\\v]+', '', 'g'))) AS dense_chars, sum(len(regexp_extract_all(text, '[0-9]+([.,-][0-9]+)*'))) AS numbers,
  count(*) FILTER (WHERE len(regexp_extract_all(text, '[가-힣]')) > len(regexp_extract_all(text, '[一-鿿㐀-䶿぀-ヿ]'))) AS korean FROM documents WHERE text IS NOT NULL GROUP BY source""")
def document_text_audit(s: SparkSession, d: str) -> DataFrame:
    """Flagship: per source, dense length, numbers and Korean texts."""
    t = F.col("text")
    return docs(s, d).where("text IS NOT NULL").groupBy("source").agg(
        F.count("*").alias("texts"), F.sum(F.length(T.dense(t))).alias("dense_chars"), F.sum(F.size(F.regexp_extract_all(t, F.lit("[0-9]+(?:[.,-][0-9]+)*"), F.lit(0)))).alias("numbers"), F.count_if(T.line_language(t) == "korean").alias("korean")
    )
