"""Queries: guards, alignment, audits and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.functions import similarity as S
from quireflow.functions import text as T
from quireflow.operators.profile import by_key, exact_median
from quireflow.plans.extract import BLOCKS, flat
from quireflow.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Each decision once, its lines as one text.
DECISIONS = "SELECT DISTINCT ON (decision_id) *, array_to_string(candidate, ' ') AS other FROM decisions"


def decisions(s: SparkSession, d: str, where: Column | str | None = None, *columns: str) -> DataFrame:
    """Decisions that `where` keeps, each once, with `other`, the lines of the second reading as one text. Those delivered
    twice are equal, so they are filtered and cut to the named columns first."""
    t = table(s, d, "decisions").select("decision_id", *(columns or ("original", "candidate", "run_id", "page"))).withColumn("other", F.array_join("candidate", " "))
    return (t if where is None else t.where(where)).dropDuplicates(["decision_id"])


def delivered(s: SparkSession, d: str) -> DataFrame:
    """Decisions as delivered, spread for costly comparisons; their results are made distinct, not their texts."""
    return spread(table(s, d, "decisions").select("decision_id", "run_id", "page", "original", "candidate")).withColumn("other", F.array_join("candidate", " "))


NUMS = "regexp_extract_all({}, '[0-9]+(?:[.,-][0-9]+)*')"


@query(f"SELECT decision_id, len({NUMS.format('original')}) AS n, array_to_string({NUMS.format('original')}, ' ') AS tokens FROM ({DECISIONS}) WHERE original IS NOT NULL AND NOT contains(original, '@')")
def critical_tokens(s: SparkSession, d: str) -> DataFrame:
    """Numbers in order with repeats, of texts without an at sign; `critical_tokens_whole` has all."""
    t = decisions(s, d, "original IS NOT NULL AND NOT contains(original, '@')").withColumn("t", T.critical_tokens(F.col("original")))
    return t.select("decision_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query()
def critical_tokens_whole(s: SparkSession, d: str) -> DataFrame:
    """Numbers, and addresses where the text has an at sign, in order with repeats, of every original."""
    t = decisions(s, d, "original IS NOT NULL").select("decision_id", S.critical_of(F.col("original")).alias("t"))
    return t.select("decision_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(f"SELECT decision_id, CASE WHEN length(original) + length(other) > 0 THEN round(2 * least(length(original), length(other)) / (length(original) + length(other)), 6) ELSE 1 END AS bound, original = other AS same FROM ({DECISIONS}) WHERE original IS NOT NULL AND other IS NOT NULL")
def similarity_bound(s: SparkSession, d: str) -> DataFrame:
    """Bound of the ratio by lengths, and equality."""
    t = decisions(s, d, "original IS NOT NULL AND other IS NOT NULL")
    return t.select("decision_id", F.round(S.upper_bound(F.col("original"), F.col("other")), 6).alias("bound"), (F.col("original") == F.col("other")).alias("same"))


@query()
def similarity_ratio(s: SparkSession, d: str) -> DataFrame:
    """The exact ratio of original and second reading."""
    return delivered(s, d).select("decision_id", F.round(S.similarity(F.col("original"), F.col("other")), 6).alias("ratio")).dropDuplicates(["decision_id"])


@query()
def line_guards(s: SparkSession, d: str) -> DataFrame:
    """The three guards of a second reading."""
    return delivered(s, d).select("decision_id", *[S.guard(g, F.col("original"), F.col("candidate")).alias(g) for g in ("refinement_is_safe", "disagrees", "boundaries_usable")]).dropDuplicates(["decision_id"])


@query()
def aligned_lines(s: SparkSession, d: str) -> DataFrame:
    """Originals cut where the second reading's lines end."""
    t = delivered(s, d).where("size(candidate) > 0 AND NOT exists(candidate, x -> x IS NULL)")
    return t.select("decision_id", S.align(F.col("original"), F.col("candidate")).alias("lines")).dropDuplicates(["decision_id"])


@query()
def conserved_lines(s: SparkSession, d: str) -> DataFrame:
    """Whether alignment keeps every character of the text without markup, by run."""
    t = decisions(s, d, "original IS NOT NULL AND size(candidate) > 0 AND NOT exists(candidate, x -> x IS NULL)")
    t = t.withColumn("lines", S.align(F.col("original"), F.col("candidate")))
    same = T.bare(F.array_join("lines", "")) == T.bare(T.stripped(F.col("original")))
    return t.groupBy("run_id").agg(F.count("*").alias("blocks"), F.count_if(~same).alias("failures"), F.sum(F.size(F.filter("lines", lambda x: x == ""))).alias("empty_chunks"))


WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"


@query(f"""WITH t AS (SELECT decision_id, original, other, {WORDS.format('original')} AS a, {WORDS.format('other')} AS b FROM ({DECISIONS}) WHERE original IS NOT NULL AND other IS NOT NULL)
  SELECT decision_id, len(a) AS n_words, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda z: z = x)))))::BIGINT AS common FROM t WHERE len(a) > 0 AND regexp_matches(original, '^[\\x20-\\x7e\\s]*$') AND regexp_matches(other, '^[\\x20-\\x7e\\s]*$')""")
def word_coverage(s: SparkSession, d: str) -> DataFrame:
    """Words of the original that the second reading has, with repeats (ASCII texts; `word_coverage_whole` has all)."""
    t = decisions(s, d, F.col("original").rlike("^[\\x20-\\x7e\\s]*$") & F.col("other").rlike("^[\\x20-\\x7e\\s]*$"))
    a, b = S.words(F.col("original")), S.words(F.col("other"))
    return t.select("decision_id", F.size(a).cast("long").alias("n_words"), S.bag_common(a, b).cast("long").alias("common")).where("n_words > 0")


@query()
def word_coverage_whole(s: SparkSession, d: str) -> DataFrame:
    """Words of the original that the second reading has, with repeats, in any script."""
    t = decisions(s, d, "original IS NOT NULL AND other IS NOT NULL")
    a, b = S.words(F.col("original")), S.words(F.col("other"))
    return t.select("decision_id", F.size(a).cast("long").alias("n_words"), S.bag_common(a, b).cast("long").alias("common")).where("n_words > 0")


@query()
def repair_is_safe(s: SparkSession, d: str) -> DataFrame:
    """Whether each second reading could replace the original."""
    return decisions(s, d, "original IS NOT NULL").select("decision_id", S.repair_is_safe(F.col("original"), F.coalesce("other", F.lit(""))).alias("safe"))


@query(f"""WITH t AS (SELECT decision_id, regexp_replace(original, '\\s+', '', 'g') AS a, regexp_replace(other, '\\s+', '', 'g') AS b, original, other FROM ({DECISIONS}) WHERE regexp_matches(original, '^[a-zA-Z0-9., \\n-]+$') AND regexp_matches(other, '^[a-zA-Z0-9., \\n-]+$'))
  SELECT decision_id, b LIKE '%' || array_to_string(string_split(a, ''), '%') || '%' AND length(b) <= greatest(1.6 * length(a), length(a) + 32) AND list_sort(regexp_extract_all(original, '[0-9]+')) = list_sort(list_filter(regexp_extract_all(other, '[0-9]+'), lambda x: true)) AS preserved FROM t""")
def preserves_content(s: SparkSession, d: str) -> DataFrame:
    """Whether the second reading keeps every character of the original in order (here: the same numbers, plain ASCII texts; `preserves_content_whole` has all)."""
    t = decisions(s, d, F.col("original").rlike("^[a-zA-Z0-9., \\n-]+$") & F.col("other").rlike("^[a-zA-Z0-9., \\n-]+$"))
    n = lambda c: F.array_sort(F.regexp_extract_all(F.col(c), F.lit("[0-9]+"), F.lit(0)))
    return t.select("decision_id", (S.preserves_content(F.col("original"), F.col("other")) & (n("original") == n("other"))).alias("preserved"))


@query()
def preserves_content_whole(s: SparkSession, d: str) -> DataFrame:
    """Whether the second reading keeps every character and number of the original, in any script, markup aside."""
    t = decisions(s, d, "original IS NOT NULL AND other IS NOT NULL")
    return t.select("decision_id", S.content_kept(F.col("original"), F.col("other")).alias("preserved"))


@query(f"""WITH t AS (SELECT decision_id, regexp_replace(lower(original), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS a, regexp_replace(lower(array_to_string(candidate, '')), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS b, candidate FROM ({DECISIONS}) WHERE original IS NOT NULL AND candidate IS NOT NULL)
  SELECT decision_id, a <> '' AND b <> '' AND len(list_filter(candidate, lambda x: coalesce(trim(x), '') = '')) = 0 AND length(b) BETWEEN 0.75 * length(a) AND 1.25 * length(a) AS usable FROM t""")
def length_ratio_usable(s: SparkSession, d: str) -> DataFrame:
    """The length part of the boundary guard."""
    t = decisions(s, d, "original IS NOT NULL AND candidate IS NOT NULL")
    a, b = T.dense(F.col("original"), fold=True), T.dense(F.array_join("candidate", ""), fold=True)
    blank = F.exists("candidate", lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    return t.select("decision_id", ((a != "") & (b != "") & ~blank & F.length(b).between(0.75 * F.length(a), 1.25 * F.length(a))).alias("usable"))


@query("""WITH b AS (SELECT doc_key, page, run_id, ord, bl.block_content AS c, bl.block_label AS l FROM (SELECT doc_key, page, run_id, unnest(parsing_res_list) AS bl, generate_subscripts(parsing_res_list, 1) AS ord FROM (SELECT DISTINCT ON (run_id, page) * FROM layout_pages ORDER BY run_id, page, page_id))),
  r AS (SELECT doc_key, min(run_id) AS first_run, max(run_id) AS last_run FROM layout_pages GROUP BY doc_key HAVING count(DISTINCT run_id) > 1),
  x AS (SELECT r.doc_key, b.page, b.ord, b.c, b.l FROM r JOIN b ON b.run_id = first_run), y AS (SELECT r.doc_key, b.page, b.ord, b.c, b.l FROM r JOIN b ON b.run_id = last_run)
  SELECT coalesce(x.doc_key, y.doc_key) AS doc_key, coalesce(x.page, y.page) AS page, coalesce(x.ord, y.ord) AS ord, x.c IS DISTINCT FROM y.c AS text_differs, x.l IS DISTINCT FROM y.l AS label_differs,
    x.doc_key IS NULL OR y.doc_key IS NULL OR regexp_replace(coalesce(x.c, ''), '[ \\t\\r\\n\\f\\v]+', '', 'g') <> regexp_replace(coalesce(y.c, ''), '[ \\t\\r\\n\\f\\v]+', '', 'g') AS substantive
  FROM x FULL JOIN y ON x.doc_key = y.doc_key AND x.page = y.page AND x.ord = y.ord WHERE x.c IS DISTINCT FROM y.c OR x.l IS DISTINCT FROM y.l""")
def block_differences(s: SparkSession, d: str) -> DataFrame:
    """Blocks that differ between the first and the last run of a book, and whether in more than white space."""
    p = table(s, d, "layout_pages").groupBy("doc_key", "run_id", "page").agg(F.min_by("parsing_res_list", "page_id").alias("l"))
    r = p.groupBy("doc_key").agg(F.min("run_id").alias("a"), F.max("run_id").alias("b")).where("a <> b")
    b = p.join(r, "doc_key").where("run_id = a OR run_id = b").select("doc_key", "page", (F.col("run_id") == F.col("a")).alias("first"), F.posexplode("l").alias("ord", "bl"))
    b = b.select("doc_key", "page", "first", (F.col("ord") + 1).cast("long").alias("ord"), F.col("bl.block_content").alias("c"), F.col("bl.block_label").alias("l"))
    x = b.where("first").select("doc_key", "page", "ord", F.col("c").alias("xc"), F.col("l").alias("xl"), F.lit(True).alias("x"))
    y = b.where("NOT first").select("doc_key", "page", "ord", F.col("c").alias("yc"), F.col("l").alias("yl"), F.lit(True).alias("y"))
    j = x.join(y, ["doc_key", "page", "ord"], "full")
    text, label = ~F.col("xc").eqNullSafe(F.col("yc")), ~F.col("xl").eqNullSafe(F.col("yl"))
    bare = lambda c: T.dense(F.coalesce(c, F.lit("")))
    return j.where(text | label).select("doc_key", "page", "ord", text.alias("text_differs"), label.alias("label_differs"), (F.col("x").isNull() | F.col("y").isNull() | (bare("xc") != bare("yc"))).alias("substantive"))


#: Without what Unicode calls white space.
INKED = "regexp_replace({}, '[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]+', '', 'g')"


@query(f"""SELECT page_id, a.block_id AS block_id, b.block_id IS NOT NULL AND coalesce({INKED.format("b.content")} = {INKED.format("a.original")}, false) AS passed FROM (SELECT DISTINCT ON (page_id, block_id) page_id, block_id, original FROM decisions ORDER BY page_id, block_id, decision_id) a LEFT JOIN ({BLOCKS}) b USING (page_id, block_id)""")
def expected_text(s: SparkSession, d: str) -> DataFrame:
    """Whether each block's whole text is the one expected of it, white space aside; a missing block fails.

    Decisions hold no box, so identity is by page and block.
    """
    e = table(s, d, "decisions").groupBy("page_id", "block_id").agg(F.min_by("original", "decision_id").alias("original"))
    b = flat(s, d, fields="block_id content").select("page_id", "block_id", "content", F.lit(True).alias("there"))
    j = e.join(b, ["page_id", "block_id"], "left")
    return j.select("page_id", "block_id", (F.col("there").isNotNull() & F.coalesce(T.bare("content") == T.bare("original"), F.lit(False))).alias("passed"))


BAND = "CASE WHEN other IS NULL OR other = '' THEN 'no recognizer output' WHEN r >= 0.99 THEN '0.99+' WHEN r >= 0.95 THEN '0.95+' WHEN r >= 0.90 THEN '0.90+' ELSE 'under 0.90' END"


@query(f"SELECT {BAND} AS band, count(*) AS blocks FROM (SELECT *, 2 * least(length(original), length(other)) / (length(original) + length(other)) AS r FROM ({DECISIONS}) WHERE length(original) > 0) GROUP BY band")
def agreement_bands(s: SparkSession, d: str) -> DataFrame:
    """Decisions by band of agreement (the length bound stands for the ratio here)."""
    t = decisions(s, d, "length(original) > 0").withColumn("r", S.upper_bound(F.col("original"), F.col("other")))
    return t.groupBy(F.expr(BAND).alias("band")).agg(F.count("*").alias("blocks"))


def agreements(s: SparkSession, d: str) -> DataFrame:
    t = delivered(s, d).where("length(original) > 0")
    return t.select("decision_id", "run_id", "page", "original", "other", F.when(F.coalesce("other", F.lit("")) != "", S.similarity(T.dense(F.col("original")), T.dense(F.col("other")))).alias("r")).dropDuplicates(["decision_id"])


@query()
def agreement_exact(s: SparkSession, d: str) -> DataFrame:
    """Bands by the exact ratio, with the mean weighted by characters."""
    t = agreements(s, d)
    n = F.length("original")
    return t.groupBy(F.expr(BAND).alias("band")).agg(F.count("*").alias("blocks"), F.round(F.coalesce(F.sum(F.col("r") * n) / F.sum(F.when(F.col("r").isNotNull(), n)), F.lit(0.0)), 4).alias("weighted"))


@query(f"SELECT run_id, round(coalesce(sum(r * length(original)) / sum(length(original)), 0), 4) AS weighted FROM (SELECT *, 2 * least(length(original), length(other)) / (length(original) + length(other)) AS r FROM ({DECISIONS}) WHERE length(original) > 0 AND other <> '') GROUP BY run_id")
def weighted_agreement(s: SparkSession, d: str) -> DataFrame:
    """Bound by lengths of the mean agreement weighted by characters; `weighted_agreement_exact` has the agreement itself."""
    t = decisions(s, d, "length(original) > 0 AND other <> ''").withColumn("r", S.upper_bound(F.col("original"), F.col("other")))
    return t.groupBy("run_id").agg(F.round(F.coalesce(F.sum(F.col("r") * F.length("original")) / F.sum(F.length("original")), F.lit(0.0)), 4).alias("weighted"))


@query(f"SELECT run_id, page, round(min(r), 6) AS worst FROM (SELECT *, 2 * least(length(original), length(other)) / (length(original) + length(other)) AS r FROM ({DECISIONS}) WHERE length(original) > 0 AND other <> '') GROUP BY run_id, page ORDER BY min(r), run_id, page LIMIT 12")
def worst_pages(s: SparkSession, d: str) -> DataFrame:
    """The twelve pages of least bound by lengths, a stand-in for agreement; `worst_pages_exact` has the agreement itself."""
    t = decisions(s, d, "length(original) > 0 AND other <> ''").withColumn("r", S.upper_bound(F.col("original"), F.col("other")))
    return t.groupBy("run_id", "page").agg(F.min("r").alias("r")).orderBy("r", "run_id", "page").limit(12).select("run_id", "page", F.round("r", 6).alias("worst"))


@query()
def weighted_agreement_exact(s: SparkSession, d: str) -> DataFrame:
    """Mean exact agreement of a run weighted by characters."""
    t = agreements(s, d).where("r IS NOT NULL")
    n = F.length("original")
    return t.groupBy("run_id").agg(F.round(F.coalesce(F.sum(F.col("r") * n) / F.sum(n), F.lit(0.0)), 4).alias("weighted"))


@query()
def worst_pages_exact(s: SparkSession, d: str) -> DataFrame:
    """The twelve pages of least exact agreement of each run."""
    t = agreements(s, d).where("r IS NOT NULL").groupBy("run_id", "page").agg(F.min("r").alias("r"))
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("r", "page"))
    return t.withColumn("place", n).where("place <= 12").select("run_id", "page", F.round("r", 6).alias("worst"), F.col("place").cast("long").alias("place"))


ITEM = "(?m)^[ \\t]*([0-9]{1,3})[.)]\\s"


@query(f"""WITH i AS (SELECT run_id, page, CAST(unnest(regexp_extract_all(content, '{ITEM}', 1)) AS INT) AS item FROM ({BLOCKS}) WHERE content IS NOT NULL), c AS (SELECT run_id, item, count(*) AS n, list_sort(list_distinct(list(page))) AS pages FROM i GROUP BY ALL), r AS (SELECT DISTINCT run_id FROM layout_pages)
  SELECT r.run_id, k.item, coalesce(c.n, 0) AS seen, coalesce(array_to_string(c.pages, ','), '') AS pages FROM r CROSS JOIN (SELECT unnest(generate_series(1, 9))::INT AS item) k LEFT JOIN c ON c.run_id = r.run_id AND c.item = k.item WHERE coalesce(c.n, 0) < 2""")
def sequence_audit(s: SparkSession, d: str) -> DataFrame:
    """Numbered items 1 to 9 seen fewer than twice in a run, with their pages."""
    i = flat(s, d, F.col("content").rlike(ITEM), "content run_id page").select("run_id", "page", F.explode(F.regexp_extract_all("content", F.lit(ITEM), F.lit(1))).alias("item")).withColumn("item", F.col("item").cast("int"))
    c = i.groupBy("run_id", "item").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("page")).alias("p"))
    want = table(s, d, "layout_pages").select("run_id").distinct().select("run_id", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("item"))
    j = want.join(c, ["run_id", "item"], "left").withColumn("seen", F.coalesce("n", F.lit(0))).where("seen < 2")
    return j.select("run_id", "item", "seen", F.coalesce(F.array_join(F.transform("p", lambda x: x.cast("string")), ","), F.lit("")).alias("pages"))


@query("SELECT l_orderkey, round(sum(l_quantity) / greatest(0.1, 0.46 * median(l_discount + 1)), 6) AS expected, count(*) AS lines, count(*) >= 3 AND sum(l_quantity) / greatest(0.1, 0.46 * median(l_discount + 1)) >= 200 AS lost FROM lineitem GROUP BY l_orderkey")
def expected_chars(s: SparkSession, d: str) -> DataFrame:
    """Characters expected of boxes by width and median height, and whether text is lost."""
    e = F.sum("l_quantity") / F.greatest(F.lit(0.1), 0.46 * F.median(F.col("l_discount") + 1))
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(e.alias("e"), F.count("*").alias("lines"))
    return g.select("l_orderkey", F.round("e", 6).alias("expected"), "lines", ((F.col("lines") >= 3) & (F.col("e") >= 200)).alias("lost"))


CHARS = "SELECT {k}, c, count(*) AS n FROM (SELECT {k}, unnest(string_split(regexp_replace(translate({t}, '〜', '～'), '[ \\t\\r\\n\\f\\v]+', '', 'g'), '')) AS c FROM {f}) WHERE c <> '' GROUP BY ALL"


def chars(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, c, n): how often each character that is no white space stands in the texts of a key, equal signs folded."""
    t = T.dense(F.translate(F.col(text), "〜", "～"))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.split(t, "(?!^)(?=.)")).alias("c")).where("c <> ''").groupBy(key, "c").agg(F.count("*").alias("n"))


@query(CHARS.format(k="run_id", t="content", f=f"({BLOCKS}) WHERE content IS NOT NULL"))
def char_multiset(s: SparkSession, d: str) -> DataFrame:
    """Bag of characters of a run."""
    return chars(flat(s, d, "content IS NOT NULL", "content run_id"), "run_id", "content")


@query(f"""WITH a AS ({CHARS.format(k='decision_id', t='original', f=f'({DECISIONS}) WHERE original IS NOT NULL')}), b AS ({CHARS.format(k='decision_id', t='other', f=f'({DECISIONS}) WHERE other IS NOT NULL')})
  SELECT decision_id, sum(greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0))::BIGINT AS missing, sum(greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0))::BIGINT AS extra FROM a FULL JOIN b USING (decision_id, c) GROUP BY decision_id""")
def char_multiset_diff(s: SparkSession, d: str) -> DataFrame:
    """Characters the second reading lacks and has too many, with repeats."""
    # Both texts are in one row: each different character is counted in both by what its removal takes away.
    t = decisions(s, d, "original IS NOT NULL OR other IS NOT NULL")
    bare = lambda c: T.dense(F.translate(F.coalesce(c, F.lit("")), "〜", "～"))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    over = lambda a, b: F.aggregate(F.array_distinct(F.split(F.col(a), "(?!^)(?=.)")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.greatest(times(F.col(a), c) - times(F.col(b), c), F.lit(0))))
    t = t.select("decision_id", bare("original").alias("a"), bare("other").alias("b")).where("a <> '' OR b <> ''")
    return t.select("decision_id", over("a", "b").cast("long").alias("missing"), over("b", "a").cast("long").alias("extra"))


#: Warnings that make a result invalid.
FATAL = ("pixel_mismatch", "text_mismatch", "page_count_mismatch")
RUNS = "SELECT DISTINCT ON (run_id) * FROM run_reports"


def runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "run_reports").dropDuplicates(["run_id"])


@query(f"SELECT run_id, CASE WHEN list_has_any(warnings, ['pixel_mismatch', 'text_mismatch', 'page_count_mismatch']) THEN 'validation_failed' WHEN len(warnings) > 0 THEN 'completed_with_warnings' ELSE 'completed' END AS status, array_to_string(list_sort(list_distinct(review_pages)), ',') AS review FROM ({RUNS})")
def doc_status(s: SparkSession, d: str) -> DataFrame:
    """Status of a run by its warnings; pages to review."""
    status = F.when(F.arrays_overlap("warnings", F.array(*map(F.lit, FATAL))), "validation_failed").when(F.size("warnings") > 0, "completed_with_warnings").otherwise("completed")
    return runs(s, d).select("run_id", status.alias("status"), F.array_join(F.transform(F.array_sort(F.array_distinct("review_pages")), lambda x: x.cast("string")), ",").alias("review"))


@query(f"SELECT status, count(*) AS runs, round(sum(elapsed_seconds), 3) AS seconds, sum(pages)::BIGINT AS pages, sum(len(review_pages))::BIGINT AS reviews FROM ({RUNS}) GROUP BY status")
def batch_summary(s: SparkSession, d: str) -> DataFrame:
    """A10: runs, seconds, pages and reviews by status."""
    return runs(s, d).groupBy("status").agg(F.count("*").alias("runs"), F.round(F.sum("elapsed_seconds"), 3).alias("seconds"), F.sum("pages").alias("pages"), F.sum(F.size("review_pages")).alias("reviews"))


@query("SELECT kind, count(*) AS entries FROM (SELECT DISTINCT ON (entry_id) entry_id, kind FROM entries) GROUP BY kind")
def evidence_counts(s: SparkSession, d: str) -> DataFrame:
    """Entries by kind of evidence."""
    return table(s, d, "entries").dropDuplicates(["entry_id"]).groupBy("kind").agg(F.count("*").alias("entries"))


@query(f"""WITH p AS (SELECT run_id, count(DISTINCT page_id) AS pages FROM layout_pages GROUP BY run_id), e AS (SELECT run_id, count(DISTINCT entry_id) AS entries FROM entries GROUP BY run_id), c AS (SELECT run_id, count(*) AS blocks, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE error IS NOT NULL) AS errors FROM ({DECISIONS}) GROUP BY run_id)
  SELECT r.run_id, status, coalesce(p.pages, 0) AS pages, coalesce(entries, 0) AS entries, coalesce(blocks, 0) AS blocks, coalesce(accepted, 0) AS accepted, coalesce(errors, 0) AS errors FROM ({RUNS}) r LEFT JOIN p USING (run_id) LEFT JOIN e USING (run_id) LEFT JOIN c USING (run_id)""")
def folder_audit(s: SparkSession, d: str) -> DataFrame:
    """One row for each run, from every table."""
    p = table(s, d, "layout_pages").groupBy("run_id").agg(F.countDistinct("page_id").alias("p"))
    e = table(s, d, "entries").groupBy("run_id").agg(F.countDistinct("entry_id").alias("entries"))
    c = table(s, d, "decisions").select("decision_id", "run_id", "accepted", "error").dropDuplicates(["decision_id"]).groupBy("run_id").agg(F.count("*").alias("blocks"), F.count_if("accepted").alias("accepted"), F.count("error").alias("errors"))
    j = runs(s, d).select("run_id", "status").join(p, "run_id", "left").join(e, "run_id", "left").join(c, "run_id", "left")
    return j.select("run_id", "status", *[F.coalesce(x, F.lit(0)).alias(y) for x, y in (("p", "pages"), ("entries", "entries"), ("blocks", "blocks"), ("accepted", "accepted"), ("errors", "errors"))])


@query(f"SELECT status, round(median(elapsed_seconds), 6) AS median_seconds, round(median(elapsed_seconds) FILTER (WHERE NOT first), 6) AS without_first FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY started_at, run_id) = 1 AS first FROM ({RUNS})) GROUP BY status")
def median_timings(s: SparkSession, d: str) -> DataFrame:
    """Exact median seconds, with and without a book's first run."""
    first = F.row_number().over(Window.partitionBy("doc_key").orderBy(F.asc_nulls_last("started_at"), "run_id")) == 1
    r = runs(s, d).withColumn("first", first)
    every = exact_median(r, "status", "elapsed_seconds", "median_seconds")
    rest = exact_median(r.where("NOT first"), "status", "elapsed_seconds", "without_first")
    return by_key("status", r.select("status").distinct(), every, rest).select("status", F.round("median_seconds", 6).alias("median_seconds"), F.round("without_first", 6).alias("without_first"))


@query(f"SELECT run_id, sum(abs(length(original) - length(coalesce(other, ''))))::BIGINT AS length_difference, count(*) FILTER (WHERE original IS DISTINCT FROM other) AS changes FROM ({DECISIONS}) WHERE original IS NOT NULL GROUP BY run_id")
def text_changes(s: SparkSession, d: str) -> DataFrame:
    """Changed texts and how far their lengths differ."""
    t = decisions(s, d, "original IS NOT NULL")
    return t.groupBy("run_id").agg(F.sum(F.abs(F.length("original") - F.length(F.coalesce("other", F.lit(""))))).alias("length_difference"), F.count_if(~F.col("original").eqNullSafe(F.col("other"))).alias("changes"))


@query("SELECT round(width * 25.4 / 72, 2) AS mm_wide, round(height * 25.4 / 72, 2) AS mm_high, count(*) AS pages FROM (SELECT DISTINCT ON (page_id) width, height FROM layout_pages) GROUP BY ALL")
def page_size_histogram(s: SparkSession, d: str) -> DataFrame:
    """Pages by size in millimetres."""
    mm = lambda c: F.round(F.col(c) * 25.4 / 72, 2)
    return table(s, d, "layout_pages").select("page_id", "width", "height").dropDuplicates(["page_id"]).groupBy(mm("width").alias("mm_wide"), mm("height").alias("mm_high")).agg(F.count("*").alias("pages"))


@query("SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS text, min(value) AS least FROM events GROUP BY user_id")
def segment_join(s: SparkSession, d: str) -> DataFrame:
    """Segments of a line in order, joined, with the least of their scores."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(s, d, "events").groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda e: e["event_type"]), " ").alias("text"), F.min("value").alias("least"))


@query("SELECT page_id, ord, round(median((x1 + next) / 2), 3) AS boundary FROM (SELECT page_id, 1 AS ord, box.x1 AS x1, lead(box.x0) OVER (PARTITION BY page_id ORDER BY o) AS next FROM (SELECT page_id, generate_subscripts(parsing_res_list, 1) AS o, unnest(parsing_res_list).block_bbox AS bb FROM (SELECT DISTINCT ON (page_id) * FROM layout_pages)) t, LATERAL (SELECT {'x0': list_min(list_filter(bb, lambda v, i: i % 2 = 1)), 'x1': list_max(list_filter(bb, lambda v, i: i % 2 = 1))} AS box) WHERE len(bb) >= 4) WHERE next IS NOT NULL GROUP BY ALL")
def column_boundaries(s: SparkSession, d: str) -> DataFrame:
    """Median place between a box's right edge and the next one's left."""
    from quireflow.operators.extract import norm_box

    b = flat(s, d, "size(bbox) >= 4", "bbox").withColumn("box", norm_box(F.col("bbox"))).where("box IS NOT NULL")
    n = F.lead("box.x0").over(Window.partitionBy("page_id").orderBy("ord"))
    return b.withColumn("next", n).where("next IS NOT NULL").groupBy("page_id", F.lit(1).alias("ord")).agg(F.round(F.median((F.col("box.x1") + F.col("next")) / 2), 3).alias("boundary"))
