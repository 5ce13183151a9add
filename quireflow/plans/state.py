"""Queries: keyed tables, resumption, predicates of modes, publication checks, scheduling arithmetic."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.operators import state as K
from quireflow.operators.extract import norm_box
from quireflow.operators.lineage import shared_folder
from quireflow.plans.extract import BLOCKS, BOX, SCALE, flat
from quireflow.sources import layouts as L
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


def runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "run_reports").dropDuplicates(["run_id"])


RUNS = "SELECT DISTINCT ON (run_id) * FROM run_reports"


@query("""SELECT DISTINCT doc_key || '/' || folder || source || suffix AS path FROM documents, (VALUES ('', '.pdf'), ('ocr_output/', '.pdf'), ('.ocr_cache/a/', '.pdf'), ('', '_searchable.pdf'), ('', '_report.json')) t(folder, suffix)
  WHERE doc_key IS NOT NULL AND source IS NOT NULL AND folder = '' AND suffix = '.pdf' ORDER BY path""")
def discover_inputs(s: SparkSession, d: str) -> DataFrame:
    """Inputs in order, of a listing that holds generated folders and files too (here made of documents and sources)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(a).alias("folder"), F.lit(b).alias("suffix")) for a, b in (("", ".pdf"), ("ocr_output/", ".pdf"), (".ocr_cache/a/", ".pdf"), ("", "_searchable.pdf"), ("", "_report.json"))])).alias("k")
    t = table(s, d, "documents").where("doc_key IS NOT NULL AND source IS NOT NULL").select("doc_key", "source").distinct().select("doc_key", "source", kinds)
    listing = t.select(F.concat("doc_key", F.lit("/"), "k.folder", "source", "k.suffix").alias("path"))
    return listing.where(L.is_input(F.col("path"), "pdf")).orderBy("path")


@query()
def discovered_files(s: SparkSession, d: str) -> DataFrame:
    """The files of the dataset folder itself by the reader, with their lengths."""
    return L.discover(s, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS bytes, true AS verified FROM documents WHERE text IS NOT NULL")
def artifact_checksum(s: SparkSession, d: str) -> DataFrame:
    """Contents read with their checksum verified."""
    t = table(s, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"), F.sha2("text", 256).alias("sha256"))
    return K.checked(t).select(F.col("name").cast("long").alias("doc_id"), "sha256", F.octet_length("content").alias("bytes"), F.lit(True).alias("verified"))


@query("SELECT doc_key AS name, max_by(run_id, (loaded_at, run_id)) AS run_id FROM run_reports GROUP BY doc_key")
def artifact_upsert(s: SparkSession, d: str) -> DataFrame:
    """The latest row of each key; the table is written over in two parts."""
    t = table(s, d, "run_reports").select(F.col("doc_key").alias("name"), "run_id", F.struct("loaded_at", "run_id").alias("stamp"))
    return K.upsert(t.where("run_id % 2 = 0"), t.where("run_id % 2 = 1"), "name", "stamp").select("name", "run_id")


@query("SELECT DISTINCT source || '/' || doc_key AS name FROM documents WHERE source IS NOT NULL AND doc_key IS NOT NULL AND NOT regexp_matches(source || '/' || doc_key, '\\.\\.') AND doc_key NOT IN (SELECT doc_key FROM run_reports)")
def artifact_absent(s: SparkSession, d: str) -> DataFrame:
    """Safe keys that are not stored."""
    t = table(s, d, "documents").where("source IS NOT NULL AND doc_key IS NOT NULL").select("doc_key", F.concat("source", F.lit("/"), "doc_key").alias("name")).distinct()
    return t.where(~F.col("name").rlike(K.UNSAFE_KEY)).join(table(s, d, "run_reports").select("doc_key"), "doc_key", "left_anti").select("name").distinct()


@query("SELECT CAST(page_id AS VARCHAR) AS name, any_value(source_sha256) AS value FROM layout_pages GROUP BY page_id")
def sidecar_import(s: SparkSession, d: str) -> DataFrame:
    """Rows delivered again are ignored; a different value under a key would fail."""
    t = table(s, d, "layout_pages").select(F.col("page_id").cast("string").alias("name"), F.col("source_sha256").alias("value"))
    return K.insert_or_ignore(t.where("CAST(name AS BIGINT) % 3 > 0"), t, "name", "value")


@query("SELECT CAST(p.page_id AS VARCHAR) AS name FROM (SELECT DISTINCT page_id FROM layout_pages) p WHERE p.page_id NOT IN (SELECT page_id FROM decisions WHERE page_id IS NOT NULL)")
def artifact_export_plan(s: SparkSession, d: str) -> DataFrame:
    """What an export has to write; what is there already stays."""
    return table(s, d, "layout_pages").select("page_id").distinct().join(table(s, d, "decisions").select("page_id"), "page_id", "left_anti").select(F.col("page_id").cast("string").alias("name"))


@query("""WITH r AS (SELECT DISTINCT CASE doc_id % 3 WHEN 0 THEN doc_key || '::' || source WHEN 1 THEN doc_key || '/' || source || '/a.json' ELSE 'loose/' || source END AS ref FROM documents WHERE doc_key IS NOT NULL AND source IS NOT NULL), p AS (SELECT ref, CASE WHEN contains(ref, '::') THEN split_part(ref, '::', 1) ELSE split_part(ref, '/', 1) END AS db, CASE WHEN contains(ref, '::') THEN split_part(ref, '::', 2) ELSE substr(ref, instr(ref, '/') + 1) END AS key FROM r)
  SELECT ref, CASE WHEN s.name IS NOT NULL THEN db END AS db, CASE WHEN s.name IS NOT NULL THEN key ELSE ref END AS key, CASE WHEN contains(ref, '::') THEN CASE WHEN s.name IS NULL THEN 'missing' ELSE 'store' END WHEN s.name IS NOT NULL THEN 'parent' ELSE 'path' END AS way FROM p LEFT JOIN (SELECT DISTINCT doc_key AS name FROM run_reports WHERE doc_key IS NOT NULL) s ON s.name = p.db""")
def reference_resolution(s: SparkSession, d: str) -> DataFrame:
    """References as store and key: named outright, found in the store of a folder above the path, or a path of its own."""
    t = table(s, d, "documents").where("doc_key IS NOT NULL AND source IS NOT NULL")
    kind = F.col("doc_id") % 3
    ref = F.when(kind == 0, F.concat("doc_key", F.lit("::"), "source")).when(kind == 1, F.concat("doc_key", F.lit("/"), "source", F.lit("/a.json"))).otherwise(F.concat(F.lit("loose/"), "source"))
    return K.resolve(t.select(ref.alias("ref")).distinct(), table(s, d, "run_reports").where("doc_key IS NOT NULL").select(F.col("doc_key").alias("name")).distinct())


@query(f"SELECT run_id, '# ' || doc_key || chr(10) || 'status: ' || status || chr(10) || coalesce(nullif(array_to_string(list_transform(list_sort(warnings), lambda w: '- ' || w), chr(10)), ''), '- none') AS summary FROM ({RUNS}) WHERE doc_key IS NOT NULL AND status IS NOT NULL")
def markdown_summary(s: SparkSession, d: str) -> DataFrame:
    """Report of a run as Markdown."""
    w = F.array_join(F.transform(F.array_sort("warnings"), lambda x: F.concat(F.lit("- "), x)), "\n")
    return runs(s, d).where("doc_key IS NOT NULL AND status IS NOT NULL").select("run_id", F.concat(F.lit("# "), "doc_key", F.lit("\nstatus: "), "status", F.lit("\n"), F.when(w == "", "- none").otherwise(F.coalesce(w, F.lit("- none")))).alias("summary"))


@query(f"SELECT doc_key, sfx AS suffix, '.ocr/' || doc_key || sfx AS path FROM (SELECT DISTINCT doc_key FROM run_reports WHERE doc_key IS NOT NULL), (VALUES ('_report.json'), ('_layout.json'), ('.md')) t(sfx)")
def artifact_names(s: SparkSession, d: str) -> DataFrame:
    """Names of a document's artifacts."""
    sfx = F.explode(F.array(*map(F.lit, ("_report.json", "_layout.json", ".md")))).alias("suffix")
    return table(s, d, "run_reports").where("doc_key IS NOT NULL").select("doc_key").distinct().select("doc_key", sfx).withColumn("path", F.concat(F.lit(".ocr/"), "doc_key", "suffix"))


FILES = ("_report.json", "_layout.json", ".md", "_line_ocr_review.json", "_old_layout_v1.json", "_notes.txt", "_layout_draft.txt", "_boundary_cache.json.pages/7.json", "_boundary_cache.json.pages/7.tmp", "_other.json")
#: Files of one book's folder, and of the caches kept apart by source.
LISTING = f"""SELECT doc_key, doc_key || sfx AS name FROM (SELECT DISTINCT doc_key FROM run_reports WHERE doc_key IS NOT NULL), (VALUES {", ".join(f"('{x}')" for x in FILES)}) t(sfx)
  UNION ALL SELECT doc_key, '.ocr_cache/' || left(sha256(source_sha256), 20) || '/' || f AS name FROM (SELECT DISTINCT doc_key, source_sha256 FROM layout_pages WHERE doc_key IS NOT NULL), (VALUES ('pruned.json'), ('meta.json'), ('page.png')) t(f)"""


@query(f"""WITH l AS ({LISTING}), r AS (SELECT DISTINCT doc_key, left(sha256(source_sha256), 20) AS fp FROM run_reports WHERE status LIKE 'completed%' AND doc_key IS NOT NULL)
  SELECT l.doc_key, l.name FROM l WHERE name IN (doc_key || '_report.json', doc_key || '_layout.json', doc_key || '.md', doc_key || '_layout_review.json', doc_key || '_line_ocr_review.json') OR (starts_with(name, doc_key || '_') AND contains(name, '_layout_') AND regexp_matches(name, '[.](json|md)$')) OR (starts_with(name, doc_key || '_boundary_cache.json.pages/') AND name LIKE '%.json')
    OR EXISTS (SELECT 1 FROM r WHERE r.doc_key = l.doc_key AND name IN ('.ocr_cache/' || fp || '/pruned.json', '.ocr_cache/' || fp || '/text.md', '.ocr_cache/' || fp || '/meta.json', '.ocr_cache/' || fp || '/partial.json'))""")
def compaction_choice(s: SparkSession, d: str) -> DataFrame:
    """Files of a book's folder to pack: its artifacts by name, layouts, boundary shards, and caches its finished reports name."""
    books = table(s, d, "run_reports").where("doc_key IS NOT NULL").select("doc_key").distinct()
    own = books.select("doc_key", F.explode(F.array(*map(F.lit, FILES))).alias("sfx")).select("doc_key", F.concat("doc_key", "sfx").alias("name"))
    fp = F.left(F.sha2("source_sha256", 256), F.lit(20))
    apart = table(s, d, "layout_pages").where("doc_key IS NOT NULL").select("doc_key", fp.alias("fp")).distinct().select("doc_key", "fp", F.explode(F.array(*map(F.lit, ("pruned.json", "meta.json", "page.png")))).alias("f")).select("doc_key", F.concat(F.lit(".ocr_cache/"), "fp", F.lit("/"), "f").alias("name"))
    reports = table(s, d, "run_reports").where("status LIKE 'completed%' AND doc_key IS NOT NULL").select("doc_key", fp.alias("fingerprint")).distinct()
    return K.compaction(own.unionByName(apart), reports, "doc_key")


@query("SELECT doc_key, count(DISTINCT source_sha256) AS versions, count(DISTINCT source_sha256) > 1 AS conflict FROM run_reports GROUP BY doc_key")
def organize_conflicts(s: SparkSession, d: str) -> DataFrame:
    """Names under which old and new would both exist."""
    g = table(s, d, "run_reports").groupBy("doc_key").agg(F.countDistinct("source_sha256").alias("versions"))
    return g.withColumn("conflict", F.col("versions") > 1)


@query("SELECT DISTINCT decision_id FROM decisions WHERE accepted IS NULL AND original IS NOT NULL AND len(rects) > 0")
def repair_eligible(s: SparkSession, d: str) -> DataFrame:
    """Decisions not judged yet that have text and boxes."""
    return table(s, d, "decisions").where("accepted IS NULL AND original IS NOT NULL AND size(rects) > 0").select("decision_id").distinct()


@query(f"SELECT page_id, block_id, round(greatest(box.x0, 0), 3) AS x0, round(least(box.x1, w), 3) AS x1 FROM (SELECT page_id, block_id, {BOX} AS box FROM ({BLOCKS})) JOIN ({SCALE}) USING (page_id) WHERE box IS NOT NULL AND least(box.x1, w) - greatest(box.x0, 0) >= 4 AND least(box.y1, h) - greatest(box.y0, 0) >= 4")
def repair_rects(s: SparkSession, d: str) -> DataFrame:
    """Boxes cut to the page, none with a side under four."""
    from quireflow.operators.extract import page_scale
    from quireflow.plans.extract import found, sizes

    b = flat(s, d, "bbox IS NOT NULL", "block_id bbox").withColumn("box", norm_box(F.col("bbox"))).where("box IS NOT NULL").join(page_scale(sizes(s, d), found(s, d)), "page_id")
    b = b.select("page_id", "block_id", F.greatest("box.x0", F.lit(0.0)).alias("x0"), F.greatest("box.y0", F.lit(0.0)).alias("y0"), F.least("box.x1", "w").alias("x1"), F.least("box.y1", "h").alias("y1"))
    return b.where("x1 - x0 >= 4 AND y1 - y0 >= 4").select("page_id", "block_id", F.round("x0", 3).alias("x0"), F.round("x1", 3).alias("x1"))


@query("""SELECT DISTINCT ON (decision_id) decision_id, len(rects) > 1 AND NOT regexp_matches(original, '<[a-zA-Z/]') AND NOT contains(original, '\\') AND NOT contains(original, '$$') AS needs_line_ocr, regexp_matches(original, '<[a-zA-Z/]') OR contains(original, '\\') AS complex FROM decisions WHERE original IS NOT NULL AND rects IS NOT NULL""")
def needs_line_ocr(s: SparkSession, d: str) -> DataFrame:
    """Whether a block needs its lines read, and whether it is too complex."""
    o = F.col("original")
    tag, slash, math = o.rlike("<[a-zA-Z/]"), F.contains(o, F.lit("\\")), F.contains(o, F.lit("$$"))
    t = table(s, d, "decisions").where("original IS NOT NULL AND rects IS NOT NULL").select("decision_id", ((F.size("rects") > 1) & ~tag & ~slash & ~math).alias("needs_line_ocr"), (tag | slash).alias("complex"))
    return t.dropDuplicates(["decision_id"])


@query("SELECT DISTINCT page_id FROM layout_pages l WHERE NOT EXISTS (SELECT 1 FROM run_reports r WHERE r.run_id = l.run_id AND r.source_sha256 = l.source_sha256 AND r.status LIKE 'completed%')")
def unfinished_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages of no finished run of the same source."""
    done = table(s, d, "run_reports").where("status LIKE 'completed%'").select("run_id", "source_sha256")
    return table(s, d, "layout_pages").select("page_id", "run_id", "source_sha256").join(done, ["run_id", "source_sha256"], "left_anti").select("page_id").distinct()


@query(f"SELECT run_id, CASE WHEN options['fast'] THEN 'fast' WHEN options['paragraph'] THEN 'paragraph' WHEN options['toc'] THEN 'auto' ELSE 'structure' END AS mode FROM ({RUNS})")
def run_modes(s: SparkSession, d: str) -> DataFrame:
    """Mode of a run by its options, the first that is set."""
    o = lambda k: F.col("options")[k]
    return runs(s, d).select("run_id", F.when(o("fast"), "fast").when(o("paragraph"), "paragraph").when(o("toc"), "auto").otherwise("structure").alias("mode"))


@query(f"SELECT run_id, sha256('fast=' || coalesce(options['fast'], false) || ';paragraph=' || coalesce(options['paragraph'], false) || ';toc=' || coalesce(options['toc'], false)) AS identity FROM ({RUNS})")
def option_identity(s: SparkSession, d: str) -> DataFrame:
    """Identity of the options that shape a result, in a fixed order."""
    one = [F.concat(F.lit(f"{k}="), F.coalesce(F.col("options")[k], F.lit(False)).cast("string")) for k in ("fast", "paragraph", "toc")]
    return runs(s, d).select("run_id", F.sha2(F.concat_ws(";", *one), 256).alias("identity"))


@query("SELECT DISTINCT path, regexp_matches(path, '(^|/)(\\.env[^/]*|private|\\.cache)(/|$)|\\.(pem|key|sqlite)$') AS private FROM (SELECT source || CASE doc_id % 4 WHEN 0 THEN '/.env.local' WHEN 1 THEN '/private/a.txt' WHEN 2 THEN '/b.pem' ELSE '/notes.md' END AS path FROM documents WHERE source IS NOT NULL)")
def private_paths(s: SparkSession, d: str) -> DataFrame:
    """Paths that must not be published."""
    end = F.element_at(F.array(*map(F.lit, ("/.env.local", "/private/a.txt", "/b.pem", "/notes.md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    t = table(s, d, "documents").where("source IS NOT NULL").select(F.concat("source", end).alias("path")).distinct()
    return t.withColumn("private", F.col("path").rlike("(^|/)(\\.env[^/]*|private|\\.cache)(/|$)|\\.(pem|key|sqlite)$"))


SECRET = "(?i)(api[_-]?key|secret|password|token)[ ]*[:=][ ]*[^ ]{8,}|[0-9a-f]{40}"


PRIVATE = "(^|/)(\\.env[^/]*|private|\\.cache)(/|$)|\\.(pem|key|sqlite)$"


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(coalesce(source, '') || CASE WHEN doc_id % 50 = 0 THEN '/.env' ELSE '/page.md' END, '{PRIVATE}') THEN 'private path' END, CASE WHEN octet_length(encode(text)) > 5242880 THEN 'over 5 MiB' END, CASE WHEN regexp_matches(text, '{SECRET}') THEN 'credential' END], lambda x: x IS NOT NULL), ', ') AS issues
  FROM documents WHERE regexp_matches(coalesce(source, '') || CASE WHEN doc_id % 50 = 0 THEN '/.env' ELSE '/page.md' END, '{PRIVATE}') OR octet_length(encode(text)) > 5242880 OR regexp_matches(text, '{SECRET}')""")
def blob_issues(s: SparkSession, d: str) -> DataFrame:
    """P10: what forbids publishing a text: its path, its size over 5 MiB, the form of a credential, whose value is never shown."""
    path = F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 50 == 0, "/.env").otherwise("/page.md"))
    issues = F.filter(F.array(F.when(path.rlike(PRIVATE), "private path"), F.when(F.octet_length("text") > 5 * 1024 * 1024, "over 5 MiB"), F.when(F.col("text").rlike(SECRET), "credential")), lambda x: x.isNotNull())
    return table(s, d, "documents").select("doc_id", F.array_join(issues, ", ").alias("issues")).where("issues <> ''")


LINK = "\\]\\(([^()\\s]+)\\)"


@query(f"WITH l AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '{LINK}', 1)) AS link FROM documents WHERE contains(text, '](')) SELECT doc_id, count(*) AS links, count(*) FILTER (WHERE NOT regexp_matches(link, '^https?://') AND link NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)) AS broken FROM l GROUP BY doc_id")
def broken_links(s: SparkSession, d: str) -> DataFrame:
    """Relative links that lead nowhere, fenced code left out."""
    t = table(s, d, "documents").where(F.contains("text", F.lit("](")))
    link = F.explode(F.regexp_extract_all(F.regexp_replace("text", "(?s)```.*?```", ""), F.lit(LINK), F.lit(1))).alias("link")
    known = table(s, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("link"), F.lit(True).alias("known")).distinct()
    j = t.select("doc_id", link).join(known, "link", "left")
    return j.groupBy("doc_id").agg(F.count("*").alias("links"), F.count_if(~F.col("link").rlike("^https?://") & F.col("known").isNull()).alias("broken"))


@query("SELECT DISTINCT ON (decision_id) decision_id, len(list_filter(rects, lambda r: NOT coalesce(len(r) = 4 AND r[1] < r[3] AND r[2] < r[4] AND isfinite(r[1]) AND isfinite(r[2]) AND isfinite(r[3]) AND isfinite(r[4]), false))) = 0 AS valid FROM decisions WHERE rects IS NOT NULL")
def valid_detections(s: SparkSession, d: str) -> DataFrame:
    """Lists of boxes that can be kept; an empty list can."""
    ok = lambda r: F.coalesce((F.size(r) == 4) & (r[0] < r[2]) & (r[1] < r[3]) & F.forall(r, lambda v: F.abs(v) < float("inf")), F.lit(False))
    return table(s, d, "decisions").where("rects IS NOT NULL").select("decision_id", F.forall("rects", ok).alias("valid")).dropDuplicates(["decision_id"])


@query("SELECT DISTINCT ON (decision_id) decision_id, sha256(concat_ws('|', block_key, engine, array_to_string(image_keys, ','))) AS key FROM decisions")
def content_keys(s: SparkSession, d: str) -> DataFrame:
    """Key of a decision's inputs."""
    return table(s, d, "decisions").select("decision_id", F.sha2(F.concat_ws("|", "block_key", "engine", F.array_join("image_keys", ",")), 256).alias("key")).dropDuplicates(["decision_id"])


@query("SELECT doc_key, count(*) FILTER (WHERE held) AS hits, count(*) FILTER (WHERE NOT held) AS misses FROM (SELECT DISTINCT r.request_id, r.doc_key, r.block_id, EXISTS (SELECT 1 FROM decisions x WHERE x.page_id = r.page_id AND x.block_id = r.block_id AND x.error IS NULL) AS held FROM recognition_requests r) GROUP BY doc_key")
def cache_hits(s: SparkSession, d: str) -> DataFrame:
    """Requests a cache answers; failures are not kept."""
    r = table(s, d, "recognition_requests").select("request_id", "doc_key", "page_id", "block_id").distinct()
    c = table(s, d, "decisions").where("error IS NULL").select("page_id", "block_id").distinct().withColumn("held", F.lit(True))
    return r.join(c, ["page_id", "block_id"], "left").groupBy("doc_key").agg(F.count("held").alias("hits"), F.count_if(F.col("held").isNull()).alias("misses"))


@query("""WITH done AS (SELECT DISTINCT run_id FROM run_reports WHERE status LIKE 'completed%'), cur AS (SELECT DISTINCT decision_id, run_id FROM decisions WHERE accepted AND run_id IS NOT NULL), pend AS (SELECT DISTINCT decision_id, run_id FROM decisions WHERE accepted IS DISTINCT FROM true AND run_id IS NOT NULL), taken AS (SELECT * FROM pend WHERE run_id IN (FROM done))
  SELECT decision_id, 'current' AS origin FROM cur WHERE run_id NOT IN (SELECT run_id FROM taken) UNION ALL SELECT decision_id, 'pending' FROM taken""")
def staged_decisions(s: SparkSession, d: str) -> DataFrame:
    """Pending decisions replace those of their run once it is published; the pending ones of other runs wait (here:
    accepted decisions are current, the others pending)."""
    t = table(s, d, "decisions").where("run_id IS NOT NULL").select("decision_id", "run_id", F.coalesce("accepted", F.lit(False)).alias("now")).distinct()
    rows = lambda now, name: t.where(F.col("now") == now).select("decision_id", "run_id", F.lit(name).alias("origin"))
    done = table(s, d, "run_reports").where("status LIKE 'completed%'").select("run_id")
    return K.staged(rows(True, "current"), rows(False, "pending"), done, "decision_id", "run_id").select("decision_id", "origin")


@query("""WITH shard AS (SELECT DISTINCT l.run_id, l.page FROM layout_pages l JOIN run_reports r ON l.run_id = r.run_id AND l.source_sha256 = r.source_sha256), want AS (SELECT run_id, max(pages) AS pages FROM run_reports GROUP BY run_id)
  SELECT run_id, pages, count(page) AS shards, count(page) >= pages AS whole, CASE WHEN count(page) >= pages THEN coalesce(sum(page), 0)::BIGINT END AS aggregate FROM want LEFT JOIN shard USING (run_id) GROUP BY run_id, pages""")
def boundary_shards(s: SparkSession, d: str) -> DataFrame:
    """Shards of a run's checkpoint, one a page, that belong to its source; their aggregate is made once all are there."""
    r = table(s, d, "run_reports").select("run_id", "source_sha256", "pages")
    shard = table(s, d, "layout_pages").select("run_id", "page", "source_sha256").join(r.select("run_id", "source_sha256"), ["run_id", "source_sha256"], "left_semi").select("run_id", "page").distinct()
    g = r.groupBy("run_id").agg(F.max("pages").alias("pages")).join(shard.groupBy("run_id").agg(F.count("page").alias("n"), F.sum("page").alias("sum")), "run_id", "left")
    n = F.coalesce("n", F.lit(0))
    return g.select("run_id", "pages", n.alias("shards"), (n >= F.col("pages")).alias("whole"), F.when(n >= F.col("pages"), F.coalesce("sum", F.lit(0))).alias("aggregate"))


@query("SELECT run_id, max_by(status, (loaded_at, status)) AS status, count(DISTINCT loaded_at) AS deliveries FROM run_reports WHERE run_id IS NOT NULL GROUP BY run_id")
def published_version(s: SparkSession, d: str) -> DataFrame:
    """A table published twice and once in vain: the last version whose check passed is read, the failed candidate is not."""
    r = table(s, d, "run_reports").where("run_id IS NOT NULL")
    good = r.groupBy("run_id").agg(F.max_by("status", F.struct("loaded_at", "status")).alias("status"), F.countDistinct("loaded_at").alias("deliveries"))
    path = f"{shared_folder(s)}/published-{uuid.uuid4().hex}"
    K.publish(good.where("run_id % 2 = 0"), path, "v1")
    K.publish(good, path, "v2", lambda t: K.same_content(t, good, "run_id", "status"))
    try:
        K.publish(good.limit(0), path, "v3", lambda t: K.same_content(t, good, "run_id", "status") and not good.isEmpty())
    except ValueError:
        pass
    return K.read_current(s, path)


@query("WITH l AS (SELECT doc_key, max(run_id) AS layout_run FROM layout_pages GROUP BY doc_key), e AS (SELECT doc_key, max(run_id) AS entry_run FROM entries GROUP BY doc_key), r AS (SELECT doc_key, max(run_id) FILTER (WHERE status = 'completed') AS run FROM run_reports GROUP BY doc_key) SELECT doc_key, coalesce(run, layout_run, entry_run) AS used FROM r FULL JOIN l USING (doc_key) FULL JOIN e USING (doc_key)")
def layout_used(s: SparkSession, d: str) -> DataFrame:
    """The layout a book's output was made from: recorded, else its own, else the default."""
    l = table(s, d, "layout_pages").groupBy("doc_key").agg(F.max("run_id").alias("layout_run"))  # noqa: E741
    e = table(s, d, "entries").groupBy("doc_key").agg(F.max("run_id").alias("entry_run"))
    r = table(s, d, "run_reports").groupBy("doc_key").agg(F.max(F.when(F.col("status") == "completed", F.col("run_id"))).alias("run"))
    return r.join(l, "doc_key", "full").join(e, "doc_key", "full").select("doc_key", F.coalesce("run", "layout_run", "entry_run").alias("used"))


@query("""WITH RECURSIVE r AS (SELECT request_id, run_id, lower(trim(coalesce(lang, ''))) AS lang, coalesce(len(images), 0) AS n FROM (SELECT DISTINCT ON (request_id) * FROM recognition_requests)), o AS (SELECT *, row_number() OVER (PARTITION BY run_id, lang ORDER BY request_id) AS i FROM r),
  w AS (SELECT run_id, lang, i, n, 0 AS batch, n AS fill FROM o WHERE i = 1 UNION ALL SELECT o.run_id, o.lang, o.i, o.n, CASE WHEN w.fill + o.n > 64 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.fill + o.n > 64 THEN o.n ELSE w.fill + o.n END FROM w JOIN o ON o.run_id IS NOT DISTINCT FROM w.run_id AND o.lang = w.lang AND o.i = w.i + 1)
  SELECT run_id, lang, batch::BIGINT AS batch, batch::BIGINT // 2 AS wave, count(*) AS requests, sum(n)::BIGINT AS images FROM w GROUP BY ALL""")
def language_batches(s: SparkSession, d: str) -> DataFrame:
    """Requests of a language within a run in batches of at most 64 images (one request alone may have more), two
    batches in flight at a time. A run is one scanned book; its requests of a language are walked in order."""
    r = table(s, d, "recognition_requests").select("request_id", "run_id", F.lower(F.trim(F.coalesce("lang", F.lit("")))).alias("lang"), F.greatest(F.size(F.coalesce("images", F.array().cast("array<string>"))), F.lit(0)).alias("n")).dropDuplicates(["request_id"])
    g = r.groupBy("run_id", "lang").agg(F.array_sort(F.collect_list(F.struct("request_id", "n"))).alias("q"))
    kind = "struct<batch:bigint,fill:int,out:array<struct<batch:bigint,n:int>>>"

    def step(acc, x):
        full = (acc["fill"] + x["n"] > 64) & (F.size(acc["out"]) > 0)
        batch = acc["batch"] + full.cast("long")
        return F.struct(batch.alias("batch"), F.when(full, x["n"]).otherwise(acc["fill"] + x["n"]).alias("fill"), F.concat(acc["out"], F.array(F.struct(batch.alias("batch"), x["n"].alias("n")))).alias("out")).cast(kind)

    start = F.struct(F.lit(0).cast("long").alias("batch"), F.lit(0).alias("fill"), F.array().cast("array<struct<batch:bigint,n:int>>").alias("out")).cast(kind)
    walked = g.select("run_id", "lang", F.explode(F.aggregate("q", start, step, lambda acc: acc["out"])).alias("o"))
    return walked.groupBy("run_id", "lang", F.col("o.batch").alias("batch")).agg(F.count("*").alias("requests"), F.sum("o.n").alias("images")).withColumn("wave", F.expr("batch div 2"))


@query(f"SELECT run_id, greatest(1, least(8, pages, 16384 // (128 + 64 * (pages // 10)))) AS workers FROM ({RUNS}) WHERE pages IS NOT NULL")
def worker_admission(s: SparkSession, d: str) -> DataFrame:
    """Q08: workers that pages and memory allow."""
    return runs(s, d).where("pages IS NOT NULL").select("run_id", F.expr("greatest(1, least(8, pages, 16384 div (128 + 64 * (pages div 10))))").cast("int").alias("workers"))


@query("SELECT http_status, count(*) AS requests, http_status IN (429, 500, 502, 503, 504) AS retry_document, http_status IN (429, 503) AS retry_line FROM (SELECT DISTINCT request_id, http_status FROM recognition_requests) GROUP BY http_status")
def retry_rules(s: SparkSession, d: str) -> DataFrame:
    """Answers that are asked for again."""
    r = table(s, d, "recognition_requests").select("request_id", "http_status").distinct().groupBy("http_status").agg(F.count("*").alias("requests"))
    return r.withColumn("retry_document", F.col("http_status").isin(429, 500, 502, 503, 504)).withColumn("retry_line", F.col("http_status").isin(429, 503))


@query("SELECT doc_key, NOT bool_or(status NOT LIKE 'completed%') AS ok, count(*) FILTER (WHERE status NOT LIKE 'completed%') AS errors FROM (SELECT DISTINCT run_id, doc_key, status FROM run_reports) GROUP BY doc_key")
def doctor_report(s: SparkSession, d: str) -> DataFrame:
    """Q11: a book is in order if none of its checks failed."""
    bad = ~F.col("status").like("completed%")
    return table(s, d, "run_reports").select("run_id", "doc_key", "status").distinct().groupBy("doc_key").agg((~F.bool_or(bad)).alias("ok"), F.count_if(bad).alias("errors"))


@query("WITH t AS (SELECT doc_id, source, ntile(10) OVER (PARTITION BY source ORDER BY doc_id) AS stratum, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents WHERE source IS NOT NULL) SELECT doc_id, source, stratum::INT AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY h) AS n FROM t) WHERE n = 1")
def stratified_sample(s: SparkSession, d: str) -> DataFrame:
    """Sampling operator: one document of each tenth of each source, by a seeded order.

    A document's place in its source is the count of those in earlier buckets of ids and its place in its bucket, so a
    source of any size is spread over as many tasks as it has buckets.
    """
    t = table(s, d, "documents").where("source IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source")
    t = t.withColumn("bucket", F.floor(F.col("doc_id") / 20_000))
    counts = t.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source")
    counts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(w).alias("all"))
    i = F.col("before") + F.row_number().over(Window.partitionBy("source", "bucket").orderBy("doc_id")) - 1
    t = t.join(counts, ["source", "bucket"]).withColumn("i", i).withColumn("size", F.expr("all div 10")).withColumn("more", F.col("all") % 10)
    # The first `more` tenths have one document more than the others.
    long = F.col("more") * (F.col("size") + 1)
    tenth = F.when(F.col("i") < long, F.expr("i div (size + 1)") + 1).otherwise(F.col("more") + F.expr("(i - more * (size + 1)) div greatest(size, 1)") + 1)
    picked = F.min_by("doc_id", F.struct(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return t.withColumn("stratum", tenth.cast("int")).groupBy("source", "stratum").agg(picked.alias("doc_id")).select("doc_id", "source", "stratum")
