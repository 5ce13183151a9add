"""Queries of reviews and orders over tables that differ from the test tables where it matters."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quireflow.functions.text import text_units
from quireflow.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
QUERIES = registry.queries()


def changed(spark, folder, **columns):
    """The test tables' decisions with some columns changed, beside the same pages."""
    spark.read.parquet(f"{DATA}/decisions.parquet").withColumns(columns).write.parquet(f"{folder}/decisions.parquet")
    spark.read.parquet(f"{DATA}/layout_pages.parquet").write.parquet(f"{folder}/layout_pages.parquet")
    return str(folder)


def test_expected_text_is_whole(spark, tmp_path):
    end = F.when(F.length("original") > 12, F.concat("original", F.lit("x"))).otherwise(F.col("original"))
    d = changed(spark, tmp_path, original=end)
    longer = {(r.page_id, r.block_id) for r in spark.read.parquet(f"{DATA}/decisions.parquet").where("length(original) > 12").select("page_id", "block_id").collect()}
    got = {(r.page_id, r.block_id): r.passed for r in QUERIES["expected_text"](spark, d).collect()}
    assert longer and not any(got[k] for k in longer)
    blanks = changed(spark, tmp_path / "b", original=F.concat(F.lit(" 　"), F.replace("original", F.lit(" "), F.lit(" \n"))))
    assert sorted(map(tuple, QUERIES["expected_text"](spark, blanks).collect())) == sorted(map(tuple, QUERIES["expected_text"](spark, DATA).collect()))


def test_document_places_has_every_book(spark, tmp_path):
    books = [(f"Book {k % 90:02}", k % 7 if k % 11 else None) for k in range(180)] + [("book 03", 3), (None, 2)]
    spark.createDataFrame(books, "doc_key string, pages int").coalesce(3).write.parquet(f"{tmp_path}/run_reports.parquet")
    most = {}
    for b, n in books:
        most[b] = max((x for x in (most.get(b), n) if x is not None), default=None)
    key = {b: (n is None, n or 0, b is None, (b or "").lower()) for b, n in most.items()}
    got = {r.doc_key: (r.pages, r.place) for r in QUERIES["document_places"](spark, str(tmp_path)).collect()}
    assert got == {b: (n, 1 + sum(k < key[b] for k in key.values())) for b, n in most.items()}
    assert len(got) > 40 == QUERIES["document_order"](spark, str(tmp_path)).count()


def decided(spark, folder, rows):
    """A table of decisions (run_id, page, original, lines), each delivered twice."""
    t = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "decision_id long, run_id long, page int, original string, candidate array<string>")
    t.unionByName(t).write.parquet(f"{folder}/decisions.parquet")
    return str(folder)


def test_worst_pages_read_the_texts(spark, tmp_path):
    """A page read wholly wrong at the same length is the worst of its run; each run has its own twelve."""
    rows = [(1, p, "abcdefghij", ["abcdefghi" if p % 2 else "abcdefghij"]) for p in range(20)] + [(1, 90, "abcdefghij", ["zzzzzzzzzz"]), (1, 91, "abc", [""]), (1, 92, "abc", None)]
    rows += [(2, p, "abcd", ["abcz"]) for p in range(3)]
    d = decided(spark, tmp_path, rows)
    got = [tuple(r) for r in QUERIES["worst_pages_exact"](spark, d).orderBy("run_id", "place").collect()]
    first = [(90, 0.0)] + [(p, round(18 / 19, 6)) for p in range(1, 20, 2)] + [(0, 1.0)]
    assert got == [(1, p, r, k) for k, (p, r) in enumerate(first, 1)] + [(2, p, 0.75, p + 1) for p in range(3)]
    weighted = {r.run_id: r.weighted for r in QUERIES["weighted_agreement_exact"](spark, d).collect()}
    assert weighted == {1: round((10 + 10 * 18 / 19) / 21, 4), 2: 0.75}


TEXTS = [
    ("Mail a.b+c@x.org by 12.5, 12.5 and 3-4", ["Mail a.b+c@x.org by 12.5,", "12.5 and 3-4"]), ("가격은 1,200원 이다", ["가격은 1,200원", "이다 더"]), ("第3章 索引と余白", ["第3章 索引"]), ("第３章 价格 ５", ["第３章", "价格 ５"]),
    ("Café déjà vu, Straße", ["CAFÉ déjà vu,", "Straße"]), ("<b>bold</b> &amp; 5 < 7", ["bold & 5", "< 7"]), ("costs $5$ and\u3000$x^2$ & more", ["costs $5$ and", "$x^2$ & more"]), ("page 12 of 12", ["page 12 of 1 2"]), ("", [""]), ("abc", [""]), ("a % b _ c", ["a % b _ c d"]),
]


def test_guards_read_every_text(spark, tmp_path):
    d = decided(spark, tmp_path, [(1, 1, *t) for t in TEXTS] + [(2, 1, None, ["x"]), (2, 1, "x", None)])
    both = [(a, " ".join(b)) for a, b in TEXTS]
    pattern = lambda t: r"[\w.+-]+@[\w.-]+|\d+(?:[.,-]\d+)*" if "@" in t else r"\d+(?:[.,-]\d+)*"
    tokens = {r.decision_id: (r.n, r.tokens) for r in QUERIES["critical_tokens_whole"](spark, d).collect()}
    assert tokens == {k: (len(x := re.findall(pattern(a), a)), " ".join(x)) for k, (a, _) in enumerate([*both, (None, ""), ("x", "")]) if a is not None}
    words = lambda t: Counter(re.findall(r"\w+", t.lower()))
    coverage = {r.decision_id: (r.n_words, r.common) for r in QUERIES["word_coverage_whole"](spark, d).collect()}
    assert coverage == {k: (words(a).total(), (words(a) & words(b)).total()) for k, (a, b) in enumerate(both) if words(a)}
    kept = {}
    for k, (a, b) in enumerate(both):
        a, b = ("".join("".join(text_units(t)).split()) for t in (a, b))
        at = 0
        for c in a:
            at = b.find(c, at) + 1 if at >= 0 else at
            at = at or -1
        numbers = [Counter(re.findall(r"\d+(?:[.,]\d+)*", t)) for t in (a, b)]
        kept[k] = bool(a and b and at >= 0 and len(b) <= max(1.6 * len(a), len(a) + 32) and numbers[0] <= numbers[1])
    got = {r.decision_id: r.preserved for r in QUERIES["preserves_content_whole"](spark, d).collect()}
    assert got == kept and True in got.values() and False in got.values()
    lines = {r.run_id: (r.blocks, r.failures) for r in QUERIES["conserved_lines"](spark, d).collect()}
    assert lines == {1: (len(TEXTS), 0)}


def test_dense_text_of_every_script(spark, tmp_path):
    texts = [a for a, _ in TEXTS] + [None, "ÀB\u3000Ç\xa0ß"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.dense for r in QUERIES["dense_text_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: "".join("".join(text_units(t)).split()).casefold() for k, t in enumerate(texts) if t is not None}
