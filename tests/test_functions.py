"""Literal cases of text, likeness, layout, raster and table functions."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireflow.functions import layout as L
from quireflow.functions import raster as R
from quireflow.functions import similarity as S
from quireflow.functions import tables as B
from quireflow.functions import text as T
from quireflow.operators import extract as X


@pytest.mark.parametrize(
    "text, units",
    [
        ("$ 3 \\times 8 $ decoder", ["3 × 8 decoder"]),
        ("$\\frac{a}{b}$", ["$\\frac{a}{b}$"]),
        ("$x_{1} \\times y$", ["$x_{1} \\times y$"]),
        ("$x \\unknown y$", ["$x \\unknown y$"]),
        ("Price $20 and $30", ["Price $20 and $30"]),
        ("$$3 \\times 8$$", ["$$3 \\times 8$$"]),
        ("\\$3 \\times 8$", ["\\$3 \\times 8$"]),
        ("To: Alice <alice@example.com>", ["To: Alice <alice@example.com>"]),
        ("x < 5 and y > 2", ["x < 5 and y > 2"]),
        ("<td>A &lt;a@b.com&gt;</td>", ["A <a@b.com>"]),
        ("<table><tr><td>To:</td><td>Alice</td></tr><tr><td>From:</td><td>Bob</td></tr></table>", ["To:", "Alice", "From:", "Bob"]),
        ("<p>vector<T> <Node>v</Node> <Item/></p>", ["vector<T> <Node>v</Node> <Item/>"]),
        ("<p>A<br/>B<span/>C</p>", ["A", "BC"]),
        ("<td>&lt;b&gt;x&lt;/b&gt; &amp;lt; &amp;</td>", ["<b>x</b> &lt; &"]),
        ("", []),
    ],
)
def test_units(text, units):
    assert T.text_units(text) == units


def test_titles(spark):
    rows = [("|연습문제", "연습문제"), ("| 학습목표 |", "학습목표"), ("|x| + |y|", "|x| + |y|"), ("## *Title*", "Title"), ("■ Part |", "Part")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", T.clean_title(F.col("t")))
    assert [r.got for r in df.collect()] == [w for _, w in rows]
    f = spark.createDataFrame([("12",), ("0",), ("xiv",), ("IIII",), ("",), ("123456",)], "t string").select(T.folio(F.col("t")).alias("f")).collect()
    assert [None if r.f is None else (r.f.style, r.f.value) for r in f] == [("arabic", 12), None, ("roman", 14), None, None, None]
    i = spark.createDataFrame([("CHAPTER 02 Title",), ("제3장 구조",), ("Appendix B Tables",), ("4.1.2 Deep",), ("Lab 3.1 Try",), ("Plain",)], "t string").select(T.identity(F.col("t")).alias("i")).collect()
    assert [(r.i.kind, r.i.ident, r.i.lexical) for r in i] == [("chapter", "2", "Title"), ("chapter", "3", "구조"), ("chapter", "B", "Tables"), ("section", "4.1.2", "Deep"), ("lab", "3.1", "Try"), ("plain", None, "Plain")]


def test_guards(spark):
    rows = [
        ("R 02 title", "CHAPTER 02 title", True),
        ("CHAPTER 02 title", "CHAPTER 03 title", False),
        ("Chapter 12", "Chapter 123", False),
        ("Original important words", "Original words", False),
        ("", "x", True),
    ]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", S.preserves_content(F.col("a"), F.col("b")))
    assert [r.got for r in df.collect()] == [w for _, _, w in rows]
    long = "the quick brown fox jumps over the lazy dog"
    rows = [(long, "zzz yyy xxx www vvv uuu ttt sss rrr qqq ppp ooo nnn mmm lll kkk jjj iii", False), ("code 47992", "code 47993 with some other appended words here", False), ("code 47992", "code 47992 with some other appended words here", True), ("", "now there is some text here", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean").withColumn("got", S.repair_is_safe(F.col("a"), F.col("b")))
    assert [r.got for r in df.collect()] == [w for _, _, w in rows]
    prefix = "same words " * 20
    assert S.disagrees(prefix + "12 34", [prefix + "34 12"]) and not S.refinement_is_safe(prefix + "12 34", [prefix + "34 12"])
    assert not S.disagrees("abc def", ["abc", "def"]) and S.disagrees("abc", [])
    assert not S.boundaries_usable("abc", ["abc", " "])


def test_alignment():
    assert S.aligned("alpha beta gamma delta", ["alpha be", "ta gamma", "delta"]) == ["alpha", "beta gamma", "delta"]
    text = "감지기가 일정한 경계를 비교하면 글자는 곧바로 표제를 모은다."
    got = S.aligned(text, ["감지기가 일정한 경게를", "비교하면 글자는", "곧바로 표제를 모은다"])
    assert len(got) == 3 and "".join("".join(got).split()) == "".join(text.split())
    assert S.snapped("one Latin word", 5) == 4 and S.snapped("abcdefghij", 5) == 5


def test_layout():
    assert L.assign_units(["aa", "b"], [1, 1, 1]) == [(0, 2), (2, 3)]
    sizes = [20, 250, 30, 240, 40, 200, 120]
    units = ["a" * int(w / 5) for w in sizes]
    assert [b - a for a, b in L.assign_units(units, sizes)] == [1] * 7
    for text in ("one two three four five six", "글자는 (임시) 장치를 살핀다."):
        got = L.split_text(text, [5.0, 5.0, 5.0])
        assert len(got) == 3 and "".join("".join(got).split()) == "".join(text.split())
    assert L.split_text("", [1.0]) == [] and L.fitted_size(10, 0.1, 5) == 1


def test_long_runs_brute_force():
    for width in range(1, 11):
        for bits in itertools.product([False, True], repeat=width):
            row = np.array([bits])
            for n in range(width + 2):
                want = np.zeros(width, bool)
                if n >= 2:
                    for a in range(width - n + 1):
                        if all(bits[a : a + n]):
                            want[a : a + n] = True
                assert (R.long_runs(row, n)[0] == want).all()


def test_lines_and_boxes():
    page = np.full((90, 200), 255, np.uint8)
    for k in range(3):
        page[10 + 25 * k : 22 + 25 * k, 10:150:2] = 0
        page[10 + 25 * k : 22 + 25 * k, 11:150:4] = 0
    boxes = R.detect_lines(page)
    assert len(boxes) == 3 and all(abs(b[0] - 10 / 3) < 1 and abs(b[2] - 50) < 1 for b in boxes)
    assert R.detect_lines(np.full((50, 50), 255, np.uint8)) == []
    ink = np.zeros((200, 200), bool)
    ink[60:70, 25:100] = True
    got = R.expand_box(ink, (40, 50, 120, 90), (30, 30))
    assert got == [23.0, 50.0, 120.0, 90.0]
    assert R.expand_box(ink, (40, 50, 120, 90), (30, 30), [(20, 55, 38, 75)]) == [40, 50, 120, 90]
    gray = np.full((100, 100), 255, np.uint8)
    gray[40:60, 40:60] = 0
    total, outside = R.ink_coverage(gray, [(38, 38, 62, 62)])
    assert total > 0 and outside == 0
    assert R.ink_coverage(np.zeros((100, 100), np.uint8), []) == (0, 0)
    wide = np.full((10, 400), 255, np.uint8)
    wide[2:8, ::3] = 0
    wide[:, 150:170] = 255
    wide[:, 260:270] = 255
    pieces, between = R.split_line(wide)
    assert len(pieces) == len(between) + 1 >= 2 and " " in between


def test_tables():
    t = "<table><tr><td>A &lt;b&gt;</td><td colspan=2>B</td></tr><tr><td>1</td><td>2<br>3</td><td>4</td></tr></table>"
    rows, regular = B.parse_table(t)
    assert regular and rows == [[("A &lt;b&gt;", 1), ("B", 2)], [("1", 1), ("2\n3", 1), ("4", 1)]]
    assert not B.parse_table('<table><tr><td rowspan="2">x</td></tr></table>')[1]
    cells = "".join("<tr>" + "".join(f"<td>c{r}{k}</td>" for k in range(3)) + "</tr>" for r in range(3))
    lines = [(10 + 40 * k, 10.0 + 20 * r, 40 + 40 * k, 20.0 + 20 * r) for r in range(3) for k in range(3)]
    got = B.layout_table(f"<table>{cells}</table>", (0, 0, 130, 70), lines)
    assert [x[1] for x in got] == [f"c{r}{k}" for r in range(3) for k in range(3)]
    assert B.layout_table("<table><tr><td>x</td></tr></table>", (0, 0, 1, 1), []) is None


def test_boxes(spark):
    rows = [([3.0, 4.0, 1.0, 2.0],), ([1.0, 1.0, 5.0, 1.0, 5.0, 3.0, 1.0, 3.0],), ([1.0, 2.0],), (None,), ([1.0, None, 2.0, 3.0],)]
    got = spark.createDataFrame(rows, "b array<double>").select(X.norm_box(F.col("b")).alias("b")).collect()
    assert [None if r.b is None else tuple(r.b) for r in got] == [(1.0, 2.0, 3.0, 4.0), (1.0, 1.0, 5.0, 3.0), None, None, None]
    b = spark.createDataFrame([(1, 1, "a  b", [0.0, 0.0, 1.0, 1.0]), (1, 2, "a b", [0.0, 0.0, 1.0, 1.0]), (1, 3, "a b", [0.0, 5.0, 1.0, 6.0])], "page_id long, ord int, block_content string, block_bbox array<double>")
    assert sorted(r.ord for r in X.find_blocks(b).collect()) == [1, 3]


def test_reviews_fail_loudly(spark):
    block = "array<struct<block_content:string,block_bbox:array<double>,block_label:string>>"
    pages = spark.createDataFrame([("s", 1, 10.0, 20.0, [("a", [0.0, 0.0, 1.0, 1.0], "text")]), ("s", 2, 10.0, 20.0, [("b", None, "text")]), ("t", 2, 10.0, 20.0, None)], f"source_sha256 string, page int, width double, height double, blocks {block}")
    kind = f"source_sha256 string, page int, reason string, original {block}, lines array<struct<text:string,bbox:array<double>>>"
    right = ("s", 2, "cut off", [("b", None, "text")], [("B", [0.0, 0.0, 10.0, 20.0])])
    got = {(r.source_sha256, r.page): r.blocks and [tuple(b) for b in r.blocks] for r in X.review_layouts(pages, spark.createDataFrame([right], kind)).collect()}
    assert got == {("s", 1): [("a", [0.0, 0.0, 1.0, 1.0], "text")], ("s", 2): [("B", [0.0, 0.0, 10.0, 20.0], "reviewed_line")], ("t", 2): None}
    wrong = {
        "review of other blocks": [right[:3] + ([("x", None, "text")],) + right[4:]], "page reviewed twice": [right, right], "review without a reason": [right[:2] + (" ",) + right[3:]], "review without lines": [right[:4] + ([],)],
        "line that is not in the page": [right[:4] + ([("B", [0.0, 0.0, 11.0, 20.0])],)],
    }
    for why, rows in wrong.items():
        with pytest.raises(Exception, match=why):
            X.review_layouts(pages, spark.createDataFrame(rows, kind)).collect()
    for line in (("", [0.0, 0.0, 1.0, 1.0]), ("a\nb", [0.0, 0.0, 1.0, 1.0]), ("a", [1.0, 0.0, 1.0, 1.0]), ("a", [0.0, 0.0, float("nan"), 1.0]), ("a", None)):
        with pytest.raises(Exception, match="line that is not in the page"):
            X.review_layouts(pages, spark.createDataFrame([right[:4] + ([line],)], kind)).collect()


def test_character_maps():
    from quireflow.functions.fonts import utf16_map

    data = b"1 beginbfchar\n<0003> <1f3e0>\n<0004> <0041>\nendbfchar\n1 beginbfrange\n<0005> <0006> <1F600>\n<0007> <0008> <0061>\nendbfrange\n<0001> <1f3e0>\n"
    want = b"1 beginbfchar\n<0003> <d83cdfe0>\n<0004> <0041>\nendbfchar\n1 beginbfrange\n<0005> <0006> [<d83dde00> <d83dde01>]\n<0007> <0008> <0061>\nendbfrange\n<0001> <1f3e0>\n"
    assert utf16_map(data) == want and utf16_map(want) == want and utf16_map(b"") == b""
    with pytest.raises(ValueError):
        utf16_map(b"1 beginbfchar\n<0003> <ffffff>\nendbfchar")


def test_numbering_rules_agree(spark):
    """The rules over columns and over strings give the same, and the word forms mean what they should."""
    cases = {"Appendix A Title": ("chapter", "A"), "appendix b": ("plain", None), "부록 C 제목": ("chapter", "C"), "Chapter 03 x": ("chapter", "3"), "Kapitel 4 Der": ("chapter", "4"), "Abcdefgh 4 x": ("plain", None), "제 12 장 끝": ("chapter", "12"), "3장": ("chapter", "3"), "Lab 3.1.4 x": ("lab", "3.1.4"), "lab 3": ("plain", None), "A.1.2 Bar": ("section", "A.1.2"), "a.1 bar": ("plain", None), "1.2": ("section", "1.2"), "Chapter 3": ("plain", None), "": ("plain", None)}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: (r.i.kind, r.i.ident) for r in df.select("t", T.identity(F.col("t")).alias("i")).collect()}
    assert got == cases == {t: T.numbering(t) for t in cases}


def test_numbering_of_any_depth(spark):
    deep = "1" + ".1" * 50_000
    i = spark.createDataFrame([(f"{deep} x",), (f"A{deep[1:]} x",)], "t string").select(T.identity(F.col("t")).alias("i")).collect()
    assert [(r.i.kind, r.i.ident, r.i.lexical) for r in i] == [("section", deep, "x"), ("section", f"A{deep[1:]}", "x")]


def test_agreement_by_brute_force():
    """The ratio against a plain search for the longest common blocks, on short random texts."""
    import random

    from quireflow.functions import similarity as S

    def matched(a, b):
        best = max(((i, j, k) for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j)) if a[i + n] != b[j + n]), min(len(a) - i, len(b) - j))]), key=lambda x: (x[2], -x[0], -x[1]), default=(0, 0, 0))
        i, j, k = best
        return k + matched(a[:i], b[:j]) + matched(a[i + k :], b[j + k :]) if k else 0

    r = random.Random(2)
    for _ in range(200):
        a, b = ("".join(r.choices("abcd", k=r.randint(0, 9))) for _ in "ab")
        want = 2 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert abs(S.ratio(a, b) - want) < 1e-12
        for threshold in (0.3, 0.7, 0.94):
            assert S.is_below(a, b, threshold) == (want < threshold)


def test_agreement_audit_by_hand(spark, tmp_path):
    """Bands, weighted means and worst pages by the true ratio."""
    from quireflow.plans import review as R

    rows = [(1, 7, 1, "abcd", ["abcd"]), (2, 7, 2, "abcdefghij", ["abcdefghix"]), (3, 7, 3, "wxyz", ["abcd"]), (4, 8, 1, "abc", []), (5, 8, 2, "", ["x"]), (1, 7, 1, "abcd", ["abcd"]), (6, 8, 3, "hello", None)]
    spark.createDataFrame(rows, "decision_id long, run_id long, page int, original string, candidate array<string>").write.parquet(f"{tmp_path}/decisions.parquet")
    bands = {r.band: (r.blocks, r.weighted) for r in R.agreement_exact(spark, str(tmp_path)).collect()}
    assert bands == {"0.99+": (1, 1.0), "0.90+": (1, 0.9), "under 0.90": (1, 0.0), "no recognizer output": (2, 0.0)}
    assert [(r.run_id, r.weighted) for r in R.weighted_agreement_exact(spark, str(tmp_path)).collect()] == [(7, round((4 + 9 + 0) / 18, 4))]
    assert sorted((r.place, r.page, r.worst) for r in R.worst_pages_exact(spark, str(tmp_path)).collect()) == [(1, 3, 0.0), (2, 2, 0.9), (3, 1, 1.0)]
