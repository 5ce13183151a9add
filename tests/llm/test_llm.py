"""Training-data operators: brute force, exact round trips, held-out accuracy and edge cases."""

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.llm import p1_lookalikes as P1
from quireflow.llm import p2_repetition as P2
from quireflow.llm import p3_scan_noise as P3
from quireflow.llm import p4_markup as P4
from quireflow.llm import p5_language as P5
from quireflow.llm import p6_tokens as P6
from quireflow.llm import p7_mixture as P7
from quireflow.llm import p8_stuffing as P8
from quireflow.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
has_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
ZW, CYR_A, GREEK_IOTA = chr(0x200B), chr(0x430), chr(0x399)


# 1


def latin_lattice():
    words = ["chapter", "paper", "part", "summary", "review", "case", "scan", "iii", "circuit"]
    return P1.Lattice({("latin", g): n for g, n in Counter(g for w in words for g in ["^^" + w[0], ("^" + w)[:3], *[w[i : i + 3] for i in range(len(w) - 2)]]).items()})


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Ｃｈａｐｔｅｒ ４", "Chapter 4", True),
        ("Ch" + CYR_A + "pter", "Chapter", True),
        (GREEK_IOTA + "II", "III", True),
        ("Sum" + ZW + "mary", "Summary", True),
        ("a" + chr(0xA0) + "b", "a b", True),
        ("e" + chr(0x301) + "t", chr(0xE9) + "t", True),
        ("제2장", "제2장".encode("utf-8").decode(), True),
        (chr(0x2162), "III", True),
        ("mm" + chr(0xB2), "mm2", False),
        (chr(0x2460), "1", False),
        ("Summary", "SUMMARY", False),
        ("caf" + chr(0xE9), "cafe", False),
        (chr(0x339F), "mm" + chr(0xB2), True),
        ("3 " + chr(0x2126), "3 " + chr(0x3A9), True),
        ("ch" + chr(0x3B1) + "pter", "chapter", True),
        (chr(0x13DF) + "hapter", "Chapter", True),
        (chr(0xA4DA) + "ase", "Case", True),
        ("pap" + chr(0x450) + "r", "pap" + chr(0xE8) + "r", True),
        ("pap" + chr(0x450) + "r", "paper", False),
        ("広い力ウンタ", "広いカウンタ", True),
        ("能力の人ロ", "能力の人口", True),
        ("能力", "能カ", True),
        ("コピ一", "コピー", True),
        ("一つの", "一つの", True),
    ],
)
def test_forms(a, b, same):
    lattice = latin_lattice()
    assert (P1.form(a, lattice) == P1.form(b, lattice)) is same


def test_forms_edges():
    lattice = P1.Lattice({})
    assert P1.form(None, lattice) is None and P1.form("", lattice) == "" and P1.form(ZW + " " + ZW, lattice) == ""
    once = P1.form("Ｘ" + CYR_A * 3000, lattice)
    assert P1.form(once, lattice) == once
    # A word with letters only Cyrillic has stays Cyrillic when the corpus has such words.
    word = "".join(map(chr, (0x43F, 0x430, 0x440, 0x442)))
    counts = {("cyrillic", g): 50 for g in ["^^" + word[0], "^" + word[:2], word[:3], word[1:]]}
    assert P1.form(word, P1.Lattice(counts)) == word


def test_viterbi_against_all_paths():
    lattice = latin_lattice()
    for token in ("p" + CYR_A + "rt", GREEK_IOTA + "II", CYR_A + chr(0x440) + "e"):
        paths = itertools.product(*[P1.LOOK.get(c, (c,)) for c in token])

        def cost(path):
            total, before, x, y = 0.0, "", "^", "^"
            for c in path:
                s, b = P1.script_of(c), P1.base_letter(c)
                total += lattice.cost.get((s, x + y + b), P1.UNSEEN) + (lattice.script.get(s, lattice.rare) if not before else P1.SWITCH if s != before else 0)
                before, x, y = s, y, b
            return total, "".join(path)

        assert lattice._viterbi(token) == min(map(cost, paths))[1]


# 2


def test_repeated_against_brute_force():
    r = random.Random(3)
    for _ in range(200):
        pages = [[r.randint(1, 3) for _ in range(r.randint(0, 25))] for _ in range(4)]
        words = np.array([w for p in pages for w in p], np.int64)
        page = np.repeat(np.arange(4), [len(p) for p in pages])
        want = []
        for p in pages:
            hit = [False] * len(p)
            for i in range(len(p) - 4):
                if any(p[j : j + 5] == p[i : i + 5] for j in range(i)):
                    hit[i : i + 5] = [True] * 5
            want += hit
        assert P2.repeated(words, page).tolist() == want


def layout_pages(spark, rows):
    block = "array<struct<block_id:int,block_order:int,block_label:string,block_content:string,block_bbox:array<double>>>"
    return spark.createDataFrame(rows, f"page_id long, run_id long, height double, parsing_res_list {block}")


def test_line_cleaning_edges(spark):
    loop = "one two three four five six seven. " * 4
    rows = [(1, 1, None, [(1, 0, "text", loop, None)]), (2, 1, None, [(1, 0, "text", None, None)]), (3, 1, None, None), (4, 1, None, []), (None, 1, None, [(1, 0, "text", "All words differ here now.", None), None])]
    got = {r.page_id: r for r in P2.clean_lines(layout_pages(spark, rows)).collect()}
    # Seven words four times over: the first time stays, with the loop of it cut from the middle of the line.
    assert got[1].rejected and got[1].n_words == 28 and got[1].n_repeated == 21 and got[1].text == "one two three four five six seven."
    assert not got[2].rejected and got[3].n_words == 0 and got[4].n_words == 0 and got[None].text == "All words differ here now."
    assert P2.clean_lines(layout_pages(spark, []).where("false")).count() == 0


def test_lines_decide(spark):
    """A page is rejected for what its lines lose; without the rule for repetition none is."""
    r = random.Random(9)
    rows, want = [], set()
    for k in range(120):
        words = [r.choice("abcdefghij") * r.randint(1, 2) for _ in range(r.randint(0, 60))]
        lines, at = [], 0
        while at < len(words):
            n = r.randint(1, 9)
            lines.append(" ".join(words[at : at + n]))
            at += n
        if r.random() < 0.2:
            lines.append("home | next | top")
            words += ["home", "next", "top"]
        hit = [False] * len(words)
        for i in range(len(words) - 4):
            if any(words[j : j + 5] == words[i : i + 5] for j in range(i)):
                hit[i : i + 5] = [True] * 5
        if words and 3 * sum(hit) >= len(words):
            want.add(k)
        rows.append((k, 1, None, [(1, 0, "text", "\n".join(lines), None)]))
    loops = [(500 + k, 1, None, [(1, 0, "text", "\n".join(["the record holds a line of it"] * n + ["a b c d"]), None)]) for k, n in enumerate((1, 2, 5))]
    pages = layout_pages(spark, rows + loops)
    got = {x.page_id: x for x in P2.clean_lines(pages).collect()}
    assert {k for k, x in got.items() if x.rejected} == want | {501, 502}
    assert got[502].text == "the record holds a line of it\na b c d" and all("home" not in x.text for x in got.values())
    assert not any(x.rejected for x in P2.clean_lines(pages, limit=1.1).collect())


# 3


def noisy_corpus():
    r = random.Random(5)
    words = "the binding record describes every margin while readers compare columns behind eighteen high-contrast pages".split()
    rows = []
    for k in range(120):
        w = [r.choice(words) for _ in range(24)]
        rows.append((k, "\n".join(" ".join(w[i : i + 8]) for i in (0, 8, 16))))
    return rows


def test_corrections(spark):
    rows = noisy_corpus() + [
        (900, "the binding rccord describes\nevery rnargin while sha256 and B4"),
        (901, "readers compare col-\numns behind the high-\ncontrast binding"),
        (902, "readers compare the bind" + chr(0xAD) + "\ning of 12-\n15"),
        (903, "readers compare the co1-\numns"),
        (904, None), (905, ""), (906, " \n "), (900, "the binding rccord describes\nevery rnargin while sha256 and B4"),
    ]
    got = {r.decision_id: r for r in P3.correct(spark.createDataFrame(rows, "decision_id long, original string")).collect()}
    assert got[900].misread == [1, 2] and got[900].hyphens == []
    assert "record describes" in got[900].paragraph and "margin" in got[900].paragraph and "sha256" in got[900].paragraph
    assert got[901].hyphens == [1] and "columns behind the high-contrast binding" in got[901].paragraph
    assert got[902].hyphens == [1] and "binding of 12-15" in got[902].paragraph
    assert got[903].misread == [1] and got[903].hyphens == [1]
    assert 904 not in got and 905 not in got and got[906].misread == []
    assert not any(got[k].misread or got[k].hyphens for k in range(120))


def second_readings():
    """(original, candidate) of 3 000 lines: one e in forty of the originals is printed as c, and two rare words are real."""
    r = random.Random(11)
    words = "the binding record describes every margin while readers compare columns behind eighteen pages".split()
    rows, wrong = [], set()
    for k in range(1000):
        lines = [[r.choice(words) for _ in range(8)] for _ in range(3)]
        if k in (11, 21):
            lines[0][0] = "rcader"
        clean = [" ".join(x) for x in lines]
        noisy = ["".join("c" if c == "e" and r.random() < 0.025 else c for c in x) for x in clean]
        wrong |= {(k, i + 1) for i in range(3) if noisy[i] != clean[i]}
        rows.append((k, "\n".join(noisy), clean if k % 5 else clean[1:]))
    return rows, wrong


def test_channel_from_two_readings(spark):
    rows, wrong = second_readings()
    df = spark.createDataFrame(rows, "decision_id long, original string, candidate array<string>")
    texts = df.selectExpr("decision_id AS k", "original AS t", "candidate AS o")
    counts = P3.word_counts(texts)
    both = P3.two_readings(texts, "o")
    seen = P3.observed(both, counts)
    assert dict(seen["c"])["e"] == pytest.approx(0.025, rel=0.2) and dict(seen["0"])["o"] < 0.03
    own = {r.word: (r.n, r.own) for r in P3.weighed(counts, both).collect()}
    # A rare word that the second reading confirms keeps its weight; one that it never confirms loses it.
    assert own["rcader"][1] > 0.5 * own["rcader"][0] and all(w < 0.2 * n for x, (n, w) in own.items() if x in ("rccord", "cvery", "whilc") and n > 3)
    got = {(r.decision_id, n) for r in P3.correct(df, other="candidate").collect() for n in r.misread}
    assert len(got & wrong) / len(wrong) > 0.99 and len(got - wrong) / len(got) < 0.01


def test_readings_against_brute_force():
    channel = {"c": [("e", 0.1)], "rn": [("m", 0.2)], "0": [("o", 0.3)], "i": [("l", 0.05), ("t", 0.01)]}

    def every(word):
        out = {("", 1.0, ())}
        for n in range(1, len(word) + 1):
            more = set()
            for k in range(n):
                for head, p, places in [x for x in every.kept[k]]:
                    piece = word[k:n]
                    if n == k + 1:
                        more.add((head + piece, p, places))
                    for meant, q in channel.get(piece, ()):
                        more.add((head + meant, p * q, (*places, k)))
            every.kept.append(more)
        return every.kept[-1] if word else out

    for word in ("ccrn0", "icirn", "abc", "c0c0c0", "rnrn"):
        for least in (1e-9, 1e-3, 0.05):
            every.kept = [{("", 1.0, ())}]
            want = {}
            for w, p, places in every(word):
                if (p >= least or not places) and (not places or not P3._ODD.search(w)) and (w != word or not places):
                    want[w] = max(want.get(w, 0), p)
            got = {w: np.exp(p) for w, p, _ in P3.readings(word, channel, least)}
            assert set(got) == set(want) and all(got[w] == pytest.approx(want[w]) for w in got)


def test_apostrophes(spark):
    assert P3.pieces("l'histoire d’un livre'") == ["l'", "\0histoire", "d’", "\0un", "livre'"] and P3.pieces("a b") == ["a", "b"]
    rows = noisy_corpus() + [(900, "the d'binding rccord's margin")]
    got = {r.decision_id: r for r in P3.correct(spark.createDataFrame(rows, "decision_id long, original string")).collect()}
    assert got[900].misread == [1] and got[900].paragraph == "the d'binding record's margin"


def test_corrections_of_nothing(spark):
    assert P3.correct(spark.createDataFrame([], "decision_id long, original string")).count() == 0


def test_furniture(spark):
    box = lambda y: [100.0, float(y), 900.0, y + 20.0]
    rows = [
        (1, 1, 1400.0, [(1, 0, "text", "Chapter 3 Title", box(30)), (2, 1, "text", "A body sentence here.", box(130)), (3, 2, "text", "~ l2 ~", box(1340))]),
        (2, 1, None, [(1, 0, "header", "Chapter 3 Title  14", box(30)), (2, 1, "text", "7", box(700)), (3, 2, "number", "Page 3 of 9", box(1340))]),
        (3, 2, 1400.0, [(1, 0, "figure_title", "Fig. 1 A picture", box(1340)), (2, 1, "text", None, None)]),
        (4, 2, 1400.0, None),
    ]
    got = {(r.page_id, r.block_id) for r in P3.furniture(layout_pages(spark, rows)).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 3)}


# 4

MARKUP = {
    "html": ["<p>text", "a <b>bold</b> word", "x<br/>y", "<!-- note --> text", "black &amp; white", "a &#x2022;b", "<td colspan=2>x</td>"],
    "markdown": ["## Heading\n\ntext", "a **bold** word", "see [here](https://x.example/y)", "![pic](img/a.png)", "> quoted text", "```c\nint x;\n```", "so __strong__ now", "~~gone~~ text", "| a | b |\n|---|---|\n| 1 | 2 |"],
    "wiki": ["[[page|word]] text", "'''Title''' text", "== Part ==\ntext", "{| class=\"x\"\n|-\n| a || b\n|}", "a {{see|b}} c", 'x<ref name="n">y</ref>'],
    "latex": ["\\section{Part} text", "a \\textbf{b} c", "$x^{2} \\geq 3$", "$$ a $$", "\\( x_{1} \\)", "\\begin{itemize}\n\\item a\n\\end{itemize}", "~\\cite{a12}"],
}
PLAIN = ["list<Folio> here", "vector<T>.", "x < 35 and y > 87", "Mail <a.desk@x.example>.", "costs $22 and $69.", "C:\\sensor\\storage", "cache_response_13", "C# and F#.", "R&D; next", "item #7.", "[17]", "|x| + |y|", "{thread, network}", "26 * 82 * block", "9 << 2", "1. First\n2. Second", "~ ix ~", "13 |", "a", ""]


@pytest.fixture(scope="module")
def labeller(spark):
    return P4.fit(spark.read.parquet("/root/testdata/sf0.01/layout_pages.parquet"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_notations(labeller):
    """The class of each block within a page of prose: nothing else decides, so an unfitted network names other blocks."""
    prose = "The reader compares the same line with a record behind it. While the index waits, every page is measured."
    cases = [(t, 1) for own in MARKUP.values() for t in own] + [(t, 0) for t in PLAIN]
    pages = [([prose, f"{prose} {t}" if k % 2 and "\n" not in t and t[:1] not in "#=>|'<" else t, prose], ["text"] * 3) for k, (t, _) in enumerate(cases)]
    found = lambda m: m.probabilities(*P4.vectors(pages)).argmax(1).reshape(-1, 3)
    want = np.array([x for _, x in cases])
    got = found(labeller)
    assert ((got[:, 1] > 0) == want).mean() >= 0.9 and (got[:, [0, 2]] == 0).mean() > 0.97
    blind = P4.Labeller()
    blind.p = labeller.p | {"out": labeller.p["out"] * 0}
    assert (found(blind)[:, 1] > 0).sum() in (0, len(cases))


def test_rewriting():
    assert P4.clean("<h2>A</h2><ul><li>b</li></ul><p>c &amp; d</p>", "html") == "## A\n\n- b\nc & d"
    assert P4.clean("== A ==\n[[x|y]] z{{q}}", "wiki") == "## A\ny z"
    assert P4.clean("\\section{A} \\textbf{b} $x_1$\\label{l}", "latex") == "# A\n b $x_1$"
    assert P4.clean("| a | b |\n|---|---|\n| 1 | 2 |", "markdown") == "a | b\n1 | 2"
    assert P4.clean("```c\n**x**\n```", "markdown") == "```c\n**x**\n```"


def test_network_gradient():
    pages = [(["<p>a b", "c d\ne"], ["text", "text"]), (["$x^2$"], ["text"])]
    x, lengths, sizes = P4.vectors(pages)
    m = P4.Labeller(1)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x = x.astype(np.float64)
    y = np.array([1, 0, 4])

    def loss():
        p = m.probabilities(x, lengths, sizes)
        return -np.log(p[np.arange(3), y].astype(np.float64)).mean()

    steps = {d: P4._steps(lengths, d == "b") for d in "fb"}
    read = {d: m._read(x, steps[d], d, True) for d in "fb"}
    both = np.concatenate([read[d][0] for d in "fb"], 1)
    prob, pooled = m._classify(both, sizes)
    prob = prob.astype(np.float64)
    prob[np.arange(3), y] -= 1
    prob /= 3
    g = {}
    back = m._unpool(prob, both, pooled, sizes)
    for k, d in enumerate("fb"):
        m._back(x, steps[d], d, read[d][1], back[:, k * P4.HIDDEN : (k + 1) * P4.HIDDEN], g)
    r = np.random.default_rng(0)
    for name in ("hf", "hb", "cf", "cb"):
        at = tuple(r.integers(0, n) for n in m.p[name].shape)
        keep = m.p[name][at]
        m.p[name][at] = keep + 1e-2
        up = loss()
        m.p[name][at] = keep - 1e-2
        down = loss()
        m.p[name][at] = keep
        assert abs((up - down) / 2e-2 - g[name][at]) < 2e-4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_labeller_held_out(spark, labeller):
    """Pages rendered anew, with words the model has not seen in these places."""
    rows = P4._contents(spark.read.parquet("/root/testdata/sf0.001/layout_pages.parquet").dropDuplicates(["page_id"])).orderBy("page_id").collect()
    pages, targets = P4.rendered([(r.contents, r.labels) for r in rows], seed=99)
    y = np.array([v for x in targets for v in x])
    got = labeller.probabilities(*P4.vectors(pages)).argmax(1)
    assert ((got > 0) == (y > 0))[y >= 0].mean() > 0.98 and (got == y)[y >= 0].mean() > 0.95


def test_rendering():
    r = random.Random(4)
    prose = "The reader compares the same line with a record."
    pages, targets = P4.rendered([([prose, None, "a <b>x</b>", "x = y[1]"], ["text", "text", "text", "code"])] * 300, seed=r.randrange(99))
    assert {t for x in targets for t in x[:1]} == {0, 1, 2, 3, 4}
    assert all(t[1:] == [0, -1, 0] and p[0][1:] == [None, "a <b>x</b>", "x = y[1]"] for p, t in zip(pages, targets))
    assert any(p[0][0] == prose for p in pages) and all(p[0][0] != prose for p, t in zip(pages, targets) if t[0])
    assert P4.rendered([]) == ([], [])


def test_labeller_edges(spark):
    model = P4.Labeller()
    got = P4.label_blocks(layout_pages(spark, [(1, 1, None, None), (2, 1, None, []), (3, 1, None, [None, (1, 0, None, None, None), (3, 1, "code", "<b>", None), (2, 1, "text", "x " * 50_000, None)])]), model)
    assert all(r.block_id == 2 for r in got.collect())


# 5


def test_segments():
    got = P5.segments("The lens measures every column. / 감지기는 글자의 버퍼를 측정한다. 新しい脚注を静かに比べる。これは文である。 C# and F#.")
    assert [w for _, w in got] == [True, True, True, True, False]
    assert P5.segments(None) == P5.segments("") == P5.segments(" \n") == []
    assert P5.segments("因为页边确认了旧\n的计数器。")[0][0] == "因为页边确认了旧的计数器。"
    assert not any(w for _, w in P5.segments("<b>x</b> $x^2$ item #27."))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_profiles_on_generated_sentences(spark):
    p = P5.profiles_of(spark, "/root/testdata/sf0.1")
    cases = {
        "en": "Without a broad archive, the editors measure what readers have to compare.", "de": "Nicht nur die Zeilengrenze misst den Buchrücken, auch die Messreihe speichert das Protokoll.",
        "fr": "Il est utile que le registre soit sous la colonne quand le répertoire compare la requête.", "es": "Conviene que la colección esté desde el capítulo cuando el número prepara el índice.",
        "ko": "감지기는 글자의 버퍼를 따로 측정한다.", "ja": "通路と印刷機の間で正確な段落をゆっくり比べることがある。", "zh": "因为缓冲区确认了压缩的信号，所以脚注安静地收集那个镜头。",
    }
    langs, sure = p.name(list(cases.values()))
    assert langs == list(cases) and (sure > 0.02).all()
    assert p.name([]) == ([], pytest.approx(np.zeros(0)))


def test_distance_against_definition():
    p = P5.Profiles({"a": Counter({"x": 5, "y": 3, "z": 1}), "b": Counter({"y": 4, "q": 2})})
    text = "yyx"
    grams = Counter(P5._grams("yyx"))
    order = sorted(grams, key=lambda g: (-grams[g], p.ids.get(g, 10**6 + list(grams).index(g))))
    places = {"a": {"x": 0, "y": 1, "z": 2}, "b": {"y": 0, "q": 1}}
    for k, lang in enumerate(p.langs):
        want = np.mean([abs(places[lang][g] - i) if g in places[lang] else P5.PROFILE for i, g in enumerate(order)])
        assert p.distances([text])[0, k] == pytest.approx(want)


# 6


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ALPHABET = st.text(alphabet=st.sampled_from(list("ab eé한글字の \n\t  <|>0-9'sT.") + [chr(x) for x in (0xA0, 0x85, 0x1C, 0x200B, 0x3000, 0x1F600, 0xFFFD, 0x2028)]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_tokens(tokenizer, text):
    assert P6.encoder().encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    assert P6.encoder().count(text) == len(P6.encoder().encode(text))


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=10), st.integers(0, 30), st.integers(0, 30))
def test_edits(text, new, a, b):
    bpe = P6.encoder().bpe
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    last = bpe.extend(text, [-1])
    got, at = bpe.edit(text, last, a, b, new)
    assert got == text[:a] + new + text[b:] and at == bpe.extend(got, [-1])
    long = b"the reader waits for the index " * 40
    bpe_last = bpe.extend(long, [-1])
    got_long, at_long = bpe.edit(long, bpe_last, a, b, new)
    assert at_long == bpe.extend(got_long, [-1])
    assert b"".join(bpe.by_bytes[t] for t in bpe.backtrack(at)) == got
    # Every prefix's tokens are those of merging in order of rank.
    assert bpe.backtrack(at) == bpe._merge_below(got, bpe.size) if got else True


def test_token_edges(spark, tokenizer):
    texts = [None, "", " ", "<|endoftext|>", "word " * 60_000, "a\x00b"]
    got = {r.doc_id: r.ids for r in P6.encode_corpus(spark.createDataFrame(list(enumerate(texts)) + [(2, " ")], "doc_id long, text string")).collect()}
    assert got == {k: [] if not t else tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}
    assert P6.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# 7


def test_route_against_brute_force():
    r = random.Random(1)
    for _ in range(60):
        sources = ["a", "b", "c"]
        targets = {s: (r.choice([0.2, 0.3, 0.5]), r.randint(1, 3)) for s in sources}
        patterns = [p for n in (1, 2, 3) for p in itertools.combinations(sources, n)]
        capacity = {p: r.randint(0, 60) for p in r.sample(patterns, 4)}
        total, quota, flows = P7.route(capacity, targets)
        used = Counter()
        for p, by in flows.items():
            assert sum(by.values()) <= capacity[p] * max(targets[s][1] for s in p)
            for s, n in by.items():
                assert s in p and n <= capacity[p] * targets[s][1]
                used[s] += n
        assert {s: n for s, n in quota.items() if n} == dict(used)
        # A larger total fits only if its quotas can be filled: by max-flow min-cut over all sets of sources.
        live = [s for s in sources if any(s in p and capacity[p] for p in capacity)]
        if not live:
            continue
        share = {s: targets[s][0] / sum(targets[x][0] for x in live) for s in live}
        groups = [g for n in range(1, len(live) + 1) for g in itertools.combinations(live, n)]
        room = {g: sum(c * min(max(targets[s][1] for s in p), sum(targets[s][1] for s in p if s in g)) for p, c in capacity.items() if set(p) & set(g)) for g in groups}
        fits = lambda t: all(sum(int(share[s] * t) for s in g) <= room[g] for g in groups)
        assert fits(total) and (not fits(total + 1) or total == sum(c * max(targets[s][1] for s in p) for p, c in capacity.items()))


def test_mixture(spark):
    docs = [(k, f"a text number {k} of this corpus", "x" if k % 3 else "y", None) for k in range(300)] + [(900, "shared text of two", "x", None), (901, "shared text of two", "y", None), (902, None, "x", None), (903, "", "x", None), (904, "no source", None, None), (905, "no target", "q", None)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    targets = spark.createDataFrame([("x", 0.4, 1), ("y", 0.4, 3), ("none", 0.2, 2), ("z", None, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    used, plan = P7.mixture(docs, targets)
    rows = used.collect()
    size = Counter()
    for r in rows:
        size[r.source] += r.uses * r.tokens
        assert r.uses <= (1 if r.source == "x" else 3)
    assert abs(size["x"] / sum(size.values()) - 0.5) < 0.01 and set(size) == {"x", "y"}
    assert sorted((r.doc_id, r.source, r.uses) for r in rows) == sorted((r.doc_id, r.source, r.uses) for r in P7.mixture(docs, targets)[0].collect())
    assert not {r.doc_id for r in rows} & {902, 903, 904, 905}
    assert P7.mixture(docs.where("false"), targets)[0].count() == 0


# 8


def test_stuffing(spark):
    r = random.Random(2)
    nouns, verbs = "lens page column record margin binding reader cache shelf index".split(), "describes measures compares rejects restores".split()
    prose = [" ".join(f"The {r.choice(nouns)} {r.choice(verbs)} the {r.choice(nouns)} behind a {r.choice(nouns)} while readers wait for it." for _ in range(8)) for _ in range(400)]
    offers, goods = "buy cheap discount coupon wholesale deal".split(), ["toner", "scanner", "label maker", "book stand"]
    spam = [", ".join(f"{r.choice(offers)} {r.choice(goods)}" for _ in range(60)), "\n".join(f"* [{r.choice(goods)} {r.choice(offers)}](https://x{k}.example/a/b-{k})" for k in range(25)), " ".join(f"#{r.choice(offers)}{r.choice(goods).replace(' ', '')}" for _ in range(60)), " ".join(f"Looking for {o} {g}? Our {g} is the {o} {g} for {g} fans who want {r.choice(offers)} {g}." for o, g in zip(r.choices(offers, k=20), r.choices(goods, k=20)))]
    fine = ["\n".join(f"{r.choice(nouns)} and {r.choice(nouns)}, {r.randint(1, 99)}, {r.randint(100, 400)}" for _ in range(40)), " ".join(["The reader compares the same line with a record behind it."] * 20), "\n".join(f"{k}  copper {r.choice(nouns)}  B4-{k}  {k} pcs" for k in range(40))]
    texts = prose + spam + fine + [None, "", " ", "buy toner"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(400, spam[0])], "doc_id long, text string")
    x = P8.measured(df)
    got = {g.doc_id for g in P8.flagged(x, P8.statistics(x)).where("outlier").collect()}
    assert got == {400, 401, 402, 403}
    empty = P8.measured(df.where("false"))
    assert P8.flagged(empty, P8.statistics(empty)).count() == 0


def test_links_without_scheme():
    """A list of hosts without a scheme is a link list like any other."""
    r = random.Random(3)
    bare = "\n".join(f"* shop{k}.example.{r.choice(['com', 'net', 'org'])}/toner-{k}" for k in range(30))
    assert P8.features(bare)[1][0] > 0.5
    old = P8.re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+|[\w.-]+\.(?:example|test|invalid|com|net|org)/\S*", P8.re.I)
    parts = ["shop", ".", ".COM/", ".te\u017ft/a", "/", " ", "www.", "http://", "-", "x", "\n", ")", "책", ".org"]
    for _ in range(5000):
        text = "".join(r.choices(parts, k=r.randint(1, 9)))
        found = old.findall(text)
        assert P8._URL.findall(text) == found and (P8._may_link(text) or not found)


def test_features_by_hand():
    lang, x = P8.features("The lens measures a column. The lens measures a column. buy toner, buy toner, buy toner\nshelf and line, 3, 17")
    at = dict(zip(P8.FEATURES, x))
    # Five words once, five of a copied sentence, six of a list, five of an index line: 21 - 5 judged or listed.
    assert lang == "en" and at["offers"] == pytest.approx(3 / 16) and at["barren"] == pytest.approx(6 / 16) and at["numbers"] == pytest.approx(5 / 16) and at["copies"] > 0.1
    assert at["lack_function"] == pytest.approx(9 / 11) and at["lack_sentences"] == pytest.approx(11 / 16)
    assert P8.features("감지기는 글자의 버퍼를 따로 측정한다. 렌즈는 문서를 옮긴다.")[0] == "ko"
    assert P8.features(None) is P8.features("") is P8.features(" \n") is P8.features("buy toner") is None
    assert P8.features("ＢＵＹ " * 20) == P8.features("BUY " * 20)
    assert P8.features("word " * 200_000)[1][4] == 1


def test_distance_decides(spark):
    """Without the part towards spam, or with another centre, the cases are lost: nothing but the distance names them."""
    r = random.Random(8)
    nouns = "lens page column record margin binding reader cache shelf index".split()
    prose = [" ".join(f"The {r.choice(nouns)} compares the {r.choice(nouns)} behind a {r.choice(nouns)} while readers wait for it." for _ in range(8)) for _ in range(150)]
    spam = [", ".join(f"{r.choice(['zorb', 'plin', 'quax'])} {r.choice(['fenn', 'drell'])}" for _ in range(60)), "\n".join(f"* [{r.choice(nouns)}](https://x{k}.example/a/b-{k})" for k in range(25))]
    x = P8.measured(spark.createDataFrame(list(enumerate(prose + spam)), "doc_id long, text string"))
    stats = P8.statistics(x)
    # Neither case holds a word of the list of offers.
    assert {g.doc_id for g in P8.flagged(x, stats).where("outlier").collect()} == {150, 151}
    blind = {k: (m, v * 0.01) for k, (m, v) in stats.items()}
    assert P8.flagged(x, blind).where("outlier").count() == 0


def test_stuffing_without_blanks(spark):
    """Japanese and Chinese pages of stacked keywords, product tags and links are cases; prose, copies and indexes are not."""
    r = random.Random(6)
    zh, ja = "段落 传感器 存储器 页边 镜头 字符 标题 目录 装订".split(), "段落 センサ 書架 余白 索引 製本 文字 通路 回路".split()
    old = "旧 新 透明 宽阔 准确 狭窄".split()
    prose = ["".join(f"{r.choice(old)}的{r.choice(zh)}慢慢地比较这个{r.choice(zh)}。因为{r.choice(zh)}说明了{r.choice(zh)}，所以{r.choice(zh)}会检查那个{r.choice(zh)}。" for _ in range(9)) for _ in range(250)]
    prose += ["".join(f"{r.choice(ja)}と{r.choice(ja)}の間で古い{r.choice(ja)}をもう一度調べることがある。" for _ in range(12)) for _ in range(250)]
    goods, offers = "扫描仪 碳粉盒 标签机 书架灯".split(), "购买 优惠 批发 包邮 价格 特价 折扣".split()
    spam = ["，".join(f"{r.choice(offers)}{r.choice(goods)}" for _ in range(60)), " ".join(f"#{r.choice(goods)}{r.choice(offers)}" for _ in range(40)), "\n".join(f"{r.choice(goods)} http://x{k}.example/{k}" for k in range(30))]
    goods, offers = "スキャナー トナー ラベルプリンター 本棚".split(), "激安 通販 送料無料 割引 最安値 口コミ".split()
    spam += ["、".join(f"{r.choice(goods)}{r.choice(offers)}" for _ in range(60)), "\n".join(f"{r.choice(offers)}の{r.choice(goods)} {r.choice(goods)}{r.choice(offers)}" for _ in range(40))]
    fine = ["\n".join(f"{r.choice(zh)}与{r.choice(zh)}, {r.randint(1, 99)}, {r.randint(100, 400)}" for _ in range(40)), "\n".join(f"{r.choice(ja)}と{r.choice(ja)}……{r.randint(1, 400)}" for _ in range(40)), "旧的传感器慢慢地比较这个字符。" * 30, "古い目録は索引の回路を別々に調べる。" * 30]
    fine += ["".join(prose[0:1]) + "".join(f"<table><tr><td>{k}</td><td>{r.choice(zh)}与{r.choice(old)}</td></tr></table>\n" for k in range(30)), "".join(prose[1:2]) + "\nfor (printer = 0; printer < 69; printer++)\n    inventory[printer] = printer * 69;"]
    df = spark.createDataFrame(list(enumerate(prose + spam + fine)), "doc_id long, text string")
    x = P8.measured(df)
    assert {g.doc_id for g in P8.flagged(x, P8.statistics(x)).where("outlier").collect()} == {500, 501, 502, 503, 504}
    assert P8.features(spam[0])[1][8] > 0.2 and P8.features(spam[1])[1][2] > 0.5


# All


@has_data
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_runs(spark, name):
    df = Q.queries()[name](spark, DATA)
    rows = df.collect()
    columns = {"p1_found": ["entry_id", "page_id", "block_id"], "p2_found": ["page_id"], "p3_found": ["kind", "record_id", "item_no"], "p4_found": ["page_id", "block_id"], "p5_found": ["request_id", "lang"], "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"]}
    if name in columns:
        assert df.columns == columns[name]
        if name != "p6_ids":
            assert len(rows) == len(set(rows))


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for f in os.listdir(DATA):
        spark.read.parquet(f"{DATA}/{f}").where("false").write.parquet(f"{folder}/{f}")
    return folder


@has_data
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_empty_tables(spark, empty_tables, name):
    assert Q.queries()[name](spark, empty_tables).count() == 0


@has_data
@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_null_rows(spark, empty_tables, tmp_path, name):
    """Tables with one more row of nulls, every row twice, and an extra column."""
    for f in os.listdir(DATA):
        t = spark.read.parquet(f"{DATA}/{f}")
        nulls = spark.createDataFrame([tuple([None] * len(t.columns))], t.schema)
        t.unionByName(t).unionByName(nulls).withColumn("k", F.lit("x")).write.parquet(f"{tmp_path}/{f}")
    got = Q.queries()[name](spark, str(tmp_path))
    if name.endswith("_found"):
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, Q.queries()[name](spark, DATA).collect()), key=repr)
    else:
        got.count()
