"""Problem 8: keyword-stuffed and link-list pages.

Method: robust Mahalanobis distance. Each document becomes a vector of density, entropy,
repetition and function-word features. For each language the centre is the vector of medians
and the scatter a covariance of the documents within three robust deviations of it, both over
all documents. A document whose deviation towards spam is `FAR` or more, and at least `ASIDE`
of its whole distance, is an outlier in spam-directed directions and a case. Nothing else
decides: there is no list a document must match and none that excuses it.

Spam-directed are more links, tags, separators and offers, more passages without function
words, few content words used over and over, and less function words and sentences. Two features
speak for other kinds of pages and count towards the distance only: numbers and copies. Lines
that end in page numbers (of indexes and contents) and passages that are mostly numbers, codes
and signs of programs count as numbers; a sentence repeated word for word counts as a copy, and
once in the other features.

A Korean word with an ending is half a function word and half the content word before the
ending. Widths of forms and ways of composing are evened out first. Texts of which more than a third are Japanese or Chinese signs are cut into units by
script and known offers; content is counted by pairs of signs there.

Language here is the one whose script and function words the text has. Null, empty and blank
texts, and texts under `SHORT` words, are no cases and take no part in the statistics.
Languages with fewer than `FEW` documents use the statistics of all. Equal rows give equal
results; a document is named once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators.lineage import saved
from quireflow.sources.tables import table

FEATURES = ("links", "separators", "tags", "barren", "coverage", "lack_entropy", "lack_function", "lack_sentences", "offers", "numbers", "copies")
#: Direction of spam for each feature: those with 0 speak for other kinds of lists.
TOWARDS = np.array([1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0], float)
#: Least robust deviation of each feature, so that features most documents lack do not blow up.
FLOOR = np.array([0.08, 0.08, 0.05, 0.2, 0.08, 0.08, 0.08, 0.3, 0.02, 0.1, 0.1])
FAR, ASIDE, SHORT, FEW = 7.0, 0.7, 8, 60
#: A text is expected to hold this many different content words at least, fewer only if it is shorter.
TYPES = 150
#: Share of numbers, codes and signs from which a passage is a list of them; share of function words up to which one is barren.
CODES, BARREN = 0.45, 0.125

# Function words by language, and words of offers.
FUNCTION = {
    "en": "the a an of to in and or for with without that which who what is was are were be been by on at from as it its this these each some our not nor neither either than then when while whenever since because until unless although though so could have has had will would can may must there here after before behind beside beneath under over inside against through about into they we you he she their his her if but also only more most other any all no yes how where why".split(),
    "de": "der die das den dem des ein eine einen einem einer und oder für mit ohne dass daß wir ist war sind sei werden wird nicht nur auch auf an in im bei bis zu zum zur von vor nach neben hinter über unter aus durch gegen um als wie wenn weil falls sobald nachdem bevor obwohl während aber sondern es er sie ihr sein seine dieser diese dieses jeder jede jedes nichts alles".split(),
    "fr": "le la les l un une des du de et ou pour avec sans que qui est était sont soit pas ne plus à au aux en dans sur sous par près derrière devant entre contre après avant pendant quand lorsque puisque parce dès tandis si mais aussi il elle nous vous ils ce cette ces chaque tout sa son leur".split(),
    "es": "el la los las un una unos unas y o para con sin que quien es era son sea no se más a al en de del sobre bajo por desde hacia según entre contra después antes mientras cuando porque puesto aunque si pero también él ella nosotros este esta estos cada todo su sus muy".split(),
}
OFFERS = frozenset(
    "buy sale deal deals cheap cheapest discount coupon wholesale price prices review reviews shipping online sku top best order shop offer offers promo bargain clearance kaufen günstig billig angebot angebote rabatt gutschein versand preis preise test bestellen kostenlos acheter promo remise soldes livraison prix avis cher gratuit comprar oferta ofertas descuento cupón envío precio barato gratis opiniones 구매 판매 할인 쿠폰 특가 최저가 도매 무료배송 추천 순위 후기 세일 가격 주문 激安 通販 送料無料 割引 口コミ 最安値 购买 优惠 折扣 批发 包邮 价格 特价".split()
)
KO_ENDS = "은 는 이 가 을 를 의 에 에서 으로 로 와 과 도 며 면 고 다 지만 므로 때 게 히".split()
CJK_FUNCTION = frozenset("のはがをにとでたるいすもかられさこ的了在和是这那个把被从对之间会也就所因为")

_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION.items():
    for _w in _words:
        _OF[_w] = (*_OF.get(_w, ()), _lang)
_URL = re.compile(r"(?:https?://|www\.)[^\s\"'<>)\]]+|(?<![\w.-])[\w.-]+\.(?:example|test|invalid|com|net|org)/\S*", re.I)
_HOST = re.compile(r"\.(?:example|test|invalid|com|net|org)/", re.I)
_CJK, _HANGUL = re.compile("[぀-ヿ㐀-鿿]"), re.compile("[가-힣]")
_ENDING = re.compile(f"^(?=.*[가-힣])(..*?)(?:{'|'.join(sorted(KO_ENDS, key=len, reverse=True))})$")
# Japanese and Chinese are written without blanks: links end where other letters than ASCII begin, words are cut by script.
_CJK_URL = re.compile(r"(?:https?://|www\.)[!#-&(*-;=?-\\^-~]+|(?<![\w.-])[\w.-]+\.(?:example|test|invalid|com|net|org)/[!-~]*", re.I | re.A)
_CJK_OFFER = re.compile("|".join(sorted((w for w in OFFERS if _CJK.search(w)), key=lambda w: (-len(w), w))))
_CJK_TAG = re.compile(r"[#＃][^\W\d_][^\s#＃,，、。.!！?？;；|｜/／]+")
_FUNCTION_SIGN, _OFFER_SIGN = "".join(sorted(CJK_FUNCTION)), "".join(sorted({m[0] for m in _CJK_OFFER.pattern.split("|")}))
_CJK_UNIT = re.compile(
    rf"(?P<han>(?:(?![{_FUNCTION_SIGN}{_OFFER_SIGN}])[㐀-鿿々]|(?!{_CJK_OFFER.pattern})(?![{_FUNCTION_SIGN}])[{_OFFER_SIGN}])+)|(?P<function>[{_FUNCTION_SIGN}]+)|(?P<kana>[ァ-ヿ]+)"
    rf"|(?P<offer>{_CJK_OFFER.pattern})|(?P<url>\0)|(?P<tag>{_CJK_TAG.pattern})|(?P<number>\d[\d.,]*)|(?P<latin>[A-Za-z]+)|(?P<separator>[,，、;；|｜/／»·・•])|(?P<sign>[=<>{{}}+%&^])|(?P<other>[^\W\d_])"
)
_ELEMENT = re.compile(r"</?[A-Za-z][^<>]*>")
_INDEX = re.compile(r"(?:[^\d\s][,，、]\s*|[.．]{3,}\s*|[·…・‥]+\s*)\d{1,4}(?:[,，、]\s*\d{1,4})*\s*$")
_PASSAGE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_STRIP = ".,;:!?()[]{}<>\"'«»“”|/·•*#-–—_=~"
_PROGRAM = frozenset("=<>{}+%&^;")


def _may_link(text: str) -> bool:
    """False only where `_URL` finds nothing; a plain test, for most texts have no link."""
    return "://" in text or ("." in text and ("www." in text.lower() or ("/" in text and _HOST.search(text) is not None)))


class _Kinds(dict):
    """Printed word to (core, kind, languages of which it is a function word, whether a separator goes with it)."""

    def __missing__(self, word: str) -> tuple[str, str, tuple[str, ...], bool]:
        core = word.strip(_STRIP).casefold()
        sep = word[-1] in ",;|/»·•" or not core
        url = _URL.search(word) if _may_link(word) else None
        if url:
            got = ("", "url", (), sep)
        elif word[0] == "#" and len(word) > 3 and word[1].isalnum():
            got = (core, "tag", (), sep)
        elif not any(map(str.isalnum, core)):
            got = ("", "program" if any(c in _PROGRAM for c in word) else "sign", (), not core)
        elif word[0] == "-" and word.lstrip("-")[:1].isalpha():
            got = ("", "program", (), sep)
        elif any(map(str.isdigit, core)):
            got = (core, "number", (), sep)
        elif core in _OF:
            got = (core, "function", _OF[core], sep)
        elif core in OFFERS:
            got = (core, "offer", (), sep)
        elif ending := _ENDING.match(core):
            got = (ending[1], "inflected", (), sep)
        else:
            got = (core, "content", (), sep)
        if len(self) > 200_000:
            self.clear()
        self[word] = got
        return got


_KINDS = _Kinds()


class _Marks(dict):
    """Printed word to one number: twice its part as a function word, numbers and program signs in millions, other signs in billions."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        kind = _KINDS[word][1]
        self[word] = got = {"function": 2, "inflected": 1, "number": 10**6, "program": 10**6, "sign": 10**9}.get(kind, 0)
        return got


_MARKS = _Marks()


def _cut_words(text: str) -> tuple[Counter, float]:
    """(passages of a text in which words stand between blanks, share of its characters in links)."""
    share = 0.0
    if _may_link(text):
        share = sum(map(len, _URL.findall(text))) / len(text)
        text = _URL.sub(" https://x/ ", text)
    return Counter(map(str.strip, _PASSAGE.findall(text))), share


def _cut_signs(text: str) -> tuple[Counter, float]:
    """`_cut_words` of a Japanese or Chinese text; its units stand between blanks in the passages then."""
    share = 0.0
    if _may_link(text):
        share = sum(map(len, _CJK_URL.findall(text))) / len(text)
        text = _CJK_URL.sub("\0", text)
    # Markup holds no words of the text, but may hold links.
    text = _ELEMENT.sub(lambda m: " " + "\0" * m[0].count("\0"), text) if "<" in text else text
    return Counter(map(str.strip, _PASSAGE.findall(text))), share


def _units(passage: str) -> list[str]:
    """The units of a Japanese or Chinese passage, each after a letter for its kind (`_UNIT_KINDS`)."""
    out = []
    for m in _CJK_UNIT.finditer(passage):
        unit, kind = m[0], m.lastgroup
        if kind == "latin":
            unit = unit.casefold()
            kind = "offer" if unit in OFFERS else "content"
        if kind in ("han", "kana", "other"):
            # What is counted of a content unit are its pairs of signs.
            out += [f"c{unit[i : i + 2]}" for i in range(max(1, len(unit) - 1))]
        else:
            out.append(_UNIT_KINDS.get(kind, "c") + unit)
    return out


_UNIT_KINDS = {"function": "f", "offer": "o", "url": "u", "tag": "t", "number": "n", "separator": "s", "sign": "p"}
_KIND_OF = {"f": "function", "o": "offer", "u": "url", "t": "tag", "n": "number", "s": "sign", "p": "program", "c": "content"}
_UNIT_MARKS = {"f": 2, "n": 10**6, "p": 10**6, "s": 10**9}


def features(text: str | None) -> tuple[str, list[float]] | None:
    """(language, features), or None for texts that are not judged."""
    ascii_ = not text or text.isascii()
    if not ascii_:
        text = unicodedata.normalize("NFKC", text)
    blanks = text.split() if text else []
    # Markup says nothing of a text's script.
    letters = sum(map(len, blanks if ascii_ or "<" not in text else _ELEMENT.sub(" ", text).split()))
    unspaced = not ascii_ and 3 * len(_CJK.findall(text)) > letters
    if letters < 4 * SHORT if unspaced else len(blanks) < SHORT:
        return None
    index = 0
    rest = text
    if "\n" in text:
        lines = text.split("\n")
        listed = [x for x in lines if x.rstrip()[-1:].isdigit() and _INDEX.search(x)]
        if listed:
            index = sum(len(_units(x)) if unspaced else len(x.split()) for x in listed)
            gone = set(listed)
            rest = "\n".join(x for x in lines if x not in gone)
    passages, links = (_cut_signs if unspaced else _cut_words)(rest) if rest else (Counter(), 0.0)
    counts: Counter = Counter()
    n = codes = barren = 0
    function = 0.0
    whole = copied = 0
    kept: list[list[str]] = []
    for passage, times in passages.items():
        words = _units(passage) if unspaced else passage.split()
        m = len(words)
        if not m:
            continue
        mark = sum([_UNIT_MARKS.get(w[0], 0) for w in words] if unspaced else map(_MARKS.__getitem__, words))
        signs, numbers, twice = mark // 10**9, mark // 10**6 % 1000, mark % 10**6
        long = len(passage) > (8 if unspaced else 24)
        if times > 1 and long:
            copied += len(passage) * (times - 1)
            times = 1
        if m > signs and numbers >= CODES * (m - signs):
            codes += m * times
            continue
        n += m * times
        if twice <= 2 * BARREN * m:
            barren += m * times
        elif long and passage[-1] in ".!?。！？":
            whole += m * times
        function += times * twice / 2
        if times == 1:
            kept.append(words)
        else:
            for w in words:
                counts[w] += times
    counts.update(chain.from_iterable(kept))
    by: Counter = Counter()
    cores: Counter = Counter()
    votes: Counter = Counter()
    separators = 0
    for w, c in counts.items():
        if unspaced:
            kind = _KIND_OF[w[0]]
            core, sep = w[1:], kind == "sign"
        else:
            core, kind, langs, sep = _KINDS[w]
            for x in langs:
                votes[x] += c
        by[kind] += c
        separators += c * sep
        if core and kind in ("content", "inflected", "offer", "tag"):
            cores[core] += c
    if unspaced:
        lang = "ja" if re.search("[぀-ヿ]", text) else "zh"
    elif not ascii_ and 3 * len(_HANGUL.findall(text)) > letters:
        lang = "ko"
    else:
        lang = max(sorted(votes), key=votes.__getitem__, default="en")
    total = max(n + index + codes, 1)
    judged = n / total
    content = sum(cores.values())
    coverage = sum(c for _, c in cores.most_common(12) if c >= 3) / max(content, 1)
    entropy = -sum(c / content * math.log(c / content) for c in cores.values()) / math.log(min(content, TYPES)) if content > 1 else 1.0
    # Function words are not missed in lines and passages that are lists of numbers.
    lacking = (n - function) / n if n else 0.0
    return lang, [
        links * judged, separators / total, by["tag"] / total, barren / total, coverage * judged, max(0.0, 1 - entropy) * judged, lacking, 1 - whole / total,
        by["offer"] / total, (by["number"] + by["program"] + by["sign"] + index + codes) / total, copied / len(text),
    ]


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang, x ARRAY<DOUBLE>) of every document that is judged."""
    source = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(k, *f) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (f := features(t))]
            yield pa.record_batch([pa.array([g[0] for g in got], batch.column(0).type), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["k", "lang", "x"])

    return source.mapInArrow(run, f"k {dict(source.dtypes)['k']}, lang string, x array<double>").withColumnRenamed("k", key)


def statistics(x: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and inverse scatter by language and of all ('*'); aggregates of a few rows each, whatever the corpus."""
    d = len(FEATURES)
    both = x.select("lang", "x").unionByName(x.select(F.lit("*").alias("lang"), "x"))
    medians = both.groupBy("lang").agg(F.count("*").alias("n"), *[F.percentile_approx(F.col("x")[i], 0.5, 10_000).alias(f"m{i}") for i in range(d)])
    centre = {r.lang: (r.n, np.array([r[f"m{i}"] for i in range(d)])) for r in medians.collect()}
    if not centre:
        return {}
    sizes = {k: v[0] for k, v in centre.items()}
    # The languages are a fixed handful; their centres go into the plan as literals.
    pick = lambda table, i: F.element_at(F.create_map(*[F.lit(v) for k, c in table.items() for v in (k, float(c[i]))]), F.col("lang"))
    dev = both.select("lang", *[(F.col("x")[i] - pick({k: v[1] for k, v in centre.items()}, i)).alias(f"d{i}") for i in range(d)])
    mads = dev.groupBy("lang").agg(*[F.percentile_approx(F.abs(f"d{i}"), 0.5, 10_000).alias(f"a{i}") for i in range(d)]).collect()
    spread = {r.lang: np.maximum(1.4826 * np.array([r[f"a{i}"] for i in range(d)]), FLOOR) for r in mads}
    near = dev.where(" AND ".join(["true"]))
    for i in range(d):
        near = near.where(F.abs(f"d{i}") <= 3 * pick(spread, i))
    sums = near.groupBy("lang").agg(F.count("*").alias("n"), *[F.avg(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)])
    out = {}
    scatter = {r.lang: np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) for r in sums.collect()}
    for lang, (_, m) in centre.items():
        s = scatter.get(lang, np.zeros((d, d)))
        s = s + np.diag(np.maximum(FLOOR**2 - np.diag(s), 0) + 0.1 * FLOOR**2)
        out[lang] = (m, np.linalg.inv(s))
    return {k: v if sizes[k] >= FEW or k == "*" else out["*"] for k, v in out.items()}


def flagged(x: DataFrame, stats: dict[str, tuple[np.ndarray, np.ndarray]], key: str = "doc_id", far: float = FAR) -> DataFrame:
    """(key, lang, distance, directed, outlier): robust distance, the part of it that points towards spam, and the flag."""
    sent = x.sparkSession.sparkContext.broadcast(stats)
    kind = dict(x.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            langs = batch.column(1).to_pylist()
            v = np.array(batch.column(2).to_pylist(), float).reshape(len(langs), len(FEATURES))
            distance, directed = np.zeros(len(langs)), np.zeros(len(langs))
            for lang in set(langs):
                at = np.array([x == lang for x in langs])
                m, inverse = own.get(lang, own["*"])
                dev = v[at] - m
                distance[at] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", dev, inverse, dev), 0))
                # The deviation's part towards spam: only features that deviate to that side.
                to = np.where(TOWARDS > 0, np.maximum(dev, 0), 0)
                directed[at] = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", to, inverse, to), 0))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(distance), pa.array(directed)], names=[key, "lang", "distance", "directed"])

    return x.select(key, "lang", "x").mapInArrow(run, f"`{key}` {kind}, lang string, distance double, directed double").withColumn("outlier", (F.col("directed") >= far) & (F.col("directed") >= ASIDE * F.col("distance")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = saved(measured(table(spark, sf_dir, "documents")))
    return flagged(x, statistics(x)).where("outlier").select("doc_id").distinct()


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = saved(measured(table(spark, sf_dir, "documents")))
    return flagged(x, statistics(x))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores}
SQL: dict[str, str] = {}
