"""Problem 1: visually identical text with different characters.

Method: after compatibility normalization and deletion of ignorable characters, the letters
of a token that look like letters of other scripts open a lattice: each position holds every
letter of the same look. Viterbi picks the path with the best character trigram score, where
a letter whose script differs from the letter before it pays a fixed penalty, so the path
keeps to one script unless the corpus says otherwise. The trigrams are counted over all
tokens of the corpus that hold no look-alike of another script, by script.

Katakana and Han signs that print alike are told by the same penalty: the path keeps to the script
around them. Accents stay with their letters, so an accented letter has the looks of its base.

What the form keeps apart: letter case, accents, punctuation, words, and raised, lowered or
circled digits and letters, which compatibility normalization alone would merge.

Null gives null; empty text and text of ignorable characters or white space only give "".
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators.lineage import saved
from quireflow.sources.tables import blocks, table

# Letters that look like a Latin letter, by script, and the Latin letters.
LOOKS = {
    "cyrillic": ("аеѕіјорсухһԁԛԝүѵӏАВЕЅІЈКМНОРСТУХԌԚԜҮѴӀ", "aesijopcyxhdqwyvlABESIJKMHOPCTYXGQWYVI"),
    "greek": ("αονρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹ", "aovpuABEZHIKMNOPTYXcjC"),
    "armenian": ("օոսցհՕՍ", "onughOU"),
    "cherokee": ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTiAJEWMHYGhZbRWSVSLCPKB"),
    "lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "other": ("ɡɑ", "ga"),
}
#: Japanese signs that look like each other, katakana and Han.
KANA_HAN = ("カロニハエタトー", "力口二八工夕卜一")
#: Signs of CJK radicals without a compatibility mapping, and the characters they print as.
RADICALS = ("⺁⺈⺋⺝⺠⻄⻅⻆⻉⻋⻒⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻰", "厂刀卩月民西见角贝车镸长门青韦页风飞食马骨鬼鱼鸟卤麦黄黾齐齿龙")
#: Square unit signs with a raised exponent, which the mapping of the standard would lower.
SQUARES = dict(zip("㎟㎠㎡㎢㎣㎤㎥㎦", ("mm²", "cm²", "m²", "km²", "mm³", "cm³", "m³", "km³")))

IGNORABLE = re.compile(
    "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF))) + "]"
)
CONTROL = re.compile("[\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f]")
KEPT_KINDS = ("<super>", "<sub>", "<circle>", "<fraction>")
TOKEN = re.compile(r"[^\W\d_]+(?:[^\W\d_]|[" + chr(0x300) + "-" + chr(0x36F) + "])*")
#: Cost of a change of script inside a token, and of a trigram never seen (natural logarithms).
SWITCH, UNSEEN = 6.0, 12.0


def _tables() -> tuple[dict[str, str], dict[str, list[str]]]:
    """Script of each look-alike letter; letter to all letters of its look (itself first)."""
    script, same = {}, defaultdict(list)
    for name, (letters, latin) in LOOKS.items():
        for a, b in zip(letters, latin, strict=True):
            script[a] = name
            same[b].append(a)
    look = {}
    for b, group in same.items():
        for x in [b, *group]:
            look[x] = [x, *[y for y in [b, *group] if y != x]]
    for kana, han in zip(*KANA_HAN, strict=True):
        look[kana], look[han] = [kana, han], [han, kana]
    return script, look


SCRIPT, LOOK = _tables()
FOREIGN = frozenset(SCRIPT)
#: Foreign letters and those with an accent that are one character.
TRIGGERS = re.compile("[" + "".join(FOREIGN) + "".join(sorted({c for x in FOREIGN for m in range(0x300, 0x370) if len(c := unicodedata.normalize("NFC", x + chr(m))) == 1})) + "]")
#: A Han sign among katakana, or a kana sign among Han, of those that look alike.
MIXED = re.compile("(?<=[ァ-ヺー])[{1}]|[{1}](?=[ァ-ヺー])|(?<=[㐀-鿿])[{0}](?![ァ-ヺー])|(?<![ァ-ヺー])[{0}](?=[㐀-鿿])".format(*KANA_HAN))
_APART = frozenset(TRIGGERS.pattern[1:-1]) - FOREIGN
RADICAL = str.maketrans({a: b for a, b in zip(*RADICALS, strict=True)})


def script_of(c: str) -> str:
    """latin, cyrillic, greek, armenian, cherokee, lisu, kana, han or other; a letter with accents counts as its base letter."""
    if c in SCRIPT:
        return SCRIPT[c]
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if o >= 0x30A0:
        return "kana" if o < 0x3100 else "han" if 0x3400 <= o < 0xA000 else "other"
    return "cyrillic" if 0x400 <= o < 0x530 else "greek" if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000 else "armenian" if 0x530 <= o < 0x590 else "other"


def _fold(c: str) -> str:
    if c in SQUARES:
        return SQUARES[c]
    kind = unicodedata.decomposition(c)
    return c if kind.startswith(KEPT_KINDS) else unicodedata.normalize("NFKC", c)


class _Folds(dict):
    def __missing__(self, c: str) -> str:
        self[c] = got = _fold(c)
        return got


_FOLDS = _Folds()


def plain(text: str) -> str:
    """Compatibility form without ignorable characters, white space collapsed; scripts untouched."""
    if text.isascii():
        return " ".join(CONTROL.sub("", text).split())
    text = CONTROL.sub("", IGNORABLE.sub("", unicodedata.normalize("NFC", text)))
    text = unicodedata.normalize("NFC", "".join(map(_FOLDS.__getitem__, text)).translate(RADICAL))
    return " ".join(text.replace(chr(0x2010), "-").split())


class Lattice:
    """Viterbi over look-alike lattices. `counts`: (script, trigram) to its count in the corpus.

    Trigrams are over letters in lower case without accents, with `^` before the token.
    """

    def __init__(self, counts: dict[tuple[str, str], int]):
        context: dict[tuple[str, str], int] = defaultdict(int)
        total: dict[str, int] = defaultdict(int)
        for (s, g), n in counts.items():
            context[s, g[:2]] += n
            total[s] += n
        everything = sum(total.values())
        self.cost = {k: -math.log(n / context[k[0], k[1][:2]]) for k, n in counts.items()}
        self.script = {s: -math.log(n / everything) for s, n in total.items()}
        self.rare = max([UNSEEN, *self.script.values()]) + 1
        self.known: dict[str, str] = {}

    def resolve(self, token: str) -> str:
        if token.isascii() or not (TRIGGERS.search(token) or MIXED.search(token)):
            return token
        got = self.known.get(token)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            # Accents stand by themselves in the lattice, so a letter with one has the looks of the letter.
            apart = "".join(unicodedata.normalize("NFD", c) if c in _APART else c for c in token)
            self.known[token] = got = unicodedata.normalize("NFC", self._viterbi(apart))
        return got

    def _viterbi(self, token: str) -> str:
        states: dict[tuple[str, str, str], tuple[float, str]] = {("^", "^", ""): (0.0, "")}
        for c in token:
            if 0x300 <= ord(c) < 0x370:
                # An accent belongs to the letter before it.
                states = {k: (cost, path + c) for k, (cost, path) in states.items()}
                continue
            after: dict[tuple[str, str, str], tuple[float, str]] = {}
            for option in LOOK.get(c, (c,)):
                base, s = base_letter(option), script_of(option)
                for (x, y, before), (cost, path) in states.items():
                    cost += self.cost.get((s, x + y + base), UNSEEN)
                    cost += self.script.get(s, self.rare) if not before else SWITCH if s != before else 0.0
                    key = (y, base, s)
                    # Ties go to the letter that is first in code order, so every machine gives one form.
                    if key not in after or (cost, path + option) < after[key]:
                        after[key] = (cost, path + option)
            states = after
        return min(states.values())[1]


_BASES: dict[str, str] = {}


def base_letter(c: str) -> str:
    got = _BASES.get(c)
    if got is None:
        got = unicodedata.normalize("NFD", c)[0].lower()[:1]
        if len(_BASES) < 100_000:
            _BASES[c] = got
    return got


def form(text: str | None, lattice: Lattice) -> str | None:
    if text is None:
        return None
    text = plain(text)
    return text if text.isascii() else TOKEN.sub(lambda m: lattice.resolve(m[0]), text)


def trigram_counts(texts: DataFrame, column: str) -> DataFrame:
    """(script, gram, n) over all tokens of letters of one alphabetic script.

    The alphabets are Latin, Cyrillic, Greek, Armenian, Cherokee and Lisu without accents and case, so
    there are at most 6 * 90^3 trigrams however large the corpus. Tokens are counted per batch
    before anything is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = defaultdict(int)
        known: dict[str, tuple[str, list[str]] | None] = {}

        def grams(token: str) -> tuple[str, list[str]] | None:
            scripts = {script_of(c) for c in token}
            s = scripts.pop()
            if scripts or s in ("other", "kana", "han") or all(c in FOREIGN for c in token):
                return None
            low = "^^" + "".join(map(base_letter, token))
            return s, [low[i : i + 3] for i in range(len(low) - 2)]

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for token in TOKEN.findall(plain(t)) if t else ():
                    if token not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[token] = grams(token)
                    if got := known[token]:
                        for g in got[1]:
                            counts[got[0], g] += 1
        items = list(counts.items())
        yield pa.record_batch([pa.array([k[0] for k, _ in items], pa.string()), pa.array([k[1] for k, _ in items], pa.string()), pa.array([n for _, n in items], pa.int64())], names=["script", "gram", "n"])

    return texts.select(column).mapInArrow(run, "script string, gram string, n long").groupBy("script", "gram").agg(F.sum("n").alias("n"))


def fit(texts: DataFrame, column: str) -> Lattice:
    return Lattice({(r.script, r.gram): r.n for r in trigram_counts(texts, column).collect()})


def unify(df: DataFrame, column: str, lattice: Lattice, out: str = "form") -> DataFrame:
    """`df` with the one form of `column` in `out`; other columns pass through."""
    sent = df.sparkSession.sparkContext.broadcast(lattice.cost), df.sparkSession.sparkContext.broadcast(lattice.script)

    @F.pandas_udf("string")
    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lattice({})
        own.cost, own.script = sent[0].value, sent[1].value
        own.rare = max([UNSEEN, *own.script.values()]) + 1
        for s in batches:
            yield pd.Series([form(t, own) if isinstance(t, str) else None for t in s], dtype=object)

    return df.withColumn(out, one(F.col(column)))


def _headings_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = blocks(table(spark, sf_dir, "layout_pages"), "block_id", "block_label", "block_content", keep=("page_id", "run_id"))
    heads = heads.where(F.col("block_label").isin("doc_title", "paragraph_title") & F.col("block_content").isNotNull())
    heads = heads.select("run_id", F.lit(None).cast("long").alias("entry_id"), "page_id", "block_id", F.col("block_content").alias("raw"))
    titles = table(spark, sf_dir, "entries").where(F.col("title").isNotNull())
    titles = titles.select("run_id", "entry_id", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("int").alias("block_id"), F.col("title").alias("raw"))
    return titles.unionByName(heads).where(F.col("run_id").isNotNull())


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _headings_and_titles(spark, sf_dir)
    # Forms are made once and saved; what follows reads them four times.
    both = saved(unify(texts, "raw", fit(texts, "raw")).where("form <> ''").distinct())
    # Raw spellings meet before rows do: a run whose thousand equal titles are all spelled alike makes no pairs.
    spell = both.groupBy("run_id", "form", "raw").agg(F.max(F.col("entry_id").isNotNull()).alias("e"), F.max(F.col("page_id").isNotNull()).alias("b"))
    pairs = spell.where("e").select("run_id", "form", F.col("raw").alias("raw_e")).join(spell.where("b").select("run_id", "form", F.col("raw").alias("raw_b")), ["run_id", "form"]).where("raw_e <> raw_b")
    e = both.where("entry_id IS NOT NULL").select("run_id", F.col("raw").alias("raw_e"), "entry_id")
    b = both.where("page_id IS NOT NULL").select("run_id", F.col("raw").alias("raw_b"), "page_id", "block_id")
    return pairs.join(e, ["run_id", "raw_e"]).join(b, ["run_id", "raw_b"]).select("entry_id", "page_id", "block_id")


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and block content in its one form."""
    heads = blocks(table(spark, sf_dir, "layout_pages"), "block_id", "block_content").where("block_content IS NOT NULL")
    texts = heads.select(F.lit("block").alias("kind"), F.col("page_id").alias("record_id"), "block_id", F.col("block_content").alias("raw"))
    titles = table(spark, sf_dir, "entries").where("title IS NOT NULL").select(F.lit("entry").alias("kind"), F.col("entry_id").alias("record_id"), F.lit(0).alias("block_id"), F.col("title").alias("raw"))
    texts = texts.unionByName(titles)
    return unify(texts, "raw", fit(texts, "raw")).select("kind", "record_id", "block_id", "form").distinct()


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
SQL: dict[str, str] = {}
