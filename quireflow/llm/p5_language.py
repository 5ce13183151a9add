"""Problem 5: language of blocks and of their segments, with a confidence value.

Method: rank-order profiles. The most frequent character n-grams (one to three characters,
words padded by blanks) of a language, in order of frequency, are its profile. A segment's own
n-grams are ranked in the same way, and its distance to a language is the sum over them of how
far each is out of place, with a fixed distance for one the profile lacks. The nearest
language wins; the confidence is the relative distance to the second.

Profiles are fitted on labelled segments: at most `SAMPLE_BLOCKS` requested blocks per label
language. As labels are wrong at times, a second fit uses the sample's segments by the
languages the first one gave them. Classification covers every block whole.

Segments are sentences: notation is taken out, broken lines are joined, and text is cut after
closing signs, at blank lines, and at slashes or semicolons set as separators. A whole sentence
has a closing sign and enough letters; other segments are named by language too, but do not
count. Null, empty and blank contents have no segments; ties go to the first language in code
order.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quireflow.llm.p1_lookalikes import plain
from quireflow.sources.tables import blocks, table

LANGS = ("de", "en", "es", "fr", "ja", "ko", "zh")
#: N-grams of a profile and of a segment; labelled blocks per language that profiles are fitted on.
PROFILE, SAMPLE_BLOCKS = 400, 400
#: Letters of a whole sentence: alphabets, Hangul, Han and kana. Alphabets need four plain words too, Hangul two.
LEAST = {"alphabet": 20, "hangul": 10, "han": 6}

_OUT = re.compile(
    r"<!--.*?-->|(?<![A-Za-z0-9_])<[A-Za-z][^<>]*>|</[A-Za-z][^<>]*>|<[a-zB][a-zR]*(?:\s[^<>]*|\s?/)?>|<[^<>\s@]+@[^<>\s]+>|\\(?:cite|label|ref|eqref|includegraphics|url|href)\*?(?:\[[^\]]*\])?\{[^{}]*\}|\\[A-Za-z]+\*?|\{\{[^{}]*\}\}|\$(?=[^$\n]*[\\^_={}])[^$\n]+\$|&#?\w{1,10};|\]\([^()\s]*\)|!\[|https?://\S+|\[\[(?:[^\[\]|]*\|)?|\]\]|[*~`{}\[\]]{1,3}|(?<![A-Za-z0-9])_{1,3}|_{1,3}(?![A-Za-z0-9])|^[>#=|\s]+",
    re.S | re.M,
)
_OUTER = ".,;:!?()\"'«»“”‘’。、，…"
_HARD = chr(0xB6)
_CJK = "぀-ヿ㐀-鿿"
_JOIN = re.compile(f"(?<=[{_CJK}。，、；：])[ \\t]*\\n[ \\t]*(?=[{_CJK}])")
_HYPHEN = re.compile("(?<=[^\\W\\d_])[-" + chr(0xAD) + chr(0xAC) + chr(0x2010) + chr(0x2011) + "][ \\t]*\\n[ \\t]*(?=[^\\W\\d_])")
_CUT = re.compile(f"(?<=[.!?])(?=[\\s\"»”')])|(?<=[。！？])|\\s/\\s|;\\s|{_HARD}")
_END = re.compile("[.!?。！？][\"»”'」』)\\s]*$")
_KANA = re.compile("[" + chr(0x3040) + "-" + chr(0x30FF) + "]")
_HANGUL, _HAN, _LETTER = re.compile("[가-힣]"), re.compile(f"[{_CJK}]"), re.compile(r"[^\W\d_]")


def segments(text: str | None) -> list[tuple[str, bool]]:
    """(segment, whether it is a whole sentence) of a block in order."""
    if not text or text.isspace():
        return []
    text = _OUT.sub(" ", _HYPHEN.sub("", _JOIN.sub("", text)))
    text = plain(re.sub(r"\n[ \t]*\n", f" {_HARD} ", text))
    out = []
    for s in _CUT.split(text):
        s = s.strip(" \"»”')/")
        letters = len(_LETTER.findall(s))
        if letters:
            hangul, han = len(_HANGUL.findall(s)), len(_HAN.findall(s))
            least = LEAST["hangul"] if 2 * hangul >= letters else LEAST["han"] if 2 * han >= letters else LEAST["alphabet"]
            words = sum(1 for w in s.split() if w.strip(_OUTER).replace("-", "").replace("'", "").isalpha())
            out.append((s, bool(_END.search(s)) and letters >= least and words >= (4 if least == LEAST["alphabet"] else 2 if least == LEAST["hangul"] else 0)))
    return out


def _grams(word: str) -> list[str]:
    """N-grams of one to three characters of a padded word; Hangul, Han and kana unpadded."""
    if ord(word[0]) < 0x1100:
        word = f" {word} "
    n = len(word)
    return [g for k in (1, 2, 3) for i in range(n - k + 1) if (g := word[i : i + k]) != " "]


class Profiles:
    """Rank-order profiles of languages; `ranks[lang][gram]` is the place of an n-gram."""

    def __init__(self, counts: dict[str, Counter]):
        self.langs = sorted(counts)
        self.ids: dict[str, int] = {}
        top = {x: [g for g, _ in sorted(counts[x].items(), key=lambda c: (-c[1], c[0]))[:PROFILE]] for x in self.langs}
        for x in self.langs:
            for g in top[x]:
                self.ids.setdefault(g, len(self.ids))
        self.fixed = len(self.ids)
        self.place = np.full((len(self.langs), self.fixed), PROFILE, np.int32)
        for k, x in enumerate(self.langs):
            for r, g in enumerate(top[x]):
                self.place[k, self.ids[g]] = r
        self.words: dict[str, np.ndarray] = {}

    def of_word(self, word: str) -> np.ndarray:
        got = self.words.get(word)
        if got is None:
            got = np.fromiter((self.ids.setdefault(g, len(self.ids)) for g in _grams(word)), np.int64)
            if len(word) <= 40:
                self.words[word] = got
        return got

    def distances(self, texts: list[str]) -> np.ndarray:
        """texts x langs: mean out-of-place distance. Texts without letters are at the largest distance."""
        if len(self.words) > 100_000 or len(self.ids) > 500_000:
            self.words.clear()
            self.ids = dict(list(self.ids.items())[: self.fixed])
        per = [[self.of_word(w) for w in re.findall(r"[^\W\d_]+", t.casefold())] for t in texts]
        sizes = np.array([sum(map(len, p)) for p in per], np.int64)
        out = np.full((len(texts), len(self.langs)), float(PROFILE))
        if not sizes.sum():
            return out
        gram = np.concatenate([a for p in per for a in p])
        key = np.repeat(np.arange(len(texts)), sizes) * (1 << 32) + gram
        key, n = np.unique(key, return_counts=True)
        owner, gram = key >> 32, key & 0xFFFFFFFF
        # Place of each n-gram in its text: by frequency, then by id, which follows the profiles' order.
        order = np.argsort(owner * (1 << 44) + ((1 << 20) - np.minimum(n, (1 << 20) - 1)) * (1 << 24) + np.minimum(gram, (1 << 24) - 1), kind="stable")
        owner, gram = owner[order], gram[order]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
        used = place < PROFILE
        owner, gram, place = owner[used], gram[used], place[used]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        count = np.diff(np.r_[start, len(owner)])
        seen = gram < self.fixed
        for k in range(len(self.langs)):
            far = np.full(len(gram), PROFILE, np.int32)
            own = self.place[k, gram[seen]]
            far[seen] = np.where(own < PROFILE, np.abs(own - place[seen]), PROFILE)
            out[owner[start], k] = np.add.reduceat(far, start) / count
        return out

    def name(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence (0 to 1) of each text; null and 0 without profiles."""
        if not len(texts) or not self.langs:
            return [None] * len(texts), np.zeros(len(texts))
        d = self.distances(texts)
        two = np.sort(d, axis=1)[:, :2] if d.shape[1] > 1 else np.c_[d, np.full(len(d), float(PROFILE))]
        return [self.langs[k] for k in d.argmin(1)], (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-9)


def labelled(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """Requests with `label`, the language their `lang` names; null if none."""
    # The table of spellings is fixed: one row for each spelling of a label.
    names = aliases.select(F.col("alias").alias("_a"), F.col("lang").alias("label")).where("_a IS NOT NULL").dropDuplicates(["_a"])
    return requests.join(F.broadcast(names), F.lower(F.trim(F.col("lang"))) == F.col("_a"), "left").drop("_a")


def believed(label: str, segment: str) -> str | None:
    """The label, unless the segment's script belongs to another language; null where it only rules the label out."""
    letters = len(_LETTER.findall(segment))
    hangul, han = len(_HANGUL.findall(segment)), len(_HAN.findall(segment))
    if 2 * hangul > letters:
        return "ko"
    if 2 * han > letters:
        return "ja" if _KANA.search(segment) else "zh"
    return None if label in ("ja", "ko", "zh") else label


def fit(sample: DataFrame) -> Profiles:
    """Profiles from (label, content) rows; the caller bounds their number."""
    rows = sorted((r.label, s) for r in sample.collect() for s, whole in segments(r.content) if whole)
    profiles = None
    for _ in range(3):
        names = [believed(*x) for x in rows] if profiles is None else profiles.name([s for _, s in rows])[0]
        counts: dict[str, Counter] = defaultdict(Counter)
        for x, (_, s) in zip(names, rows):
            for w in [] if x is None else re.findall(r"[^\W\d_]+", s.casefold()):
                counts[x].update(_grams(w))
        profiles = Profiles(counts)
    return profiles


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, page_id, block_id, label, content) of each request, as often as its page was delivered."""
    r = table(spark, sf_dir, "recognition_requests").select("request_id", "page_id", "block_id", "lang").distinct()
    b = blocks(table(spark, sf_dir, "layout_pages"), "block_id", "block_content").select("page_id", "block_id", F.col("block_content").alias("content")).where("content IS NOT NULL")
    # Pages delivered twice give equal rows here; results name each case once.
    return labelled(r, table(spark, sf_dir, "lang_aliases")).join(b, ["page_id", "block_id"]).select("request_id", "page_id", "block_id", "label", "content")


def profiles_of(spark: SparkSession, sf_dir: str, per_label: int = SAMPLE_BLOCKS) -> Profiles:
    """Profiles from at most `per_label` requested blocks of each label, chosen by a hash of the request."""
    r = labelled(table(spark, sf_dir, "recognition_requests").select("request_id", "page_id", "block_id", "lang").distinct(), table(spark, sf_dir, "lang_aliases"))
    by_hash = Window.partitionBy("label").orderBy(F.xxhash64("request_id"), "request_id")
    some = r.where("label IS NOT NULL").withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= per_label).select("page_id", "block_id", "label")
    # At most len(LANGS) * per_label rows.
    b = blocks(table(spark, sf_dir, "layout_pages"), "block_id", "block_content")
    return fit(b.join(F.broadcast(some), ["page_id", "block_id"]).select("label", F.col("block_content").alias("content")).distinct())


def segment_languages(rows: DataFrame, key: list[str], content: str, profiles: Profiles) -> DataFrame:
    """`key`, seg_no (from 1), segment, whole, lang, confidence: a row for each segment of each row."""
    sent = rows.sparkSession.sparkContext.broadcast((profiles.langs, list(profiles.ids)[: profiles.fixed], profiles.place))
    kept = rows.select(*key, F.col(content).alias("_content"))
    schema = ", ".join(f"`{c}` {t}" for c, t in kept.drop("_content").dtypes) + ", seg_no int, segment string, whole boolean, lang string, confidence double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles({})
        own.langs, grams, own.place = sent.value
        own.ids, own.fixed = {g: i for i, g in enumerate(grams)}, len(grams)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                cut = [segments(t) for t in part.column(len(key)).to_pylist()]
                flat = [s for x in cut for s in x]
                langs, sure = own.name([s for s, _ in flat])
                index = pa.array(np.repeat(np.arange(len(cut)), [len(x) for x in cut]))
                yield pa.record_batch(
                    [
                        *[part.column(k).take(index) for k in range(len(key))],
                        pa.array([k + 1 for x in cut for k in range(len(x))], pa.int32()),
                        pa.array([s for s, _ in flat], pa.string()),
                        pa.array([w for _, w in flat], pa.bool_()),
                        pa.array(langs, pa.string()),
                        pa.array(sure, pa.float64()),
                    ],
                    names=[*key, "seg_no", "segment", "whole", "lang", "confidence"],
                )

    return kept.mapInArrow(run, schema)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = segment_languages(requested(spark, sf_dir), ["request_id", "label"], "content", profiles_of(spark, sf_dir))
    return named.where("whole AND NOT (label <=> lang)").select("request_id", "lang").distinct()


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every requested block with its language and confidence."""
    rows = requested(spark, sf_dir).select("page_id", "block_id", "content").distinct()
    return segment_languages(rows, ["page_id", "block_id"], "content", profiles_of(spark, sf_dir))


def p5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requested block's main language: that of most letters, its confidence weighted by them; null without segments."""
    by = p5_segments(spark, sf_dir).groupBy("page_id", "block_id", "lang").agg(F.sum(F.length("segment")).alias("n"), F.sum(F.col("confidence") * F.length("segment")).alias("c"))
    best = F.max(F.struct("n", "lang", "c"))
    return by.groupBy("page_id", "block_id").agg(best.alias("b"), F.sum("n").alias("all")).select("page_id", "block_id", F.col("b.lang").alias("lang"), (F.col("b.c") / F.col("all")).alias("confidence"))


QUERIES = {"p5_found": p5_found, "p5_segments": p5_segments, "p5_blocks": p5_blocks}
SQL: dict[str, str] = {}
