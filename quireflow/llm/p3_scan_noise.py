"""Problem 3: noise in text from scanned pages.

Running headers, footers and page numbers are told by place, form and recurrence in the run.
Broken and misread words are found by noisy-channel correction: a word as printed is read as
another with the probability of the character confusions between them; candidates are
weighed by their frequency in the corpus and, along the line, by how often words follow one
another, and Viterbi over the candidate words of each line picks the reading.

The probability that a piece of a word is printed as another is estimated where a second reading
of the same lines exists: words that differ between the readings, where the second reading's is a
far more frequent word of the corpus, count as confusions of the pieces in which they differ. The
table below only stands in for `PRIOR` observations of each piece, so it decides where little or
nothing was observed. A confusion that is not in it is added once `KINDS` different words show it.

How far a word may be taken for one is estimated likewise: its count is weighed by the share of its places
that the second reading confirms, and where a word has few such places by the share of all words
seen about as often. Where there is no second reading, a word seen once counts 0.3.

All confusions of a word are searched, however many it has, as long as the most frequent word of
the corpus could still beat the word as it stands; readings beyond that bound cannot be chosen.

Word counts, candidates and their frequencies are tables joined by word, however large the
vocabulary is. Options of frequent words (at least one in `FREQUENT` of all; so there are no more
than `FREQUENT`) are broadcast, so no key of the join is hot. Two tables of fixed size reach every
task: counts of words and word pairs hashed into `PAIR_CELLS` cells, and a bitmap of `BITMAP_CELLS`
cells that keeps words without candidates out of the shuffle; more words make both less
selective, never wrong by omission.

A word is judged if it has Latin letters and at most two of its characters, or a third of them,
are no letters; words with an apostrophe inside are judged part by part. Null and empty texts
have no lines; blank lines count as lines. Repeated rows count once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import ChainMap, defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators.lineage import saved
from quireflow.sources.tables import blocks, table

#: What is meant and what it is printed as.
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("t", "†"), ("s", "5"), ("n", "ri"), ("o", "0"), ("i", "l"), ("i", "!"), ("i", "1"), ("h", "b"), ("l", "i"),
    ("l", "1"), ("l", "!"), ("l", "|"), ("i", "|"), ("d", "cl"), ("u", "ii"), ("m", "rn"), ("rn", "m"), ("g", "9"), ("b", "6"), ("v", "y"), ("w", "vv"), ("li", "h"), ("q", "g"), ("z", "2"),
)
#: Probability of a confusion of the table, observations it stands for, different words that show a new one, and how many times more frequent the meant word is.
LIKELY, PRIOR, KINDS, TIMES = 0.03, 100.0, 3, 20
#: Cost of odd characters in a word read as it is; weight of the words' own frequencies in that of pairs.
ODD, BACK_OFF = 3.0, 5.0
#: Places that the share of all words seen about as often stands for.
DOUBT = 2.0
PAIR_CELLS, BITMAP_CELLS, FREQUENT = 1 << 18, 1 << 20, 10_000
HYPHENS = "-" + chr(0xAC) + chr(0xAD) + chr(0x2010) + chr(0x2011)
SOFT = chr(0xAC) + chr(0xAD)

_OUTER = ".,;:?()[]{}\"'«»“”„‘’…—–" + chr(0)
_JUDGED = re.compile("^(?=.*[a-zß-öø-ÿœ])[a-zß-öø-ÿœ0-9!†|-]+$")
_ODD = re.compile("[0-9!†|]")
_BROKEN = re.compile(f"(\\S+)[{HYPHENS}][ \\t]*$")
GLUE = chr(0)
_PIECE = re.compile("[^\\s'’]+['’]*|['’]+")
#: (printed, meant) to its probability, where nothing was observed.
Channel = dict[str, list[tuple[str, float]]]


def prior_channel() -> Channel:
    out: Channel = defaultdict(list)
    for meant, printed in CONFUSIONS:
        out[printed].append((meant, LIKELY))
    return dict(out)


def core(token: str) -> str:
    """Lower case without outer punctuation; an exclamation mark at the end of a plain word is punctuation too."""
    t = token.strip(_OUTER).lower()
    return t[:-1] if t[-1:] == "!" and not _ODD.search(t[:-1]) and len(t) > 3 else t


def judged(word: str) -> bool:
    return len(word) > 1 and bool(_JUDGED.match(word)) and len(_ODD.findall(word)) <= max(2, len(word) // 3)


def readings(word: str, channel: Channel, least: float) -> list[tuple[str, float, str]]:
    """(meant word, log probability that it is printed as `word`, places of the confusions, comma separated), itself
    first; all whose probability is `least` or more."""
    out = {word: (0.0, "")}
    todo = [(0, "", 1.0, "")]
    spots = {i: [(printed, meant, p) for printed, own in channel.items() if word.startswith(printed, i) for meant, p in own] for i in range(len(word))}
    while todo:
        at, before, p, places = todo.pop()
        for i in range(at, len(word)):
            for printed, meant, q in spots[i]:
                if p * q >= least:
                    head = before + word[at:i] + meant
                    w, where = head + word[i + len(printed) :], f"{places},{i}" if places else str(i)
                    if w not in out or out[w][0] < math.log(p * q) and w != word:
                        out[w] = (math.log(p * q), where)
                    todo.append((i + len(printed), head, p * q, where))
    return [(w, p, at) for w, (p, at) in out.items() if not at or not _ODD.search(w)]


def pieces(line: str) -> list[str]:
    """Words of a line; of a word with an apostrophe inside its parts, those after the first with `GLUE` before them."""
    if "'" not in line and "’" not in line:
        return line.split()
    out = []
    for token in line.split():
        first, *rest = _PIECE.findall(token) or [token]
        out += [first, *[GLUE + x for x in rest]]
    return out


def line_tokens(text: str) -> list[list[str]]:
    return [[core(t) for t in pieces(line)] for line in text.split("\n")]


def breaks(text: str) -> list[tuple[int, str, str, str, bool]]:
    """(line from 1, left part, right part, hyphen, whether the line may be judged) of each line that ends in a hyphen."""
    lines = text.split("\n")
    out = []
    for k, (a, b) in enumerate(zip(lines, lines[1:])):
        m = _BROKEN.search(a)
        if m and b.strip():
            hyphen = a.rstrip()[-1]
            left, right = pieces(m[1])[-1].lstrip(_OUTER).lower(), pieces(b)[0].rstrip(_OUTER).lower()
            if left and right and any(c.isalpha() for c in left) and right[0].isalpha() or (left and right and judged(left[-1:] + right) and not left.isdigit()):
                out.append((k + 1, left, right, hyphen))
    return out


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n, asked) of `t`: counts of the words within lines; `asked` if a line end asks for the word or compound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = defaultdict(int)
            asked: set[str] = set()
            for t in batch.column(0).to_pylist():
                lines, ends = line_tokens(t), {x[0]: x for x in breaks(t)}
                for k, words in enumerate(lines):
                    lo, hi = 1 if k in ends else 0, len(words) - 1 if k + 1 in ends else len(words)
                    for w in words[lo:hi]:
                        if judged(w):
                            counts[w] += 1
                for _, left, right, _ in ends.values():
                    for w in (left + right, f"{left}-{right}"):
                        if judged(w):
                            counts[w] += 0
                            asked.add(w)
            yield _rows({"word": (list(counts), pa.string()), "n": (list(counts.values()), pa.int64()), "asked": ([w in asked for w in counts], pa.bool_())})

    return texts.select("t").mapInArrow(run, "word string, n long, asked boolean").groupBy("word").agg(F.sum("n").alias("n"), F.bool_or("asked").alias("asked"))


def pair_counts(texts: DataFrame) -> np.ndarray:
    """Counts of words (first row) and of neighbouring words of a line (two rows by different hashes), in PAIR_CELLS cells each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(3 * PAIR_CELLS, np.int64)
        known: dict[str, int] = {}
        for batch in batches:
            words: list[int] = []
            for t in batch.column(0).to_pylist():
                for line in line_tokens(t):
                    for w in line:
                        if w not in known:
                            known[w] = word_hash(w)
                    words += [known[w] for w in line]
                    words.append(-1)
            w = np.array(words, np.int64)
            if len(w) > 1:
                a, b = w[:-1], w[1:]
                inside = (a >= 0) & (b >= 0)
                counts[:PAIR_CELLS] += np.bincount(w[w >= 0] % PAIR_CELLS, minlength=PAIR_CELLS)
                for k in (0, 1):
                    at = (k + 1) * PAIR_CELLS
                    counts[at : at + PAIR_CELLS] += np.bincount(pair_cell(a[inside], b[inside], k), minlength=PAIR_CELLS)
            if len(known) > 200_000:
                known.clear()
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["cell", "n"])

    # At most 3 * PAIR_CELLS rows.
    got = texts.select("t").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(3 * PAIR_CELLS, np.float32)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(3, PAIR_CELLS)


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def pair_cell(a, b, k: int):
    """Cell of a pair of words, from their hashes, in row k of the pairs."""
    return ((a * (0x9E3779B1, 0xC2B2AE3D)[k] & 0xFFFFFFFF) + (b * (0x85EBCA77, 0x27D4EB2F)[k] & 0xFFFFFFFF) >> (7, 9)[k]) % PAIR_CELLS


def weighed(counts: DataFrame, both: DataFrame | None = None) -> DataFrame:
    """`counts` with `own`, how many times the word was meant. `both`: (printed, meant, n) of two readings."""
    plain = F.when(F.col("n") > 0, F.greatest(F.col("n") - 0.7, F.lit(0.3))).otherwise(0.0)
    if both is None:
        return counts.withColumn("own", plain)
    same = F.sum(F.when(F.col("printed") == F.col("meant"), F.col("n")).otherwise(0)).alias("same")
    c = saved(counts.join(both.groupBy(F.col("printed").alias("word")).agg(same, F.sum("n").alias("seen")), "word", "left").na.fill(0, ["same", "seen"]).withColumn("about", F.floor(F.log2(F.greatest("n", F.lit(1))))))
    # One share for each power of two up to the most frequent word's count.
    shares = {r.about: (r.same + 0.1 * DOUBT) / (r.seen + DOUBT) for r in c.where("seen > 0").groupBy("about").agg(F.sum("same").alias("same"), F.sum("seen").alias("seen")).collect()}
    share = F.lit(0.3)
    for about, x in shares.items():
        share = F.when(F.col("about") == about, x).otherwise(share)
    own = F.col("n") * (F.col("same") + DOUBT * share) / (F.col("seen") + DOUBT)
    return c.select(*counts.columns, F.when(F.col("n") > 0, own).otherwise(0.0).alias("own"))


def two_readings(texts: DataFrame, other: str) -> DataFrame:
    """(printed, meant, n): words of `t` and what `other`, an array of lines of a second reading, has in their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = defaultdict(int)
            for t, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                theirs = [pieces(x) for x in lines or () if x]
                at = 0
                for line in t.split("\n"):
                    ours = pieces(line)
                    # The second reading lacks lines but keeps their order: the first line of as many words that shares most of them.
                    for k in range(at, len(theirs)):
                        if len(theirs[k]) == len(ours) and 2 * sum(a == b for a, b in zip(ours, theirs[k])) > len(ours):
                            at = k + 1
                            for a, b in zip(ours, theirs[k]):
                                a, b = core(a), core(b)
                                if judged(a) and judged(b):
                                    found[a, b] += 1
                            break
            yield _rows({"printed": ([a for a, _ in found], pa.string()), "meant": ([b for _, b in found], pa.string()), "n": (list(found.values()), pa.int64())})

    return texts.where(F.col(other).isNotNull()).select("t", other).mapInArrow(run, "printed string, meant string, n long").groupBy("printed", "meant").agg(F.sum("n").alias("n"))


def observed(both: DataFrame, counts: DataFrame) -> Channel:
    """The channel that two readings show: what differs between a word and a far more frequent one in its place."""
    known = counts.select("word", F.col("n").alias("c"))
    both = both.where("printed <> meant").join(known.withColumnsRenamed({"word": "printed", "c": "n_printed"}), "printed")
    both = both.join(known.withColumnsRenamed({"word": "meant", "c": "n_meant"}), "meant").where(F.col("n_meant") > TIMES * F.col("n_printed"))

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
            for a, b, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                size = min(len(a), len(b))
                head = next((i for i in range(size) if a[i] != b[i]), size)
                tail = next((i for i in range(size - head) if a[-1 - i] != b[-1 - i]), size - head)
                printed, meant = a[head : len(a) - tail], b[head : len(b) - tail]
                if 0 < len(printed) <= 2 and 0 < len(meant) <= 2:
                    found[printed, meant][0] += n
                    found[printed, meant][1] += 1
            yield _rows({"printed": ([a for a, _ in found], pa.string()), "meant": ([b for _, b in found], pa.string()), "n": ([x for x, _ in found.values()], pa.int64()), "words": ([x for _, x in found.values()], pa.int64())})

    # Pairs of pieces of at most two characters of an alphabet.
    seen = {(r.printed, r.meant): (r.n, r.words) for r in both.select("printed", "meant", "n").mapInArrow(differ, "printed string, meant string, n long, words long").groupBy("printed", "meant").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()}
    wanted = {(b, a): seen.get((b, a), (0, 0))[0] for a, b in CONFUSIONS} | {k: n for k, (n, words) in seen.items() if words >= KINDS}
    # How often each piece was meant: its places in the words of the corpus.
    meant = sorted({m for _, m in wanted})
    places = [F.sum(F.col("n") * (F.length("word") - F.length(F.replace("word", F.lit(m), F.lit("")))) / len(m)).alias(f"m{k}") for k, m in enumerate(meant)]
    times = dict(zip(meant, counts.agg(*places).first()))
    prior = {(b, a) for a, b in CONFUSIONS}
    out: Channel = defaultdict(list)
    for (printed, m), n in sorted(wanted.items()):
        p = (n + PRIOR * LIKELY * ((printed, m) in prior)) / ((times[m] or 0) + PRIOR)
        out[printed].append((m, min(p, 0.5)))
    return dict(out)


def channel(counts: DataFrame, confusions: Channel) -> DataFrame:
    """(word, n, own, options): for each word that may be meant as another or is asked for at a line end, its weight as it
    stands and its readings found in the corpus as (score, cand, edits, places), most probable first."""
    most = counts.agg(F.max("own")).first()[0] or 1.0
    odd = math.exp(-ODD)
    counts = counts.withColumn("own", F.col("own") * F.when(F.col("word").rlike("[0-9!†|]"), odd).otherwise(1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)))
            # No reading of less probability than this beats the word as it stands, even if it is the most frequent word.
            got = [(w, n, own, *r) for w, n, own, at_end in rows for r in readings(w, confusions, (own if n else 1e-6 * most) / most) if r[2] or at_end]
            yield _rows({"word": ([x[0] for x in got], pa.string()), "n": ([x[1] for x in got], pa.int64()), "own": ([x[2] for x in got], pa.float64()), "cand": ([x[3] for x in got], pa.string()), "p": ([x[4] for x in got], pa.float64()), "places": ([x[5] for x in got], pa.string())})

    asked = counts.select("word", "n", "own", "asked").mapInArrow(run, "word string, n long, own double, cand string, p double, places string")
    known = counts.where("own > 0").select(F.col("word").alias("cand"), F.col("own").alias("n_cand"))
    found = asked.join(known, "cand").where((F.col("places") == "") | (F.col("n") == 0) | (F.col("n_cand") * F.exp("p") > F.col("own")))
    score = F.log("n_cand") + F.col("p")
    edits = F.when(F.col("places") == "", 0).otherwise(F.size(F.split("places", ",")))
    # A word has no more options than it has readings.
    options = F.sort_array(F.collect_list(F.struct(score.alias("score"), "cand", edits.alias("edits"), "places")), asc=False)
    return found.groupBy("word").agg(F.max("n").alias("n"), F.max("own").alias("own"), options.alias("options"))


def _asked_words(text: str) -> set[str]:
    out = {w for words in line_tokens(text) for w in words if judged(w)}
    for _, left, right, _ in breaks(text):
        out |= {left + right, f"{left}-{right}"}
    return out


class Pairs:
    """Hashed counts of words and word pairs, as `pair_counts` gives them. What a cell holds by chance is taken off."""

    def __init__(self, counts: np.ndarray):
        self.words, self.first, self.second = counts
        self.total = max(float(self.words.sum()), 1.0)
        self.chance, self.chance_pairs = self.total / PAIR_CELLS, float(self.first.sum()) / PAIR_CELLS

    def follows(self, a: int, b: int, printed: bool) -> float:
        """Log of how much more often than by themselves the words of two hashes stand one after the other, backed off to
        their own frequencies. A pair that stands as printed has been counted here; that once is taken off."""
        n_a, n_b = (max(float(self.words[x % PAIR_CELLS]) - self.chance, 1.0) for x in (a, b))
        both = min(float(self.first[pair_cell(a, b, 0)]), float(self.second[pair_cell(a, b, 1)])) - self.chance_pairs
        both = max(min(both, n_a, n_b) - printed, 0.0)
        return math.log((both * self.total / n_b + BACK_OFF) / (n_a + BACK_OFF))


def _decode(words: list[str], options: Mapping[str, tuple[float, list]], pairs: Pairs) -> list[tuple[str, int, str]]:
    """Viterbi over the candidate words of one line: (word, edits, places) at each position."""
    if not any(w in options for w in words):
        return [(w, 0, "") for w in words]
    # State: score, hash of its word, whether that is the word as printed, place of the state before, (word, edits, places).
    states: list[list[tuple]] = []
    for w in words:
        own = options.get(w)
        choices = [(0.0, w, 0, "")]
        if own and own[0]:
            choices = [(math.log(own[0]), w, 0, ""), *[(o["score"], o["cand"], o["edits"], o["places"]) for o in own[1] if o["edits"]]]
        after = []
        for score, cand, edits, places in choices:
            here = word_hash(cand)
            best, back = 0.0, -1
            if states:
                before = states[-1]
                if len(before) == 1 and len(choices) == 1:
                    best, back = before[0][0], 0
                else:
                    best, back = max(((x[0] + pairs.follows(x[1], here, x[2] and not edits), -k) for k, x in enumerate(before)))
                    back = -back
            after.append((best + score, here, not edits, back, (cand, edits, places)))
        states.append(after)
    out, at = [], max(range(len(states[-1])), key=lambda k: (states[-1][k][0], -k))
    for own in reversed(states):
        out.append(own[at][4])
        at = own[at][3]
    return out[::-1]


def _judge_break(left: str, right: str, hyphen: str, options: Mapping[str, tuple[float, list]]) -> tuple[bool, str, str]:
    """(whether one word is broken, the whole word, places of misread characters in left + right)."""
    whole, compound = options.get(left + right), options.get(f"{left}-{right}")
    best = lambda own: max((o["score"] for o in own[1]), default=-1e9) if own else -1e9
    n_whole, n_compound = best(whole), best(compound)
    if n_compound > n_whole and hyphen not in SOFT:
        return False, f"{left}-{right}", ""
    if whole and whole[1]:
        return True, whole[1][0]["cand"], whole[1][0]["places"]
    return hyphen in SOFT or (not _ODD.search(left + right) and "-" not in left and len(left) > 1), left + right, ""


def correct(texts: DataFrame, key: str = "decision_id", text: str = "original", other: str | None = None) -> DataFrame:
    """(key, hyphens ARRAY<INT>, misread ARRAY<INT>, paragraph): line numbers of broken and of misread words, and
    the lines joined into one paragraph with the words as read. `key` must be unique but for equal repeated rows;
    `other` names an array of lines of a second reading, from which the confusions are estimated."""
    spark = texts.sparkSession
    source = texts.select(F.col(key).alias("k"), F.col(text).alias("t"), *([F.col(other).alias("o")] if other else [])).where("k IS NOT NULL AND t IS NOT NULL AND t <> ''")
    source = saved(source.distinct())
    latin = source.where(F.col("t").rlike("[A-Za-z]"))
    counts = saved(word_counts(latin))
    both = saved(two_readings(latin, "o")) if other else None
    options = saved(channel(saved(weighed(counts, both)), observed(both, counts) if other else prior_channel()))
    # Each of these words is a FREQUENT-th of all words or more, so there are no more than FREQUENT of them.
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = {r.word: (r.own, r.options) for r in options.where(F.col("n") * FREQUENT >= total).collect()} if total else {}
    rare = options.where(F.col("n") * FREQUENT < total)
    cells = rare.select((F.crc32("word") % BITMAP_CELLS).cast("int").alias("c")).distinct().toArrow()["c"].to_numpy()
    bits = np.zeros(BITMAP_CELLS, bool)
    bits[cells] = True
    sent = spark.sparkContext.broadcast((np.packbits(bits), pair_counts(latin), hot))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent = np.unpackbits(sent.value[0]), sent.value[2]
        for batch in batches:
            got = [(k, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in _asked_words(t) if w not in frequent and own[zlib.crc32(w.encode("utf-8", "surrogatepass")) % BITMAP_CELLS]]
            yield pa.record_batch([pa.array([k for k, _ in got], batch.column(0).type), pa.array([w for _, w in got], pa.string())], names=["k", "word"])

    kind = dict(source.dtypes)["k"]
    asked = latin.select("k", "t").mapInArrow(asks, f"k {kind}, word string").join(rare, "word")
    per = asked.groupBy("k").agg(F.collect_list(F.struct("word", "own", "options")).alias("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, frequent = Pairs(sent.value[1]), sent.value[2]
        for batch in batches:
            hyphens, misread, out = [], [], []
            for t, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                h, m, p = read_lines(t, ChainMap({x["word"]: (x["own"], x["options"]) for x in o or ()}, frequent), pairs)
                hyphens.append(h)
                misread.append(m)
                out.append(p)
            yield pa.record_batch([batch.column(0), pa.array(hyphens, pa.list_(pa.int32())), pa.array(misread, pa.list_(pa.int32())), pa.array(out, pa.string())], names=[key, "hyphens", "misread", "paragraph"])

    return source.select("k", "t").join(per, "k", "left").select("k", "t", "o").mapInArrow(run, f"`{key}` {kind}, hyphens array<int>, misread array<int>, paragraph string")


def read_lines(text: str, options: Mapping[str, tuple[float, list]], pairs: Pairs) -> tuple[list[int], list[int], str]:
    lines = text.split("\n")
    ends = {x[0]: x for x in breaks(text)}
    hyphens, misread = [], set()
    printed = [pieces(line) for line in lines]
    for k, words in enumerate(printed):
        inner = words[1 if k in ends else 0 : len(words) - 1 if k + 1 in ends else len(words)]
        start = 1 if k in ends else 0
        for j, (w, edits, _) in enumerate(_decode([core(x) for x in inner], options, pairs)):
            if edits:
                misread.add(k + 1)
                words[start + j] = _like(inner[j], w)
    for k, left, right, hyphen in ends.values():
        broken, whole, places = _judge_break(left, right, hyphen, options)
        for at in map(int, filter(None, places.split(","))):
            misread.add(k if at < len(left) else k + 1)
        if broken:
            hyphens.append(k)
    return hyphens, sorted(misread), _paragraph(printed, ends, set(hyphens))


def _like(token: str, word: str) -> str:
    """`word` in the outer punctuation and the case of `token`."""
    bare = core(token)
    at = token.lower().find(bare)
    inner = token[at : at + len(bare)]
    return token[:at] + (word.upper() if inner.isupper() and len(inner) > 1 and inner.isalpha() else word[:1].upper() + word[1:] if inner[:1].isupper() and token[at : at + 1] != "I" else word) + token[at + len(bare) :]


def _paragraph(printed: list[list[str]], ends: dict[int, tuple], hyphens: set[int]) -> str:
    out = ""
    for k, words in enumerate(printed):
        line = " ".join(words).replace(f" {GLUE}", "")
        if k in hyphens:
            out = out.rstrip(HYPHENS) + line
        elif k in ends or re.search(f"[0-9][{HYPHENS}]$", out) and line[:1].isdigit():
            out += line
        elif out and line and ord(out[-1]) >= 0x3000 and ord(line[0]) >= 0x3040 and not 0xAC00 <= ord(line[0]) < 0xD7A4:
            out += line
        else:
            out = f"{out} {line}" if out and line else out + line
    return out


# Running headers, footers and page numbers.

_NUM = "(?:[0-9OoIl!SB]{1,4}|[ivxlcdm]{1,7})"
PAGE_NUMBER = f"^\\s*(?:[-–—~\\[(|]\\s*)*(?:(?:[Pp]a[gq9]e|[Ss]eite|[Pp][áa][gq9]ina|p\\.)\\s*)?{_NUM}(?:\\s*(?:/|of|von|de|sur)\\s*{_NUM})?(?:\\s*[-–—~\\])|])*\\s*$"
TITLE_NUMBER = f"^.{{2,}}\\s[|·•]\\s*{_NUM}\\s*$"


def furniture(pages: DataFrame) -> DataFrame:
    """(page_id, block_id) of running headers, footers and page numbers, whatever their label.

    A single line in the top 7 or the bottom 6 hundredths of the page is furniture if it is a page
    number, a title with a number, the top line without a sentence's end, or a text that recurs there
    on other pages of the run. A page without a height takes the largest of its run; a block without
    a usable box is judged if it is the first or last of its page, by form or as a text that recurs at
    the edges of the run's pages and stood there before.
    """
    number_of = F.col("page") if "page" in pages.columns else F.col("page_id")
    p = pages.select("page_id", "run_id", number_of.alias("_page"), F.expr("CASE WHEN height > 0 THEN height END").alias("height"), "parsing_res_list")
    tall = p.groupBy("run_id").agg(F.max("height").alias("_tall"))
    b = blocks(p.withColumn("_n", F.size("parsing_res_list")), "block_id", "block_content", "block_bbox", keep=("page_id", "run_id", "_page", "height", "_n"))
    text = F.trim(F.coalesce("block_content", F.lit("")))
    ys = F.expr("transform(filter(block_bbox, (v, i) -> i % 2 = 1 AND size(block_bbox) >= 4), v -> v)")
    b = b.select("page_id", "run_id", "_page", "block_id", "height", "_n", "ord", text.alias("t"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    b = b.where("t <> '' AND NOT contains(t, '\n') AND (y0 IS NULL OR height IS NULL OR y1 < 0.07 * height OR y0 > 0.94 * height)")
    b = b.join(tall, "run_id", "left").withColumn("h", F.coalesce("height", "_tall"))
    top, bottom = F.col("y1") < 0.07 * F.col("h"), F.col("y0") > 0.94 * F.col("h")
    loose = (F.col("y0").isNull() | F.col("h").isNull()) & ((F.col("ord") == 1) | (F.col("ord") == F.col("_n")))
    number = F.col("t").rlike(PAGE_NUMBER) | F.col("t").rlike(TITLE_NUMBER)
    key = F.lower(F.regexp_replace(F.regexp_replace("t", "[0-9]+", ""), "[\\s|·~\\[\\]—–-]+", " "))
    e = b.withColumn("top", F.coalesce(top, F.lit(False))).withColumn("bottom", F.coalesce(bottom, F.lit(False))).where(F.col("top") | F.col("bottom") | loose)
    e = e.withColumn("number", number).withColumn("key", F.trim(key)).withColumn("plain_top", F.col("top") & ~F.col("t").rlike("[.!?。！？]\\s*$"))
    sure = e.where("(top OR bottom) AND number OR plain_top OR number AND NOT (top OR bottom)").select("page_id", "block_id")
    rest = e.where("NOT number AND key <> '' AND ((top OR bottom) AND NOT plain_top OR NOT (top OR bottom))")
    often = e.where("(top OR bottom) AND NOT number AND key <> ''").groupBy("run_id", "key").agg(F.countDistinct("page_id").alias("n"), F.min("_page").alias("_first")).where("n >= 2")
    # A heading stands where its text is not yet a running header: a block without a place must come after one.
    return sure.union(rest.join(often, ["run_id", "key"]).where("top OR bottom OR _page > _first").select("page_id", "block_id")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = furniture(table(spark, sf_dir, "layout_pages")).select(F.lit("furniture").alias("kind"), F.col("page_id").alias("record_id"), F.col("block_id").alias("item_no"))
    c = correct(table(spark, sf_dir, "decisions"), other="candidate")
    item: Column = F.explode(F.array(F.struct(F.lit("hyphen").alias("kind"), F.col("hyphens").alias("n")), F.struct(F.lit("misread").alias("kind"), F.col("misread").alias("n")))).alias("_x")
    c = c.select(F.col("decision_id").alias("record_id"), item).select(F.col("_x.kind").alias("kind"), "record_id", F.explode("_x.n").alias("item_no"))
    return f.unionByName(c)


def p3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous paragraphs: of `decisions.original` (kind decision, item_no 0) and of the `block_content` of every block
    that is no running header, footer or page number (kind block, record_id its page, item_no its block)."""
    pages = table(spark, sf_dir, "layout_pages")
    d = table(spark, sf_dir, "decisions").select(F.concat(F.lit("d:"), "decision_id").alias("k"), F.col("original").alias("t"), F.col("candidate").alias("o"))
    b = blocks(pages, "block_id", "block_content").join(furniture(pages), ["page_id", "block_id"], "left_anti")
    b = b.select(F.concat(F.lit("b:"), "page_id", F.lit(":"), "block_id").alias("k"), F.col("block_content").alias("t"), F.lit(None).cast("array<string>").alias("o"))
    c = correct(d.unionByName(b), "k", "t", "o").withColumn("_k", F.split("k", ":"))
    return c.select(F.when(F.col("_k")[0] == "d", "decision").otherwise("block").alias("kind"), F.col("_k")[1].cast("long").alias("record_id"), F.coalesce(F.get("_k", F.lit(2)).cast("int"), F.lit(0)).alias("item_no"), "paragraph", F.size("hyphens").alias("n_hyphens"), F.size("misread").alias("n_misread_lines"))


QUERIES = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs}
SQL: dict[str, str] = {}
