"""Problem 2: repetition inside a single page.

Method: line-first cleaning. The lines of the page's blocks are judged one by one by rules for
punctuation, navigation, boilerplate and repetition; what fails is removed, and a page that loses
too much of its text is rejected. `p2_found` names the rejected pages and nothing else.

The first three rules fail whole lines. The repetition rule cuts a line where a repeated passage
begins or ends and fails the pieces within: five or more consecutive words that began earlier on
the page as well (the earlier occurrence may overlap; words are split at white space, compared
without letter case and without characters other than letters, marks and digits, and words of
nothing else do not count). A page's loss is therefore counted in words, and a line of which only
the end is repeated loses only its end.

Each rule's loss is counted apart. Repetition rejects: a page that loses `LIMIT` of its words or
more to that rule. Lines of navigation, boilerplate and separators leave the text, but a page that
has many of them is short of content, not repetitive, and is kept.

Null and empty contents hold no words; a page without words has share 0 and is kept.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.sources.tables import latest, table

#: Words of a passage; share of lost words from which a page is rejected.
PASSAGE, LIMIT = 5, 1 / 3
#: Words of navigation lines and of boilerplate lines.
NAVIGATION = frozenset("home menu next previous prev back top login logout register sitemap search share print contents index weiter zurück accueil suivant précédent inicio siguiente anterior 다음 이전 처음 목차 次へ 前へ 上一页 下一页".split())
BOILERPLATE = frozenset("cookie cookies copyright javascript subscribe newsletter rights reserved privacy terms impressum datenschutz".split())
TERMINAL = ".!?。！？…:;)”\"'」』"
WORDS_KEPT = 300_000


class Words(dict):
    """Printed word to a number; 0 for one without a letter or digit. Bounded: emptied between pages."""

    def __init__(self) -> None:
        super().__init__()
        self.forms: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        form = "".join(c for c in word.casefold() if c.isalnum() or unicodedata.category(c)[0] == "M")
        got = self.forms.setdefault(form, len(self.forms) + 1) if form else 0
        self[word] = got
        return got


def repeated(words: np.ndarray, page: np.ndarray, size: int = PASSAGE) -> np.ndarray:
    """For words of many pages in order: which lie in a passage that began earlier on the page."""
    out = np.zeros(len(words), bool)
    n = len(words) - size + 1
    if n <= 0:
        return out
    key = page[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(size):
        key = (key ^ words[k : k + n].astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    whole = np.flatnonzero(page[:n] == page[size - 1 :])
    key = key[whole]
    order = np.argsort(key, kind="stable")
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    if len(again):
        # Equal keys are compared word by word with the first of their group: no page is judged by a hash.
        starts = np.maximum.accumulate(np.where(np.r_[True, key[order][1:] != key[order][:-1]], np.arange(len(order)), 0))
        here, first = whole[order[again + 1]], whole[order[starts[again + 1]]]
        same = np.ones(len(here), bool)
        for k in range(size):
            same &= words[here + k] == words[first + k]
        same &= page[here] == page[first]
        here = here[same]
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, here, 1)
        np.add.at(edge, here + size, -1)
        out = np.cumsum(edge[:-1]) > 0
    return out


def line_rules(line: str, words: list[str]) -> tuple[bool, bool, bool]:
    """(punctuation, navigation, boilerplate): which rules the line fails.

    Punctuation: five words or more of Latin script without any closing sign and mostly
    separators. Navigation: all words are navigation words, or links between bars.
    Boilerplate: at least two boilerplate words in a line of at most 12 words.
    """
    low = [w.casefold().strip(".,:;|»«<>·()[]") for w in words]
    bars = sum(1 for w in low if not w)
    navigation = bool(low) and (all(w in NAVIGATION or not w for w in low) or (bars >= 3 and 2 * bars >= len(low)))
    punctuation = len(words) >= 5 and line[-1:] not in TERMINAL and sum(line.count(c) for c in ",|/#•·") >= len(words) - 1
    boilerplate = len(words) <= 12 and sum(w in BOILERPLATE for w in low) >= 2
    return punctuation, navigation, boilerplate


def clean_lines(pages: DataFrame, limit: float = LIMIT, keep_text: bool = True) -> DataFrame:
    """Line-first cleaning of `parsing_res_list`, one row per row of `pages`.

    (page_id, n_words; n_punctuation, n_navigation, n_boilerplate: words of the lines failing each
    rule; n_repeated: words of the pieces failing the repetition rule; lost_share: n_repeated of
    n_words; rejected; text: what is left, null unless `keep_text`).
    """
    contents = F.transform(F.filter("parsing_res_list", lambda b: b["block_content"].isNotNull()), lambda b: b["block_content"])
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.array_join(F.coalesce(contents, F.array().cast("array<string>")), "\n").alias("t"))
    schema = "page_id long, n_words int, n_punctuation int, n_navigation int, n_boilerplate int, n_repeated int, lost_share double, rejected boolean, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                if len(number) > WORDS_KEPT:
                    number = Words()
                lines = [t.split("\n") for t in part.column(1).to_pylist()]
                page_of_line = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
                flat = [x for own in lines for x in own]
                split = [x.split() for x in flat]
                counts = np.fromiter(map(len, split), np.int64, len(split))
                words = np.fromiter((number[w] for own in split for w in own), np.int64, int(counts.sum()))
                line_of = np.repeat(np.arange(len(flat)), counts)
                line_of, words = line_of[words > 0], words[words > 0]
                page_of = page_of_line[line_of]
                rep = repeated(words, page_of)
                per_line = np.bincount(line_of, minlength=len(flat))
                rules = np.array([line_rules(x, w) for x, w in zip(flat, split)], bool).reshape(-1, 3)
                fails = rules.any(1)
                of = lambda mask: np.bincount(page_of_line, weights=per_line * mask, minlength=len(lines)).astype(np.int32)
                total = of(np.ones(len(flat), bool))
                lost = np.bincount(page_of[rep], minlength=len(lines)).astype(np.int32)
                share = lost / np.maximum(total, 1)
                text = None
                if keep_text:
                    cut = np.bincount(line_of[rep], minlength=len(flat)) > 0
                    gone = iter(rep)
                    left: list[list[str]] = [[] for _ in lines]
                    for k, line in enumerate(flat):
                        # Signs between words go with the word before them.
                        went, words_left = False, []
                        if cut[k]:
                            for w in split[k]:
                                went = bool(next(gone)) if number[w] else went
                                words_left += [] if went else [w]
                            line = " ".join(words_left)
                        else:
                            next(islice(gone, per_line[k] - 1, None), None) if per_line[k] else None
                        if not fails[k] and (line or not cut[k]):
                            left[page_of_line[k]].append(line)
                    text = ["\n".join(x) for x in left]
                yield pa.RecordBatch.from_pandas(
                    pd.DataFrame({"page_id": part.column(0).to_pandas(), "n_words": total, "n_punctuation": of(rules[:, 0]), "n_navigation": of(rules[:, 1]), "n_boilerplate": of(rules[:, 2]), "n_repeated": lost, "lost_share": share, "rejected": (share >= limit) & (total > 0), "text": text}),
                    schema=pa.schema([("page_id", pa.int64()), *[(c, pa.int32()) for c in ("n_words", "n_punctuation", "n_navigation", "n_boilerplate", "n_repeated")], ("lost_share", pa.float64()), ("rejected", pa.bool_()), ("text", pa.string())]),
                    preserve_index=False,
                )

    return source.mapInArrow(run, schema)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = clean_lines(table(spark, sf_dir, "layout_pages"), keep_text=False)
    return cleaned.where("rejected AND page_id IS NOT NULL").select("page_id").distinct()


def p2_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(latest(table(spark, sf_dir, "layout_pages").select("page_id", "parsing_res_list", "loaded_at"), "page_id"))


QUERIES = {"p2_found": p2_found, "p2_line_cleaning": p2_line_cleaning}
SQL: dict[str, str] = {}
