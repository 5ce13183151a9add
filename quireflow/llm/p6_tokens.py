"""Problem 6: token ids of a public byte-level BPE tokenizer for the whole corpus.

Method: prefix dynamic programming. For a byte string every prefix has exactly one last
token in its BPE encoding, so one array `last[i]` describes the encodings of all prefixes:
`last[i]` is the only token that ends at i and may stand after `last[i - len(token)]`.
Appending bytes therefore never changes what is stored, and an edit needs new entries only
from the edit on, until both arrays agree again.

The pattern of the tokenizer cuts a text before white space that follows other characters,
so words with their leading white space are encoded independently and kept in a bounded
cache per worker; the programming itself runs once per new word.

Null and empty texts give an empty list. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quireflow.sources.tables import table

#: The white space of the Unicode standard, as the tokenizer's pattern sees it.
WHITE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Words kept per worker, and the longest word kept (characters).
CACHE_WORDS, CACHE_LONGEST = 200_000, 64


def tokenizer_dir() -> str:
    """The folder of the vocabulary files: TOKENIZER_DIR or /opt/tokenizers."""
    return os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


class PrefixBpe:
    """Byte-level BPE by prefix dynamic programming over the ranks of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = 1 + max(self.rank.values())
        self.by_bytes = [b""] * self.size
        for b, r in self.rank.items():
            self.by_bytes[r] = b
        self.left, self.right = list(range(self.size)), list(range(self.size))
        self.merged: dict[int, int] = {}
        for b, r in sorted(self.rank.items(), key=lambda x: x[1]):
            if len(b) > 1:
                parts = self._merge_below(b, r)
                if len(parts) == 2:
                    self.left[r], self.right[r] = parts
                    self.merged[parts[0] * self.size + parts[1]] = r
        # Lengths of the tokens by last byte, long ones first: the possible last tokens of a prefix.
        by_last: dict[int, set[int]] = {}
        for b, r in self.rank.items():
            if len(b) == 1 or self.left[r] != r:
                by_last.setdefault(b[-1], set()).add(len(b))
        self.lengths = {k: sorted(v, reverse=True) for k, v in by_last.items()}
        self.longest = max(map(len, self.rank))
        self.fits: dict[int, bool] = {}

    def _merge_below(self, word: bytes, below: int) -> list[int]:
        """The tokens of `word` when only merges of a rank under `below` are made."""
        parts = [bytes([x]) for x in word]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether the encoding of the bytes of a and b is just (a, b).

        Both tokens are taken apart towards the seam, the later merge first; if at any time
        the two tokens at the seam would have been merged earlier, the pair cannot stand.
        """
        key = a * self.size + b
        known = self.fits.get(key)
        if known is None:
            known = self._follows(a, b)
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _follows(self, a: int, b: int) -> bool:
        bound = self.size
        while True:
            if self.merged.get(a * self.size + b, bound) < bound:
                return False
            inner_a, inner_b = self.right[a], self.left[b]
            if a > b and inner_a != a:
                bound, a = a, inner_a
            elif inner_b != b:
                bound, b = b + 1, inner_b
            elif inner_a != a:
                bound, a = a, inner_a
            else:
                return True

    def extend(self, text: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill `last` (last[0] is a mark) up to len(text), or to `stop`; entries that are there are kept."""
        rank, lengths, follows = self.rank, self.lengths, self.follows
        for i in range(len(last), (len(text) if stop is None else stop) + 1):
            for n in lengths[text[i - 1]]:
                if n <= i:
                    t = rank.get(text[i - n : i])
                    if t is not None and (n == i or follows(last[i - n], t)) and (n == 1 or self.left[t] != t):
                        last.append(t)
                        break
        return last

    def backtrack(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i:
            out.append(last[i])
            i -= len(self.by_bytes[last[i]])
        return out[::-1]

    def encode_bytes(self, text: bytes) -> list[int]:
        whole = self.rank.get(text)
        if whole is not None and (len(text) == 1 or self.left[whole] != whole):
            return [whole]
        return self.backtrack(self.extend(text, [-1]))

    def edit(self, text: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """`text` with [start, stop) replaced, and its `last`.

        Computed anew is what follows `start` until as many entries in a row agree with the old ones as the longest
        token has bytes: an entry depends on the bytes of its token and the entries at most that far before it, so all
        that follow agree too and are taken over.
        """
        text = text[:start] + new + text[stop:]
        out, shift, same = last[: start + 1], stop - start - len(new), 0
        for i in range(start + 1, len(text) + 1):
            if same == self.longest:
                return text, out + last[i + shift :]
            self.extend(text, out, i)
            same = same + 1 if i > start + len(new) and out[i] == last[i + shift] else 0
        return text, out


class Encoder(dict):
    """Word (with its leading white space) to token ids; missing words are encoded and kept."""

    def __init__(self, bpe: PrefixBpe, pattern: str):
        import regex

        super().__init__()
        self.bpe, self.find = bpe, regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}

    def piece(self, s: str) -> list[int]:
        got = self.pieces.get(s)
        if got is None:
            got = self.bpe.encode_bytes(s.encode("utf-8", "surrogatepass"))
            if len(s) <= CACHE_LONGEST:
                if len(self.pieces) >= CACHE_WORDS:
                    self.pieces.clear()
                self.pieces[s] = got
        return got

    def __missing__(self, word: str) -> list[int]:
        got = [t for s in self.find(word) for t in self.piece(s)]
        if len(word) <= CACHE_LONGEST:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(map(self.__getitem__, CHUNK.findall(text)))) if text else []

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.__getitem__, CHUNK.findall(text)))) if text else 0


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> Encoder:
    import public_tokenizers

    return Encoder(PrefixBpe(f"{folder or tokenizer_dir()}/{name}.tiktoken"), public_tokenizers.PATTERN)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids) of every row, in one pass without a shuffle. Repeated rows stay repeated."""
    folder = folder or tokenizer_dir()
    source = documents.select(documents[key].alias("k"), documents[text].alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = [np.fromiter(enc.encode(t), np.int32) for t in part.column(1).to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], names=[key, "ids"])

    return source.mapInArrow(run, f"`{key}` {dict(source.dtypes)['k']}, ids array<int>")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
