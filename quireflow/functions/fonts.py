"""Character maps of embedded fonts: destinations beyond the basic plane written as numbers become UTF-16."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

_ROW = re.compile(rb"^[ \t]*<([0-9A-Fa-f]+)>(?:[ \t]+<([0-9A-Fa-f]+)>)?[ \t]+<([0-9A-Fa-f]{5,6})>[ \t]*$")


def utf16_map(data: bytes) -> bytes:
    """`data` with the five- and six-digit destinations of its bfchar and bfrange rows as UTF-16; everything else stays
    byte for byte. A range is written out, as it may cross a border between surrogates. Impossible ranges raise."""
    out, kind = [], None
    for line in data.split(b"\n"):
        word = line.strip().split(b" ")[-1]
        if word in (b"beginbfchar", b"beginbfrange"):
            kind = word
        elif word in (b"endbfchar", b"endbfrange"):
            kind = None
        elif kind and (m := _ROW.match(line)) and (m[2] is not None) == (kind == b"beginbfrange"):
            first, last, value = int(m[1], 16), int(m[2] or m[1], 16), int(m[3], 16)
            if not (first <= last <= 0xFFFF and 0x10000 <= value and value + last - first <= 0x10FFFF):
                raise ValueError("character map range is not Unicode")
            texts = [b"<" + chr(value + k).encode("utf-16-be").hex().encode() + b">" for k in range(last - first + 1)]
            line = b"<" + m[1] + b"> " + (texts[0] if m[2] is None else b"<" + m[2] + b"> [" + b" ".join(texts) + b"]")
        out.append(line)
    return b"\n".join(out)


@F.pandas_udf(BinaryType())
def repaired_map(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else utf16_map(bytes(b)))
