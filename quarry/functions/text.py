"""Text normalisation, tokens and weights."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Digits and units of Chinese numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
SCALES = {"十": 10, "百": 100, "千": 1000, "万": 10000}
#: Punctuation that has an ASCII form beyond what NFKC gives.
PUNCTUATION = str.maketrans({"。": ".", "、": ",", "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-", "《": "<", "》": ">", "【": "[", "】": "]", "「": '"', "」": '"', "～": "~", "－": "-"})
#: How a line without styles shows that it is a heading, by level.
HEADINGS = {1: "^(?:[一二三四五六七八九十]+、|第[一二三四五六七八九十]+章)", 2: "^(?:（[一二三四五六七八九十]+）|第[一二三四五六七八九十]+条)"}
_UNITS = "[" + "".join(DIGITS) + "]"
_SIGN = "[" + "".join(DIGITS) + "".join(SCALES) + "]"
#: Digits in a row, or up to four places with their units; zeros may stand where a place is left out.
_ROW = re.compile(f"{_UNITS}+")
_PLACES = re.compile(f"零*(?:({_UNITS})?(千))?零*(?:({_UNITS})?(百))?零*(?:({_UNITS})?(十))?零*({_UNITS})?零*")
_DATE = re.compile(r"(\d{4})\s*年\s*(\d{1,2})\s*月(?:\s*(\d{1,2})\s*[日号])?")
_SLASHED = re.compile(r"(?<!\d)(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?![\d.])")
_WORD = re.compile(r"[a-z0-9]+(?:[.\-/][a-z0-9]+)*|[㐀-鿿]+", re.IGNORECASE)


def numeral(text: str) -> int | None:
    """A Chinese numeral below a hundred million; None if it is not well formed."""
    if _ROW.fullmatch(text or ""):
        return int("".join(str(DIGITS[c]) for c in text))
    upper, myriad, lower = (text or "").partition("万")
    values = []
    for part in (upper, lower):
        m = _PLACES.fullmatch(part)
        if not m:
            return None
        *places, ones = m.groups()
        # a unit without a digit before it counts once
        value = sum(DIGITS[digit or "一"] * SCALES[unit] for digit, unit in zip(places[::2], places[1::2], strict=True) if unit)
        values.append(value + DIGITS.get(ones, 0))
    if not upper and (myriad or not lower):
        return None
    return values[0] * 10_000 + values[1] if myriad else values[0]


def _numbers(text: str) -> str:
    """Well-formed numerals of two or more signs, and all of a percentage, as digits; others stay."""
    text = re.sub(f"百分之({_SIGN}+)", lambda m: m[0] if numeral(m[1]) is None else f"{numeral(m[1])}%", text)
    return re.sub(f"{_SIGN}{{2,}}", lambda m: m[0] if numeral(m[0]) is None else str(numeral(m[0])), text)


def normal(text: str | None) -> str:
    """NFKC, ASCII punctuation, ISO dates, numerals as digits, single spaces, lower case."""
    t = unicodedata.normalize("NFKC", text or "").translate(PUNCTUATION)
    t = _DATE.sub(lambda m: f"{m[1]}-{int(m[2]):02d}" + (f"-{int(m[3]):02d}" if m[3] else ""), t)
    t = _SLASHED.sub(lambda m: f"{m[1]}-{int(m[2]):02d}-{int(m[3]):02d}", t)
    return re.sub(r"\s+", " ", _numbers(t)).strip().lower()


def split_words(text: str | None, stop: frozenset[str] = frozenset()) -> list[str]:
    """Words of Latin letters and digits, and pairs of neighbouring Chinese characters; single non-ASCII characters and stop words are left out."""
    out: list[str] = []
    for w in _WORD.findall(normal(text)):
        out.extend([w] if w.isascii() else [w[i : i + 2] for i in range(len(w) - 1)])
    return [w for w in out if w not in stop]


@F.pandas_udf(StringType())
def normalised(texts: pd.Series) -> pd.Series:
    """normal() in Arrow batches: NFKC has no JVM function."""
    return texts.map(normal)


@F.pandas_udf(ArrayType(StringType()))
def segmented(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(split_words)
        pa.default_memory_pool().release_unused()  # a worker lives on and keeps what it once needed


def letter_words(text: Column) -> Column:
    """Words of letters and digits of any script in lower case, without Python: the tokens of the vocabulary queries."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def inverse_frequency(df: Column, n: Column) -> Column:
    """Smoothed: ln((N + 1) / (df + 1)) + 1."""
    return F.log((n + 1) / (df + 1)) + 1


def term_weight(count: Column, most: Column, idf: Column) -> Column:
    """(1 + ln c) / (1 + ln cmax) * idf."""
    return (1 + F.log(count)) / (1 + F.log(most)) * idf


def heading_level(line: Column) -> Column:
    """1 for a chapter or a numeral before a comma, 2 for an article or a numeral in brackets, else 0."""
    out = F.lit(0)
    for level in sorted(HEADINGS, reverse=True):
        out = F.when(line.rlike(HEADINGS[level]), level).otherwise(out)
    return out


def table_caption(line: Column) -> Column:
    return F.when(line.rlike("^表[：:]"), F.trim(F.regexp_extract(line, "^表[：:](.*)$", 1)))


def keeps_numbers(original: Column, rewritten: Column) -> Column:
    """Whether every number of the original stands in the rewritten text."""
    number = F.lit(r"[0-9]+(?:\.[0-9]+)?")
    return F.size(F.array_except(F.regexp_extract_all(original, number, F.lit(0)), F.regexp_extract_all(rewritten, number, F.lit(0)))) == 0


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
