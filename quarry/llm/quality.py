"""Quality rules: repetition counts and an n-gram perplexity band for each language.

The language model is a modified Kneser-Ney model of order ORDER over characters (lower case, any digit as 0,
any white space as a space), one for each language of the inventory and one for all other rows.  Spark
counts the n-grams of every text, with map-side sums, nothing pruned, and derives continuation counts,
discounts, back-off weights and interpolated probabilities of all orders by grouped aggregations and joins of
the partitioned tables: the model grows with the corpus and no task or driver needs to hold it.  For
scoring it is laid out as sorted arrays of 64-bit hashes; a count decides whether they are told to all tasks
(at most TOLD_GRAMS entries) or each document's n-grams are joined with the tables, with the same result.

Junk that is frequent would teach the model to expect it.  So a model of order FIRST_ORDER is fitted on all documents
first, and the other one learns from those documents whose score under it is within USUAL deviations of their
language's median (over half of them); all documents are scored.

A document's score is its mean negative log2-probability a character.  Over all documents of a
language, median and median absolute deviation give an upper and a lower band; a document outside
is rejected.  The band is wider for short texts, whose mean varies more.

Defined results: null and empty texts have 0 for all counts and fail the base rule; a language
outside the inventory, or null, belongs to the group "und".  Repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, dropped, pieces, ready, written
from quarry.llm.textkernel import U, Words, mix, windows

LANGUAGES = ("en", "de", "fr", "es")
ORDER = 5
#: Order of the model that tells which documents the other one learns from, and how many deviations those may be away.
FIRST_ORDER, USUAL = 3, 1.0
#: Entries of a model of up to so many are told to all tasks: 12 bytes each.
TOLD_GRAMS = 1 << 23
#: Up to so many possible n-grams of a batch have a place each in a table.
DENSE = 1 << 23
#: Half-width of the band in median absolute deviations, and the characters at which it is sqrt(2) times as wide.
WIDTH, SHORT = 6.0, 400.0
#: Least half-width in bits a character, for a language whose texts hardly differ: below WIDTH deviations of every language measured.
LEAST = 0.05
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT = 10, 20


@cache
def folds() -> np.ndarray:
    """Each code point's symbol."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isspace():
            out[c] = 32
        elif ch.isdecimal():
            out[c] = 48
        elif ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


#: One odd multiplier for each place in an n-gram, from its end.
_AT = np.random.default_rng(411).integers(1, 2**63, size=16, dtype=np.uint64) * U(2) + U(1)


class Symbols:
    """The symbols of a batch of texts, order - 1 spaces before each."""

    def __init__(self, texts: list[bytes], order: int) -> None:
        parts = [t.decode("utf-8", "replace") for t in texts]
        pad = " " * (order - 1)
        self.points = folds()[np.frombuffer("".join(pad + x for x in parts).encode("utf-32-le"), dtype=np.uint32)]
        size = np.array([len(x) for x in parts], dtype=np.int64)
        #: Where each text's own characters begin in the list of all texts' characters; one more for the end.
        self.first = np.concatenate(([0], np.cumsum(size)))
        #: Where each character stands among the points.
        self.at = np.arange(int(size.sum())) + (order - 1) * (np.repeat(np.arange(len(parts)), size) + 1)

    def sums(self, order: int) -> np.ndarray:
        """For each character the sum that the n-gram of this order that ends there is hashed from."""
        total = self.points[self.at].astype(np.uint64) * _AT[0]
        for k in range(1, order):
            total += self.points[self.at - k].astype(np.uint64) * _AT[k]
        return total

    def codes(self, group: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, int] | None:
        """For each character the number of its n-gram by group, what symbols its digits stand for, and a bound of the numbers; None if 64 bits are too few."""
        present = np.zeros(int(self.points.max(initial=0)) + 1, dtype=bool)
        present[self.points] = True
        symbols = np.flatnonzero(present)
        base = len(symbols)
        most = base**order * (int(group.max(initial=0)) + 1)
        if most >= 1 << 63:
            return None
        digit = np.zeros(len(present), dtype=np.uint64)
        digit[symbols] = np.arange(base)
        digits = digit[self.points]
        total = group.astype(np.uint64)
        for k in range(order - 1, -1, -1):
            total *= U(base)
            total += digits[self.at - k]
        return total, symbols, most

    def distinct(self, group: np.ndarray, order: int) -> tuple[np.ndarray, list[str], np.ndarray]:
        """Group, n-gram and count of the different n-grams of the batch."""
        coded = self.codes(group, order)
        if coded is None:
            _, at, n = np.unique(keys_of(self.sums(order), group, order), return_index=True, return_counts=True)
            return group[at], self.listed(at, order), n
        codes, symbols, _ = coded
        codes.sort()
        at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        n, left = np.diff(np.append(at, len(codes))), codes[at]
        points = np.empty((len(at), order), dtype=np.uint32)
        for k in range(order - 1, -1, -1):
            left, points[:, k] = left // U(len(symbols)), symbols[left % U(len(symbols))]
        text = points.tobytes().decode("utf-32-le")
        return left, [text[i : i + order] for i in range(0, len(text), order)], n

    def listed(self, which: np.ndarray, order: int) -> list[str]:
        text = self.points.tobytes().decode("utf-32-le")
        return [text[i + 1 - order : i + 1] for i in self.at[which].tolist()]


def keys_of(sums: np.ndarray, group: np.ndarray, order: int) -> np.ndarray:
    """Hashes of n-grams of one order by group."""
    return mix(mix(sums + U(order)) + group.astype(np.uint64))


def sums_of(grams: list[str], order: int) -> np.ndarray:
    """The sums of n-grams that are given as strings."""
    points = np.frombuffer("".join(grams).encode("utf-32-le"), dtype=np.uint32).reshape(-1, order).astype(np.uint64) if order else np.zeros((len(grams), 0), np.uint64)
    total = np.zeros(len(grams), dtype=np.uint64)
    for k in range(order):
        total += points[:, order - 1 - k] * _AT[k]
    return total


def language(column: str = "lang", languages: tuple[str, ...] = LANGUAGES):
    """Index in the inventory; its length for any other value."""
    out = F.lit(len(languages))
    for i, x in enumerate(languages):
        out = F.when(F.lower(F.col(column)) == x, F.lit(i)).otherwise(out)
    return out


def count_ngrams(docs: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, order: int = ORDER, only: Usual | None = None) -> DataFrame:
    """g, gram, c: the n-grams of the highest order and their counts over all texts, or those that only finds usual."""
    shared = docs.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = shared.value
        for batch in batches:
            for rows, texts in pieces(batch, limit=1 << 20):
                lang = rows.column(1).to_numpy(zero_copy_only=False)
                if usual:
                    kept = np.concatenate([usual.of(texts[i : i + 128], lang[i : i + 128]) for i in range(0, len(texts), 128)])
                    texts, lang = [t for t, k in zip(texts, kept.tolist(), strict=True) if k], lang[kept]
                some = Symbols(texts, order)
                group = np.repeat(lang, np.diff(some.first))
                of, grams, n = some.distinct(group, order)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["g", "gram", "c"])

    rows = docs.select("text", language(languages=languages).alias("g"))
    return rows.mapInArrow(run, "g int, gram string, c long").groupBy("g", "gram").agg(F.sum("c").alias("c"))


@dataclass
class Usual:
    """A model of lower order with bands: tells texts that are like most of their language."""

    told: tuple
    bands: dict[int, tuple[float, float]]
    order: int
    width: float

    def of(self, texts: list[bytes], lang: np.ndarray) -> np.ndarray:
        some = Symbols(texts, self.order)
        n = np.diff(some.first)
        mean = sums(costs(some, np.repeat(lang, n), self.told, self.order), some.first) / np.maximum(n, 1)
        middle, mad = (np.array([self.bands.get(int(g), (0.0, np.inf))[i] for g in lang]) for i in (0, 1))
        # rounded as the scores are that the band is made of, so that joined scores tell the same
        return np.abs(np.round(mean, 4) - middle) <= self.width * np.maximum(mad, 1e-3) * np.sqrt(1 + SHORT / np.maximum(n, 1))


def usual(docs: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, order: int = FIRST_ORDER, width: float = USUAL) -> tuple[DataFrame, Usual | None]:
    """The rows to learn from, and what tells which of them are usual; None if the rows are just those.

    Fitted on all documents at every size.  A model that may be told tells texts where they are read; beyond that rows are
    scored by joins, like in the second pass, and those within the band are kept.
    """
    model = kneser_ney(count_ngrams(docs, languages=languages, order=order), order)
    told = arrays(model, order)
    if told is None:
        rows = written(docs.select("text", "lang", F.monotonically_increasing_id().alias("doc_id")), "rows")
        scored = written(score(rows, model, languages=languages, order=order, told=False, counted=False), "scored")
        off = F.abs(F.col("bits") - F.col("middle")) <= width * F.greatest(F.col("mad"), F.lit(1e-3)) * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("chars"), F.lit(1)))
        kept = scored.where("bits is not null").join(F.broadcast(deviations(scored)), "g", "left").where(F.coalesce(off, F.lit(True))).select("doc_id")
        return rows.join(kept, "doc_id", "left_semi"), None
    scored = written(score(docs, model, languages=languages, order=order, counted=False), "scored")
    found = {r["g"]: (r["middle"], r["mad"]) for r in deviations(scored).collect()}  # a row for each language of the inventory
    dropped(scored)
    return docs, Usual(told, found, order, width)


def discounts(table: DataFrame) -> DataFrame:
    """g, d1, d2, d3: Chen and Goodman's three discounts from the counts of counts, one row a language."""
    n = [F.greatest(F.lit(1), F.count(F.when(F.col("c") == k, 1))).cast("double").alias(f"n{k}") for k in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}") for k in (1, 2, 3)]
    return table.groupBy("g").agg(*n).select("g", *d)


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, g, gram, p: probability of the last symbol after the others; k, g, context, weight: of what the context leaves to the lower order; g, uniform).

    Lower orders use continuation counts: how many different symbols stand before the n-gram.
    """
    tables = {order: written(counts, "grams")}
    for k in range(order - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy("g", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("c")), "grams")
    uniform = tables[1].groupBy("g").agg((1.0 / (F.count("*") + 1)).alias("uniform"))  # one more for symbols never seen
    grams, contexts = {}, {}
    for k in range(1, order + 1):
        off = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = tables[k].join(F.broadcast(discounts(tables[k])), "g")  # a row for each language of the inventory
        rows = rows.select("g", "gram", F.substring("gram", 1, k - 1).alias("context"), F.col("c").cast("double").alias("c"), off.alias("off"))
        contexts[k] = written(rows.groupBy("g", "context").agg(F.sum("c").alias("total"), (F.sum("off") / F.sum("c")).alias("weight")), "contexts")
        rows = rows.join(contexts[k], ["g", "context"])
        lower = F.broadcast(uniform).withColumnRenamed("uniform", "lower") if k == 1 else grams[k - 1].select("g", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
        rows = rows.join(lower, "g") if k == 1 else rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(lower, ["g", "suffix"])
        grams[k] = written(rows.select("g", "gram", ((F.col("c") - F.col("off")) / F.col("total") + F.col("weight") * F.col("lower")).alias("p")), "probabilities")
    for t in tables.values():
        if t is not tables[1]:
            dropped(t)

    def together(parts: dict[int, DataFrame], *columns: str) -> DataFrame:
        out = None
        for k, t in parts.items():
            some = t.select(F.lit(k).alias("k"), "g", *columns)
            out = some if out is None else out.union(some)
        return out

    return together(grams, "gram", "p"), together(contexts, "context", "weight"), uniform


class Arrays:
    """Sorted hashes with values, and where the hashes of each leading bit pattern begin."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = 64 - bits
        self.begin = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << U(self.shift)).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether there is one."""
        out, seen = np.zeros(len(wanted), dtype=np.float32), np.zeros(len(wanted), dtype=bool)
        if not len(self.keys):
            return out, seen
        left = np.arange(len(wanted))
        at = self.begin[(wanted >> U(self.shift)).astype(np.int64)].astype(np.int64)
        while len(left):
            inside = at < len(self.keys)
            left, at = left[inside], at[inside]
            here = self.keys[at]
            hit = here == wanted[left]
            out[left[hit]], seen[left[hit]] = self.values[at[hit]], True
            on = here < wanted[left]
            left, at = left[on], at[on] + 1
        return out, seen


def arrays(model: tuple[DataFrame, DataFrame, DataFrame], order: int = ORDER) -> tuple[dict[int, Arrays], dict[int, Arrays], dict[int, float]] | None:
    """The model as sorted hash arrays of costs (negative log2) by order; None if it has over TOLD_GRAMS entries."""
    grams, contexts, uniform = model
    if grams.count() + contexts.count() > TOLD_GRAMS:
        return None
    found, less = {}, {}
    for k in range(1, order + 1):
        g = grams.where(F.col("k") == k).select("g", "gram", (-F.log2("p")).alias("cost")).toArrow()
        c = contexts.where(F.col("k") == k).select("g", "context", (-F.log2("weight")).alias("cost")).toArrow()
        found[k] = Arrays(keys_of(sums_of(g["gram"].to_pylist(), k), g["g"].to_numpy(), k), g["cost"].to_numpy())
        less[k] = Arrays(keys_of(sums_of(c["context"].to_pylist(), k - 1), c["g"].to_numpy(), k + 32), c["cost"].to_numpy())
    return found, less, {r["g"]: -float(np.log2(r["uniform"])) for r in uniform.collect()}


def costs(some: Symbols, group: np.ndarray, told: tuple, order: int = ORDER) -> np.ndarray:
    """Negative log2-probability of each character; 1 bit more than nothing is known for a group without a model.

    It depends on the character's n-gram and group alone, so that each of these is looked up once in a batch.
    """
    coded = some.codes(group, order)
    if coded is None or not len(group):
        return costs_at(some, group, np.arange(len(group)), told, order)
    codes, _, most = coded
    if most <= DENSE:
        where = np.full(most, -1, dtype=np.int32)
        where[codes] = np.arange(len(codes), dtype=np.int32)
        different = np.flatnonzero(where >= 0)
        values = np.empty(most, dtype=np.float64)
        values[different] = costs_at(some, group, where[different].astype(np.int64), told, order)
        return values[codes]
    by = np.argsort(codes)
    ordered = codes[by]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    out = np.empty(len(codes), dtype=np.float64)
    out[by] = costs_at(some, group, by[new], told, order)[np.cumsum(new) - 1]
    return out


def costs_at(some: Symbols, group: np.ndarray, at: np.ndarray, told: tuple, order: int) -> np.ndarray:
    """The costs of some of the characters."""
    found, less, uniform = told
    group, points = group[at], some.at[at]
    out = np.zeros(len(at), dtype=np.float64)
    left = np.arange(len(at))

    def summed(last: int, size: int) -> np.ndarray:
        total = np.zeros(len(left), dtype=np.uint64)
        for j in range(size):
            total += some.points[points[left] - last - j].astype(np.uint64) * _AT[j]
        return total

    for k in range(order, 0, -1):
        if not len(left):
            break
        value, seen = found[k].find(keys_of(summed(0, k), group[left], k))
        out[left[seen]] += value[seen]
        left = left[~seen]
        value, seen = less[k].find(keys_of(summed(1, k - 1), group[left], k + 32))
        out[left[seen]] += value[seen]
    out[left] += np.array([uniform.get(int(g), 1.0) for g in group[left]])
    return out


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring places of at."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


def base_counts(texts: list[bytes], window: int = WINDOW) -> dict[str, np.ndarray]:
    words = Words(texts)
    space = np.zeros(256, dtype=bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    point = np.ones(256, dtype=bool)
    point[0x80:0xC0] = False
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    hashes, inside = windows(words, window)
    at = np.flatnonzero(inside)
    text = np.repeat(np.arange(len(texts), dtype=np.uint64), words.per_text())
    key = hashes[at] ^ mix(text[at] + U(1))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(at), dtype=bool)
    if len(at) > 1:
        equal = (key[order][1:] == key[order][:-1]) & (text[at][order][1:] == text[at][order][:-1])
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    cover = np.zeros(len(words.hashes) + window + 1, dtype=np.int64)
    np.add.at(cover, at[same], 1)
    np.add.at(cover, at[same] + window, -1)
    covered = np.cumsum(cover)[: len(words.hashes)] > 0
    lines = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        some = [x for x in t.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        lines[i] = len(some) - len(set(some))
    return {
        "n_words": words.per_text().astype(np.int64),
        "word_chars": sums((point & ~space)[words.buffer], words.offsets),
        "n_symbols": sums(symbol[words.buffer], words.offsets),
        "n_dup_lines": lines,
        "n_repeat_words": sums(covered, words.first),
    }


def score(docs: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], *, languages: tuple[str, ...] = LANGUAGES, order: int = ORDER, told: bool | None = None, counted: bool = True) -> DataFrame:
    """doc_id, group, the base counts, chars and bits (mean negative log2-probability; null without characters).

    told: whether the model goes to all tasks; by default a count decides.  counted: whether base counts are made; else they are 0.
    """
    ready(docs.sparkSession)
    told_model = None if told is False else arrays(model, order)
    shared = docs.sparkSession.sparkContext.broadcast(told_model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", language(languages=languages).alias("g"), F.monotonically_increasing_id().alias("row"))
    if told_model is None:
        rows = written(rows, "texts")  # so that both passes see the same row numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch):
                lang = rows.column(2).to_numpy(zero_copy_only=False)
                some = Symbols(texts, order)
                n = np.diff(some.first)
                total = sums(costs(some, np.repeat(lang, n), shared.value, order), some.first) if shared.value else np.zeros(len(n))
                base = base_counts(texts) if counted else dict.fromkeys(COUNTS, np.zeros(len(n), np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(lang, pa.int32()), rows.column(3), *(pa.array(base[k], pa.int64()) for k in COUNTS), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "g", "row", *COUNTS, "chars", "total"])

    out = rows.mapInArrow(run, "doc_id long, g int, row long, " + ", ".join(f"{k} long" for k in COUNTS) + ", chars long, total double")
    if told_model is None:
        out = out.drop("total").join(joined_costs(rows, model, order), "row", "left")
    bits = F.when(F.col("chars") > 0, F.round(F.col("total") / F.col("chars"), 4))
    return out.select("doc_id", "g", *COUNTS, "chars", bits.alias("bits"))


def joined_costs(rows: DataFrame, model: tuple[DataFrame, DataFrame, DataFrame], order: int = ORDER) -> DataFrame:
    """row, total: each document's n-grams joined with the tables, order by order.  rows: row, text, g."""
    grams, contexts, uniform = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some_rows, texts in pieces(batch):
                some = Symbols(texts, order)
                of = np.repeat(np.arange(len(texts)), np.diff(some.first))
                _, at, n = np.unique(keys_of(some.sums(order), of, order), return_index=True, return_counts=True)
                pick = pa.array(of[at])
                yield pa.RecordBatch.from_arrays([some_rows.column(0).take(pick), some_rows.column(2).take(pick), pa.array(some.listed(at, order), pa.string()), pa.array(n, pa.int64())], names=["row", "g", "gram", "n"])

    left = rows.select("row", "text", "g").mapInArrow(run, "row long, g int, gram string, n long").withColumn("cost", F.lit(0.0))
    done = None
    for k in range(order, 0, -1):
        here = grams.where(F.col("k") == k).select("g", "gram", "p")
        found = written(left.join(here, ["g", "gram"], "left"), "costs")
        some = found.where("p is not null").select("row", "n", (F.col("cost") - F.log2("p")).alias("cost"))
        done = some if done is None else done.union(some)
        lower = contexts.where(F.col("k") == k).select("g", "context", "weight")
        left = found.where("p is null").withColumn("context", F.substring("gram", 1, k - 1)).join(lower, ["g", "context"], "left")
        left = left.select("row", "g", F.substring("gram", 2, k).alias("gram"), "n", (F.col("cost") - F.coalesce(F.log2("weight"), F.lit(0.0))).alias("cost"))
    last = left.join(F.broadcast(uniform), "g", "left").select("row", "n", (F.col("cost") + F.coalesce(-F.log2("uniform"), F.lit(1.0))).alias("cost"))
    return done.union(last).groupBy("row").agg(F.sum(F.col("n") * F.col("cost")).alias("total"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def bands(scored: DataFrame, *, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """g, middle, half: one row a language, over all scored documents."""
    return deviations(scored).select("g", "middle", F.greatest(F.lit(width) * F.col("mad"), F.lit(least)).alias("half"))


def deviations(scored: DataFrame) -> DataFrame:
    """g, middle, mad of the bits."""
    middle = scored.where("bits is not null").groupBy("g").agg(F.percentile_approx("bits", 0.5, 10_000).alias("middle"))
    return scored.where("bits is not null").join(F.broadcast(middle), "g").groupBy("g").agg(F.first("middle").alias("middle"), F.percentile_approx(F.abs(F.col("bits") - F.col("middle")), 0.5, 10_000).alias("mad"))


def judge(docs: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, order: int = ORDER, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    ready(docs.sparkSession)
    learned, only = usual(docs, languages=languages)
    model = kneser_ney(count_ngrams(learned, languages=languages, order=order, only=only), order)
    scored = written(score(docs, model, languages=languages, order=order), "scored")
    banded = scored.join(F.broadcast(bands(scored, width=width, least=least)), "g", "left")  # a row for each language of the inventory
    half = F.col("half") * F.sqrt(1 + F.lit(SHORT) / F.greatest(F.col("chars"), F.lit(1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    low, high = F.col("middle") - half, F.col("middle") + half
    inside = F.coalesce(F.col("bits").between(low, high), F.lit(False))
    return banded.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"), F.element_at(F.array(*map(F.lit, (*languages, "und"))), F.col("g") + 1).alias("model_language"), "bits", F.round(low, 6).alias("bits_low"), F.round(high, 6).alias("bits_high")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
