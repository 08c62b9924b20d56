"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: case, accents, full-width forms and look-alike letters of other scripts,
digits and signs that stand for letters, invisible characters.  The lexicon is learned: whole words
and word beginnings whose document frequency among toxic labelled rows is far above that among the
others, weighted by the log-odds.  Longer exception phrases cancel the entries inside them.  The sum
of weights and its share of the text's words (length normalisation) go into a logistic curve, fitted
on the same rows.

Labels are read only for rows whose crc32(doc_id as text) mod 4 is not HELD_OUT, and of those at
most about SAMPLE rows are used, chosen by a hash of doc_id; lang, source and doc_id are no input of
a score.

Defined results: null and empty texts have no match and the lowest score; without any toxic label
the lexicon is empty and all scores are the same; repeated rows give repeated rows; a label that
contradicts another of the same doc_id counts as a row of its own.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import islice, takewhile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, dropped, pieces, written

HELD_OUT = 2
#: Most labelled rows that learning uses, in expectation.
SAMPLE = 20_000
LEAST_SUPPORT, LEAST_WEIGHT = 5, 3.0
BEGINNINGS = (4, 5, 6)
CUT = 0.3
#: Phrases in which an entry is harmless; folded like texts.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car", "scum line", "sore loser bracket", "loser bracket")
#: Letters of other scripts and signs that look like Latin letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ł": "l", "ø": "o", "đ": "d", "ß": "s",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "|": "l",
}
INVISIBLE = (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)
#: Mathematical and enclosed letters lie below; from here on all are taken for letters of other scripts, as this one is.
LAST = 0x20000
_LETTER, _GAP, _DROP = 0x7E, 0x20, 0
_LEARNED: dict[str, object] = {}


@cache
def fold_table() -> np.ndarray:
    """Folded ASCII byte of each code point up to LAST: a-z, ~ for other letters, space, 0 to drop."""
    out = np.full(LAST + 1, _GAP, dtype=np.uint8)
    for c in range(LAST + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c).lower()[:1]
        base = LOOK_ALIKES.get(ch) or unicodedata.normalize("NFKD", ch)[:1].lower()
        base = LOOK_ALIKES.get(base, base)
        kind = unicodedata.category(chr(c))
        if c in INVISIBLE or kind in ("Mn", "Me"):
            out[c] = _DROP
        elif "a" <= base <= "z":
            out[c] = ord(base)
        elif kind[0] in "LN":
            out[c] = _LETTER
    return out


def folded(texts: list[bytes]) -> list[str]:
    """Each text folded, between spaces.

    ! and | only fold between letters, so that punctuation at a word's end stays a gap.
    """
    joined = "\n".join(t.decode("utf-8", "replace").replace("\n", " ") for t in texts)
    points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32), LAST)
    out = fold_table()[points]
    mark = np.isin(points, MARKS)
    if mark.any() and len(out) > 2:
        plain = np.concatenate(([False], (out != _GAP) & ~mark, [False]))
        out[mark & ~(plain[:-2] & plain[2:])] = _GAP
    out[points == 10] = 10
    return [f" {x} " for x in out[out != _DROP].tobytes().decode("ascii").split("\n")]


MARKS = [ord(c) for c in "!|@$€"]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == HELD_OUT


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic of about sample labelled rows at most; held-out labels are dropped before anything else."""
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("_id")) & F.col("toxic").isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col("_id"), F.lit(17)), F.lit(n)) < sample)
    # at most about sample rows of two numbers: a proven bound
    return docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(rows), "_id").select("text", "toxic")


def terms(text: str) -> dict[str, str]:
    """Words (between spaces) and word beginnings of a folded text, with the word before their first place."""
    out, before = {}, ""
    for w in text.split():
        if 3 <= len(w) <= 40:
            out.setdefault(f" {w} ", before)
            for k in BEGINNINGS:
                if k <= len(w):
                    out.setdefault(f" {w[:k]}", before)
        before = w
    return out


def frequencies(rows: DataFrame) -> pd.DataFrame:
    """term, toxic and clean rows with it, for terms with enough different words before them among toxic rows.

    Words before a term tell an insult, which stands anywhere, from the rare words of a text that was
    copied many times: those always follow the same word.
    """

    def count(batches: Iterator[pa.RecordBatch], only: int, wanted: set[str] | None) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in total], pa.string()), pa.array([b for _, b in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "before", "n"])

        for batch in batches:
            for some, texts in pieces(batch.filter(pc.equal(batch.column(1), only))):
                for t in folded(texts):
                    for x, before in terms(t).items():
                        if wanted is None or x in wanted:
                            key = (x, before if wanted is None else "")
                            total[key] = total.get(key, 0) + 1
                if len(total) > 200_000:
                    yield out()
                    total = {}
        yield out()

    schema = "term string, before string, n long"
    pairs = rows.mapInArrow(lambda b: count(b, 1, None), schema).groupBy("term", "before").agg(F.sum("n").alias("n"))
    toxic = pairs.groupBy("term").agg(F.sum("n").alias("toxic"), F.count("*").alias("places")).where(F.col("places") >= LEAST_SUPPORT)
    # terms with support in a bounded sample: as many as its texts can hold, none left out
    have = {r["term"]: (r["toxic"], r["places"]) for r in toxic.toLocalIterator()}
    wanted = set(have)
    clean = rows.mapInArrow(lambda b: count(b, 0, wanted), schema).groupBy("term").agg(F.sum("n").alias("n"))
    other = {r["term"]: r["n"] for r in clean.toLocalIterator()}
    return pd.DataFrame({"term": list(have), "toxic": [a for a, _ in have.values()], "places": [p for _, p in have.values()], "clean": [other.get(t, 0) for t in have]})


def lexicon(table: pd.DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entry -> weight.  A beginning stands in for its words only where it gathers more than one of them."""
    support = max(LEAST_SUPPORT, 0.004 * n_toxic)
    weight = {}
    count = {}
    for term, a, places, b in table[["term", "toxic", "places", "clean"]].itertuples(index=False):
        w = math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))
        if places >= support and w >= LEAST_WEIGHT:
            weight[term], count[term] = round(w, 4), a
    out: dict[str, float] = {}
    ordered = sorted(weight)
    for term in sorted(weight, key=lambda t: (len(t.rstrip()), t.endswith(" "), t)):
        if any(term.startswith(term[: k + 1]) and term[: k + 1] in out for k in range(3, len(term))):
            continue  # a shorter beginning covers it
        if not term.endswith(" "):
            longer = takewhile(lambda t, term=term: t.startswith(term), islice(ordered, bisect_right(ordered, term), None))
            if any(count[t] >= 0.9 * count[term] for t in longer):
                continue  # one longer entry says the same, more precisely
        out[term] = weight[term]
    return out


class Matcher:
    def __init__(self, entries: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for term, w in entries.items():
            self.machine.add_word(term, (len(term), w))
        for phrase in exceptions:
            text = folded([phrase.encode()])[0]
            self.machine.add_word(text, (len(text), None))
        self.ready = len(self.machine) > 0
        if self.ready:
            self.machine.make_automaton()

    def match(self, text: str) -> tuple[float, int]:
        """Sum of weights and number of matches outside exception phrases."""
        if not self.ready:
            return 0.0, 0
        found, free = [], []
        for end, (size, w) in self.machine.iter(text):
            (found if w is not None else free).append((end - size + 1, end + 1, w))
        if free:
            found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b, _ in free)]
        return sum(x[2] for x in found), len(found)


def measures(sums: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Inputs of the curve: one, the damped sum of weights, and the sum a word."""
    return np.stack([np.ones(len(sums)), np.log1p(sums), np.sqrt(sums / np.maximum(words, 1.0))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """entries, curve, exceptions."""
    rows = written(labelled(docs, labels, sample), "labelled")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    entries = lexicon(frequencies(rows), n.get(1, 0), n.get(0, 0)) if n.get(1) else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(entries, exceptions)
        for batch in batches:
            for some, texts in pieces(batch):
                found = [(matcher.match(t)[0], t.count(" ")) for t in folded(texts)]
                yield pa.RecordBatch.from_arrays([some.column(1), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64())], names=["toxic", "sums", "words"])

    points = rows.mapInArrow(run, "toxic int, sums double, words long").toPandas()  # three numbers for each row of the sample
    points = points.sort_values(["toxic", "sums", "words"])
    curve = fit(measures(points["sums"].to_numpy(float), points["words"].to_numpy(float)), (points["toxic"] == 1).to_numpy(float)) if len(points) else np.array([-3.0, 0.0, 0.0])
    dropped(rows)
    return {"entries": entries, "curve": np.round(curve, 6), "exceptions": exceptions}


def score(docs: DataFrame, model: dict, *, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LEARNED:
            _LEARNED.clear()
            _LEARNED[name] = Matcher(shared.value["entries"], shared.value["exceptions"])
        matcher = _LEARNED[name]
        for batch in batches:
            for rows, texts in pieces(batch):
                some = folded(texts)
                found = [matcher.match(t) for t in some]
                words = np.array([t.count(" ") for t in some], dtype=float)
                x = measures(np.array([f[0] for f in found], dtype=float), words)
                p = np.round(1 / (1 + np.exp(-np.clip(x @ shared.value["curve"], -30, 30))), 6)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array((p >= cut).astype(np.int32)), pa.array([f[1] for f in found], pa.int64())], names=["doc_id", "score", "predicted", "n_matches"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_matches long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_matches")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
