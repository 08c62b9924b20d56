"""Segmentation with a dictionary: the best path through the word graph of each run of letters.

The dictionary is a table (word, freq, user).  A run of Han characters (or, with runs=LETTERS, of any letters) is cut so that the
sum of log(freq / total) over its words is greatest; a single character that is no word counts as one of frequency
UNSEEN.  User terms are never divided: where one stands in a run, the longest from left to right, it is a word and what
stands on its two sides is cut by itself.  Among equal sums the path whose last word is longest is taken, from right to left.

The dictionary goes to all tasks while it has at most MOST_WORDS words (a frozen dictionary does not grow with the
texts); beyond that segmentation is refused rather than cut short.

`graph_best` is the same by joins alone, for runs as rows: substrings of at most the longest word's length are joined with the
dictionary table by equality and the edges of a run are folded by Spark's `aggregate`, so a dictionary of any size will do.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequency of a character that is no word, most words that are told to tasks, decimals of a sum of logarithms.
UNSEEN, MOST_WORDS, DIGITS = 0.5, 2_000_000, 9
#: Runs of Han characters, and of letters of any script.
HAN, LETTERS = "[㐀-鿿]+", r"[^\W\d_]+"


@dataclass
class Dictionary:
    """Words with the logarithm of their share, and the prefixes that some word begins with."""

    cost: dict[str, float]
    user: frozenset[str] = frozenset()
    unseen: float = 0.0
    longest: int = 1
    prefixes: frozenset[str] = field(default_factory=frozenset)
    longest_user: int = 0

    @classmethod
    def of(cls, words: dict[str, float], user: frozenset[str] = frozenset()) -> Dictionary:
        known = {w: n for w, n in words.items() if w and n > 0}
        total = max(sum(known.values()), 1.0)
        cost = {w: round(math.log(n / total), DIGITS) for w, n in known.items()}
        prefixes = frozenset(w[:i] for w in known for i in range(1, len(w)))
        return cls(cost, frozenset(u for u in user if u), round(math.log(UNSEEN / total), DIGITS), max(map(len, known), default=1), prefixes, max(map(len, user), default=0))

    def knows(self, word: str) -> bool:
        """Whether a general dictionary has the word; a user term alone does not make it general."""
        return word in self.cost

    def cut(self, run: str) -> list[str]:
        if not self.longest_user:
            return self.best(run)
        out, at, i = [], 0, 0
        while i < len(run):
            end = next((j for j in range(min(len(run), i + self.longest_user), i, -1) if run[i:j] in self.user), 0)
            if end:
                out += [*self.best(run[at:i]), run[i:end]]
                at = i = end
            else:
                i += 1
        return out + self.best(run[at:])

    def best(self, run: str) -> list[str]:
        """Best sums of all beginnings from left to right, then the path back; only prefixes of words are tried further."""
        n = len(run)
        best = [0.0] + [-math.inf] * n
        back = [0] * (n + 1)
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                word = run[i:j]
                cost = self.cost.get(word, self.unseen if j == i + 1 else None)
                if cost is not None:
                    total = round(best[i] + cost, DIGITS)
                    if total > best[j]:  # the first that comes begins farthest left: the longest
                        best[j], back[j] = total, i
                if word not in self.prefixes:
                    break
        out, end = [], n
        while end:
            out.append(run[back[end] : end])
            end = back[end]
        return out[::-1]


def gathered(words: DataFrame, user: DataFrame | None = None, *, most: int = MOST_WORDS) -> Dictionary:
    """The dictionary of a table (word, freq) and one of user terms (term)."""
    rows = words.where("word is not null and freq > 0").groupBy("word").agg(F.sum("freq").alias("freq")).limit(most + 1).collect()
    terms = [r[0] for r in user.select("term").where("term is not null").distinct().limit(most + 1).collect()] if user is not None else []
    if len(rows) + len(terms) > most:
        raise ValueError(f"a dictionary of over {most} words: use graph_best")
    return Dictionary.of({r["word"]: float(r["freq"]) for r in rows}, frozenset(terms))


def segmented(texts: DataFrame, dictionary: Dictionary, *, key: str, text: str = "text", runs: str = HAN) -> DataFrame:
    """key, words: all words of a text in order; runs are cut by the dictionary, other words (letters, digits, joined by . - /) stay whole."""
    shared = texts.sparkSession.sparkContext.broadcast(dictionary)
    pattern = rf"(?P<run>{runs})|[^\W_]+(?:[.\-/][^\W_]+)*" if runs != HAN else rf"(?P<run>{runs})|(?:(?!{HAN[:-1]})[^\W_])+(?:[.\-/](?:(?!{HAN[:-1]})[^\W_])+)*"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, words = re.compile(pattern), shared.value
        for f in frames:
            out = []
            for t in f[text]:
                row: list[str] = []
                for m in found.finditer(t or ""):
                    row.extend(words.cut(m[0]) if m["run"] else [m[0]])
                out.append(row)
            yield pd.DataFrame({key: f[key], "words": out})

    return texts.select(F.col(key).cast("long").alias(key), text).mapInPandas(run, f"{key} long, words array<string>")


def graph_best(runs: DataFrame, words: DataFrame, *, key: str = "run") -> DataFrame:
    """key (the distinct runs), words: the best path by joins.  words: word, freq."""
    known = words.where("word is not null and word <> '' and freq > 0").groupBy("word").agg(F.sum("freq").cast("double").alias("freq"))
    total, longest = known.agg(F.coalesce(F.sum("freq"), F.lit(1.0)), F.coalesce(F.max(F.length("word")), F.lit(1))).first()
    cost = known.select("word", F.round(F.log(F.col("freq") / F.lit(float(max(total, 1.0)))), DIGITS).alias("cost"))
    unseen = round(math.log(UNSEEN / max(total, 1.0)), DIGITS)
    own = runs.select(F.col(key).alias("run")).where("run is not null and run <> ''").distinct()
    size = F.length("run")
    starts = own.select("run", F.explode(F.sequence(F.lit(1), size)).alias("i"))
    spans = starts.select("run", "i", F.explode(F.sequence(F.col("i"), F.least(size, F.col("i") + int(longest) - 1))).alias("j"))
    spans = spans.withColumn("word", F.expr("substring(run, i, j - i + 1)"))
    edges = spans.join(cost, "word", "left").withColumn("cost", F.coalesce("cost", F.when(F.col("i") == F.col("j"), F.lit(unseen)))).where("cost is not null")
    sorted_ = edges.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("i", "j", "cost"))).alias("edges"))
    # best: for each position the sum so far and where its last word begins; an edge is met after all that end before it
    start = F.transform(F.sequence(F.lit(0), size), lambda p: F.struct(F.when(p == 0, 0.0).alias("sum"), F.lit(0).alias("back")))

    def step(best: Column, e: Column) -> Column:
        total = F.round(F.element_at(best, e["i"])["sum"] + e["cost"], DIGITS)
        there = F.element_at(best, e["j"] + 1)["sum"]
        better = total.isNotNull() & (there.isNull() | (total > there))
        told = F.struct(total.alias("sum"), (e["i"] - 1).alias("back"))
        return F.when(better, F.transform(best, lambda x, p: F.when(p == e["j"], told).otherwise(x))).otherwise(best)

    solved = sorted_.withColumn("best", F.aggregate("edges", start, step))
    # back from the end, as many steps as there are characters
    first = F.struct(size.alias("end"), F.array().cast("array<string>").alias("out"))

    def back(held: Column, _: Column) -> Column:
        begin = F.element_at(F.col("best"), held["end"] + 1)["back"]
        word = F.substring(F.col("run"), begin + 1, held["end"] - begin)
        return F.when(held["end"] == 0, held).otherwise(F.struct(begin.alias("end"), F.concat(F.array(word), held["out"]).alias("out")))

    return solved.select(F.col("run").alias(key), F.aggregate(F.sequence(F.lit(1), size), first, back, lambda held: held["out"]).alias("words"))
