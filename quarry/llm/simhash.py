"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint has a bit for each bit of a 64-bit hash (XXH64, seed SEED) of its shingles of SIZE words,
repeats included: 1 where over half of the hashes have it.  Fingerprints link at THRESHOLD or fewer differing bits.

1. Anchors.  The perfect Golay code [23, 12] puts every 23-bit word within RADIUS = 3 of exactly one codeword.  The
   fingerprint is cut into SEGMENTS pieces of 23 bits (the last filled with zeros) and the anchors are all sequences
   of codewords: a covering code whose radius is RADIUS in each piece.
2. Replication.  Let y differ from x by e_k bits in piece k, sum of e_k at most THRESHOLD.  The anchor of x is within
   RADIUS + e_k of y in piece k.  So every fingerprint goes to all anchors that it reaches with radius RADIUS plus
   a threshold of THRESHOLD spread over the pieces: 118 on average for three pieces (61 for two pieces, where the
   other bits play no part), and any two that link meet at both of their own anchors.
3. Comparison.  Rows are dealt by anchor and read as a stream.  At an anchor those that have it as their own are
   compared with all that came; of the links only a spanning forest leaves the task, never the pairs.  More than
   LARGE fingerprints at one anchor leave the task as they are: each goes to the 65 words that are within one bit of
   it, where two of them meet if and only if they differ by two bits or fewer, so no group holds more than 65.
4. Components of these links by contraction, all in tables; every document of a fingerprint has its component.

Only different fingerprints are compared, one row each, however many documents share one.  Two pieces are used for
up to FEW fingerprints, else three: anchors are few or many, the links are the same (any number of pieces is exact).

Defined results: null, empty and wordless texts have fingerprint zero, which links like any other; a text of fewer
than SIZE words has its whole sequence as one shingle; rows without an id have a fingerprint and link, but never
name a component (one of such rows only is null); repeated rows count as one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, pieces, ready, written
from quarry.llm.jaccard import NOBODY, components, stars
from quarry.llm.textkernel import LOWER, U

SIZE, SEED, THRESHOLD = 3, 42, 2
#: The code: length, dimension, covering radius, and its generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
LENGTH, DIMENSION, RADIUS, GENERATOR = 23, 12, 3, 0b101011100011
SEGMENTS, FEW = 3, 1 << 23
#: Fingerprints of one anchor that are compared in one task; shingles that are hashed at once; rows of a batch.
LARGE, CHUNK, ROWS = 1 << 17, 1 << 15, 1 << 17


# --- fingerprints ----------------------------------------------------------------------------


def fingerprint(text: bytes, size: int = SIZE, seed: int = SEED) -> int:
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words)))
    width = min(size, len(words))
    first = np.concatenate(([0], ends[: len(words) - width])).tolist()
    last = (ends[width - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), CHUNK):
        some = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """doc_id, print (signed 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in pieces(batch):
                found = np.array([fingerprint(t, size, seed) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found)], names=["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, print long")


# --- the code --------------------------------------------------------------------------------


def remainder(words: np.ndarray) -> np.ndarray:
    """Words modulo the generator polynomial: their syndrome, 0 for a codeword."""
    out = words.astype(np.int64)
    for bit in range(LENGTH - 1, LENGTH - DIMENSION - 1, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - (LENGTH - DIMENSION))), out)
    return out


@cache
def cosets(threshold: int = THRESHOLD) -> list[np.ndarray]:
    """For e = 0 .. threshold a table: for each syndrome the words of weight RADIUS + e (for e = 0: up to RADIUS) that have it, filled up with -1."""
    words = np.arange(1 << LENGTH, dtype=np.int64)
    weight = np.bitwise_count(words)
    out = []
    for e in range(threshold + 1):
        some = words[weight <= RADIUS] if e == 0 else words[weight == RADIUS + e]
        syndrome = remainder(some)
        order = np.argsort(syndrome, kind="stable")
        some, syndrome = some[order], syndrome[order]
        count = np.bincount(syndrome, minlength=1 << (LENGTH - DIMENSION))
        table = np.full((len(count), count.max()), -1, dtype=np.int64)
        table[syndrome, np.arange(len(some)) - np.repeat(np.cumsum(count) - count, count)] = some
        out.append(table)
    return out


def spreads(segments: int, threshold: int) -> list[tuple[int, ...]]:
    """All ways to spread up to threshold over the pieces."""
    out = [()]
    for _ in range(segments):
        out = [(*x, e) for x in out for e in range(threshold - sum(x) + 1)]
    return out


def cut(prints: np.ndarray, segments: int) -> list[np.ndarray]:
    return [((prints >> U(LENGTH * k)) & U((1 << LENGTH) - 1)).astype(np.int64) for k in range(segments)]


def named(codewords: list[np.ndarray]) -> np.ndarray:
    """One number for a sequence of codewords: the code is systematic, so the upper bits of each say which it is."""
    out = codewords[0] >> (LENGTH - DIMENSION)
    for c in codewords[1:]:
        out = out << DIMENSION | c >> (LENGTH - DIMENSION)
    return out


def own_anchor(prints: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    table = cosets(THRESHOLD)[0]
    return named([w ^ table[remainder(w), 0] for w in cut(prints, segments)])


def reached(prints: np.ndarray, segments: int = SEGMENTS, threshold: int = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchors, places of the prints that reach them), each pair once, in parts."""
    tables = cosets(threshold)
    words = cut(prints, segments)
    syndromes = [remainder(w) for w in words]
    for spread in spreads(segments, threshold):
        place = np.arange(len(prints))
        chosen: list[np.ndarray] = []
        for k, e in enumerate(spread):
            table = tables[e][syndromes[k][place]]
            row, column = np.nonzero(table >= 0)
            chosen = [c[row] for c in chosen]
            chosen.append(words[k][place[row]] ^ table[row, column])
            place = place[row]
        if len(place):
            yield named(chosen), place


# --- comparison ------------------------------------------------------------------------------


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For the edges a - b between n places the least place that each hangs together with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def met(prints: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between many prints, through the words within one bit of them; at most about most words at once."""
    flips = np.concatenate(([U(0)], U(1) << np.arange(64, dtype=np.uint64)))
    rounds = -(-len(prints) * len(flips) // most)
    label = np.arange(len(prints))
    for r in range(rounds):
        words, owner = [], []
        for flip in flips:
            word = prints ^ flip
            mine = np.flatnonzero((word * U(0x9E3779B97F4A7C15) >> U(40)) % U(rounds) == r)
            words.append(word[mine])
            owner.append(mine)
        word, own = np.concatenate(words), np.concatenate(owner)
        order = np.argsort(word, kind="stable")
        word, own = word[order], own[order]
        same = np.flatnonzero(word[1:] == word[:-1])
        tops = roots_of(np.concatenate([own[same], np.arange(len(prints))]), np.concatenate([own[same + 1], label]), len(prints))
        label = tops
    some = np.flatnonzero(label != np.arange(len(prints)))
    return prints[label[some]], prints[some]


def compared(own: np.ndarray, others: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of an anchor's own prints among themselves and with the others."""
    every = np.concatenate([own, others])
    if len(own) * len(every) > 1 << 20 and threshold == 2:
        return met(every)
    near = np.zeros((len(every), len(every)), dtype=bool) if len(every) <= 64 else None
    link = np.bitwise_count(own[:, None] ^ every[None, :]) <= threshold
    if near is not None:
        near[: len(own)] = link
        near |= near.T
        np.fill_diagonal(near, False)
        edges = np.array(stars(near), dtype=np.int64).reshape(-1, 2)
        return every[edges[:, 0]], every[edges[:, 1]]
    a, b = np.nonzero(link)
    label = roots_of(a, b, len(every))
    some = np.flatnonzero(label != np.arange(len(every)))
    return every[label[some]], every[some]


def links(prints: DataFrame, *, segments: int = SEGMENTS, threshold: int = THRESHOLD, large: int = LARGE) -> DataFrame:
    """a, b: links that hold the same components as all links of the distinct prints (column print)."""

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 1 << 12):
                some = whole[at : at + (1 << 12)]
                for anchor, place in reached(some, segments, threshold):
                    for k in range(0, len(anchor), ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[k : k + ROWS]), pa.array(some[place[k : k + ROWS]].view(np.int64))], names=["anchor", "print"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor_held, held, told = None, [], False

        def out(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
            b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b], names=["a", "b"])

        def solved(anchors: np.ndarray, some: np.ndarray) -> pa.RecordBatch:
            """Whole anchors, in order."""
            mine = own_anchor(some, segments) == anchors
            begin = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
            size = np.diff(np.append(begin, len(anchors)))
            n_own = np.add.reduceat(mine.astype(np.int64), begin)
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            two = begin[(size == 2) & (n_own > 0)]  # most of them
            near = np.bitwise_count(some[two] ^ some[two + 1]) <= threshold
            a.append(some[two[near]])
            b.append(some[two[near] + 1])
            for i in np.flatnonzero((size > 2) & (n_own > 0)).tolist():
                here = slice(begin[i], begin[i] + size[i])
                x, y = compared(some[here][mine[here]], some[here][~mine[here]], threshold)
                a.append(x)
                b.append(y)
            return out(np.concatenate(a), np.concatenate(b))

        for batch in batches:
            anchors = batch.column(0).to_numpy(zero_copy_only=False)
            some = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(anchors):
                continue
            if told and anchors[0] == anchor_held:  # a large anchor goes on
                end = int(np.searchsorted(anchors, anchor_held, "right"))
                yield out(some[:end], None)
                anchors, some = anchors[end:], some[end:]
                if not len(anchors):
                    continue
            if held:
                anchors, some = np.concatenate([held[0], anchors]), np.concatenate([held[1], some])
            held, told = [], False
            last = int(np.searchsorted(anchors, anchors[-1]))
            if last:
                yield solved(anchors[:last], some[:last])
            anchors, some, anchor_held = anchors[last:], some[last:], anchors[-1]
            if len(anchors) > large:
                yield out(some, None)
                told = True
            else:
                held = [anchors, some]
        if held:
            yield solved(*held)

    rows = prints.select("print").mapInArrow(replicate, "anchor long, print long")
    dealt = rows.repartition("anchor").sortWithinPartitions("anchor")
    found = written(dealt.mapInArrow(compare, "a long, b long"), "links")
    left = found.where("b is null").select("a").distinct()
    if not left.limit(1).count():
        return found
    # beyond what one task compares: words within one bit, each with at most 65 prints
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)))
    words = left.select("a", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("a")))).alias("word"))
    groups = words.groupBy("word").agg(F.min("a").alias("least"), F.collect_list("a").alias("those")).where(F.size("those") > 1)
    stars_of = groups.select(F.col("least").alias("a"), F.explode("those").alias("b")).where("a <> b").distinct()
    return found.where("b is not null").union(stars_of)


def classes(docs: DataFrame, *, size: int = SIZE, seed: int = SEED, segments: int | None = None, large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    ready(docs.sparkSession)
    base = written(fingerprints(docs, size=size, seed=seed), "fingerprints")
    least = written(base.groupBy("print").agg(F.coalesce(F.min("doc_id"), F.lit(NOBODY)).alias("label")).select(F.col("print").alias("node"), "label"), "prints")
    few = least.count() <= FEW
    edges = links(least.select(F.col("node").alias("print")), segments=segments or (2 if few else 3), large=large)
    joined = components(edges, least).select(F.col("node").alias("print"), F.nullif("label", F.lit(NOBODY)).alias("component_id"))
    return base.join(joined, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
