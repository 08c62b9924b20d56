"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of WINDOW consecutive words of the benchmark items; an item of fewer words
is one shorter window.  The alphabet of the search is words, so a block of two words takes the place
of Wu and Manber's block of characters: a shift table over blocks tells how far the search may jump,
a block that ends a pattern leads to a bucket by the hash of its suffix, split by the hash of its
first words, and direct comparison with the bucket's patterns confirms an occurrence.  Windows of
one length share tables; each shorter length has its own.

Defined results: a null or wordless text has 0 words and is clean; a null or wordless item has no
window; items with a null item_id are left out; repeated items count once.  The benchmark is read in
blocks of at most BLOCK_BYTES of text.  Each block is one broadcast of proven size and one pass over the
documents; of STAGE passes at a time one stage is made, and what they found is written before the next, so
that a stage's workers and a driver's broadcasts stay few.  Documents are never shuffled.  Cost grows with
documents times blocks: this search is for benchmarks of up to some hundred MB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, free, pieces, written

WINDOW = 10
BLOCK_BYTES = 8 << 20
#: Blocks that are searched in one stage.
STAGE = 4
#: ASCII lower-casing, and every byte that is no word character becomes a space.
WORD_BYTES = bytes(b if b in b"0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Tables:
    """Shift table and buckets for patterns of one length m."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], m: int) -> None:
        self.m = m
        self.block = min(2, m)
        self.default = m - self.block + 1
        #: last word of a block -> first word of the block -> shift; for m = 1 the first word is empty.
        self.shift: dict[bytes, dict[bytes, int]] = {}
        #: suffix block -> first two words -> [(pattern, items)]
        self.buckets: dict[tuple[bytes, bytes], dict[tuple[bytes, ...], list[tuple[list[bytes], list[int]]]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block - 1, m):
                first = pattern[end - 1] if self.block == 2 else b""
                row = self.shift.setdefault(pattern[end], {})
                row[first] = min(row.get(first, self.default), m - 1 - end)
            suffix = (pattern[-2] if self.block == 2 else b"", pattern[-1])
            self.buckets.setdefault(suffix, {}).setdefault(pattern[:2], []).append((list(pattern), items))

    def search(self, words: list[bytes], starts: list[tuple[int, int]], items: set[int]) -> None:
        """Adds the [start, end) of each occurrence and its items."""
        m, default, pair, head = self.m, self.default, self.block == 2, min(2, self.m)
        get, n, i = self.shift.get, len(words), self.m - 1
        while i < n:
            row = get(words[i])
            if row is None:  # in no pattern at any place that a block may end at
                i += default
                continue
            before = words[i - 1] if pair else b""
            shift = row.get(before, default)
            if shift:
                i += shift
                continue
            begin = i - m + 1
            for pattern, owners in self.buckets[before, words[i]].get(tuple(words[begin : begin + head]), ()):
                if words[begin : i + 1] == pattern:
                    starts.append((begin, i + 1))
                    items.update(owners)
            i += 1


def tables(items: list[tuple[int, bytes]], size: int) -> list[Tables]:
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        words = words_of(text)
        m = min(size, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners = by_length.setdefault(m, {}).setdefault(tuple(words[i : i + m]), [])
            if item not in owners[-1:]:
                owners.append(item)
    return [Tables(patterns, m) for m, patterns in by_length.items()]


def blocks(benchmark: DataFrame, limit: int) -> list[DataFrame]:
    """The benchmark's rows in groups by hash, each of about limit bytes at most."""
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // limit) + 1
    return [rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rows]


def find(docs: DataFrame, benchmark: DataFrame, *, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """doc_id, the columns keep, n_words, hits (array of the merged [start, end) word ranges) and items (sorted ids), in this order; the three names begin with prefix and get a trailing _ where docs has them."""
    n_words, hits_, items_ = (free(prefix + x, docs.columns) for x in ("n_words", "hits", "items"))
    spark = docs.sparkSession
    kept = [c for c in dict.fromkeys((*keep, "text")) if c != "doc_id"]
    out = docs.select("doc_id", *kept, F.lit(0).cast("long").alias(n_words), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias(hits_), F.expr("cast(array() as array<bigint>)").alias(items_))
    schema = out.schema
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    for number, block in enumerate(blocks(benchmark, block_bytes)):
        if number and number % STAGE == 0:
            out = written(out, "hits")
        have = [(r["item_id"], r["text"].encode("utf-8", "surrogatepass")) for r in block.toLocalIterator()]
        shared = spark.sparkContext.broadcast(have)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = tables(shared.value, size)
            for batch in batches:
                for rows, texts in pieces(batch):
                    n = rows.num_columns
                    counts, hits, found = [], [], []
                    for text, old, known in zip(texts, rows.column(n - 2).to_pylist(), rows.column(n - 1).to_pylist(), strict=True):
                        words = words_of(text)
                        spans, items = [(x["start"], x["end"]) for x in old], set(known)
                        for t in search:
                            t.search(words, spans, items)
                        counts.append(len(words))
                        hits.append(merged(spans))
                        found.append(sorted(items))
                    columns = [*rows.columns[: n - 3], pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], hit_type), pa.array(found, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

        out = out.mapInArrow(run, schema)
    return out if "text" in keep else out.drop("text")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def digest(found: DataFrame) -> DataFrame:
    n_words, hits, items = found.columns[-3:]
    n_hit = F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(n_words).alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


__all__ = ["digest", "find", "op4", "tables", "words_of"]
