"""N-gram Jaccard join with vertical partitioning, and its connected components.

A document's set is its distinct shingles of SIZE words.  Two documents link when
100 * |x & y| >= PERCENT * |x | y|.  The join finds every link between different sets and
counts them for each document; documents of equal sets are one node, one row in all that follows.

1. Global order.  All shingles of all texts are counted in a sketch (two rows of counters, summed over the
   tasks in levels), which grows with the texts within SKETCH_BITS: in a sketch that is too small rare shingles
   look like common ones, prefixes share by chance, and clusters grow together.  The order is (estimate, hash), rare
   shingles first.  An estimate that is off costs time, never a link: any total order gives the same result.
2. Clusters.  If two sets link, their prefixes in the global order share a shingle, and at their
   first common one the rest that is left must still hold enough.  Prefix shingles are dealt by ranges
   of (shingle, size, node), so that a frequent shingle is split over many tasks, and read as a stream.
   The nodes of a shingle are chained: those of few nodes where sizes and positions allow a link, those
   of many, or across the borders of tasks, where sizes allow it.  So each shingle gives fewer edges than
   rows, and linked sets always fall into one component of these edges, their cluster.
3. Overlaps.  Each set of a cluster is cut at the same FRAGMENTS - 1 places of the global order.  A cluster's
   nodes are dealt out in blocks; a task gets two blocks, counts the overlap of every pair of its sets in
   each vertical fragment separately (products of incidence matrices) and sums the parts for each pair.
   So each pair is tested exactly once.  Of the links only stars of the parts that hang together and each
   node's number leave the task: what is emitted grows with the rows and not with the pairs.
4. Components of the links by contraction: each round's edges and map are written to the shared folder.

Sets are 64-bit shingle hashes and a node is named by a 64-bit hash of its set and size.

Defined results: null, empty and wordless texts have no shingles and link with nothing (their
component is their own doc_id); a text of fewer than SIZE words has its whole sequence as one
shingle; repeated rows are one node; a null doc_id never names a component but its text links like
any other (a component of such rows only is null); n_links counts other rows that have an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, dropped, hinted, pieces, ready, written
from quarry.llm.textkernel import LOWER, U, Words, shingle_sets, windows

SIZE = 5
PERCENT = 80
#: Least and most counters of a sketch's row, as powers of two, and bytes of text for each.
SKETCH_BITS, SKETCH_BYTES = (19, 23), 768
FRAGMENTS = 4
#: Of a shingle of more nodes than this only sizes are compared when clusters are made.
FEW = 48
#: Nodes and shingles of a block, on average.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 22
#: Tasks whose sketches are summed in one group.
LEVEL = 256
#: Label of a component without any doc_id.
NOBODY = (1 << 63) - 1


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of sets of a and b shingles that link: 100 i >= p (a + b - i)."""
    return -((-percent * (a + b)) // (100 + percent))


def sketch_bits(docs: DataFrame) -> int:
    """Counters of a row for the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(max((int(size) // SKETCH_BYTES).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])


def narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes each as the greatest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def count_sketch(docs: DataFrame, *, size: int = SIZE, bits: int | None = None) -> np.ndarray:
    """Two rows of 2**bits counters (of 16 bits: what is more counts as the most) over all shingles of all texts; the driver gets just these."""
    bits, part = sketch_bits(docs) if bits is None else bits, 1 << 14

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << bits), dtype=np.uint32)
        for batch in batches:
            for _, texts in pieces(batch):
                hashes, inside = windows(Words([t.translate(LOWER) for t in texts]), size)
                for row, at in enumerate(slots(hashes[inside], bits)):
                    np.add.at(total[row], at, 1)
        flat = total.reshape(-1, part)
        some = np.flatnonzero(flat.any(axis=1))
        for at in range(0, len(some), 64):
            few = some[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), pa.array([narrow(flat[i]) for i in few], pa.binary())], names=["part", "counts"])

    def add(key: tuple, frames: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, dtype=np.int64)
        for x in frames["counts"]:
            total += np.frombuffer(x, dtype=f"u{len(x) // part}").astype(np.int64)
        return pd.DataFrame({"part": [key[0]], "counts": [narrow(total)]})

    parts = docs.select("text").mapInArrow(run, "part int, counts binary")
    near = F.floor(F.spark_partition_id() / LEVEL).cast("int").alias("near")
    parts = parts.select("part", near, "counts").groupBy("part", "near").applyInPandas(add, "part int, counts binary")
    parts = parts.groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros((2 << bits) // part * part, dtype=np.uint16).reshape(-1, part)
    for r in parts.toLocalIterator():
        out[r["part"]] = np.frombuffer(r["counts"], dtype=f"u{len(r['counts']) // part}").astype(np.int64).clip(max=0xFFFF)
    return out.reshape(2, -1)


def slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes >> U(64 - bits)).astype(np.int64), ((hashes >> U(8)) & U((1 << bits) - 1)).astype(np.int64)


def in_order(shingles: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set in the global order, and its estimates."""
    a, b = slots(shingles, int(sketch.shape[1]).bit_length() - 1)
    estimate = np.minimum(sketch[0][a], sketch[1][b])
    order = np.lexsort((shingles, estimate))
    return shingles[order], estimate[order]


def pivots(sketch: np.ndarray, count: int = FRAGMENTS) -> list[tuple[int, np.uint64]]:
    """Places (estimate, hash) of the global order that cut the counted shingles into count nearly equal shares."""
    row = sketch[0]
    bits = int(sketch.shape[1]).bit_length() - 1
    order = np.lexsort((np.arange(len(row)), row))
    mass = np.cumsum(row[order], dtype=np.int64)
    at = np.searchsorted(mass, mass[-1] * np.arange(1, count) // count)
    return [(int(row[order[i]]), U(int(order[i]) << (64 - bits))) for i in at]


def cuts(ordered: np.ndarray, estimate: np.ndarray, places: list[tuple[int, np.uint64]]) -> list[int]:
    """Where the fragments of an ordered set begin and end."""
    out = [0]
    for e, h in places:
        low, high = np.searchsorted(estimate, e, "left"), np.searchsorted(estimate, e, "right")
        out.append(int(low + np.searchsorted(ordered[low:high], h)))
    return [*out, len(ordered)]


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))).astype(np.int64))


def prefixes(docs: DataFrame, sketch: np.ndarray, *, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), node, prefix (the first shingles in the global order)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for rows, texts in pieces(batch):
                sets = shingle_sets([t.translate(LOWER) for t in texts], size)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                keep = np.where(n > 0, n - -((-percent * n) // 100) + 1, 0)
                chosen = [in_order(s, table)[0][:k].view(np.int64) for s, k in zip(sets, keep, strict=True)]
                at = np.concatenate(([0], np.cumsum(keep))).astype(np.int32)
                flat = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
                nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), nodes, pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int64()))], names=["doc_id", "n", "node", "prefix"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, node long, prefix array<long>")


# --- clusters --------------------------------------------------------------------------------


def survivors(n: np.ndarray, node: np.ndarray, place: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes of one shingle a spanning forest of the pairs whose sizes and positions allow a link."""
    rest = n - place
    near = np.minimum(rest[:, None], rest[None, :]) >= needed(n[:, None], n[None, :], percent)
    np.fill_diagonal(near, False)
    edges = np.array(stars(near), dtype=np.int64).reshape(-1, 2)
    return node[edges[:, 0]], node[edges[:, 1]]


def stars(near: np.ndarray) -> list[tuple[int, int]]:
    """For each component of a symmetric adjacency matrix, edges from its first member to each other one."""
    out, todo = [], near.any(axis=1)
    while todo.any():
        root = int(np.argmax(todo))
        reached = [root]
        todo[root] = False
        for x in reached:
            found = np.flatnonzero(near[x] & todo)
            todo[found] = False
            reached.extend(found.tolist())
        out.extend((root, x) for x in reached[1:])
    return out


class Chain:
    """Nodes of one shingle by size as they come: each hangs on the first of similar size."""

    def __init__(self, percent: int) -> None:
        self.percent, self.leader, self.last = percent, None, None

    def add(self, n: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, i = [], [], 0
        while i < len(n):
            if self.leader is None or n[i] * self.percent > 100 * self.leader[0]:
                if self.last is not None and n[i] * self.percent <= 100 * self.last[0]:
                    a.append(np.array([self.last[1]]))
                    b.append(node[i : i + 1])
                self.leader = (int(n[i]), int(node[i]))
            j = i + int(np.searchsorted(n[i:], 100 * self.leader[0] // self.percent, "right"))
            own = node[i:j]
            own = own[own != self.leader[1]]
            a.append(np.full(len(own), self.leader[1]))
            b.append(own)
            self.last = (int(n[j - 1]), int(node[j - 1]))
            i = j
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *a]), np.concatenate([none, *b])


def cluster_edges(nodes: DataFrame, *, percent: int = PERCENT, few: int = FEW) -> DataFrame:
    """a, b: edges between nodes that share a shingle of their prefixes.  nodes: node, n, prefix, one row a node."""
    spark = nodes.sparkSession
    rows = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("place", "token")).select("token", "n", "node", "place")
    dealt = rows.repartitionByRange("token", "n", "node").sortWithinPartitions("token", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        carry = [np.zeros(0, np.int64)] * 4  # rows of a run that may go on
        chain: Chain | None = None  # of a run that is known to be large
        token_of_chain, first, border = None, True, []

        def emit(cols: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal carry, chain, token_of_chain, first
            token, n, node, place = cols
            begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            size = np.diff(np.append(begin, len(token)))
            a, b = [], []
            if first:
                border.append((0, int(token[0]), int(n[0]), int(node[0])))
            big = np.flatnonzero(size > few).tolist()
            goes_on = chain is not None and token[0] == token_of_chain
            # the first and the last run of a partition may go on in another one
            ends = {0} if first or goes_on else set()
            ends |= {len(begin) - 1} if last else set()
            large = sorted({*big, *ends})
            carry = [c[:0] for c in cols]
            done = len(begin)
            if not last:
                done -= 1
                if len(begin) - 1 not in large:
                    carry = [c[begin[-1] :] for c in cols]
            for r in large:
                if r != 0 or not goes_on:
                    chain = Chain(percent)
                    token_of_chain = token[begin[r]]
                x, y = chain.add(n[begin[r] : begin[r] + size[r]], node[begin[r] : begin[r] + size[r]])
                a.append(x)
                b.append(y)
            if not (len(begin) - 1 in large and not last):
                chain = None
            small = np.ones(len(begin), dtype=bool)
            small[large] = False
            small[done:] = False
            two = begin[small & (size == 2)]
            rest = np.minimum(n[two] - place[two], n[two + 1] - place[two + 1])
            two = two[rest >= needed(n[two], n[two + 1], percent)]
            a.append(node[two])
            b.append(node[two + 1])
            for r in np.flatnonzero(small & (size > 2)).tolist():
                here = slice(begin[r], begin[r] + size[r])
                x, y = survivors(n[here], node[here], place[here], percent)
                a.append(x)
                b.append(y)
            if last:
                border.append((1, int(token[-1]), int(n[-1]), int(node[-1])))
            first = False
            yield edges_of(np.concatenate(a), np.concatenate(b))

        def edges_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            low, high = np.minimum(a, b), np.maximum(a, b)
            both = np.unique(np.stack([low, high], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            none = pa.nulls(len(both), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *[none] * 4], names=NAMES)

        for batch in batches:
            cols = [np.concatenate([c, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, c in enumerate(carry)]
            if len(cols[0]) > 1:
                keep = cols
                # one row is held back, so that the end is known when it comes
                yield from emit([c[:-1] for c in keep], False)
                carry = [np.concatenate([c, k[-1:]]) for c, k in zip(carry, keep, strict=True)]
            else:
                carry = cols
        if len(carry[0]):
            yield from emit(carry, True)
        if border:
            side, token, n, node = (pa.array(list(x), pa.int64()) for x in zip(*border, strict=True))
            k = len(border)
            yield pa.RecordBatch.from_arrays([node, pa.nulls(k, pa.int64()), token, n, side, pa.array([partition] * k, pa.int64())], names=NAMES)

    found = written(dealt.mapInArrow(run, ", ".join(f"{x} long" for x in NAMES)), "candidates")
    borders = sorted((r["partition"], r["side"], r["token"], r["n"], r["a"]) for r in found.where("token is not null").collect())  # two rows a task
    joined = [(x[4], y[4]) for x, y in zip(borders, borders[1:]) if x[0] != y[0] and x[2] == y[2] and y[3] * percent <= 100 * x[3]]
    return found.where("token is null").select("a", "b").union(spark.createDataFrame(joined, "a long, b long"))


NAMES = ["a", "b", "token", "n", "side", "partition"]


def contracted(edges: DataFrame) -> DataFrame:
    """node, root: for every node of the edges (a, b) the least node that it hangs together with.

    Each round every node hangs on its least neighbour, ends of edges are renamed to where they hang, and edges
    within one tree and doubles go: few are left after a round.  The rounds' maps are put together at the end.
    """
    left = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    levels = []
    while True:
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        up = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("parent")), "parents")
        levels.append(up)
        told = hinted(up)
        moved = left.join(told.select(F.col("node").alias("a"), F.col("parent").alias("x")), "a").join(told.select(F.col("node").alias("b"), F.col("parent").alias("y")), "b")
        new = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        dropped(left)
        left = new
        if not left.limit(1).count():
            dropped(left)
            break
    out = levels.pop().select("node", F.col("parent").alias("root"))
    for up in reversed(levels):
        further = hinted(out.select(F.col("node").alias("parent"), "root"))
        out = up.join(further, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return out


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label: the least label of the nodes that a node hangs together with.  labels: node, label."""
    roots = written(labels.join(contracted(edges), "node", "left").select("node", "label", F.coalesce("root", "node").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("label").alias("least"))
    return roots.join(hinted(least), "root").select("node", F.col("least").alias("label"))


# --- overlaps --------------------------------------------------------------------------------


def suspects_sets(docs: DataFrame, chosen: DataFrame, sketch: np.ndarray, *, size: int = SIZE, count: int = FRAGMENTS) -> DataFrame:
    """chosen's rows (node, doc_id, ...) with shingles (in the global order, 8 bytes each) and at (where fragments begin), computed again from the texts."""
    places = pivots(sketch, count)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    wanted = hinted(chosen.select(F.col("doc_id").alias("wanted")).distinct())
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, some in pieces(batch):
                sets = [s for s in shingle_sets([t.translate(LOWER) for t in some], size) if len(s)]
                told = [in_order(s, shared.value) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([o.tobytes() for o, _ in told], pa.binary()), pa.array([cuts(o, e, places) for o, e in told], pa.list_(pa.int32()))], names=["node", "shingles", "at"])

    sets = texts.mapInArrow(run, "node long, shingles binary, at array<int>")
    # ids may repeat, with one text or with several
    return sets.join(hinted(chosen.drop("doc_id")), "node").dropDuplicates(["node"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], chunk: int = 1 << 11) -> np.ndarray:
    """Shared shingles of each left set (row) with each right one (column): exact, in parts of at most chunk shingles."""
    flat = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, at = np.unique(flat, return_inverse=True)
    own = row < len(left)
    both = (np.bincount(at[own], minlength=at.max(initial=-1) + 1) > 0) & (np.bincount(at[~own], minlength=at.max(initial=-1) + 1) > 0)
    place = np.cumsum(both) - 1
    shared = both[at]
    row, at, own = row[shared], place[at[shared]], own[shared]
    out = np.zeros((len(left), len(right)), dtype=np.int32)
    total = int(both.sum())
    for c in range(0, total, chunk):
        width = min(chunk, total - c)
        here = (at >= c) & (at < c + width)
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        x[row[here & own], at[here & own] - c] = 1
        y[row[here & ~own] - len(left), at[here & ~own] - c] = 1
        out += (x @ y.T).astype(np.int32)  # whole numbers below 2**24: exact
    return out


def block_links(node: np.ndarray, n: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], at: list[list[int]], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(roots, members) of the stars of all links between two blocks (left and right: places of their rows, the same for one block), and for each row the copies it links with.

    The overlap of every pair is summed over the vertical fragments; once no pair can reach what it needs, the rest is left out.
    """
    same = len(left) == len(right) and bool((left == right).all())
    want = needed(n[left][:, None], n[right][None, :], percent).astype(np.int32)
    found = np.zeros(want.shape, dtype=np.int32)
    rest_left, rest_right = n[left].astype(np.int32), n[right].astype(np.int32)
    for f in range(len(at[0]) - 1):
        ours, theirs = ([sets[x][at[x][f] : at[x][f + 1]] for x in side.tolist()] for side in (left, right))
        found += overlaps(ours, theirs)
        rest_left -= np.array([len(x) for x in ours], dtype=np.int32)
        rest_right -= np.array([len(x) for x in theirs], dtype=np.int32)
        if not (found + np.minimum(rest_left[:, None], rest_right[None, :]) >= want).any():
            break
    link = found >= want
    if same:
        np.fill_diagonal(link, False)
    total = np.zeros(len(n), dtype=np.int64)
    total[left] += link @ copies[right]
    if not same:
        total[right] += link.T @ copies[left]
    near = np.zeros((len(n), len(n)), dtype=bool)
    near[np.ix_(left, right)] = link
    edges = np.array(stars(near if same else near | near.T), dtype=np.int64).reshape(-1, 2)
    return node[edges[:, 0]], node[edges[:, 1]], total


def links(sets: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """Of all links of all clusters: stars (a, b, null), and each node's number (a, null, k).  sets: node, n, copies, cluster, blocks, shingles, at."""
    own = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("own")
    rows = sets.select("cluster", "node", "n", "copies", own, "shingles", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "copies", "shingles", "at")
    dealt = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def solved(key: tuple, rows: list[tuple]) -> list[tuple]:
        own, node, n, copies = (np.array(x, dtype=np.int64) for x in list(zip(*rows, strict=True))[:4])
        sets, at = [np.frombuffer(r[4], dtype=np.uint64) for r in rows], [r[5] for r in rows]
        left, right = np.flatnonzero(own == key[1]), np.flatnonzero(own == key[2])
        if not len(left) or not len(right) or len(node) < 2:
            return []
        roots, members, total = block_links(node, n, copies, sets, at, left, right, percent)
        some = np.flatnonzero(total)
        return [*((a, b, None) for a, b in zip(roots.tolist(), members.tolist(), strict=True)), *((int(node[x]), None, int(total[x])) for x in some)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["a", "b", "k"])

        for batch in batches:
            for c, i, j, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (c, i, j) != key:
                    if held:
                        out += solved(key, held)
                    key, held = (c, i, j), []
                held.append(tuple(row))
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if held:
            out += solved(key, held)
        yield batch_of(out)

    return dealt.mapInArrow(run, "a long, b long, k long")


def join(docs: DataFrame, *, size: int = SIZE, percent: int = PERCENT, count: int = FRAGMENTS, few: int = FEW, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, n, node for each row of docs; node, label of the nodes that have links; node, linked of the same).

    linked: rows with an id of other sets that link with it.
    """
    ready(docs.sparkSession)
    sketch = count_sketch(docs, size=size)
    base = written(prefixes(docs, sketch, size=size, percent=percent), "prefixes")
    edges = cluster_edges(base.where("node is not null").select("node", "n", "prefix").dropDuplicates(["node"]), percent=percent, few=few)
    clusters = contracted(edges).select("node", F.col("root").alias("cluster"))
    named = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("copies"), F.first("n").alias("n"))
    chosen = written(named.join(clusters, "node"), "suspects")

    sizes = chosen.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / block_shingles)).alias("blocks")).where("blocks > 1")
    dealt = chosen.join(hinted(sizes), "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("int"))
    found = written(links(suspects_sets(docs, dealt, sketch, size=size, count=count), percent=percent), "links")
    out = components(found.where("b is not null").select("a", "b"), chosen.select("node", F.coalesce("doc_id", F.lit(NOBODY)).alias("label")))
    linked = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("k").alias("linked"))
    return base.select("doc_id", "n", "node"), out.select("node", F.nullif("label", F.lit(NOBODY)).alias("label")), linked


def classes(docs: DataFrame, *, with_links: bool = True, **options) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs, and with_links also n_links: the other rows with an id that it links with."""
    base, labels, linked = join(docs, **options)
    least = base.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("copies"))
    named = least.join(labels, "node", "left").select("node", "copies", F.coalesce("label", "least").alias("component"))
    told = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")]
    if with_links:
        named = named.join(linked, "node", "left")
        alike = F.col("copies") - F.col("doc_id").isNotNull().cast("long")
        told.append((F.coalesce("linked", F.lit(0)) + F.coalesce(alike, F.lit(0))).alias("n_links"))
    return base.join(named, "node", "left").select(*told)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir), with_links=False)


def op2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 with n_links, which its SQL does not have."""
    return classes(documents(spark, sf_dir))
