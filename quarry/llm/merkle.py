"""Merkle manifest of a dataset: a tree for each source, one above the sources, and a proof for every row.

1. Leaves are digests of rows (SQL functions; the text goes no further than its own task).
2. Places.  Leaves are sorted by (tree, order) in range partitions and written; a partition's counts by tree, summed
   over the partitions before it, turn places in a partition into places in the tree.  No tree is gathered: a hot
   source is as many partitions as its rows need.
3. Blocks.  FAN ** LEVELS neighbouring leaves are an aligned block: a subtree of its own.  Blocks are folded to
   their roots, these are the leaves of the next round, until each tree has one node; the sources' roots are the
   leaves of one more tree, in the same way.
4. Traversal, from the top down.  A task gets one block and the path above it, which all of its leaves share.  It walks the
   leaves from left to right and keeps for each level the siblings of the current node (the authentication path).
   The siblings of the next run of a level are made by a treehash stack of that level while the walk passes through
   the present run; of the stacks that are not done the one whose lowest node is lowest gets the next leaf, so that
   all of them together hold a number of nodes that grows with the block's levels, not with its leaves.  After a
   block's own path comes the shared one.  From both the row's proof is made and folded at once, so that no path
   is ever shuffled with a row.

H is lowercase hex sha256 of the concatenation of its inputs; digests are concatenated as hex text.

Defined results: fields that are null are '-' in a leaf; a null doc_id stands before all others and is not tampered
with; rows that repeat an id stand in the order of their leaves, so that equal rows have interchangeable places;
a null source is a tree of its own, before ''; a lone leaf is its tree's root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import documents, hinted, ready, written

#: Children of a node, and levels of a block.
FAN, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and tampered: the leaf of what a row holds after tampering, else null."""
    columns = {c: F.col(c) for c in FIELDS}
    made = lambda text: F.sha2(F.concat(*(field(text if c == "text" else x) for c, x in columns.items())).cast("binary"), 256)
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), made(F.col("text")).alias("leaf"), F.when(odd, made(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered"))


# --- places ----------------------------------------------------------------------------------


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with place (from 0) and total in their tree, in the order of these columns."""
    dealt = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    # a row number holds the number of its partition; both are fixed by writing them
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()), "sorted").withColumn("part", F.shiftright("at", 33))
    here = dealt.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    of_tree = Window.partitionBy(tree)  # a row for each partition that holds some of a tree
    before = F.sum("n").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    counted = written(here.select(tree, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(of_tree).alias("total")), "places")
    return dealt.join(hinted(counted), [tree, "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


# --- one block -------------------------------------------------------------------------------


class Treehash:
    """Makes the nodes lo + 1 .. of one run of a level, leaf by leaf, on a stack."""

    def __init__(self, level: int, first: int, last: int, leaves: list[str], width: int) -> None:
        self.level, self.at, self.end, self.leaves, self.width = level, first, min(last, width), leaves, width
        #: Nodes not yet folded: (level, children so far).
        self.stack: list[list] = []
        self.done: list[str] = []

    def low(self) -> int:
        """Level of the lowest node on the stack; the stack's own level while it is empty."""
        return self.stack[-1][0] if self.stack else self.level

    def step(self) -> None:
        """One leaf, and all nodes that it completes."""
        node, level = self.leaves[self.at], 0
        self.at += 1
        span = 1
        while level < self.level:
            if self.stack and self.stack[-1][0] == level:
                self.stack[-1][1].append(node)
            else:
                self.stack.append([level, [node]])
            span *= FAN
            if self.at % span and self.at < self.width:
                return
            node, level = digest(self.stack.pop()[1]), level + 1
        self.done.append(node)


def root_of(nodes: list[str], levels: int) -> str:
    """The node so many levels above a block's leaves."""
    hashed = Treehash(levels, 0, len(nodes), nodes, len(nodes))
    while hashed.at < hashed.end:
        hashed.step()
    return hashed.done[0]


def traversed(nodes: list[str], levels: int) -> Iterator[list[tuple[list[str], list[str]]]]:
    """For each leaf of a block its path: for each level the siblings on the left and on the right."""
    width = len(nodes)
    spans = [FAN**k for k in range(levels + 1)]

    def run_of(k: int, first: int) -> Treehash:
        """The nodes of level k from this leaf on to the end of their run."""
        return Treehash(k, first, (first // spans[k + 1] + 1) * spans[k + 1], nodes, width)

    def finished(hashed: Treehash) -> list[str]:
        while hashed.at < hashed.end:
            hashed.step()
        return hashed.done

    # The first path: all nodes of the first run of each level but the leftmost one, to which the walk comes first.
    right = [finished(run_of(k, spans[k])) if spans[k] < width else [] for k in range(levels)]
    left: list[list[str]] = [[] for _ in range(levels)]
    # The next run's nodes; its leftmost is left out as well, the walk comes to it from below.
    ahead = [run_of(k, spans[k + 1] + spans[k]) if spans[k + 1] + spans[k] < width else None for k in range(levels)]
    for leaf in range(width):
        yield [(list(left[k]), list(right[k])) for k in range(levels)]
        # Schedule: each of the stacks needs FAN - 1 of FAN leaves of its pace; the lowest one is served first.
        for _ in range(levels):
            busy = [h for h in ahead if h is not None and h.at < h.end]
            if not busy:
                break
            min(busy, key=lambda h: (h.low(), h.level)).step()
        nxt, node = leaf + 1, nodes[leaf]
        if nxt >= width:
            return
        for k in range(levels):
            # the walk has left the node of level k that ends here
            if nxt % spans[k + 1]:
                left[k].append(node)
                right[k] = right[k][1:]
                break
            node = digest([*left[k], node])
            hashed = ahead[k]
            left[k], right[k] = [], finished(hashed) if hashed else []
            first = nxt + spans[k + 1] + spans[k]
            ahead[k] = run_of(k, first) if first < width else None


# --- trees -----------------------------------------------------------------------------------


def levels_of(total: Column) -> Column:
    """How far a block of a tree of so many leaves is folded: to one node if it is the only block, else LEVELS."""
    out = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        out = F.when(total <= FAN**k, F.lit(k)).otherwise(out)
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """rows (tree, place, total, ...) with their block and the levels that it is folded by."""
    return rows.withColumn("block", F.floor(F.col("place") / FAN**LEVELS)).withColumn("levels", levels_of(F.col("total")).cast("int"))


def raised(rows: DataFrame) -> DataFrame:
    """tree, place, total, node of the next round.  rows: tree, place, total, node."""

    def fold(table: pa.Table) -> pa.Table:
        some = table.sort_by("place")
        first = some.slice(0, 1)
        root = root_of(some["node"].to_pylist(), first["levels"][0].as_py())
        total = -(-first["total"][0].as_py() // FAN**LEVELS)
        return pa.table({"tree": pa.array([first["tree"][0].as_py()], pa.string()), "place": pa.array([first["block"][0].as_py()], pa.int64()), "total": pa.array([total], pa.int64()), "node": pa.array([root], pa.string())})

    out = blocks(rows.select("tree", "place", "total", "node")).groupBy("tree", "block").applyInArrow(fold, "tree string, place long, total long, node string")
    return written(out, "nodes")


def rounds(rows: DataFrame) -> list[DataFrame]:
    """The nodes of each round: leaves first, one node a tree last."""
    out = [rows, raised(rows)]
    while out[-1].where("total > 1").limit(1).count():
        out.append(raised(out[-1]))
    return out


PATH = "array<struct<left:array<string>,right:array<string>>>"


def lowered(rows: DataFrame, above: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """What finish makes of a block's rows, their whole paths and the row of above.  above: tree, place, path, ... of the blocks."""

    def walk(key: tuple, table: pa.Table, told: pa.Table) -> pa.Table:
        some = table.sort_by("place")
        nodes = some["node"].to_pylist()
        shared = [(x["left"], x["right"]) for x in told["path"][0].as_py()]
        paths = ([*own, *shared] for own in traversed(nodes, some["levels"][0].as_py()))
        return finish(some, paths, told)

    upper = above.withColumnRenamed("place", "block")
    return blocks(rows).groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(walk, schema)


def with_path(some: pa.Table, paths: Iterator, told: pa.Table) -> pa.Table:
    kind = pa.list_(pa.struct([("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))
    told = [[{"left": a, "right": b} for a, b in path] for path in paths]
    return pa.table({"tree": some["tree"].cast(pa.string()), "place": some["place"], "path": pa.array(told, kind)})


def proven(some: pa.Table, paths: Iterator, told: pa.Table, root: str) -> pa.Table:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proofs, folded = [], []
    for path, leaf, changed in zip(paths, some["node"].to_pylist(), some["tampered"].to_pylist(), strict=True):
        node, siblings = changed or leaf, []
        for left, right in path:
            siblings += [*left, *right]
            node = digest([*left, node, *right])
        proofs.append(digest(siblings))
        folded.append(node)
    same = pa.array([x == root for x in folded], pa.bool_())
    subroot = told["subroot"][0].as_py()
    columns = [some["doc_id"], some["node"].cast(pa.string()), pa.array([subroot] * len(folded), pa.string()), pa.array([root] * len(folded), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), same]
    return pa.table(columns, names=list(RESULT))


RESULT = {"doc_id": "long", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}


def paths_down(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """tree, place, path of the nodes of the first of these rounds.  top: the same of the last one, a node a tree."""
    out = top
    for rows in reversed(levels[:-1]):
        out = written(lowered(rows, out, with_path, f"tree string, place long, path {PATH}"), "paths")
    return out


def manifest(docs: DataFrame) -> DataFrame:
    ready(docs.sparkSession)
    # a tree's name is never null, and '' comes before '+', before all names that are given
    named = leaves(docs).select("doc_id", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("tree"), F.col("leaf").alias("node"), "tampered")
    rows = placed(written(named, "leaves"), "tree", "doc_id", "node")  # sorting reads its rows twice
    if not rows.limit(1).count():
        return rows.sparkSession.createDataFrame([], ", ".join(f"{k} {t}" for k, t in RESULT.items()))
    trees = rounds(rows)
    # the sources' roots are the leaves of one tree
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node")
    sources = written(placed(roots, "tree", "source"), "subroots")
    above = rounds(sources.select("tree", "place", "total", "node"))
    root = above[-1].head()["node"]
    none = F.array().cast(PATH)
    source_paths = paths_down(above, above[-1].select("tree", "place", none.alias("path")))
    tops = sources.join(source_paths.select("place", "path"), "place").select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("node").alias("subroot"))
    tops = written(tops, "tops")
    block_paths = paths_down(trees[1:], tops.select("tree", "place", "path"))
    told = block_paths.join(hinted(tops.select("tree", "subroot")), "tree")
    return lowered(rows, told, partial(proven, root=root), ", ".join(f"{k} {t}" for k, t in RESULT.items()))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


OP13_SQL = r"""
WITH RECURSIVE f AS (SELECT doc_id, source, text, (CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END)
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head FROM documents),
bytes AS (SELECT *, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM f),
crc AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x:
    list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc FROM bytes),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS tampered FROM crc),
p AS (SELECT *, coalesce('+' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS total FROM l),
lv(tree, k, place, total, node) AS (SELECT tree, 0, place, total, leaf FROM p
  UNION ALL SELECT tree, k + 1, place // 3, (total + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM lv WHERE total > 1 GROUP BY tree, k, place // 3, total),
sub AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place, count(*) OVER () AS total FROM lv WHERE total = 1),
up(k, place, total, node) AS (SELECT 0, place, total, subroot FROM sub
  UNION ALL SELECT k + 1, place // 3, (total + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM up WHERE total > 1 GROUP BY k, place // 3, total),
r AS (SELECT node AS root FROM up WHERE total = 1),
runs AS (SELECT tree, k, place // 3 AS run, list(node ORDER BY place) AS nodes FROM lv WHERE total > 1 GROUP BY tree, k, place // 3
  UNION ALL SELECT NULL, k, place // 3, list(node ORDER BY place) FROM up WHERE total > 1 GROUP BY k, place // 3),
w(n, doc_id, leaf, tree, k, place, node, siblings) AS (SELECT row_number() OVER (), doc_id, leaf, tree, 0, place, coalesce(tampered, leaf), '' FROM p
  UNION ALL SELECT n, doc_id, leaf, w.tree, w.k + 1, place // 3, sha256(array_to_string(nodes[:place % 3], '') || node || array_to_string(nodes[place % 3 + 2:], '')),
    siblings || array_to_string(nodes[:place % 3], '') || array_to_string(nodes[place % 3 + 2:], '') FROM w JOIN runs ON runs.tree = w.tree AND runs.k = w.k AND runs.run = w.place // 3),
own AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY n ORDER BY k DESC) = 1),
v(n, doc_id, leaf, subroot, k, place, node, siblings) AS (SELECT n, doc_id, leaf, subroot, 0, sub.place, node, siblings FROM own JOIN sub USING (tree)
  UNION ALL SELECT n, doc_id, leaf, subroot, v.k + 1, place // 3, sha256(array_to_string(nodes[:place % 3], '') || node || array_to_string(nodes[place % 3 + 2:], '')),
    siblings || array_to_string(nodes[:place % 3], '') || array_to_string(nodes[place % 3 + 2:], '') FROM v JOIN runs ON runs.tree IS NULL AND runs.k = v.k AND runs.run = v.place // 3),
whole AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY n ORDER BY k DESC) = 1)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified FROM whole, r
"""
