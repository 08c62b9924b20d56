"""The Merkle manifest against a tree that is built whole."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from quarry.llm import merkle as M

H = lambda *x: sha256("".join(x).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        c = out[-1]
        out.append([H(*c[i : i + 3]) for i in range(0, len(c), 3)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run, q = nodes[i // 3 * 3 : i // 3 * 3 + 3], i % 3
        out.append((run[:q], run[q + 1 :]))
        i //= 3
    return out


def brute(rows):
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda d, t, lang, s, n: H(*map(enc, (d, s, lang, n, t)))
    trees = defaultdict(list)
    for row in rows:
        trees[row[3]].append((row[0], leaf(*row), row))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        built[s] = levels_of([x[1] for x in trees[s]])
    top = levels_of([built[s][-1][0] for s in names])
    root = top[-1][0]
    out = []
    for j, s in enumerate(names):
        for i, (d, leaf_, row) in enumerate(trees[s]):
            whole = path(built[s], i) + path(top, j)
            node = leaf_
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0:
                node = leaf(d, row[1] and row[1].replace("\n", ""), *row[2:])
            for a, b in whole:
                node = H(*a, node, *b)
            out.append((d, leaf_, built[s][-1][0], root, H(*(x for a, b in whole for x in (*a, *b))), node, node == root))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, node string")
    got = M.manifest(df)
    assert got.columns == list(M.RESULT)
    key = lambda x: str(tuple(x))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def row(i, source, text="line\nof text"):
    return (i, f"{text} {i}" if text else text, "en", source, i)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_against_brute_force(spark, monkeypatch, levels):
    """Blocks of 3, 9 and 729 leaves; with small ones trees take several rounds."""
    monkeypatch.setattr(M, "LEVELS", levels)
    rows = [row(i, "hot") for i in range(0, 400, 2)] + [row(i, f"s{i % 7}") for i in range(1, 40)] + [row(500, "alone"), row(501, None), row(502, ""), row(503, "é"), row(504, "z")]
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a\nb", None, "s", 3), (None, "a\nb", None, "s", 3), (2, "", "de", "s", 0), (2, "x\ny", "de", "s", 0), (2, "x\ny", "de", "s", 0), (3, "中文\n" * 40_000, "zh", "s", 7), (-4, "\n", "en", "s", -1)]
    check(spark, rows)
    check(spark, rows[:1])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert M.manifest(df).columns == list(M.RESULT) and M.manifest(df).count() == 0


@pytest.mark.parametrize("levels", range(5))
def test_traversal(levels):
    for width in range(1, 3**levels + 1):
        nodes = [H(str(i)) for i in range(width)]
        whole = [nodes]
        for _ in range(levels):
            whole.append([H(*whole[-1][i : i + 3]) for i in range(0, len(whole[-1]), 3)])
        assert M.root_of(nodes, levels) == whole[-1][0]
        assert list(M.traversed(nodes, levels)) == [path(whole, i) for i in range(width)]


def test_memory_of_the_traversal(monkeypatch):
    """Nodes held by all stacks at once grow with the levels, not with the leaves."""
    held, most = {}, []
    step = M.Treehash.step

    def watched(self):
        step(self)
        held[id(self)] = (self, sum(len(c) for _, c in self.stack) + len(self.done))
        live = [n for h, n in held.values() if h.at < h.end or h.done]
        most.append(sum(sorted(live)[-12:]))

    monkeypatch.setattr(M.Treehash, "step", watched)
    for _ in M.traversed([H(str(i)) for i in range(3**6)], 6):
        held = {k: v for k, v in held.items() if v[0].at < v[0].end}
    assert max(most) <= 6 * 6
