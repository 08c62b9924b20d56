"""The n-gram Jaccard join loses no link, in small and in large groups."""

import random
import re

import pytest

from quarry.llm import jaccard as J


def near_copies(n, size, edits, seed):
    r = random.Random(seed)
    base = [f"w{r.randrange(10_000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(size)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"\S+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return [sum(1 for j, b in enumerate(sets) if i != j and rows[j][0] is not None and a and b and 100 * len(a & b) >= 80 * len(a | b)) for i, a in enumerate(sets)]


def brute_components(rows):
    """Smallest id reachable, through rows without an id too."""
    sets = []
    for _, t in rows:
        w = re.findall(r"\S+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = [r[0] if r[0] is not None else 1 << 62 for r in rows]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)] for i, a in enumerate(sets)]
    # a repeated id is one document: its rows share a name, not their links
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if new == label:
            return [None if x == 1 << 62 else x for x in label]
        label = new


@pytest.mark.parametrize("few", [2, 10, 48])
def test_every_link_is_counted(spark, few):
    texts = near_copies(60, 120, 6, 1) + near_copies(25, 60, 2, 2) + near_copies(12, 9, 1, 3) + [None, "", "a b", "A  b"] + near_copies(1, 80, 0, 5) * 7
    random.Random(4).shuffle(texts)
    rows = [(None if i == 3 else i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_links) for r in J.classes(df, few=few, block=8).collect())
    assert got == sorted((-1 if i is None else i, k) for (i, _), k in zip(rows, brute_links(rows)))


def near_below(n, seed):
    """Pairs of texts just below the threshold, each with a tail of its own."""
    out = []
    for k in range(n):
        w = [f"b{seed}x{k}x{i}" for i in range(28)]
        out += [" ".join(w), " ".join([*w[:-3], "t1", "t2", f"t{k}"])]
    return out


def test_repeated_rows_give_no_false_links(spark):
    texts = near_below(40, 1)
    rows = [(i, t) for i, t in enumerate(texts)] * 2
    got = sorted(map(tuple, J.classes(spark.createDataFrame(rows, "doc_id long, text string"), with_links=False).select("doc_id", "component_id").collect()))
    assert got == sorted(zip([r[0] for r in rows], brute_components(rows)))
    assert all(a == b for a, b in got)


def test_rows_without_an_id_are_bridges(spark):
    words = [f"w{i}" for i in range(64)]
    left = ["x", *words[1:5], "x5", *words[6:]]
    a, n, b = " ".join(words), " ".join(left), " ".join([*left[:-6], "y5", *left[-5:-1], "y"])
    rows = [(1, a), (None, n), (2, b), (3, b + " z"), (None, "alone " * 3), (None, "only null ids here and there a"), (None, "only null ids here and there a")]
    got = sorted((str(r.doc_id), str(r.component_id), r.n_links) for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [(str(i), str(c), k) for (i, _), c, k in zip(rows, brute_components(rows), brute_links(rows))]
    assert got == sorted(want) and ("2", "1", 1) in got


def test_an_id_of_two_texts_keeps_both(spark):
    texts = near_copies(10, 60, 2, 8) + near_copies(10, 60, 2, 9)
    rows = [(i % 10, t) for i, t in enumerate(texts)]
    got = sorted((r.doc_id, r.n_links) for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, k) for (i, _), k in zip(rows, brute_links(rows)))


def test_long_texts_and_many_partitions(spark):
    """Runs across the borders of tasks, blocks of few shingles, one very long text and a copy of it with an edit."""
    long = near_copies(1, 30_000, 0, 11)[0].split()
    texts = near_copies(150, 90, 3, 12) + [" ".join(long), " ".join(["edit", *long[1:]])]
    rows = list(enumerate(texts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = sorted((r.doc_id, r.component_id, r.n_links) for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(9), few=5, block=40, block_shingles=2000).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == [(i, c, k) for (i, _), c, k in zip(rows, brute_components(rows), brute_links(rows))]


def test_fragments_cut_the_global_order():
    import numpy as np

    r = np.random.default_rng(3)
    sketch = r.integers(1, 9, (2, 1 << 10)).astype(np.int32)
    places = J.pivots(sketch, 4)
    a, b = (np.unique(r.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(2))
    b[:250] = a[:250]
    b = np.unique(b)
    (x, ex), (y, ey) = J.in_order(a, sketch), J.in_order(b, sketch)
    cx, cy = J.cuts(x, ex, places), J.cuts(y, ey, places)
    parts = [np.intersect1d(x[cx[f] : cx[f + 1]], y[cy[f] : cy[f + 1]]).size for f in range(4)]
    assert sum(parts) == np.intersect1d(a, b).size and all(parts)


def test_the_sketch_grows_with_the_texts(spark, monkeypatch):
    r = random.Random(9)
    rows = list(enumerate(near_copies(30, 80, 4, 7) + [" ".join(f"w{r.randrange(10_000)}" for _ in range(400)) for _ in range(60)]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert J.sketch_bits(df) == J.SKETCH_BITS[0] and J.sketch_bits(df.where("false")) == J.SKETCH_BITS[0]
    monkeypatch.setattr(J, "SKETCH_BITS", (14, 17))
    monkeypatch.setattr(J, "SKETCH_BYTES", 4)
    assert J.sketch_bits(df) in (15, 16)
    sketch = J.count_sketch(df)
    shingles = sum(len(t.split()) - 4 for _, t in rows)
    assert sketch.shape == (2, 1 << J.sketch_bits(df)) and sketch.sum(axis=1).tolist() == [shingles] * 2
    assert sorted((x.doc_id, x.component_id) for x in J.classes(df, with_links=False).collect()) == list(enumerate(brute_components(rows)))
