"""SimHash fingerprints bit by bit, and links by anchors against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash as S


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints):
    label = [i if i is not None else 1 << 62 for i in ids]
    near = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2] for p in prints]
    while True:
        new = [min(label[j] for j in js) for js in near]
        if new == label:
            return [x if x < 1 << 62 else None for x in label]
        label = new


def check(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "clash", "x", 1) for d, t in rows], "doc_id long, text string, print string, component_id string, n int")
    got = S.classes(df, **options)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [brute_print(t) for _, t in rows]
    parts = brute_components([d for d, _ in rows], prints)
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=key) == sorted(((d, f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, parts, strict=True)), key=key)
    return parts


def corpus(seed, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.7:
            w = (r.choice(rows)[1] or "x y").split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = f"e{r.randrange(99)}"
        else:
            w = [f"W{r.randrange(500)}" for _ in range(r.choice([1, 2, 5, 30, 1500, 1500, 1500]))]
        rows.append((i * 3, " ".join(w)))
    r.shuffle(rows)
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "one two"), (1005, "é 中文 😀"), (1006, "long " * 50_000), (None, "one two"), (None, "of nobody " * 9), (1007, "one"), (1007, "one"), (1007, "three")]


@pytest.mark.parametrize(("segments", "large"), [(None, S.LARGE), (1, S.LARGE), (3, S.LARGE), (2, 3), (1, 5)])
def test_against_brute_force(spark, segments, large):
    parts = check(spark, corpus(3) + ODD, segments=segments, large=large)
    assert len(set(parts)) < 120


def test_empty(spark):
    assert S.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_code():
    """Each word has one codeword within RADIUS; what is within reach is what the definition says."""
    leader = S.cosets()[0]
    assert leader.shape == (2048, 1) and (leader >= 0).all()
    r = np.random.default_rng(2)
    prints = r.integers(0, 2**64, size=40, dtype=np.uint64)
    for segments in (1, 2, 3):
        found = {(int(a), int(p)) for x, y in S.reached(prints, segments) for a, p in zip(x, y, strict=True)}
        own = S.own_anchor(prints, segments)
        for i in range(64):
            for j in range(i + 1):
                moved = prints ^ (np.uint64(1) << np.uint64(i)) if i == j else prints ^ (np.uint64(1) << np.uint64(i)) ^ (np.uint64(1) << np.uint64(j))
                assert {(int(a), k) for k, a in enumerate(S.own_anchor(moved, segments))} <= found
        assert {(int(a), k) for k, a in enumerate(own)} <= found


@pytest.mark.parametrize("most", [100, 1 << 22])
def test_met(most):
    r = random.Random(4)
    prints = sorted({r.getrandbits(64) & 0xFFF for _ in range(900)})
    near = {(p, q) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= 2}
    a, b = S.met(np.array(prints, dtype=np.uint64), most)
    parts = lambda edges: sorted(map(sorted, groups(prints, edges)))
    assert parts(near) == parts(zip(a.tolist(), b.tolist(), strict=True)) and len(a) == len(prints) - len(groups(prints, near))
    x, y = S.compared(np.array(prints[:70], dtype=np.uint64), np.array(prints[70:150], dtype=np.uint64))
    some = {(p, q) for p, q in near if p in prints[:70] and q in prints[:150] or q in prints[:70] and p in prints[:150]}
    assert sorted(map(sorted, groups(prints, some))) == parts(zip(x.tolist(), y.tolist(), strict=True))


def groups(nodes, edges):
    of = {x: {x} for x in nodes}
    for p, q in edges:
        if of[p] is not of[q]:
            joined = of[p] | of[q]
            for x in joined:
                of[x] = joined
    return list({id(v): v for v in of.values()}.values())
