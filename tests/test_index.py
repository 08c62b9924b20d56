"""The inverted-file index and the impact-ordered postings against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import impact as I
from quarry.operators import vector_index as N


def vectors(spark, n=400, dim=8, seed=1):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = [(i, (centres[i % 6 if i % 3 else 0] + 0.3 * r.normal(size=dim)).astype(np.float32).tolist(), "x") for i in range(n)]
    rows += [(n, [0.0] * dim, "x"), (n + 1, None, "x"), (n + 2, rows[5][1], "x"), (n + 3, rows[5][1], "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string")


def brute(rows, asked, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    out = {}
    for q, v in asked:
        scored = sorted((-round(float(unit(v) @ unit(x)), 6) + 0.0, i) for i, x, _ in rows if x is not None)[:k]
        out[q] = [(i, -s + 0.0) for s, i in scored]
    return out


@pytest.mark.parametrize(("block", "asked"), [(8192, 2048), (20, 3)])
def test_exact_search_is_brute_force(spark, monkeypatch, block, asked):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "ASKED", asked)
    rows, table = vectors(spark)
    index = N.build(table, N.fit(table, key="vec_id", lists=12), key="vec_id")
    queries = [(i, v) for i, v, _ in rows if v is not None and (i % 40 == 0 or i == 400)]
    got = N.search(index, spark.createDataFrame([*queries, (9999, None)], "query_id long, embedding array<float>"), k=15, probes=2, exact=True)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    wanted = brute(rows, queries, 15)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in wanted.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q in wanted for a, b in zip(found[q], wanted[q], strict=True))
    few = {r.query_id: r.n_scored for r in got.select("query_id", "n_scored").distinct().collect()}
    assert min(few.values()) < len(rows) / 2 and few[400] == len(rows) - 1


def test_measured_probes(spark):
    rows, table = vectors(spark)
    index = N.build(table, N.fit(table, key="vec_id", lists=12), key="vec_id")
    probes = N.probes_for(index, table, key="vec_id", k=15)
    queries = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = N.search(index, queries, k=15, exact=True)
    measured = N.recall(N.search(index, queries, k=15, probes=probes), exact, "vec_id").agg(F.avg("recall")).first()[0]
    assert 1 <= probes <= 12 and measured >= 0.9


def test_few_vectors(spark):
    for rows in ([], [(1, None)], [(1, [0.0, 0.0])], [(1, [1.0, 0.0]), (2, [1.0, 0.0])]):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        index = N.build(table, N.fit(table, key="vec_id"), key="vec_id")
        got = N.search(index, table.select(F.col("vec_id").alias("query_id"), "embedding"), exact=True)
        known = [k for k, v in rows if v]
        assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [(a, b) for a in known for b in known]


@pytest.mark.parametrize(("seed", "block", "first", "skewed"), [(0, 65_536, 20_000, False), (1, 7, 30, True), (2, 5, 1, True), (3, 65_536, 10, False)])
def test_impact_search_is_brute_force(spark, monkeypatch, seed, block, first, skewed):
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "SEED", first)
    r = random.Random(seed)
    tokens = [f"t{i}" for i in range(60)]
    share = {t: (0.9 if i < 4 else 0.3 if i < 15 else 0.05) if skewed else 0.2 for i, t in enumerate(tokens)}
    postings = [(d, t, round(r.random() * (0.4 if share[t] > 0.5 else 2), 3) + 0.001) for d in range(300) for t in tokens if r.random() < share[t]]
    asked = [(q, t, round(r.random() + 0.01, 3)) for q in range(12) for t in r.sample(tokens, r.choice([1, 3, 10, 40]))]
    asked += [(0, "t1", 0.5), (50, "never", 1.0), (51, None, 1.0), (52, "t20", 0.0)]
    index = I.build(spark.createDataFrame([*postings, (7, None, 1.0), (7, "t2", 0.0)], "doc long, token string, w double"), "doc")
    got = {}
    for x in I.search(index, spark.createDataFrame(asked, "q_id long, token string, q double"), "q_id", 5).orderBy("q_id", "rank").collect():
        got.setdefault(x.q_id, []).append((x.doc, x.score))
    of = {}
    for d, t, w in postings:
        of.setdefault(t, []).append((d, w))
    wanted = {}
    for q in range(12):
        total = {}
        for a, t, v in asked:
            if a == q:
                for d, w in of.get(t, []):
                    total[d] = total.get(d, 0) + v * w
        wanted[q] = sorted(((d, round(s, 6)) for d, s in total.items()), key=lambda x: (-x[1], x[0]))[:5]
    assert got.keys() == {q for q, v in wanted.items() if v}
    for q, v in got.items():
        assert [round(s, 5) for _, s in v] == [round(s, 5) for _, s in wanted[q]]
