"""Dictionary segmentation against all segmentations of short runs, by tasks and by joins."""

import itertools
import math
import random

import pytest

from quarry.functions import segments as S


def every(run):
    for bits in itertools.product((0, 1), repeat=len(run) - 1):
        out, at = [], 0
        for i, b in enumerate(bits, 1):
            if b:
                out.append(run[at:i])
                at = i
        yield [*out, run[at:]]


def brute(run, d):
    """The greatest sum; None if several paths have it."""
    scored = []
    for path in every(run):
        costs = [d.cost.get(w, d.unseen if len(w) == 1 else None) for w in path]
        if None not in costs:
            scored.append((round(sum(costs), 7), path))
    best = max(s for s, _ in scored)
    found = [p for s, p in scored if s == best]
    return best, found


def words(seed, letters="ab中文報里", n=25):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.choice([1, 2, 2, 3, 4]))): float(r.randrange(1, 200)) for _ in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_best_path_is_the_best_of_all(spark, seed):
    known = words(seed)
    d = S.Dictionary.of(known)
    r = random.Random(seed + 50)
    runs = ["".join(r.choice("ab中文報里x") for _ in range(r.randrange(1, 11))) for _ in range(60)]
    table = spark.createDataFrame(list(known.items()), "word string, freq double")
    joined = {x.run: x.words for x in S.graph_best(spark.createDataFrame([(t,) for t in [*runs, None, ""]], "run string"), table).collect()}
    assert joined.keys() == set(runs)
    for run in runs:
        best, found = brute(run, d)
        got = d.best(run)
        assert got in found and "".join(got) == run, (run, got, found)
        assert abs(sum(d.cost.get(w, d.unseen) for w in got) - best) < 1e-6
        assert joined[run] == got


def test_user_terms_and_other_words(spark):
    table = spark.createDataFrame([("净销售额", 5.0), ("销售", 50.0), ("额度", 3.0), ("同比", 9.0), (None, 3.0), ("", 4.0), ("零", 0.0)], "word string, freq double")
    terms = spark.createDataFrame([("华东区",), ("华东区域",), (None,)], "term string")
    d = S.gathered(table, terms)
    assert d.cut("华东区域净销售额同比") == ["华东区域", "净销售额", "同比"] and d.cut("销售华东区额度") == ["销售", "华东区", "额度"]
    assert d.knows("销售") and not d.knows("华东区") and not d.knows("报里")
    got = S.segmented(spark.createDataFrame([(1, "Q3净销售额同比 12.5%，a-b/c"), (2, None), (3, ""), (4, "，。 ")], "id long, text string"), d, key="id")
    assert {r.id: r.words for r in got.collect()} == {1: ["Q3", "净销售额", "同比", "12.5", "a-b/c"], 2: [], 3: [], 4: []}


def test_bounds(spark):
    empty = spark.createDataFrame([], "word string, freq double")
    d = S.gathered(empty)
    assert d.cut("任何字") == ["任", "何", "字"] and d.cut("") == []
    with pytest.raises(ValueError, match="graph_best"):
        S.gathered(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "word string, freq double"), most=1)
    long = S.Dictionary.of({"ab": 3.0, "a": 1.0}).cut("ab" * 50_000)
    assert long == ["ab"] * 50_000 and math.isfinite(S.Dictionary.of({}).unseen)
