"""The filter audit against plain Python: every order is run through, filter by filter."""

import itertools
import random
import re
from collections import defaultdict

import pytest

from quarry.llm import filter_audit as A

DOCS = "doc_id long, text string, lang string, source string, part string, n long, mask int, quality int"


def brute(rows, labels):
    """rows: doc_id, text, source."""
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    parts = defaultdict(list)
    for d, t, source in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        parts[source or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        removed_at = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                removed_at[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[0] for x in docs) - len(gone), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_at[order[step - 1]])
    return out


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, "clash", 1, 7, 0) for d, t, s in rows], DOCS)


def test_against_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(k)}" for _ in range(n)) + tail for n, k in ((250, 900), (250, 40), (20, 90)) for tail in ("", " #", " ABCDEFGHIJKLMNOPQRST XYZ")]
    texts += [None, "", " \n ", "long " * 30_000, "Ünï é 中文 " * 70]
    rows = [(i, r.choice(texts), r.choice(["a", "b", None, "", "é"])) for i in range(300)]
    rows += [(7, rows[7][1], "a"), (7, rows[7][1], "b"), (None, texts[0], "a"), (None, None, None), (9, "one id", "a"), (9, "other text", "a")]
    labels = [(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99_999, 1, 1)]
    got = A.audit(table(spark, rows), spark.createDataFrame([(d, q, t, "x") for d, q, t in labels], "doc_id long, quality int, toxic int, text string"))
    assert got.columns == list(A.COLUMNS)
    found = {(x.part, x.filter_order, x.step): list(x[3:]) for x in got.collect()}
    assert found == brute(rows, labels)


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(table(spark, []), labels).count() == 0
    assert A.audit(table(spark, [(1, "x", "a")]), labels).count() == 600


def test_polynomial():
    counts = {0: 5, 1: 3, 3: 7, 4: 2, 7: 11}
    f = A.Removal(counts, 3)
    for s in range(8):
        assert f.corner(s) == sum(n for m, n in counts.items() if m & s)
    orders = list(itertools.permutations(range(3)))
    for i in range(3):
        total = sum(f.corner(sum(1 << j for j in o[: o.index(i) + 1])) - f.corner(sum(1 << j for j in o[: o.index(i)])) for o in orders)
        assert f.shapley(i) * 6 == total
    assert sum(f.shapley(i) for i in range(3)) == f.corner(7)


@pytest.mark.parametrize("text", [b"", b" ", b"a", "É A".encode(), b"A" * 100_000])
def test_own_failures(text):
    t = text.decode()
    w = t.split()
    assert A.own_failures(text) == (len(w) < 200) + 2 * (2 * len(set(w)) < len(w)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 2 * len(t)) + 8 * bool(re.search(r"[#$%&*|]", t))
