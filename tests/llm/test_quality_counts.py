"""Each different n-gram of a batch is looked up once: counts and costs as by the plain way, with far fewer look-ups."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import quality as Q


class Table:
    """A stand-in for sorted arrays: some n-grams are known; look-ups are counted."""

    asked = 0

    def find(self, wanted):
        Table.asked += len(wanted)
        return (wanted % np.uint64(1009)).astype(np.float32) / 100, wanted % np.uint64(3) == 0


@pytest.mark.parametrize("alphabet", ["ab c", "abcdefghij é\n0世", "".join(map(chr, range(0x4E00, 0x9000)))])
@pytest.mark.parametrize("order", [3, 5])
def test_counts_and_costs_of_a_batch(alphabet, order):
    r = random.Random(order)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(400))) for _ in range(30)] + ["", "\0\0a"]
    some = Q.Symbols([t.encode() for t in texts], order)
    lang = np.array([i % 3 for i in range(len(texts))])
    group = np.repeat(lang, np.diff(some.first))
    folded = lambda t: "".join(chr(Q.folds()[ord(c)]) for c in t)
    want = Counter((int(g), (" " * (order - 1) + folded(t))[i : i + order]) for g, t in zip(lang, texts) for i in range(len(t)))
    of, grams, n = some.distinct(group, order)
    assert Counter(dict(zip(zip(of.tolist(), grams), n.tolist()))) == want
    told = ({k: Table() for k in range(1, order + 1)}, {k: Table() for k in range(1, order + 1)}, {0: 4.0, 1: 5.0})
    plain = Q.costs_at(some, group, np.arange(len(group)), told, order)
    Table.asked = 0
    assert (Q.costs(some, group, told, order) == plain).all()
    if len(alphabet) < 9:
        assert Table.asked < 2 * order * len(want) + 1
