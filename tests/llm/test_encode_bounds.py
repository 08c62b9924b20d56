"""Encoding keeps little on disk and decodes a bounded number of characters at once; rows of any plan keep their own numbers."""

import random
from pathlib import Path

import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm import sentencepiece_lattice as S

PATH = public_tokenizers.path(S.MODEL)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(300)) for _ in range(400)]
    d = f"{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3).write.parquet(d)
    return d, texts


def test_numbers_of_units_are_not_written_twice(spark, table):
    path, texts = table
    folder = Path(common.shared_dir(spark).removeprefix("file:")) / "quarry"
    size = lambda: {f: f.stat().st_size for f in folder.rglob("*.parquet")}
    before = size()
    out = S.encode(spark.read.parquet(path), PATH, whole=True)
    kept = sum(v for f, v in size().items() if f not in before)
    assert kept < 0.05 * sum(map(len, texts))
    sp = S.processor(PATH)
    assert {r.doc_id: (list(r.ids), r.text, r.round_trip) for r in out.collect()} == {i: (sp.encode(t), t, True) for i, t in enumerate(texts)}


def test_decoding_takes_bounded_slices():
    own = pa.struct([("doc_id", pa.int64()), ("given_chars", pa.int64())])
    chars = [10, 0, 300, 20, 30, 900, 5, 60, 60]
    rows = [(k, place, {"doc_id": k, "given_chars": n} if place is None else None) for k, n in enumerate(chars) for place in (None, 4, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), own))], names=["row", "place", "own"])
    for given in (batch, batch.slice(6)):  # from a later row on, too
        cut = [x.to_pylist() for x in S.some_rows(given, 100)]
        assert [r for x in cut for r in x] == given.to_pylist()
        for x in cut:
            sizes = [r["own"]["given_chars"] for r in x if r["place"] is None]
            assert x[0]["place"] is None and sum(sizes[:-1]) < 100
    assert len(list(S.some_rows(batch, 100))) > 3


def test_rows_that_a_plan_repeats(spark, table):
    path, texts = table
    few = spark.read.parquet(path).where("doc_id < 20").select("doc_id", "text", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    rows = common.numbered(few, "n")
    assert rows.columns == ["doc_id", "text", "k", "n"] and rows.select("n").distinct().count() == 40
    got = sorted((r.doc_id, r.text, r.round_trip) for r in S.encode(few, PATH, whole=True).collect())
    assert got == sorted((i, texts[i], True) for i in range(20) for _ in (1, 2))
