"""Whole id sequences and texts from the query, and units of any length through the lattice, against the library."""

import random

import public_tokenizers
import pytest

import __spark_entry__
from quarry.llm import sentencepiece_lattice as S


@pytest.mark.parametrize("name", ["op8_sentencepiece", "pipeline"])
def test_query_gives_ids_and_decoded_texts(spark, sf, name):
    sp = S.processor(public_tokenizers.path(S.MODEL))
    rows = __spark_entry__.queries()[name](spark, sf).select("doc_id", "ids", "text", "n_pieces").collect()
    given = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert rows and all(len(r.ids) == r.n_pieces and list(r.ids) == sp.encode(r.text) for r in rows)
    if name == "op8_sentencepiece":
        assert {r.doc_id: r.text for r in rows} == given


def test_long_units_through_the_lattice(spark):
    path = public_tokenizers.path(S.MODEL)
    sp = S.processor(path)
    r = random.Random(5)
    runs = ["".join(r.choice(a) for _ in range(r.randrange(63, 900))) for a in ("ab", "acgt", "the", "nation", "-=", "*", "ée😀", "aeiourstln", "中国人民大学") for _ in range(4)]
    runs += [S.MARK * 200, S.MARK + "a" * 5000, "#" * 63, "국" * 70, "ing" * 1000]
    newline = len(sp.encode("\n"))
    got = {x.unit: list(x.ids) for x in S.encode_long(spark.createDataFrame([(u,) for u in runs], "unit string"), path).collect()}
    assert got == {u: sp.encode("\n" + u)[newline:] for u in runs}


def test_units_that_few_or_many_rows_share(spark, monkeypatch):
    """A row's rare and long units fall into place over several Arrow batches."""
    path = public_tokenizers.path(S.MODEL)
    sp = S.processor(path)
    texts = [f"{'ab' * 50} é{i}x {'-' * (60 + i)} same 😀" * 3 for i in range(40)] + [None, ""]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    monkeypatch.setattr(S, "HOT", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted((list(x.ids), x.text, x.round_trip) for x in S.encode(df, path, whole=True).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((sp.encode(t or ""), t or "", True) for t in texts)
