"""The verdicts of the quality rules do not depend on whether models are told to tasks or joined."""

from quarry.llm import quality as Q


def test_judge_is_the_same_at_any_limit(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    docs = spark.createDataFrame([*docs.select("doc_id", "text", "lang").collect(), (900, None, "en"), (901, "", "xx"), (902, "zz " * 30, None)], "doc_id long, text string, lang string")
    told = {r.doc_id: (r.kept, r.base_failed, r.bits) for r in Q.judge(docs).collect()}
    monkeypatch.setattr(Q, "TOLD_GRAMS", 1000)
    joined = {r.doc_id: (r.kept, r.base_failed, r.bits) for r in Q.judge(docs).collect()}
    assert told.keys() == joined.keys()
    assert {k: v[:2] for k, v in told.items()} == {k: v[:2] for k, v in joined.items()}
    assert all((a[2] is None) == (joined[k][2] is None) and (a[2] is None or abs(a[2] - joined[k][2]) < 2e-4) for k, a in told.items())
    assert len({v[0] for v in told.values()}) == 2
