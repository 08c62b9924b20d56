"""Hand examples of the store's operators; the registered queries are held against DuckDB besides."""

import pytest

from quarry.operators import quality as Q
from quarry.operators import retrieval as R
from quarry.operators import review as V
from quarry.operators import vocabulary as W
from quarry.streaming import events as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_payloads(spark):
    points = spark.createDataFrame([(1, '{"a": "x", "b": "y"}'), (2, '{"a": "x"}'), (3, '{"a": "x", "b"'), (4, None), (5, "[]")], "id long, payload string")
    assert rows(R.valid_payloads(points, ("a", "b"))) == [(1, "x", "y")]


def test_embedding_batches(spark):
    texts = spark.createDataFrame([(i, "a" * i if i else None) for i in range(40)], "doc_id long, text string").coalesce(1)
    sizes = R.embedded(texts, lambda t: [[float(len(t))]] * len(t), key="doc_id")
    assert {v[0] for _, v in sizes.collect()} <= {float(n) for n in range(1, 17)}
    assert sizes.count() == 40
    with pytest.raises(Exception, match="vectors for"):
        R.embedded(texts, lambda t: [[1.0]] * (len(t) - 1), key="doc_id").collect()


def test_stop_words(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text("the\n\n  of \nthe\n", encoding="utf-8")
    stop = W.stop_words(spark, str(path))
    assert rows(stop) == [("of",), ("the",)]
    tokens = spark.createDataFrame([("the",), ("net",)], "token string")
    assert rows(W.without_stop_words(tokens, stop)) == [("net",)]
    assert rows(W.without_stop_words(tokens, W.stop_words(spark, str(tmp_path / "none.txt")))) == [("net",), ("the",)]


def test_merged_citations(spark):
    schema = "task_id long, ordinal long, source_type string, title string, section string, page_no int, fingerprint string, caption string, row_no int, slice_no int"
    doc = lambda n, row, **k: (1, n, "DOCUMENT", k.get("title", "Report"), "Sales", 2, None, "By region", row, None)
    data = [doc(1, 5), doc(2, 1), doc(3, 2), (1, 4, "SQL", "q", None, None, "abcdef0123456789", None, None, 0), (1, 5, "OTHER", "Memo", None, None, None, None, None, None), (1, 6, "OTHER", "Memo", None, None, None, None, None, None), doc(7, None, title="Report > Sales")]
    got = [(p, t) for _, p, t in rows(V.merged_citations(spark.createDataFrame(data, schema)))]
    assert got == [(1, "《Report》（Sales），第 2 页（表「By region」第 1–2、5 行）"), (2, "业务数据库查询 abcdef012345（结果第 1 行）"), (3, "Memo（2 条）"), (4, "《Report > Sales》，第 2 页")]


def test_table_limits(spark):
    data = [(1, d, f"doc{d}", "s", "c", 1, 3) for d in range(5)] + [(1, 9, "doc9", "s", "c", r, 2) for r in (1, 2)]
    cited = spark.createDataFrame(data, "task_id long, document_id long, document string, section string, caption string, row_no int, n_rows int")
    got = [t for _, _, t in rows(V.table_limits(cited))]
    assert got == [f"表格「c」（doc{d}）共 3 行，已引用 1 行" for d in range(3)] + ["另有 2 张表不完整"]


def test_versions_and_notes(spark):
    docs = spark.createDataFrame([("a", 1, "1997-01-01", "1997-06-30"), ("a", 2, "1997-07-01", None), ("b", 1, "1997-01-01", "1997-12-31"), ("b", 2, "1997-07-01", None), ("c", 1, "1997-01-01", None), ("c", 2, "1997-07-01", None), ("d", 1, "1997-01-01", None)], "logical_key string, version int, a string, b string")
    docs = docs.selectExpr("logical_key", "version", "date(a) AS effective_from", "date(b) AS effective_to")
    assert [(k, p) for k, _, p in rows(Q.wrong_versions(docs))] == [("b", "OLD_FOUND"), ("c", "NO_END")]
    chunks = spark.createDataFrame([(1, "incl. tax"), (2, "plain"), (2, None)], "document_id long, text string")
    assert rows(Q.without_note(spark.createDataFrame([(1,), (2,), (3,)], "document_id long"), chunks, "tax")) == [(2,), (3,)]


def test_idle_frames(spark):
    data = [(1, 1, 0), (1, 2, 30), (1, 3, 45), (1, 4, 62), (2, 5, 0)]
    events = spark.createDataFrame(data, "user_id long, event_id long, s long").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts")
    got = S.idle_frames(events, "user_id", 15).selectExpr("user_id", "unix_seconds(at) AS s")
    assert rows(got) == [(1, 15), (1, 60)]  # frames at 30 and 45 would fall on events
