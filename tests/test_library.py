import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry import queries as Q
from quarry.functions import numbers, periods
from quarry.functions import text as X
from quarry.operators import analytics as A
from quarry.operators import evidence as E
from quarry.operators import quality as K
from quarry.operators import retrieval as R
from quarry.operators import review as V
from quarry.operators import vocabulary as W
from quarry.sources import files, sinks
from quarry.sources import tables as T
from quarry.streaming import events as S


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_periods():
    assert periods.bounds("1997-q3") == (dt.date(1997, 7, 1), dt.date(1997, 10, 1))
    assert periods.bounds("2025-13") is None and periods.bounds("2025Q3") is None
    assert periods.canonical("2025-h1") == "2025-H1" and periods.canonical(" 2025 ") == "2025"
    assert periods.token(dt.date(2025, 1, 1), dt.date(2025, 10, 1)) is None
    assert periods.token(dt.date(2025, 4, 1), dt.date(2025, 7, 1)) == "2025-Q2"


def test_text():
    assert X.normal("２０２５年7月1日，百分之十五") == "2025-07-01,15%"
    assert X.numeral("二十五") == 25 and X.numeral("一万二千") == 12000 and X.numeral("x") is None
    assert X.split_words("Net Sales 净销售额 a") == ["net", "sales", "净销", "销售", "售额", "a"]


def test_numbers(spark):
    df = spark.createDataFrame([(1.0, 0.0), (5.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(numbers.signed_delta(F.col("a"), F.col("b"))).collect()] == ["—", "+25.0%"]
    assert [r[0] for r in df.select(numbers.percent(F.col("a"), F.col("b"))).collect()] == ["—", "125.0%"]


def test_star_invariant(spark, sf):
    fact = T.sales(spark, sf)
    assert fact.where("net <> gross - discount - returned").count() == 0
    assert fact.count() == T.raw(spark, sf, "lineitem").join(T.raw(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).count()


def test_date_filter_reaches_the_scan(spark, sf):
    plan = T.sales(spark, sf, start="1997-07-01", end="1997-10-01")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan


def test_percentile_is_an_order_statistic(spark):
    df = spark.range(1, 21).withColumn("k", F.lit(1))
    assert A.nearest_rank(df, "id", 0.95, "k").first()["value"] == 19


def test_even_sample(spark):
    got = sorted(r[0] for r in A.even_sample(spark.range(103).repartition(5), "id", 10).collect())
    assert got == [i * 103 // 10 for i in range(10)]
    assert A.even_sample(spark.range(3), "id", 10).count() == 3


def test_vocabulary_is_append_only(spark):
    first = spark.createDataFrame([("a", 3), ("b", 5)], "token string, df long")
    known = W.with_ids(first)
    assert rows(known) == [("a", 3, 1), ("b", 5, 0)]
    more = W.with_ids(spark.createDataFrame([("b", 9), ("c", 1), ("d", 2)], "token string, df long"), known)
    assert rows(more.select("token", "df", "token_id")) == [("a", 3, 1), ("b", 5, 0), ("c", 1, 3), ("d", 2, 2)]


def test_dense_zero_vector_and_ties(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in R.dense_top(v, q, k=2).orderBy("rank").collect()] == [(2, 1.0), (3, 1.0)]
    assert R.dense_top(v, q.where("false")).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, d long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "q long, d long, rank int")
    assert [r.d for r in R.fused([a, b], "q", "d").orderBy("place").collect()] == [11, 10, 12]


def test_gate(spark):
    best = spark.createDataFrame([(1, 0.7), (2, 0.5), (3, 0.9)], "query_id long, best double")
    words = spark.createDataFrame([(1, "sales"), (3, "blockchain")], "query_id long, token string")
    vocab = spark.createDataFrame([("net-sales",)], "token string")
    unseen = R.unseen_topics(words, vocab, words.select("token"))
    assert rows(unseen) == [(3, "blockchain")]
    assert rows(R.refused(best, unseen)) == [(1, False), (2, True), (3, True)]
    assert R.rewritten("sales 2025", lambda q: ["sales", "2025 net sales", "sales 2025"]) == ["sales 2025", "2025 net sales"]
    assert R.rewritten("x", lambda q: 1 / 0) == ["x"]


def test_conflict_matrix(spark):
    claim = "claim_id string, evidence_id string, metric string, period string, scope map<string,string>, value double, unit string, cutoff date"
    fact = "fact_id string, metric string, period string, scope map<string,string>, value double"
    facts = spark.createDataFrame([("f", "m", "2025-Q3", {"region": "a"}, 1_000_000.0)], fact)
    late, early = dt.date(2025, 9, 30), dt.date(2025, 9, 20)
    cases = [
        ("same", "2025-q3", {"region": "a"}, 100.0, late), ("within", "2025-Q3", {"region": "a"}, 100.05, late), ("over", "2025-Q3", {"region": "a"}, 101.0, late), ("other", "2025-Q3", {"region": "b"}, 500.0, late),
        ("open", "2025-Q3", {}, 500.0, None), ("period", "2025-Q2", {"region": "a"}, 500.0, None), ("unknown", None, None, 500.0, None), ("cut", "2025-Q3", {"region": "a"}, 500.0, early), ("more", "2025-Q3", {"region": "a", "line": "x"}, 500.0, None),
    ]
    claims = spark.createDataFrame([(n, n, "m", p, s, v, "万元", c) for n, p, s, v, c in cases], claim)
    assert {(r.claim_id, r.kind) for r in E.conflicts(claims, facts).collect()} == {("over", "VALUE"), ("open", "VALUE"), ("unknown", "VALUE"), ("cut", "TIME")}


def test_value_and_time_conflicts_by_hand(spark, sf):
    import binascii

    got = {(r.kind, r.fact_id) for r in Q.QUERIES["value_and_time_conflicts"](spark, sf).collect()}
    facts = {(r.fact_id, r.period): r.value for r in Q.trails.monthly(spark, sf).collect()}
    wanted = set()
    for (name, period), value in facts.items():
        k = binascii.crc32(name.encode())
        if k % 5 == 0:
            wanted.add(("TIME", name))
        elif k % 3 == 0 and abs(value) * 0.02 > max(1.0, 0.001 * abs(value)):
            wanted.add(("VALUE", name))
    assert got == wanted


def test_exact_header_beats_alias(spark):
    df = spark.createDataFrame([("t", "m", True, ["a"], 1), ("t", "m", False, ["a"], 2), ("u", "m", False, ["a"], 3), ("u", "m", False, ["a", "b"], 4)], "table_id string, metric string, exact boolean, dims array<string>, n int")
    assert sorted(r.n for r in E.exact_headers(df).collect()) == [1, 3]


def test_evidence_fan_out(spark):
    assert E.sql_evidence(spark.range(3), "f", ["id"]).count() == 3
    one = E.sql_evidence(spark.range(25), "f", ["id"]).collect()
    assert len(one) == 1 and one[0].claim.startswith("25 rows: id=0 | id=1 | id=2")
    assert E.sql_evidence(spark.range(1).select(F.lit(None).cast("int").alias("x")), "f", ["x"]).count() == 0


def test_review_and_plan(spark):
    f = spark.createDataFrame([("a", "HIGH", "NONE"), ("a", "HIGH", "NONE"), ("a", "HIGH", "CLARIFY"), ("b", "LOW", "NONE")], "task_id string, severity string, action string")
    assert rows(V.scores(f)) == [("a", 0, "CLARIFY"), ("b", 95, "PASS")]
    p = V.Plan.start(["SQL", "DOCUMENT"], ["q1", "q2"])
    assert len(p.steps) == 4 and p.extend([("SQL", "Q1 "), ("SQL", "q3"), ("WEB", "x")]) == [("SQL", "q3")]
    with pytest.raises(ValueError, match="PLAN_INVALID"):
        V.Plan.start(["WEB"], ["q"])
    assert V.progress(3, 2, 0, 0, 0) == "CONTINUE" and V.progress(2, 2, 0, 1, 0) == "EXPAND" and V.progress(2, 1, 1, 1, 9) == "SUFFICIENT"
    assert V.retry_route(["tool", "replan"], {"replan": 0, "tool": 1}) == "tool"


def test_rows_equal():
    assert K.rows_equal([(1.004, None)], [("1.00", None)]) and not K.rows_equal([(1,), (1,)], [(1,)])
    assert K.rows_equal([("x", 1, 2)], [("x", 2)], subset=True) and not K.rows_equal([("x", 1)], [("x", 1), ("x", 1)], subset=True)


def test_furniture(spark):
    lines = [("d", p, i, t) for p in (1, 2) for i, t in enumerate([f"Page {p}", f"body {p} text", "Confidential"])]
    df = spark.createDataFrame(lines, "document_id string, page int, line_no int, text string")
    found = K.furniture(df)
    assert {r.text for r in found.collect()} == {"Page #", "Confidential"}
    assert {r.text for r in K.without_furniture(df, found).collect()} == {"body 1 text", "body 2 text"}


def test_parsers_and_chunks():
    md = files.markdown("# A\n\ntext one\nwraps **bold**\n\n**Cap**\n| x | y |\n|---|---|\n| 1 | 2 |\n| 3 |\n\n```\n# no heading\n```\n")
    assert [b.kind for b in md] == ["HEADING", "PARAGRAPH", "TABLE", "PARAGRAPH"] and md[1].text == "text one wraps bold" and md[2].caption == "Cap"
    assert [t for _, k, t in files.chunks(md) if k == "ROW"] == ["表：Cap\nx | y\n1 | 2", "表：Cap\nx | y\n3 | "]
    html = files.html("<html><head><title>t</title></head><body><h2>H</h2><p>a &amp; b</p><script>x</script><table><tr><th>c</th></tr><tr><td>1</td></tr></table></body></html>")
    assert [(b.kind, b.text) for b in html] == [("HEADING", "H"), ("PARAGRAPH", "a & b"), ("TABLE", "")]
    long = files.chunks([files.Block("PARAGRAPH", "x" * 2000)])
    assert all(len(t) <= files.CHUNK for _, _, t in long)
    assert files.chunks(files.plain_text("Title\n=====\n\nbody. more."))[0][0] == ["Title"]
    assert [b.text for b in files.body(files.markdown("# 修订记录\n\nx\n\n# Real\n\ny"))] == ["Real", "y"]
    assert files.table_row(None, [], ["a", "b"]) == "a | b"
    assert [(b.kind, b.text, b.level) for b in files.plain_text("一、总则\n（一）范围\n-\ntext\n------\n\n---  ---\nrow")] == [("HEADING", "一、总则", 1), ("HEADING", "（一）范围", 2), ("PARAGRAPH", "-", 0), ("HEADING", "text", 2), ("PARAGRAPH", "row", 0)]
    table = files.Block("TABLE", header=["a"], rows=[["1"]])
    assert [b.caption for b in files.captioned([files.Block("PARAGRAPH", "表：销售"), table, table])] == ["销售", "销售"]


def test_files_from_a_folder(spark, tmp_path):
    buffer = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>text</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(buffer.getvalue())
    (tmp_path / "b.md").write_text("# M\n\nx")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.xyz").write_bytes(b"\0")
    got = {r.path.rsplit("/", 1)[1]: r.blocks and [b.text for b in r.blocks] for r in files.parsed(files.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": ["H", "text"], "b.md": ["M", "x"], "c.docx": None, "d.xyz": None}
    kinds = {r.path.rsplit("/", 1)[1]: r.s for r in files.scan(spark, str(tmp_path)).select("path", files.sniffed(F.col("content")).alias("s")).collect()}
    assert kinds == {"a.docx": "ZIP", "b.md": "TEXT", "c.docx": "TEXT", "d.xyz": "BINARY"}


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 0), ("b", 1)], "token string, token_id long")
    new = spark.createDataFrame([("a", 5), ("c", 1), ("d", 6)], "token string, token_id long")
    assert rows(sinks.appended_vocabulary(old, new)) == [("d", 6)]
    assert sinks.write_version(old, str(tmp_path / "x"), "v1") == 2 and sinks.write_version(new, str(tmp_path / "x"), "v2") == 3
    assert rows(sinks.read_current(spark, str(tmp_path / "x"))) == rows(new)
    for bad in ("../x", "/etc", "a/../../b", "s3://x"):
        with pytest.raises(ValueError, match="bad storage key"):
            sinks.safe_key(bad)


def test_streams_equal_batch(spark, sf, tmp_path):
    e = S.timed(T.raw(spark, sf, "events"))
    e.write.parquet(str(tmp_path / "in"))
    live = S.tumbling(S.stream(spark, str(tmp_path / "in"), e), "1 hour", "event_type")
    q = live.writeStream.outputMode("complete").format("memory").queryName("tumbling_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("tumbling_test")) == rows(S.tumbling(e, "1 hour", "event_type"))


def test_rate_window_by_hand(spark):
    t0 = dt.datetime(2024, 1, 1)
    hits = [(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 10, 20, 61, 62, 200))] + [(2, 9, t0)]
    df = spark.createDataFrame(hits, "user_id long, event_id long, ts timestamp")
    got = {r.event_id: (r.place, r.allowed) for r in S.rate_limited(df, 60, 2).collect()}
    assert got == {0: (1, True), 1: (2, True), 2: (3, False), 3: (1, True), 4: (2, True), 5: (1, True), 9: (1, True)}


def test_every_query_has_rows_or_a_schema(spark, sf):
    assert len(Q.QUERIES) >= 75 and set(Q.ORACLE) <= set(Q.QUERIES)
    for name in ("rate_window", "chunks", "page_blocks", "normalised_text", "word_segmentation"):
        assert Q.QUERIES[name](spark, sf).limit(1).count() == 1


def live(df, name, tmp_path, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_token_bucket_and_heartbeats(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate((0, 0, 0, 10, 4000))] + [(2, 9, t0)], "user_id long, event_id long, ts timestamp")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = S.stream(spark, str(tmp_path / "in"), e)
    got = {r.event_id: r.allowed for r in live(S.token_bucket(source, rate=0.1, burst=2.0), "bucket_test", tmp_path).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}
    slow = {r.event_id: r.allowed for r in live(S.token_bucket(source, rate=0.1, burst=2.0, scale=0.5), "bucket_slow", tmp_path).collect()}
    assert slow[3] is False
    gone = live(S.heartbeats(source, 30, late="1 minute"), "heartbeat_test", tmp_path).collect()
    assert {r.user_id for r in gone} == {2}


def test_corpus_checks(spark):
    d = spark.createDataFrame([("a", True, "ACTIVE", "k1", "k2", "INTERNAL"), ("b", False, "FAILED", "k2", None, "EXTERNAL"), ("c", False, "ACTIVE", "k3", "k9", "INTERNAL")], "document_id string, has_text_layer boolean, status string, logical_key string, pair_with string, source_kind string")
    c = spark.createDataFrame([("b", 1)], "document_id string, n int")
    assert {r.document_id for r in K.chunks_of_failed(d, c).collect()} == {"b", "c"}
    assert [r.document_id for r in K.unpaired(d).collect()] == ["c"]
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert [r.query_id for r in K.answered_absent(asked, spark.createDataFrame([(1, True), (2, False)], "query_id long, refused boolean")).collect()] == [2]
