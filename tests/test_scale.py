"""What a task holds, and what is done again, does not grow with the tables."""

from quarry.operators import retrieval, review, vocabulary
from quarry.queries import paper
from quarry.sources import shared, tables


def test_pdf_files_are_read_once(spark, sf):
    plan = paper.pdf_text(spark, sf)._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan  # the layout starts from written marks


def test_large_tables_are_dealt_out_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "PART", 100)
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert tables.dealt(df, "k").rdd.getNumPartitions() == 10
    assert tables.dealt(df.limit(400), "k").count() == 400


def test_arrow_batches_are_bounded(spark, sf):
    tables.raw(spark, sf, "documents")
    assert spark.conf.get(shared.BATCH) != shared.DEFAULT


def test_no_window_over_all_tables_of_a_task(spark):
    data = [(t, d, f"doc{d}", "s", "c", 1, 3) for t in (1, None) for d in range(6)]
    cited = spark.createDataFrame(data, "task_id long, document_id long, document string, section string, caption string, row_no int, n_rows int")
    found = review.table_limits(cited)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.task_id or 0, r.place) for r in found.collect()) == [(t, p) for t in (0, 1) for p in (1, 2, 3, 4)]


def test_words_are_counted_where_the_text_stands(spark):
    rows = [(1, ["a", "b", "a"]), (2, ["a"]), (2, ["a", "c"]), (None, ["a"]), (None, ["a"]), (3, None)]
    once = spark.createDataFrame([rows[0], rows[1], rows[5]], "id long, words array<string>")
    assert "Exchange" not in vocabulary.counted_words(once, "id")._jdf.queryExecution().executedPlan().toString()
    got = vocabulary.counted_words(spark.createDataFrame(rows, "id long, words array<string>"), "id").collect()
    assert sorted(got, key=repr) == sorted([(1, "a", 2, 2), (1, "b", 1, 2), (2, "a", 2, 2), (2, "c", 1, 2), (None, "a", 2, 2)], key=repr)


def test_dense_top_over_small_parts(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "SCORED", 3)
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id long, embedding array<double>").repartition(2)
    got = retrieval.dense_top(v, v.where("vec_id = 7").selectExpr("vec_id AS query_id", "embedding"), k=9).orderBy("rank")
    assert [r.vec_id for r in got.collect()] == [2, 7, 12, 17, 22, 27, 32, 37, 3]
