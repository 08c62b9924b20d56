"""Language ID over documents and raw pages."""

import __spark_entry__


def test_language_id_covers_pages_with_suffix_evidence(spark, tmp_path):
    text = {"de": "der schein und die freiheit ist nicht über keit", "fr": "le château et la prière de l'été où être"}
    spark.createDataFrame([(i, text[l], l, "src") for i, l in enumerate(("de", "fr") * 20)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    # page 3 has no text evidence and no declared language: host and suffix alone decide
    pages = [(1, "https://www.x.de/a", f"<html lang='de-AT'><body>{text['de']}</body></html>"), (2, "http://y.fr", f"<html><body>{text['fr']}</body></html>"), (3, "http://z.de", "<p>xq</p>"), (4, "http://z2.fr", "<p>xq</p>"), (5, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = __spark_entry__.queries()["op9_language_id"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got if r.kind == "document") == list(range(40))
    page = {r.page_id: r for r in got if r.kind == "page"}
    assert set(page) == {1, 2, 3, 4, 5} and page[5].rejected
    assert [page[i].language for i in (1, 2, 3, 4)] == ["de", "fr", "de", "fr"]
