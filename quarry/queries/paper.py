"""Queries over PDF files that are made from the tables' rows, all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from quarry.queries.registry import query
from quarry.sources import files, pdf
from quarry.sources.shared import settled
from quarry.sources.tables import raw

PER_LINE, PER_PAGE, TABLE_ROWS, OF_FILE = 10, 40, 20, 100


def printed_texts(spark, sf):
    """path (the document's id and, as an id may repeat or be null, a number), content: a file of each document, words spread over lines and pages; files of odd ids are compact."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [pdf.rendered(pdf.typeset([w.decode() for w in (t or "").encode().split()], PER_LINE, PER_PAGE), bool(odd)) for odd, t in zip(f["odd"], f["text"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "content": made})

    dealt = raw(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")
    path = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("#"), F.monotonically_increasing_id().cast("string"))
    return dealt.select(path.alias("path"), F.coalesce(F.col("doc_id") % 2 != 0, F.lit(False)).alias("odd"), "text").mapInPandas(run, "path string, content binary")


@query(
    "pdf_text",
    r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(0, len(w), 400)) AS pos FROM w) "
    r"SELECT doc_id, CAST(pos // 400 + 1 AS INTEGER) AS page, CAST((least(400, len(w) - pos) + 9) // 10 AS BIGINT) AS n_lines, "
    r"sha256(array_to_string(list_transform(range(pos, least(pos + 400, len(w)), 10), lambda i: array_to_string(w[i+1:least(i + 10, pos + 400)], ' ')), chr(10))) AS hash FROM p",
)
def pdf_text(spark, sf):
    """Every document as a PDF file, read back page by page and line by line."""
    pages = pdf.page_texts(settled(pdf.marks(printed_texts(spark, sf))))  # the layout reads the marks several times
    document = F.nullif(F.substring_index("path", "#", 1), F.lit("")).cast("long")
    return pages.select(document.alias("doc_id"), "page", "n_lines", F.sha2("text", 256).alias("hash"))


def printed_tables(spark, sf):
    """path, content: files of up to OF_FILE customers, a ruled table on each page."""
    c = raw(spark, sf, "customer")
    told = F.struct("c_custkey", "c_name", "c_mktsegment", F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("balance"))
    rows = c.groupBy(F.floor(F.col("c_custkey") / OF_FILE).cast("string").alias("path")).agg(F.array_sort(F.collect_list(told)).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = []
            for rows in f["rows"]:
                cells = [[str(x["c_custkey"]), x["c_name"], x["c_mktsegment"], x["balance"]] for x in rows]
                pages = [pdf.ruled_table([["key", "name", "segment", "balance"], *cells[i : i + TABLE_ROWS]]) for i in range(0, len(cells), TABLE_ROWS)]
                made.append(pdf.rendered([[("text", pdf.LEFT, pdf.TOP, pdf.SIZE, f"page {n}"), *p] for n, p in enumerate(pages, 1)]))
            yield pd.DataFrame({"path": f["path"], "content": made})

    return rows.mapInPandas(run, "path string, content binary")


@query(
    "pdf_tables",
    "SELECT file, CAST((n - 1) // 20 + 1 AS INTEGER) AS page, CAST((n - 1) % 20 + 1 AS INTEGER) AS row_no, c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS balance "
    "FROM (SELECT *, c_custkey // 100 AS file, row_number() OVER (PARTITION BY c_custkey // 100 ORDER BY c_custkey) AS n FROM customer)",
)
def pdf_tables(spark, sf):
    """Every customer in a ruled table of a PDF file, read back cell by cell with its page."""
    found = pdf.tables(settled(pdf.marks(printed_tables(spark, sf))))
    rows = found.select(F.col("path").cast("long").alias("file"), "page", F.posexplode("rows").alias("row_no", "r"))
    return rows.select("file", "page", (F.col("row_no") + 1).alias("row_no"), F.col("r")[0].cast("long").alias("key"), F.col("r")[1].alias("name"), F.col("r")[2].alias("segment"), F.col("r")[3].alias("balance"))


@query(
    "upload_checks",
    "WITH f AS (SELECT page_id, page_id % 4 AS s, (page_id // 4) % 5 AS c FROM pages), k AS (SELECT *, CASE s WHEN 0 THEN 'HTML' WHEN 1 THEN 'PDF' WHEN 2 THEN 'DOCX' END AS format, CASE c WHEN 1 THEN 'PDF' WHEN 2 THEN 'DOCX' END AS magic FROM f) "
    "SELECT page_id, format, CASE WHEN format IS NULL THEN 'unknown format' WHEN magic <> format THEN 'content is ' || magic WHEN magic IS NULL AND format <> 'HTML' THEN 'no header of ' || format WHEN c = 3 THEN 'binary content' WHEN c = 4 THEN 'not UTF-8' END AS rejected FROM k",
)
def upload_checks(spark, sf):
    """Every page as a file of one of four names and five contents: as it is, with the first bytes of a PDF or a ZIP file, with a NUL, with a byte that is no UTF-8."""
    p, k = raw(spark, sf, "pages"), F.col("page_id")
    path = F.concat(F.lit("page"), F.element_at(F.array(*map(F.lit, (".html", ".pdf", ".docx", ".bin"))), (k % 4 + 1).cast("int")))
    first = F.element_at(F.array(*(F.lit(bytes(x)) for x in (b"", b"%PDF-1.4", b"PK\x03\x04", b"a\x00b", b"\xff"))), (F.floor(k / 4) % 5 + 1).cast("int"))
    content = F.concat(first, F.encode("html", "utf-8"))
    form = files.format_of(path)
    return p.select("page_id", form.alias("format"), files.rejection(form, content).alias("rejected"))
