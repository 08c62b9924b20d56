"""Document files: scan, guards, and parsers to blocks and chunks.

Readers start from Spark's binaryFile source, so any store that Spark reads will do.  A parser works
on one file's bytes in an Arrow batch; PDF files have a reader of their own (parsed_pdf), whose layout is Spark's work.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import HEADINGS

#: Suffixes and formats.
FORMATS = {"pdf": "PDF", "docx": "DOCX", "md": "MARKDOWN", "markdown": "MARKDOWN", "txt": "TXT", "html": "HTML", "htm": "HTML"}
MOST_BYTES = 50 << 20
CHUNK, OVERLAP, LEAST = 800, 100, 100
#: A heading's underline, lines that only rule off, and what stands between a row's cells.
UNDERLINE, RULE, COLUMNS = re.compile(r"[-=]{4,}"), re.compile(r"[-=_~\s]{3,}"), " | "
BLOCKS = "array<struct<kind:string,level:int,text:string,caption:string,header:array<string>,rows:array<array<string>>>>"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, size, format (null if unknown), checksum, content of files within the size limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), format_of(F.col("path")).alias("format"), F.sha2("content", 256).alias("checksum"), "content").where(F.col("size") <= MOST_BYTES)


#: Bytes that say what a file is.
HEAD = 4096


def rejection(form: Column, content: Column) -> Column:
    """Why a file is not taken: its name's format is unknown, or its first bytes are not of that format; null if it is taken."""
    head = F.substring(content, 1, HEAD)
    told = F.hex(F.substring(content, 1, 4))
    magic = F.when(told == "25504446", "PDF").when(told == "504B0304", "DOCX")
    whole = lambda n: F.is_valid_utf8(F.substring(content, 1, n).cast("string"))
    # a character may be cut at the end of the head
    text = whole(HEAD) | ((F.octet_length(content) > HEAD) & (whole(HEAD - 1) | whole(HEAD - 2) | whole(HEAD - 3)))
    return (
        F.when(form.isNull(), "unknown format")
        .when(magic.isNotNull() & (magic != form), F.concat(F.lit("content is "), magic))
        .when(magic.isNull() & form.isin("PDF", "DOCX"), F.concat(F.lit("no header of "), form))
        .when(magic.isNull() & F.hex(head).rlike("^(?:..)*?00"), "binary content")
        .when(magic.isNull() & ~text, "not UTF-8")
    )


def examined(spark: SparkSession, path: str) -> DataFrame:
    """Every file that is not empty (Spark lists no empty ones) once: path, size, format, checksum, content, rejected (the reason, null if it is taken; content is only there if it is).

    Files over the limit are told by their size alone, their content is not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    form = format_of(F.col("path")).alias("format")
    small = files.where(F.col("length") <= MOST_BYTES).select("path", F.col("length").alias("size"), form, F.sha2("content", 256).alias("checksum"), "content")
    small = small.withColumn("rejected", rejection(F.col("format"), F.col("content"))).withColumn("content", F.when(F.col("rejected").isNull(), F.col("content")))
    large = files.where(F.col("length") > MOST_BYTES).select("path", F.col("length").alias("size"), form, F.lit(None).cast("string").alias("checksum"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit("over "), F.lit(MOST_BYTES), F.lit(" bytes")).alias("rejected"))
    return small.unionByName(large)


def format_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit(None).cast("string")
    for s, f in FORMATS.items():
        out = F.when(suffix == s, f).otherwise(out)
    return out


def sniffed(content: Column) -> Column:
    """What the first bytes say: PDF, ZIP (a DOCX file), BINARY if there is a NUL, else TEXT."""
    head = F.hex(F.substring(content, 1, 4096))
    return F.when(head.startswith("25504446"), "PDF").when(head.startswith("504B0304"), "ZIP").when(head.rlike("^(?:..)*?00"), "BINARY").otherwise("TEXT")


@dataclass
class Block:
    kind: str
    text: str = ""
    level: int = 0
    caption: str | None = None
    header: list[str] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().strip("|"))]


def _plain(text: str) -> str:
    return re.sub(r"(\*\*|__|\*|`)(.+?)\1", r"\2", text)


def markdown(text: str) -> list[Block]:
    """Headings, paragraphs, pipe tables with a bold line as caption; fences stay paragraphs."""
    out: list[Block] = []
    held: list[str] = []
    lines, i, fence = text.splitlines(), 0, False

    def flush() -> None:
        if held:
            out.append(Block("PARAGRAPH", joined(held)))
            held.clear()

    while i < len(lines):
        line = lines[i]
        if line.lstrip().startswith("```"):
            fence = not fence
        elif fence:
            held.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            flush()
            out.append(Block("HEADING", _plain(m[2]), len(m[1])))
        elif "|" in line and i + 1 < len(lines) and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*", lines[i + 1]):
            caption = None
            if held and (m := re.fullmatch(r"\s*\*\*(.+?)\*\*\s*", held[-1])):
                caption = m[1]
                held.pop()
            flush()
            header, rows = [_plain(c) for c in _cells(line)], []
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append([_plain(c) for c in _cells(lines[i])])
                i += 1
            out.append(Block("TABLE", caption=caption, header=header, rows=rows))
            continue
        elif line.strip():
            held.append(line)
        else:
            flush()
        i += 1
    flush()
    return out


def joined(lines: list[str]) -> str:
    """Wrapped lines as one: a space only where both sides are ASCII."""
    out = ""
    for line in (_plain(x.strip()) for x in lines):
        out += (" " if out and out[-1].isascii() and line[:1].isascii() else "") + line
    return out


def plain_text(text: str) -> list[Block]:
    """Paragraphs at blank lines.  A line above one run of four or more = or - is a heading, and so is a numbered line; other rules are no content."""
    out: list[Block] = []
    for part in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        lines, held = [x.strip() for x in part.split("\n") if x.strip()], []
        for line, below in zip(lines, [*lines[1:], ""], strict=False):  # a blank part has no lines
            level = 0
            if not RULE.fullmatch(line):
                level = (1 if below[0] == "=" else 2) if UNDERLINE.fullmatch(below) else next((n for n, p in HEADINGS.items() if re.match(p, line)), 0)
            if level and held:
                out.append(Block("PARAGRAPH", joined(held)))
                held = []
            if level:
                out.append(Block("HEADING", line, level))
            elif not RULE.fullmatch(line):
                held.append(line)
        if held:
            out.append(Block("PARAGRAPH", joined(held)))
    return out


class _Html(HTMLParser):
    SKIP, BREAK = {"script", "style", "head", "nav"}, {"p", "div", "li", "br", "tr", "section", "article", "ul", "ol", "table"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.buffer, self.level, self.skip = "", 0, 0
        self.table: Block | None = None
        self.cell: str | None = None

    def flush(self) -> None:
        text = " ".join(self.buffer.split())
        if text:
            self.out.append(Block("HEADING" if self.level else "PARAGRAPH", text, self.level))
        self.buffer = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.level = int(tag[1])
        elif tag == "table":
            self.flush()
            self.table = Block("TABLE")
        elif tag == "tr" and self.table is not None:
            self.table.rows.append([])
        elif tag in ("td", "th") and self.table is not None and self.table.rows:
            self.cell = ""
        elif tag in self.BREAK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch(r"h[1-6]", tag):
            self.flush()
            self.level = 0
        elif tag in ("td", "th") and self.cell is not None:
            self.table.rows[-1].append(" ".join(self.cell.split()))
            self.cell = None
        elif tag == "table" and self.table is not None:
            rows = [r for r in self.table.rows if r]
            self.out.append(Block("TABLE", header=rows[0] if rows else [], rows=rows[1:]))
            self.table = None
        elif tag in self.BREAK:
            self.flush()

    def handle_data(self, data):
        if self.skip:
            return
        if self.cell is not None:
            self.cell += data
        elif self.table is None:
            self.buffer += data


def html(text: str) -> list[Block]:
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return p.out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(data: bytes) -> list[Block]:
    """Body paragraphs, heading styles and tables of a DOCX file; headers and footers are other parts and stay out."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out: list[Block] = []

    def words(x) -> str:
        return "".join(t.text or "" for t in x.iter(f"{_W}t"))

    for x in root.find(f"{_W}body"):
        if x.tag == f"{_W}p" and words(x).strip():
            style = x.find(f"{_W}pPr/{_W}pStyle")
            m = re.fullmatch(r"(?i)heading\s*(\d)", style.get(f"{_W}val", "")) if style is not None else None
            out.append(Block("HEADING" if m else "PARAGRAPH", words(x).strip(), int(m[1]) if m else 0))
        elif x.tag == f"{_W}tbl":
            rows = [[words(c).strip() for c in r.iter(f"{_W}tc")] for r in x.iter(f"{_W}tr")]
            out.append(Block("TABLE", header=rows[0] if rows else [], rows=rows[1:]))
    return out


def blocks_of(content: bytes, kind: str | None) -> list[Block] | None:
    """None for what cannot be parsed here."""
    if kind == "DOCX":
        return docx(content)
    if kind in ("MARKDOWN", "TXT", "HTML"):
        return {"MARKDOWN": markdown, "TXT": plain_text, "HTML": html}[kind](content.decode("utf-8-sig", "replace"))
    return None


def parsed(files: DataFrame) -> DataFrame:
    """path, blocks (null where the file could not be parsed)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = []
            for content, kind in zip(f["content"], f["format"], strict=True):
                try:
                    blocks = blocks_of(bytes(content), kind)
                except (ElementTree.ParseError, KeyError, zipfile.BadZipFile):
                    blocks = None
                found.append(None if blocks is None else [vars(b) for b in blocks])
            yield pd.DataFrame({"path": f["path"], "blocks": found})

    return files.select("path", "format", "content").mapInPandas(run, f"path string, blocks {BLOCKS}")


def pdf_blocks(items: list[dict] | None) -> list[Block] | None:
    """Blocks of a PDF file's lines and tables (pdf.content), in reading order; a caption line is the table's below it, also on the next page."""
    if items is None:
        return None
    out: list[Block] = []
    held: list[str] = []
    caption = None

    def flush() -> None:
        if held:
            out.extend(plain_text("\n".join(held)))
            held.clear()

    for i, x in enumerate(items):
        below = items[i + 1] if i + 1 < len(items) else None
        if x["text"] is None:
            flush()
            out.append(Block("TABLE", caption=caption, header=list(x["header"]), rows=[list(r) for r in x["rows"]]))
            caption = None
        elif below is not None and below["text"] is None and (m := CAPTION.match(x["text"].strip())):
            caption = m[1].strip()
        else:
            held.append(x["text"])
    flush()
    return captioned(out)


def parsed_pdf(files: DataFrame) -> DataFrame:
    """path, blocks of PDF files (null where one cannot be read; none for a scanned one)."""
    from quarry.sources import pdf

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [pdf_blocks(None if x is None else list(x)) for x in f["items"]]
            yield pd.DataFrame({"path": f["path"], "blocks": [None if b is None else [vars(x) for x in b] for b in found]})

    return pdf.content(files).mapInPandas(run, f"path string, blocks {BLOCKS}")


#: Headings of sections that only frame a document.
FRAME = re.compile("^(修订历史|版本变更记录|修订记录|附件目录)$")
#: Fixed value: how a table's caption begins.
CAPTION = re.compile(r"^表[：:]\s*(.+)$")


def captioned(blocks: list[Block]) -> list[Block]:
    """Tables with the caption line before them; a table right after one of the same header, as on a next page, has its caption too."""
    out: list[Block] = []
    for b in blocks:
        before = out[-1] if out else Block("NONE")
        if b.kind == "TABLE" and b.caption is None:
            if before.kind == "PARAGRAPH" and (m := CAPTION.match(before.text)):
                out[-1] = replace(b, caption=m[1].strip())
                continue
            if before.kind == "TABLE" and before.header == b.header:
                b = replace(b, caption=before.caption)
        out.append(b)
    return out


def body(blocks: list[Block]) -> list[Block]:
    """Without framing sections: from such a heading to the next of the same or a higher level."""
    out, level = [], 0
    for b in blocks:
        if b.kind == "HEADING":
            if level and b.level <= level:
                level = 0
            if not level and FRAME.match(b.text.strip()):
                level = b.level
        if not level:
            out.append(b)
    return out


def table_row(caption: str | None, header: list[str], row: list[str]) -> str:
    """Lines of caption, header and row, the row padded or cut to the header; without a header the row stays whole."""
    cells = (row + [""] * len(header))[: len(header) or None]
    return "\n".join([*([f"表：{caption}"] if caption else []), *([COLUMNS.join(header)] if header else []), COLUMNS.join(cells)])


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[。！？；])|(?<=[.!?;])\s+", text) if s and s.strip()]


def chunks(blocks: list[Block], size: int = CHUNK, overlap: int = OVERLAP) -> list[tuple[list[str], str, str]]:
    """(section path, kind, text): text below its headings in pieces of at most size characters that overlap; each table row alone."""
    path: list[tuple[int, str]] = []
    out: list[tuple[list[str], str, str]] = []
    held = ""

    def names() -> list[str]:
        return [t for _, t in path]

    def flush() -> None:
        nonlocal held
        if held.strip():
            out.append((names(), "TEXT", held.strip()))
        held = ""

    for b in captioned(body(blocks)):
        if b.kind == "HEADING":
            flush()
            path = [(n, t) for n, t in path if n < b.level] + [(b.level, b.text)]
        elif b.kind == "TABLE":
            flush()
            out.extend((names(), "ROW", table_row(b.caption, b.header, r)) for r in b.rows)
        else:
            for s in sentences(b.text):
                at = 0
                while len(s) - at > size:
                    flush()
                    out.append((names(), "TEXT", s[at : at + size]))
                    at += size - overlap
                s = s[at:]
                if held and len(held) + len(s) + 1 > size:
                    tail = held[-overlap:] if overlap else ""
                    flush()
                    held = tail if len(tail) + len(s) + 1 <= size else ""
                held = f"{held} {s}".strip() if held else s
    flush()
    return out


def chunked(texts: DataFrame, key: str, text: str = "text", kind: str = "TXT", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, ordinal, section, kind, text: the chunks of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, s, c, t) for k, x in zip(f[key], f[text], strict=True) for i, (s, c, t) in enumerate(chunks(blocks_of((x or "").encode(), kind) or [], size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "ordinal", "section", "kind", "text"])

    # as text, a key beside a null one does not become a float
    told = texts.select(F.col(key).cast("long").cast("string").alias(key), text).mapInPandas(run, f"{key} string, ordinal int, section array<string>, kind string, text string")
    return told.withColumn(key, F.col(key).cast("long"))


def chunk_id(document: Column, ordinal: Column) -> Column:
    """Depends on the document and the ordinal alone."""
    return F.concat(F.lit("chk_"), F.substring(F.sha2(F.concat_ws("#", document.cast("string"), ordinal.cast("string")), 256), 1, 24))
