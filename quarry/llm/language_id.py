"""Language identification by Bayesian evidence fusion.

Evidence for a row: the likelihood of its text under byte-trigram models of the inventory's
languages, its declared language (a markup attribute or metadata field), the suffix of its address,
and a prior for its host.  Host priors are smoothed hierarchically: host counts shrink to those of
the suffix, these to those of all rows.  Models and priors are grouped aggregations over all rows.

Only trigrams with a letter count.  Of text, the mean log-likelihood a trigram counts as at most TRUST
trigrams, since neighbouring trigrams are not independent.  Besides the inventory there is one more hypothesis,
"other": every trigram equally likely, of prior probability OTHER.  The model table has (languages x 2**BITS)
entries, a proven bound.  The host table is broadcast if it has at most HOSTS rows, else joined.

Defined results: null and empty texts, and those without a letter, give no text evidence and are rejected
(there is nothing to read); a declared language outside the inventory, or null, is no evidence; a null host
counts as its own host; a row is rejected if no language reaches CERTAIN.  Repeated rows count each time.
The rows' own columns travel in a struct, so that no name of theirs can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import documents, free, hinted, pieces, ready
from quarry.llm.textkernel import LOWER

LANGUAGES = ("en", "de", "fr", "es")
BITS = 14
TRUST = 40.0
CERTAIN = 0.5
OTHER = 0.01
#: Probability that a declared language or an address suffix is that of the text.
DECLARED, SUFFIX = 0.9, 0.8
#: Rows that a parent's distribution counts for.
SHRINK = 20.0
#: Trigrams that the shared distribution counts for in each language's model.
OWN = 2000.0
#: Share of the uniform distribution in each model, so that an unseen trigram tells little.
FLOOR = 0.1
NEVER = -30.0
HOSTS = 100_000
#: Languages of some country suffixes; others say nothing.
SUFFIXES = {"uk": "en", "us": "en", "ie": "en", "au": "en", "de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es"}
_TABLES: dict[str, np.ndarray] = {}


def trigrams(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams with a letter of the lower-cased bytes, and the texts' offsets; digits count as one character."""
    fold = bytes(0x30 if 0x30 <= b <= 0x39 else b for b in LOWER)
    joined = np.frombuffer(b"".join(b" " + t.translate(fold) + b" " for t in texts), dtype=np.uint8)
    lengths = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(lengths)
    if len(joined) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    letter = ((joined >= 0x61) & (joined <= 0x7A)) | (joined >= 0x80)
    inside = letter[:-2] | letter[1:-1] | letter[2:]
    inside[ends[:-1] - 1] = False  # those that begin at a text's last two bytes belong to no text
    inside[ends[:-1] - 2] = False
    at = joined.astype(np.uint32)
    code = ((at[:-2] << 16 | at[1:-1] << 8 | at[2:]) * np.uint32(2654435761)) >> np.uint32(32 - bits)
    so_far = np.concatenate(([0], np.cumsum(inside)))
    return code[inside], np.concatenate(([0], so_far[np.minimum(ends, len(inside))]))


def index_of(value: Column, languages: tuple[str, ...] = LANGUAGES) -> Column:
    """Index of a language tag (its first part, any case) in the inventory; null for others."""
    head = F.lower(F.substring_index(F.substring_index(F.trim(value), "-", 1), "_", 1))
    out = F.lit(None).cast("int")
    for i, x in enumerate(languages):
        out = F.when(head == x, F.lit(i)).otherwise(out)
    return out


def evidence(rows: DataFrame, *, text: str = "text", declared: str | None = "lang", host: str | None = "source", url: str | None = None) -> DataFrame:
    """_row (a struct of the rows' columns), _text, _declared, _host and _suffix."""
    address = F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)", 1)) if url else None
    name = F.col(host).cast("string") if host else (address if url else F.lit(None).cast("string"))
    suffix = F.regexp_extract(address, r"\.([a-z]+)$", 1) if url else F.lit(None).cast("string")
    tag = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    # the text itself stands in _row as null, not twice
    row = F.struct(*(F.lit(None).cast("string").alias(c) if c == text and rows.schema[c].dataType == T.StringType() else F.col(f"`{c}`").alias(c) for c in rows.columns))
    return rows.select(row.alias("_row"), F.col(text).cast("string").alias("_text", metadata={"column": text}), tag.alias("_declared"), F.coalesce(name, F.lit("")).alias("_host"), F.coalesce(suffix, F.lit("")).alias("_suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Evidence of raw web pages: visible text, the html lang attribute or content-language, and the address."""
    html = F.col("html")
    attribute = F.regexp_extract(html, r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    meta = F.regexp_extract(html, r"(?is)<meta[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z-]+)", 1)
    visible = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    text, lang = free("_page_text", pages.columns), free("_page_lang", pages.columns)
    told = evidence(pages.withColumns({text: visible, lang: F.when(attribute != "", attribute).otherwise(meta)}), text=text, declared=lang, host=None, url="url")
    return told.withColumn("_row", F.struct(*(F.col("_row")[c].alias(c) for c in pages.columns)))


def train(rows: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, bits: int = BITS) -> np.ndarray:
    """(languages x 2**bits) log-probabilities from all rows that declare a language of the inventory."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), size), dtype=np.int64)
        for batch in batches:
            for some, texts in pieces(batch, "_text"):
                code, at = trigrams(texts, bits)
                lang = some.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                total += np.bincount(np.repeat(lang, np.diff(at)) * size + code, minlength=total.size).reshape(total.shape)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.int64())], names=["cell", "n"])

    told = rows.select("_text", index_of(F.col("_declared"), languages).alias("g")).where("g is not null and _text is not null")
    counts = np.zeros(len(languages) * size)
    table = told.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[table.column("cell").to_numpy()] += table.column("n").to_numpy()
    counts = counts.reshape(len(languages), size)
    # a language leans on what all texts share as far as it has little text of its own
    shared = counts.sum(axis=0) + 0.5
    shared /= shared.sum()
    out = np.log((1 - FLOOR) * (counts + OWN * shared) / (counts.sum(axis=1, keepdims=True) + OWN) + FLOOR / size)
    out[counts.sum(axis=1) == 0] = NEVER  # a language that no row declares is no candidate
    return out.astype(np.float32)


def with_likelihoods(rows: DataFrame, model: np.ndarray, *, trust: float = TRUST) -> DataFrame:
    """rows with _trigrams and _likelihood (array of log-likelihoods, tempered, in the order of the inventory)."""
    name = uuid.uuid4().hex
    shared = rows.sparkSession.sparkContext.broadcast(model)
    bits = int(model.shape[1]).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = shared.value
        table = _TABLES[name]
        for batch in batches:
            for some, texts in pieces(batch, "_text"):
                code, at_ = trigrams(texts, bits)
                n = np.diff(at_)
                sums = np.stack([np.diff(np.concatenate(([0.0], np.cumsum(table[g][code], dtype=np.float64)))[at_]) for g in range(len(table))], axis=1)
                tempered = np.round(sums / np.maximum(n, 1)[:, None] * np.minimum(n, trust)[:, None], 6)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(table)), pa.array(tempered.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(n, pa.int64()), lists], names=[*some.schema.names, "_trigrams", "_likelihood"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_trigrams", T.LongType()), T.StructField("_likelihood", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def host_priors(rows: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, shrink: float = SHRINK) -> DataFrame:
    """_host, _suffix, _prior: smoothed log-probabilities of the languages, from what rows declare."""
    told = rows.select("_host", "_suffix", index_of(F.col("_declared"), languages).alias("g"))
    n = [F.count(F.when(F.col("g") == i, 1)).cast("double").alias(f"n{i}") for i in range(len(languages))]
    hosts = told.groupBy("_host", "_suffix").agg(*n)
    names = [f"n{i}" for i in range(len(languages))]
    suffixes = hosts.groupBy("_suffix").agg(*(F.sum(c).alias(f"s{i}") for i, c in enumerate(names)))
    every = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"a{i}") for i, c in enumerate(names)))

    def total(prefix: str) -> Column:
        return sum((F.col(f"{prefix}{i}") for i in range(len(languages))), F.lit(0.0))

    def share(prefix: str, i: int, parent: Column) -> Column:
        return (F.col(f"{prefix}{i}") + shrink * parent) / (total(prefix) + shrink)

    def smoothed(i: int) -> Column:
        return F.log(share("n", i, share("s", i, share("a", i, F.lit(1.0 / len(languages))))))

    joined = hosts.join(suffixes, "_suffix").crossJoin(F.broadcast(every))  # every is one row
    return joined.select("_host", "_suffix", F.array(*(F.round(smoothed(i), 9) for i in range(len(languages)))).alias("_prior"))


def fused(rows: DataFrame, priors: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, certain: float = CERTAIN, hosts: int = HOSTS, trust: float = TRUST, bits: int = BITS) -> DataFrame:
    """rows with _language, _posterior and _rejected."""
    joined = rows.join(hinted(priors, hosts), ["_host", "_suffix"], "left")
    k = len(languages)
    declared, suffix = index_of(F.col("_declared"), languages), F.lit(None).cast("int")
    for s, lang in SUFFIXES.items():
        if lang in languages:
            suffix = F.when(F.col("_suffix") == s, F.lit(languages.index(lang))).otherwise(suffix)

    def told(which: Column, i: int, right: float) -> Column:
        return F.when(which.isNull(), F.lit(0.0)).when(which == i, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log((1 - right) / max(1, k - 1)))))

    logs = F.array(*(F.col("_likelihood")[i] + F.coalesce(F.col("_prior")[i], F.lit(0.0)) + told(declared, i, DECLARED) + told(suffix, i, SUFFIX) for i in range(k)))
    out = joined.withColumn("_logs", logs)
    other = float(np.log(OTHER)) - bits * float(np.log(2)) * F.least(F.col("_trigrams").cast("double"), F.lit(trust))
    weights = F.transform(F.concat("_logs", F.array(other)), lambda x: F.exp(x - F.array_max("_logs")))
    out = out.withColumn("_posterior", F.round(1.0 / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x), 6))
    best = F.element_at(F.array(*map(F.lit, languages)), F.array_position("_logs", F.array_max("_logs")).cast("int"))
    rejected = (F.col("_trigrams") == 0) | (F.col("_posterior") < certain)
    return out.withColumn("_language", F.when(F.col("_trigrams") > 0, best)).withColumn("_rejected", rejected)


def identify(rows: DataFrame, *, languages: tuple[str, ...] = LANGUAGES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """rows: the outcome of evidence().  The columns keep of what it was made of (all by default), then _language, _posterior, _rejected (with a trailing _ where keep has such names)."""
    ready(rows.sparkSession)
    model = train(rows, languages=languages)
    keep = tuple(rows.schema["_row"].dataType.names) if keep is None else keep
    kept = F.struct(*(F.col("_row")[c].alias(c) for c in keep)) if keep else F.lit(None).cast("int")
    slim = rows.select(kept.alias("_row"), "_text", "_declared", "_host", "_suffix")
    scored = fused(with_likelihoods(slim, model), host_priors(rows, languages=languages), languages=languages)
    names = [free(c, keep) for c in ("_language", "_posterior", "_rejected")]
    text = rows.schema["_text"].metadata.get("column")
    whole = text in keep and rows.schema["_row"].dataType[text].dataType == T.StringType()
    return scored.select(*(F.col("_text").alias(c) if whole and c == text else F.col("_row")[c].alias(c) for c in keep), *(F.col(c).alias(n) for c, n in zip(("_language", "_posterior", "_rejected"), names)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all pages: kind, doc_id or page_id, language, posterior, rejected."""
    none = F.lit(None).cast("long")
    docs = evidence(documents(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id"), "text", "lang", "source"))
    pages = page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("page").alias("kind"), none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), "url", "html"))
    columns = ("kind", "doc_id", "page_id")
    row = F.struct(*(F.col("_row")[c].alias(c) for c in columns))
    found = identify(docs.withColumn("_row", row).unionByName(pages.withColumn("_row", row)), keep=columns)
    return found.select(*columns, F.col("_language").alias("language"), F.col("_posterior").alias("posterior"), F.col("_rejected").alias("rejected"))
