"""Token counts by overlap resynchronisation.

A text up to CHUNK code points is encoded whole.  A longer one is cut into chunks that overlap;
each is encoded with offsets, and two neighbours are spliced at a position where both begin a
pre-token.  Such a position is proven stable: pre-tokens are matched from left to right and a match
looks at nothing before its start, so from a common start on both encodings agree with that of the
whole text, as long as the left one is not affected by its own end.  A margin of code points before that
end is never used: no match, look-ahead or special string decides anything farther back.  Where an
overlap holds no common start, the overlap is doubled, at last to all of the left chunk; if that holds none either
(one endless pre-token), the left chunk is doubled, so that all its encodings together are about twice the last one.
A chunk is encoded once and its encoding is handed on when the right neighbour becomes the left one.

Two engines give encodings with offsets.  The library does for any tokenizer; its word ids tell where
pre-tokens begin.  For a byte-level byte-pair tokenizer whose file is shown to say just what BytePairs
does (no normaliser, the usual pre-tokenizer pattern without a prefix space, every merge makes the token of
the next rank, each byte its own token, no dropout, prefix or fused unknowns, special strings
without white space matched as they stand) the same vocabulary is run by an engine that is four times as fast.  There a
token's length gives its offset, and a white-space character after another character is the start of a pre-token in every text,
since no alternative of the pattern has white space behind anything else.

Null and empty texts have 0 tokens and 0 bytes.  Repeated rows give repeated rows; extra columns
are ignored.  Memory: one text and one chunk's encoding at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, pieces

CHUNK = 1 << 11
OVERLAP = 1 << 7
TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024


def load(path: str):
    """The tokenizer, without truncation or padding, its offsets untrimmed so that they tile the text."""
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def byte_values() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: ASCII white space behind a word character: the start of a pre-token in any text.
_STABLE = re.compile(r"(?<=\w)[ \t\n]")


class BytePairs:
    """Byte-level byte-pair encoding with offsets, from a tokenizer's own file."""

    def __init__(self, model: dict) -> None:
        import tiktoken

        values = byte_values()
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        ranks = {bytes(values[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.special}
        self.engine = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.lengths = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, dtype=np.int64)
        for piece, i in [*ranks.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.lengths[i] = len(piece)

    @staticmethod
    def says_the_same(model: dict) -> bool:
        """Whether a tokenizer's file says just what this class does."""
        bpe, split = model["model"], model.get("pre_tokenizer") or {}
        if bpe.get("type", "BPE") != "BPE" or model.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            return False
        if bpe.get("dropout") or bpe.get("continuing_subword_prefix") or bpe.get("end_of_word_suffix") or bpe.get("byte_fallback") or bpe.get("ignore_merges"):
            return False
        vocab, special = bpe["vocab"], {x["content"] for x in model["added_tokens"]}
        for x in model["added_tokens"]:
            if x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") or re.search(r"\s", x["content"]):
                return False
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
        made = [vocab.get(a + b) for a, b in merges]
        single = {k for k in vocab if len(k) == 1}
        ordered = None not in made and all(x < y for x, y in zip(made, made[1:]))
        return ordered and single == set(byte_values()) and {v for k, v in vocab.items() if k not in single and k not in special} == set(made) and max(vocab[k] for k in single) < min(made)

    def count(self, text: str) -> int:
        return len(self.engine.encode_to_numpy(text, allowed_special="all"))

    def starts(self, text: str) -> tuple[int, ByteStarts]:
        """Number of tokens, and the stable positions."""
        ids = self.engine.encode_to_numpy(text, allowed_special="all")
        return len(ids), ByteStarts(text, np.concatenate(([0], np.cumsum(self.lengths[ids]))))


class ByteStarts:
    """Stable positions (code points) of an encoding, looked up when they are asked for."""

    def __init__(self, text: str, begin: np.ndarray) -> None:
        self.text, self.begin = text, begin

    def index(self, p: int) -> int | None:
        """The token that begins at a position, if it is stable."""
        if not _STABLE.match(self.text, p):
            return None
        done = len(self.text[:p].encode("utf-8", "replace"))
        k = int(np.searchsorted(self.begin, done))
        return k if self.begin[k] == done else None

    def before(self, high: int) -> Iterator[int]:
        """Stable positions from 1 to high."""
        return (m.start() for m in _STABLE.finditer(self.text, 1, max(high + 1, 1)))


class WordStarts:
    """The same for positions that are known."""

    def __init__(self, known: dict[int, int]) -> None:
        self.known = known

    def index(self, p: int) -> int | None:
        return self.known.get(p)

    def before(self, high: int) -> Iterator[int]:
        return (p for p in sorted(self.known) if 1 <= p <= high)


class Library:
    """The library's encodings."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def starts(self, text: str) -> tuple[int, WordStarts]:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return len(found.ids), WordStarts(dict(starts(found)))


def engine(path: str, tokenizer) -> BytePairs | Library:
    import json
    from pathlib import Path

    model = json.loads(Path(path).read_text(encoding="utf-8"))
    return BytePairs(model) if BytePairs.says_the_same(model) else Library(tokenizer)


def margin(tokenizer) -> int:
    """Code points at a chunk's end that may still change: a special string or a contraction cut short."""
    return max([8, *(len(x.content) for x in tokenizer.get_added_tokens_decoder().values())]) + 8


def starts(encoding) -> list[tuple[int, int]]:
    """(code point, index of token) for each token that begins a pre-token or a special string.

    Special strings have no word id of their own text run; a change of the word id, or a lack of
    one, marks a start.  Runs on both sides of a special string count words anew.
    """
    words, offsets, out = encoding.word_ids, encoding.offsets, []
    before: object = object()
    for i, w in enumerate(words):
        if w is None or w != before:
            out.append((offsets[i][0], i))
        before = w
    return out


def count_long(text: str, engine: BytePairs | Library, edge: int, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of a text from overlapping chunks, and the number of splices."""
    if len(text) <= chunk:
        return engine.count(text), 0
    total = splices = 0
    begin, end, cut = 0, chunk, 0  # the left chunk, and where (in the text) its own part begins
    size, known = engine.starts(text[:end])
    while True:
        skip = 0 if cut == begin else known.index(cut - begin)
        if end >= len(text):
            return total + size - skip, splices
        width = overlap
        while end - width > cut:
            right = end - width
            right_end = min(len(text), right + chunk)
            right_size, theirs = engine.starts(text[right:right_end])
            common = (right + p for p in theirs.before(width - edge) if right + p > cut and theirs.index(p) is not None)
            joined = next((p for p in common if known.index(p - begin) is not None), None)
            if joined is not None:
                total += known.index(joined - begin) - skip
                splices += 1
                # its encoding is handed on
                begin, end, cut, size, known = right, right_end, joined, right_size, theirs
                break
            width *= 2
        else:  # no common start in the whole chunk: twice as much of the text
            end = min(len(text), begin + 2 * (end - begin))
            size, known = engine.starts(text[begin:end])


def count_tokens(docs: DataFrame, path: str, *, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP, fast: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_splices for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = load(path)
        edge, own = margin(tokenizer), engine(path, tokenizer) if fast else Library(tokenizer)
        for batch in batches:
            for rows, texts in pieces(batch):
                counts = [count_long(t.decode("utf-8", "surrogatepass"), own, edge, chunk, overlap) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([c for c, _ in counts], pa.int64()), pa.array([c > limit for c, _ in counts]), pa.array([k for _, k in counts], pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_splices"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_splices long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))
