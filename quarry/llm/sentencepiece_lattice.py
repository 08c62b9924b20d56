"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units at places that no piece of the model crosses: before a run of word marks, around
a line break or a digit, between letters and other signs, and, within a unit of over LONGEST characters,
between any two characters that no piece has side by side.  The distinct units of all texts are counted;
bounded-length substrings of each are exploded, joined with the piece table by equality, and the edges are
grouped by unit and folded by Spark's higher-order aggregate:

* for a unigram model the fold is Viterbi's: the best score of every position from left to right;
* for a byte-pair model (the one used here) the score of a piece is its merge rank and no
  log-probability, so the best path of the lattice is not what the model means.  There the fold
  takes, again and again, the edge of best rank whose ends are boundaries with just one boundary
  between them, the leftmost among equals, which is the library's result.

Units that occur most often, at most HOT of them (a proven bound), are told to all tasks by their 64-bit
hashes; occurrences of the others are joined by unit.  Characters without a piece become byte pieces.

A unit that still has over LONGEST characters (one character repeated, say) is cut into windows, whose edges come from
the same join; they are folded from left to right in order of the windows.  For a byte-pair model a sequence of pieces is the
merging of its text just if the merging of each two neighbours leaves those two pieces: the first merge across a border
would also be made in those two alone.  So the last piece of every prefix is the one edge that stands the piece before it.

The ids of every document are put together in order, and decoded again from there.  encode() gives of each row:

* ids_digest: the sum of (id + 1) * (M * place + 7) modulo 2**31 - 1, M = 1000003; the place of a piece is 4 times
  the code point (of the text with word marks, the first being 0) that it begins at, plus the number of the
  byte for byte pieces;
* text_digest: the sum of c * (M * place + 7) over the decoded characters c, by the code point's place in the
  text with its leading word mark; round_trip says whether it and n_decoded are those of the given text;
* with whole also the ids and the decoded text themselves.

Defined results: null and empty texts have no pieces; repeated rows are encoded each; a text with a
word mark of its own decodes to a space there, as in the library, and counts as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, dropped, is_plain, numbered, pieces, ready, written
from quarry.llm.textkernel import U, mix, span_hashes

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LONGEST = 62
HOT = 1 << 19
#: Spark's setting for the groups that a task aggregates by hash before it sorts all rows instead, and so many: a unit takes about a kB.
HASHED, GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 1 << 17
#: Characters of text that are decoded at once, or one text of more.
AT_ONCE = 1 << 19
#: Bit of a packed edge of one character; below it are 19 bits for its id plus one.
SINGLE = 1 << 19
#: Code points whose single pieces are looked up by number.
DIRECT = 1 << 11
#: Score of a character without a piece.
UNKNOWN = -1e4
PRIME, PLACE = (1 << 31) - 1, 1_000_003


@cache
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def is_unigram(path: str) -> bool:
    """A byte-pair model's scores are its ranks: whole numbers."""
    sp = processor(path)
    scores = [sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
    return any(s != int(s) for s in scores)


def merged_alone(text: str, ranks: dict[str, int]) -> tuple[list[str], bool]:
    """Byte-pair merging of one text, and whether its merges came in order of rank."""
    parts, last, ordered = list(text), (-1, -1), True
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return parts, ordered
        ordered &= best[0] >= last[0]
        last = best
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@cache
def all_ranks(path: str) -> dict[str, int]:
    """Merge rank of each normal piece."""
    sp = processor(path)
    normal = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    order = {s: r for r, s in enumerate(sorted(set(normal.values()), reverse=True))}
    return {p: order[s] for p, s in normal.items()}


@cache
def reachable(path: str) -> tuple[frozenset[str], bool]:
    """Pieces that merging can form, and whether one pass over a unit's edges by rank is enough.

    As long as both ends of a piece stay boundaries, what happens between them is what happens to
    the piece alone.  So a piece that does not merge to itself alone is never formed and can be left
    out; and if every other piece merges alone in order of rank, all merges of any unit come in that
    order, and each edge need be looked at once.  Where that fails, the fold looks for the best edge
    again after each merge.
    """
    ranks = all_ranks(path)
    alone = {p: merged_alone(p, ranks) for p in ranks}
    formed = frozenset(p for p, (parts, _) in alone.items() if len(parts) == 1)
    return formed, all(alone[p][1] for p in formed)


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """piece, id, rank (0 best), score: the normal pieces.  A model file's vocabulary bounds its size."""
    sp = processor(path)
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    if any(breaks(np.array(list(map(ord, sp.id_to_piece(i))), dtype=np.uint32))[1:].any() for i in normal):
        raise ValueError("this model has pieces that cross the units' borders")
    # equal scores share a rank, so that among them the leftmost edge wins
    ranks = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
    kept = normal if is_unigram(path) else [i for i in normal if sp.id_to_piece(i) in reachable(path)[0]]
    return spark.createDataFrame([(sp.id_to_piece(i), i, ranks[sp.get_score(i)], float(sp.get_score(i))) for i in kept], "piece string, id int, rank int, score double")


_OTHER, _LETTER, _DIGIT, _LINE, _MARK = range(5)


@cache
def kinds() -> np.ndarray:
    """Kind of each code point."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            out[c] = _LETTER if ch.isalpha() else _DIGIT if ch.isdecimal() else _OTHER
    out[10], out[ord(MARK)] = _LINE, _MARK
    return out


@cache
def mixed() -> np.ndarray:
    """What each code point gives to its unit's hash."""
    return mix(np.arange(0x110000, dtype=np.uint64) + U(0x9E3779B9))


def breaks(points: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each of a text's code points; the first does."""
    out = np.ones(len(points), dtype=bool)
    kind = kinds()[points]
    x, y = kind[:-1], kind[1:]
    out[1:] = ((x != _MARK) & ((x != y) | (y == _DIGIT))) | (y == _LINE)
    return out


@cache
def neighbours(path: str) -> frozenset[str]:
    """All pairs of characters that stand side by side in a piece."""
    sp = processor(path)
    return frozenset(p[k : k + 2] for p in map(sp.id_to_piece, range(sp.get_piece_size())) for k in range(len(p) - 1))


class Units:
    """The units of a batch of texts: the texts put together (text), its code points, and each unit's place and hash."""

    def __init__(self, texts: list[bytes], path: str) -> None:
        parts = [MARK + t.decode("utf-8", "replace").replace(" ", MARK) if t else "" for t in texts]
        self.text = "".join(parts)
        self.points = np.frombuffer(self.text.encode("utf-32-le"), dtype=np.uint32)
        #: Where each text begins; one more for the end.
        self.offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        size = len(self.points)
        cut = breaks(self.points)
        cut[self.offsets[:-1][self.offsets[:-1] < size]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], size)
        long = np.flatnonzero(ends - starts > LONGEST)
        if len(long):
            pairs, more = neighbours(path), []
            for a, b in zip(starts[long].tolist(), ends[long].tolist()):
                more += [i for i in range(a + 1, b) if self.text[i - 1 : i + 1] not in pairs]
            starts = np.union1d(starts, np.array(more, dtype=np.int64))
            ends = np.append(starts[1:], size)
        self.starts, self.ends = starts, ends[: len(starts)]
        self.hashes = span_hashes(mixed()[self.points], self.starts, self.ends)
        #: The first unit of each text; one more for the end.
        self.first = np.searchsorted(self.starts, self.offsets)

    def listed(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def units_of(text: str, path: str) -> list[str]:
    u = Units([text.encode()], path)
    return u.listed(np.arange(len(u.starts)))


def count_units(docs: DataFrame, path: str) -> DataFrame:
    """unit, n: over all texts; each slice of a task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in pieces(batch):
                u = Units(texts, path)
                _, at, n = np.unique(u.hashes, return_index=True, return_counts=True)
                fits = (u.ends - u.starts)[at] <= LONGEST
                yield pa.RecordBatch.from_arrays([pa.array(u.listed(at[fits]), pa.string()), pa.array(n[fits], pa.int64())], names=["unit", "n"])

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def edges(units: DataFrame, table: DataFrame, longest: int, singles: bool = True) -> DataFrame:
    """unit, n, start, size, id (null for a single character without a piece), rank, score.

    Without singles, characters below DIRECT stay out but for a unit's first: byte-pair merging looks their ids up by code point.
    """
    starts = units.select("unit", "n", F.length("unit").alias("length"), F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("start"))
    spans = starts.select("unit", "n", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("length") - F.col("start")))).alias("size"))
    if not singles:
        # a unit keeps one row even if none of its substrings is a piece
        spans = spans.where((F.col("size") > 1) | (F.col("start") == 0) | (F.ascii(F.substring("unit", F.col("start") + 1, F.lit(1))) >= DIRECT))
    found = spans.withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("size"))).join(F.broadcast(table), "piece", "left")
    return found.where("id is not null or size = 1").drop("piece")


def byte_ids(c: Column, first_byte: int) -> Column:
    """Ids of the byte pieces of a character."""
    code = F.hex(F.encode(c, "utf-8"))
    return F.transform(F.sequence(F.lit(1), F.length(code).cast("int"), F.lit(2)), lambda i: F.conv(F.substring(code, i, F.lit(2)), 16, 10).cast("int") + first_byte)


def path_ids(unit: Column, path: Column, first_byte: int) -> Column:
    """Ids of a path (array of (start, id)); id -1 stands for a character's bytes."""
    ordered = F.sort_array(path)
    return F.flatten(F.transform(ordered, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(byte_ids(F.substring(unit, x["start"] + 1, F.lit(1)), first_byte))))


def direct_ids(path: str) -> list[int]:
    """Piece id of each code point below DIRECT, -1 without one."""
    sp = processor(path)
    out = []
    for c in range(DIRECT):
        i = sp.piece_to_id(chr(c))
        out.append(-1 if sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.id_to_piece(i) != chr(c) else i)
    return out


def folded_pairs(grouped: DataFrame, path: str, once: bool = False) -> DataFrame:
    """Byte-pair merging.  Boundaries are the bits of a long; edges come sorted by rank and start; once: see reachable()."""

    first_byte = processor(path).piece_to_id("<0x00>")
    direct = F.array(*map(F.lit, direct_ids(path)))  # folded to one literal

    def unpacked(x: Column) -> Column:
        start, end = F.shiftright(x, 26).bitwiseAND(63), F.shiftright(x, 20).bitwiseAND(63)
        left, right = bit(start), bit(end)
        return F.struct(left.bitwiseOR(right).alias("ends"), (right - left - left).alias("inner"), start.cast("int").alias("start"), (x.bitwiseAND((1 << 19) - 1) - 1).cast("int").alias("id"))

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))

    def several(x: Column) -> Column:
        return x.bitwiseAND(SINGLE) == 0

    # edges of one character never merge and are needed only at the end
    listed = grouped.select("unit", "n", F.transform(F.sort_array(F.filter("packed", several)), unpacked).alias("edges"), F.filter("packed", lambda x: ~several(x)).alias("singles"))

    def can(state: Column, e: Column) -> Column:
        return (state.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(state.bitwiseAND(e["inner"])) == 1)

    def merge(state: Column, e: Column) -> Column:
        return F.when(can(state, e), state.bitwiseAND(F.bitwise_not(e["inner"]))).otherwise(state)

    def merge_best(state: Column, _: Column) -> Column:
        first = F.get(F.filter("edges", lambda e: can(state, e)), F.lit(0))
        # once nothing merges the sign says so, and further steps cost nothing
        return F.when(state < 0, state).otherwise(F.coalesce(state.bitwiseAND(F.bitwise_not(first["inner"])), -state))

    start_state = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.length("unit") + 1))  # all of the first length + 1 bits, up to 63
    if once:
        folded = F.aggregate("edges", start_state, merge)
    else:
        steps = F.sequence(F.lit(1), F.greatest(F.length("unit") - 1, F.lit(1)))
        folded = F.abs(F.aggregate(steps, start_state, merge_best))
    merged = listed.withColumn("state", folded)

    def taken(e: Column) -> Column:
        return (F.col("state").bitwiseAND(e["ends"]) == e["ends"]) & (F.col("state").bitwiseAND(e["inner"]) == 0)

    many = F.transform(F.filter("edges", taken), lambda e: F.struct(e["start"].alias("start"), e["id"].alias("id")))

    def alone(i: Column) -> Column:
        return F.call_function("shiftright", F.col("state"), i).bitwiseAND(3) == 3

    def single(i: Column) -> Column:
        code = F.ascii(F.substring(F.col("unit"), i + 1, F.lit(1)))
        far = F.get(F.filter("singles", lambda x: F.shiftright(x, 26).bitwiseAND(63) == i), F.lit(0))
        id_ = F.when(code < DIRECT, F.get(direct, code)).otherwise((far.bitwiseAND((1 << 19) - 1) - 1).cast("int"))
        return F.struct(i.alias("start"), id_.alias("id"))

    places = F.sequence(F.lit(0), F.length("unit") - 1)
    whole = F.concat(many, F.transform(F.filter(places, alone), single))
    return merged.select("unit", "n", path_ids(F.col("unit"), whole, first_byte).alias("ids"))


def folded_viterbi(grouped: DataFrame, first_byte: int, unknown: float = UNKNOWN) -> DataFrame:
    """Best-scored path.  grouped has edges (end, start, id, score), sorted by end and start."""
    none = F.expr("cast(array() as array<struct<start:int,id:int>>)")
    first = F.array(F.struct(F.lit(0.0).cast("double").alias("score"), none.alias("path")))

    def step(best: Column, e: Column) -> Column:
        before = F.element_at(best, e["start"] + 1)
        total = before["score"] + F.coalesce(e["score"], F.lit(unknown))
        now = F.struct(total.alias("score"), F.concat(before["path"], F.array(F.struct(e["start"].alias("start"), e["id"].alias("id")))).alias("path"))
        opens = F.size(best) == e["end"]
        better = total > F.element_at(best, F.least(e["end"] + 1, F.size(best)))["score"]
        return F.when(opens, F.concat(best, F.array(now))).when(better, F.concat(F.slice(best, 1, e["end"]), F.array(now))).otherwise(best)

    found = F.aggregate(F.sort_array("edges"), first, step, lambda best: F.element_at(best, -1)["path"])
    return grouped.select("unit", "n", path_ids(F.col("unit"), found, first_byte).alias("ids"))


def longest_piece(path: str) -> int:
    sp = processor(path)
    return max(len(sp.id_to_piece(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))


def encode_units(units: DataFrame, path: str) -> DataFrame:
    """unit, n, ids."""
    sp = processor(path)
    table = piece_table(units.sparkSession, path)
    first_byte = sp.piece_to_id("<0x00>")
    longest = longest_piece(path)
    if is_unigram(path):
        lattice = edges(units, table, longest)
        edge = F.struct((F.col("start") + F.col("size")).alias("end"), "start", F.coalesce("id", F.lit(-1)).alias("id"), "score")
        return folded_viterbi(lattice.groupBy("unit", "n").agg(F.collect_list(edge).alias("edges")), first_byte)
    lattice = edges(units, table, longest, singles=False)
    rank = F.coalesce(F.col("rank"), F.lit(0)).cast("long")
    start = F.col("start").cast("long")
    packed = rank * (1 << 32) + start * (1 << 26) + (start + F.col("size")) * (1 << 20) + F.when(F.col("size") == 1, SINGLE).otherwise(0) + F.coalesce(F.col("id"), F.lit(-1)) + 1
    return folded_pairs(lattice.groupBy("unit", "n").agg(F.collect_list(packed).alias("packed")), path, reachable(path)[1])


def decoded(ids: DataFrame, path: str, key: str, column: str = "ids") -> DataFrame:
    """key, text for rows of key (not repeated) and ids: pieces joined by id, put together by place."""
    rows = [(i, b.hex()) for i, b in enumerate(piece_bytes(path))]
    table = ids.sparkSession.createDataFrame(rows, "id int, code string")
    apart = ids.select(key, F.posexplode(column).alias("place", "id")).join(F.broadcast(table), "id")
    whole = apart.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("parts"))
    text = F.decode(F.unhex(F.array_join(F.transform("parts", lambda x: x["code"]), "")), "utf-8")
    return ids.select(key).join(whole.select(key, F.regexp_replace(text, "^ ", "").alias("text")), key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def piece_bytes(path: str) -> list[bytes]:
    """What each id decodes to."""
    sp = processor(path)
    return [bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(sp.get_piece_size())]


@lru_cache(maxsize=1 << 18)
def joins(path: str, a: str, b: str) -> bool:
    """Whether the merging of the two texts together leaves these two."""
    return merged_alone(a + b, all_ranks(path))[0] == [a, b]


class Fold:
    """The pieces of one unit, from edges that come in order of their starts: for each end the last piece of the text up to there."""

    def __init__(self, path: str) -> None:
        self.path, self.unigram = path, is_unigram(path)
        self.size, self.id, self.text, self.score = [0], [-1], [""], [0.0]

    def edge(self, start: int, id_: int, text: str) -> None:
        end = start + len(text)
        score = 0.0
        if self.unigram:
            score = self.score[start] + (processor(self.path).get_score(id_) if id_ >= 0 else UNKNOWN)
            taken = end >= len(self.size) or not self.size[end] or score > self.score[end]
        else:
            taken = start == 0 or joins(self.path, self.text[start], text)
        if taken:
            for own, none in ((self.size, 0), (self.id, -1), (self.text, ""), (self.score, 0.0)):
                own.extend([none] * (end + 1 - len(own)))
            self.size[end], self.id[end], self.text[end], self.score[end] = len(text), id_, text, score

    def ids(self, first_byte: int) -> list[int]:
        out, at = [], len(self.size) - 1
        while at:
            out += [self.id[at]] if self.id[at] >= 0 else [first_byte + b for b in reversed(self.text[at].encode())]
            at -= self.size[at]
        return out[::-1]


def encode_long(units: DataFrame, path: str) -> DataFrame:
    """unit, ids of distinct units of any length: windows, their edges by the join with the pieces, and a fold in order of the windows."""
    sp = processor(path)
    first_byte, longest = sp.piece_to_id("<0x00>"), longest_piece(path)
    units = written(units.select(F.monotonically_increasing_id().alias("key"), "unit"), "long_units")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, unit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in range(0, len(unit), LONGEST << 10):
                    at = range(i, min(len(unit), i + (LONGEST << 10)), LONGEST)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([unit[k : k + LONGEST + longest - 1] for k in at], pa.string())], names=["key", "at", "unit"])

    windows = written(units.mapInArrow(cut, "key long, at long, unit string"), "windows")
    lattice = edges(windows.select("unit", F.lit(1).cast("long").alias("n")).distinct(), piece_table(units.sparkSession, path), longest).where(F.col("start") < LONGEST)
    edge = F.col("start").cast("long") * (1 << 32) + F.col("size") * (1 << 24) + F.coalesce("id", F.lit(-1)) + 1
    of_window = lattice.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    ordered = windows.join(of_window, "unit").select("key", "at", "unit", "edges").repartition("key").sortWithinPartitions("key", "at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.ids(first_byte)], pa.list_(pa.int32()))], names=["key", "ids"])

        now, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key, at, text = (batch.column(c)[i].as_py() for c in range(3))
                if key != now:
                    if state:
                        yield done()
                    now, state = key, Fold(path)
                for x in batch.column(3)[i].values.to_numpy().tolist():
                    start = x >> 32
                    state.edge(at + start, (x & (1 << 24) - 1) - 1, text[start : start + (x >> 24 & 255)])
        if state:
            yield done()

    return units.join(ordered.mapInArrow(fold, "key long, ids array<int>"), "key").select("unit", "ids")


def hot_units(table: DataFrame, path: str, most: int | None = None) -> tuple[tuple[np.ndarray, ...], DataFrame]:
    """(sorted hashes, the number of each by falling count, where the ids of each number begin and one more for the end, ids) of the units above a count that at most so many units reach; and the other units."""
    most = HOT if most is None else most
    level = F.when(F.col("n") < 64, F.col("n")).otherwise(F.floor(F.log2(F.col("n").cast("double"))) + 64).cast("int")
    sizes = dict(table.groupBy(level.alias("level")).count().collect())  # at most 128 rows
    total, least = 0, 1 << 30
    for k in sorted(sizes, reverse=True):
        if total + sizes[k] > most:
            break
        total, least = total + sizes[k], k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of(batch.column(0).to_pylist()).view(np.int64)), batch.column(1), batch.column(2)], names=["hash", "n", "ids"])

    # the units themselves stay where they are: the driver gets numbers
    rows = table.where(level >= least).select("unit", "n", "ids").mapInArrow(run, "hash long, n long, ids array<int>").toArrow()
    hashes = rows["hash"].to_numpy().view(np.uint64)
    order, by_count = np.argsort(hashes), np.argsort(-rows["n"].to_numpy(), kind="stable")
    number = np.empty(len(order), dtype=np.int32)
    number[by_count] = np.arange(len(order), dtype=np.int32)
    sizes_of, flat = listed(rows["ids"])
    begin = np.cumsum(sizes_of) - sizes_of
    told = hashes[order], number[order], np.concatenate(([0], np.cumsum(sizes_of[by_count]))), flat[ragged(begin[by_count], sizes_of[by_count])]
    return told, table.where(level < least).select("unit", "ids")


def listed(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many values each row of a column of lists has, and all of them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def ragged(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)


def short(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of numbers below 2**21, 7 bits each, all but a number's last with the high bit; and where each number begins, one more for the end."""
    sizes = 1 + (values >= 1 << 7) + (values >= 1 << 14)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(begin[-1]), dtype=np.uint8)
    last = begin[1:] - 1
    out[last] = values & 127
    for k in (1, 2):
        some = sizes > k
        out[last[some] - k] = values[some] >> 7 * k & 127 | 128
    return out, begin


def unshort(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and where the last byte of each is."""
    last = np.flatnonzero(code < 128)
    sizes = np.diff(last, prepend=-1)
    values = code[last].astype(np.int64)
    for k in (1, 2):
        some = sizes > k
        values[some] |= (code[last[some] - k].astype(np.int64) & 127) << 7 * k
    return values, last


def hashes_of(units: list[str]) -> np.ndarray:
    """64-bit hashes of units, as Units has them."""
    ends = np.cumsum([len(u) for u in units]).astype(np.int64)
    points = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
    return span_hashes(mixed()[points], np.concatenate(([0], ends[:-1])).astype(np.int64) if units else ends, ends)


def digests(values: np.ndarray, places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text the sum of its values by their places."""
    return summed(values * ((PLACE * places + 7) % PRIME) % PRIME, first) % PRIME


def summed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(x)))[first])


def own_places(first: np.ndarray) -> np.ndarray:
    """Of each item its number in its text."""
    return np.arange(int(first[-1])) - np.repeat(first[:-1], np.diff(first))


class Decoder:
    """What ids decode to, and where in the text they stand."""

    def __init__(self, path: str) -> None:
        sp = processor(path)
        known = piece_bytes(path)
        self.sizes = np.array([len(b) for b in known], dtype=np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(known), dtype=np.uint8)
        self.byte = np.array([sp.is_byte(i) for i in range(len(known))])
        value = np.array([b[0] if b else 0 for b in known])
        #: Characters that begin with a piece: none with a byte inside a character.
        self.chars = np.where(self.byte, (value & 0xC0) != 0x80, [len(sp.id_to_piece(i)) for i in range(len(known))]).astype(np.int64)

    def places(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        chars = self.chars[ids]
        after = np.cumsum(chars)
        after -= np.repeat(np.concatenate(([0], after))[first[:-1]], np.diff(first))
        inside = self.byte[ids] & (chars == 0)
        if not inside.any():
            return 4 * (after - chars)
        number = np.arange(len(ids))
        return np.where(inside, 4 * (after - 1) + number - np.maximum.accumulate(np.where(inside, 0, number)), 4 * (after - chars))

    def texts(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts with the space of the leading word mark."""
        sizes = self.sizes[ids]
        at = np.concatenate(([0], np.cumsum(sizes)))[first].tolist()
        whole = self.bytes[ragged(self.begin[ids], sizes)].tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


class Numbers:
    """The numbers of told units, looked up by hash: the top bits say where in the sorted hashes to look."""

    BITS = 20

    def __init__(self, told: tuple[np.ndarray, ...]) -> None:
        self.hashes, self.number = told[:2]
        top = (self.hashes >> U(64 - self.BITS)).astype(np.int64)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(top, minlength=1 << self.BITS))))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """From 1 on, 0 for units that are not told."""
        top = (hashes >> U(64 - self.BITS)).astype(np.int64)
        at, end = self.begin[top], self.begin[top + 1]
        out = np.zeros(len(hashes), dtype=np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.hashes[at[left]] == hashes[left]
            out[left[same]] = self.number[at[left[same]]].astype(np.int64) + 1
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


def coded(rows: DataFrame, path: str, shared: Broadcast) -> DataFrame:
    """Of each row the numbers of its units (code), and size and digest of its text."""
    schema = "row long, doc_id long, n_units long, code binary, given_chars long, given long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value)
        for batch in batches:
            for some, texts in pieces(batch):
                u = Units(texts, path)
                number = numbers(u.hashes)
                code, begin = short(number)
                binary = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(begin[u.first].astype(np.int32)), pa.py_buffer(code)])
                given = np.where(u.points == ord(MARK), 32, u.points).astype(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.diff(u.first)), binary, pa.array(np.diff(u.offsets)), pa.array(digests(given, own_places(u.offsets), u.offsets))], names=names)

    return rows.mapInArrow(run, schema)


def rare_units(rows: DataFrame, path: str, shared: Broadcast) -> DataFrame:
    """row, place, unit of every occurrence of a unit that is not told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(shared.value)
        for batch in batches:
            for some, texts in pieces(batch):
                u = Units(texts, path)
                number = numbers(u.hashes)
                rare = np.flatnonzero(number == 0)
                of = np.repeat(np.arange(len(texts)), np.diff(u.first))[rare]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), pa.array(rare - u.first[:-1][of]), pa.array(u.listed(rare), pa.string())], names=["row", "place", "unit"])

    return rows.mapInArrow(run, "row long, place long, unit string")


def some_rows(batch: pa.RecordBatch, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows (own, then units) of about limit characters of text each: decoding takes some ten times their size."""
    begins = np.flatnonzero(batch.column(1).is_null().to_numpy(zero_copy_only=False))
    chars = batch.column(2).field("given_chars").to_numpy(zero_copy_only=False)[begins].astype(np.int64) + 1
    before = np.cumsum(chars) - chars
    cuts = np.flatnonzero(np.diff(before // (limit or AT_ONCE), prepend=-1))
    ends = np.append(begins[cuts[1:]], batch.num_rows)
    for a, b in zip(begins[cuts].tolist(), ends.tolist()):
        yield batch.slice(a, b - a)


def encoded_units(docs: DataFrame, path: str) -> DataFrame:
    """unit, n, ids of all units of up to LONGEST characters, written; their edges are grouped by hash, not by a sort of all edges."""
    conf = docs.sparkSession.conf
    before = conf.get(HASHED)
    conf.set(HASHED, str(GROUPS))
    try:
        return written(encode_units(count_units(docs, path), path).select("unit", "n", "ids"), "units", small=True)
    finally:
        conf.set(HASHED, before)


def encode(docs: DataFrame, path: str, *, whole: bool = False) -> DataFrame:
    """row, doc_id, n_units, n_pieces, ids_digest, n_decoded, text_digest, round_trip, and with whole also ids and text (decoded), for each row of docs.

    Texts are cut twice, for their rare units and for the rest, so that the numbers of their units are on disk once only, in the last shuffle.
    """
    ready(docs.sparkSession)
    if not is_plain(docs):
        docs = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "texts", small=True)
    table = encoded_units(docs, path)
    told, others = hot_units(table, path)
    shared = docs.sparkSession.sparkContext.broadcast(told)
    rows = numbered(docs, "row", ["doc_id", "text"]).select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    rare = written(rare_units(rows, path, shared), "rare", small=True)
    long = rare.where(F.length("unit") > LONGEST)
    joined = rare.join(others, "unit")
    if not long.isEmpty():
        joined = joined.unionByName(long.join(encode_long(long.select("unit").distinct(), path), "unit"))
    narrow = "array<smallint>" if processor(path).get_piece_size() <= 1 << 15 else "array<int>"
    joined = written(joined.select("row", "place", F.col("ids").cast(narrow).alias("ids")), "rare_ids", small=True)
    dropped(table)
    dropped(rare)
    own = F.struct("doc_id", "n_units", "code", "given_chars", "given")
    known = coded(rows, path, shared).select("row", F.lit(None).cast("long").alias("place"), own.alias("own"), F.lit(None).cast(narrow).alias("ids"))
    nothing = F.lit(None).cast("struct<doc_id:long,n_units:long,code:binary,given_chars:long,given:long>")
    parts = known.union(joined.select("row", "place", nothing, "ids"))
    # nulls come first: a row's own, then its units in order
    parts = parts.repartition("row").sortWithinPartitions("row", "place")
    schema = "row long, doc_id long, n_units long, n_pieces long, ids_digest long, n_decoded long, text_digest long, round_trip boolean" + (", ids array<int>, text string" if whole else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(path)
        begin, hot_ids = shared.value[2:]

        def finished(batch: pa.RecordBatch) -> pa.RecordBatch:
            whole_rows = batch.filter(pc.is_null(batch.column(1)))
            doc_id, units, code, given_chars, given = whole_rows.column(2).flatten()
            codes = code.to_pylist()
            number, last = unshort(np.frombuffer(b"".join(codes), dtype=np.uint8))
            sizes, flat = listed(batch.filter(pc.is_valid(batch.column(1))).column(3))
            apart = number == 0
            counts = np.empty(len(number), dtype=np.int64)
            counts[apart] = sizes
            hot = number[~apart] - 1
            counts[~apart] = np.diff(begin)[hot]
            ids = np.empty(int(counts.sum()), dtype=np.int64)
            here = np.repeat(apart, counts)
            ids[here], ids[~here] = flat, hot_ids[ragged(begin[hot], counts[~apart])]
            first = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(last, np.concatenate(([0], np.cumsum([len(c) for c in codes]))).astype(np.int64))]
            n_units = units.to_numpy()
            texts = decoder.texts(ids, first)
            chars = np.array([len(t) for t in texts], dtype=np.int64)
            offsets = np.concatenate(([0], np.cumsum(chars)))
            points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
            digest = digests(points, own_places(offsets), offsets)
            same = (digest == given.to_numpy()) & (chars == given_chars.to_numpy())
            # decoding takes the word mark before the text away
            columns = [whole_rows.column(0), doc_id, units, pa.array(np.diff(first)), pa.array(digests(ids + 1, decoder.places(ids, first), first)), pa.array(np.maximum(chars - 1, 0)), pa.array((digest - np.where(n_units > 0, 32 * 7, 0)) % PRIME), pa.array(same)]
            if whole:
                columns += [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())), pa.array([t[1:] for t in texts], pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        def ended(head: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in pa.Table.from_batches(head).combine_chunks().to_batches():
                yield from map(finished, some_rows(x))
            pa.default_memory_pool().release_unused()

        held: list[pa.RecordBatch] = []  # the last row, whose units may go on in the next batch
        for batch in batches:
            begins = np.flatnonzero(batch.column(1).is_null().to_numpy(zero_copy_only=False))
            if not len(begins):
                held.append(batch)
                continue
            head = [x for x in (*held, batch.slice(0, int(begins[-1]))) if x.num_rows]
            if head:
                yield from ended(head)
            held = [batch.slice(int(begins[-1]))]
        if held:
            yield from ended(held)

    return parts.mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path(MODEL), whole=True).drop("row")


__all__ = ["decoded", "encode", "op8", "units_of"]
