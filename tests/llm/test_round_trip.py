"""SentencePiece encoding and decoding over whole tables, against the library."""

import public_tokenizers
import pytest

import __spark_entry__
from quarry.llm import sentencepiece_lattice as S

PRIME = (1 << 31) - 1


def brute(sp, text):
    """What the query returns of one text, from the library's ids."""
    ids, place, at = sp.encode(text), [], 0
    marked = "\u2581" + text.replace(" ", "\u2581")
    byte = 0
    for i in ids:
        place.append(4 * at + byte)
        if sp.is_byte(i):
            byte += 1
            if byte == len(marked[at].encode()):
                at, byte = at + 1, 0
        else:
            at += len(sp.id_to_piece(i))
    decoded = sp.decode(ids)
    mixed = lambda pairs: sum(v * (1_000_003 * p + 7) for v, p in pairs) % PRIME
    given = text.replace("\u2581", " ")
    return len(ids), mixed((i + 1, p) for i, p in zip(ids, place)), len(given), mixed((ord(c), p + 1) for p, c in enumerate(given)), decoded == given


def test_sentencepiece_round_trip_of_every_row(spark):
    path = public_tokenizers.path(S.MODEL)
    sp = S.processor(path)
    texts = [None, "", " two  spaces ", "世界 é 😀 \n\n x", "a" * 300, "ａ▁b", "long " * 5000, "same", "same", "don't 12,345.6 (see [x]) über-groß e\u0301 \t\u00a0 --==>> _a_ %%% ² ½", "我" * 90 + "的中国人民" * 40, "-" * 200 + "ab" * 90]
    df = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "doc_id long, text string")  # ids repeat
    got = sorted((r.doc_id, r.n_pieces, r.ids_digest, r.n_decoded, r.text_digest, r.round_trip) for r in S.encode(df, path).collect())
    want = sorted((i % 3, *brute(sp, t or "")) for i, t in enumerate(texts))
    assert got == want and all(w[-1] for w in want)


def test_no_piece_crosses_units(spark):
    path = public_tokenizers.path(S.MODEL)
    assert "".join(S.units_of("a b12 c,d\n" + "x\u4e2d" * 80, path)) == "\u2581a\u2581b12\u2581c,d\n" + "x\u4e2d" * 80
    assert S.units_of("ab, c1", path) == ["\u2581ab", ",", "\u2581c", "1"]
    assert all(len(u) <= S.LONGEST for u in S.units_of("\u4e2d\u56fd\u4eba" * 100, path))


def test_whole_table_against_the_library(spark, sf):
    sp = S.processor(public_tokenizers.path(S.MODEL))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_pieces, r.ids_digest, r.n_decoded, r.text_digest, r.round_trip) for r in __spark_entry__.queries()["op8_sentencepiece"](spark, sf).collect()}
    assert got == {i: brute(sp, t or "") for i, t in texts.items()}


@pytest.mark.parametrize("name", ["pipeline"])
def test_sentencepiece_queries_decode(spark, sf, name):
    out = __spark_entry__.queries()[name](spark, sf)
    assert {"ids_digest", "text_digest"} <= set(out.columns) and out.where("not round_trip").count() == 0
