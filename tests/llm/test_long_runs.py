"""Long runs of one letter at default parameters: digests stay right, and work grows with the text."""

import time

import public_tokenizers

from quarry.llm import sentencepiece_lattice as S
from quarry.llm import token_counts as T


def test_digest_of_a_long_run(spark):
    """300 words and 400,000 times one letter, against the documented formulas."""
    text = " ".join(f"wort{i}" for i in range(300)) + " " + "ж" * 400_000
    path = public_tokenizers.path(S.MODEL)
    got = S.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()
    sp = S.processor(path)
    ids = sp.encode(text)
    at, byte, digest = 0, 0, 0
    for i in ids:
        digest += (i + 1) * (S.PLACE * (4 * at + byte) + 7)
        if sp.is_byte(i):  # the letter has a piece; bytes do not occur
            raise AssertionError
        at += len(sp.id_to_piece(i))
    marked = " " + text
    assert (got.n_pieces, got.ids_digest, got.round_trip) == (len(ids), digest % S.PRIME, True)
    assert got.text_digest == (sum(ord(c) * (S.PLACE * k + 7) for k, c in enumerate(marked)) - 32 * 7) % S.PRIME


def test_endless_pre_token():
    """4 MB of one letter: the count is the library's, in a few times its time."""
    path = public_tokenizers.path(T.TOKENIZER)
    tokenizer = T.load(path)
    own, edge = T.engine(path, tokenizer), T.margin(tokenizer)
    text = "a" * 4_000_000
    T.count_long("a" * 10_000, own, edge)
    began = time.process_time()
    wanted = T.Library(tokenizer).count(text)
    library = time.process_time() - began
    began = time.process_time()
    assert T.count_long(text, own, edge)[0] == wanted
    assert time.process_time() - began < 3 * library + 2


def test_chunks_are_encoded_once():
    """Neighbours hand their encodings on; an endless run in between is doubled, not stepped through."""
    path = public_tokenizers.path(T.TOKENIZER)
    tokenizer = T.load(path)
    edge, seen = T.margin(tokenizer), []

    class Watched(T.Library):
        def starts(self, text):
            seen.append(len(text))
            return super().starts(text)

    own = Watched(tokenizer)
    text = "some words and 12345 numbers, <|endoftext|> it's so\n\n" * 400
    got, splices = T.count_long(text, own, edge)
    assert got == own.count(text) and splices > 5 and sum(seen) < 1.3 * len(text) + 2 * T.CHUNK
    seen.clear()
    text = "head words " * 300 + "b" * 60_000 + " tail words" * 300
    assert T.count_long(text, own, edge)[0] == own.count(text)
    assert sum(seen) < 8 * len(text)


def test_long_secret(spark):
    """A key of any length near a word that says so."""
    from quarry.llm import pii

    key = "aB3" * 400
    got = pii.redact(spark.createDataFrame([(1, f"the api_key = {key} is here")], "doc_id long, text string")).first()
    assert key not in got.text and got.text.startswith("the api_key") and got.text.endswith("is here")
