"""Chunks of texts that are blank in whole or in part, and of keys that a float does not hold."""

from quarry.sources import files


def test_blank_parts_have_no_lines():
    assert files.plain_text("") == files.plain_text(" \n\n ") == []
    assert [b.text for b in files.plain_text("\n \nfirst.\n\nsecond.\n\n")] == ["first.", "second."]


def test_chunks_of_blank_texts_and_large_keys(spark):
    large = (1 << 53) + 1
    rows = [(1, None), (2, ""), (3, " \n\n"), (large, "a word.\n\n"), (None, "\n\nb")]
    blank = spark.createDataFrame(rows[:3], "doc_id long, text string")
    assert files.chunked(blank, "doc_id").collect() == []
    got = files.chunked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id").collect()
    assert {(r.doc_id, r.ordinal, r.kind, r.text) for r in got} == {(large, 0, "TEXT", "a word."), (None, 0, "TEXT", "b")} and len(got) == 2


def test_pieces_of_a_long_sentence():
    text = "".join(chr(0x4E00 + i % 5000) for i in range(3000))
    got = [t for _, _, t in files.chunks([files.Block("PARAGRAPH", text)], 800, 100)]
    assert got == [text[i : i + 800] for i in (0, 700, 1400, 2100)] + [text[2800:]]
