"""The pipeline's stages against plain Python on small tables."""

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from quarry.llm import sentencepiece_lattice as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    passage = " ".join(f"leak{i}" for i in range(12))
    body = [" ".join(f"word{(i * 7 + k * 13) % 97}x{i}" for k in range(60)) for i in range(30)]
    texts = [*body, body[3], body[4] + " tail", f"{body[5][:100]} {passage} more", "mail me at a@b.cd or call +1 (499) 555-6503 today", None, "  "]
    rows = [(i, t, "en", "src0", len(t or ""), "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts


def test_stages(spark, folder):
    sf, texts = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans"], name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    everything = set(range(len(texts)))
    assert set(kept[0]) == everything - {34, 35}
    assert set(kept[1]) == set(kept[0]) - {30, 31}
    assert set(kept[2]) == set(kept[1]) - {32}
    assert kept[3][33] == "mail me at [EMAIL] or call [PHONE] today" and {k: v for k, v in kept[3].items() if k != 33} == {k: v for k, v in kept[2].items() if k != 33}
    sp = S.processor(public_tokenizers.path(S.MODEL))
    assert {r.doc_id: r.n_pieces for r in corpus_pipeline.run(spark, sf).collect()} == {k: len(sp.encode(v)) for k, v in kept[3].items()}


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_copies_go_by_row(spark, tmp_path):
    """Repeated ids with one text or several, repeated rows and rows without an id: of linked rows just one stays, and every other text."""
    body = [" ".join(f"w{(i * 11 + k * 17) % 89}y{i}" for k in range(40)) for i in range(4)]
    a, b, c, d = body
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (None, c), (None, d), (None, d), (9, None), (9, None), (10, ""), (2, a + " tail"), (None, None), (5, "alone here"), (11, b + " more"), (5, d + " x y")]
    table = spark.createDataFrame([(i, t, "en", "row", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, row string, place int")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for docs in (spark.read.parquet(f"{tmp_path}/documents.parquet"), table.where("place >= 0")):
        kept = corpus_pipeline.drop_copies(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns
        left = {r.place: (r.doc_id, r.text) for r in kept.collect()}
        sets = [shingles(t) for _, t in rows]
        near = [{j for j, y in enumerate(sets) if j == i or x and y and 100 * len(x & y) >= 80 * len(x | y)} for i, x in enumerate(sets)]
        groups = {i: {i} for i in range(len(rows))}
        for i in range(len(rows)):
            for j in near[i]:
                joined = groups[i] | groups[j]
                for k in joined:
                    groups[k] = joined
        for group in {frozenset(g) for g in groups.values()}:
            stays = [k for k in group if k in left]
            assert len(stays) == 1, (group, stays)
            ids = [rows[k][0] for k in group]
            named = [i for i in ids if i is not None]
            assert left[stays[0]][0] == (min(named) if named else None)


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names
