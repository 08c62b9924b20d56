"""The perplexity band rejects what differs clearly, and little else."""

import random

from quarry.llm import quality as Q


def prose(n, seed):
    r = random.Random(seed)
    parts = ["the", "of", "and", "to", "in", "ring", "tion", "ea", "under", "st", "wa", "or"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(n)]


def test_quality_band_rejects_symbols_and_fragments(spark):
    texts = [" ".join(prose(300, s)) for s in range(200)] + [" ".join(w + ("&" if i % 8 == 0 else "") for i, w in enumerate(prose(300, 900))), " ".join(w + (" |" if i % 8 == 0 else "") for i, w in enumerate(prose(300, 901)))]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in Q.judge(df).collect()}
    assert got[200] == got[201] == (False, False)
    assert sum(k for i, (_, k) in got.items() if i < 200) >= 190


def test_quality_band_on_held_out_labels(spark):
    """WIDTH, SHORT and USUAL were chosen on the even ids of sf0.1; the odd ids are held out."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where("doc_id % 2 = 1 and quality is not null").collect()}
    rows = [(labels[r.doc_id], r.kept) for r in Q.judge(docs).where("not base_failed").select("doc_id", "kept").collect() if r.doc_id in labels]
    good, bad = [k for q, k in rows if q == 1], [k for q, k in rows if q == 0]
    print("held out: good", sum(good), "of", len(good), "kept; bad", len(bad) - sum(bad), "of", len(bad), "rejected")
    assert sum(good) > 0.97 * len(good) and sum(bad) < 0.15 * len(bad)
