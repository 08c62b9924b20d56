"""Small tests of every operator: defined results for odd input, and brute force where SQL cannot say it."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat_template as C
from quarry.llm import decontamination as D
from quarry.llm import jaccard as J
from quarry.llm import language_id as L
from quarry.llm import pii as P
from quarry.llm import quality as Q
from quarry.llm import sentencepiece_lattice as S
from quarry.llm import sharding as H
from quarry.llm import token_counts as T
from quarry.llm import toxicity as X

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, value int"


def docs(spark, texts, langs=None):
    return spark.createDataFrame([(i, t, (langs or {}).get(i, "en"), "src", len(t or ""), "clash", 1) for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


ODD = [None, "", " \n\t ", "x", "long " * 30_000, "é ü 中文 😀 \x00​", "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 1 ---------------------------------------------------------------------------------------


def luhn(n):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(n)))) % 10 == 0


def base_spans(text):
    number = lambda v: re.sub("[^0-9]", "", v)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(number(v)) <= 19 and luhn(number(v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(number(v)) <= 15),
    ]
    out = [(m.start(), i, m.end(), k) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_pii_base_spans(spark):
    r = random.Random(5)
    bits = ["a.b@c.de", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+49 30 12", " ", "é", "😀", "99", ".", "-", "+", "_", "john", "@b.c.d_x@y.z", "0004.1.2.3", "\n", "GB82 WEST 1234 5698 7654 32"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(300)] + ODD + ["1" * 5000, "a" * 50_000, "1 " * 4000]
    got = P.digest(docs(spark, texts)).collect()
    assert {x.doc_id: x.base_sha256 for x in got} == {i: hashlib.sha256(base_spans(t).encode()).hexdigest() for i, t in enumerate(texts)}


def test_pii_redaction_and_checks(spark, odd, empty):
    text = "😀 pay GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33, mail a@b.cd; ssn 123-45-6789"
    row = P.redact(docs(spark, [text])).first()
    assert row.text == "😀 pay [IBAN] or GB82 WEST 1234 5698 7654 33, mail [EMAIL]; ssn [SSN]" and row.spans == "clash"
    assert P.redact(odd).columns == odd.columns and P.redact(odd).where("text is null").count() == 1
    assert P.digest(empty).count() == 0


# --- 2 ---------------------------------------------------------------------------------------


def brute_classes(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_copies(n, size, edits, seed):
    r = random.Random(seed)
    base = words(size, seed, 10_000)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(size)] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few", [2, 10])
def test_jaccard_against_brute_force(spark, few):
    texts = near_copies(40, 120, 5, 1) + near_copies(25, 60, 2, 2) + near_copies(12, 9, 1, 3) + [" ".join(words(50, s)) for s in range(20)] + ODD + ["a b c", "A  b\nC", "a b c d e", "a b c d e f"] + [" ".join(words(90, 7, 10_000))] * 15
    random.Random(4).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(docs(spark, texts), few=few, block=8).collect()}
    assert got == brute_classes(texts)


def test_jaccard_empty_and_null_ids(spark, empty):
    assert J.classes(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, J.classes(df, with_links=False).collect()), key=repr) == [(3, 0, 3), (5, 2, 5), (5, 2, 5), (None, 2, 5)]


# --- 3 ---------------------------------------------------------------------------------------


def test_template_folding_and_sandbox():
    t = C.Template("{% if true and 'a' == 'a' %}x{{ 'b' ~ 1 | upper }}{% else %}no{% endif %}y")
    assert t.tree == [C.Text("xb1y")] and t.render([]) == ("xb1y", [])
    for bad in ("{{ message.__class__ }}", "{{ open('x') }}", "{% import os %}", "{{ x | eval }}", "{% if x %}", "{% for a in %}{% endfor %}", "{{ 1 +"):
        with pytest.raises(C.TemplateError):
            C.Template(bad + "}}" if bad.endswith("+") else bad)


def test_template_rendering():
    source = "<s>{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% elif not loop.first %}+{{ m.text }}{% else %}{{ m.text }}{% endif %}{% if loop.last %}!{% endif %}{% endfor %}</s>"
    talk = [{"role": "user", "text": "q"}, {"role": "assistant", "text": " a "}, {"role": "user", "text": "z"}]
    text, spans = C.Template(source).render(talk)
    assert text == "<s>qa+z!</s>" and [text[a:b] for a, b in spans] == ["a"]
    t = C.Template(source)
    assert t.by_turn and "".join(t.turn(m, i, i == 2)[0] for i, m in enumerate(talk)) == text


def test_chat_round_trip(spark):
    hard = ["\\", "<turn user>\n", "</turn>\n", "\\<", "é😀", None, "", C.HARD, "\n", "### x"]
    rows = [(c, t, r, hard[((c or 0) * 3 + t) % len(hard)], "extra") for c in (1, 2, None) for t, r in enumerate(("system", "user", "assistant", "assistant", None))] + [(1, 0, "system", "tie", "extra")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = {r.conv_id: r for r in C.digest(C.format_turns(df)).collect()}
    for conv in (1, 2, None):
        talk = [(r or "", t or "") for c, n, r, t, _ in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] is not None, x[2] or "", x[3] is not None, (x[3] or "").encode()))]
        whole, spans = C.Template().render([{"role": r, "text": t} for r, t in talk])
        assert C.read_turns(whole) == talk
        loss = "".join(t for r, t in talk if r == "assistant")
        assert "".join(C.unescape(whole[a:b]) for a, b in spans) == loss
        g = got[conv]
        assert (g.n_turns, g.formatted_chars, g.loss_chars) == (len(talk), len(whole), len(loss))
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in talk).encode()).hexdigest() and g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.digest(C.format_turns(df.where("false"))).count() == 0


# --- 4 ---------------------------------------------------------------------------------------


def brute_hits(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        m = min(10, len(v))
        for i in range(len(v) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == v[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_decontamination_against_brute_force(spark, block):
    items = [(i, " ".join(words(n, i, 9))) for i, n in enumerate((1, 2, 3, 9, 10, 11, 25, 0, 12))] + [(11, None), (2, "W1, w2! w3"), (20, "café Über")]
    texts = [" ".join(words(60, 100 + s, 9 if s % 2 else 40)) for s in range(30)] + [f"start {items[6][1].upper()} end", "x, " + items[5][1] + " " + items[5][1], "CAFé Über; w8"] + ODD[:4] + ODD[5:]
    bench = spark.createDataFrame([*items, (None, "w1 w2 w3")], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in D.digest(D.find(docs(spark, texts), bench, block_bytes=block)).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontamination_keeps_columns(spark, odd):
    kept = D.find(odd, spark.createDataFrame([], "item_id long, text string"), keep=tuple(odd.columns))
    clash = D.find(odd.withColumn("hits", F.lit(3)), spark.createDataFrame([(1, "same text here")], "item_id long, text string"), keep=("hits",), prefix="_")
    assert sorted(r.doc_id for r in clash.where("hits = 3 and size(_hits) > 0").collect()) == [6, 7]
    assert set(odd.columns) < set(kept.columns) and kept.where("size(hits) > 0").count() == 0 and kept.count() == len(ODD)


# --- 5 ---------------------------------------------------------------------------------------


def test_toxicity_learns_folds_and_holds_out(spark, empty):
    bad = ["villain", "rotter", "knave"]
    texts = [" ".join(words(60, i) + ([bad[i % 3]] * 2 if i % 4 == 0 else [])) for i in range(400)]
    df = docs(spark, texts + ["you v1llаin, a r0tter", "no insult here", None])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = X.learn(df, labels)
    assert {t.strip() for t in model["entries"]} == set(bad)
    got = {r.doc_id: r for r in X.score(df, model).collect()}
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(400)) and got[400].predicted == 1 and got[401].predicted == 0 and got[402].score < 0.3
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = X.learn(df, flipped)
    assert again["entries"] == model["entries"] and (again["curve"] == model["curve"]).all()
    assert X.score(empty, model).count() == 0
    none = X.learn(df, labels.where("false"))
    assert X.score(df, none).where("predicted = 1").count() == 0


def test_toxicity_folds_letters_beyond_the_first_plane():
    bold = "".join(chr(0x1D400 + ord(c) - 97 + 26) for c in "idiot")
    assert X.folded([f"x {bold} \U0001F600 \U00020001".encode()]) == X.folded([b"x idiot \xf0\x9f\x98\x80 \xe4\xb8\x80"])


def test_toxicity_exceptions():
    m = X.Matcher({" trash ": 5.0, " clow": 4.0}, ("trash can",))
    assert m.match(X.folded([b"the trash can"])[0]) == (0.0, 0)
    assert m.match(X.folded(["TRАSH! cl​owns".encode()])[0]) == (9.0, 2)


# --- 6 ---------------------------------------------------------------------------------------


def test_sharding(spark, odd, empty):
    names = tuple(f"s{i}" for i in range(7))
    t = H.table(names, 211)
    sizes = [t.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1 and -1 not in t
    fewer = H.table(names[:-1], 211)
    assert sum(a != b for a, b in zip(t, fewer) if a != 6) < 40
    assert H.table(names, 211, {"s0": 3}).count(0) > 1.5 * 211 / 7
    with pytest.raises(ValueError):
        H.table(names, 210)
    out = H.place(odd.withColumn("slot", F.lit(9)), "doc_id", shards=names, slots=211)
    assert out.count() == len(ODD) and all(r["shard_name"] == names[r["shard"]] and t[r["slot_"]] == r["shard"] for r in out.collect())
    assert H.place(empty, "doc_id").count() == 0


# --- 7 ---------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(T.TOKENIZER)
    library = Tokenizer.from_file(path)
    r = random.Random(1)
    bits = ["hello", " ", "  ", "\n", "'s", "'ll", "<|endoftext|>", "1234", "é", "!!!", "a" * 70, "x" * 300, "<|end", "oftext|>", "😀", "\t"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(300))) for _ in range(150)] + ODD + ["".join(r.choice(bits) for _ in range(9000)), "x" * 9000, "\u0441\u043b\u043e\u0432\u043e " * 3000, "\u4e2d\u6587" * 3000]
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)}
    for chunk, overlap, fast in ((T.CHUNK, T.OVERLAP, True), (80, 20, True), (400, 40, False)):
        rows = T.count_tokens(docs(spark, texts), path, chunk=chunk, overlap=overlap, fast=fast).collect()
        assert {x.doc_id: (x.n_bytes, x.n_tokens) for x in rows} == want and sum(x.n_splices for x in rows) > 10
    assert T.count_tokens(empty, path).count() == 0


# --- 8 ---------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, monkeypatch, empty):
    path = public_tokenizers.path(S.MODEL)
    r = random.Random(3)
    bits = ["hello", " ", "  ", "\n", "tion", "世界", "é", "!!!", "a" * 70, "😀", "\t", "Ａ", "▁", "Éçeau", "ungheit", "."]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(50))) for _ in range(120)] + ODD
    df = docs(spark, texts)
    whole = {x.doc_id: x for x in S.encode(df, path, whole=True).collect()}
    sp = S.processor(path)
    assert {i: list(x.ids) for i, x in whole.items()} == {i: sp.encode(t or "") for i, t in enumerate(texts)}
    back = S.decoded(spark.createDataFrame([(i, list(x.ids)) for i, x in whole.items()], "doc_id long, ids array<int>"), path, "doc_id")
    assert {x.doc_id: x.text for x in back.collect()} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    monkeypatch.setattr(S, "HOT", 5)
    rare = {x.doc_id: tuple(x)[2:8] for x in S.encode(df, path).collect()}
    assert rare == {i: tuple(x)[2:8] for i, x in whole.items()}
    again = {x.doc_id: list(x.ids) for x in S.encode(df, path, whole=True).collect()}
    assert again == {i: list(x.ids) for i, x in whole.items()}
    assert S.encode(empty, path).count() == 0


def test_viterbi_finds_the_best_path(spark):
    pieces = {"a": -2.0, "b": -2.0, "ab": -3.0, "abc": -6.0, "c": -2.5, "bc": -3.5}
    rows = [("abc", 1, i, i + n, k, s) for k, (p, s) in enumerate(pieces.items()) for n in [len(p)] for i in range(3) if "abc"[i : i + n] == p]
    grouped = spark.createDataFrame(rows, "unit string, n long, start int, end int, id int, score double").groupBy("unit", "n").agg(F.collect_list(F.struct("end", "start", "id", "score")).alias("edges"))
    assert list(S.folded_viterbi(grouped, 3).first().ids) == [2, 4] or list(S.folded_viterbi(grouped, 3).first().ids) == [0, 5]


# --- 9 ---------------------------------------------------------------------------------------


def test_language_id(spark, odd, empty):
    text = {"en": "the ring of the other thing and that with this", "de": "der schein und die freiheit ist nicht über keit", "fr": "le château et la prière de l'été où être", "es": "la niña y el corazón de los años que está"}
    rows = [(i, text[l] + f" {i}", l if i % 10 else None, f"host{i % 3}") for i, l in enumerate(("en", "de", "fr", "es") * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in L.identify(L.evidence(df)).collect()}
    assert all(got[i]._language == ("en", "de", "fr", "es")[i % 4] and not got[i]._rejected for i in got) and len(got) == 120
    o = L.identify(L.evidence(odd)).select("text", "_rejected").collect()
    # blank texts, and one in a script outside the inventory; nearly all that the model knows is ODD[4]
    assert {r.text for r in o if r._rejected} >= {None, "", " \n\t ", ODD[5]} and not any(r._rejected for r in o if r.text == ODD[4]) and len(o) == len(ODD)
    assert L.identify(L.evidence(empty)).count() == 0
    page = spark.createDataFrame([(1, "https://www.x.de/a", "<html lang='de-AT'><body>der die und</body></html>"), (2, None, None)], "page_id long, url string, html string")
    assert [(r._declared, r._host, r._suffix) for r in L.page_evidence(page).orderBy("page_id").collect()] == [("de-AT", "www.x.de", "de"), (None, "", "")]


# --- 10 --------------------------------------------------------------------------------------


def brute_quality(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {k for at in grams.values() if len(at) > 1 for i in at for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_against_brute_force(spark, empty):
    r = random.Random(2)
    texts = [" ".join(words(r.randrange(1, 120), s, 300)) for s in range(60)] + ["a b c d e\n" * 4, "x y é *# <b>\n\nx\n x\nx", "q " * 40] + ODD
    df = docs(spark, texts)
    got = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in Q.judge(df).collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert Q.judge(empty).count() == 0


def brute_bits(train, score, order):
    """Mean costs by the textbook's recursion."""
    import math
    from collections import Counter

    fold = lambda t: "".join(" " if c.isspace() else "0" if c.isdecimal() else c.lower() if len(c.lower()) == 1 else c for c in t)
    grams = lambda t: [(" " * (order - 1) + fold(t))[i : i + order] for i in range(len(t))]
    tables = {order: Counter(g for t in train for g in grams(t))}
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    d = {}
    for k, t in tables.items():
        n = [max(1, sum(c == j for c in t.values())) for j in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1])
        d[k] = [0] + [min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.05), j - 0.05) for j in (1, 2, 3)]

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(tables[1]) + 1)
        own = [c for g, c in tables[k].items() if g[:-1] == gram[:-1]]
        if not own:
            return p(gram[1:])
        c = tables[k].get(gram, 0)
        weight = sum(d[k][min(x, 3)] for x in own) / sum(own)
        return (c - d[k][min(c, 3)]) / sum(own) + weight * p(gram[1:])

    symbols = {*"".join(fold(t) for t in train)}
    return [round(sum(-math.log2(p(g)) for g in grams(t)) / len(t), 4) if t else None for t in score], [sum(p(c + s) for s in symbols) + p(c + "\u0416") for c in ("", "a", "ab", "th")]


def test_kneser_ney_against_brute_force(spark):
    r = random.Random(5)
    train = ["".join(r.choice("abth e1\n\u00c9") for _ in range(40)) for _ in range(30)] + ["aaaa", "the the the", ""]
    score = [*train[:8], "unseen w\u00f6rds ab", "a", "", "thE 2 bath\t\u4e2d"]
    df, other = docs(spark, train), docs(spark, score)
    model = Q.kneser_ney(Q.count_ngrams(df, order=3), 3)
    want, whole = brute_bits(train, score, 3)
    for told in (True, False):
        got = {x.doc_id: x.bits for x in Q.score(other, model, order=3, told=told).collect()}
        assert all((got[i] is None and w is None) or abs(got[i] - w) < 2e-4 for i, w in enumerate(want))
    assert all(abs(x - 1) < 1e-9 for x in whole)


def test_quality_band_rejects_another_script(spark):
    texts = [" ".join(words(80, s, 50)) for s in range(80)] + ["Жщ ъы эю ёя йц ук ен гш щз хъ фы ва пр ол дж э " * 3 + " ".join(f"ж{i}ъ" for i in range(60))]
    got = {x.doc_id: x.kept for x in Q.judge(docs(spark, texts)).collect()}
    assert not got[80] and sum(got.values()) == 80


def test_pii_secrets_by_context(spark):
    key = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    rows = {r.doc_id: (r.spans, r.scores) for r in P.digest(docs(spark, [f'the token = "{key}" of', f"commit {key} and more", "Kennwort: aaaaaaaaaaaaaaaaaaaaaaaa", f"mot de passe {key.lower()}"])).collect()}
    assert rows == {0: ("secret:13:53", "0.8"), 1: ("", ""), 2: ("", ""), 3: ("secret:13:53", "0.8")}
    assert P.redact(docs(spark, [f'token = "{key}"'])).first().text == 'token = "[SECRET]"'


def test_sharding_write_with_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(i, "mine", 5) for i in range(200)], "doc_id long, shard_name string, slot int")
    H.write(df, "doc_id", f"{tmp_path}/out", shards=("a", "b", "c"), slots=101)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {r["shard_name_"] for r in back.collect()} == {"a", "b", "c"} and back.where("shard_name = 'mine' and slot = 5").count() == 200


def test_sharding_table_by_the_definition():
    """Turns are taken one by one over permutations that are written out."""
    names = tuple(f"n{i}" for i in range(5))
    slots = 53
    orders = [[(H._hash(s, "offset") % slots + k * (H._hash(s, "skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in names]
    assert all(sorted(o) == list(range(slots)) for o in orders)
    table, turn = {}, 0
    while len(table) < slots:
        table[next(x for x in orders[turn % 5] if x not in table)] = turn % 5
        turn += 1
    assert H.table(names, slots) == [table[i] for i in range(slots)]


def test_decontamination_names_can_clash_and_empty_documents(spark, empty):
    df = spark.createDataFrame([(1, "same text here", 7, "x", [3])], "doc_id long, text string, n_words int, hits string, items array<int>")
    found = D.find(df, spark.createDataFrame([(1, "same text here")], "item_id long, text string"), keep=tuple(df.columns))
    assert found.columns[-3:] == ["n_words_", "hits_", "items_"] and tuple(D.digest(found).first())[1:4] == (3, 3, 1)
    assert D.digest(D.find(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string"))).count() == 0
    long = docs(spark, ["word " * 40_000 + "same text here " + "word " * 40_000])
    assert D.digest(D.find(long, spark.createDataFrame([(1, "same text here")], "item_id long, text string"))).first().n_hit == 3


def test_language_id_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "the ring of the other thing", "en", "h", "u", 1, (1, "a"))], "doc_id long, text string, lang string, source string, _text string, _rejected int, `odd name` struct<`x y`:int,z:string>")
    out = L.identify(L.evidence(df))
    assert out.columns == [*df.columns, "_language", "_posterior", "_rejected_"] and out.first()["_text"] == "u" and out.first()["odd name"]["x y"] == 1


def brute_posterior(rows, languages, trust, other, bits):
    """rows: (text, declared, host).  Posterior of the best language by the formulas of the docstring, in plain Python."""
    import math
    from collections import Counter

    def grams(t):
        b = " ".encode() + re.sub(rb"[0-9]", b"0", (t or "").encode().lower()) + b" "
        return [b[i : i + 3] for i in range(len(b) - 2) if any(0x61 <= x <= 0x7A or x >= 0x80 for x in b[i : i + 3])]

    cell = lambda g: ((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32) >> (32 - bits)
    count = {l: Counter(cell(g) for t, d, _ in rows if d == l for g in grams(t)) for l in languages}
    every = sum(count.values(), Counter())
    mass = sum(every.values()) + 0.5 * 2**bits
    hosts = {l: Counter(h for _, d, h in rows if d == l) for l in languages}
    of_all = {l: sum(hosts[l].values()) for l in languages}
    out = []
    for t, d, h in rows:
        g = grams(t)
        logs = []
        for l in languages:
            total = sum(count[l].values())
            mean = sum(math.log((1 - L.FLOOR) * (count[l][cell(x)] + L.OWN * (every[cell(x)] + 0.5) / mass) / (total + L.OWN) + L.FLOOR / 2**bits) for x in g) / max(len(g), 1)
            base = 1 / len(languages)
            for n, s in ((of_all[l], sum(of_all.values())), (of_all[l], sum(of_all.values())), (hosts[l][h], sum(hosts[k][h] for k in languages))):
                base = (n + L.SHRINK * base) / (s + L.SHRINK)
            told = 0 if d is None else math.log(L.DECLARED if d == l else (1 - L.DECLARED) / (len(languages) - 1))
            logs.append(mean * min(len(g), trust) + math.log(base) + told)
        rest = math.log(other) - bits * math.log(2) * min(len(g), trust)
        best = max(logs)
        out.append((languages[logs.index(best)], 1 / (sum(math.exp(x - best) for x in logs) + math.exp(rest - best))))
    return out


def test_language_posteriors_against_brute_force(spark):
    text = {"en": "the ring of that", "de": "der schein und die", "fr": "le château été", "es": "la niña y el"}
    rows = [(text[l][: 3 + i % 14] + str(i), l if i % 5 else None, f"h{i % 2}") for i, l in enumerate(("en", "de", "fr", "es") * 10)]
    rows += [("zq xw kj", None, "h0"), ("der schein und", "en", "h1")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = [(r._language, r._posterior) for r in L.identify(L.evidence(df)).orderBy("doc_id").collect()]
    want = brute_posterior(rows, L.LANGUAGES, L.TRUST, L.OTHER, L.BITS)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-4 for g, w in zip(got, want))


def test_language_of_hidden_and_wrong_declarations(spark):
    """On the documents: of half the rows the declaration is hidden, of every tenth it is wrong."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = F.when(F.col("doc_id") % 10 == 1, F.lit("de")).when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.col("lang"))
    found = L.identify(L.evidence(rows.withColumn("told", wrong), declared="told")).select("doc_id", "lang", "told", "_language", "_rejected").collect()
    hidden = [r for r in found if r.told is None]
    misled = [r for r in found if r.told == "de" and r.lang != "de"]
    right = lambda x: sum(r._language == r.lang for r in x) / len(x)
    print("hidden", len(hidden), right(hidden), "wrong", len(misled), right(misled), "rejected", sum(r._rejected for r in found))
    assert right(hidden) > 0.99 and right(misled) > 0.95 and sum(r._rejected for r in found) < 0.01 * len(found)


def test_language_outside_the_inventory_is_rejected(spark):
    text = {"en": "the ring of the other thing and that with this", "de": "der schein und die freiheit ist nicht über keit"}
    rows = [(i, " ".join(r for r in random.Random(i).sample(text[l].split(), 8)) , l, "h") for i, l in enumerate(("en", "de") * 40)]
    rows += [(100, "привет как дела сегодня вечером", None, "h"), (101, "!!! ... ???", "en", "h"), (102, "12 34 56", "en", "h")]
    got = {r.doc_id: r._rejected for r in L.identify(L.evidence(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert all(got[i] for i in (100, 101, 102)) and not any(got[i] for i in range(80))


def test_fast_engine_only_for_files_that_say_the_same():
    import json
    from pathlib import Path

    model = json.loads(Path(public_tokenizers.path(T.TOKENIZER)).read_text())
    assert T.BytePairs.says_the_same(model)
    other = json.loads(json.dumps(model))
    other["model"]["merges"][5], other["model"]["merges"][6] = other["model"]["merges"][6], other["model"]["merges"][5]
    assert not T.BytePairs.says_the_same(other)
    assert not T.BytePairs.says_the_same(model | {"normalizer": {"type": "NFC"}}) and not T.BytePairs.says_the_same(json.loads(Path(public_tokenizers.path("word_bpe_49k.json")).read_text()))


def test_most_text_comes_through_splices(spark):
    from tokenizers import Tokenizer

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = public_tokenizers.path(T.TOKENIZER)
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in T.count_tokens(rows, path).collect()}
    texts = {r.doc_id: r.text or "" for r in rows.select("doc_id", "text").collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(e.ids) for i, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False))}
    assert sum(r.n_bytes for r in got.values() if r.n_splices) > 0.5 * sum(r.n_bytes for r in got.values())
