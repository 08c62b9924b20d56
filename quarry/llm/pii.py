"""Personal data in texts, by DataFrame functions only.

A regular expression for each kind proposes spans: splitting a text at the matches and extracting
them gives both sides of every match, and a fold over their lengths gives positions in code points.
Check digits confirm (Luhn for cards, mod 97 for bank accounts); words near a span move its score.
Base kinds (email, ip, card, phone) keep every span that passes their own rule, whatever the score;
further kinds keep those whose score reaches THRESHOLD.

The patterns are written so that the Java engine runs in linear time without recursion: runs are
possessive, and a match begins at the start of a run or where the previous match ended.

Defined results: null and empty texts have no spans; equal rows give equal results; other columns
are left alone; spans of different kinds may overlap, spans of one kind never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents

NEAR = 48
THRESHOLD = 0.5
EMPTY = "array<struct<start:int,rank:int,end:int,kind:string,value:string,score:double>>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number of A-Z and 0-9 leaves 1 modulo 97 once its first four characters stand last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c.between("0", "9"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def below_256(value: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def card_rule(value: Column) -> Column:
    number = digits(value)
    return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a text without a match of this has none of the kind
    rule: object
    score: float
    near: str
    gain: float
    base: bool = True


_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]"
_SECRET = r"(?i)token|secret|passw|api.?key|access.?key|private.?key|kennwort|schlüssel|mot de passe|contraseñ|clave"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++", "@", lambda v: F.lit(True), 0.9, r"mail|contact|write|reach|kontakt|schreib|écri|correo|escrib", 0.1),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", below_256, 0.6, r"\bip\b|host|server|address|login|adresse|rechner|serveur|direcci|servidor", 0.3),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9]", card_rule, 0.8, r"card|visa|master|credit|pay|karte|kredit|zahl|carte|paiement|tarjeta|pago", 0.2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda v: F.length(digits(v)).between(9, 15), 0.6, r"phone|call|tel|mobile|fax|anruf|handy|appel|portable|llam|móvil", 0.3),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", lambda v: mod97(F.regexp_replace(v, " ", "")), 0.9, r"iban|account|bank|konto|compte|banque|cuenta|banco", 0.1, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]-[0-9]", lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, r"ssn|social|security|sozial|sécurité|seguridad", 0.5, False),
    # a long run of letters and digits is a key or password only near a word that says so
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?![A-Za-z0-9+/_-])", _SECRET, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"), 0.2, _SECRET, 0.6, False),
)


def spans_of_kind(text: Column, rank: int, kind: Kind) -> Column:
    """Spans of one kind, in order, with their values and scores."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("at"), F.when(kind.rule(x["hit"]), F.concat(state["out"], F.array(one))).otherwise(state["out"]).alias("out"))

    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda x: x["hit"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))
    found = F.aggregate(pairs, zero, step, lambda s: s["out"])

    def scored(x: Column) -> Column:
        begin = F.greatest(x["start"] - NEAR, F.lit(0))
        around = F.lower(F.concat_ws(" ", F.substring(text, begin + 1, x["start"] - begin), F.substring(text, x["end"] + 1, F.lit(NEAR))))
        score = F.lit(kind.score) + F.when(around.rlike(kind.near), F.lit(kind.gain)).otherwise(F.lit(0.0))
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), x["value"].alias("value"), F.round(score, 4).alias("score"))

    out = F.transform(found, scored)
    if not kind.base:
        out = F.filter(out, lambda x: x["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.hint), out).otherwise(F.expr(f"cast(array() as {EMPTY})"))


def spans(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """array of (start, rank, end, kind, value, score), by start, then in the order of the kinds."""
    whole = F.coalesce(text, F.lit(""))
    return F.array_sort(F.flatten(F.array(*(spans_of_kind(whole, i, k) for i, k in enumerate(kinds)))))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span (or chain of overlapping spans) replaced by its first kind in brackets."""

    def step(state: Column, x: Column) -> Column:
        apart = x["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(apart, more).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(found, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; all other columns and rows as they are."""
    name = "_pii_spans"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, spans(F.col("text"))).withColumn("text", redacted(F.col("text"), F.col(name))).drop(name)


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    base = [k.name for k in KINDS if k.base]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans(F.col("text")).alias("found"))

    def of(kind: str) -> Column:
        return F.filter("found", lambda x: x["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("found", lambda x: x["kind"].isin(*base))), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir))
