"""Review scores, citations, plans, conversation memory."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a finding costs.
PENALTY = {"HIGH": 40, "MEDIUM": 15, "LOW": 5}
SECRET = r"(?i)(api[_-]?key|password|secret|token)\s*[:=]\s*\S{6,}"


def scores(findings: DataFrame, task: str = "task_id") -> DataFrame:
    """score = max(0, 100 - penalties), and the verdict: RETRY before FAIL before CLARIFY before PASS."""
    cost = F.lit(0)
    for level, n in PENALTY.items():
        cost = F.when(F.col("severity") == level, n).otherwise(cost)
    flags = {k: F.max(F.when(F.col("action") == k, 1).otherwise(0)) for k in ("RETRY", "FAIL", "CLARIFY")}
    out = findings.groupBy(task).agg(F.greatest(F.lit(0), 100 - F.sum(cost)).cast("long").alias("score"), *(c.alias(k) for k, c in flags.items()))
    verdict = F.lit("PASS")
    for k in ("CLARIFY", "FAIL", "RETRY"):
        verdict = F.when(F.col(k) == 1, k).otherwise(verdict)
    return out.select(task, "score", verdict.alias("verdict"))


def coverage(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """task_id, cited and known: whole percents of claims with a citation, and of citations that exist."""
    cited = claims.groupBy("task_id").agg(F.floor(100 * F.avg(F.when(F.size("evidence_ids") > 0, 1).otherwise(0))).cast("long").alias("cited"))
    ids = claims.select("task_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    known = ids.join(evidence.select("evidence_id").distinct().withColumn("_k", F.lit(1)), "evidence_id", "left").groupBy("task_id").agg(F.floor(100 * F.avg(F.coalesce("_k", F.lit(0)))).cast("long").alias("known"))
    return cited.join(known, "task_id", "left").select("task_id", "cited", F.coalesce("known", F.lit(0)).cast("long").alias("known"))


def leaks(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.where(F.col(text).rlike(SECRET))


def incomplete_tables(cited: DataFrame) -> DataFrame:
    """Tables whose cited rows are fewer than they have."""
    return cited.groupBy("document_id", "section", "caption").agg(F.countDistinct("row_no").alias("covered"), F.max("n_rows").alias("total")).where("covered < total")


def ranges(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """Runs of whole numbers as text, such as 1–3、5.  A run's rows share value - row_number."""
    w = Window.partitionBy(*keys).orderBy(value)
    runs = rows.select(*keys, value).distinct().withColumn("_island", F.col(value) - F.row_number().over(w)).groupBy(*keys, "_island").agg(F.min(value).alias("a"), F.max(value).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("–"), F.col("b").cast("string")))
    listed = runs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))).alias("parts"))
    return listed.select(*keys, F.array_join(F.transform("parts", lambda x: x["t"]), "、").alias("ranges"))


def turn_pairs(messages: DataFrame) -> DataFrame:
    """A user's turn and the assistant's that follows it; system rows stand for nothing."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    talk = messages.where(F.col("role") != "system").withColumns({"next_role": F.lead("role").over(w), "next_text": F.lead("text").over(w), "next_turn": F.lead("turn").over(w)})
    return talk.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select("conv_id", "turn", "next_turn", F.col("text").alias("question"), F.col("next_text").alias("answer"))


def latest(messages: DataFrame, role: str) -> DataFrame:
    """Each conversation's last text of a role that is not empty."""
    kept = messages.where((F.col("role") == role) & (F.trim("text") != ""))
    return kept.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def last_then_ascending(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation, in order of turn."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


@dataclass
class Plan:
    """Steps of a task, at most MOST, extended by rounds that never repeat a step."""

    steps: list[tuple[str, str]] = field(default_factory=list)
    MOST = 8
    ROUND, TOTAL = 6, 24
    SOURCES = ("SQL", "DOCUMENT")

    @classmethod
    def start(cls, sources: list[str], questions: list[str]) -> Plan:
        bad = [s for s in sources if s not in cls.SOURCES]
        if bad:
            raise ValueError(f"PLAN_INVALID: {bad}")
        return cls([(s, q) for q in questions for s in sources][: cls.MOST])

    def extend(self, more: list[tuple[str, str]]) -> list[tuple[str, str]]:
        known = {(s, " ".join(q.lower().split())) for s, q in self.steps}
        taken = []
        for s, q in more:
            key = (s, " ".join(q.lower().split()))
            if s in self.SOURCES and key not in known and len(taken) < self.ROUND and len(self.steps) + len(taken) < self.TOTAL:
                known.add(key)
                taken.append((s, q))
        self.steps += taken
        return taken


def progress(required: int, done: int, failed: int, gaps: int, rounds: int, most_rounds: int = 3) -> str:
    """CONTINUE while steps are open, EXPAND while gaps remain and rounds are left, else SUFFICIENT."""
    if done + failed < required:
        return "CONTINUE"
    return "EXPAND" if gaps and rounds < most_rounds else "SUFFICIENT"


def retry_route(wanted: list[str], budgets: dict[str, int]) -> str:
    """The first of replan, expand, tool, analysis that is wanted and has budget; else done."""
    return next((r for r in ("replan", "expand", "tool", "analysis") if r in wanted and budgets.get(r, 0) > 0), "done")


#: The Chinese phrases of limits and citations below.  MOST_LIMITS: tables whose missing rows are named one by one.
MOST_LIMITS = 3


def table_limits(cited: DataFrame, *, task: str = "task_id", most: int = MOST_LIMITS) -> DataFrame:
    """task, place, text: a sentence for each incompletely cited table, at most so many, then one that counts the others.

    cited: task, document_id, document (shown name), section, caption, row_no, n_rows.
    """
    tables = cited.groupBy(task, "document_id", "section", "caption").agg(F.min("document").alias("document"), F.countDistinct("row_no").alias("covered"), F.max("n_rows").alias("total")).where("covered < total")
    # each task's first tables by a limited rank and their number by a count: no task sorts all tables of one
    w = Window.partitionBy(task).orderBy("document", "caption", "total", "covered", "document_id", "section")
    ranked = tables.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most + 1).withColumn("place", F.col("place").cast("long"))
    ranked = ranked.join(tables.groupBy(F.col(task).alias("_task")).agg(F.count("*").alias("n")), F.col(task).eqNullSafe(F.col("_task")))
    shown = F.concat(F.lit("表格「"), "caption", F.lit("」（"), "document", F.lit("）共 "), F.col("total").cast("string"), F.lit(" 行，已引用 "), F.col("covered").cast("string"), F.lit(" 行"))
    others = F.concat(F.lit("另有 "), (F.col("n") - most).cast("string"), F.lit(" 张表不完整"))
    return ranked.select(task, "place", F.when(F.col("place") <= most, shown).otherwise(others).alias("text"))


def rendered_source() -> Column:
    """What a reader sees of a piece of evidence: title, section unless the title names it, page; or the query's short fingerprint."""
    section = F.coalesce("section", F.lit(""))
    named = F.when((section != "") & ~F.col("title").contains(section), F.concat(F.lit("（"), section, F.lit("）"))).otherwise("")
    page = F.when(F.coalesce("page_no", F.lit(0)) > 0, F.concat(F.lit("，第 "), F.col("page_no").cast("string"), F.lit(" 页"))).otherwise("")
    document = F.concat(F.lit("《"), "title", F.lit("》"), named, page)
    query = F.concat(F.lit("业务数据库查询 "), F.substring(F.coalesce("fingerprint", F.lit("")), 1, 12))
    return F.when(F.col("source_type") == "DOCUMENT", document).when(F.col("source_type") == "SQL", query).otherwise(F.col("title"))


def merged_citations(evidence: DataFrame, *, task: str = "task_id") -> DataFrame:
    """task, place, text: evidence that reads alike is one citation, with its table rows, else its result rows, else how many there are.

    evidence: task, ordinal, source_type, title, section, page_no, fingerprint, caption, row_no (from 1), slice_no (from 0).
    """
    rows = evidence.withColumn("source", rendered_source())
    groups = rows.groupBy(task, "source").agg(F.min("ordinal").alias("first"), F.count("*").alias("n"), F.min_by("caption", "ordinal").alias("caption"))
    tables = ranges(rows.where("row_no is not null"), "row_no", task, "source").withColumnRenamed("ranges", "in_table")
    results = ranges(rows.where("slice_no is not null").withColumn("slice_no", F.col("slice_no") + 1), "slice_no", task, "source").withColumnRenamed("ranges", "in_result")
    name = F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("表「"), "caption", F.lit("」"))).otherwise("该表")
    suffix = F.when(F.col("in_table").isNotNull(), F.concat(F.lit("（"), name, F.lit("第 "), "in_table", F.lit(" 行）")))
    suffix = suffix.when(F.col("in_result").isNotNull(), F.concat(F.lit("（结果第 "), "in_result", F.lit(" 行）")))
    suffix = suffix.when(F.col("n") > 1, F.concat(F.lit("（"), F.col("n").cast("string"), F.lit(" 条）"))).otherwise("")
    both = groups.join(tables, [task, "source"], "left").join(results, [task, "source"], "left")
    place = F.row_number().over(Window.partitionBy(task).orderBy("first", "source")).cast("long")
    return both.select(task, place.alias("place"), F.concat("source", suffix).alias("text"))
