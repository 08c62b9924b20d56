"""The semantic layer: tables, columns, metrics, join graph, roles and row scope."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC, INTERNAL, SENSITIVE = "PUBLIC", "INTERNAL", "SENSITIVE"
LEVELS = (PUBLIC, INTERNAL, SENSITIVE)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    level: str = PUBLIC
    roles: tuple[str, ...] = ()
    kind: str = "string"

    def visible_to(self, role: str) -> bool:
        return not self.roles or role in self.roles


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    #: Column that holds the region's key, if rows are limited by a principal's regions.
    scope: str | None = None
    fact: bool = False
    #: Column whose predicates say which days a query reads.
    time: str | None = None

    def column(self, name: str) -> ColumnSpec | None:
        return next((c for c in self.columns if c.name.lower() == name.lower()), None)


@dataclass(frozen=True)
class Metric:
    code: str
    aliases: tuple[str, ...]
    expression: str
    tables: tuple[str, ...]
    unit: str = ""
    version: str = "v1"

    def column(self, alias: str | None = None) -> Column:
        return F.expr(self.expression).alias(alias or self.code)


@dataclass(frozen=True)
class Principal:
    role: str = "ANALYST"
    #: No regions means no restriction.
    regions: tuple[int, ...] = ()


@dataclass(frozen=True)
class Catalog:
    tables: tuple[TableSpec, ...]
    #: Pairs of (table, column) that may be equal in a join.
    edges: frozenset[frozenset[tuple[str, str]]]
    metrics: tuple[Metric, ...] = ()
    functions: frozenset[str] = field(default_factory=frozenset)

    @cached_property
    def by_name(self) -> dict[str, TableSpec]:
        return {t.name: t for t in self.tables}

    def table(self, name: str) -> TableSpec | None:
        return self.by_name.get(name.lower())

    @cached_property
    def joins(self) -> frozenset[frozenset[str]]:
        """Pairs of tables that may be joined."""
        return frozenset(frozenset(t for t, _ in e) for e in self.edges)

    def join_allowed(self, left: str, right: str) -> bool:
        return left == right or frozenset((left, right)) in self.joins

    def edge(self, left: tuple[str, str], right: tuple[str, str]) -> bool:
        """Whether two columns may be equal in a join: an edge, or one column of two readings of a table."""
        return left == right or frozenset((left, right)) in self.edges

    def metric(self, code: str) -> Metric | None:
        return next((m for m in self.metrics if m.code == code), None)

    def match_metrics(self, question: str) -> list[Metric]:
        """Metrics whose alias is in the question; a longer alias hides the shorter ones inside it."""
        text, out = question.lower(), []
        for alias, m in sorted(((a.lower(), m) for m in self.metrics for a in m.aliases), key=lambda x: (-len(x[0]), x[0])):
            if alias in text:
                text = text.replace(alias, "\0")
                if m not in out:
                    out.append(m)
        return out

    def neighbours(self, name: str) -> list[str]:
        return sorted(next(iter(e - {name})) for e in self.joins if name in e and len(e) == 2)

    def subset(self, question: str, *, hops: int = 2, most: int = 8) -> list[str]:
        """Tables for a question: those of its metrics (all facts if there are none), then their neighbours, nearest first."""
        seeds = list(dict.fromkeys(t for m in self.match_metrics(question) for t in m.tables)) or [t.name for t in self.tables if t.fact]
        seen = dict.fromkeys(seeds, 0)
        queue = deque(seeds)
        while queue:
            at = queue.popleft()
            if seen[at] < hops:
                for n in self.neighbours(at):
                    if n not in seen:
                        seen[n] = seen[at] + 1
                        queue.append(n)
        return sorted(seen, key=lambda t: (seen[t], list(seen).index(t)))[:most]

    def level_of(self, columns: list[str]) -> str:
        """Highest sensitivity of result columns by bare name over all tables; unknown names are PUBLIC."""
        levels = [c.level for n in columns for t in self.tables if (c := t.column(n))]
        return max(levels, key=LEVELS.index, default=PUBLIC)


def _cols(*names: str, **special: ColumnSpec) -> tuple[ColumnSpec, ...]:
    """A name, or a name and a type."""
    return tuple(special.get(n) or ColumnSpec(n.split()[0], kind=n.partition(" ")[2] or "string") for n in names)


#: The functions that governed SQL may call.
FUNCTIONS = frozenset((
    "sum", "count", "avg", "min", "max", "round", "abs", "ceil", "floor",
    "date", "year", "month", "quarter", "date_format", "str_to_date", "date_add", "date_sub", "datediff", "last_day", "timestampdiff",
    "coalesce", "ifnull", "nullif", "if", "cast", "convert", "concat", "substring", "trim", "upper", "lower",
))
#: Functions that are refused for good, however a query is repaired; the last three run code in Spark.
FORBIDDEN = frozenset(("sleep", "benchmark", "load_file", "get_lock", "release_lock", "sys_exec", "sys_eval", "java_method", "reflect", "try_reflect"))

CATALOG = Catalog(
    tables=(
        TableSpec("fact_sales", _cols("order_key bigint", "order_date date", "region_key bigint", "channel", "line", "category", "cust_key bigint", "part_key bigint", "quantity double", "gross decimal(18,4)", "discount decimal(18,4)", "returned decimal(18,4)", "net decimal(18,4)"), scope="region_key", fact=True, time="order_date"),
        TableSpec("sales_target", _cols("period_month date", "region_key bigint", "line", "target double"), scope="region_key", fact=True, time="period_month"),
        TableSpec("inventory", _cols("week date", "region_key bigint", "line", "available double", "safety double"), scope="region_key", fact=True, time="week"),
        TableSpec("dim_region", _cols("region_key bigint", "region_name", "province_count int")),
        TableSpec("dim_channel", _cols("channel")),
        TableSpec("dim_line", _cols("line")),
        TableSpec("dim_product", _cols("part_key bigint", "product_name", "line", "category", "list_price", list_price=ColumnSpec("list_price", INTERNAL, kind="decimal(12,2)"))),
        TableSpec("dim_customer", _cols("cust_key bigint", "customer_name", "region_key bigint", "channel", customer_name=ColumnSpec("customer_name", SENSITIVE, ("ADMIN",))), scope="region_key"),
    ),
    edges=frozenset(
        frozenset(((left, column), (right, column)))
        for left, right, column in (
            ("fact_sales", "dim_region", "region_key"), ("fact_sales", "dim_channel", "channel"), ("fact_sales", "dim_line", "line"), ("fact_sales", "dim_product", "part_key"), ("fact_sales", "dim_customer", "cust_key"),
            ("dim_product", "dim_line", "line"), ("sales_target", "dim_region", "region_key"), ("sales_target", "dim_line", "line"), ("inventory", "dim_region", "region_key"), ("inventory", "dim_line", "line"), ("dim_customer", "dim_region", "region_key"), ("dim_customer", "dim_channel", "channel"),
        )
    ),
    metrics=(
        Metric("net_sales", ("net sales", "net revenue", "revenue"), "sum(net)", ("fact_sales",), "CNY", "v1.2"),
        Metric("gross_sales", ("gross sales", "tax-inclusive sales"), "sum(gross)", ("fact_sales",), "CNY", "v1.2"),
        Metric("discount_amount", ("discount amount", "discount"), "sum(discount)", ("fact_sales",), "CNY", "v1.1"),
        Metric("return_amount", ("return amount", "returns"), "sum(returned)", ("fact_sales",), "CNY", "v1.1"),
        Metric("order_count", ("order count", "orders", "order lines"), "count(order_key)", ("fact_sales",), "rows", "v1.0"),
        Metric("target_amount", ("net sales target", "sales target", "target"), "sum(target)", ("sales_target",), "CNY", "v1.0"),
        Metric("available_qty", ("available stock", "stock", "inventory"), "sum(available)", ("inventory",), "pieces", "v1.0"),
    ),
    functions=FUNCTIONS,
)


def visible(df: DataFrame, table: TableSpec, who: Principal) -> DataFrame:
    """The table as a principal may see it: their columns, and their regions' rows at the leaf."""
    out = df.select(*(c.name for c in table.columns if c.visible_to(who.role)))
    return out.where(F.col(table.scope).isin(*who.regions)) if table.scope and who.regions else out
