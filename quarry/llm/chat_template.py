"""Chat formatting by a small template compiler.

The template language has text, {{ expression }}, {% if %}/{% elif %}/{% else %}/{% endif %},
{% for message in messages %}/{% endfor %} and {% generation %}/{% endgeneration %}.  Expressions
know literals, names, attributes of a message or of loop, ==, !=, and, or, not, ~ (joining) and the
filters below.  Nothing else can be named, so a template cannot reach Python's objects.  A template
is parsed to a syntax tree, constants are folded, and the tree becomes nested Python closures, which
render a conversation and note the generation blocks' places in the output.

A conversation may hold a third of all rows, so conversations are never gathered: rows are sorted
by (conversation, turn) and rendered turn by turn, with one row of look-ahead for loop.last.

Defined results: a null text or role is empty; rows of one turn number come in the order of role and
text; repeated rows are turns; rows with a null conversation id form a conversation; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import ready

TEMPLATE = (
    "{% for message in messages %}<turn {{ message.role | escape }}>\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
)

_ESCAPED = re.compile(r"[\\<>]")
_TURN = re.compile(r"<turn ([^\\<>]*(?:\\.[^\\<>]*)*)>\n([^\\<>]*(?:\\.[^\\<>]*)*)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Control strings begin or end with < or >; those and the escape itself get a backslash."""
    return _ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    pass


# --- syntax tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple


@dataclass
class Text:
    value: str


@dataclass
class Show:
    value: object


@dataclass
class If:
    branches: list[tuple[object, list]]


@dataclass
class For:
    name: str
    over: Name
    body: list


@dataclass
class Generation:
    body: list


# --- parser ----------------------------------------------------------------------------------

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_][A-Za-z_0-9]*)|(==|!=|[|~().]))")
_ESCAPES = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    source = source.strip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at : at + 20]!r}")
        out.append((("text", "number", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """Recursive descent: or, and, not, comparison, joining, filters, atoms."""

    def __init__(self, source: str) -> None:
        self.rest = _tokens(source)

    def whole(self):
        out = self.either()
        if self.rest[0][0] != "end":
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")
        return out

    def take(self, *values: str) -> str | None:
        if self.rest[0][1] in values and self.rest[0][0] in ("name", "sign"):
            return self.rest.pop(0)[1]
        return None

    def chain(self, below: Callable, *ops: str):
        out = below()
        while op := self.take(*ops):
            out = Call(op, (out, below()))
        return out

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        return Call("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        return self.chain(self.joined, "==", "!=")

    def joined(self):
        return self.chain(self.filtered, "~")

    def filtered(self):
        out = self.atom()
        while self.take("|"):
            kind, name = self.rest.pop(0)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            out = Call("filter", (name, out))
        return out

    def atom(self):
        kind, value = self.rest.pop(0)
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return Const(int(value))
        if value == "(" and kind == "sign":
            out = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return out
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        if value in ("true", "false"):
            return Const(value == "true")
        path = [value]
        while self.take("."):
            kind, value = self.rest.pop(0)
            if kind != "name" or value.startswith("_"):
                raise TemplateError("bad attribute")
            path.append(value)
        return Name(tuple(path))


def parse(source: str) -> list:
    parts = [p for p in _PARTS.split(source) if p]
    body, end = _block(parts, 0, ())
    if end < len(parts):
        raise TemplateError(f"unexpected {parts[end]}")
    return body


def _block(parts: list[str], at: int, stops: tuple[str, ...]) -> tuple[list, int]:
    out: list = []
    while at < len(parts):
        part = parts[at]
        if part.startswith("{{"):
            out.append(Show(_Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word in stops:
                return out, at
            if word == "if":
                branches, condition = [], _Expression(rest).whole()
                while True:
                    body, at = _block(parts, at + 1, ("elif", "else", "endif"))
                    branches.append((condition, body))
                    if at >= len(parts):
                        raise TemplateError("if without endif")
                    word, _, rest = parts[at][2:-2].strip().partition(" ")
                    if word == "endif":
                        break
                    condition = Const(True) if word == "else" else _Expression(rest).whole()
                out.append(If(branches))
            elif word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+([A-Za-z]\w*)\s*", rest)
                if not m:
                    raise TemplateError(f"cannot read {part}")
                body, at = _block(parts, at + 1, ("endfor",))
                out.append(For(m[1], Name((m[2],)), body))
            elif word == "generation":
                body, at = _block(parts, at + 1, ("endgeneration",))
                out.append(Generation(body))
            else:
                raise TemplateError(f"unknown tag {word!r}")
            if at >= len(parts):
                raise TemplateError("a block is not closed")
        else:
            out.append(Text(part))
        at += 1
    if stops:
        return out, at
    return out, at


# --- constant folding ------------------------------------------------------------------------


def _apply(op: str, args: tuple):
    if op == "filter":
        return FILTERS[args[0]](str(args[1]))
    if op == "not":
        return not args[0]
    a, b = args
    return {"==": lambda: a == b, "!=": lambda: a != b, "~": lambda: f"{a}{b}", "and": lambda: a and b, "or": lambda: a or b}[op]()


def fold(node):
    """The same node with what is known now worked out; for statements a list of them."""
    if isinstance(node, Call):
        args = tuple(a if isinstance(a, str) else fold(a) for a in node.args)
        if all(isinstance(a, (Const, str)) for a in args):
            return Const(_apply(node.op, tuple(a.value if isinstance(a, Const) else a for a in args)))
        return Call(node.op, args)
    if isinstance(node, list):
        out: list = []
        for x in node:
            for y in _statement(x):
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + y.value)
                elif not (isinstance(y, Text) and not y.value):
                    out.append(y)
        return out
    return node


def _statement(x) -> list:
    if isinstance(x, Show):
        value = fold(x.value)
        return [Text(str(value.value))] if isinstance(value, Const) else [Show(value)]
    if isinstance(x, For):
        return [For(x.name, x.over, fold(x.body))]
    if isinstance(x, Generation):
        return [Generation(fold(x.body))]
    if isinstance(x, If):
        branches = []
        for condition, body in x.branches:
            condition = fold(condition)
            if isinstance(condition, Const):
                if not condition.value:
                    continue
                branches.append((condition, fold(body)))
                break
            branches.append((condition, fold(body)))
        if not branches:
            return []
        return branches[0][1] if isinstance(branches[0][0], Const) else [If(branches)]
    return [x]


# --- closures --------------------------------------------------------------------------------


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda scope, v=node.value: v
    if isinstance(node, Name):
        head, *rest = node.path

        def get(scope: dict):
            out = scope.get(head, "")
            for r in rest:
                out = out.get(r, "") if isinstance(out, dict) else ""
            return out

        return get
    if node.op == "filter":
        f, inner = FILTERS[node.args[0]], _value(node.args[1])
        return lambda scope: f(str(inner(scope)))
    parts = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda scope: parts[0](scope) and parts[1](scope)
    if node.op == "or":
        return lambda scope: parts[0](scope) or parts[1](scope)
    return lambda scope, op=node.op: _apply(op, tuple(p(scope) for p in parts))


def _run(nodes: list) -> Callable[[dict, Output], None]:
    steps = [_step(n) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict, out: Output) -> None:
        for s in steps:
            s(scope, out)

    return run


def _step(node) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        return lambda scope, out, v=node.value: out.add(v)
    if isinstance(node, Show):
        value = _value(node.value)
        return lambda scope, out: out.add(str(value(scope)))
    if isinstance(node, Generation):
        body = _run(node.body)

        def generation(scope: dict, out: Output) -> None:
            begin = out.size
            body(scope, out)
            out.spans.append((begin, out.size))

        return generation
    if isinstance(node, If):
        branches = [(_value(c), _run(b)) for c, b in node.branches]

        def choose(scope: dict, out: Output) -> None:
            for condition, body in branches:
                if condition(scope):
                    body(scope, out)
                    return

        return choose
    body, over = _run(node.body), _value(node.over)

    def loop(scope: dict, out: Output) -> None:
        items = list(over(scope))
        for i, x in enumerate(items):
            body({**scope, node.name: x, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, out)

    return loop


class Template:
    def __init__(self, source: str = TEMPLATE) -> None:
        self.tree = fold(parse(source))
        self._whole = _run(self.tree)
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For) and n.over.path == ("messages",)]
        #: A template that is one loop over the messages between constant texts can be rendered turn by turn.
        self.by_turn = len(loops) == 1 and all(isinstance(n, Text) for i, n in enumerate(self.tree) if i not in loops)
        if self.by_turn:
            at = loops[0]
            self._before = "".join(n.value for n in self.tree[:at])
            self._after = "".join(n.value for n in self.tree[at + 1 :])
            self._name, self._body = self.tree[at].name, _run(self.tree[at].body)

    def render(self, messages: list[dict[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation's text and its generation spans (code points, end exclusive)."""
        out = Output()
        self._whole({"messages": messages}, out)
        return out.text(), out.spans

    def turn(self, message: dict[str, str], index: int, last: bool) -> tuple[str, list[tuple[int, int]]]:
        """One turn's part of the output, with what stands before the first turn and after the last."""
        out = Output()
        if index == 0:
            out.add(self._before)
        self._body({self._name: message, "loop": {"index0": index, "first": index == 0, "last": last}}, out)
        if last:
            out.add(self._after)
        return out.text(), out.spans


# --- operator --------------------------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def format_turns(rows: DataFrame, *, source: str = TEMPLATE) -> DataFrame:
    """conv_id, place (0, 1, ... in the conversation), last, piece, spans: the pieces of a conversation, in order, are its formatted text.

    The result's rows lie sorted in partitions that hold whole conversations.
    """
    if not Template(source).by_turn:
        raise TemplateError("not a single loop over messages between constant texts; use Template.render")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = Template(source)
        held: tuple | None = None  # conversation, place, message
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held:
                    out.append(_piece(template, held, last=held[0] != conv))
                held = (conv, held[1] + 1 if held and held[0] == conv else 0, {"role": role or "", "text": text or ""})
            yield _pieces(out)
        if held:
            yield _pieces([_piece(template, held, last=True)])

    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(run, "conv_id long, place long, last boolean, piece string, spans array<struct<start:int,end:int>>")


def _piece(template: Template, held: tuple, last: bool) -> tuple:
    text, spans = template.turn(held[2], held[1], last)
    return held[0], held[1], last, text, [{"start": a, "end": b} for a, b in spans]


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), _SPANS)
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "place", "last", "piece", "spans"])


def read_turns(piece: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a formatted text."""
    at, out = 0, []
    while at < len(piece):
        m = _TURN.match(piece, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digest(formatted: DataFrame) -> DataFrame:
    """Reads pieces back, in order, a conversation at a time; only hashes and counts are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            out = []
            for conv, _, last, piece, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for role, text in read_turns(piece):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    text = unescape(piece[s["start"] : s["end"]])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    loss_chars += len(text)
                chars += len(piece)
                if last:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


HARD = "\\### Assistant: </turn> ok"


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return digest(format_turns(rows.unionByName(hard)))


OP3_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  length(replace(replace(replace(role, '\', '\\'), '<', '\<'), '>', '\>')) + length(replace(replace(replace(text, '\', '\\'), '<', '\<'), '>', '\>')) + 16 AS chars FROM r)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
