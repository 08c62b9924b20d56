"""Functions of other SQL dialects in Spark's terms."""

from __future__ import annotations

import re

#: Format letters and their Java counterparts.
FORMATS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%i": "mm", "%s": "ss", "%S": "ss", "%M": "MMMM", "%b": "MMM", "%j": "DDD"}


def java_format(text: str) -> str:
    return re.sub(r"%[A-Za-z]", lambda m: FORMATS.get(m[0], m[0]), text)


def _split(args: str) -> list[str]:
    """Arguments at the top level of brackets and quotes."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(args):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif c == "," and not depth:
            out.append(args[at:i].strip())
            at = i + 1
    return [*out, args[at:].strip()]


def _calls(sql: str, name: str, rewrite) -> str:
    pattern = re.compile(rf"\b{name}\s*\(", re.IGNORECASE)
    at = 0
    while m := pattern.search(sql, at):
        depth, i, quote = 1, m.end(), ""
        while i < len(sql) and depth:
            c = sql[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            i += 1
        new = rewrite(_split(sql[m.end() : i - 1]))
        sql = sql[: m.start()] + new + sql[i:]
        at = m.start() + len(name) + 1
    return sql


def translated(sql: str) -> str:
    sql = _calls(sql, "date_format", lambda a: f"date_format({a[0]}, {java_format(a[1])})" if len(a) == 2 else f"date_format({', '.join(a)})")
    sql = _calls(sql, "str_to_date", lambda a: f"to_date({a[0]}, {java_format(a[1])})")
    sql = _calls(sql, "convert", lambda a: f"cast({a[0]} as {a[1]})")
    for name, sign in (("date_add", "+"), ("date_sub", "-")):
        sql = _calls(sql, name, lambda a, s=sign, n=name: f"({a[0]} {s} {a[1]})" if a[1].lower().startswith("interval") else f"{n}({', '.join(a)})")
    return sql
