"""Prompt templates compiled to Columns.

Supported: `{{.field}}`, `{{if .field}}..{{else}}..{{end}}`,
`{{range .field}}..{{.}}..{{end}}`, `{{join .field}}`, `{{clock .field}}`,
`{{broadcast "name"}}`, `{{broadcastJSON "name"}}`, `{{len .field}}`.  A field that
the schema lacks is an error (`strict`) or empty.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as txt
from .values import render

_ACTION = re.compile(r"\{\{-?\s*(.*?)\s*-?\}\}", re.S)


class TemplateError(ValueError):
    """A template that can't be compiled, or names a field that is not there."""


def parse(template: str) -> list:
    """Nested nodes: text, (action, argument), or (block, argument, body, else body)."""
    stack: list[tuple] = [("root", "", [], [])]
    target = [stack[0][2]]
    at = 0
    for m in _ACTION.finditer(template):
        if m.start() > at:
            target[-1].append(template[at : m.start()])
        at = m.end()
        word, _, rest = m[1].partition(" ")
        if word in ("if", "range"):
            node = (word, rest.strip(), [], [])
            target[-1].append(node)
            stack.append(node)
            target.append(node[2])
        elif word == "else":
            if len(stack) == 1:
                raise TemplateError("else outside a block")
            target[-1] = stack[-1][3]
        elif word == "end":
            if len(stack) == 1:
                raise TemplateError("end outside a block")
            stack.pop()
            target.pop()
        elif word.startswith("."):
            target[-1].append(("field", word[1:]))
        elif word in ("join", "clock", "broadcast", "broadcastJSON", "len"):
            target[-1].append((word, rest.strip()))
        else:
            raise TemplateError(f"unknown action {m[1]!r}")
    if len(stack) > 1:
        raise TemplateError("a block has no end")
    if at < len(template):
        target[-1].append(template[at:])
    return stack[0][2]


def fields(template: str) -> set[str]:
    """The fields that a template reads."""
    out: set[str] = set()

    def walk(nodes: list) -> None:
        for n in nodes:
            if isinstance(n, str):
                continue
            if n[0] == "field" and n[1]:
                out.add(n[1])
            elif n[0] not in ("broadcast", "broadcastJSON", "field") and n[1].startswith("."):
                out.add(n[1][1:])
            if len(n) == 4:
                walk(n[2])
                walk(n[3])

    walk(parse(template))
    return out


def compile_template(template: str, schema: T.StructType, *, strict: bool = True, broadcasts: dict | None = None, column: Callable[[str], Column] | None = None) -> Column:
    """A string Column for a template over rows of a schema."""
    get = column or (lambda name: F.col(f"`{name}`"))
    shared = broadcasts or {}

    def field(name: str) -> tuple[Column, T.DataType | None]:
        if name in schema.names:
            return get(name), schema[name].dataType
        if strict:
            raise TemplateError(f"no field {name!r}")
        return F.lit(None).cast("string"), T.StringType()

    def filled(col: Column, kind: T.DataType | None) -> Column:
        if isinstance(kind, (T.ArrayType, T.MapType)):
            return F.coalesce(F.size(col) > 0, F.lit(False))
        if isinstance(kind, T.BooleanType):
            return F.coalesce(col, F.lit(False))
        if isinstance(kind, T.NumericType):
            return F.coalesce(col != 0, F.lit(False))
        return render(col, kind) != ""

    def build(nodes: list, dot: tuple | None) -> Column:
        parts = [one(n, dot) for n in nodes]
        return F.concat(*parts) if parts else F.lit("")

    def one(n, dot: tuple | None) -> Column:
        if isinstance(n, str):
            return F.lit(n)
        name, arg = n[0], n[1]
        if name == "field":
            if not arg:
                if dot is None:
                    raise TemplateError("{{.}} outside range")
                return render(*dot)
            return render(*field(arg))
        if name in ("broadcast", "broadcastJSON"):
            key = arg.strip('"')
            if key not in shared:
                raise TemplateError(f"broadcast {key!r} is not declared")
            value = shared[key]
            return F.lit(json.dumps(value, sort_keys=True) if name == "broadcastJSON" or not isinstance(value, str) else value)
        own = dot if arg == "." else field(arg.lstrip("."))
        if own is None:
            raise TemplateError("{{.}} outside range")
        if name == "join":
            return txt.join_list(own[0]) if isinstance(own[1], T.ArrayType) else render(*own)
        if name == "clock":
            return txt.clock(render(*own))
        if name == "len":
            return F.coalesce(F.size(own[0]) if isinstance(own[1], T.ArrayType) else F.octet_length(render(*own)), F.lit(0)).cast("string")
        if name == "if":
            return F.when(filled(*own), build(n[2], dot)).otherwise(build(n[3], dot))
        if not isinstance(own[1], T.ArrayType):
            raise TemplateError(f"range over {arg} that is no list")
        body = F.array_join(F.transform(own[0], lambda x: build(n[2], (x, own[1].elementType))), "")
        return F.when(F.coalesce(F.size(own[0]) > 0, F.lit(False)), body).otherwise(build(n[3], dot))

    return build(parse(template), None)
