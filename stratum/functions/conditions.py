"""The twelve conditions over rendered values, case-sensitive and two-valued: an absent or null field renders as empty and never makes a condition null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import render, strip

# The operators.
OPS = ("is", "is-not", "contains", "not-contains", "non-empty", "empty", "exists", "missing", "gt", "gte", "lt", "lte")


def number(text: Column) -> Column:
    """A decimal number, infinity or NaN, with blanks around it; null for any other text."""
    form = r"(?i)^\s*[+-]?(\d+(\.\d*)?(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*$"
    return F.when(text.rlike(form), F.trim(text).try_cast("double"))


@dataclass(frozen=True)
class Cond:
    field: str
    op: str
    value: str = ""

    def column(self, schema: T.StructType) -> Column:
        if self.op not in OPS:
            raise ValueError(f"unknown condition {self.op!r}")
        there = self.field in schema.names
        if self.op == "exists":
            return F.lit(there)
        if self.op == "missing":
            return F.lit(not there)
        kind = schema[self.field].dataType if there else None
        raw = F.col(f"`{self.field}`") if there else F.lit(None).cast("string")
        text = render(raw, kind)
        if self.op in ("empty", "non-empty"):
            empty = F.coalesce(F.size(raw) <= 0, F.lit(True)) if isinstance(kind, (T.ArrayType, T.MapType)) else strip(text) == ""
            return empty if self.op == "empty" else ~empty
        if self.op in ("is", "is-not"):
            same = text == F.lit(self.value)
            return same if self.op == "is" else ~same
        if self.op in ("contains", "not-contains"):
            has = text.contains(self.value)
            return has if self.op == "contains" else ~has
        a, b = number(text), number(F.lit(self.value))
        both = a.isNotNull() & b.isNotNull()
        compare = {"gt": lambda x, y: x > y, "gte": lambda x, y: x >= y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y}[self.op]
        return F.when(both, compare(a, b)).otherwise(compare(text, F.lit(self.value)))
