"""Table functions: several rows and columns from one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import udtf


def table_function(handler: type, schema: str, *, arrow: bool = True) -> Callable:
    """A class whose `eval` yields rows of the schema, as a function of Columns; Arrow carries its batches."""
    return udtf(handler, returnType=schema, useArrow=arrow)


def lateral(df: DataFrame, function: Callable, *args: Column, outer: bool = False) -> DataFrame:
    """Each row beside the rows that the function gives for it; outer keeps rows for which it gives none."""
    return df.lateralJoin(function(*[a.outer() for a in args]), how="left" if outer else "inner")
