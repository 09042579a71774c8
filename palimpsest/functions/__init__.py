"""Column expressions for the vocabulary that predicates and projections use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extension(name: Column | str) -> Column:
    """The last dot and what follows it; '' where there is none."""
    return F.regexp_extract(_c(name), r"(\.[^.]*)$", 1)


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *(_c(p) for p in parts))


def compare(a: Column | str, b: Column | str, ignore_case: bool = False) -> Column:
    """-1, 0 or 1, by bytes; null if either is."""
    x, y = (F.lower(_c(v)) if ignore_case else _c(v) for v in (a, b))
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def add_seconds(t: Column | str, n: Column | int) -> Column:
    return _shift("SECOND", t, n)


def add_milliseconds(t: Column | str, n: Column | int) -> Column:
    return _shift("MILLISECOND", t, n)


def _shift(unit: str, t: Column | str, n: Column | int) -> Column:
    return F.timestamp_add(unit, n if isinstance(n, Column) else F.lit(n), _c(t))


def ordinal(*order: Column | str) -> Column:
    """0, 1, 2 ... in the given order.  It needs all rows in one sort: for results
    of a bounded size, such as a page."""
    from pyspark.sql import Window

    return F.row_number().over(Window.orderBy(*order)) - 1
