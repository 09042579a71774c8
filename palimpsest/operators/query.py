"""The query builder: filter, order, skip, limit, then one terminal.

A builder compiles to one lazy DataFrame.  Rows have a natural order, given by the
columns ``natural``; it breaks ties of every other order, and is only sorted for
where an offset or limit depends on it, or where rows are handed out in order.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType

from ..sources.files import Files, shared_dir

Expr = Column | str


def _column(x: Expr) -> Column:
    return F.expr(x) if isinstance(x, str) else x


class Query:
    """``df`` is a DataFrame, or a function that a terminal calls for the rows of its
    moment.  ``update``/``delete`` are called with a function for exactly the chosen rows."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame], natural: list[Expr], update: Callable[[Callable[[], DataFrame], dict], int] | None = None, delete: Callable[[Callable[[], DataFrame]], int] | None = None, order: list[Expr] | None = None) -> None:
        self._df, self._natural, self._update, self._delete = df, [_column(c) for c in natural], update, delete
        self._filter: Column | None = None
        self._order: list[Column] | None = [_column(c) for c in order] if order else None
        self._skip: int | None = None
        self._limit: int | None = None
        self._set: set[str] = set()

    def _once(self, clause: str) -> None:
        if clause in self._set:
            raise RuntimeError(f"{clause} is already set")
        self._set.add(clause)

    def where(self, predicate: Expr | None) -> Query:
        self._once("where")
        self._filter = None if predicate is None else _column(predicate)
        return self

    def order_by(self, *keys: Expr) -> Query:
        self._once("order_by")
        if not keys:
            raise ValueError("order_by needs a key")
        self._order = [_column(k) for k in keys]
        return self

    def skip(self, n: int) -> Query:
        self._once("skip")
        if n < 0:
            raise ValueError("skip can't be negative")
        self._skip = n
        return self

    def limit(self, n: int) -> Query:
        self._once("limit")
        if n < 0:
            raise ValueError("limit can't be negative")
        self._limit = n
        return self

    def _sort(self) -> list[Column]:
        return [*(self._order or []), *self._natural]

    def _chosen(self) -> DataFrame:
        df = self._df() if callable(self._df) else self._df
        return df if self._filter is None else df.where(self._filter)

    def _rows(self, ordered: bool = False) -> DataFrame:
        df = self._chosen()
        if self._limit is not None:
            return df.orderBy(*self._sort()).offset(self._skip or 0).limit(self._limit)
        if self._skip:
            df = _without_first(df, self._sort(), self._skip)
        return df.orderBy(*self._sort()) if ordered else df

    # terminals

    def to_df(self, ordered: bool = True) -> DataFrame:
        """The rows; ``ordered=False`` saves a sort where no one looks at the order."""
        return self._rows(ordered)

    def select(self, *exprs: Expr, ordered: bool = True) -> DataFrame:
        return self._rows(ordered).select(*(_column(e) for e in exprs))

    def select_distinct(self, *exprs: Expr) -> DataFrame:
        """Distinct values of the rows that skip and limit leave, in no order."""
        return self._rows().select(*(_column(e) for e in exprs)).distinct()

    def count(self) -> int:
        """How many rows skip and limit leave, for which their order doesn't matter."""
        n = max(0, self._chosen().count() - (self._skip or 0))
        return n if self._limit is None else min(n, self._limit)

    def exists(self) -> bool:
        return not self._rows().isEmpty()

    def aggregate(self, kind: str, expr: Expr, null_on_empty: bool = False) -> DataFrame:
        """One row ``value``: sum, min, max or avg, of the kind of the argument.

        Empty input gives 0 (for min and max of other than numbers: null) unless
        ``null_on_empty``.  Sums of integers that overflow are errors."""
        df = self._rows().select(_column(expr).alias("value"))
        of = df.schema["value"].dataType
        value = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg}[kind]("value")
        to = _result_type(kind, of)
        value = value.cast(to) if to else value
        zero = _default(to or of)
        if not null_on_empty and zero is not None:
            value = F.coalesce(value, F.lit(zero).cast(to or of))
        return df.agg(value.alias("value"))

    def _scalar(self, kind: str, expr: Expr, null_on_empty: bool) -> Any:
        return self.aggregate(kind, expr, null_on_empty).head()["value"]  # type: ignore[index]

    def sum(self, expr: Expr, null_on_empty: bool = False) -> Any:
        return self._scalar("sum", expr, null_on_empty)

    def min(self, expr: Expr, null_on_empty: bool = False) -> Any:
        return self._scalar("min", expr, null_on_empty)

    def max(self, expr: Expr, null_on_empty: bool = False) -> Any:
        return self._scalar("max", expr, null_on_empty)

    def avg(self, expr: Expr, null_on_empty: bool = False) -> Any:
        return self._scalar("avg", expr, null_on_empty)

    def group_by(self, *keys: Expr) -> Grouped:
        if not keys:
            raise ValueError("group_by needs a key")
        return Grouped(self._rows(), [_column(k) for k in keys])

    def update(self, **values: Any) -> int:
        """New versions of exactly the chosen rows; returns how many."""
        if self._update is None:
            raise RuntimeError("this query reads only")
        return self._update(self._rows, values)

    def delete(self) -> int:
        if self._delete is None:
            raise RuntimeError("this query reads only")
        return self._delete(self._rows)


class Grouped:
    """Groups of the rows that skip and limit left; the last ``having`` counts."""

    def __init__(self, df: DataFrame, keys: list[Column]) -> None:
        self._df, self._keys = df, keys
        self._having: Column | None = None

    def having(self, predicate: Expr) -> Grouped:
        """A predicate over aggregates, such as ``F.count("*") > 2``."""
        self._having = _column(predicate)
        return self

    def select(self, *aggregates: Expr) -> DataFrame:
        """Keys and aggregates; null is a key like any other."""
        out = [_column(a) for a in aggregates]
        if self._having is None:
            return self._df.groupBy(*self._keys).agg(*out) if out else self._df.select(*self._keys).distinct()
        return self._df.groupBy(*self._keys).agg(*out, self._having.alias("__having")).where("__having").drop("__having")


def _forget(files: Files, uri: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        files.delete(uri)


def _without_first(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """All rows but the first ``n`` of an order, in no order.

    The rows are written in sorted ranges (a read of them twice could cut ranges
    differently), and a count per range says where the n-th row lies: no task gets
    more than its range.  The table lives in the shared folder until the driver exits."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/palimpsest-page-{uuid.uuid4().hex}"
    place = F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * (1 << 33)
    df.orderBy(*order).withColumns({"__range": F.spark_partition_id(), "__place": place}).write.parquet(uri)
    atexit.register(_forget, Files(spark), uri)
    rows = spark.read.parquet(uri)
    at, first = 0, (-1, 0)
    for r in sorted(rows.groupBy("__range").count().collect()):  # a row per task
        if at <= n < at + r["count"]:
            first = r["__range"], n - at
        at += r["count"]
    if at <= n:
        return rows.where(F.lit(False)).drop("__range", "__place")
    later = F.col("__range") > first[0]
    return rows.where(later | ((F.col("__range") == first[0]) & (F.col("__place") >= first[1]))).drop("__range", "__place")


def _result_type(kind: str, of: DataType) -> DataType | None:
    """Sums and averages keep the argument's kind: int sums are int, float ones float."""
    if kind == "sum" and isinstance(of, (IntegerType, ShortType, FloatType)):
        return of
    if kind == "avg" and isinstance(of, FloatType):
        return of
    if kind == "avg" and isinstance(of, DecimalType):
        return DecimalType(38, min(of.scale + 4, 28))
    if kind == "avg" or (kind == "sum" and isinstance(of, DoubleType)):
        return DoubleType()
    if kind == "sum" and isinstance(of, DecimalType):
        return DecimalType(38, of.scale)
    return LongType() if kind == "sum" else None


def _default(of: DataType) -> Any:
    if isinstance(of, (IntegerType, ShortType, LongType)):
        return 0
    if isinstance(of, (FloatType, DoubleType)):
        return 0.0
    if isinstance(of, DecimalType):
        return Decimal(0)
    return None
