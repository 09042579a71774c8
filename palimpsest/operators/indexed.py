"""Queries that start from a predicate on a named key, or on an array of keys.

Keys are Column expressions; predicates on them reach the Parquet scan, whose
statistics take the place of an index structure.  Null keys match nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .query import Query


class IndexRoot:
    """One scalar predicate; the query after it is ordered by the key unless told otherwise."""

    def __init__(self, key: Column, query: Callable[[Column, Column], Query]) -> None:
        self._key, self._query = key, query

    def _root(self, predicate: Column) -> Query:
        return self._query(predicate, self._key)

    def equal(self, v: Any) -> Query:
        return self._root(self._key == F.lit(v))

    def isin(self, *vs: Any) -> Query:
        """Any of the values; repeated ones count once, none at all match nothing."""
        return self._root(self._key.isin(*dict.fromkeys(vs)) if vs else F.lit(False))

    def not_equal(self, v: Any) -> Query:
        return self._root(self._key != F.lit(v))

    def greater(self, v: Any) -> Query:
        return self._root(self._key > F.lit(v))

    def less(self, v: Any) -> Query:
        return self._root(self._key < F.lit(v))

    def greater_equal(self, v: Any) -> Query:
        return self._root(self._key >= F.lit(v))

    def less_equal(self, v: Any) -> Query:
        return self._root(self._key <= F.lit(v))

    def between(self, lo: Any, hi: Any) -> Query:
        """Inclusive; nothing if lo > hi."""
        return self._root(self._key.between(F.lit(lo), F.lit(hi)))

    def not_between(self, lo: Any, hi: Any) -> Query:
        """Each row once, also if lo > hi."""
        return self._root((self._key < F.lit(lo)) | (self._key > F.lit(hi)))


class SetIndexRoot:
    """One predicate on the elements of an array key; null elements are no elements,
    and rows without elements match neither ANY nor ALL."""

    def __init__(self, key: Column, query: Callable[[Column, Column | None], Query]) -> None:
        self._key, self._query = F.array_compact(key), query

    def _any(self, f: Callable[[Column], Column]) -> Query:
        return self._query(F.exists(self._key, f), None)

    def _all(self, f: Callable[[Column], Column]) -> Query:
        return self._query((F.size(self._key) > 0) & F.forall(self._key, f), None)

    @staticmethod
    def _in(vs: tuple) -> Callable[[Column], Column]:
        return lambda x: x.isin(*dict.fromkeys(vs)) if vs else F.lit(False)

    def any_equal(self, v: Any) -> Query:
        return self._query(F.array_contains(self._key, F.lit(v)), None)

    def any_in(self, *vs: Any) -> Query:
        return self._any(self._in(vs))

    def any_not_equal(self, v: Any) -> Query:
        return self._any(lambda x: x != F.lit(v))

    def any_not_in(self, *vs: Any) -> Query:
        return self._any(lambda x: ~self._in(vs)(x))

    def all_not_equal(self, v: Any) -> Query:
        return self._all(lambda x: x != F.lit(v))

    def all_not_in(self, *vs: Any) -> Query:
        return self._all(lambda x: ~self._in(vs)(x))

    def any_greater(self, v: Any) -> Query:
        return self._any(lambda x: x > F.lit(v))

    def all_greater(self, v: Any) -> Query:
        return self._all(lambda x: x > F.lit(v))

    def any_less(self, v: Any) -> Query:
        return self._any(lambda x: x < F.lit(v))

    def all_less(self, v: Any) -> Query:
        return self._all(lambda x: x < F.lit(v))

    def any_greater_equal(self, v: Any) -> Query:
        return self._any(lambda x: x >= F.lit(v))

    def all_greater_equal(self, v: Any) -> Query:
        return self._all(lambda x: x >= F.lit(v))

    def any_less_equal(self, v: Any) -> Query:
        return self._any(lambda x: x <= F.lit(v))

    def all_less_equal(self, v: Any) -> Query:
        return self._all(lambda x: x <= F.lit(v))
