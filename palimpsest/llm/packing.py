"""Harmonic packing of token sequences.

A document's ids are cut into pieces, each of a class k: slots of capacity // k
ids, k of them to a bin.  The cut depends on the document's length alone, so all
workers cut independently; bins of a class take exactly k pieces, by rank.  Only
the fewer than k pieces that are left of each class, a number bounded by the
capacity, are put together by first fit.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tune, written
from .tokens import default_vocabulary, drops_space, encoder

CAPACITY = 4096
#: A rest stays whole if its slot wastes at most this part of it.
WASTE = 1 / 256


def classes(capacity: int = CAPACITY) -> np.ndarray:
    """The class numbers: all of 1..64, then powers of two."""
    some = [k for k in range(1, min(64, capacity) + 1)]
    k = 128
    while k <= capacity:
        some.append(k)
        k *= 2
    return np.array(some)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of ``n`` ids, in order."""
    out = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    slots = capacity // _classes(capacity)
    while rest:
        over = int(np.searchsorted(-slots, -rest, side="right")) - 1  # the smallest slot that holds the rest
        if slots[over] - rest <= rest * WASTE or over + 1 == len(slots):
            out.append((rest, int(_classes(capacity)[over])))
            break
        under = over + 1
        out.append((int(slots[under]), int(_classes(capacity)[under])))
        rest -= int(slots[under])
    return out


_known: dict[int, np.ndarray] = {}


def _classes(capacity: int) -> np.ndarray:
    if capacity not in _known:
        _known[capacity] = classes(capacity)
    return _known[capacity]


def _first_fit(pieces: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """Bin of each ``(length, key)``, longest first."""
    room: list[int] = []
    where = {}
    for length, key in sorted(pieces, key=lambda p: (-p[0], p[1])):
        for b, r in enumerate(room):
            if r >= length:
                break
        else:
            b = len(room)
            room.append(capacity)
        room[b] -= length
        where[key] = b
    return where


def pieces_of(docs: DataFrame, vocabulary: str, end: int, capacity: int, text: str, id_col: str) -> DataFrame:
    by_word = drops_space(vocabulary)
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("class", pa.int32()), ("worker", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        worker = context.partitionId() if context else 0
        encode = encoder(vocabulary, by_word)
        seen: dict[int, int] = {}
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encode(t, end)
                at = 0
                for length, k in cut(len(ids), capacity):
                    nth = seen.get(k, 0)
                    seen[k] = nth + 1
                    rows.append((doc_id, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids), k, worker, nth))
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, worker int, nth long")


def pack(docs: DataFrame, text: str = "text", id_col: str = "doc_id", vocabulary: str | None = None, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone.  Every row is a document of its
    own, also where ids repeat or are null; ties between equal lengths go by
    worker and order of arrival.  An empty table gives no rows; other columns
    are ignored.
    """
    tune(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    # Written once: the ranks below read a fixed dealing of pieces to workers.
    pieces = written(pieces_of(docs, vocabulary, end, capacity, text, id_col))
    held = pieces.groupBy("class", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("worker")
    held = held.withColumn("base", F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    total = held.groupBy("class").agg(F.sum("n").alias("total"))
    bins = total.withColumn("bins", F.expr("total div class"))  # a row per class
    first = bins.withColumn("first", F.coalesce(F.sum("bins").over(Window.orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("bins").over(Window.partitionBy()))
    held = held.join(F.broadcast(first), "class").select("class", "worker", F.coalesce("base", F.lit(0)).alias("base"), "bins", "first", "all")
    ranked = pieces.join(held, ["class", "worker"]).withColumn("rank", F.col("base") + F.col("nth"))
    filled = F.col("rank") < F.col("bins") * F.col("class")
    full = ranked.where(filled).withColumn("sequence_id", F.col("first") + F.expr("rank div class")).withColumn("slot", F.expr("rank % class"))
    # Fewer than k pieces of each class k: at most sum(k - 1) rows, whatever the input.
    left = ranked.where(~filled).select("class", "rank", "length")
    kind = pa.schema([("class", pa.int32()), ("rank", pa.int64()), ("bin", pa.int64())])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("class", "rank", "length")))]
        rows.sort()
        where = _first_fit([(r[2], k) for k, r in enumerate(rows)], capacity)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*((r[0], r[1], where[k]) for k, r in enumerate(rows))), kind)], schema=kind)

    fitted = left.coalesce(1).mapInArrow(fit, "class int, rank long, bin long")
    rest = ranked.where(~filled).join(fitted, ["class", "rank"]).withColumn("sequence_id", F.col("all") + F.col("bin")).withColumn("slot", F.col("class") * F.lit(1 << 40) + F.col("rank"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"]
    placed = full.select(*names, "slot").unionByName(rest.select(*names, "slot"))
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0))).select(*names, "offset")
