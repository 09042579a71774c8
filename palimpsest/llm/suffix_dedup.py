"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Every position is a suffix, seen through its first ``size`` bytes.  Most
suffixes have no equal, and sorting all of them would move the corpus many
times over, so the order of work is:

1. Each document splits its suffixes into runs by *anchor*, the gram of least
   hash inside the window (:func:`windows.anchors`).  Equal windows have equal
   anchors at equal distance, so the anchor's hash is the first digit: a run
   whose anchor occurs once holds no repeated window.
2. Runs whose whole bytes recur (hashes of 64 + 64 bits) are repeated through
   and through; one run of each such class goes on for the comparison with others.
3. What is left, distinct runs under one anchor, carries its bytes to a task
   that does the remaining digit passes (:func:`windows.repeated`), 8 bytes a
   pass, and stops at ``size``.  As in any most-significant-digit sort only small
   groups are finished in one place: under an anchor with more than ``hot``
   distinct runs the next pass is spread over tasks, by a digit of 128 bits of
   each window.  Which of the two a group takes changes no result.

Work and traffic grow with the text; nothing is paired.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import windows
from .common import drop, keyed, release, same_key, tune, written

#: Bytes of an anchor gram.
GRAM = 32
#: Distinct runs of one anchor that a task may sort.
HOT_RUNS = 20_000
_ANCHORS = "doc_id long, th long, gram long, run long, lo int, hi int, lead short, times int"
_TASK_WINDOWS = 400_000
_ODD = 0x9E3779B97F4A7C15


def _anchor_rows(size: int, gram: int):
    """A row for each distinct run of a text, with its times there.  Places of runs
    that recur in the text need no others to be repeated: they come as spans of
    neighbouring places, with times 0, so a periodic text is a few rows."""
    names = ["doc_id", "th", "gram", "run", "lo", "hi", "lead", "times"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int32()]
    kind = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            nulls: list[np.ndarray] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")))
            for doc_id, th, text in rows:
                data = (text or "").encode()
                if len(data) < size:
                    continue
                g, at, lo, hi = windows.anchors(np.frombuffer(data, np.uint8), size, gram)
                runs = np.fromiter((xxhash.xxh3_64_intdigest(data[a : b + size]) for a, b in zip(lo.tolist(), hi.tolist())), np.uint64, len(lo))
                _, first, of, times = np.unique(g ^ (runs * np.uint64(_ODD)), return_index=True, return_inverse=True, return_counts=True)
                again = np.flatnonzero(times[of] > 1)
                new = np.flatnonzero(np.concatenate(([True], lo[again[1:]] != hi[again[:-1]] + 1))) if len(again) else again
                end = np.append(new[1:], len(again)) - 1 if len(again) else again
                a, b, none = lo[again[new]], hi[again[end]], np.zeros(len(new), np.int64)
                n = len(first) + len(new)
                nulls.append(np.full(n, doc_id is None))
                parts.append([
                    np.full(n, doc_id or 0), np.full(n, th), np.concatenate((g[first].view(np.int64), none)), np.concatenate((runs[first].view(np.int64), none)),
                    np.concatenate((lo[first], a)).astype(np.int32), np.concatenate((hi[first], b)).astype(np.int32), np.concatenate(((at - lo)[first], none)).astype(np.int16), np.concatenate((times, none)).astype(np.int32),
                ])
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts)]
                arrays = [pa.array(columns[0], types[0], mask=np.concatenate(nulls)), *(pa.array(c, t) for c, t in zip(columns[1:], types[1:]))]
                yield pa.RecordBatch.from_arrays(arrays, schema=kind)

    return run


def _packed(docs: DataFrame) -> DataFrame:
    """Texts as zstd, which a shuffle moves at a third of the size; other columns go along."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, LongType, StructType

    others = [f for f in docs.schema if f.name != "text"]
    names = [f.name for f in others]
    schema = StructType(others).add("n_bytes", LongType()).add("packed", BinaryType())
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            packed = [codec.compress(t, asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([len(t) for t in texts], pa.int64()), pa.array(packed, pa.binary())], names=kind.names)

    return docs.mapInArrow(run, schema)


def _unpack(packed: bytes, n: int) -> bytes:
    return pa.Codec("zstd").decompress(packed, n, asbytes=True) if n else b""


def _run_bytes(size: int):
    kind = pa.schema([("gram", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("lead", pa.int16()), ("single", pa.bool_()), ("hot", pa.bool_()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, th, n, packed, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "n_bytes", "packed", "asked"))):
                text = _unpack(packed, n)
                rows += [(q["gram"], doc_id, th, q["lo"], q["lead"], q["n"] == 1, q["hot"], text[q["lo"] : q["hi"] + size]) for q in asked]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 4096]), kind)], schema=kind)

    return run


_SPANS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _spans_of(rows: list[tuple], hit: np.ndarray, which: np.ndarray, offset: np.ndarray) -> list[tuple]:
    """Maximal runs of repeated window starts, for the runs that occur once."""
    out = []
    at = np.flatnonzero(hit)
    if not len(at):
        return out
    new = np.ones(len(at), dtype=bool)
    new[1:] = (which[at[1:]] != which[at[:-1]]) | (offset[at[1:]] != offset[at[:-1]] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    for a, b in zip(at[begin].tolist(), at[end].tolist()):
        _, doc_id, th, lo, _, single, _ = rows[which[a]]
        if single:
            out.append((doc_id, th, lo + int(offset[a]), lo + int(offset[b])))
    return out


def _window_arrays(rows: list[tuple], size: int):
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    length = np.array([len(r[6]) for r in rows], dtype=np.int64)
    count = length - size + 1
    which = np.repeat(np.arange(len(rows)), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(np.cumsum(length) - length, count) + offset
    lead = np.array([r[4] for r in rows], dtype=np.int64)[which] - offset
    return data, which, offset, starts, lead


def _sorted_blocks(size: int):
    """Digit passes over the runs of whole anchors; the input is ordered by gram."""

    def block(rows: list[tuple]) -> list[tuple]:
        data, which, offset, starts, lead = _window_arrays(rows, size)
        gram = np.array([r[0] for r in rows], dtype=np.int64)
        number = np.cumsum(np.concatenate(([False], gram[1:] != gram[:-1])))[which]
        return _spans_of(rows, windows.repeated(data, starts, number * (2 * size) + lead, size), which, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0

        def flush(rows):
            if found := block(rows):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _SPANS)], schema=_SPANS)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc_id", "th", "lo", "lead", "single", "data"))):
                if n > _TASK_WINDOWS and r[0] != held[-1][0]:
                    yield from flush(held)
                    held, n = [], 0
                held.append(r)
                n += len(r[6]) - size + 1
        if held:
            yield from flush(held)

    return run


def _hot_windows(size: int):
    """Each window of the runs of very common anchors, under a 128-bit digit."""
    kind = pa.schema([("gram", pa.int64()), ("lead", pa.int16()), ("digit", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("single", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for g, doc_id, th, lo, lead, single, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "doc_id", "th", "lo", "lead", "single", "data"))):
                rows += [(g, lead - j, xxhash.xxh3_128_digest(data[j : j + size]), doc_id, th, lo + j, single) for j in range(len(data) - size + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], schema=kind)

    return run


def repeated_spans(docs: DataFrame, size: int, gram: int = GRAM, hot: int = HOT_RUNS) -> DataFrame:
    """``doc_id, th, lo, hi``: windows that start at ``lo..hi`` also start elsewhere.

    ``docs`` is what :func:`common.keyed` returns.
    """
    if size < gram + 8:
        raise ValueError(f"size must be at least {gram + 8} bytes")
    spark = docs.sparkSession
    anchors = written(docs.where(F.octet_length("text") >= size).mapInArrow(_anchor_rows(size, gram), _ANCHORS))
    # Written, so that an anchor which very many documents share is a side that the join can split.
    known = written(anchors.where("times = 0").select("doc_id", "th", "lo", "hi"))
    some = anchors.where("times > 0")
    common = written(some.groupBy("gram").agg(F.sum("times").alias("c"), F.min("run").alias("r0"), F.max("run").alias("r1")).where("c > 1").select("gram", (F.col("r0") != F.col("r1")).alias("mixed")))
    release(spark)
    again = written(some.join(common, "gram"))
    drop(spark, anchors, common)
    release(spark)
    mixed = again.where("mixed")
    runs = written(mixed.groupBy("gram", "run").agg(F.sum("times").alias("n"), F.min(F.struct("doc_id", "th", "lo", "hi", "lead")).alias("of")))
    whole = again.where("NOT mixed").select("doc_id", "th", "lo", "hi").unionByName(
        mixed.join(runs.where("n > 1").select("gram", "run"), ["gram", "run"]).select("doc_id", "th", "lo", "hi")
    )
    busy = runs.groupBy("gram").count().where(F.col("count") > hot).select("gram", F.lit(True).alias("hot"))
    asked = runs.join(busy, "gram", "left").select("of.doc_id", "of.th", F.struct("gram", "of.lo", "of.hi", "of.lead", "n", F.coalesce("hot", F.lit(False)).alias("hot")).alias("q"))
    asked = asked.groupBy("doc_id", "th").agg(F.collect_list("q").alias("asked"))
    packed = _packed(docs.where(F.octet_length("text") >= size))
    text = packed.join(asked, same_key(packed, asked)).select(packed["doc_id"], packed["th"], "n_bytes", "packed", "asked")
    kind = "gram long, doc_id long, th long, lo int, lead short, single boolean, hot boolean, data binary"
    parts = written(text.mapInArrow(_run_bytes(size), kind))
    columns = ["gram", "doc_id", "th", "lo", "lead", "single", "data"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cold = parts.where("NOT hot").select(columns).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_sorted_blocks(size), "doc_id long, th long, lo int, hi int")
    wide = parts.where("hot").select(columns).mapInArrow(_hot_windows(size), "gram long, lead short, digit binary, doc_id long, th long, at int, single boolean")
    equal = written(wide.groupBy("gram", "lead", "digit").count().where("count > 1").select("gram", "lead", "digit"))
    wide = wide.where("single").join(equal, ["gram", "lead", "digit"]).select("doc_id", "th", F.col("at").alias("lo"), F.col("at").alias("hi"))
    return known.unionByName(whole).unionByName(cold).unionByName(wide)


def remove_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", size: int = 200, gram: int = GRAM, hot: int = HOT_RUNS, carry: list[str] | None = None) -> DataFrame:
    """Each row's text without the bytes that a repeated ``size``-byte string covers.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) for every row,
    and the columns ``carry`` as a struct of that name.
    Strings are compared as UTF-8 within the input only; all copies go, the first
    included, and overlapping occurrences in one text count.  A null text is an
    empty one; a text under ``size`` bytes keeps everything; a null id is an id
    like any other; repeated rows are copies of each other; an empty table gives
    no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    rows = keyed(docs, text, id_col, carry)
    spans = repeated_spans(rows.select("doc_id", "th", "text"), size, gram, hot).groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    packed = _packed(rows)
    others = ["carry"] if carry else []
    both = packed.join(spans, same_key(packed, spans), "left").select(packed["doc_id"], *others, "n_bytes", "packed", "spans")
    schema = StructType([f for f in both.schema if f.name in ("doc_id", "carry")]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, data, found in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "packed", "spans"))):
                data, kept, end, gone, runs = _unpack(data, n), [], 0, 0, 0
                until = -1  # end of the last removed run
                for a, b in sorted((s["lo"], s["hi"] + size) for s in found or ()):
                    if a > until:
                        kept.append(data[end:a])
                        runs += 1
                        until = a
                    if b > until:
                        gone += b - until
                        until = b
                    end = until
                kept.append(data[end:])
                out.append((n, gone, runs, b"".join(kept)))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *others)), *columns], names=schema.names)

    return both.mapInArrow(run, schema)


def text_of(kept: Column) -> Column:
    """Kept bytes as text; a character that lost some of its bytes goes whole."""

    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", "ignore"))

    return decode(kept)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
