"""Removal of sentences that repeat in spans.

A text is cut into sentences; every run of ``span`` consecutive sentences is
hashed (128 bits), however short, and joined over the whole corpus; a sentence goes if any run
that covers it also occurs earlier, in the order of (id, hash of the text, position).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, same_key, tune, written
from .suffix_dedup import _packed, _unpack

#: Sentences in a run.
SPAN = 2
_PIECE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")
_EDGE = " \t\n\r\x0b\x0c"
_BLANK = re.compile(r"[.!? \t\n\r\x0b\x0c]*")


def sentences(text: str) -> tuple[list[str], list[int]]:
    """Pieces that make up the text, and the numbers of those that are sentences:
    up to and with a row of end signs or line breaks, and not those alone."""
    pieces = _PIECE.findall(text)
    return pieces, [k for k, p in enumerate(pieces) if not _BLANK.fullmatch(p)]


def runs(text: str, span: int) -> list[bytes]:
    """A digest of each run."""
    pieces, at = sentences(text)
    keys = [pieces[k].strip(_EDGE) for k in at]
    return [xxhash.xxh3_128_digest("\n".join(keys[k : k + span]).encode()) for k in range(len(keys) - span + 1)]


def without_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", span: int = SPAN) -> DataFrame:
    """``doc_id, n_sentences, n_removed, kept`` of every row.

    A null or empty text has no sentences; a text of fewer than ``span`` keeps
    all.  The first occurrence of a span stays whole: that of the least (id, hash
    of the text, position), null ids first.  Rows that repeat both id and text
    are one document and fare alike.  An empty table gives no rows; other
    columns are ignored.
    """
    tune(docs.sparkSession)
    rows = keyed(docs, text, id_col)
    kind = pa.schema([("run", pa.binary()), ("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, th, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text"))):
                out += [(r, doc_id, th, k) for k, r in enumerate(runs(t or "", span))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    found = written(rows.mapInArrow(emit, "run binary, doc_id long, th long, at int"))
    place = F.struct("doc_id", "th", "at")
    # Written, so that a run which very many documents share is a side that the join can split.
    first = written(found.groupBy("run").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("NOT first <=> last").select("run", "first"))
    again = found.join(first, "run").where(~place.eqNullSafe(F.col("first"))).groupBy("doc_id", "th").agg(F.collect_set("at").alias("gone"))
    packed = _packed(rows)
    both = packed.join(again, same_key(packed, again), "left").select(packed["doc_id"], "n_bytes", "packed", "gone")
    result = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, data, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "packed", "gone"))):
                pieces, at = sentences(_unpack(data, n).decode())
                drop = {at[g + k] for g in gone or () for k in range(span)}
                out.append((doc_id, len(at), len(drop), "".join(p for k, p in enumerate(pieces) if k not in drop)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), result)], schema=result)

    return both.mapInArrow(cut, "doc_id long, n_sentences long, n_removed long, kept string")
