"""Logs and streams: a sink for inserts, and the log's entries since a number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dataset import Dataset


def insert_stream(dataset: Dataset, rows: DataFrame, name: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Insert a stream's rows, each micro-batch once: the number of the last batch of
    each ``name`` is committed with that batch's rows, so a batch that failed is
    written when it is replayed, and one that was committed is passed over."""

    def put(batch: DataFrame, number: int) -> None:
        dataset._insert_batch(batch, name, number)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changes(dataset: Dataset, after: int = 0) -> tuple[DataFrame, int]:
    """The committed entries (inserts, updates, tombstones) of this generation with a
    number over ``after``, and the number to go on from.  A defrag starts a new
    generation, which holds the current rows alone."""
    with dataset._lock:
        rows = dataset._log_rows()
        return rows.where(F.col("_seq") > after), dataset._log.meta.last_seq
