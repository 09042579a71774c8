"""The version algebra: what state each row of an append-only log is in.

A log has ``_id, _seq, _op`` (I, U or D), ``_created_at`` and value columns.  A
version is valid from its own time until the next entry of its id: then it is
``Stale``, or ``Deleted`` if that entry is a tombstone; without one it is ``Fresh``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRESH, STALE, DELETED = "Fresh", "Stale", "Deleted"
SYSTEM = ["_id", "_seq", "_op", "_created_at", "_encrypted", "_length", "_payload"]

#: Statistics by name: state, measure.  LastId comes from metadata.
STATISTICS = {f"{measure}{state}{what}": (state, measure.lower() or what.lower()) for state in (FRESH, STALE, DELETED) for measure, what in (("", "Count"), ("", "Size"), ("Max", "Size"), ("Min", "Size"), ("Avg", "Size"))}


def versions(log: DataFrame) -> DataFrame:
    """Every version with ``_state`` and ``_state_at``; tombstones only end their predecessor."""
    w = Window.partitionBy("_id").orderBy("_seq")
    seen = log.withColumn("_next", F.lead("_op").over(w)).withColumn("_state_at", F.lead("_created_at").over(w))
    state = F.when(F.col("_next").isNull(), FRESH).when(F.col("_next") == "D", DELETED).otherwise(STALE)
    return seen.where("_op <> 'D'").withColumn("_state", state).drop("_next")


def fresh(log: DataFrame, clean: bool = False) -> DataFrame:
    """Current versions.  A ``clean`` log (inserts only) is read as it is, without a shuffle."""
    if clean:
        return log
    # The newest entry of an id by a combining aggregate: one row an id and task is shuffled.
    newest = log.groupBy("_id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "_id")), "_seq").alias("_v"))
    return newest.where("_v._op <> 'D'").select("_id", "_v.*").select(*log.columns)


def current(inserts: DataFrame, changes: DataFrame) -> DataFrame:
    """Current versions of a log whose inserts and changes are apart.

    An id is inserted once, before all its changes, so an insert is current unless
    its id was changed, and else the newest change is, unless it is a tombstone.
    Winners are found on three columns of the changes; inserts are only filtered by
    ids (a broadcast, if the changes are few), so their scan keeps its filters and columns."""
    # One number, so that the aggregate hashes: the newest entry's, and whether it is a tombstone.
    newest = changes.groupBy("_id").agg(F.max(2 * F.col("_seq") + (F.col("_op") == "D").cast("long")).alias("_last"))
    live = newest.where("_last % 2 = 0").select("_id", F.expr("_last div 2").alias("_seq"))
    return inserts.join(newest.select("_id"), "_id", "left_anti").unionByName(changes.join(live, ["_id", "_seq"], "left_semi"))


def as_of(found: DataFrame, at: Column) -> DataFrame:
    """The versions whose time of validity holds ``at``, from ``versions()`` and archives."""
    return found.where((F.col("_created_at") <= at) & ((F.col("_state") == FRESH) | (F.col("_state_at") > at)))


def statistics(found: DataFrame, last_id: int | None, names: list[str] | None = None) -> dict[str, float | int | None]:
    """Requested statistics (all by default); the others are None; empty states give 0."""
    asked = set(STATISTICS) | {"LastId"} if names is None else set(names)
    unknown = asked - set(STATISTICS) - {"LastId"}
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    size = F.col("_length")
    rows = found.groupBy("_state").agg(F.count("*").alias("count"), F.sum(size).alias("size"), F.max(size).alias("max"), F.min(size).alias("min"), F.avg(size).alias("avg")).collect()  # at most 3 rows
    by = {r["_state"]: r.asDict() for r in rows}
    out: dict[str, float | int | None] = {n: (by.get(s, {}).get(m) or 0) if n in asked else None for n, (s, m) in STATISTICS.items()}
    return out | {"LastId": last_id if "LastId" in asked else None}


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
