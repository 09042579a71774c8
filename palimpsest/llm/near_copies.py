"""Near copies by SimHash, held to the Jaccard similarity of word shingles.

Distinct shingle sets, not documents, are compared, and each link is verified by the
whole sets.  First come the fingerprints of the sets, by the generalised pigeonhole
principle of :mod:`.simhash`: pairs within ``RADIUS`` bits are verified, and sets that
links join have one label.  How many bits alike sets differ in is spread (at 0.8, 10
of 64 are usual), so a radius that is affordable does not reach all of them.

The links beyond it come from keys.  Each set gets ``BANDS`` keys, a key of ``ROWS``
minimum hashes; two sets of similarity s share no key with probability
(1 - s**ROWS)**BANDS, 5e-7 at 0.8.  Sets that share a key and have different labels
are candidates.

A large group isn't compared pair by pair.  By its keys a set is compared with one other,
of those that lead its buckets the one that leads most, and takes over that one's
label if they are alike.  A bucket is led by the set that shares most keys
with all others: of a text and its many copies, each changed elsewhere, that is the
text.  Then candidates are verified, but for
those that their differences from one leader rule out: how two sets differ follows
from how each differs from a third, so copies of one text are held against each
other by their few changes.  Labels and differences only save work; components are
made once, of all links, and each link was verified by the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import keyed, tune, written
from .components import components

WIDTH, SIMILARITY = 5, 0.8
#: Bits of 64 in which the fingerprints of candidates differ at most.
RADIUS = 10
#: Fingerprints of one bucket are compared in one place up to here: a row costs as much as some thousand comparisons.
BUCKET, PROBE = 1 << 18, 1000
#: Times that a larger bucket is cut: each makes RADIUS + 1 rows of one.
LEVELS = 1
BANDS, ROWS = 48, 6
#: Shared keys that tell a leader from a chance meeting (at 0.8, 13 of 48 are usual).
SEVERAL = 4
#: Sets under this similarity to the leader that they asked are held against others whole.
NEAR = 0.5
_SLICE = 4096
_random = np.random.default_rng(42)
_FLIP = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.dtype("<u8"))
    parts = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.dtype("<u8")))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set that isn't empty."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32)
    for k in range(0, len(low), _SLICE):
        np.minimum(least, ((low[k : k + _SLICE] ^ _FLIP) * _TIMES).min(axis=1), out=least)
    bands = least.reshape(BANDS, ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)), np.uint64, BANDS).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _sketches(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    kind = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            sid = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([simhash.of_hashes(s) for s in sets], np.uint64).view(np.int64)
            keys = [band_keys(s) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(sid), pa.array([len(s) for s in sets], pa.int32()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], schema=kind)

    return keyed(docs, text, id_col).mapInArrow(run, "doc_id long, th long, sid long, n int, fp long, keys array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["sid", "items"])


def _compared(pairs: DataFrame, sets: DataFrame, changes: bool = False) -> DataFrame:
    """``a, b, s``: the similarity of the sets of each pair; with ``changes``, ``diff``
    too: 4 bytes of each hash that only one of the two has, where they are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(s.as_buffer(), "<u8") for s in batch.column(c)] for c in "xy"]
            found = [similarity(x, y) for x, y in zip(*sides)]
            columns = [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())]
            if changes:
                diff = [(np.setxor1d(x, y, assume_unique=True) >> np.uint64(32)).astype("<u4").tobytes() if s >= NEAR else None for x, y, s in zip(*sides, found)]
                columns.append(pa.array(diff, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "s", "diff"][: len(columns)])

    # By the other side last: many sets meet one leader there, and that join can be split.
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, s double" + ", diff binary" * changes)


def _bucket(sid: np.ndarray, root: np.ndarray, n: np.ndarray, ref: np.ndarray, diff: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a bucket's members that have different labels and may be alike.

    Members with one ``ref`` share at least overlap elements of their changes, and so
    differ in at most |changes| + |changes| - 2 overlap hashes; short hashes that
    collide only raise the overlap, so no pair of alike sets is passed over."""
    parts = [np.frombuffer(x, "<u4") for x in diff]
    size = np.array([len(x) for x in parts])
    owner = np.repeat(np.arange(len(sid)), size)
    _, element = np.unique(np.concatenate(parts), return_inverse=True)
    order = np.argsort(element, kind="stable")
    owners, begin = owner[order], np.searchsorted(element[order], np.arange(element.max() + 2 if len(element) else 1))
    first = np.concatenate(([0], np.cumsum(size)))
    for k in range(len(sid) - 1):
        u, v = np.minimum(n[k], n), np.maximum(n[k], n)
        open_ = (root != root[k]) & (u >= SIMILARITY * v - 1e-9)
        open_[: k + 1] = False
        if not open_.any():
            continue
        mine = element[first[k] : first[k + 1]]
        shared = np.bincount(np.concatenate([owners[begin[e] : begin[e + 1]] for e in mine]), minlength=len(sid)) if len(mine) else np.zeros(len(sid), np.int64)
        both = (n[k] + n - (size[k] + size - 2 * shared)) / 2
        far = (ref == ref[k]) & (both < SIMILARITY * (n[k] + n - both) - 1e-6)
        other = sid[open_ & ~far]
        if len(other):
            yield np.maximum(other, sid[k]), np.minimum(other, sid[k])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for members in batch.column("members"):
            numbers = [members.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)]
            for a, b in _bucket(*numbers, members.values.field(4).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def by_fingerprint(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: pairs of sets whose fingerprints differ in at most ``radius`` bits and whose
    sizes allow a link; of sets with one fingerprint, each with the least.

    ``prints`` has ``sid, n, fp`` of each set.  A fingerprint with very many neighbours
    is paired with one of them, see :func:`simhash.neighbours`."""
    first = written(prints.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("k")).select("fp", F.col("k.sid").alias("b"), F.col("k.n").alias("m")))
    close = simhash.links(first.select("fp"), radius, bucket, simhash.neighbours, PROBE, LEVELS)
    apart = close.toDF("x", "y").join(first.toDF("x", "sid", "n"), "x").join(first.toDF("y", "b", "m"), "y")
    equal = prints.join(first, "fp").where("sid <> b")
    both = apart.select("sid", "n", "b", "m").unionByName(equal.select("sid", "n", "b", "m"))
    return both.where(F.least("n", "m") >= SIMILARITY * F.greatest("n", "m") - 1e-9).select(F.greatest("sid", "b").alias("a"), F.least("sid", "b").alias("b"))


def grouped(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, th, root`` of each row; root names the component of the links
    between sets of 5-word shingles whose Jaccard similarity is 0.8 or more.
    Texts without words are one set."""
    tune(docs.sparkSession)
    each = written(_sketches(docs, text, id_col))
    distinct = each.groupBy("sid").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    filed = distinct.select("sid", "n", F.explode("keys").alias("key"))
    rows = written(filed.join(filed.groupBy("key").count().where("count > 1"), "key"))
    prints = written(each.where("n > 0").select("sid", "n", "fp").distinct())
    close = written(by_fingerprint(prints).distinct())
    candidates = rows.select("sid").unionByName(close.select(F.explode(F.array("a", "b")).alias("sid")))
    wanted = written(each.join(candidates.distinct(), "sid").groupBy("sid").agg(F.min("th").alias("th")))
    texts = keyed(docs, text, id_col).select("th", "text").join(wanted, "th").dropDuplicates(["sid"]).select("sid", "text")
    sets = written(texts.mapInArrow(_sets, "sid long, items binary"))
    same = F.col("s") >= SIMILARITY - 1e-9
    printed = written(_compared(close, sets).where(same).select("a", "b"))
    joined = written(components(printed))
    shared = written(rows.groupBy("sid").agg(F.sum("count").alias("shared")))
    now = written(rows.select("key", "sid", "n").join(shared, "sid"))
    # Written like all aggregates below, so that a bucket of very many members is a side that the joins can split.
    lead = written(now.groupBy("key").agg(F.min(F.struct((-F.col("shared")).alias("order"), F.col("sid").alias("b"), F.col("n").alias("m"))).alias("k")).select("key", (-F.col("k.order")).alias("led"), "k.b", "k.m"))
    near = F.least("n", "m") >= SIMILARITY * F.greatest("n", "m") - 1e-9
    met = now.join(lead, "key").where((F.col("sid") != F.col("b")) & near).groupBy("sid", "led", "b").agg(F.count("*").alias("c"))
    # Of leaders that it shares several keys with, the one that leads most: members of a large group ask the same.
    best = met.groupBy("sid").agg(F.max(F.struct(F.least("c", F.lit(SEVERAL)), "led", "c", "b")).alias("k")).select(F.col("sid").alias("a"), "k.b")
    asked = written(_compared(best, sets, changes=True))
    known = asked.select(F.col("a").alias("sid"), F.when(same, F.col("b")).alias("to"), F.when(F.col("diff").isNotNull(), F.col("b")).alias("ref"), "diff")
    # A set takes the label of its leader if they are alike, and may miss that of its own links: more work later, no harm.
    known = written(known.join(joined.select(F.col("node").alias("sid")), "sid", "full").withColumn("to", F.coalesce("to", "sid")))
    known = known.join(joined.toDF("to", "root"), "to", "left").select("sid", F.coalesce("root", "to").alias("root"), "ref", "diff")
    now = written(now.join(known, "sid", "left").select("key", "sid", "n", F.coalesce("root", "sid").alias("root"), F.coalesce("ref", "sid").alias("ref"), F.coalesce("diff", F.lit(b"")).alias("diff")))
    open_ = written(now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"))
    members = now.join(open_, "key").groupBy("key").agg(F.collect_list(F.struct("sid", "root", "n", "ref", "diff")).alias("members"))
    pairs = members.select("members").mapInArrow(_across, "a long, b long").distinct()
    links = written(_compared(written(pairs), sets).where(same))
    found = printed.unionByName(asked.where(same).select("a", "b")).unionByName(links.select("a", "b"))
    roots = written(components(found))
    return each.select("doc_id", "th", "sid").join(roots.toDF("sid", "found"), "sid", "left").select("doc_id", "th", F.coalesce("found", "sid").alias("root"))
