"""SimHash near-duplicates by the generalised pigeonhole principle.

Distinct fingerprints, not documents, are compared.  Two of them differ in at
most ``radius`` bits only if, for some partition i of the bits, they differ in at
most t_i bits of it, whenever the t_i + 1 add up to radius + 1.  Bits that vary
together share a partition; a dynamic programme picks the t_i from the candidate
counts that the partitions' value frequencies over all fingerprints predict.
Each fingerprint is filed under its value in the chosen partitions, probes all
values within t_i, and every candidate is verified by its whole distance.

A bucket of more than ``bucket`` fingerprints isn't compared in one place: the
principle is applied again to the bits that it leaves open, which cuts the bucket
without losing a link.  Inside a bucket only a spanning forest of links goes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, keyed, same_key, tune, whole_rows, written
from .components import components

BITS = 64
#: Fingerprints of one bucket that are compared in one place.
BUCKET = 512
#: Times that an overfull bucket is cut by its open bits: 64 bits leave at most 2**13 values then.
LEVELS = 4
#: What filing a fingerprint under one value costs, in comparisons.
PROBE = 40
#: Fingerprints with more neighbours than these are paired with one of them.
FEW = 8
_SLICE = 1 << 16


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of one text, as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles: list[bytes] = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width)))))
    return of_hashes(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.dtype("<u8"), len(shingles)))


def of_hashes(hashes: np.ndarray) -> int:
    """The fingerprint of some features by their 64-bit hashes."""
    n = len(hashes)
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, _SLICE):
        part = hashes[k : k + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3) -> DataFrame:
    """``doc_id, th, fp`` per row: id, hash of the text, and signed fingerprint of the whole text."""
    kind = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(found.view(np.int64))], schema=kind)

    tune(docs.sparkSession)
    return keyed(docs, text, id_col).mapInArrow(run, "doc_id long, th long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _joint_counts(fps: DataFrame) -> np.ndarray:
    """How often bits i and j are both set, over all fingerprints (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            x = batch.column("fp").to_numpy(zero_copy_only=False).astype("<i8")
            bits = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        rows = total.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["i", "c"])

    rows = fps.select("fp").mapInArrow(run, "i int, c array<long>")
    sums = rows.groupBy("i").agg(*(F.sum(F.col("c")[j]).alias(f"c{j}") for j in range(BITS))).collect()  # 64 rows
    out = np.zeros((BITS, BITS))
    for r in sums:
        out[r[0]] = r[1:]
    return out


def bit_order(joint: np.ndarray, n: int) -> list[int]:
    """The bits, each next to those that it is most correlated with."""
    mean = np.diag(joint) / max(n, 1)
    cov = joint / max(n, 1) - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    rho = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(rho, 0)
    order = [int(rho.sum(axis=1).argmax())]
    left = set(range(BITS)) - set(order)
    while left:
        near = max(sorted(left), key=lambda b: rho[b, order[-8:]].mean())
        order.append(near)
        left.remove(near)
    return order


def split_bits(bits: list[int], parts: int) -> list[list[int]]:
    at = np.linspace(0, len(bits), parts + 1).round().astype(int)
    return [bits[a:b] for a, b in zip(at, at[1:])]


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def allocate(costs: list[list[float]], radius: int) -> tuple[list[int], float]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = radius + 1 and least total cost.

    ``costs[i][s]`` is partition i's cost at t_i = s - 1."""
    need = radius + 1
    best: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * need
    for own in costs:
        best = [min(((best[s - k][0] + own[k], best[s - k][1] + [k - 1]) for k in range(s + 1)), key=lambda x: x[0]) for s in range(need + 1)]
    return best[need][1], best[need][0]


def _plan(fps: DataFrame, n: int, radius: int, probe: float = PROBE) -> tuple[list[int], list[tuple[list[int], int]]]:
    """The order of the bits, and the partitions to use with their thresholds."""
    joint = _joint_counts(fps)
    order = bit_order(joint, n)
    mean = np.diag(joint) / max(n, 1)
    # Fewer parts would need thresholds over 2, with very many probes, and have as many values as there are fingerprints.
    layouts = [split_bits(order, m) for m in range(max(2, (radius + 3) // 3), radius + 2)]
    parts = [p for layout in layouts for p in layout]
    values = fps.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(mask_of(p)))).alias("v")) for i, p in enumerate(parts)))).alias("x")).select("x.i", "x.v")
    counts = values.groupBy("i", "v").count().groupBy("i").agg(F.sum(F.expr("count * (count - 1) / 2")).alias("pairs"))
    pairs = {r["i"]: float(r["pairs"]) for r in counts.collect()}  # a row per partition
    best: tuple[float, list] | None = None
    i = 0
    for layout in layouts:
        costs = []
        for bits in layout:
            p = 2 * mean[bits] * (1 - mean[bits])
            odds = np.minimum(p / np.maximum(1 - p, 1e-9), 1)
            near, poly = [], np.zeros(radius + 1)
            poly[0] = 1
            for o in odds:  # elementary symmetric sums: pairs at each distance against pairs at 0
                poly[1:] += poly[:-1] * o
            probes = 0.0
            for t in range(radius + 1):
                probes += comb(len(bits), t)
                near.append(max(pairs.get(i, 0.0), 1.0) * poly[: t + 1].sum() + probe * max(n, 1) * (probes + (t > 0)))
            costs.append([0.0, *near])
            i += 1
        thresholds, cost = allocate(costs, radius)
        if best is None or cost < best[0]:
            best = cost, [(b, t) for b, t in zip(layout, thresholds) if t >= 0]
    assert best
    return order, best[1]


def _values_within(bits: list[int], t: int) -> Column:
    base = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
    flips = [c for k in range(t + 1) for c in combinations(bits, k)]
    return F.array(*(base.bitwiseXOR(F.lit(signed(mask_of(list(c))))) for c in flips))


def _verify(radius: int):
    """Links inside a bucket: each member to the least member of its part of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for members in batch.column("members"):
                x = np.unique(np.asarray(members.values.to_numpy(zero_copy_only=False), dtype=np.int64))
                u = x.view(np.uint64)
                if len(x) == 2:
                    label = np.array([0, 0 if int(np.bitwise_count(u[0] ^ u[1])) <= radius else 1])
                else:
                    label = np.arange(len(x))
                    while True:
                        new = np.array([label[np.bitwise_count(u ^ v) <= radius].min() for v in u])
                        new = new[new]
                        if (new == label).all():
                            break
                        label = new
                at = np.flatnonzero(label != np.arange(len(x)))
                a.append(x[at])
                b.append(x[label[at]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)], names=["a", "b"])

    return run


def neighbours(radius: int, few: int = FEW):
    """Pairs inside a bucket, for an exact check to follow: each member with all
    members within ``radius`` bits; where they are more than ``few``, with the one
    of them that has most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for members in batch.column("members"):
                x = np.unique(np.asarray(members.values.to_numpy(zero_copy_only=False), dtype=np.int64))
                u = x.view(np.uint64)
                step = max(1, _SLICE // len(u))
                degree = np.concatenate([(np.bitwise_count(u[k : k + step, None] ^ u) <= radius).sum(axis=1) for k in range(0, len(u), step)]) - 1
                some = np.flatnonzero(degree)
                for k in range(0, len(some), step):
                    at = some[k : k + step]
                    near = np.bitwise_count(u[at, None] ^ u) <= radius
                    near[np.arange(len(at)), at] = False
                    many = degree[at] > few
                    one = np.where(near[many], degree, -1).argmax(axis=1)
                    i, j = np.nonzero(near[~many])
                    a += [x[at[many]], x[at[~many][i]]]
                    b += [x[one], x[j]]
            sides = [np.concatenate(v) if v else np.empty(0, np.int64) for v in (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(*sides)), pa.array(np.minimum(*sides))], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET, verify=_verify, probe: float = PROBE, levels: int = LEVELS) -> DataFrame:
    """``a, b``: links that join all distinct ``fp`` within ``radius`` bits, directly or by
    others; with ``verify=neighbours``, pairs within ``radius`` bits.  A bucket that was cut
    ``levels`` times is compared in one place, whatever its size."""
    spark = fps.sparkSession
    n = fps.count()
    order, chosen = _plan(fps, n, radius, probe)
    rows = None
    for i, (bits, t) in enumerate(chosen):
        one = fps.select(F.lit(i).alias("part"), F.explode(_values_within(bits, t)).alias("key"), F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("rest"), "fp")
        rows = one if rows is None else rows.unionByName(one)
    assert rows is not None
    masks = {(i, 0) for i, _ in enumerate(chosen)}
    name = ["part", "key", "mask", "rest"]
    found = []
    for level in range(levels + 1):
        # Written, so that a bucket of very many members is a side that the join can split.
        sizes = written(rows.groupBy(*name).count().where("count > 1"))
        last = level == levels
        sized = rows.join(sizes, name)
        cold = sized if last else sized.where(F.col("count") <= bucket)
        found.append(cold.groupBy(*name).agg(F.collect_list("fp").alias("members")).select("members").mapInArrow(verify(radius), "a long, b long"))
        if last:
            break
        hot = written(sized.where(F.col("count") > bucket).select(*name, "fp"))
        if hot.isEmpty():
            drop(spark, hot)
            break
        # The members agree on what is fixed, or nearly: all `radius` bits may lie in the rest.
        cuts, new = None, set()
        for i, m in sorted(masks):
            open_bits = [b for b in order if not (m | mask_of(chosen[i][0])) >> b & 1]
            pieces = [p for p in split_bits(open_bits, radius + 1)]
            options = F.array(*(F.lit(signed(m | mask_of(p))) for p in pieces))
            new |= {(i, m | mask_of(p)) for p in pieces}
            at = (F.col("part") == i) & (F.col("mask") == signed(m))
            cuts = F.when(at, options) if cuts is None else cuts.when(at, options)
        masks = new
        rows = hot.select("part", "key", F.explode(cuts).alias("mask"), "fp").withColumn("rest", F.col("fp").bitwiseAND(F.col("mask")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def grouped(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, th, fp, root, component_id`` of each row; root names the component."""
    each = written(fingerprints(docs, text, id_col, width))
    fps = written(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(fps.select("fp"), radius, bucket))
    linked = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = written(linked)
    least = written(linked.groupBy("root").agg(F.min("first").alias("component_id")))
    of = written(linked.join(least, "root").select("fp", "root", "component_id"))
    return each.join(of, "fp")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row.

    Rows whose fingerprints differ in at most ``radius`` bits are linked, and
    component_id is the least id that a row reaches by links, itself included.
    Fewer than ``width`` words are one shingle; no words (null, empty, white
    space) give the fingerprint 0, linked like any other.  Equal fingerprints are
    equal rows here, so repeated rows and ids cost nothing and each gets its row.
    A null id gets a row, and is passed over where a component has other ids.
    An empty table gives no rows; other columns are ignored.
    """
    found = grouped(docs, text, id_col, width, radius, bucket)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs``, one of each component: that of the least id, null ids
    last, then of the least hash of the text; of rows that repeat both, one."""
    return first_of_each(docs, grouped(docs, text, id_col, width, radius, bucket), text, id_col)


def first_of_each(docs: DataFrame, found: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that :func:`one_of_each` keeps; ``found`` has doc_id, th and root."""
    rows = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "n")
    keep = written(rows.groupBy("root").agg(F.min(order).alias("k")).select("k.doc_id", "k.th", "k.n"))
    each = whole_rows(docs, text, id_col)
    kept = each.join(keep, same_key(each, keep)).select(each["doc_id"], each["th"], "n", "row")
    # Only keys that rows repeat are sorted out; all others go by without another shuffle.
    one, more = kept.where("n = 1"), kept.where("n > 1").dropDuplicates(["doc_id", "th"])
    return one.unionByName(more).select("row.*")
