"""Hierarchical language identification with linear support vector machines.

Languages with similar letter statistics form families, found by merging the
nearest centroids.  A text is first given a family, by one-versus-one machines
between families, then a language, by one-versus-one machines inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_fold, map_rows, tune, written

#: Training rows of one language, and of all, at most (lowest hashes of the id first).
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS = 800, 3200
BITS = 12
#: Bits of an id's hash that choose its slice.
SLICE_BITS = 12
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def grams(text: str) -> np.ndarray:
    """Square roots of hashed 2- and 3-byte counts of the whole lower-cased text, of length 1."""
    a = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    two = a[:-1] << np.uint32(8) | a[1:]
    three = two[:-1] << np.uint32(8) | a[2:]
    shift = np.uint32(32 - BITS)
    counts = np.bincount((three * np.uint32(2654435761)) >> shift, minlength=1 << BITS)
    counts = counts + np.bincount(((two + np.uint32(1 << 25)) * np.uint32(2246822519)) >> shift, minlength=1 << BITS)
    x = np.sqrt(counts).astype(np.float32)
    return x / np.sqrt(np.float32((x * x).sum()))


def machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 120) -> tuple[np.ndarray, float]:
    """A linear SVM (squared hinge, classes weighted alike) by accelerated gradient steps; y is +1 or -1."""
    n = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    rate = np.float32(1 / (1e-3 + 2 * c * 2))
    for k in range(steps):
        push = n * y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1]))
        grad = 1e-3 * v - 2 * c * np.append(push @ x, push.sum())
        new = v - rate * grad
        v = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


@dataclass
class Tree:
    families: list[list[str]]
    between: dict[tuple[int, int], tuple[np.ndarray, float]] = field(default_factory=dict)
    within: list[dict[tuple[int, int], tuple[np.ndarray, float]]] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        fam, sure = _vote(x, len(self.families), self.between)
        names, score = [""] * len(x), np.zeros(len(x))
        for f, langs in enumerate(self.families):
            at = np.flatnonzero(fam == f)
            if len(at):
                which, own = _vote(x[at], len(langs), self.within[f])
                score[at] = sure[at] * own
                for k, w in zip(at.tolist(), which.tolist()):
                    names[k] = langs[w]
        return names, score


def _vote(x: np.ndarray, n: int, machines: dict[tuple[int, int], tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """The class with most wins (margins break ties), and its least pairwise confidence."""
    wins, sure = np.zeros((len(x), n)), np.ones((len(x), n))
    for (i, j), (w, b) in machines.items():
        p = 1 / (1 + np.exp(-np.clip(3 * (x @ w + b), -30, 30)))
        wins[:, i] += (p >= 0.5) + 0.01 * p
        wins[:, j] += (p < 0.5) + 0.01 * (1 - p)
        sure[:, i] = np.minimum(sure[:, i], p)
        sure[:, j] = np.minimum(sure[:, j], 1 - p)
    best = wins.argmax(axis=1)
    return best, sure[np.arange(len(x)), best]


def families(names: list[str], centroids: np.ndarray) -> list[list[str]]:
    """Average-linkage groups of centroids, cut where the distance to merge jumps most."""
    groups = [[k] for k in range(len(names))]
    dist = np.sqrt(np.maximum(0, 2 - 2 * (centroids @ centroids.T) / np.outer(*[np.linalg.norm(centroids, axis=1)] * 2)))
    history, heights = [list(groups)], [0.0]
    while len(groups) > 1:
        d, i, j = min((float(dist[np.ix_(a, b)].mean()), i, j) for (i, a), (j, b) in combinations(enumerate(groups), 2))
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
        history.append(list(groups))
        heights.append(d)
    if len(names) < 3:
        cut = 0
    else:
        cut = max(range(1, len(names) - 1), key=lambda k: heights[k + 1] - heights[k])
    return sorted(sorted(names[k] for k in g) for g in history[cut])


def fit(x: np.ndarray, langs: np.ndarray) -> Tree:
    names = sorted(set(langs))
    tree = Tree(families(names, np.stack([x[langs == n].mean(axis=0) for n in names])))
    of = {n: f for f, g in enumerate(tree.families) for n in g}
    fam = np.array([of[n] for n in langs])
    for i, j in combinations(range(len(tree.families)), 2):
        at = (fam == i) | (fam == j)
        tree.between[i, j] = machine(x[at], np.where(fam[at] == i, 1, -1).astype(np.float32))
    for group in tree.families:
        own = {}
        for i, j in combinations(range(len(group)), 2):
            at = (langs == group[i]) | (langs == group[j])
            own[i, j] = machine(x[at], np.where(langs[at] == group[i], 1, -1).astype(np.float32))
        tree.within.append(own)
    return tree


def sample_ids(tagged: DataFrame, per_language: int, rows: int) -> DataFrame:
    """At most ``rows`` ids of ``tagged`` (id, lang): of each language those of least
    hash, ``per_language`` at most.

    Ids are first counted by slices of the hash, so that only those of the least
    slices that hold enough are ranked, however many a language has."""
    sliced = tagged.withColumn("h", F.xxhash64("id")).withColumn("part", F.shiftright("h", 64 - SLICE_BITS))
    # Distinct ids, not rows, as one id may hold many rows; the estimate's error (5 %) is far inside the quarter more.
    counts = sliced.groupBy("lang", "part").agg(F.approx_count_distinct("id").alias("c"))
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # some thousand rows
    few = counts.withColumn("below", F.coalesce(F.sum("c").over(before), F.lit(0))).where(F.col("below") < 1.25 * per_language)
    # A row a language; written, so that Spark knows its size and rows are left out before any shuffle.
    edge = written(few.groupBy("lang").agg(F.max("part").alias("edge")))
    near = sliced.join(edge, "lang").where("part <= edge").select("lang", "h", "id").distinct()
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(F.col("k") <= per_language)
    return ranked.orderBy("k", "lang", "id").limit(rows).select("id", "lang")


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> Tree | None:
    """``docs`` has doc_id, text and lang; the held-out fold is left out.  Of rows that
    repeat an id and language, the text of least hash is learnt from."""
    tagged = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 4, 2)).select(F.col("doc_id").alias("id"), "lang")
    ids = sample_ids(tagged, per_language, rows)  # at most `rows` pairs
    sample = docs.select(F.col("doc_id").alias("id"), "text", "lang").join(F.broadcast(ids), ["id", "lang"])
    sample = sample.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))
    found = map_rows(sample, ["id", "text", "lang"], "id long, lang string, x binary", lambda r: (r[0], r[2], grams(r[1]).astype(np.float16).tobytes()) if has_letter(r[1]) else None)
    # At most `rows` ids, half precision: 8 KB each.
    got = sorted((r["id"], r["lang"], bytes(r["x"])) for r in found.collect())
    if not got:
        return None
    langs = np.array([g[1] for g in got])
    return fit(np.stack([np.frombuffer(g[2], np.float16) for g in got]).astype(np.float32), langs)


def identify(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from its whole text.

    Learns from text and language of ids outside the held-out fold only.  A text
    without a letter (null, empty, signs) is ``und`` with score 0, as is every
    text where no row has a language; with one language, all others get it.
    Repeated rows are predicted alike; an empty table gives no rows; null ids
    are scored but not learnt from; other columns are ignored.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    tree = train(own, per_language, rows)
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            at = [k for k, t in enumerate(texts) if has_letter(t)] if tree else []
            if at:
                got, sure = tree.predict(np.stack([grams(texts[k]) for k in at]))
                score[at] = sure
                for k, name in zip(at, got):
                    names[k] = name
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names), pa.array(score)], schema=kind)

    rows_in = own.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "text")
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
