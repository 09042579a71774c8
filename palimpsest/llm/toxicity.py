"""Toxicity by weak supervision.

A lexicon of words and of word beginnings is read off a bounded sample of labelled
rows; that, and which way a voter points, is all that labels are used for.  The
lexicon is dealt in turn to voters of four kinds (words, beginnings, beginnings
that recur, beginnings that are dense), so that each holds entries of every
language.  A voter says "toxic" of a text with one of its entries, else "clean".

A generative label model is estimated from how votes agree, without labels: with
a hidden class, the covariance of two voters that are independent given the class
is a product of two numbers, one each, which triplets of voters give in closed
form; third moments give the share of the class; and what the covariances have
beyond that are the voters' own correlations, by which their weights shrink.  A
linear classifier is trained on the posterior labels, over the lexicon's entries.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, in_fold, map_rows, tune, written
from .quality import labelled_sample

#: Labelled rows to learn from (lowest hashes of the id first), and entries of the lexicon, at most.
SAMPLE_ROWS, ENTRIES = 9000, 600
#: Voters of each kind: words, beginnings, recurring ones, dense ones.
VOTERS = {"": 8, "*": 4, "2": 4, "%": 4}
#: Times (as a logarithm) that an entry is commoner in toxic texts, and the least statistic of it.
LEAST_LIFT, LEAST_GAIN = 2.5, 3.5
#: Residual correlations over this count as dependence.
DEPENDENT = 0.1
#: Lengths of word beginnings that patterns look at.
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
_HELD = 300_000


def signs(word: str) -> tuple[str, ...]:
    """A word's lexicon entry and patterns."""
    return (word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k))


def words_of(text: str | None) -> Counter:
    return Counter(_WORD.findall((text or "").lower()))


def signs_of(words: Counter) -> set[str]:
    """Signs of a text: those of its words, and beginnings that recur or are dense in it."""
    n = sum(words.values())
    found: set[str] = set(words)
    for k in PREFIXES:
        of: Counter = Counter()
        for w, c in words.items():
            if len(w) > k:
                of[w[:k]] += c
        for p, c in of.items():
            found.add(f"{p}*")
            if c > 1:
                found.add(f"{p}*2")
            if 100 * c >= n:
                found.add(f"{p}*%")
    return found


def counted(sample: DataFrame) -> DataFrame:
    """``sign, toxic, other``: in how many of the sample's texts of either label a sign occurs."""
    kind = pa.schema([("sign", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()

        def out():
            keys = list({**held[0], **held[1]})
            for k in range(0, len(keys), 20_000):
                part = keys[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([held[1][x] for x in part]), pa.array([held[0][x] for x in part])], schema=kind)
            for h in held:
                h.clear()

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                held[y].update(signs_of(words_of(text)))
                if len(held[0]) + len(held[1]) > _HELD:
                    yield from out()
        yield from out()

    rows = sample.select("text", "y").mapInArrow(run, "sign string, toxic long, other long")
    return rows.groupBy("sign").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def lexicon(counts: DataFrame, n_toxic: int, n_other: int, most: int = ENTRIES) -> list[str]:
    """The signs that speak most for toxicity, by a signed likelihood-ratio statistic."""
    a, b = F.col("toxic") + 0.5, F.col("other") + 0.5
    lift = F.log((a / F.lit(n_toxic + 1.0)) / (b / F.lit(n_other + 1.0)))
    gain = F.round(F.col("toxic") * lift, 6)
    told = counts.where((F.col("toxic") >= 2) & (lift > LEAST_LIFT)).select("sign", gain.alias("gain")).where(F.col("gain") > LEAST_GAIN)
    return [r["sign"] for r in told.orderBy(F.desc("gain"), "sign").limit(most).collect()]  # at most `most`


def kind_of(sign: str) -> str:
    return sign[-1] if sign[-1] in "*2%" else ""


def dealt(entries: list[str]) -> list[int]:
    """The voter of each entry: those of a kind get them in turn."""
    seen: Counter = Counter()
    places = []
    for e in entries:
        k = kind_of(e)
        places.append((k, seen[k] % VOTERS[k]))
        seen[k] += 1
    number = {place: n for n, place in enumerate(sorted(set(places)))}
    return [number[place] for place in places]


@dataclass
class LabelModel:
    """``prior``: share of toxic texts; ``hi``, ``lo``: how often each voter says
    toxic in toxic and in other texts; ``rho``: correlations of voters given the class."""

    prior: float
    hi: np.ndarray
    lo: np.ndarray
    rho: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """Voters that vote together beyond what the class explains share their weight."""
        return 1 / (1 + np.where(self.rho > DEPENDENT, self.rho, 0).sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        yes, no, w = np.log(self.hi / self.lo), np.log((1 - self.hi) / (1 - self.lo)), self.weights
        z = votes @ (w * yes) + (1 - votes) @ (w * no) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loadings(cov: np.ndarray, free: np.ndarray) -> np.ndarray:
    """u with cov[i, j] = u[i] u[j] for the pairs in ``free``: a median over triplets of voters."""
    n = len(cov)
    c = np.where(free & (cov > 1e-9), cov, np.nan)
    upper = np.triu_indices(n, 1)
    out = np.zeros(n)
    for i in range(n):
        each = (c[i][:, None] * c[i][None, :] / c)[upper]
        each = each[np.isfinite(each)]
        out[i] = np.sqrt(np.median(each)) if len(each) else 0.0
    return out


def label_model(votes: np.ndarray, rounds: int = 4) -> LabelModel:
    """The model of texts' 0/1 votes, from second and third moments alone.

    Voters are taken to be right more often than not.  Voters that fewer than two
    others agree with tell nothing; if none is left, the prior is their mean vote."""
    n = votes.shape[1]
    mean = votes.mean(axis=0)
    x = votes - mean
    cov = x.T @ x / len(votes)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    apart = ~np.eye(n, dtype=bool)
    free, u, rho = apart, np.zeros(n), np.zeros((n, n))
    for _ in range(rounds):  # pairs that turn out to depend leave the triplets
        u = _loadings(cov, free)
        rho = np.where(apart, (cov - np.outer(u, u)) / np.outer(scale, scale), 0)
        free = apart & (np.abs(rho) < 1.5 * DEPENDENT)
    best = [int(i) for i in np.argsort(-u, kind="stable")[:12] if u[i] > 0]
    triples = [(i, j, k) for i, j, k in combinations(best, 3) if free[i, j] and free[i, k] and free[j, k]]
    if triples:
        skew = float(np.median([(x[:, i] * x[:, j] * x[:, k]).mean() / (u[i] * u[j] * u[k]) for i, j, k in triples]))
        prior = (1 - skew / np.sqrt(4 + skew * skew)) / 2
    else:
        prior = float(mean.mean()) if n else 0.5
    prior = min(max(prior, 0.01), 0.5)
    gap = u / np.sqrt(prior * (1 - prior))
    lo = np.clip(mean - prior * gap, 1e-3, 1 - 1e-3)
    return LabelModel(prior, np.maximum(np.clip(mean + (1 - prior) * gap, 1e-3, 1 - 1e-3), lo), lo, rho)


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self._of: dict[str, tuple[list[int], list[str]]] = {}

    def votes(self, text: str | None) -> set[int]:
        found: set[int] = set()
        often: Counter = Counter()
        of, index = self._of, self.index
        if len(of) > 500_000:
            of.clear()
        words = words_of(text)
        for w, c in words.items():
            hit = of.get(w)
            if hit is None:
                word, *starts = signs(w)
                own = [index[s] for s in (word, *starts) if s in index]
                counted = [s for s in starts if f"{s}2" in index or f"{s}%" in index]
                hit = of[w] = (own, counted)
            if hit[0]:
                found.update(hit[0])
            for s in hit[1]:
                often[s] += c
        if often:
            n = sum(words.values())
            for s, c in often.items():
                if c > 1 and f"{s}2" in index:
                    found.add(index[f"{s}2"])
                if 100 * c >= n and f"{s}%" in index:
                    found.add(index[f"{s}%"])
        return found

    def row(self, text: str | None) -> np.ndarray:
        return signals(self.votes(text), len(self.index))

    def score(self, text: str | None) -> float:
        z = float(self.row(text) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def signals(votes: set[int], n: int) -> np.ndarray:
    """The classifier's input: which entries were found, and how many."""
    x = np.zeros(n + 2, dtype=np.float32)
    if votes:
        x[list(votes)] = 1
        x[n], x[n + 1] = 1, np.log1p(len(votes))
    return x


def logistic(x: np.ndarray, q: np.ndarray, ridge: float = 0.3, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Weights and bias for soft labels ``q``, by Newton steps with a ridge."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(a.shape[1])
    pen = np.full(a.shape[1], ridge)
    pen[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w.astype(a.dtype), -30, 30)))
        grad = a.T @ (p - q).astype(a.dtype) + pen * w
        hess = (a * np.maximum(p * (1 - p), 1e-4).astype(a.dtype)[:, None]).T @ a + np.diag(pen)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def sampled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = ENTRIES) -> tuple[Model | float, list[tuple[int, int, list[int]]]]:
    """A model with the lexicon and no weights yet (or a constant score where labels
    or entries are missing), and ``(id, label, entries found)`` of the sample."""
    sample = written(labelled_sample(docs, labels, "toxic", ~in_fold("id", 5, 0), rows))
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    a, b = size.get(1, 0), size.get(0, 0)
    if not a or not b:
        return (1.0 if a else 0.0), []
    chosen = lexicon(counted(sample), a, b, most)
    if not chosen:
        return a / (a + b), []
    model = Model({s: k for k, s in enumerate(chosen)}, np.zeros(len(chosen) + 2), 0.0)
    # At most `rows` rows, a number for each entry found.
    found = map_rows(sample, ["id", "text", "y"], "id long, y int, on array<int>", lambda r: (r[0], r[2], sorted(model.votes(r[1])))).collect()
    drop(docs.sparkSession, sample)
    return model, sorted((r["id"], r["y"], list(r["on"])) for r in found)


def ballots(model: Model, found: list[tuple[int, int, list[int]]]) -> np.ndarray:
    """What each voter says of each text."""
    voter = np.array(dealt(list(model.index)))
    votes = np.zeros((len(found), int(voter.max()) + 1), dtype=np.float32)
    for k, (_, _, on) in enumerate(found):
        votes[k, voter[on]] = 1
    return votes


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = ENTRIES) -> Model | float:
    """A model, or a constant score where labels or lexicon entries are missing."""
    model, found = sampled(docs, labels, rows, most)
    if isinstance(model, float):
        return model
    votes = ballots(model, found)
    x = np.stack([signals(set(on), len(model.index)) for _, _, on in found])
    model.weights, model.bias = logistic(x, label_model(votes).posterior(votes))
    return model


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text.

    Learns from ids outside the held-out fold (crc32 of the id modulo 5 is 0);
    null labels and ids are passed over, and of rows that repeat an id one is learnt
    from.  A text without words (null, empty) has no entries and gets the classifier's base score; repeated rows score alike; an
    empty table gives no rows; without labels of both classes the score is 0, or
    1 if all are toxic.  Other columns are ignored.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = train(own, labels)
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.array([model if isinstance(model, float) else model.score(t) for t in batch.column("text").to_pylist()], dtype=float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=kind)

    return own.select("doc_id", in_fold("doc_id", 5, 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
