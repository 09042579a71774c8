"""Document quality by regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics; each class gets a mean and a
shrunken covariance from a bounded sample of labelled rows; a score is the
difference of two Mahalanobis log densities, computed with Cholesky factors that
are made once, put through a logistic calibration.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_fold, map_rows, tune

#: Labelled rows that a model is fitted on, at most (lowest hashes of the id first).
SAMPLE_ROWS = 20_000
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_MARKS = re.compile(r"[.,;:!?]")


def _logit(p: float, n: float) -> float:
    """Log odds of a proportion of n things, half a thing added to either side."""
    k = p * n
    return float(np.log((k + 0.5) / (n - k + 0.5)))


def statistics(text: str | None) -> list[float] | None:
    """The transformed statistics of one whole text; None for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return None
    data = text.encode()
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars = len(text)
    upper = int(hist[65:91].sum())
    letters = upper + int(hist[97:123].sum()) + int(hist[0xC2:0xF5].sum())
    digits = int(hist[48:58].sum())
    symbols = int(hist[_SYMBOLS].sum())
    calls = int(hist[33] + hist[63])
    commas = int(hist[44])
    stops = int(hist[46])
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = max(counts.values())
    pairs = sum(map(eq, words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    repeated_lines = len(lines) - len(set(lines))
    solid = chars - int(hist[32] + hist[10])
    packed = len(zlib.compress(data, 1))
    return [
        float(np.log(lengths.mean())),
        float(np.log1p(lengths.std())),
        float(np.log1p(lengths.max())),
        _logit(letters / max(solid, letters, 1), solid + letters),
        _logit(upper / max(letters, 1), letters),
        _logit(digits / max(solid, 1), solid),
        _logit(symbols / max(solid, 1), solid),
        _logit(calls / max(solid, 1), solid),
        float(np.log((commas + 1) / (n + 10))),
        float(np.log((stops + 1) / (n + 10))),
        _logit(len(counts) / n, n) - 0.5 * float(np.log(n)),
        _logit(top / n, n),
        _logit(pairs / n, n),
        _logit(repeated_lines / max(len(lines), 1), len(lines)),
        float(np.log(len(lines) / n)),
        float(np.log(packed / (len(data) + 20))) + 0.1 * float(np.log(len(data))),
        float(np.log(n)),
    ]


@dataclass
class Quadratic:
    """Two Gaussian classes: means, inverse Cholesky factors and constants."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    slope: float
    intercept: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -12, 12)
        parts = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return parts[1] - parts[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _squash(self.raw(x)) + self.intercept, -30, 30)))


def _squash(d: np.ndarray) -> np.ndarray:
    """Tails of a log density difference carry no more evidence as they grow."""
    return np.sign(d) * np.log1p(np.abs(d))


def _gaussians(z: np.ndarray, y: np.ndarray, mix: float, ridge: float):
    pooled = sum(np.cov(z[y == c], rowvar=False, bias=True) * (y == c).sum() for c in (0, 1)) / len(y)
    means, factors, offsets = [], [], []
    for c in (0, 1):
        own = z[y == c]
        cov = (1 - mix) * np.cov(own, rowvar=False, bias=True) + mix * pooled
        cov = (1 - ridge) * cov + ridge * np.trace(cov) / len(cov) * np.eye(len(cov)) + 1e-4 * np.eye(len(cov))
        low = np.linalg.cholesky(cov)
        means.append(own.mean(axis=0))
        factors.append(np.linalg.inv(low))
        offsets.append(-float(np.log(np.diag(low)).sum()))
    return means, factors, offsets


def _calibrate(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and intercept by Newton steps."""
    x = np.stack([d, np.ones_like(d)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(x: np.ndarray, y: np.ndarray) -> Quadratic:
    """Shrinkage by log loss on every fourth row, then a fit of all rows."""
    centre = np.median(x, axis=0)
    scale = np.maximum(x.std(axis=0), 1e-3)
    z = np.clip((x - centre) / scale, -12, 12)
    test = np.arange(len(y)) % 4 == 3
    if min((y[~test] == c).sum() for c in (0, 1)) < 2 or len(set(y[test])) < 2:
        test = np.zeros(len(y), dtype=bool)
    best: tuple[float, tuple] | None = None
    for mix in (0.0, 0.1, 0.3, 0.6):
        for ridge in (0.0, 0.02, 0.1):
            model = Quadratic(centre, scale, *_gaussians(z[~test], y[~test], mix, ridge), 1.0, 0.0)
            rows = test if test.any() else ~test
            d = _squash(model.raw(x[rows]))
            a, b = _calibrate(d, y[rows])
            p = np.clip(1 / (1 + np.exp(-np.clip(a * d + b, -30, 30))), 1e-6, 1 - 1e-6)
            loss = -float((y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p)).mean())
            if best is None or loss < best[0] - 1e-9:
                best = loss, (mix, ridge, a, b)
    assert best
    mix, ridge, a, b = best[1]
    return Quadratic(centre, scale, *_gaussians(z, y, mix, ridge), a, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, text, y`` of at most ``rows`` labelled ids with ``learn(id)`` true, lowest
    hash first; of rows that repeat an id, the text of the least hash."""
    ids = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    ids = ids.groupBy("id").agg(F.max("y").alias("y")).where(learn).orderBy(F.xxhash64("id"), "id").limit(rows)
    # at most `rows` pairs of numbers
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(ids), "id")
    return found.groupBy("id", "y").agg(F.min_by("text", F.xxhash64(F.coalesce("text", F.lit("")))).alias("text"))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, learn: Column | None = None) -> Quadratic | float:
    """A model, or a constant score where the labels have one class only."""
    learn = ~in_fold("id", 4, 2) if learn is None else learn
    sample = labelled_sample(docs, labels, "quality", learn, rows)
    found = map_rows(sample, ["id", "text", "y"], "id long, y int, x array<double>", lambda r: (r[0], r[2], x) if (x := statistics(r[1])) else None).toPandas()
    if not len(found):
        return 0.5
    found = found.sort_values("id", kind="stable")
    y = found["y"].to_numpy()
    if min((y == c).sum() for c in (0, 1)) < 2:
        return float(y.mean())
    return fit(np.array(found["x"].tolist()), y)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, scored over its whole text.

    Learns from ids outside the held-out fold (crc32 of the id modulo 4 is 2)
    only; null labels and ids are passed over.  A text without words (null,
    empty, white space) scores 0.  Repeated rows score alike, an empty table
    gives no rows, and without labels of both classes every text with words
    gets their mean (0.5 without any).  Other columns are ignored.
    """
    tune(docs.sparkSession)
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), labels, rows)
    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(in_fold(id_col, 4, 2), F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    return score_rows(rows_in, model, threshold)


def score_rows(rows: DataFrame, model: Quadratic | float, threshold: float) -> DataFrame:
    import pyarrow as pa

    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            at = [k for k, v in enumerate(x) if v is not None]
            score = np.zeros(len(x))
            if at:
                score[at] = model if isinstance(model, float) else model.score(np.array([x[k] for k in at]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], schema=kind)

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def score_of(text: Column, model: Quadratic | float) -> Column:
    """The score of a text column, for filters."""

    @F.pandas_udf("double")
    def score(t: pd.Series) -> pd.Series:
        x = [statistics(v) for v in t]
        out = np.zeros(len(x))
        at = [k for k, v in enumerate(x) if v is not None]
        if at:
            out[at] = model if isinstance(model, float) else model.score(np.array([x[k] for k in at]))
        return pd.Series(out)

    return score(text.cast("string"))
