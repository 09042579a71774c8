"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Base rules fail a text by counts.  The others become vectors of transformed
statistics, and each (language, source) gets a minimum-covariance-determinant
estimate: from three fixed starts, concentration steps take the mean and
covariance of the half of the rows that lie nearest under the estimate before;
after ``SCREEN`` steps the start of least determinant goes on, until its
determinant falls no more.  A text goes if its Mahalanobis distance exceeds the cutoff.

Statistics are fixed-point integers, sums of them are exact, and the nearest rows
are taken by bins of the distance (a 16th of an octave), so a result doesn't depend on
how rows are dealt to tasks, and nothing is sorted or gathered by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, written

#: Fixed point: units of a statistic's natural logarithm.
UNIT = 200
NAMES = ["x0", "x1", "x2", "x3", "x4"]
#: Steps from every start, further steps at most, passing rows that a group needs.
SCREEN, STEPS, LEAST_ROWS = 2, 12, 50
#: Squared distances over this, in units in which their median is that of chi-square, are outliers.
CUTOFF = 120.0
_CHI2_MEDIAN_5 = 4.3515
#: Spread that is added to each statistic, in units.
FLOOR = 12.0
_BINS = 16
_SPACE = r"[\x20\x09-\x0D]+"


def _count(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def base(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source", window: int = 8) -> DataFrame:
    """Counts of every text, the base verdict and the transformed statistics."""
    t = F.col("t")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("\x00")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("source"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("w", F.array_remove(F.split(t, _SPACE), ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.withColumn("ln", lines).withColumn("n", F.size("w"))
    grams = F.when(F.col("n") > window, F.transform(F.sequence(F.lit(0), F.col("n") - window), lambda i: F.xxhash64(*(F.get(F.col("w"), i + k) for k in range(window)))))
    rows = rows.withColumn("g", grams)
    rows = rows.withColumn("again", F.col("g").isNotNull() & (F.size(F.array_distinct("g")) < F.size("g")))
    # Places of windows found twice, in texts that have any: sort by window, look at both neighbours.
    sorted_ = F.when(F.col("again"), F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("sg", sorted_)
    at = lambda k: F.get(F.col("sg"), k)["h"]
    twice = F.filter("sg", lambda s, k: (s["h"].eqNullSafe(at(k - 1))) | (s["h"].eqNullSafe(at(k + 1))))
    places = F.array_sort(F.transform(twice, lambda s: s["i"]))
    covered = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + window - F.greatest(a["end"], i)).alias("n"), (i + window).alias("end")), lambda a: a["n"])
    rows = rows.select(
        "doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _count(t, "#*$%&|<>").cast("long").alias("n_symbols"), (F.size("ln") - F.size(F.array_distinct("ln"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        _count(t, "!?").alias("calls"), _count(t, "A-Z").alias("upper"), _count(t, ".,;:").alias("marks"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    per = lambda c: F.log(1.0 + 100.0 * F.col(c) / F.greatest(F.col("word_chars"), F.lit(1)))
    vector = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), per("n_symbols"), per("calls"), per("upper"), per("marks")]
    return rows.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(F.round(v * UNIT).cast("long").alias(n) for n, v in zip(NAMES, vector)))


def _grouped(rows: DataFrame) -> DataFrame:
    """``grp`` of each row: its language and source, or its language, or all, whichever has enough rows."""
    good = rows.where("NOT base_failed")
    pair = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    lang = pair.groupBy("lang").agg(F.sum("n").alias("m"))
    known = rows.select("lang", "source").distinct().join(pair, ["lang", "source"], "left").join(lang, "lang", "left")
    own = F.when(F.col("n") >= LEAST_ROWS, F.concat(F.lit("s\x01"), "lang", F.lit("\x01"), "source")).when(F.col("m") >= LEAST_ROWS, F.concat(F.lit("l\x01"), "lang")).otherwise("all")
    return known.select("lang", "source", own.alias("grp"))


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + 1e-6) * _BINS).cast("int")


def _quantile(rows: DataFrame, d2: Column, rank: Column, name: str) -> DataFrame:
    """The least bin of d2 that has ``rank`` (of n) of an estimate's rows at or below it."""
    counts = rows.select("grp", "start", _bin(d2).alias("bin")).groupBy("grp", "start", "bin").agg(F.count("*").alias("c"))
    # Some hundred rows an estimate.
    own = Window.partitionBy("grp", "start")
    sums = counts.withColumn("up", F.sum("c").over(own.orderBy("bin"))).withColumn("n", F.sum("c").over(own))
    return sums.where(F.col("up") >= rank).groupBy("grp", "start").agg(F.min("bin").alias(name))


def distance(p: str = "") -> Column:
    """Squared Mahalanobis distance by the inverse Cholesky factor in columns m*, v*_*."""
    d = len(NAMES)
    parts = [sum((F.col(f"v{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(d)]
    return sum((q * q for q in parts), F.lit(0.0))


def _factors(sums: DataFrame) -> DataFrame:
    """Mean, and the inverse Cholesky factor of the covariance, from exact sums."""
    d = len(NAMES)
    n = F.col("n").cast("double")
    out = sums.select("grp", "start", *((F.col(f"s{i}") / n).alias(f"m{i}") for i in range(d)), *((F.col(f"q{i}_{j}") / n - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n) + (FLOOR**2 if i == j else 0.0)).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)))
    for j in range(d):  # a column of the factor at a time
        rest = lambda i, j: F.col(f"c{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}_{j}", F.sqrt(F.greatest(rest(j, j), F.lit(1.0))))
        out = out.withColumns({f"l{i}_{j}": rest(i, j) / F.col(f"l{j}_{j}") for i in range(j + 1, d)}) if j + 1 < d else out
    for i in range(d):  # a row of the inverse at a time
        out = out.withColumns({f"v{i}_{j}": (F.lit(1.0) if i == j else -sum((F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)), F.lit(0.0))) / F.col(f"l{i}_{i}") for j in range(i + 1)})
    return out.select("grp", "start", *(f"m{i}" for i in range(d)), *(f"v{i}_{j}" for i in range(d) for j in range(i + 1)))


def _sums(rows: DataFrame) -> DataFrame:
    d = len(NAMES)
    return rows.groupBy("grp", "start").agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(NAMES)), *(F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)))


def _starts(good: DataFrame) -> DataFrame:
    """Medians with each statistic's quartile range, medians with one spread for all,
    and the mean and covariance of all rows."""
    d = len(NAMES)
    part = written(good.groupBy("grp").agg(*(F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, x in enumerate(NAMES))))
    ranges = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(FLOOR)) for i in range(d)]

    def plain(start: int, spread: list[Column]) -> DataFrame:
        inverse = (F.lit(1.0) / spread[i] if i == j else F.lit(0.0) for i in range(d) for j in range(i + 1))
        names = (f"v{i}_{j}" for i in range(d) for j in range(i + 1))
        return part.select("grp", F.lit(start).alias("start"), *(F.col(f"p{i}")[1].alias(f"m{i}") for i in range(d)), *(v.alias(n) for v, n in zip(inverse, names)))

    every = _factors(written(_sums(good.withColumn("start", F.lit(2)))))
    return plain(0, ranges).unionByName(plain(1, [F.lit(FLOOR)] * d)).unionByName(every)


def _step(good: DataFrame, now: DataFrame) -> DataFrame:
    """Estimates from the half of the rows (n + d + 1 of 2 n) that lie nearest under those of ``now``."""
    apart = good.join(now, "grp")
    # A row an estimate; written, so that Spark knows its size and rows of large groups stay where they are.
    half = F.least(F.col("n"), F.floor((F.col("n") + len(NAMES) + 1) / 2))
    edge = written(_quantile(apart, distance(), half, "edge"))
    sums = written(_sums(apart.join(edge, ["grp", "start"]).where(_bin(distance()) <= F.col("edge"))))
    return written(_factors(sums))


def _least(found: DataFrame, first: str) -> DataFrame:
    """The estimate of least determinant of each group, of equal ones that of least ``first``."""
    determinant = sum((-2 * F.log(F.col(f"v{i}_{i}")) for i in range(len(NAMES))), F.lit(0.0))
    whole = F.min_by(F.struct(*(c for c in found.columns if c != "grp")), F.struct(determinant, F.col(first)))
    return written(found.groupBy("grp").agg(whole.alias("k")).select("grp", "k.*"))


def estimates(good: DataFrame) -> DataFrame:
    """The estimate of each ``grp``: mean, inverse factor, and the scale of squared distances."""
    spark = good.sparkSession
    now = written(_starts(good))
    for _ in range(SCREEN):
        now = _step(good, now)
    now = _least(now, "start")
    for _ in range(STEPS):
        both = now.withColumn("turn", F.lit(0)).unionByName(_step(good, now).withColumn("turn", F.lit(1)))
        new = _least(both, "turn")
        settled = new.where("turn = 1").isEmpty()
        drop(spark, now)
        now = new.drop("turn")
        if settled:
            break
    middle = _quantile(good.join(now, "grp"), distance(), F.col("n") * 0.5, "mid").drop("start")
    return now.drop("start").join(middle, "grp").withColumn("scale", F.pow(F.lit(2.0), (F.col("mid") + 1) / _BINS) / _CHI2_MEDIAN_5)


def verdicts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and ``outlyingness`` of every row.

    A null or empty text has no words and fails; a null language or source is a
    value of its own; groups of fewer than LEAST_ROWS passing rows are judged
    with their language, or with all.  Repeated rows count as often as they
    occur and are judged alike; an empty table gives no rows; other columns are
    ignored.  outlyingness is the squared distance in chi-square units, null
    where the base rules fail.
    """
    rows = written(base(docs, text, id_col, lang, source))
    groups = written(_grouped(rows))
    good = written(rows.where("NOT base_failed").join(groups, ["lang", "source"]).select("grp", *NAMES))
    found = written(estimates(good))
    judged = rows.join(written(groups.join(found, "grp")), ["lang", "source"], "left")
    out = F.when(~F.col("base_failed"), distance() / F.greatest(F.col("scale"), F.lit(1.0)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(out <= cutoff, F.lit(True))).alias("kept"), out.alias("outlyingness"))
