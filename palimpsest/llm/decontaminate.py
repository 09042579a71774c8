"""Benchmark passages in documents: a prefix-filtered set join, in DataFrame functions only.

Every benchmark item is a set of windows of consecutive words.  A window occurs
where all its word shingles do, so a prefix of one shingle is enough to find it,
and the rarest of the corpus makes the fewest candidates: shingles of windows are
counted over all documents, windows with a shingle that no document has are
settled at once, and each other window is joined by its rarest.  The shingle's
place gives the window's only possible start, which must leave it inside the
document (position and length bounds); then the words themselves are compared.

Texts are shingled once: places of shingles that any window has are written, as
numbers alone, and words are looked at again only in documents with a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, same_key, written

WINDOW, SHINGLE = 13, 5
#: Rows of a table (about 150 bytes each) that may be broadcast; beyond, joins shuffle numbers.
BROADCAST_WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits, A-Z in lower case, and of anything beyond ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _shingle(w: str, at: str, s: int) -> Column:
    return F.xxhash64(*(F.expr(f"get({w}, {at} + {k})") for k in range(s)))


def windows_of(bench: DataFrame, window: int, text: str, id_col: str) -> DataFrame:
    """``item, win, len``: the distinct windows of each item."""
    rows = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))))
    return rows.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.least(F.size("w"), F.lit(window))), " ").alias("win"), F.least(F.size("w"), F.lit(window)).alias("len")).distinct()


def _positions(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """One row for each word position and shingle size: ``p, h`` beside the document's words."""
    out = docs.where(F.size("w") >= min(sizes)).withColumn("p", F.explode(F.sequence(F.lit(0), F.size("w") - min(sizes))))
    if len(sizes) == 1:
        return out.withColumn("h", _shingle("w", "p", sizes[0]))
    # Shorter items only: one more hash per size.
    return out.withColumn("h", F.explode(F.array(*(F.when(F.col("p") + s <= F.size("w"), _shingle("w", "p", s)) for s in sizes)))).where("h IS NOT NULL")


def _small(df: DataFrame, most: int) -> DataFrame:
    """A written table, to be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def occurrences(docs: DataFrame, windows: DataFrame, shingle: int, broadcast_windows: int) -> DataFrame:
    """``doc_id, th, at, len, win``: where windows occur in documents.

    ``docs`` has doc_id, th and w (words); ``windows`` has win and len, distinct."""
    spark = docs.sparkSession
    sized = windows.withColumn("ww", F.split("win", " ")).withColumn("s", F.least("len", F.lit(shingle)))
    sizes = [r["s"] for r in sized.select("s").distinct().orderBy("s").collect()] or [shingle]  # at most `shingle` numbers
    grams = sized.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("s"))))
    hashed = F.coalesce(*(F.when(F.col("s") == s, _shingle("ww", "j", s)) for s in sizes))
    grams = written(grams.select("win", "len", "j", hashed.alias("h")))
    keys = written(grams.select("h").distinct())
    places = _positions(docs, sizes).select("doc_id", "th", "p", F.size("w").alias("n"), "h")
    places = written(places.join(_small(keys, 16 * broadcast_windows), "h", "left_semi"))
    counts = written(places.groupBy("h").agg(F.count("*").alias("c")))
    rare = grams.join(counts, "h", "left").groupBy("win", "len").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "h", "j")).alias("r"))
    prefix = written(rare.where("r.c > 0").select("win", "len", F.col("r.h").alias("h"), F.col("r.j").alias("j")))
    inside = (F.col("p") >= F.col("j")) & (F.col("p") - F.col("j") + F.col("len") <= F.col("n"))
    found = written(places.join(_small(prefix, broadcast_windows), "h").where(inside).select("doc_id", "th", (F.col("p") - F.col("j")).alias("at"), "len", "win").distinct())
    drop(spark, grams, keys, places, counts)
    near = _small(found, broadcast_windows)
    same = F.array_join(F.slice("w", F.col("at") + 1, F.col("len")), " ") == F.col("win")
    return docs.join(near, same_key(docs, near)).where(same).select(docs["doc_id"], docs["th"], "at", "len", "win")


def _hits(docs: DataFrame, bench: DataFrame, window: int, shingle: int, text: str, id_col: str, item_text: str, item_id: str, broadcast_windows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Keys and words of the documents, windows of the items, and where they occur."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("th"), words(F.col(text)).alias("w"))
    items = written(windows_of(bench, window, item_text, item_id))
    return base, items, written(occurrences(base, items.select("win", "len").distinct(), shingle, broadcast_windows).distinct())


def _spans() -> Column:
    return F.array_sort(F.collect_set(F.struct("at", F.col("len").alias("n"))))


def _n_covered(spans: Column) -> Column:
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["at"] + s["n"] - F.greatest(a["end"], s["at"]))).alias("n"), F.greatest(a["end"], s["at"] + s["n"]).alias("end")),
        lambda a: a["n"],
    )
    return covered.cast("long")


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``doc_id, th, n_words, n_hit, items`` of every row; th is a hash of the text,
    items are sorted strings.

    A null or empty text has no words and no hits; an item of fewer words than a
    window is one window, and one of none never occurs; a null item id marks
    words but isn't listed; items that share an id are one item.  Repeated rows
    and ids get a row each; empty tables give no rows or no hits; other columns
    are ignored.
    """
    if not 0 < shingle <= window <= WINDOW:
        raise ValueError(f"need 0 < shingle <= window <= {WINDOW}")
    base, items, hits = _hits(docs, bench, window, shingle, text, id_col, item_text, item_id, broadcast_windows)
    hit = hits.groupBy("doc_id", "th").agg(_n_covered(_spans()).alias("n_hit"))
    named = hits.select("doc_id", "th", "win").distinct().join(items.select("item", "win"), "win").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))
    each = hit.join(named, same_key(hit, named)).select(hit["doc_id"], hit["th"], "n_hit", "items")
    rows = base.select("doc_id", "th", F.size("w").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return rows.join(each, same_key(rows, each), "left").select(rows["doc_id"], rows["th"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def contaminated() -> Column:
    """A twentieth of the words, and one at least, are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def hit_rows(docs: DataFrame, bench: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, th`` of the distinct rows in which any window occurs."""
    return _hits(docs, bench, WINDOW, SHINGLE, text, id_col, "text", "item_id", BROADCAST_WINDOWS)[2].select("doc_id", "th").distinct()
