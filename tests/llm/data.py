"""Small fixtures with every awkward case: nulls, empty and long texts, ties,
repeated rows, ids that repeat with another text, columns with clashing names."""

import random

WORDS = "the of and data corpus stream window token shard bucket lemma glyph prose quartz umbra velvet".split()


def prose(r, n):
    out = []
    for k in range(n):
        w = r.choice(WORDS) + r.choice(("", "s", "ing", "ed", "é"))
        out.append(w + ("." if r.random() < 0.15 else ""))
    return " ".join(out)


def documents(seed=0, n=40):
    r = random.Random(seed)
    shared = [prose(r, k) for k in (30, 60, 90)]
    rows = []
    for i in range(n):
        parts = [prose(r, r.randint(1, 80)) for _ in range(r.randint(1, 3))]
        if r.random() < 0.5:
            parts.insert(r.randrange(len(parts) + 1), r.choice(shared))
        rows.append((i, r.choice((" ", "\n")).join(parts), r.choice(("en", "de", None)), r.choice(("a", "b", None))))
    rows += [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, " \n ", "en", "a"), (None, rows[0][1], "en", "a"), (None, None, None, None), (3, rows[3][1], "en", "a"), (3, rows[4][1], "en", "a"), (n + 3, prose(r, 4000), "en", "b"), (n + 4, rows[5][1] + " end", "de", "a"), (n + 5, "x" * 900, "en", "a"), (n + 6, "?! .", "en", "a"), (n + 7, "Äß 漢字 😀 " * 60, "de", "b")]
    return rows


def frame(spark, rows=None, empty=False):
    """documents with extra columns named like inner ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([] if empty else (documents() if rows is None else rows), "doc_id long, text string, lang string, source string")
    clash = ("th", "fp", "score", "words", "w", "n", "grp", "class", "at", "key", "x0", "id", "y", "packed", "kept", "run", "root")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(f"own {c}") for c in clash})
