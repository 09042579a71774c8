"""A training-data pipeline over ``documents``: quality, near duplicates, repeated
strings, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of documents, whatever others there are and
whatever their names.  Rows keep their nulls; an empty table goes through empty;
texts without words (null, empty) are rejected by the classifier; rows that repeat
id and text are one document from the second stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, near_copies, packing, quality, simhash, suffix_dedup
from palimpsest.llm.common import same_key, table, tune, whole_rows, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects (score under 0.7)."""
    model = quality.train(docs, table(tune(spark), sf_dir, "labels"))
    return docs.where(quality.score_of(F.col("text"), model) >= 0.7)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: links are similarities of
    0.8 or more between sets of five-word shingles."""
    return simhash.first_of_each(docs, near_copies.grouped(docs))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes that also occur elsewhere."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    kept = suffix_dedup.remove_repeats(docs, carry=others)
    text = kept.select("carry.*", suffix_dedup.text_of(F.col("kept")).alias("text"))
    return text.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else c for c in docs.columns))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of 13 words of any benchmark item occurs
    (of an item that is shorter: all of it)."""
    # Written, so that the join knows its size.
    hit = written(decontaminate.hit_rows(docs, table(spark, sf_dir, "benchmark")))
    rows = whole_rows(docs)
    return rows.join(hit, same_key(rows, hit), "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: Classifier, fingerprints and tokenizer have no form in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
