"""The registered queries of the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, packing, quality, rules, sentences, simhash, suffix_dedup, token_files, toxicity
from .common import table, tune


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(tune(spark), table(spark, sf_dir, "documents"), end=1)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), size=200))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(table(spark, sf_dir, "documents")).drop("outlyingness")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentences.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), end=2, capacity=4096)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(tune(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1,
    "op2_quality_classifier": op2,
    "op3_token_files": op3,
    "op4_suffix_array_dedup": op4,
    "op5_quality_rules": op5,
    "op6_sentence_span_dedup": op6,
    "op7_toxicity": op7,
    "op8_harmonic_packing": op8,
    "op9_benchmark_decontamination": op9,
    "op10_language_id": op10,
}

_OP6_SQL = r"""
WITH pieces AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+')) AS piece,
         generate_subscripts(regexp_extract_all(text, '[^.!?\n]*[.!?\n]+|[^.!?\n]+'), 1) AS ord
  FROM documents),
marked AS (
  SELECT *, NOT regexp_full_match(piece, '[.!? \t\n\r\x0b\x0c]*') AS real_one, trim(piece, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM pieces),
numbered AS (
  SELECT doc_id, ord, k, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn
  FROM marked WHERE real_one),
runs AS (
  SELECT doc_id, rn, k || chr(10) || lead(k) OVER d AS run
  FROM numbered WINDOW d AS (PARTITION BY doc_id ORDER BY rn)),
placed AS (
  SELECT doc_id, rn, row_number() OVER (PARTITION BY run ORDER BY doc_id, rn) AS nth
  FROM runs WHERE run IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, rn FROM (
    SELECT doc_id, rn FROM placed WHERE nth > 1 UNION ALL SELECT doc_id, rn + 1 FROM placed WHERE nth > 1)),
ends AS (
  SELECT n.doc_id, n.ord FROM numbered n JOIN gone g ON n.doc_id = g.doc_id AND n.rn = g.rn),
kept AS (
  SELECT p.doc_id, string_agg(p.piece, '' ORDER BY p.ord) AS kept
  FROM pieces p ANTI JOIN ends e ON p.doc_id = e.doc_id AND p.ord = e.ord GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(n.c, 0) AS n_sentences, coalesce(g.c, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d
LEFT JOIN kept k ON d.doc_id = k.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS c FROM numbered GROUP BY doc_id) n ON d.doc_id = n.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id) g ON d.doc_id = g.doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""

ORACLES: dict[str, str] = {"op6_sentence_span_dedup": _OP6_SQL, "op9_benchmark_decontamination": _OP9_SQL}
