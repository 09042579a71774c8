"""What the corpus operators share: inputs, row keys, and tables that cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_dir as shared_dir

#: Rows in one Arrow batch: keeps a batch of long texts far below a worker's memory.
BATCH_ROWS = 256


def tune(spark: SparkSession) -> SparkSession:
    """Session settings that the Python stages need: bounded batches, and this
    package on the path of workers that a local session starts."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def drop(spark: SparkSession, *frames: DataFrame | str) -> None:
    """Delete tables of :func:`written` that nothing reads any more."""
    for f in frames:
        uri = f if isinstance(f, str) else getattr(f, "_palimpsest_path", None)
        if uri:
            with contextlib.suppress(Exception):
                fs, path = _path(spark, uri)
                fs.delete(path, True)


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later readers neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    uri = f"{shared_dir(spark)}/palimpsest/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out._palimpsest_path = uri  # type: ignore[attr-defined]
    atexit.register(drop, spark, uri)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now; it
    acts when the driver's JVM collects garbage, which a small heap use delays."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def keyed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``th`` and ``text`` of each row, and no other column but a
    struct ``carry`` of those asked for.

    ``th`` is a hash of the text: with the id it is the key of a row, so that
    rows that repeat an id with another text stay apart."""
    own = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("th"),
        F.col(text).cast("string").alias("text"),
    ]
    return docs.select(*own, *([F.struct(*carry).alias("carry")] if carry else []))


def whole_rows(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, th`` as of :func:`keyed`, and all columns in a struct ``row``, where
    no name of theirs can clash with one of ours."""
    th = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), th.alias("th"), F.struct(*docs.columns).alias("row"))


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def in_fold(id_col: str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo: true where it is ``remainder`` (null ids: false)."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(fold == F.lit(remainder), F.lit(False))


def map_rows(df: DataFrame, columns: list[str], schema: str, f: Callable[[tuple], tuple | None]) -> DataFrame:
    """``f`` over each row's values of ``columns``; for outputs of one row or none."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for x in zip(*(batch.column(c).to_pylist() for c in columns)) if (r := f(x)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows), kind)], schema=kind)

    return df.select(*columns).mapInArrow(run, schema)
