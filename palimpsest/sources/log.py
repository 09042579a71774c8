"""An append-only Parquet log in generations and batches.

``<path>/_meta/<n>.json`` states are numbered; the highest is current and names
the generation and the batches that belong to it.  A batch is first written under
``<path>/gen-<g>/<kind>-<k>-<attempt>``, then the next state is created, which fails if
another writer was faster: a batch is in the log whole or not at all, and files of
failed writes are never read.  A state that a crash left torn never happened: the
newest whole one counts, and the next number is free.  Batches are of inserts
(``i-``) or of changes (``c-``), so that rows that never changed can be told from others.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType, TimestampType

from ..errors import CorruptLog, DatasetError
from .files import Files

_KEEP_STATES = 8


@dataclass
class Meta:
    generation: int = 0
    last_id: int = 0
    last_seq: int = 0
    #: Inserts only: current versions need no resolving.
    clean: bool = True
    batches: list[str] = field(default_factory=list)
    rows: int = 0
    schema: str = ""
    streams: dict[str, int] = field(default_factory=dict)
    #: Some rows may be encrypted.
    sealed: bool = False
    #: Names the log in its archive.
    uid: str = ""


class LogStore:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None) -> None:
        self.spark, self.path, self._files = spark, path.rstrip("/"), Files(spark)
        self._state, self.meta = self._load()
        if not self.meta.schema and schema is not None:
            self.meta.schema = schema.json()

    def _load(self) -> tuple[int, Meta]:
        states = sorted((int(n[:-5]) for n in self._files.children(f"{self.path}/_meta") if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
        for n in states:
            try:
                return states[0], Meta(**self._files.read_json(f"{self.path}/_meta/{n:012d}.json"))
            except (ValueError, TypeError):
                continue  # torn by a crash: it was never committed
        if states:
            raise CorruptLog(f"{self.path}: no state is whole")
        return -1, Meta(uid=uuid.uuid4().hex)

    @property
    def value_schema(self) -> StructType:
        if not self.meta.schema:
            raise DatasetError("the dataset has no schema yet: give one, or insert a DataFrame first")
        return StructType.fromJson(json.loads(self.meta.schema))

    @property
    def schema(self) -> StructType:
        system = [StructField("_id", LongType()), StructField("_seq", LongType()), StructField("_op", StringType()), StructField("_created_at", TimestampType()), StructField("_encrypted", BooleanType()), StructField("_length", LongType()), StructField("_payload", BinaryType())]
        return StructType([*system, *(StructField(f.name, f.dataType, True) for f in self.value_schema.fields)])

    def commit(self, meta: Meta) -> None:
        uri = f"{self.path}/_meta/{self._state + 1:012d}.json"
        if not self._files.create_new(uri, json.dumps(asdict(meta))):
            raise DatasetError(f"another writer changed {self.path}")
        self._state, self.meta = self._state + 1, meta
        if self._state >= _KEEP_STATES:
            self._files.delete(f"{self.path}/_meta/{self._state - _KEEP_STATES:012d}.json")

    def directory(self, generation: int | None = None) -> str:
        return f"{self.path}/gen-{self.meta.generation if generation is None else generation}"

    def read(self, kind: str = "") -> DataFrame:
        """All batches, or those of inserts (``i``) or changes (``c``)."""
        some = [f"{self.directory()}/{b}" for b in self.meta.batches if b.startswith(kind)]
        if not some:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*some)

    def sweep(self) -> None:
        """Remove what writes that never committed left behind; for the only writer."""
        live = set(self.meta.batches)
        for name in self._files.children(self.path):
            if name.startswith("_stage-") or (name.startswith("gen-") and f"{self.path}/{name}" != self.directory()):
                self._files.delete(f"{self.path}/{name}")
        for name in self._files.children(self.directory()):
            if name not in live:
                self._files.delete(f"{self.directory()}/{name}")

    def check(self) -> None:
        """Fewer rows on disk than committed ones: CorruptLog."""
        try:
            n = self.read().count()
        except Exception as e:
            raise CorruptLog(f"{self.path}: {e}") from e
        if n < self.meta.rows:
            raise CorruptLog(f"{self.path}: {n} rows, {self.meta.rows} are committed")

    def numbered(self, df: DataFrame, first: int, name: str, order: list | None = None) -> tuple[DataFrame, int, str]:
        """``df`` with dense numbers from ``first`` up in ``name``, in partition order.

        Rows are staged once; a count per partition gives the offsets, so nothing
        is sorted or sent to one task.  Returns the frame, the count and the
        staging folder (to delete when the frame was used)."""
        stage = f"{self.path}/_stage-{uuid.uuid4().hex}"
        if order:
            df = df.orderBy(*order)
        df.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id() - F.spark_partition_id().cast("long") * (1 << 33)).write.parquet(stage)
        rows = self.spark.read.parquet(stage)
        counts = {r["_p"]: r["count"] for r in rows.groupBy("_p").count().collect()}  # a row per task
        offsets, at = [], first
        for p in sorted(counts):
            offsets.append((p, at))
            at += counts[p]
        if not offsets:
            return rows.withColumn(name, F.lit(first).cast("long")).drop("_p", "_k"), 0, stage
        base = self.spark.createDataFrame(offsets, "_p int, _base long")  # a row per task
        return rows.join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_k")).drop("_p", "_k", "_base"), at - first, stage

    def append(self, df: DataFrame, rows: int, **changes) -> None:
        """Commit ``df`` (in the log's schema) as one batch; ``changes`` go to the metadata."""
        name = f"{'c' if changes.get('clean') is False else 'i'}-{self._state + 1:012d}-{uuid.uuid4().hex[:8]}"
        df.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.parquet(f"{self.directory()}/{name}")
        self.commit(replace(self.meta, batches=[*self.meta.batches, name], rows=self.meta.rows + rows, **changes))

    def rewrite(self, df: DataFrame, rows: int) -> None:
        """A new generation with ``df`` alone; the old one is deleted after the switch."""
        old, name = self.meta.generation, f"i-{0:012d}-{uuid.uuid4().hex[:8]}"
        df.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.parquet(f"{self.directory(old + 1)}/{name}")
        self.commit(replace(self.meta, generation=old + 1, batches=[name], rows=rows, clean=True))
        self._files.delete(self.directory(old))
