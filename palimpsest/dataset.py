"""Named, typed, versioned datasets over DataFrames.

    catalog = Catalog(spark)
    catalog.configure("assets", path, schema).index("name", "name").register()
    with catalog.open("assets") as ds:
        ds.insert(df)
        ds.query().where("kind = 1").order_by("name").limit(10).update(hash=F.lit(7))

Inserts, updates and deletes append versions to a log; nothing is changed in place.
"""

from __future__ import annotations

import json
import os
import platform
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import datetime, timezone
from decimal import Decimal
from enum import Flag
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, StructType

from .errors import ConfigurationError, DatasetError, EncryptionNotReady, FlushError, ModeError, StoreClosed
from .operators import IndexRoot, Query, SetIndexRoot
from .plans import versions as plan
from .sources import crypto
from .sources.files import Files, shared_dir
from .sources.log import LogStore, Meta

DEFAULT_FLUSH_SECONDS, MAX_FLUSH_SECONDS = 5, 60
#: Rows that wait for a flush at most.
BUFFERED_ROWS = 10_000


class Mode(Flag):
    READ_WRITE = 1
    READ_ONLY = 2
    APPEND_ONLY = 4


class Config:
    """Settings of one dataset.  Each setter checks itself against those before it."""

    def __init__(self, catalog: Catalog, name: str, path: str | None = None, schema: StructType | str | None = None) -> None:
        if not name:
            raise ConfigurationError("a dataset needs a name")
        self._catalog, self.name, self.path = catalog, name, path.rstrip("/") if path else None
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.mode, self.flush_seconds = Mode.READ_WRITE, DEFAULT_FLUSH_SECONDS
        self.key: bytes | None = None
        self.cipher = "GCM"
        self.archive_path: str | None = None
        self.snapshot_path: str | None = None
        self.indexes: dict[str, Column] = {}
        self.set_indexes: dict[str, Column] = {}
        self.by_identity = False
        self.length: Column | None = None
        self._derived: dict[str, Column] = {}
        self._converted: dict[str, Column] = {}
        self._encode: Callable[[Column], Column] = lambda v: F.to_json(v, {"ignoreNullFields": "false"}).cast("binary")
        self._decode: Callable[[Column, StructType], Column] = lambda b, kind: F.from_json(b.cast("string"), kind)
        self._flush_set = False

    def _persisted(self, what: str) -> None:
        if self.path is None:
            raise ConfigurationError(f"{what} needs a dataset with a path")

    def set_mode(self, mode: Mode) -> Config:
        if mode in (Mode.READ_ONLY, Mode.APPEND_ONLY):
            self._persisted(f"{mode.name} mode")
        if mode == Mode.READ_ONLY and self.snapshot_path:
            raise ConfigurationError("a read-only dataset can't have snapshots")
        if mode == Mode.READ_ONLY and self._flush_set:
            raise ConfigurationError("a read-only dataset has no flush interval")
        self.mode = mode
        return self

    def flush_interval(self, seconds: int) -> Config:
        """0 flushes only when asked; otherwise buffered rows are written after so many seconds."""
        self._persisted("a flush interval")
        if self.mode == Mode.READ_ONLY:
            raise ConfigurationError("a read-only dataset has no flush interval")
        if not 0 <= seconds <= MAX_FLUSH_SECONDS:
            raise ConfigurationError(f"a flush interval is 0 to {MAX_FLUSH_SECONDS} seconds")
        self.flush_seconds, self._flush_set = seconds, seconds != DEFAULT_FLUSH_SECONDS
        return self

    def _encrypt(self, key: bytes, cipher: str) -> Config:
        self._persisted("encryption")
        if self.key is not None:
            raise ConfigurationError("encryption is already set")
        if cipher not in ("GCM", "CBC"):
            raise ConfigurationError(f"unknown cipher mode {cipher}")
        self.key, self.cipher = key, cipher
        return self

    def encrypt_with_key(self, provider: Callable[[], bytes] | bytes, cipher: str = "GCM") -> Config:
        return self._encrypt(crypto.check_key(provider() if callable(provider) else provider), cipher)

    def encrypt_with_password(self, provider: Callable[[], str] | str, cipher: str = "GCM") -> Config:
        return self._encrypt(crypto.key_of_password(provider() if callable(provider) else provider), cipher)

    def archive_to(self, path: str) -> Config:
        self._persisted("an archive")
        if self.archive_path:
            raise ConfigurationError("the archive is already set")
        self.archive_path = path.rstrip("/")
        return self

    def snapshots_to(self, path: str) -> Config:
        self._persisted("a snapshot")
        if self.mode == Mode.READ_ONLY:
            raise ConfigurationError("a read-only dataset can't have snapshots")
        if self.snapshot_path:
            raise ConfigurationError("the snapshot path is already set")
        self.snapshot_path = path.rstrip("/")
        return self

    def index_identity(self, on: bool = True) -> Config:
        self.by_identity = on
        return self

    def index(self, name: str, key: Column | str, collation: str | None = None) -> Config:
        """A named key expression; ``collation`` (such as UNICODE_CI) replaces order and equality by bytes."""
        if name in self.indexes or name in self.set_indexes:
            raise ConfigurationError(f"index {name} is already set")
        k = F.expr(key) if isinstance(key, str) else key
        self.indexes[name] = F.collate(k, collation) if collation else k
        return self

    def set_index(self, name: str, key: Column | str) -> Config:
        if name in self.indexes or name in self.set_indexes:
            raise ConfigurationError(f"index {name} is already set")
        self.set_indexes[name] = F.expr(key) if isinstance(key, str) else key
        return self

    def derive(self, name: str, expr: Column | str) -> Config:
        """A column that is computed on read and never stored."""
        self._derived[name] = F.expr(expr) if isinstance(expr, str) else expr
        return self

    def convert(self, name: str, expr: Column | str) -> Config:
        """What is stored in a column when rows are inserted, in terms of the values given."""
        self._converted[name] = F.expr(expr) if isinstance(expr, str) else expr
        return self

    def serialize_with(self, encode: Callable[[Column], Column], decode: Callable[[Column, StructType], Column]) -> Config:
        """The form of encrypted rows, and of their size: a struct to binary, and back.  JSON by default."""
        self._encode, self._decode = encode, decode
        return self

    def sized_by(self, length: Column | str) -> Config:
        """The serialized size of a row, for statistics; by default that of its JSON form."""
        self.length = F.expr(length) if isinstance(length, str) else length
        return self

    def register(self) -> Config:
        self._catalog._register(self)
        return self


class Catalog:
    """Configurations and open datasets of one session, by case-insensitive name."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._configs: dict[str, Config] = {}
        self._open: set[str] = set()

    def configure(self, name: str, path: str | None = None, schema: StructType | str | None = None) -> Config:
        return Config(self, name, path, schema)

    def _register(self, config: Config) -> None:
        if config.name.lower() in self._configs:
            raise ConfigurationError(f"dataset {config.name} is already configured")
        self._configs[config.name.lower()] = config

    def get(self, name: str) -> Config:
        try:
            return self._configs[name.lower()]
        except KeyError:
            raise ConfigurationError(f"dataset {name} isn't configured") from None

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._configs

    def remove(self, name: str) -> bool:
        if name.lower() in self._open:
            raise ConfigurationError(f"dataset {name} is open")
        return self._configs.pop(name.lower(), None) is not None

    def open(self, name: str) -> Dataset:
        config = self.get(name)
        if name.lower() in self._open:
            raise DatasetError(f"dataset {name} is already open")
        return Dataset(self, config)

    def unlock(self, name: str) -> None:
        """Remove the lock that a process of another machine left when it died."""
        Files(self.spark).delete(f"{self._closed(name).path}/_lock")

    def _closed(self, name: str) -> Config:
        config = self.get(name)
        config._persisted("maintenance")
        if name.lower() in self._open:
            raise DatasetError(f"dataset {name} is open")
        return config

    def defrag(self, name: str) -> tuple[int, int]:
        """Archive (if set up) and drop all but current versions; how many were stale and deleted."""
        with Dataset(self, self._closed(name), maintenance=True) as ds:
            return ds._defrag()

    def read_archive(self, name: str) -> DataFrame:
        """Archived versions: ``_id, _state, _state_at, _created_at`` and values."""
        config = self.get(name)
        if not config.archive_path:
            raise ConfigurationError(f"dataset {name} has no archive")
        if not Files(self.spark).exists(config.archive_path):
            raise DatasetError(f"the archive of {name} is empty")
        rows = self.spark.read.parquet(config.archive_path).drop("generation")
        return _readable(rows, _archived_schema(rows), config).select("_id", "_state", "_state_at", "_created_at", "archived_at", *(c for c in _archived_schema(rows).names))

    def restore(self, name: str, at: datetime, out: str) -> int:
        """A dataset in ``out`` with the rows that were current at ``at`` (UTC); returns their number."""
        if at.tzinfo is None or at.utcoffset().total_seconds():  # type: ignore[union-attr]
            raise ValueError("the time must be in UTC")
        if at > datetime.now(timezone.utc):
            raise ValueError("the time must be past")
        with Dataset(self, self._closed(name), maintenance=True) as ds:
            return ds._restore(at, out)

    def snapshot_name(self, name: str, at: datetime) -> str:
        return f"{at:%Y%m%d.%H%M.%S}.{at.microsecond // 1000:03d}.{name}"


def _archived_schema(rows: DataFrame) -> StructType:
    skip = {*plan.SYSTEM, "_state", "_state_at", "archived_at"}
    return StructType([f for f in rows.schema.fields if f.name not in skip])


def _readable(rows: DataFrame, values: StructType, config: Config) -> DataFrame:
    """Decrypted rows; encrypted ones that the key (or its absence) can't open are left out."""
    if config.key is None:
        return rows.where("NOT coalesce(_encrypted, false)")
    key = crypto.hidden(rows.sparkSession, config.key)
    text = crypto.decrypt(F.col("_payload"), key, config.cipher)
    opened = rows.withColumn("_open", F.when(F.col("_encrypted"), config._decode(text, values)))
    # A payload that the key doesn't open isn't there; one that opens to nulls alone
    # is there if they are what was put in, and not what a codec makes of noise.
    nulls = F.lit(True)
    for f in values.fields:
        nulls = nulls & F.col("_open")[f.name].isNull()
    same = config._encode(F.struct(*(F.col("_open")[f.name].alias(f.name) for f in values.fields))) == text
    opened = opened.where(~F.coalesce("_encrypted", F.lit(False)) | (F.col("_open").isNotNull() & (~nulls | F.coalesce(same, F.lit(False)))))
    return opened.select(*(F.when(F.col("_encrypted"), F.col("_open")[f.name]).otherwise(F.col(f.name)).alias(f.name) if f.name in values.names else F.col(f.name) for f in rows.schema.fields))


def _fitting(of: DataType) -> Callable[[Any], Any]:
    """Python numbers to the type that a column takes."""
    if isinstance(of, DecimalType):
        return lambda v: v if isinstance(v, Decimal) else Decimal(str(v))
    return float if isinstance(of, (FloatType, DoubleType)) else lambda v: v


def _began(pid: int) -> str | None:
    """When a process of this machine began, in the system's terms; None if there is none."""
    try:
        with open(f"/proc/{pid}/stat", encoding="utf-8", errors="replace") as f:
            return f.read().rpartition(")")[2].split()[19]
    except OSError:
        return None


class Dataset:
    """An open dataset; use it as a context."""

    def __init__(self, catalog: Catalog, config: Config, maintenance: bool = False) -> None:
        self._catalog, self.config, self.spark = catalog, config, catalog.spark
        self._files = Files(self.spark)
        self._volatile = config.path is None
        path = config.path or f"{shared_dir(self.spark)}/palimpsest-{uuid.uuid4().hex}"
        self._lock = threading.RLock()
        self._rows: list[tuple[int, bool, dict]] = []
        self._halted: BaseException | None = None
        self.on_halted: Callable[[BaseException], None] | None = None
        self._closed_ = False
        self._lock_uri = f"{path}/_lock"
        if not self._volatile:
            self._take_lock()
        try:
            self._log = LogStore(self.spark, path, config.schema)
            if config.mode != Mode.READ_ONLY and not self._volatile:
                self._log.sweep()
            if self._log.meta.batches and config.mode != Mode.APPEND_ONLY:
                self._log.check()
        except BaseException:
            if not self._volatile:
                self._files.delete(self._lock_uri)
            raise
        self._next_id = self._log.meta.last_id + 1
        self._timer: threading.Timer | None = None
        catalog._open.add(config.name.lower())

    # life cycle

    def _take_lock(self) -> None:
        """The lock file names its process; that of a process of this machine that is gone is taken over."""
        own = json.dumps({"host": platform.node(), "pid": os.getpid(), "began": _began(os.getpid())})
        if self._files.create_new(self._lock_uri, own):
            return
        try:
            held = json.loads(self._files.read_text(self._lock_uri))
            gone = held["host"] == platform.node() and _began(held["pid"]) != held["began"]
        except (ValueError, KeyError, TypeError):
            gone = False
        if gone:
            self._files.delete(self._lock_uri)
            if self._files.create_new(self._lock_uri, own):
                return
        raise DatasetError(f"{self.config.name} is open elsewhere: {self._lock_uri} exists (Catalog.unlock removes it)")

    def __enter__(self) -> Dataset:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        with self._lock:
            if self._closed_:
                return
            try:
                if not self._halted:
                    self._write_buffered()
            finally:
                self._closed_ = True
                if self._timer:
                    self._timer.cancel()
                self._catalog._open.discard(self.config.name.lower())
                self._files.delete(self._log.path if self._volatile else self._lock_uri)

    def _guard(self, write: bool = False, append: bool = False) -> None:
        if self._halted:
            raise StoreClosed("writing failed before") from self._halted
        if self._closed_:
            raise StoreClosed("the dataset is closed")
        mode = self.config.mode
        if mode == Mode.READ_ONLY and (write or append) or mode == Mode.APPEND_ONLY and not append:
            raise ModeError(f"the dataset is running in '{mode.name}' mode")

    # rows

    def _fresh(self) -> DataFrame:
        with self._lock:
            self._write_buffered()
            if self._log.meta.clean:
                return self._log.read()
            return plan.current(self._log.read("i"), self._log.read("c"))

    def _log_rows(self) -> DataFrame:
        self._write_buffered()
        return self._log.read()

    def _current(self) -> DataFrame:
        """Current versions with system columns, values readable."""
        return _readable(self._fresh(), self._log.value_schema, self.config)

    def rows(self) -> DataFrame:
        """Current rows: ``_id``, ``_seq`` (the natural order), values and derived columns."""
        self._guard()
        return self._current().select("_id", "_seq", *self._log.value_schema.names).withColumns(self.config._derived)

    def query(self) -> Query:
        """Rows are those that are current when a terminal runs."""
        self._guard()
        return Query(self.rows, ["_seq"], self._update_rows, self._delete_rows)

    def _index_query(self, predicate: Column, key: Column | None) -> Query:
        return Query(lambda: self.rows().where(predicate), ["_seq"], self._update_rows, self._delete_rows, None if key is None else [key])

    def via_index(self, name: str) -> IndexRoot:
        self._guard()
        if not self.config.indexes:
            raise DatasetError("the dataset has no index")
        if name not in self.config.indexes:
            raise KeyError(f"no index {name}")
        return IndexRoot(self.config.indexes[name], self._index_query)

    def via_set_index(self, name: str) -> SetIndexRoot:
        self._guard()
        if name not in self.config.set_indexes:
            raise KeyError(f"no set index {name}")
        return SetIndexRoot(self.config.set_indexes[name], self._index_query)

    def exists(self, what: Column | str | int) -> bool:
        return not self._matching(what).isEmpty()

    def count(self, predicate: Column | str | None = None) -> int:
        self._guard(append=predicate is None)
        if predicate is None:
            self._write_buffered()
            meta = self._log.meta
            if meta.clean and (not meta.sealed or self.config.mode == Mode.APPEND_ONLY):
                return meta.rows
            return self._current().count() if meta.sealed else self._fresh().count()
        return self._matching(predicate).count()

    def _matching(self, what: Column | str | int) -> DataFrame:
        return self.rows().where(F.col("_id") == what if isinstance(what, int) else what)

    def find(self, what: Column | str | int) -> dict | None:
        """The first matching row in natural order, or None."""
        row = self._matching(what).orderBy("_seq").limit(1).head()
        return row.asDict(recursive=True) if row else None

    def find_all(self, predicate: Column | str) -> DataFrame:
        return self._matching(predicate).orderBy("_seq")

    def find_ids(self, *ids: int) -> DataFrame:
        """In argument order if the identity is indexed, else in natural order; missing ids are passed over."""
        ids = tuple(dict.fromkeys(ids))
        found = self.rows().where(F.col("_id").isin(*ids) if ids else F.lit(False))
        if self.config.by_identity and ids:
            return found.orderBy(F.array_position(F.array(*(F.lit(i).cast("long") for i in ids)), F.col("_id")))
        return found.orderBy("_seq")

    # changes

    def insert(self, rows: DataFrame | dict | Iterable[dict], encrypt: bool = False, on_id: Callable[[int], dict | None] | None = None, order: list | None = None) -> list[int] | tuple[int, int]:
        """Insert rows.  A DataFrame is one batch and gives the ids' range (first,
        last); its natural order is ``order``, or that of its partitions.  Dicts
        are buffered until a flush or a read, and give their ids; ``on_id`` may
        return values to set, such as the id itself."""
        self._guard(append=True)
        if encrypt and self.config.key is None:
            raise EncryptionNotReady("the dataset has no key")
        if isinstance(rows, DataFrame):
            return self._insert_frame(rows, encrypt, order)
        ids = []
        with self._lock:
            for row in [rows] if isinstance(rows, dict) else rows:
                if row is None:
                    raise ValueError("a row can't be null")
                new, row = self._next_id, dict(row)
                self._next_id += 1
                if on_id:
                    row |= on_id(new) or {}
                self._rows.append((new, encrypt, row))
                ids.append(new)
            if len(self._rows) >= BUFFERED_ROWS:
                self._write_buffered()
            elif self.config.flush_seconds and not self._volatile and self._timer is None:
                self._timer = threading.Timer(self.config.flush_seconds, self._tick)
                self._timer.daemon = True
                self._timer.start()
        return ids

    def _tick(self) -> None:
        with self._lock:
            self._timer = None
            if not self._closed_ and not self._halted:
                try:
                    self._write_buffered()
                except FlushError:
                    pass  # kept in _halted: the next call raises it

    def flush(self) -> None:
        if self._volatile:
            raise DatasetError("a dataset in memory has nothing to flush to")
        self._guard(append=True)
        self._write_buffered()

    def _write_buffered(self) -> None:
        with self._lock:
            if not self._rows:
                return
            held = self._rows
            try:
                schema = self._log.value_schema
                names = schema.names
                seq = self._log.meta.last_seq
                fit = [_fitting(f.dataType) for f in schema.fields]
                data = [(i, seq + k + 1, e, *(None if (v := r.get(n)) is None else f(v) for n, f in zip(names, fit))) for k, (i, e, r) in enumerate(held)]
                kind = StructType.fromDDL("_id long, _seq long, _encrypted boolean")
                df = self.spark.createDataFrame(data, StructType([*kind.fields, *schema.fields]), verifySchema=False)
                self._log.append(self._stored(df, "I", F.lit(datetime.now(timezone.utc))), len(held), last_id=max(self._log.meta.last_id, held[-1][0]), last_seq=seq + len(held), sealed=self._log.meta.sealed or any(e for _, e, _ in held))
                self._rows = []
            except Exception as e:
                self._halted = e
                if self.on_halted:
                    self.on_halted(e)
                raise FlushError(str(e)) from e

    def _stored(self, df: DataFrame, op: str, at: Column) -> DataFrame:
        """Log rows of ``_id, _seq, _encrypted`` and values."""
        schema = self._log.value_schema
        if op == "I" and self.config._converted:
            df = df.withColumns(self.config._converted)
        values = F.struct(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
        payload = self.config._encode(values)
        length = self.config.length if self.config.length is not None else F.octet_length(payload)
        out = df.withColumn("_op", F.lit(op)).withColumn("_created_at", at.cast("timestamp"))
        if self.config.key is None:
            return out.withColumn("_length", length.cast("long")).withColumn("_payload", F.lit(None).cast("binary"))
        out = out.withColumn("_length", F.when(F.col("_encrypted"), crypto.encrypted_length(length, self.config.cipher)).otherwise(length).cast("long"))
        out = out.withColumn("_payload", F.when(F.col("_encrypted"), crypto.encrypt(payload, crypto.hidden(self.spark, self.config.key), self.config.cipher)))
        return out.withColumns({n: F.when(~F.col("_encrypted"), F.col(n)) for n in schema.names})

    def _insert_frame(self, df: DataFrame, encrypt: bool, order: list | None, stream: tuple[str, int] | None = None) -> tuple[int, int]:
        """``stream``, a name and the number of its batch, is committed with the rows."""
        with self._lock:
            self._write_buffered()
            more = {"streams": self._log.meta.streams | dict([stream])} if stream else {}
            if not self._log.meta.schema:
                self._log.meta.schema = StructType([f for f in df.schema.fields]).json()
            df = df.select(*self._log.value_schema.names)
            first = self._next_id
            rows, n, stage = self._log.numbered(df, 0, "_k0", order)
            if n:
                rows = rows.withColumn("_id", F.col("_k0") + first).withColumn("_seq", F.col("_k0") + self._log.meta.last_seq + 1).withColumn("_encrypted", F.lit(encrypt))
                self._log.append(self._stored(rows, "I", F.lit(datetime.now(timezone.utc))), n, last_id=first + n - 1, last_seq=self._log.meta.last_seq + n, sealed=self._log.meta.sealed or encrypt, **more)
                self._next_id = first + n
            self._files.delete(stage)
            return first, first + n - 1

    def _insert_batch(self, df: DataFrame, name: str, number: int) -> None:
        """A stream's batch, unless its number was committed before."""
        self._guard(append=True)
        with self._lock:
            if number > self._log.meta.streams.get(name, -1):
                self._insert_frame(df, False, None, (name, number))

    def _append_versions(self, rows: Callable[[], DataFrame], op: str, values: dict[str, Column]) -> int:
        """A version or tombstone for each target row, with one time for all.  Targets
        are found and written under one lock, so that no change comes between."""
        with self._lock:
            targets = rows()
            names = self._log.value_schema.names
            unknown = set(values) - set(names)
            if unknown:
                raise ValueError(f"no such columns: {sorted(unknown)}")
            new = targets.withColumns(values).select("_id", "_seq", *names)
            rows, n, stage = self._log.numbered(new.withColumnRenamed("_seq", "_was"), self._log.meta.last_seq + 1, "_seq", ["_was"] if op == "U" else None)
            if n:
                at = datetime.now(timezone.utc)
                if op == "U":
                    encrypted = self._log_rows().select("_seq", "_encrypted").withColumnRenamed("_seq", "_was")
                    rows = rows.join(encrypted, "_was") if self.config.key is not None else rows.withColumn("_encrypted", F.lit(False))
                    rows = self._stored(rows, "U", F.lit(at))
                else:
                    empty = {f.name: F.lit(None).cast(f.dataType) for f in self._log.value_schema.fields}
                    rows = rows.withColumns(empty | {"_op": F.lit("D"), "_created_at": F.lit(at), "_encrypted": F.lit(False), "_length": F.lit(0), "_payload": F.lit(None).cast("binary")})
                self._log.append(rows, n, last_seq=self._log.meta.last_seq + n, clean=False)
            self._files.delete(stage)
            return n

    def _update_rows(self, rows: Callable[[], DataFrame], values: dict[str, Any]) -> int:
        self._guard(write=True)
        return self._append_versions(rows, "U", {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})

    def _delete_rows(self, rows: Callable[[], DataFrame]) -> int:
        self._guard(write=True)
        return self._append_versions(rows, "D", {})

    def update(self, what: Column | str | int, **values: Any) -> int:
        """New versions of all matching rows; returns how many."""
        self._guard(write=True)
        return self._update_rows(lambda: self._matching(what), values)

    def delete(self, what: Column | str | int) -> int:
        self._guard(write=True)
        return self._delete_rows(lambda: self._matching(what))

    # maintenance

    def versions(self) -> DataFrame:
        """Every version with its state and times."""
        self._guard()
        found = plan.versions(self._log_rows())
        return _readable(found, self._log.value_schema, self.config)

    def purge(self) -> tuple[int, int]:
        """Forget versions that aren't current; how many stale and deleted ones were held."""
        self._guard()
        if self.config.mode != Mode.READ_WRITE:
            return 0, 0
        w = plan.versions(self._log_rows())
        ended = w.where("_state <> 'Fresh'").groupBy("_state").count().collect()
        by = {r["_state"]: r["count"] for r in ended}
        now = by.get(plan.STALE, 0), by.get(plan.DELETED, 0)
        before, self._purged = getattr(self, "_purged", (0, 0)), now
        return now[0] - before[0], now[1] - before[1]

    def statistics(self, *names: str) -> dict[str, float | int | None]:
        self._guard()
        return plan.statistics(plan.versions(self._log.read()), self._next_id - 1, list(names) or None)

    def snapshot(self) -> datetime:
        """A copy of the current rows, a dataset of its own, under the snapshot path."""
        self._guard(append=True)
        if not self.config.snapshot_path:
            raise ConfigurationError("the dataset has no snapshot path")
        at = datetime.now(timezone.utc)
        at = at.replace(microsecond=at.microsecond // 1000 * 1000)
        rows = self._fresh()
        self._copy(rows, f"{self.config.snapshot_path}/{self._catalog.snapshot_name(self.config.name, at)}")
        return at

    def _room_for(self, out: str) -> None:
        """Before rows are copied: the store must have room for all of the log."""
        need = self._files.size(self._log.directory())
        if self._files.room(out) < need:
            raise DatasetError(f"{out}: less than {need} bytes are free")

    def _copy(self, rows: DataFrame, out: str) -> int:
        """``rows`` as the only generation of a new log; ids go on after the last one."""
        store = LogStore(self.spark, out, self._log.value_schema)
        if store.meta.batches:
            raise DatasetError(f"{out} holds a dataset")
        self._room_for(out)
        store.meta = replace(Meta(), schema=self._log.meta.schema, last_id=self._log.meta.last_id, last_seq=self._log.meta.last_seq, generation=-1, sealed=self._log.meta.sealed, uid=uuid.uuid4().hex)
        store.rewrite(rows.withColumn("_op", F.lit("I")), 0)
        n = store.read().count()
        store.commit(replace(store.meta, rows=n))
        return n

    def _defrag(self) -> tuple[int, int]:
        self._guard(write=True)
        if self._log.meta.clean:
            return 0, 0
        self._room_for(self.config.archive_path or self._log.path)
        found = plan.versions(self._log.read())
        by = {r["_state"]: r["count"] for r in found.groupBy("_state").count().collect()}
        if self.config.archive_path:
            at = datetime.now(timezone.utc)
            gone = found.where("_state <> 'Fresh'").withColumn("archived_at", F.lit(f"{at:%Y%m%d.%H%M.%S}.{at.microsecond // 1000:03d}"))
            # One folder for each generation of this log: a retry after a crash replaces its own rows.
            gone.write.mode("overwrite").parquet(f"{self.config.archive_path}/generation={self._log.meta.uid}-{self._log.meta.generation}")
        rows = found.where("_state = 'Fresh'").drop("_state", "_state_at").withColumn("_op", F.lit("I"))
        self._log.rewrite(rows, by.get(plan.FRESH, 0))
        return by.get(plan.STALE, 0), by.get(plan.DELETED, 0)

    def _archived(self) -> DataFrame:
        """Archived versions that the log itself no longer holds: a crash may have come between archive and rewrite."""
        rows = self.spark.read.parquet(self.config.archive_path)
        return rows.where(F.col("generation") != f"{self._log.meta.uid}-{self._log.meta.generation}").drop("generation", "archived_at")

    def _restore(self, at: datetime, out: str) -> int:
        found = [plan.versions(self._log.read())]
        if self.config.archive_path and self._files.exists(self.config.archive_path):
            found.append(self._archived())
        rows = plan.as_of(plan.union(found), F.lit(at).cast("timestamp"))
        return self._copy(rows.drop("_state", "_state_at"), out)
