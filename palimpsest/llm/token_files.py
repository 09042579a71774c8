"""Token id files with Elias-Fano coded document boundaries.

A file is the concatenated ids of its documents (2 or 4 bytes each, little
endian), an index and a footer; it is written front to back, so any store will do:

    ids | document ids (int64) | lower bits | upper bits | select samples | footer

The footer is ``<8s8Q``: magic, documents, documents with a null id (they come
first), ids, bytes of an id, lower bits of a boundary, bytes of the lower and of
the upper part, samples.  Samples take 4 bytes (8 beyond 512 MB of upper bits), one
for 256 documents; boundaries take about 2 + log2(ids / documents) bits.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, tune, written
from .tokens import default_vocabulary, drops_space, encoder

_FOOTER = "<8s8Q"
_FOOTER_BYTES = struct.calcsize(_FOOTER)
_MAGIC = b"EFTOKEN1"
_SAMPLE = 256
_CHUNK_IDS = 1 << 20


class EliasFano:
    """A sorted list of integers; ``select(k)`` is its k-th element."""

    def __init__(self, n: int, low_bits: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.lower, self.upper, self.samples = n, low_bits, lower, upper, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        lower = np.zeros(-(-n * low_bits // 8), dtype=np.uint8)
        step = 1 << 16  # values at once; a multiple of 8, so each step fills whole bytes
        for k in range(0, n if low_bits else 0, step):
            part = values[k : k + step]
            bits = (part[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
            lower[k * low_bits // 8 : k * low_bits // 8 + len(packed)] = packed
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(ones[-1]) if n else 0) + 1, dtype=np.uint8)
        flags[ones] = n > 0
        return cls(n, low_bits, lower, np.packbits(flags, bitorder="little"), ones[::_SAMPLE].astype(np.uint64))

    def _low(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, dtype=np.int64)
        first, last = a * self.low_bits, b * self.low_bits
        bits = np.unpackbits(self.lower[first // 8 : -(-last // 8)], bitorder="little")[first % 8 : first % 8 + last - first]
        return bits.reshape(b - a, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def between(self, a: int, b: int) -> np.ndarray:
        """Elements a to b - 1."""
        if b <= a:
            return np.empty(0, dtype=np.int64)
        start = int(self.samples[a // _SAMPLE])
        stop = int(self.samples[(b - 1) // _SAMPLE + 1]) if (b - 1) // _SAMPLE + 1 < len(self.samples) else len(self.upper) * 8
        bits = np.unpackbits(self.upper[start // 8 : -(-stop // 8)], bitorder="little")
        ones = np.flatnonzero(bits) + start // 8 * 8
        ones = ones[np.searchsorted(ones, start) :]
        at = a - a // _SAMPLE * _SAMPLE
        high = ones[at : at + b - a] - np.arange(a, b)
        return (high << self.low_bits) | self._low(a, b)

    def select(self, k: int) -> int:
        if not 0 <= k < self.n:
            raise IndexError(k)
        return int(self.between(k, k + 1)[0])

    @property
    def n_bytes(self) -> int:
        return self.lower.nbytes + self.upper.nbytes + self.samples.nbytes


def _filesystem(uri: str):
    from pyarrow.fs import FileSystem

    # Hadoop's names of the same store
    return FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def _sample_kind(n_upper: int) -> str:
    """Bit positions of ``n_upper`` bytes take four bytes, or eight beyond 512 MB."""
    return "<u4" if n_upper * 8 < 1 << 32 else "<u8"


def write_files(docs: DataFrame, folder: str, vocabulary: str, end: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the files; returns the manifest, ``shard, uri, n_docs, n_ids``.

    Shards hold ascending ranges of (id, hash of the text); null ids come first.
    A file's name is unique to the attempt that wrote it, and the manifest, itself
    a written table, names those that count: a lost or doubled task does no harm.
    """
    spark = tune(docs.sparkSession)
    by_word = drops_space(vocabulary)
    width = 2 if _vocabulary_size(vocabulary) <= 1 << 16 else 4
    kind = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        encode = encoder(vocabulary, by_word)
        store, base = _filesystem(folder)
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.eft"
        out = None
        ids: list[int] = []
        nulls, lengths = 0, []
        for batch in batches:
            for doc_id, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{name}")
                got = encode(t, end)
                out.write(got.astype(f"<u{width}").tobytes())
                lengths.append(len(got))
                nulls += doc_id is None
                ids.append(doc_id or 0)
        if out is None:
            return
        starts = np.concatenate(([0], np.cumsum(lengths)))
        index = EliasFano.encode(starts)
        for part in (np.array(ids, dtype="<i8"), index.lower, index.upper, index.samples.astype(_sample_kind(len(index.upper)))):
            out.write(part.tobytes())
        out.write(struct.pack(_FOOTER, _MAGIC, len(ids), nulls, int(starts[-1]), width, index.low_bits, len(index.lower), len(index.upper), len(index.samples)))
        out.close()
        yield pa.RecordBatch.from_pylist([{"shard": shard, "uri": f"{folder}/{name}", "n_docs": len(ids), "n_ids": int(starts[-1])}], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "th").sortWithinPartitions("doc_id", "th").select("doc_id", "text")
    return written(ordered.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long"))


def _vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str) -> None:
        store, path = _filesystem(uri)
        self._file = store.open_input_file(path)
        size = self._file.size()
        magic, self.n_docs, self.n_null, self.n_ids, self.width, low_bits, n_lower, n_upper, n_samples = struct.unpack(_FOOTER, self._at(size - _FOOTER_BYTES, _FOOTER_BYTES))
        if magic != _MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        at = self.n_ids * self.width
        index = self._at(at, size - _FOOTER_BYTES - at)
        samples = np.dtype(_sample_kind(n_upper))
        cut = np.cumsum([self.n_docs * 8, n_lower, n_upper, n_samples * samples.itemsize])
        self.doc_ids = np.frombuffer(index[: cut[0]], "<i8")
        self.bounds = EliasFano(self.n_docs + 1, low_bits, np.frombuffer(index[cut[0] : cut[1]], np.uint8), np.frombuffer(index[cut[1] : cut[2]], np.uint8), np.frombuffer(index[cut[2] : cut[3]], samples))

    def _at(self, start: int, n: int) -> bytes:
        self._file.seek(start)
        return self._file.read(n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._at(start * self.width, (stop - start) * self.width), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document."""
        return self.ids(self.bounds.select(k), self.bounds.select(k + 1))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(id, start, ids)`` in order, read in large pieces."""
        k = 0
        while k < self.n_docs:
            stop = min(self.n_docs, k + 4096)
            starts = self.bounds.between(k, stop + 1)
            j = 0
            while j < stop - k:
                e = max(j + 1, int(np.searchsorted(starts, starts[j] + _CHUNK_IDS, side="right")) - 1)
                e = min(e, stop - k)
                part = self.ids(int(starts[j]), int(starts[e]))
                for d in range(j, e):
                    yield (None if k + d < self.n_null else int(self.doc_ids[k + d])), int(starts[d]), part[starts[d] - starts[j] : starts[d + 1] - starts[j]]
                j = e
            k = stop

    def close(self) -> None:
        self._file.close()


def read_files(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of the files.

    ``start`` counts ids over all files in shard order."""
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    # A row per file; the running sum over them needs them in one place.
    base = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("shard", "uri", base.alias("base"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                f = TokenFile(uri)
                rows: list[tuple] = []
                for doc_id, start, ids in f.documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
                f.close()

    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end: int = 1, folder: str | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write every text's ids, then read the files back.

    A null or empty text is the end id alone; null ids come first; rows that
    repeat an id follow each other by hash of the text, each a document of its
    own; an empty table writes no file and gives no rows; other columns are ignored.
    """
    folder = folder or f"{shared_dir(spark)}/palimpsest/tokens-{uuid.uuid4().hex}"
    return read_files(write_files(docs, folder, vocabulary or default_vocabulary(), end, text, id_col))
