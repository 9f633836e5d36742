"""Shared helpers: tables, scratch tables in the shared folder, and vectorised word scanning.

Word scanning works on the UTF-8 bytes of a whole Arrow batch at once.  A word is a run of bytes
whose class is set in a 256-entry table, words never cross documents, and every word gets a 64-bit
polynomial hash of its (optionally lower-cased) bytes taken from prefix sums, finalised so that
sums of hashes stay well mixed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import ensure_checkpoint_dir

#: Bytes of text scanned at once (a longer text is scanned alone).  Bounds a worker's memory.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch between Spark and Python; with ``CHUNK_BYTES`` it bounds a batch.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of long texts (a session setting, read when a job starts)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the session's shared folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, lineage cut, columns prunable."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes the table that ``written`` made, once all its readers have written what they need."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if not path.getName().startswith("llm-"):
            raise ValueError(f"{path} is no scratch table")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the string column as zstd-compressed UTF-8, to make an exchange of texts smaller."""
    import zstandard
    i = df.columns.index(column)
    schema = StructType([StructField(f.name, BinaryType()) if f.name == column else f for f in df.schema.fields])

    def pack(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [None if t is None else press.compress(t.encode()) for t in batch.column(i).to_pylist()]
            cols = [pa.array(blobs, pa.binary()) if k == i else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return df.mapInArrow(pack, schema)


def unpacked(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    """The batch with the compressed column as strings again."""
    import zstandard
    spread, i = zstandard.ZstdDecompressor(), batch.schema.get_field_index(column)
    texts = pa.array([None if b is None else spread.decompress(b).decode() for b in batch.column(i).to_pylist()], pa.large_string())
    cols = [texts if k == i else batch.column(k) for k in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays(cols, names=batch.schema.names)


# ---------------------------------------------------------------- word classes (byte tables)

def _class(codes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


#: ``[^\x20\x09-\x0D]``
NON_SPACE = ~_class([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z
ALNUM = _class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK_BYTES:  # a very long text's powers are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (murmur3): every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) pieces of a batch, each of at most ``CHUNK_BYTES`` or one row; null is empty."""
    i = 0
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    while i < len(texts):
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1
        j = min(max(j, i + 1), len(texts))
        yield batch.slice(i, j - i), data[offsets[i]:offsets[j]], (offsets[i:j + 1] - offsets[i])
        i = j


class Words:
    """The words of a chunk: byte range, document (row) index, hash; ``first[d]``..``first[d + 1]`` are d's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, fold: np.ndarray, hashes: bool = True):
        n, docs = len(data), len(offsets) - 1
        inside = kind[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), self.count)
        if hashes:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE_CODE[fold][data] * _power(_BASE, n), out=total[1:])
            raw = (total[self.end] - total[self.start]) * _power(_INVERSE, n + 1)[self.start]
            self.hash = mix(raw + (self.end - self.start).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word index) of the windows of ``size`` words inside one document, and their hashes."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1:])
        total = np.zeros(n, np.uint64)
        for k in range(size):
            total += self.hash[k:k + n] * _ODD[k]
        return at, mix(total[at])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


#: DuckDB has no crc32: the byte table is built, then folded over the ASCII strings ``s`` of ``keys`` (views: crc32(s, c)).
CRC_SQL = """crc_table(b, k, v) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_table WHERE k < 8),
crc(s, k, v) AS (
  SELECT s, 1, CAST(4294967295 AS BIGINT) FROM ({keys})
  UNION ALL SELECT s, crc.k + 1, xor(t.v, crc.v >> 8) FROM crc JOIN crc_table t
    ON t.k = 8 AND t.b = xor(crc.v & 255, ascii(substr(s, crc.k, 1))) WHERE crc.k <= length(s)),
crc32 AS (SELECT s, xor(v, 4294967295) AS c FROM crc WHERE k = length(s) + 1)"""
