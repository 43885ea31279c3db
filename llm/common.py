"""Shared pieces: reading tables, the shared work folder, and vectorised text hashing inside tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once inside a task; bounds the memory of the numpy steps.
SLICE_BYTES = 400_000
_U = np.uint64
#: Small tables that take up to this many bytes in memory are sent to all tasks, larger ones are joined by shuffle.
MAX_SENT_BYTES = 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, or one of our own where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return found.rstrip("/")


#: Rows of an Arrow batch where rows hold whole texts, and where they hold a few numbers.
TEXT_ROWS, NUMBER_ROWS = 500, 10_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_session(spark: SparkSession) -> None:
    """Small Arrow batches for whatever the session runs from here on: they bound the memory, on both sides, of tasks that
    read whole texts in Python. Operators that return a plan which does so call this; ``cut`` sets its own."""
    spark.conf.set(BATCH_ROWS, TEXT_ROWS)


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def cut(df: DataFrame, label: str, texts: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive lost executors and start there.

    ``texts``: the stages that are written read whole texts in Python.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    with batch_rows(spark, TEXT_ROWS if texts else NUMBER_ROWS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the folder behind a ``cut`` table that no later step reads."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/llm-" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a ``cut`` table."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return 0
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def _width(kind: T.DataType, value: Column) -> Column:
    """Bytes of a value in memory, from above."""
    if isinstance(kind, T.ArrayType):
        one = sum(8 if not isinstance(f.dataType, (T.StringType, T.BinaryType)) else 64 for f in kind.elementType.fields) + 16 if isinstance(kind.elementType, T.StructType) else 8
        return 16 + F.coalesce(F.size(value), F.lit(0)) * one
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(value), F.lit(0))
    return F.lit(8 * len(kind.fields) + 16 if isinstance(kind, T.StructType) else 8)


def memory_bytes(df: DataFrame) -> int:
    """Bytes that the rows of a ``cut`` table take in a hash table; not counted out where the files alone are too large."""
    on_disk = table_bytes(df)
    if on_disk > MAX_SENT_BYTES:
        return on_disk
    each = sum((_width(f.dataType, F.col(f.name)) for f in df.schema.fields), F.lit(40))
    return df.agg(F.sum(each)).first()[0] or 0


def joined(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a written small table: sent to all tasks where its rows take little memory, by shuffle beyond that."""
    return big.join(F.broadcast(small) if memory_bytes(small) <= MAX_SENT_BYTES else small, on, how)


def id_name(docs: DataFrame) -> DataFrame:
    """The two columns every document operator reads; other columns, clashing names included, are left alone."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def marked(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whole, as a struct that no name can clash with, beside the keys that tell them apart: key_id
    (the doc_id, or the least long for null) and key_text (a hash of the text)."""
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("whole")
    return docs.select(whole, F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("key_id"), F.xxhash64(docs["text"].cast("string")).alias("key_text"))


# ---------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_R = _U(0x9E3779B97F4A7C15)
_R_INV = _U(pow(int(_R), -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = 1 << max(12, int(n).bit_length())
        got = np.full(size, base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[int(base)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64 output bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of documents.

    start, end: byte places of each word; first: for each document the number of its first word, and one more entry
    for the end; data: the bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        n = len(data)
        space = separators[data]
        edge = np.ones(n + 1, bool)
        edge[1:-1] = space[:-1]
        edge[offsets] = True
        self.start = np.flatnonzero(edge[:-1] & ~space)
        edge = np.ones(n + 1, bool)
        edge[1:-1] = space[1:]
        edge[offsets] = True
        self.end = np.flatnonzero(edge[1:] & ~space) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        data = _LOWER[self.data] if lower else self.data
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(_R, len(data)), out=total[1:])
        return mix((total[self.end] - total[self.start]) * powers(_R_INV, len(data) + 1)[self.start])

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes (Karp-Rabin); the caller drops the runs that cross documents."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    if k <= 8:
        out = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            out = out * _R + words[j : n - k + 1 + j]
        return mix(out)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(_R, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(_R_INV, n + 1)[: n - k + 1])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, places - places[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows of about ``limit`` bytes; a longer text is a slice by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, places = texts_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(places, places[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark longs."""
    return pa.array(values.view(np.int64))


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))
