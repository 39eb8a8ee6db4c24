"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import re
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.session import working_folder

BATCH_BYTES = 4 << 20

# Word bytes: 0-9, a-z (A-Z are lowered) and every byte of a character outside ASCII.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lowered, then runs of ASCII letters, digits and non-ASCII characters.

    Works on UTF-8 bytes: all bytes of a non-ASCII character are word bytes, so
    no character is ever cut.  Null has no words.
    """
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


@contextmanager
def small_batches(spark: SparkSession, limit_bytes: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches that go to Python hold at most so many bytes, or one row that is longer."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    found = re.fullmatch(r"(-?\d+)b?", before)
    if found and 0 < int(found[1]) <= limit_bytes:
        yield
        return
    spark.conf.set(key, f"{limit_bytes}b")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared working folder and read back.

    It cuts the lineage with files every executor can read, so a lost executor
    costs nothing, and the reader knows the size of what it reads.  Spark's
    own Arrow batches may reach 64 MB in the executor and again in Python, for
    each running task, so they are held smaller here.
    """
    path = f"{working_folder(frame.sparkSession)}/{name}_{uuid.uuid4().hex}"
    with small_batches(frame.sparkSession):
        frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def release() -> None:
    """Gives memory that a Python worker has freed back to the system.

    Spark keeps workers for later tasks, also beside stages that need none, and
    both Arrow and the C library keep what was freed, some 100 MB of a worker.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def releasing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and ``release`` after the last one."""
    try:
        yield from batches
    finally:
        release()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few hundred at a time in Python's own form."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            yield from zip(*(column.to_pylist() for column in batch.slice(at, 500).columns))


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000, limit_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; the last field of a row may be large."""
    held: list[tuple] = []
    weight = 0
    try:
        for row in rows:
            held.append(row)
            weight += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if len(held) >= size or weight >= limit_bytes:
                yield _batch(held, schema)
                held, weight = [], 0
        if held:
            yield _batch(held, schema)
    finally:
        held = []
        release()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
