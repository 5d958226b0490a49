"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.durable import settled as durable  # noqa: F401

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def ascii_lower(data: bytes) -> bytes:
    """Lower-cases A-Z alone, in UTF-8 bytes."""
    return data.translate(_LOWER)


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null is empty, a lone surrogate becomes its replacement."""
    return b"" if text is None else text.encode("utf-8", "replace")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of rows that an Arrow batch takes at most, but for a single longer row.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes: ten thousand long texts at once are too much for a worker."""
    conf = df.sparkSession.conf
    now = conf.get(_BATCH_SETTING, str(BATCH_BYTES * 2)).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def release_memory() -> None:
    """Gives freed memory back to the system: a worker that goes on to other stages would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def release_disk(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files and checkpoints of tables that nothing refers to any more: it does so when the
    driver collects garbage, which a driver with little to do would put off until the disks are full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def row_key(*columns: str) -> Column:
    """A non-null key for the values of these columns, nulls included."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in columns])


def steps(texts: pa.ChunkedArray | pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of about `most` characters, each with the place of its first; null is empty."""
    run, size, first = [], 0, 0
    for i, text in enumerate(texts):
        value = text.as_py() or ""
        if run and size + len(value) > most:
            yield first, run
            run, size, first = [], 0, i
        run.append(value)
        size += len(value)
    if run:
        yield first, run
