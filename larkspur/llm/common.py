"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.shared import discarded as discarded
from larkspur.sources.shared import released as released
from larkspur.sources.shared import saved as saved

#: Characters that one in-memory step of a Python worker handles at most; a longer text is a step of its own.
STEP_CHARS = 2_000_000

#: Bytes of rows that go to a Python worker at a time; a larger row goes alone. Spark's own bound is 64 MB.
BATCH_BYTES = 4_000_000

#: White space of the contracts' words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: for files, their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shards(df: DataFrame, mb: float, least: int = 1) -> int:
    """How many shards of about that many input MB a table's work is dealt into; grows with the table."""
    return max(least, math.ceil(min(input_bytes(df), 1 << 50) / (mb * 1e6)))


def fold(items: list, size, limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of items whose sizes sum up to the limit at most, or a single larger item."""
    i, total = 0, 0
    for j, x in enumerate(items):
        n = size(x)
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(items):
        yield i, len(items)


_memories: dict[str, Callable[[], None]] = {}


def remembers(owner: str, forget: Callable[[], None]) -> None:
    """At the begin of a task: a worker serves one operator after another, so what others remember in it is forgotten
    and goes back to the system."""
    others = [x for x in _memories if x != owner]
    for x in others:
        _memories.pop(x)()
    _memories[owner] = forget
    if others:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Has the session send BATCH_BYTES to a Python worker at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """bound_batches for the plans that run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remainder(column: Column | str, m: int) -> Column:
    """crc32 of the value as text, modulo m; null for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string").cast("binary")) % m
