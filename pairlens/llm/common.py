"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.session import settle

__all__ = ["ByteMemo", "blobs", "held_out", "read", "released", "settle", "shuffle_width", "slices", "strings"]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session: hot groups are dealt over as many tasks."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(key: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the key as text has this remainder; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``most`` bytes of one column, and one row at least."""
    for batch in batches:
        size = batch.column(column).nbytes
        step = max(1, int(batch.num_rows * most / max(size, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def _give_back() -> None:
    """Memory that is free in this worker goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; its own rules hold


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` after which, and before which, its worker holds no more than it uses.

    Workers live on between tasks and stages; what a task freed would otherwise count for the next one as well.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def blobs(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def strings(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    """A text column as Python strings."""
    return batch.column(column).to_pylist()


class Memo(dict):
    """A bounded cache of a pure function, in two generations: when full, the entries become the old generation, from
    which those still in use come back. Results never depend on it."""

    def __init__(self, fn: Callable, most: int = 300_000):
        super().__init__()
        self.fn, self._most, self._old = fn, most, {}

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteMemo(dict):
    """A cache of a pure function bounded in bytes, in two generations as ``Memo``: each holds half of ``most`` at most.

    An entry counts with its key, its value, what a tuple as value holds, and a share of the table. Results never depend
    on it.
    """

    def __init__(self, fn: Callable, most: int):
        super().__init__()
        self.fn, self._most, self._old, self._held = fn, most // 2, {}, 0

    def __missing__(self, key):
        value = self._old.get(key)
        if value is None:
            value = self.fn(key)
        size = 120 + getsizeof(key) + getsizeof(value)
        if type(value) is tuple:
            size += sum(map(getsizeof, value)) + sum(getsizeof(x) for v in value if type(v) is tuple for x in v)
        if self._held + size > self._most:
            self._old = dict(self)
            self.clear()
            self._held = 0
        self._held += size
        self[key] = value
        return value
