"""JSON arrays of any size, read by many tasks.

Spark's text reader deals a file over tasks at commas (its ``lineSep``), which every array of more than one element has, on
one line or many. What a comma means depends on all text before it: whether it lies in a string and how deep. A first pass
gives, for each byte range that a task read, what the range does to this state: whether it ends in another string parity than
it began with, and its change of depth begun outside and begun inside a string. These rows, one a range, are summed up in the
order of a file, so each range knows its state at the start, and a second pass cuts elements where a comma stands outside
strings at depth 1. Elements that lie in one range leave at once; the rest, two fragments a range, are put together by file.
A task holds one element at a time, so an element must fit into memory but neither a file nor a range need to.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlens.operators.guards import require_rows
from pairlens.session import settle

RANGE_SCHEMA = "path string, block long, bytes long, size long, parity int, outside long, inside long, lead string"
PART_SCHEMA = "path string, block long, part long, kind int, value string"
HEAD, WHOLE, TAIL = 0, 1, 2
WINDOW = 1 << 18
ROWS, FLUSH_BYTES = 4096, 4 << 20
#: Stands for a depth that no comma of a file that holds no array comes to.
NEVER = -(1 << 40)
BLANK = b" \t\r\n"
QUOTE, BACKSLASH, COMMA = b'"\\,'
DEPTH = np.zeros(256, dtype=np.int8)
DEPTH[list(b"[{")], DEPTH[list(b"]}")] = 1, -1


class _Scanner:
    """Goes through a byte stream in windows; knows whether it is in a string and whether a backslash is open."""

    def __init__(self, parity: int = 0):
        self.parity, self._odd = parity, 0

    def scan(self, data: np.ndarray) -> np.ndarray:
        """For each byte 1 inside a string and 0 outside."""
        quotes = data == QUOTE
        slashes = data == BACKSLASH
        if self._odd or slashes.any():
            # a byte is escaped after an odd number of backslashes
            at = np.arange(len(data))
            stop = np.maximum.accumulate(np.where(slashes, -1 - self._odd, at))
            before = np.concatenate([[-1 - self._odd], stop[:-1]])
            quotes &= (at - 1 - before) % 2 == 0
            self._odd = int(len(data) - 1 - stop[-1]) % 2
        within = np.bitwise_xor.accumulate(quotes.view(np.uint8)) ^ np.uint8(self.parity)
        self.parity = int(within[-1])
        return within


def _windows(values: Sequence[bytes], comma: bool) -> Iterator[bytes]:
    """Rows as the bytes of their file, the separating commas put back before each (but the first, without ``comma``)."""
    held, size = [], 0
    for value in values:
        if comma:
            held.append(b",")
        comma = True
        for at in range(0, len(value), WINDOW):
            held.append(value[at : at + WINDOW])
            size += len(held[-1])
            if size >= WINDOW:
                yield b"".join(held)
                held, size = [], 0
        size += 1
    if held:
        yield b"".join(held)


def _streams(batches: Iterator[pa.RecordBatch], state: Sequence[str] = ()) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Byte ranges in their order: path, block and state of each, and its bytes in windows."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("path", "block", *state, "value")), strict=True)

    for key, group in groupby(rows(), key=lambda r: r[:-1]):
        yield key, _windows((r[-1] for r in group), key[1] > 0)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each byte range does to the state of the text."""
    for (path, block, whole), windows in _streams(batches, ("bytes",)):
        scanner, size, change, lead = _Scanner(), 0, [0, 0], None
        for window in windows:
            data = np.frombuffer(window, dtype=np.uint8)
            steps, within = DEPTH[data], scanner.scan(data)
            inner = int(steps[within == 1].sum(dtype=np.int64))
            change[0] += int(steps.sum(dtype=np.int64)) - inner
            change[1] += inner
            size += len(data)
            if not lead:
                lead = window.removeprefix(b"\xef\xbb\xbf").lstrip(BLANK)[:1].decode("latin-1") or None
        made = [path], [block], [whole], [size], [scanner.parity], [change[0]], [change[1]], [lead]
        kinds = pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], names=["path", "block", "bytes", "size", "parity", "outside", "inside", "lead"])


def _cut(windows: Iterator[bytes], parity: int, depth: int) -> Iterator[tuple[int, int, bytes]]:
    """Number, kind and bytes of the parts between the commas that separate elements; the last one has no such comma."""
    scanner, held, part = _Scanner(parity), [], 0
    for window in windows:
        data = np.frombuffer(window, dtype=np.uint8)
        within = scanner.scan(data)
        level = np.cumsum(np.where(within == 0, DEPTH[data], 0), dtype=np.int64) + depth
        depth, start = int(level[-1]), 0
        for end in np.flatnonzero((data == COMMA) & (within == 0) & (level == 1)).tolist():
            held.append(window[start:end])
            yield part, WHOLE if part else HEAD, b"".join(held)
            held, part, start = [], part + 1, end + 1
        held.append(window[start:])
    yield part, TAIL if part else HEAD, b"".join(held)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, names = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()), ["path", "block", "part", "kind", "value"]
    out, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for (path, block, parity, depth), windows in _streams(batches, ("_parity", "_depth")):
        for part, kind, data in _cut(windows, parity, depth):
            out.append((path, block, part, kind, data.decode("utf-8", errors="replace")))
            held += len(data)
            if len(out) >= ROWS or held >= FLUSH_BYTES:
                yield batch()
                out, held = [], 0
    if out:
        yield batch()


def _pieces(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", ",").text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("bytes"), F.col("value").cast("binary").alias("value"), F.monotonically_increasing_id().alias("_id"),
    )


def _starts(ranges: DataFrame) -> DataFrame:
    """Each range's state at its start, and per file what it begins with and whether all that opens also closes."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    turned = ranges.withColumn("_parity", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    turned = turned.withColumn("_change", F.when(F.col("_parity") == 0, F.col("outside")).otherwise(F.col("inside")))
    # blank files have no first character; in a sound array it lies in the first range
    lead = F.min_by("lead", "block").over(whole)
    return turned.select(
        "path", "block", F.col("_parity").cast("int").alias("_parity"), lead.alias("lead"),
        F.when(lead == "[", F.coalesce(F.sum("_change").over(earlier), F.lit(0))).otherwise(F.lit(NEVER)).alias("_depth"),
        ((F.sum("parity").over(whole) % 2 == 0) & (F.sum("_change").over(whole) == 0)).alias("_closed"),
        F.sum("size").over(whole).alias("_size"), "bytes",
    )


def json_values(spark: SparkSession, path: str | Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """``(path, value, element)`` of the files below a path, each of which is one JSON value: the elements of an array, one a row,
    or the value itself, with ``element`` false; blank files give no rows.

    Elements are text and not parsed here. Text that is no array of anything (an unclosed string or bracket, a comma after the
    array, a blank element) fails when it is read, here or by the caller's parser. ``only`` holds the paths wanted, in a column
    ``path``. Rows are in no order. A ``.gz`` file is one task's work. Two passes over the text; elements are written once.
    """
    pieces = _pieces(spark, path)
    ranges = pieces.select("path", "block", "bytes", "value").mapInArrow(_ranges, RANGE_SCHEMA)
    if only is not None:
        ranges = ranges.join(only.select("path").distinct(), "path", "left_semi")
    starts = settle(_starts(settle(ranges, "array-ranges")).where("lead is not null"), "array-starts")
    broken = starts.where("not _closed").select("path").first()
    if broken:
        raise ValueError(f"invalid JSON in {broken.path}: a string or bracket is not closed")
    # the reader gives no row after a last comma; then its rows have all bytes of the file (a byte order mark is not among them)
    broken = starts.where("path not like '%.gz' and (_size = bytes - 1 or _size = bytes - 4)").select("path").first()
    if broken:
        raise ValueError(f"invalid JSON in {broken.path}: it ends with a comma")
    # a range stays in one task and in order, whichever join Spark chooses
    begun = pieces.join(starts.select("path", "block", "_parity", "_depth"), ["path", "block"]).sortWithinPartitions("path", "block", "_id")
    parts = settle(begun.select("path", "block", "_parity", "_depth", "value").mapInArrow(_parts, PART_SCHEMA), "array-parts")
    fragments = parts.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("path").orderBy("block", "part")
    numbered = fragments.select("path", "block", "part", F.sum((F.col("kind") == TAIL).cast("long")).over(order).alias("n"))
    last = Window.partitionBy("path")
    numbered = settle(numbered.withColumn("last", F.col("n") == F.max("n").over(last)), "array-numbers")
    joined = fragments.join(numbered, ["path", "block", "part"]).groupBy("path", "n", "last").agg(F.sort_array(F.collect_list(F.struct("block", "part", "value"))).alias("_f"))
    text = F.array_join(F.transform("_f", lambda f: f["value"]), "")
    leads = starts.groupBy("path").agg(F.max("lead").alias("lead"))
    edged = joined.select("path", "n", "last", text.alias("value")).join(leads, "path").withColumn("element", F.col("lead") == "[")

    def trimmed(at: Column, pattern: str, value: Column) -> Column:
        return F.when(F.col("element") & at, F.regexp_replace(value, pattern, "")).otherwise(value)

    value = trimmed(F.col("last"), r"\][ \t\r\n]*\z", trimmed(F.col("n") == 0, r"\A\x{FEFF}?[ \t\r\n]*\[", F.col("value")))
    blank = F.col("value").rlike(r"\A[ \t\r\n]*\z")
    shaped = edged.withColumn("value", value).where(~(F.col("element") & (F.col("n") == 0) & F.col("last") & blank))
    found = shaped.select("path", "value", "element").union(parts.where(F.col("kind") == WHOLE).select("path", "value", F.lit(True)))
    return require_rows(found, "value", ~(F.col("element") & blank), F.concat(F.lit("invalid JSON in "), F.col("path"), F.lit(": an element is missing")))
