"""Incremental ingest of appended response logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pairlens.operators.metrics import add_counts, condition_counts, summary_of_counts
from pairlens.operators.normalize import normalize_responses
from pairlens.session import list_paths, path_exists, qualified, remove, scratch, settle

RESPONSE_SCHEMA = (
    "id string, dataset string, model string, condition string, correct string, distractor string, "
    "initial string, final string, is_error boolean, ingested timestamp"
)
KEYS = ("dataset", "model", "condition", "id")


def read_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of appended JSONL files."""
    return (
        spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)
    )


def own_checkpoint(spark: SparkSession, out: str, checkpoint: str | None) -> str:
    """The checkpoint of an output: the one given or ``out`` with ``-checkpoint``; output without one is refused."""
    where = checkpoint or f"{out.rstrip('/')}-checkpoint"
    if path_exists(spark, out) and not path_exists(spark, where):
        raise ValueError(f"{out} holds output but there is no checkpoint {where}")
    return where


def _numbered(spark: SparkSession, folder: str, below: int) -> list[int]:
    """Numbers of the ``batch=`` folders below a number."""
    found = [int(n.split("=")[1]) for n in list_paths(spark, folder) if n.startswith("batch=")] if path_exists(spark, folder) else []
    return sorted(n for n in found if n < below)


def fold_counts(rows: DataFrame, folder: str, number: int) -> DataFrame:
    """Add a batch's counts to the totals of the batch before; the new totals, a row per condition.

    Totals of a batch come from those below its number only, so a batch that is run again gives the same. The last two are
    kept.
    """
    spark = rows.sparkSession
    before = _numbered(spark, folder, number)
    counts = condition_counts(rows)
    if before:
        counts = add_counts(counts, spark.read.schema(counts.schema).parquet(f"{folder}/batch={before[-1]}"))
    counts.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    for old in before[:-1]:
        remove(spark, f"{folder}/batch={old}")
    return spark.read.schema(counts.schema).parquet(f"{folder}/batch={number}")


#: Rows of a batch up to which every task that scans the keys seen holds the batch's hashes: 16 bytes each and a table of 16 MB.
LOOKUP_ROWS = 4_000_000
#: Hash of a row's key. Keys seen are scanned by it alone; whether two keys are the same is decided by the keys themselves.
HASH = "_key_hash"


def _same_key() -> Column:
    return reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in KEYS])


def _span(number: int, merge_every: int) -> int:
    """How many batches below a number its ``merged=`` folder covers: the largest power of ``merge_every`` that divides the number."""
    span = merge_every
    while number % (span * max(merge_every, 2)) == 0:
        span *= max(merge_every, 2)
    return span


def _merged(spark: SparkSession, folder: str, number: int, merge_every: int) -> list[int]:
    """Numbers of the ``merged=`` folders that together hold the keys of all batches below a number where a stretch begins."""
    found = [int(n.split("=")[1]) for n in list_paths(spark, folder) if n.startswith("merged=")] if path_exists(spark, folder) else []
    chosen, left = [], number
    for n in sorted(found, reverse=True):
        if n <= left:
            chosen.append(n)
            left = n - _span(n, merge_every)
    return chosen


def _merge(spark: SparkSession, folder: str, number: int, merge_every: int, kind: StructType) -> None:
    """Keys of the stretch before a number as one folder, with those of whole stretches before it where these are as many as a
    stretch has batches. A key is so written again once for every power of ``merge_every`` only.

    What the folder was made of is deleted a stretch later, so that the batch can be run again.
    """
    old = number - merge_every
    parts = [f"{folder}/batch={n}" for n in _numbered(spark, folder, number) if n >= old]
    parts += [f"{folder}/merged={n}" for n in _merged(spark, folder, old, merge_every) if n > number - _span(number, merge_every)]
    keys = _keys(spark, parts, kind) if parts else spark.createDataFrame([], kind)
    _written(keys.sortWithinPartitions(HASH), f"{folder}/merged={number}")
    for n in _numbered(spark, folder, old):
        remove(spark, f"{folder}/batch={n}")
    kept = _merged(spark, folder, old, merge_every)
    for name in list_paths(spark, folder):
        if name.startswith("merged=") and (n := int(name.split("=")[1])) < old and n not in kept:
            remove(spark, f"{folder}/{name}")


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a qualified path, and the path in it."""
    return (fs.LocalFileSystem(), path.removeprefix("file:")) if path.startswith("file:") else fs.FileSystem.from_uri(path)


def _files(folders: Sequence[str]) -> list[tuple[fs.FileSystem, str]]:
    """Data files directly in folders, the largest first."""
    found = []
    for folder in folders:
        store, inside = _store(folder)
        found += [(-i.size, i.path, store) for i in store.get_file_info(fs.FileSelector(inside)) if i.is_file and not i.base_name.startswith(("_", "."))]
    return [(store, path) for _, path, store in sorted(found, key=lambda f: f[:2])]


def _row_groups(store: fs.FileSystem, path: str) -> Iterator[Callable[[list[str]], pa.Table]]:
    """A reader of columns for each row group of a file."""
    with store.open_input_file(path) as source:
        file = pq.ParquetFile(source, read_dictionary=KEYS[:-1])  # few values, which need no text a row
        for group in range(file.num_row_groups):
            yield lambda columns, group=group: file.read_row_group(group, columns, use_threads=False)


def _hashes(folder: str) -> np.ndarray:
    """Sorted hashes of a folder."""
    found = [read([HASH]).column(0).to_numpy() for f in _files([folder]) for read in _row_groups(*f)]
    return np.sort(np.concatenate(found)) if found else np.empty(0, "i8")


def _repeated(ids: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Hashes that a folder has more than once."""
    for _ in ids:
        hashes = _hashes(folder)
        yield pa.RecordBatch.from_pydict({HASH: np.unique(hashes[1:][hashes[1:] == hashes[:-1]])})


def _matching(ids: Iterator[pa.RecordBatch], tasks: int, asked: str, folders: Sequence[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the folders' files whose hash is among those asked for; task ``i`` of ``tasks`` takes every ``tasks``-th file.

    A byte for each leading 24 bits of a hash rules out nearly all rows; what is left is searched for in the sorted hashes. Both
    are some four times as fast on files ordered by hash, as these are.
    """
    mine = [f for batch in ids for i in batch.column(0).to_pylist() for f in _files(folders)[i::tasks]]
    hashes = _hashes(asked) if mine else ()
    if not len(hashes):
        return
    leading = np.zeros(1 << 24, bool)
    leading[(hashes >> 40) + (1 << 23)] = True
    for file in mine:
        for read in _row_groups(*file):
            seen = read([HASH]).column(0).to_numpy()
            likely = np.flatnonzero(leading[(seen >> 40) + (1 << 23)])
            at = np.searchsorted(hashes, seen[likely])
            rows = likely[hashes[np.minimum(at, len(hashes) - 1)] == seen[likely]]
            if len(rows):
                yield from read(schema.names).select(schema.names).take(pa.array(rows)).cast(schema).combine_chunks().to_batches(max_chunksize=10_000)


def _scannable(folder: str) -> bool:
    """Whether Arrow reads a folder of keys and finds hashes in it; folders written by earlier versions have none."""
    try:
        found = _files([folder])
    except (OSError, pa.ArrowInvalid, ImportError):
        return False
    return bool(found) and HASH in _footer(*found[0]).schema.names


def _footer(store: fs.FileSystem, path: str) -> pq.FileMetaData:
    with store.open_input_file(path) as source:
        return pq.read_metadata(source)


def _count(folder: str) -> int:
    """Rows of a folder, by its footers."""
    return sum(_footer(*f).num_rows for f in _files([folder]))


def _with_hash_of(rows: DataFrame, work: str, parts: Sequence[str], kind: StructType, scanned: bool) -> DataFrame:
    """Keys seen, in the folders ``parts``, that share their hash with one of ``rows``, which lie in ``work``.

    Arrow scans the one integer column, some ten times as fast as a join goes through rows. The keys are joined where there are
    too many at once, or where they cannot be scanned.
    """
    spark = rows.sparkSession
    if not scanned:
        return _keys(spark, parts, kind).join(rows.select(HASH), HASH, "left_semi")
    tasks, schema = spark.sparkContext.defaultParallelism, to_arrow_schema(kind)
    return spark.range(0, tasks, 1, tasks).mapInArrow(lambda ids: _matching(ids, tasks, f"{work}/rows", parts, schema), kind)


def _keys(spark: SparkSession, parts: Sequence[str], kind: StructType) -> DataFrame:
    """Keys of folders with their hashes, which folders written by earlier versions do not have."""
    return spark.read.schema(kind).parquet(*parts).withColumn(HASH, F.coalesce(HASH, F.xxhash64(*KEYS)))


def new_keys(batch: DataFrame, folder: str, number: int, merge_every: int = 64) -> DataFrame:
    """The first row of each key that no batch below ``number`` had; null is a key value like any other.

    Keys seen are a table: a folder a batch, merged every ``merge_every`` batches. A batch first looks up which of its own
    keys are in there: the table is scanned by one hash a key, and what has a hash of the batch is compared in full. So it is
    not shuffled while the batch has at most ``LOOKUP_ROWS`` rows, and nothing stays in executors between batches.
    Of rows with one key in one batch the earliest by ingest time counts. Folders below the number alone are read, so a
    batch that is run again gives the same rows.
    """
    spark = batch.sparkSession
    folder, work = qualified(spark, folder), qualified(spark, scratch(spark, "batch"))
    rows = _written(batch.select(F.xxhash64(*KEYS).alias(HASH), *batch.columns), f"{work}/rows")
    kind = rows.select(HASH, *KEYS).schema
    base = number // merge_every * merge_every
    if number == base and number:  # a new stretch begins
        _merge(spark, folder, number, merge_every, kind)
    parts = [f"{folder}/merged={n}" for n in reversed(_merged(spark, folder, base, merge_every))]
    parts += [f"{folder}/batch={n}" for n in _numbered(spark, folder, number) if n >= base]
    scanned = all(map(_scannable, (f"{work}/rows", *parts[:1]))) and _count(f"{work}/rows") <= LOOKUP_ROWS
    fresh = _firsts(rows, work, scanned)
    if parts:
        known = _written(_with_hash_of(rows, work, parts, kind, scanned), f"{work}/known")
        fresh = fresh.alias("a").join(known.alias("b"), (F.col(f"a.{HASH}") == F.col(f"b.{HASH}")) & _same_key(), "left_anti")
    out = _written(fresh.sortWithinPartitions(HASH), f"{folder}/batch={number}")
    remove(spark, work)
    return out.select(batch.columns)


def _firsts(rows: DataFrame, work: str, scanned: bool) -> DataFrame:
    """The earliest row of each key of ``rows``, which lie in ``work``. Only those whose hash is not alone there are grouped."""
    spark = rows.sparkSession
    others = [c for c in rows.columns if c not in (HASH, *KEYS)]
    order = F.struct(F.coalesce("ingested", F.timestamp_seconds(F.lit(0))), F.xxhash64(*others))
    if scanned:
        twice = spark.range(0, 1, 1, 1).mapInArrow(lambda ids: _repeated(ids, f"{work}/rows"), f"{HASH} bigint")
    else:
        twice = rows.groupBy(HASH).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(HASH)
    twice = _written(twice, f"{work}/repeated")
    if not _count(f"{work}/repeated") if scanned else twice.isEmpty():
        return rows
    # The hash comes first, so that rows are ordered by it and not by keys that begin alike.
    grouped = rows.join(twice, HASH, "left_semi").groupBy(HASH, *KEYS).agg(F.min_by(F.struct(*others), order).alias("_r"))
    return rows.join(twice, HASH, "left_anti").unionByName(grouped.select(HASH, *KEYS, "_r.*"))


def _written(rows: DataFrame, path: str) -> DataFrame:
    """Rows written to a path, in place of what is there, and read back. A scan holds a row group, so these are small."""
    rows.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _save_summary(totals: DataFrame, out: str) -> None:
    """A row per condition, so every batch replaces it."""
    summary_of_counts(totals).coalesce(1).write.mode("overwrite").parquet(out)


def stream_responses(
    spark: SparkSession, log: str, out: str, checkpoint: str | None = None, files_per_batch: int = 1000,
    merge_every: int = 64,
) -> StreamingQuery:
    """Keep ``out`` equal to the condition summary of the first rows of all keys logged so far; stops at the end of the log.

    Keys and counts lie in tables beside the checkpoint, so the query itself has no state. The checkpoint, by default beside
    ``out``, makes a restart continue where the last run ended.
    """
    checkpoint = own_checkpoint(spark, out, checkpoint)
    tables = f"{checkpoint.rstrip('/')}-tables"

    def fold(batch: DataFrame, number: int) -> None:
        rows = new_keys(batch, f"{tables}/keys", number, merge_every)
        _save_summary(fold_counts(normalize_responses(rows), f"{tables}/counts", number), out)

    return (
        read_log(spark, log, files_per_batch).writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_autosave(
    spark: SparkSession, log: str, out: str, checkpoint: str | None = None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Save new rows and error rows of each batch, and the summary of everything so far, under ``out``.

    ``rows`` and ``errors`` have a folder a batch, so a batch that is run again after a failure replaces its own output
    only. ``summary`` holds the totals so far; they are folded from ``counts``. The checkpoint, by default beside ``out``,
    keeps batch numbers going after a restart.
    """
    checkpoint = own_checkpoint(spark, out, checkpoint)

    def save(batch: DataFrame, number: int) -> None:
        rows = settle(normalize_responses(batch), "batch")
        failed = F.coalesce("is_error", F.lit(False))
        rows.where(~failed).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        rows.where(failed).write.mode("overwrite").parquet(f"{out}/errors/batch={number}")
        _save_summary(fold_counts(rows, f"{out}/counts", number), f"{out}/summary")

    return (
        read_log(spark, log, files_per_batch).writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
