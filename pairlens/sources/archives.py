"""Gzip and tar archives as tables of lines, read and written as streams.

Spark's text reader unpacks a ``.gz`` file of any size row by row; joined by line feeds again, its rows are the unpacked
bytes. A task takes tar members out of that stream as it passes, so neither an archive nor a member is ever held whole, and
any file system that Spark reads will do. One file is one task's work, as gzip cannot be split; many run side by side.
What begins with a tar header is an archive; all other ``.gz`` files are lines of their own.
"""

from __future__ import annotations

import io
import tarfile
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.guards import require_rows
from pairlens.session import path_exists, settle

SCHEMA = "path string, file string, line_number long, value string, fault string"
ROWS = 4096
#: Lines of a member that are compressed together while it is put in order.
RUN = 256
BLOCK = 512
#: Members and files of a run that hold responses.
WANTED = ("exp", ".jsonl")


class _Stream(io.RawIOBase):
    """Rows of a text file as the bytes they were, read forward; past the end it goes on with line feeds."""

    def __init__(self, rows: Iterator[bytes], padded: bool):
        self._rows, self._held, self._padded = rows, bytearray(), padded
        self.ended, self.total = False, 0

    def readable(self) -> bool:
        return True

    def _fill(self, size: int) -> None:
        while len(self._held) < size and not self.ended:
            row = next(self._rows, None)
            if row is None:
                self.ended = True
            else:
                self._held += row
                self._held += b"\n"
                self.total += len(row) + 1

    def peek(self, size: int) -> bytes:
        self._fill(size)
        return bytes(self._held[:size])

    def rest(self, size: int) -> bytes:
        """Bytes that there are."""
        self._fill(size)
        out = bytes(self._held[:size])
        del self._held[:size]
        return out

    def read(self, size: int = -1) -> bytes:
        out = self.rest(size)
        return out.ljust(size, b"\n") if self._padded else out

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _is_tar(head: bytes) -> bool:
    try:
        return len(head) == BLOCK and bool(tarfile.TarInfo.frombuf(head, "utf-8", "surrogateescape").name)
    except tarfile.HeaderError:
        return False


def _decoded(line: bytes) -> str:
    return line.rstrip(b"\r\n").decode("utf-8", errors="replace")


def _lines(path: str, rows: Iterator[bytes]) -> Iterator[tuple]:
    """Rows of one file: path, member or file, line number, line, or what is wrong with it."""
    first: list[bytes] = []  # as much as a tar header takes
    while sum(map(len, first)) + len(first) < BLOCK and (row := next(rows, None)) is not None:
        first.append(row)
    base = path.rsplit("/", 1)[-1]
    rows = chain(first, rows)
    if not _is_tar((b"\n".join(first) + b"\n")[:BLOCK]):
        yield from ((path, base, n, _decoded(line), None) for n, line in enumerate(rows, 1))
        return
    stream = _Stream(rows, True)
    name, end = None, 0
    try:
        with tarfile.open(fileobj=stream, mode="r|") as archive:
            for member in archive:
                archive.members = []  # else one entry a member is kept
                own, name = member.name.rsplit("/", 1)[-1], member.name
                end = member.offset_data + -(-member.size // BLOCK) * BLOCK
                if not (member.isfile() and own.startswith(WANTED[0]) and own.endswith(WANTED[1])):
                    continue
                at = member.offset_data
                for n, line in enumerate(archive.extractfile(member), 1):
                    yield path, name, n, _decoded(line), None
                    at += len(line)
                    if stream.ended and at >= stream.total and at < member.offset_data + member.size:
                        raise tarfile.ReadError("cut off")
            name = None
        if stream.ended and stream.total < end + BLOCK:
            raise tarfile.ReadError("cut off")
        while data := stream.rest(1 << 16):
            if data.strip(b"\0\n"):
                raise tarfile.ReadError("data that no header announces")
    except (tarfile.TarError, EOFError) as error:
        yield path, name, None, None, f"broken archive: {error}"


def archive_lines(spark: SparkSession, path: str | Sequence[str], glob: str = "*.gz") -> DataFrame:
    """``(path, file, line_number, value, fault)`` of ``.gz`` files below a path: of a tar archive the lines of its
    ``exp*.jsonl`` members, of any other file all lines.

    A broken archive gives its lines up to the break, then a row without a line whose ``fault`` says what is wrong. The
    numbers are those of the member, from 1, blank lines included.
    """
    # a cut-off file ends early, and the tar stream then shows it
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "\n").option("ignoreCorruptFiles", "true").text(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = chain.from_iterable(zip(b.column("path").to_pylist(), b.column("value").to_pylist(), strict=True) for b in batches)
        names, kinds = ["path", "file", "line_number", "value", "fault"], (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
        held: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        for source, group in groupby(flat, key=lambda r: r[0]):
            for row in _lines(source, (value for _, value in group)):
                held.append(row)
                if len(held) == ROWS:
                    yield batch()
                    held.clear()
        if held:
            yield batch()

    return rows.mapInArrow(unpack, SCHEMA)


def read_archives(spark: SparkSession, path: str | Sequence[str], glob: str = "*.gz") -> DataFrame:
    """Lines of archives without ``fault``; reading a broken one fails and names it."""
    lines = archive_lines(spark, path, glob)
    broken = F.concat(F.col("fault"), F.lit(" in "), F.col("path"), F.coalesce(F.concat(F.lit(", member "), "file"), F.lit("")))
    return require_rows(lines, "path", F.col("fault").isNull(), broken).drop("fault")


def read_tree(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(path, file, line_number, value, fault)`` of what the integrity report takes: folders, of which all ``exp*.jsonl``
    files are read, and ``.gz`` files, archives or not. A path that does not exist is a row with a fault."""
    from pairlens.sources.readers import text_lines, with_line_numbers

    found = []
    for path in paths:
        if not path_exists(spark, path):
            found.append(spark.createDataFrame([(path, None, None, None, "path does not exist")], SCHEMA))
        elif path.endswith(".gz"):
            found.append(archive_lines(spark, path, "*"))
        else:
            lines = with_line_numbers(text_lines(spark, path, f"{WANTED[0]}*{WANTED[1]}"))
            found.append(lines.select("path", "file", F.col("line_number").cast("long").alias("line_number"), "value", F.lit(None).cast("string").alias("fault")))
    out = spark.createDataFrame([], SCHEMA)
    for part in found:
        out = out.unionByName(part)
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered lines as compressed runs of one member each, with the number of their first line and their place in the task."""
    at = 0
    for batch in batches:
        files, numbers, values = (batch.column(c) for c in ("file", "line_number", "value"))
        rows = list(zip(files.to_pylist(), numbers.to_pylist(), values.to_pylist(), strict=True))
        out: list[tuple] = []
        for file, group in groupby(rows, key=lambda r: r[0]):
            member = list(group)
            for start in range(0, len(member), RUN):
                part = member[start : start + RUN]
                out.append((file, part[0][1], at, zlib.compress("".join(r[2] + "\n" for r in part).encode(), 1)))
                at += 1
        kinds = (files.type, numbers.type, pa.int64(), pa.binary())
        columns = zip(*out, strict=True) if out else ((),) * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "line_number", "at", "run"])


def write_archives(lines: DataFrame, path: str, archives: int, broken: Column | None = None) -> None:
    """``(file, line_number, value)`` as tar archives, gzipped, one a task: members are dealt over ``archives`` tasks.

    Members go out line by line behind a header with their size, which an aggregate gives, so none is held whole. Members
    for which ``broken`` holds are said to be one block longer than they are and end their archive, as a cut-off copy would.
    """
    cut = F.coalesce(broken, F.lit(False)) if broken is not None else F.lit(False)
    body = lines.select("file", "line_number", F.coalesce("value", F.lit("")).alias("value"), cut.alias("cut"))
    sizes = settle(body.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("size"), F.max("cut").alias("cut")), "archive-sizes")
    # Lines are put in order by many tasks and go on as compressed runs, so that the one task of an archive orders these only.
    line = T.StructType([T.StructField("file", T.StringType()), body.schema["line_number"]])
    kinds = T.StructType([*line.fields, T.StructField("at", T.LongType()), T.StructField("run", T.BinaryType())])
    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines.rdd.getNumPartitions())
    ordered = body.select("file", "line_number", "value").repartitionByRange(tasks, "file", "line_number").sortWithinPartitions("file", "line_number")
    runs = ordered.mapInArrow(_runs, kinds)
    # The largest members are dealt first, and the cut member comes last in its task.
    dealt = Window.orderBy(F.desc("size"), "file")
    placed = sizes.withColumn("archive", ((F.row_number().over(dealt) - 1) % archives).cast("int"))
    laid = runs.join(placed, "file").repartitionById(archives, F.col("archive")).sortWithinPartitions("cut", "file", "line_number", "at")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The archive's bytes as rows between line feeds, which the text writer puts back."""
        held, tail, name, left, ended = [], b"", None, 0, False

        def put(data: bytes) -> None:
            nonlocal tail
            *done, tail = (tail + data).split(b"\n")
            held.extend(done)

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r.decode() for r in held], pa.string())], names=["value"])
            held.clear()
            return out

        for batch in batches:
            for file, size, cut, run in zip(*(batch.column(c).to_pylist() for c in ("file", "size", "cut", "run")), strict=True):
                if file != name:
                    if ended:
                        break
                    if name is not None:
                        put(b"\0" * (-left % BLOCK))
                    name, left, ended = file, size, cut
                    info = tarfile.TarInfo(file)
                    info.size = size + BLOCK * 2 if cut else size
                    put(info.tobuf(tarfile.PAX_FORMAT))
                put(zlib.decompress(run))
                if len(held) >= ROWS:
                    yield rows()
        if name is not None and not ended:
            put(b"\0" * (-left % BLOCK) + b"\0" * 2 * BLOCK)
        if tail:
            held.append(tail)
        if held:
            yield rows()

    # a row for an empty task, so that each task's file is an archive or is empty
    laid.select("file", "size", "cut", "run").mapInArrow(pack, "value string").write.option("compression", "gzip").option("lineSep", "\n").text(path)
