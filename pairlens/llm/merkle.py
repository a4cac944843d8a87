"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line with its line end; a section ends with a blank line, or with a paragraph whose hash says so, so that
edits do not move the ends of later sections. A paragraph's hash is that of its bytes, a section's that of its
paragraphs' hashes, the root that of its sections' hashes: equal roots mean equal texts, and unlike branches lead to the
edits (``edits``).

A fingerprint writes the tree down: the root, and for each section ``|`` and its short hash, for each paragraph ``.``, its
short hash and the 24-bit marks of its segments. Segments of about 40 bytes end where the last eight bytes say so. Two
fingerprints are alike by the share of marks that they have in common, so likeness needs no text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import Memo, blobs, shuffle_width, slices, strings

WINDOW, MEAN_SEGMENT, LEAST_SEGMENT = 8, 40, 12
SECTION_SHARE = 8
MARKS = re.compile(r"\.[0-9a-f]{8}([0-9a-f]*)")
NODE_SCHEMA = "doc_id long, level string, section int, paragraph int, hash string, start long, length long"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _windows(data: bytes) -> np.ndarray:
    """A hash of the eight bytes that end at each byte."""
    padded = np.frombuffer(b"\0" * (WINDOW - 1) + data, dtype=np.uint8)
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    x = np.ascontiguousarray(x).view(np.uint64).ravel()
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def paragraphs(data: bytes) -> list[bytes]:
    parts = data.split(b"\n")
    lines = [p + b"\n" for p in parts[:-1]]
    return lines + [parts[-1]] if parts[-1] else lines


def sections(hashes: list[bytes], lines: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of paragraphs."""
    out, start = [], 0
    for i, (h, line) in enumerate(zip(hashes, lines, strict=True)):
        if i == len(lines) - 1 or not line.strip() or h[0] % SECTION_SHARE == 0:
            out.append((start, i + 1))
            start = i + 1
    return out


def _tree(data: bytes) -> tuple[bytes, list[tuple[int, int, bytes]], list[bytes], list[bytes]]:
    """Root, sections (first, end, hash), paragraph hashes and paragraphs."""
    lines = paragraphs(data)
    hashes = [hashlib.sha256(b"p" + line).digest() for line in lines]
    parts = [(a, b, hashlib.sha256(b"s" + b"".join(hashes[a:b])).digest()) for a, b in sections(hashes, lines)]
    return hashlib.sha256(b"r" + b"".join(h for _, _, h in parts)).digest(), parts, hashes, lines


def fingerprint_of(data: bytes) -> str:
    root, parts, hashes, lines = _tree(data)
    if not lines:
        return root.hex()
    mixed = _windows(data)
    ends = np.cumsum([len(line) for line in lines])
    cuts = np.flatnonzero(mixed % np.uint64(MEAN_SEGMENT) == 0) + 1
    if len(cuts):
        cuts = cuts[np.diff(cuts, prepend=-LEAST_SEGMENT) >= LEAST_SEGMENT]
    stops = np.union1d(cuts, ends)
    starts = np.concatenate([[0], stops[:-1]])
    sums = np.add.reduceat(mixed, starts)
    marks = (sums ^ (sums >> np.uint64(24)) ^ (sums >> np.uint64(48))).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:]
    digits, upto = marks.tobytes().hex(), (np.searchsorted(stops, ends) + 1) * 6
    out, at = [root.hex()], 0
    for a, b, h in parts:
        out.append("|" + h[:4].hex())
        for i in range(a, b):
            out.append("." + hashes[i][:4].hex() + digits[at : upto[i]])
            at = upto[i]
    return "".join(out)


def _marks(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(MARKS.findall(fingerprint))), dtype=np.uint8).reshape(-1, 3).astype(np.uint32)
    return np.unique(raw[:, 0] << 16 | raw[:, 1] << 8 | raw[:, 2], return_counts=True)


def likeness_of(a: str, b: str, marks=_marks) -> float:
    """Twice the common marks over all marks of both; 1 exactly for equal roots."""
    if a[:64] == b[:64]:
        return 1.0
    (x, n), (y, m) = marks(a), marks(b)
    if not len(x) or not len(y):
        return 0.0
    spots = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = np.minimum(n, m[spots])[y[spots] == x].sum()
    return min(2 * float(common) / float(n.sum() + m.sum()), 1 - 1e-9)


def fingerprint(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Replace text columns by fingerprint columns of the names given; all other columns are kept.

    A null text counts as empty. Whole texts are read. A text met again within the next few is not computed again.
    """
    kept = [c for c in rows.columns if c not in columns and c not in columns.values()]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in columns.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(fingerprint_of, 16)
        for batch in slices(batches, next(iter(columns))):
            texts = [blobs(batch, c) for c in columns]
            made = [[memo[t or b""] for t in row] for row in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, pa.string()) for c in zip(*made, strict=True))], names=[*kept, *columns.values()])

    return rows.select(*kept, *columns).mapInArrow(run, schema)


def likeness(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Add columns of likeness between two fingerprint columns; null where either is null."""
    kept = [c for c in rows.columns if c not in pairs]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(c, T.DoubleType()) for c in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(_marks, 16)
        for batch in slices(batches, next(iter(pairs.values()))[0]):
            made = [
                [None if a is None or b is None else likeness_of(a, b, memo.__getitem__) for a, b in zip(strings(batch, x), strings(batch, y), strict=True)]
                for x, y in pairs.values()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, pa.float64()) for c in made)], names=[*kept, *pairs])

    return rows.select(*kept).mapInArrow(run, schema)


def nodes(documents: DataFrame) -> DataFrame:
    """The tree itself: a row per root, section and paragraph with its full hash and byte range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for key, data in zip(batch.column("doc_id").to_pylist(), blobs(batch), strict=True):
                root, parts, hashes, lines = _tree(data or b"")
                spots = [0, *np.cumsum([len(line) for line in lines]).tolist()]
                out.append((key, "root", None, None, root.hex(), 0, spots[-1]))
                for n, (a, b, h) in enumerate(parts):
                    out.append((key, "section", n, None, h.hex(), spots[a], spots[b] - spots[a]))
                    out += [(key, "paragraph", n, i, hashes[i].hex(), spots[i], len(lines[i])) for i in range(a, b)]
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in NODE_SCHEMA.split(", ")])

    return documents.select("doc_id", "text").mapInArrow(run, NODE_SCHEMA)


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paragraphs of ``new`` trees that the ``old`` tree of the same doc_id lacks, found by walking down unlike branches.

    Both are ``nodes`` tables with one tree per doc_id; rows with a null doc_id are not compared.
    """
    changed = new.where("level = 'root'").select("doc_id", "hash").join(old.where("level = 'root'").select("doc_id", F.col("hash").alias("was")), "doc_id").where("hash <> was").select("doc_id")
    unlike = new.where("level = 'section'").join(changed, "doc_id", "left_semi").join(old.where("level = 'section'"), ["doc_id", "hash"], "left_anti").select("doc_id", "section")
    below = new.where("level = 'paragraph'").join(unlike, ["doc_id", "section"], "left_semi")
    return below.join(old.where("level = 'paragraph'"), ["doc_id", "hash"], "left_anti").select("doc_id", "section", "paragraph", "hash", "start", "length")


def with_next(documents: DataFrame) -> DataFrame:
    """Add ``next_text``, that of the next document by ascending doc_id, after the last that of the first.

    Ids are dealt into ranges of about equal counts; the first row of each range goes to the range before as well, so each
    text is shuffled once and nothing is ordered in one task. A null doc_id comes first; rows with the same doc_id are
    ordered by text. Null texts count as empty; a single row is its own next. Column ``text`` comes without nulls.
    """
    low = -(1 << 63)
    spark, parts = documents.sparkSession, shuffle_width(documents.sparkSession)
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_at", F.coalesce("doc_id", F.lit(low)))
    spots = keyed.select(F.percentile_approx("_at", [i / parts for i in range(1, parts)], 10_000) if parts > 1 else F.array().cast("array<long>")).first()[0]
    bounds = sorted({float(s) for s in spots or []})
    split = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_spot", outputCol="_part")

    def dealt(rows: DataFrame) -> DataFrame:
        return split.transform(rows.withColumn("_spot", F.col("_at").cast("double"))).withColumn("_part", F.col("_part").cast("int")).drop("_spot") if bounds else rows.withColumn("_part", F.lit(0))

    firsts = sorted((r[0], r[1]) for r in dealt(keyed.select("_at")).groupBy("_part").agg(F.min("_at")).collect())  # a row per range
    before = [(at, firsts[i - 1][0]) for i, (_, at) in enumerate(firsts)]
    edges = spark.createDataFrame(before, "_at long, _before int") if before else spark.createDataFrame([], "_at long, _before int")
    doubled = dealt(keyed).join(F.broadcast(edges), "_at", "left").withColumn(
        "_copy", F.explode(F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("edge")))).otherwise(
            F.array(F.struct(F.col("_part").alias("part"), F.lit(0).alias("edge")), F.struct(F.col("_before").alias("part"), F.lit(1).alias("edge")))
        ))
    )
    flat = doubled.select("doc_id", "text", "_at", F.col("_copy.part").alias("_part"), F.col("_copy.edge").alias("_edge"))
    order = Window.partitionBy("_part").orderBy("_edge", "_at", "text")
    return flat.withColumn("next_text", F.lead("text").over(order)).where("_edge = 0").select("doc_id", "text", "next_text")
