"""JSONL, JSON, archive and CSV sources."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens import constants as K
from pairlens.functions.labels import strip
from pairlens.operators.guards import require, require_rows
from pairlens.operators.normalize import normalize_lines, with_record
from pairlens.session import dealt, list_paths, path_exists, settle
from pairlens.sources.arrays import json_values


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def text_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Lines with ``path``, ``file`` and the byte offset of their file split; ``.gz`` is read as is."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def with_line_numbers(lines: DataFrame, wanted: Column | None = None) -> DataFrame:
    """1-based line number within the file, optionally only for wanted rows.

    Rows of one file split have consecutive ids. One small row per split gives its first id and line count; splits
    before it give the offset. No file is ordered in one task.
    """
    numbered = lines.withColumn("_id", F.monotonically_increasing_id())
    splits = numbered.groupBy("path", "block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = numbered if wanted is None else numbered.where(wanted)
    return rows.join(offsets, ["path", "block"]).withColumn(
        "line_number", F.col("_id") - F.col("_first") + F.col("_offset") + 1
    ).drop("_id", "_first", "_offset")


def read_strict(spark: SparkSession, path: str | Sequence[str], per: Sequence[str] = ("path",)) -> DataFrame:
    """Normalised JSONL responses; malformed line, missing id, repeated id or no row at all fail the read.

    Lines are parsed once into a columnar table in the shared folder, without a shuffle. Faults and repeated ids are looked
    for on its key columns only, and every later query reads columns instead of text. Only where there is a fault is the text
    read again, to name the file and line of the first one.
    """
    lines = text_lines(spark, path).where(strip(F.col("value")) != "").drop("block")
    rows = settle(normalize_lines(lines), "strict")
    if not rows.where(_FAULTY).isEmpty():
        raise ValueError(_first_fault(spark, path))
    return require_unique(rows.drop("parsed"), [*per, "id"], str(path))


_FAULTY = "not parsed or id is null"


def _first_fault(spark: SparkSession, path: str | Sequence[str]) -> str:
    """What is wrong with the first faulty line, by path and line number."""
    numbered = with_line_numbers(text_lines(spark, path), strip(F.col("value")) != "")
    bad = normalize_lines(numbered).where(_FAULTY).select("path", "line_number", "parsed").orderBy("path", "line_number").first()
    return f"{'missing item id' if bad.parsed else 'invalid JSON'} in {bad.path}, line {bad.line_number}"


def require_unique(table: DataFrame, keys: Sequence[str], what: str = "input") -> DataFrame:
    """The table itself; an empty table or a repeated key is an error. Reads the key columns of a settled table only."""
    if table.isEmpty():
        raise ValueError(f"no records found in {what}")
    repeated = dealt(table.select(*keys), table, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").first()
    if repeated:
        raise ValueError(f"duplicate item id: {repeated.asDict()}")
    return table


def read_permissive(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Typed JSONL rows; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Typed JSONL rows, or no rows when the path does not exist."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_or_jsonl(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Rows of JSON arrays, JSON objects or JSON lines, decided for each file by all its lines.

    A file whose non-blank lines are JSON values each is read by lines (a line that is an array gives its elements); every
    other file must be one JSON value as a whole, whose elements many tasks read if it is an array, or the read fails.
    Blank files give no rows.
    """
    lines = text_lines(spark, path).select("path", "value").where(strip(F.col("value")) != "")
    kinds = settle(with_record(lines).groupBy("path").agg(F.bool_and(F.col("_v").isNotNull()).alias("by_line")), "json-kinds")
    by_line, whole = kinds.where("by_line").select("path"), kinds.where("not by_line").select("path")
    mixed = not whole.isEmpty()
    found = _typed(lines.join(by_line, "path", "left_semi") if mixed else lines, schema)
    return found.unionByName(_typed(_elements(json_values(spark, path, whole)), schema)) if mixed else found


def _elements(values: DataFrame) -> DataFrame:
    """Elements as arrays of one, so that null and nested arrays mean what they do within their array."""
    return values.select("path", F.when(F.col("element"), F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("value")).alias("value"))


def _typed(texts: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows of JSON texts ``(path, value)``, each an object or an array of objects; any other text fails the read."""
    typed = T.ArrayType(texts.sparkSession.createDataFrame([], schema).schema)
    sound = require_rows(with_record(texts), "value", F.col("_v").isNotNull(), F.concat(F.lit("invalid JSON in "), F.col("path")))
    return sound.select(F.inline(F.from_json("value", typed, {"mode": "FAILFAST"})))


def read_item_bank(spark: SparkSession, path: str) -> DataFrame:
    """Keyed item bank from JSON arrays, which many tasks read: text id, unique, none missing."""
    schema = (
        "id string, item_id string, source string, subject string, question string, "
        "options map<string,string>, correct_answer string, distractor string"
    )
    rows = _typed(_elements(json_values(spark, path)), schema)
    named = rows.withColumn("id", F.coalesce("id", "item_id")).drop("item_id")
    checked = require_rows(named, "id", F.col("id").isNotNull(), "item without id")
    return require_unique(settle(checked, "bank"), ["id"], path)


def read_result_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A comparison CSV back as typed rows."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)


def find_runs(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Run folders whose name matches, with the sample size in their name; smallest first, unknown last."""
    names = spark.createDataFrame([(n,) for n in list_paths(spark, folder)], "run_name string")
    size = F.regexp_extract("run_name", K.RUN_SIZE_PATTERN, 1).try_cast("int")
    return (
        names.where(F.col("run_name").rlike(pattern)).withColumn("n_samples", size)
        .orderBy(F.asc_nulls_last("n_samples"), "run_name")
    )


DIGEST_CHUNK = 1 << 22


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
            local = path.startswith("file:")  # taken as it is, since a URI would need its blanks escaped
            store, inside = (fs.LocalFileSystem(), path.removeprefix("file:")) if local else fs.FileSystem.from_uri(path)
            digest, read = hashlib.md5(usedforsecurity=False), 0
            with store.open_input_stream(inside, compression=None) as stream:
                while chunk := stream.read(DIGEST_CHUNK):
                    digest.update(chunk)
                    read += len(chunk)
            if read != length:
                raise ValueError(f"{path}: {read} bytes read of {length}")
            yield pa.RecordBatch.from_pydict({"path": [path], "length": [length], "md5": [digest.hexdigest()]})


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """MD5 of every file below a path, of any size: the digest's state goes from chunk to chunk of a few MB.

    Spark lists the files (not those without a byte) and deals them over tasks. The path must be on a file system that Arrow reads (local, HDFS, S3, GCS).
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    )
    return files.select("path", "length").repartition("path").mapInArrow(_digests, "path string, length bigint, md5 string")


def text_fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def require_fingerprint(df: DataFrame, md5: str) -> DataFrame:
    """Fails when a file differs from the given MD5."""
    return df.withColumn("md5", require(F.col("md5"), F.col("md5") == md5, "file fingerprint mismatch"))
