"""Shared folder taken from the running session, and small file-system helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` was given.

    Without either, a local session gets one folder of its own; on a cluster that would lose rows, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get()
    application, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="pairlens-")
    return _OWN[application]


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/pairlens/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; tables read from there must not be used afterwards."""
    remove(spark, run_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder once and read it back: later steps and retries start from the files.

    A written table has a known size, by which Spark itself decides whether to broadcast it.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of which one task groups or orders the keys.
GROUP_ROWS = 300_000


def dealt(rows: DataFrame, settled: DataFrame, *keys: str) -> DataFrame:
    """Rows of a settled table dealt by keys into tasks of about ``GROUP_ROWS`` rows, whose number the footers give.

    For keys that hardly repeat: a file split of them may hold millions, which a task would group in memory before the shuffle.
    """
    tasks = max(settled.sparkSession.sparkContext.defaultParallelism, -(-settled.count() // GROUP_ROWS))
    return rows.repartition(tasks, *keys)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on whatever file system the path names."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark takes it to be on."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below a folder, sorted."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted(f.getPath().getName() for f in files)


def data_files(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the data files directly in a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.getFileStatus(hadoop).isDirectory():
        return [path]
    return [f"{path.rstrip('/')}/{n}" for n in list_paths(spark, path) if not n.startswith(("_", "."))]
