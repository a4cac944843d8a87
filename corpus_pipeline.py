"""From raw documents to packed token sequences, in five stages.

Each stage takes what the one before kept; a run writes every stage's rows to the shared folder and reads them back, so a
lost executor costs one stage's tasks at most. A stage's rows must be written before the next stage is called, which
deletes the working tables of the one before. One pipeline at a time runs in a session. All stages but the last return the columns of the documents. Rows may
repeat, ids may be null, and columns beyond ``doc_id text lang source`` travel along under whatever names they have.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import language, minhash, packing, pii, quality
from pairlens.llm.common import read, settle
from pairlens.session import list_paths, path_exists, remove, run_dir

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SURROGATE_KEY = "surrogates of the pipeline"
SHINGLE, LEAST = 5, Fraction(8, 10)


_SPENT: dict[str, set[str]] = {}


def _stage(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that first deletes the working tables of the one before, whose rows have been written by then.

    The first stage deletes nothing, so that what an earlier run returned can still be read.
    """

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application, base = spark.sparkContext.applicationId, run_dir(spark)
        spent = _SPENT.pop(application, set())
        if fn.__name__ != "identify_language":
            for name in spent:
                remove(spark, f"{base}/{name}")
        before = set(list_paths(spark, base)) if path_exists(spark, base) else set()
        out = fn(spark, docs, sf_dir)
        _SPENT[application] = (set(list_paths(spark, base)) if path_exists(spark, base) else set()) - before
        return out

    return run_stage


def _whole(docs: DataFrame) -> DataFrame:
    """All columns as one, beside what a stage works on."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", *(c for c in ("source",) if c in docs.columns))


def _rows(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised; models are learned from the rows with a language."""
    model = language.fit(docs)
    beside = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), "text")
    kept = language.identify(beside, model, keep=("row", "text")).where("not rejected")
    return kept.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


@_stage
def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose posterior of being good, with that of their site, is low."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    host, path = quality.site_of(F.col("source"))
    scored = settle(quality.evidence(_whole(docs).select("row", "text", host.alias("host"), path.alias("path")), model), "pipeline-evidence")
    return _rows(quality.posteriors(scored, model).where("not rejected"), docs)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, that of least id; texts without words are groups of their own.

    Where ids are null or repeat, rows are told apart by their shingle sets, and of rows that share both one stays. A
    group without any id keeps one row.
    """
    groups = settle(minhash.near_duplicates(docs, SHINGLE, LEAST), "pipeline-groups")
    winners = groups.where("kept and key is not null").groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("w"))
    winners = winners.select("w.doc_id", "w.key")
    ids = groups.agg(F.count(F.lit(1)), F.count("doc_id"), F.expr("count(distinct doc_id)")).first()
    if ids[0] == ids[1] == ids[2]:
        kept = winners.select("doc_id").union(groups.where("key is null").select("doc_id"))
        return docs.join(kept, "doc_id", "left_semi")
    keyed = minhash.with_keys(_whole(docs).select("row", "doc_id", "text"), SHINGLE)
    first = keyed.where("key is not null").groupBy("doc_id", "key").agg(F.first("row").alias("row"))
    left, right = first.alias("l"), winners.alias("r")
    chosen = left.join(right, F.expr("l.doc_id <=> r.doc_id and l.key = r.key"), "left_semi")
    return _rows(chosen.select("row").union(keyed.where("key is null").select("row")), docs)


@_stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give personal data surrogates."""
    return pii.replace(docs, SURROGATE_KEY)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and places in sequences of 1024."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language", identify_language),
    ("quality", filter_quality),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("packing", pack_sequences),
]

#: Language models, classifiers and tokenizers have no form in SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
