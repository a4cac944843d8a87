"""Analysis grids: which file holds which (dataset, model, condition), and which conditions are compared."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens import constants as K
from pairlens.operators.guards import require_rows
from pairlens.operators.normalize import normalize_lines
from pairlens.functions.labels import strip
from pairlens.session import data_files, path_exists, settle
from pairlens.sources.readers import require_unique, text_lines


@dataclass(frozen=True)
class Manifest:
    """Checked grid. ``cells`` lists (dataset, model, condition, path)."""

    cells: tuple[tuple[str, str, str, str], ...]
    contrasts: tuple[tuple[str, str], ...]


def load_manifest(spark: SparkSession, path: str) -> Manifest:
    """Read and check a manifest file: a few metadata lines, so this runs on the driver."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    return check_manifest(spark, json.loads(text), os.path.dirname(path))


def check_manifest(spark: SparkSession, content: dict, base: str) -> Manifest:
    listed = content.get("comparisons", [list(c) for c in K.DEFAULT_CONTRASTS])
    for pair in listed:
        if not (isinstance(pair, list) and len(pair) == 2 and all(pair)):
            raise ValueError(f"invalid comparison: {pair!r}")
    contrasts = tuple((str(a), str(b)) for a, b in listed)
    needed = {c for pair in contrasts for c in pair}
    if not isinstance(content.get("cells"), list) or not content["cells"]:
        raise ValueError("a manifest needs a non-empty list of cells")
    cells, seen = [], set()
    for cell in content["cells"]:
        key = tuple(str(cell.get(k) or "").strip() for k in ("dataset", "model"))
        conditions = cell.get("conditions")
        if not all(key) or not isinstance(conditions, dict):
            raise ValueError("a cell needs dataset, model and conditions")
        if key in seen:
            raise ValueError(f"duplicate cell: {key}")
        seen.add(key)
        if needed - set(conditions):
            raise ValueError(f"cell {key} lacks conditions: {sorted(needed - set(conditions))}")
        for name, target in conditions.items():
            full = os.path.expandvars(os.path.expanduser(str(target)))
            if "://" not in full and not os.path.isabs(full):
                full = f"{base}/{full}"
            if not path_exists(spark, full):
                raise FileNotFoundError(f"{key}/{name}: {full}")
            cells.append((*key, str(name), full))
    return Manifest(tuple(cells), contrasts)


def read_grid(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """All files of a manifest as one normalised table with dataset, model and condition.

    One scan of all files, joined to the list of files by path; how is left to its size. Lines are
    parsed once into the shared folder; an empty condition or a repeated item within one is an error.
    """
    files = [(*c[:3], f) for c in manifest.cells for f in data_files(spark, c[3])]
    names = spark.createDataFrame(files, "dataset string, model string, condition string, path string")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    keyed = settle(names.withColumn("_path", plain).drop("path"), "grid-files")
    lines = text_lines(spark, [f[3] for f in files]).where(strip(F.col("value")) != "")
    joined = lines.withColumn("_path", F.regexp_replace("path", r"^file:/*", "/")).join(keyed, "_path")
    rows = normalize_lines(joined.drop("_path", "path", "block"))
    text = F.concat(F.lit("invalid JSON or missing id in "), F.col("file"))
    checked = require_rows(rows, "id", F.col("parsed") & F.col("id").isNotNull(), text).drop("parsed")
    grid = require_unique(settle(checked, "grid"), ["dataset", "model", "condition", "id"], "the manifest")
    # One row per manifest entry.
    found = {tuple(r) for r in grid.select("dataset", "model", "condition").distinct().collect()}
    empty = sorted({c[:3] for c in manifest.cells} - found)
    if empty:
        raise ValueError(f"no records found for {empty}")
    return grid


def condition_args(
    spark: SparkSession, run_dir: str, known: Sequence[str], extra: Sequence[str] = ()
) -> dict[str, str]:
    """Condition files of a run folder plus ``NAME=PATH`` additions; repeats and missing files are errors."""
    found = {n: f"{run_dir}/{n}.jsonl" for n in known if path_exists(spark, f"{run_dir}/{n}.jsonl")}
    for text in extra:
        name, sep, path = (part.strip() for part in text.partition("="))
        if not (sep and name and path):
            raise ValueError(f"expected NAME=PATH: {text!r}")
        if name in found:
            raise ValueError(f"condition given twice: {name}")
        if not path_exists(spark, path):
            raise FileNotFoundError(path)
        found[name] = path
    if not found:
        raise ValueError("no condition files")
    return found


def read_conditions(spark: SparkSession, files: dict[str, str], dataset: str, model: str) -> DataFrame:
    """Those files as one normalised table."""
    cells = tuple((dataset, model, name, path) for name, path in files.items())
    return read_grid(spark, Manifest(cells, ()))
