"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors of cosine c or more lie within a squared distance of 2 - 2c. After a random rotation the coordinates are split
into blocks, each with its share of that budget by its number of coordinates: a pair within the whole budget is within
the share in one block at least. Each block is a range join on a grid over its first coordinates; a point near the upper
side of its cell is also put into the next one, so a pair meets in the cell that is the larger of its two home cells
in each coordinate. A pair counts only there, and only in the first block that finds it, and is then checked exactly.

Equal vectors form a class and go on as one row with a count. Cells are dealt into blocks of bounded size, so a cell
that a third of all vectors share is spread over many tasks. Tasks return sums of links per vector and links that join
components, not pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.llm.common import settle, shuffle_width, slices
from pairlens.llm.components import components

SEED = 77
MEMBERS = 1024
GRID, SIDE = 4, 3.0
SLACK = 1e-9
ROW_SCHEMA = "vec_id long, label string, key binary, vector binary"
FOUND_SCHEMA = "src binary, dst binary, links long"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Subspaces:
    """Rotation, blocks and grids for vectors of one dimension."""

    def __init__(self, size: int, least: float, width: int = 8):
        rng = np.random.default_rng(SEED)
        self._turn = np.linalg.qr(rng.standard_normal((size, size)))[0]
        self.blocks = np.array_split(np.arange(size), max(1, size // width))
        self.budgets = [(2 - 2 * least) * len(b) / size + SLACK for b in self.blocks]
        self._sides = [SIDE * max(np.sqrt(b), 1e-6) for b in self.budgets]
        self._reach = [np.sqrt(b) for b in self.budgets]

    def turned(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self._turn

    def homes(self, turned: np.ndarray, b: int) -> np.ndarray:
        return np.floor(turned[:, self.blocks[b][:GRID]] / self._sides[b]).astype(np.int64)

    def cell(self, labels: np.ndarray, b: int, coordinates: np.ndarray) -> np.ndarray:
        """A number for a cell of a block and label."""
        with np.errstate(over="ignore"):
            h = _mixed(labels.view(np.uint64) + np.uint64(b + 1) * _M2)
            for j in range(coordinates.shape[1]):
                h = _mixed(h * _M1 + coordinates[:, j].view(np.uint64))
        return h.view(np.int64)

    def cells(self, turned: np.ndarray, labels: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the cells that they belong to."""
        home = self.homes(turned, b)
        spots = turned[:, self.blocks[b][:GRID]]
        near = (home + 1) * self._sides[b] - spots <= self._reach[b]
        rows, coordinates = np.arange(len(home)), home
        for j in range(home.shape[1]):
            also = near[rows, j]
            moved = coordinates[also].copy()
            moved[:, j] += 1
            rows, coordinates = np.concatenate([rows, rows[also]]), np.concatenate([coordinates, moved])
        return rows, self.cell(labels[rows], b, coordinates)


def _label_numbers(labels: list[str], sizes: list[int]) -> np.ndarray:
    """A 64-bit number for label and dimension; labels themselves are compared where pairs are checked."""
    return np.array([int.from_bytes(hashlib.blake2b(f"{n} {x}".encode(), digest_size=8).digest(), "little", signed=True) for x, n in zip(labels, sizes, strict=True)], dtype=np.int64)


def _keyed(vectors: DataFrame) -> tuple[DataFrame, type]:
    """Rows with a key per label and vector; key and vector are null where the row links with nothing."""
    single = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "embedding"):
            keys, blobs = [], []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
                part = values.values
                good = label is not None and part is not None and len(part) > 0 and not part.null_count
                x = part.to_numpy(zero_copy_only=False).astype(kind) + kind(0) if good else None  # -0.0 becomes 0.0
                if good and np.isfinite(x).all() and x.any():
                    data = x.tobytes()
                    blobs.append(data)
                    keys.append(hashlib.blake2b(label.encode() + b"\0" + data, digest_size=16).digest())
                else:
                    blobs.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(keys, pa.binary()), pa.array(blobs, pa.binary())], names=["vec_id", "label", "key", "vector"])

    number = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), number.alias("embedding")).mapInArrow(run, ROW_SCHEMA), kind


def _unit(blobs: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # large components must not overflow when squared
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _spread(classes: DataFrame, kind: type, least: float) -> DataFrame:
    """Rows (cell, block, key): the cells of every block that a class belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Subspaces] = {}
        for batch in slices(batches, "vector", 1 << 20):
            keys, labels, blobs = (batch.column(c).to_pylist() for c in ("key", "label", "vector"))
            sizes = np.array([len(b) for b in blobs])
            for size in np.unique(sizes):
                use = np.flatnonzero(sizes == size)
                n = int(size) // np.dtype(kind).itemsize
                space = spaces.setdefault(n, Subspaces(n, least))
                turned = space.turned(_unit([blobs[i] for i in use], kind))
                numbers = _label_numbers([labels[i] for i in use], [n] * len(use))
                for b in range(len(space.blocks)):
                    rows, cells = space.cells(turned, numbers, b)
                    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(rows), b, np.int32)), pa.array([keys[use[i]] for i in rows], pa.binary())], names=["cell", "block", "key"])

    return classes.select("key", "label", "vector").mapInArrow(run, "cell long, block int, key binary")


def _pairs_in(space: Subspaces, unit: np.ndarray, labels: list[str], numbers: np.ndarray, deals: np.ndarray, cross: bool, b: int, cell: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a group that belong to this cell and block and have the cosine."""
    turned = space.turned(unit)
    mine = turned[:, space.blocks[b]]
    square = np.einsum("ij,ij->i", mine, mine)
    distance = square[:, None] + square[None, :] - 2 * (mine @ mine.T)
    left, right = np.nonzero(np.triu(distance <= space.budgets[b] + SLACK, 1))
    names = np.array(labels, dtype=object)
    keep = names[left] == names[right]
    if cross:
        keep &= deals[left] != deals[right]
    left, right = left[keep], right[keep]
    home = space.homes(turned, b)
    found = []
    for at in range(0, len(left), 1 << 15):
        i, j = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
        here = space.cell(numbers[i], b, np.maximum(home[i], home[j])) == cell
        i, j = i[here], j[here]
        gap = (turned[i] - turned[j]) ** 2
        # distances are computed pair by pair here, so that every task decides alike which block is the first
        inside = np.stack([gap[:, s].sum(axis=1) <= limit for s, limit in zip(space.blocks[: b + 1], space.budgets, strict=False)])
        first = inside[b] & ~inside[:b].any(axis=0)
        i, j = i[first], j[first]
        near = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
        found.append((i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def _links(groups: DataFrame, kind: type, least: float) -> DataFrame:
    """Per group: sums of links per class, and links that join what the group has not joined yet."""

    def solve(at: tuple, held: list[tuple], spaces: dict[int, Subspaces]) -> list[tuple]:
        cell, b, lo, hi = at
        keys, deals, counts, labels, blobs = zip(*held, strict=True)
        n = len(blobs[0]) // np.dtype(kind).itemsize
        same = [i for i, x in enumerate(blobs) if len(x) == len(blobs[0])]  # a cell number is of one dimension but for hash accidents
        space = spaces.setdefault(n, Subspaces(n, least))
        unit = _unit([blobs[i] for i in same], kind)
        names = [labels[i] for i in same]
        left, right = _pairs_in(space, unit, names, _label_numbers(names, [n] * len(names)), np.array([deals[i] for i in same]), lo != hi, b, cell, least)
        if not len(left):
            return []
        weight = np.array([counts[i] for i in same])
        links = np.bincount(left, weight[right], len(same)) + np.bincount(right, weight[left], len(same))
        out = [(keys[same[i]], None, int(links[i])) for i in np.flatnonzero(links)]
        up = list(range(len(same)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, j in zip(left.tolist(), right.tolist(), strict=True):
            a, c = top(i), top(j)
            if a != c:
                up[max(a, c)] = min(a, c)
                out.append((keys[same[i]], keys[same[j]], 0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spaces: dict[int, Subspaces] = {}
        at, held = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["src", "dst", "links"])

        for batch in slices(batches, "vector"):
            found = []
            names = ("cell", "block", "lo", "hi", "key", "deal", "n", "label", "vector")
            for cell, b, lo, hi, *member in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if (cell, b, lo, hi) != at:
                    if len(held) > 1:
                        found += solve(at, held, spaces)
                    at, held = (cell, b, lo, hi), []
                held.append(member)
            yield batch_of(found)
        if len(held) > 1:
            yield batch_of(solve(at, held, spaces))

    return groups.mapInArrow(run, FOUND_SCHEMA)


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Link rows of ``vectors(vec_id, embedding, label)`` of equal label whose cosine, in double precision, is ``least`` or more.

    Returns per row: vec_id, n_links (other rows linked directly), component_id (least vec_id reachable, itself included)
    and kept (vec_id = component_id). A vector that is null, empty, zero or holds a null or non-finite component, and a
    row with a null label, stays alone with its own vec_id. Only vectors of one dimension are compared. Rows that repeat
    a vec_id count as rows of their own. A null vec_id never names a component: if no other row does, component_id is null
    and the row is kept.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must lie in (0, 1]")
    keyed, kind = _keyed(vectors)
    rows = settle(keyed, "vectors-rows")
    classes = settle(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")), "vectors-classes")
    spread = settle(_spread(classes, kind, least), "vectors-cells")
    sizes = spread.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("deals"), F.count(F.lit(1)).alias("members")).where("members > 1")
    dealt = spread.join(settle(sizes, "vectors-sizes"), ["cell", "block"]).withColumn("deal", F.pmod(F.xxhash64("key", "cell"), F.col("deals")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("cell", "block", "key", "deal", F.least("deal", "other").alias("lo"), F.greatest("deal", "other").alias("hi"))
    groups = paired.join(classes.select("key", "n", "label", "vector"), "key")
    ordered = groups.repartition(shuffle_width(vectors.sparkSession), "cell", "block", "lo", "hi").sortWithinPartitions("cell", "block", "lo", "hi")
    found = settle(_links(ordered, kind, least), "vectors-found")

    sums = found.groupBy("src").agg(F.sum("links").alias("links")).withColumnRenamed("src", "key")
    roots = components(found.where("dst is not null"), "vectors").withColumnRenamed("id", "key")
    named = classes.select("key", "low", "n").join(sums, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # written before the join, so that a hot root on the other side can be split at run time
    heads = settle(named.groupBy("root").agg(F.min("low").alias("component_id")), "vectors-heads")
    result = settle(named.join(heads, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "vectors-result")
    joined = rows.select("vec_id", "key").join(result, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.expr("vec_id = component_id"), F.col("component_id").isNull()))
