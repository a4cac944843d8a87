"""Prefix trie of conversations, grouped exactly only where a count-min sketch cannot prove a prefix to be alone.

Turns become digests and word counts where their texts lie; texts are never shuffled. Digests are numbered within their
conversation over ranges of (conversation, turn), so that a conversation of any length is spread over tasks, and a prefix has
as digest the exclusive-or of the digests of its turns, each hashed with its depth: it is a running value, and the part of a
later range is completed by the values of the ranges before, of which there is a row per range border. Two 64-bit lanes make
it; unlike prefixes with equal digests are to be feared only from texts made for it.

The sketch has two rows of cells, addressed by the two lanes, that count up to two. A prefix with a cell below two has one
member: it, and so its whole tail, is emitted where it is, with one look at the node above for the head of a tail. All other
prefixes, shared ones and false alarms, are grouped exactly. Sums over subtrees need no walk: a member owns the nodes whose
least member it is, which are those from one depth on, so children, leaves and words saved are plain sums over the members
of a node.

Turns are ordered by turn, null first; turns with equal numbers by the digest of role and text. A null role or text counts
as empty. Rows without a conversation id belong to no conversation and are left out; an empty table has no node, not even a
root. Only the four columns named are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import settle, shuffle_width

WORD = r"[^\x20\x09-\x0D]+"
SHARED_TURNS, FAMILY = 4, 20
#: Cells a sketch row has for each prefix, and at most. A fuller sketch proves less and groups more, with equal results.
CELLS_PER_PREFIX, MOST_CELLS = 8, 1 << 28
#: Cells of a block, the piece in which a sketch is built and merged.
BLOCK = 1 << 18
#: Prefixes whose cells a task packs at a time.
HITS_AT_ONCE = 1 << 19
#: Ids joined to one text, before texts are digested one after another.
IDS_PER_TEXT = 1 << 14
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, a, b, words)``: two halves of a digest of role and text, and the words of the text."""
    rows = conversations.where(F.col(f"`{key}`").isNotNull())
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    out = rows.select(F.col(f"`{key}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return out.select("conv", "turn", half(1).alias("a"), half(16).alias("b"), "words")


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own turns with their number ``own`` (from 1) and range ``part``; and ``(conv, n_own)``.

    Rows are sorted over ranges of (conversation, turn); a conversation that goes on in a later range is numbered on from
    the counts of its earlier ranges.
    """
    width = shuffle_width(rows.sparkSession)
    order = ["conv", F.col("turn").asc_nulls_first(), "a", "b"]
    laid = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    laid = settle(laid.select("conv", "a", "b", "words", "at", F.shiftright("at", 33).cast("int").alias("part")), "trie-laid")
    ranges = laid.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.expr("sum(n) over (partition by conv order by part) - n")
    ranges = settle(ranges.withColumn("before", before), "trie-ranges")
    own = laid.join(ranges.select("conv", "part", "first", "before"), ["conv", "part"]).select("conv", "part", (F.col("at") - F.col("first") + F.col("before") + 1).alias("own"), "a", "b", "words")
    return own, ranges.groupBy("conv").agg(F.sum("n").alias("n_own"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, ``(conv, part, depth, a, b, words)``, and ``(conv, length)`` of all of them.

    Conversation c starts with the first h turns of conversation c - c % 20, followed by its own turns after its first h.
    """
    own, counts = numbered(rows)
    own = settle(own, "trie-own")
    counts = counts.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("lead", F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED_TURNS)
    bases = counts.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    counts = counts.join(bases, "base", "left").withColumn("led", F.least(F.col("lead"), F.coalesce("n_base", F.lit(0))))
    counts = settle(counts.withColumn("length", F.col("led") + F.greatest(F.col("n_own") - F.col("lead"), F.lit(0))), "trie-counts")
    heads = own.where((F.col("conv") % FAMILY == 0) & (F.col("own") < SHARED_TURNS)).select(F.col("conv").alias("base"), F.col("own").alias("depth"), "a", "b", "words")
    # three rows a base at most, and twenty conversations a base
    led = counts.where("led > 0").join(settle(heads, "trie-heads"), "base").where("depth <= led").select("conv", F.lit(-1).alias("part"), "depth", "a", "b", "words")
    kept = own.join(counts.select("conv", "lead", "led"), "conv").where("own > lead")
    kept = kept.select("conv", "part", (F.col("own") - F.col("lead") + F.col("led")).alias("depth"), "a", "b", "words")
    return led.union(kept), counts.select("conv", "length")


def with_prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(conv, depth, x, y, px, py, words, before, last)``: digests of the prefix and of the one above, words above.

    The lanes of the prefix above a first turn are null.
    """
    lane = lambda n, c: F.xxhash64(F.lit(n), F.col("depth"), F.col(c))
    rows = rows.select("conv", "part", "depth", lane(1, "a").alias("u"), lane(2, "b").alias("v"), "words")
    within = "over (partition by conv, part order by depth)"
    rows = settle(rows.select("*", F.expr(f"bit_xor(u) {within} as x"), F.expr(f"bit_xor(v) {within} as y"), F.expr(f"sum(words) {within} as upto")), "trie-within")
    sums = rows.groupBy("conv", "part").agg(F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"), F.sum("words").alias("w"))
    over = "over (partition by conv order by part rows between unbounded preceding and 1 preceding)"
    carried = sums.select("conv", "part", F.expr(f"bit_xor(u) {over} as cu"), F.expr(f"bit_xor(v) {over} as cv"), F.expr(f"sum(w) {over} as cw")).where("cu is not null")
    rows = rows.join(settle(carried, "trie-carried"), ["conv", "part"], "left").join(lengths, "conv")
    zero = F.lit(0).cast("long")
    x, y = (F.col(c).bitwiseXOR(F.coalesce(k, zero)) for c, k in (("x", "cu"), ("y", "cv")))
    deeper = F.col("depth") > 1
    return rows.select(
        "conv", "depth", x.alias("x"), y.alias("y"), F.when(deeper, x.bitwiseXOR(F.col("u"))).alias("px"), F.when(deeper, y.bitwiseXOR(F.col("v"))).alias("py"),
        "words", (F.col("upto") - F.col("words") + F.coalesce("cw", zero)).alias("before"), (F.col("depth") == F.col("length")).alias("last"),
    )


class Sketch:
    """Which cells of two rows have been hit twice or more, a bit a cell."""

    def __init__(self, cells: int, blocks: dict[int, bytes]):
        self._mask, self._bits = np.int64(cells - 1), np.zeros(2 * cells // 8, np.uint8)
        size = min(BLOCK, 2 * cells) // 8
        for n, bits in blocks.items():
            self._bits[n * size : (n + 1) * size] = np.frombuffer(bits, np.uint8)

    def shared(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the least of a prefix's two cells is two or more; if not, it has one member."""
        return self._twice(x & self._mask) & self._twice((y & self._mask) + self._mask + 1)

    def _twice(self, cell: np.ndarray) -> np.ndarray:
        return (self._bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def sketch_cells(prefixes: int) -> int:
    """Cells of a row: a power of two, eight bits at least."""
    return min(MOST_CELLS, 1 << max(3, math.ceil(math.log2(max(1, prefixes * CELLS_PER_PREFIX)))))


def build_sketch(prefixes: DataFrame, cells: int) -> Sketch:
    """Count-min sketch of (x, y) pairs with cells that stop at two, merged block by block.

    A task sends the cells that its rows hit, packed per block; a block of cells is merged by one task. What the driver
    gathers is a bit a cell, 64 MB at most.
    """
    block = min(BLOCK, 2 * cells)

    names, kinds = ["block", "cells", "often"], (pa.int64(), pa.binary(), pa.binary())

    def packed(lanes: list[np.ndarray]) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(lanes), return_counts=True)
        cuts = np.flatnonzero(np.diff(found // block)) + 1
        parts = [(p, o) for p, o in zip(np.split(found, cuts), np.split(times, cuts), strict=True) if len(p)]
        out = [[int(p[0] // block) for p, _ in parts], [(p % block).astype("<u4").tobytes() for p, _ in parts], [(o > 1).astype(np.uint8).tobytes() for _, o in parts]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lanes, held = [], 0
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            lanes += [x & (cells - 1), (y & (cells - 1)) + cells]
            held += len(x)
            if held >= HITS_AT_ONCE:
                yield packed(lanes)
                lanes, held = [], 0
        if held:
            yield packed(lanes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, None
        done = lambda: pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), "bits": pa.array([np.packbits(counts > 1).tobytes()], pa.binary())})
        for batch in batches:
            for number, hits, often in zip(*(batch.column(c) for c in ("block", "cells", "often")), strict=True):
                if number.as_py() != at:
                    if at is not None:
                        yield done()
                    at, counts = number.as_py(), np.zeros(block, np.uint8)
                where = np.frombuffer(hits.as_py(), "<u4")
                counts[where] = np.minimum(2, counts[where] + 1 + np.frombuffer(often.as_py(), np.uint8))
        if at is not None:
            yield done()

    hits = prefixes.select("x", "y").mapInArrow(hit, "block long, cells binary, often binary")
    blocks = hits.repartition(shuffle_width(prefixes.sparkSession), "block").sortWithinPartitions("block").mapInArrow(merge, "block long, bits binary")
    return Sketch(cells, {r.block: bytes(r.bits) for r in blocks.collect()})


def screened(prefixes: DataFrame, sketch: Sketch) -> DataFrame:
    """Add ``shared`` and ``above``: whether the sketch lets the prefix, and the one above it, have several members."""
    known = prefixes.sparkSession.sparkContext.broadcast(sketch)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prefixes.schema)}, shared boolean, above boolean"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = [batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("x", "y", "px", "py")]
            marks = [pa.array(known.value.shared(*lanes[:2])), pa.array(known.value.shared(*lanes[2:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, "shared", "above"])

    return prefixes.mapInArrow(look, schema)


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``(x, y, ends_sha256)`` from ``(x, y, conv)``: the digest of a node's ids, ascending, joined by commas.

    Ids are sorted over ranges of (node, id), where tasks join them to texts of bounded length; the digest of a node then
    reads a row per text, in order, and holds one of them.
    """
    width = shuffle_width(ends.sparkSession)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        names = ("x", "y", "first", "ids")
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out = []
            for x, y, conv in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "conv")), strict=True):
                if (x, y) != node or len(ids) >= IDS_PER_TEXT:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (x, y), []
                ids.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*node, ids[0], ",".join(map(str, ids))), kinds, strict=True)], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names, kinds = ("x", "y", "ends_sha256"), (pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            out = []
            for x, y, text in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("ids"), strict=True):
                if (x, y) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (x, y), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*node, state.hexdigest()), kinds, strict=True)], names=names)

    order = ["x", "y", "conv"]
    texts = ends.select(*order).repartitionByRange(width, *order).sortWithinPartitions(*order).mapInArrow(join, "x long, y long, first long, ids string")
    return texts.repartition(width, "x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(digest, "x long, y long, ends_sha256 string")


def trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: ``conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256``."""
    rows, lengths = rebuilt(settle(turns(conversations, key, turn, role, text), "trie-turns"))
    lengths = settle(lengths, "trie-lengths")
    prefixes = settle(with_prefixes(rows, lengths), "trie-prefixes")
    sketch = build_sketch(prefixes, sketch_cells(prefixes.count()))
    marked = settle(screened(prefixes, sketch), "trie-marked")
    total = lengths.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.max("length").alias("longest")).first()
    if not total.n:
        return _node(marked, F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit("")).limit(0)

    own_end = F.when(F.col("last"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(NO_ENDS))
    alone = marked.where("not shared")
    head = F.col("px").isNotNull() & F.col("above")
    tails = _node(
        alone.where(~head), F.when(F.col("px").isNull(), F.lit(total.least)).otherwise(F.col("conv")), F.lit(1), (~F.col("last")).cast("long"), F.lit(1), F.lit(0), own_end,
    )
    grouped, shared = _shared(marked, total.least)
    above = grouped.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("up"))
    heads = settle(alone.where(head), "trie-heads-of-tails").join(above, ["px", "py"])
    heads = _node(heads, F.col("up"), F.lit(1), (~F.col("last")).cast("long"), F.lit(1), F.lit(0), own_end)

    # the root's sums are those of the nodes below
    below = grouped.agg(
        F.count(F.when(F.col("depth") == 1, 1)).alias("children"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    ).first()
    beside = marked.where("not shared").agg(F.count(F.when(F.col("depth") == 1, 1)).alias("children"), F.count(F.when(F.col("last"), 1)).alias("leaves")).first()
    silent = lengths.where("length = 0").select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "conv")
    stops = settle(digests_of_ends(silent), "trie-silent").first()
    root = lengths.sparkSession.range(1).select(
        F.lit(total.least).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total.n).cast("long").alias("n_convs"),
        F.lit(below.children + beside.children).cast("long").alias("n_children"), F.lit((below.leaves + beside.leaves) or 1).cast("long").alias("n_leaves"),
        F.lit(below.saved or 0).cast("long").alias("saved_tokens"), F.lit(stops.ends_sha256 if stops else NO_ENDS).alias("ends_sha256"),
    )
    return root.unionByName(tails).unionByName(heads).unionByName(shared)


def _node(rows: DataFrame, parent: Column, n: Column, children: Column, leaves: Column, saved: Column, ends: Column) -> DataFrame:
    long = {"parent_conv_id": parent, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved}
    return rows.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), *(c.cast("long").alias(k) for k, c in long.items()), ends.alias("ends_sha256"))


def _shared(marked: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Nodes that may have several members, grouped exactly: with their figures, and as rows of the result."""
    possible = settle(marked.where("shared").drop("shared", "above"), "trie-possible")
    nodes = settle(possible.groupBy("x", "y").agg(F.min("conv").alias("low"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("last"), 1)).alias("stops")), "trie-nodes")
    members = settle(possible.join(nodes, ["x", "y"]), "trie-members")
    # a conversation owns the nodes from the first of which it is the least member; the head of a tail is its own
    owned = members.where("low = conv").select("conv", "depth", "before")
    first_alone = marked.where("not shared and px is not null and above").select("conv", "depth", "before")
    firsts = owned.union(first_alone).groupBy("conv").agg(F.min(F.struct("depth", "before")).alias("own"))
    ends = members.where("last").select("conv", (F.col("before") + F.col("words")).alias("total"), ((F.col("low") == F.col("conv")) & (F.col("n") == F.col("stops"))).alias("leaf"))
    facts = settle(firsts.join(ends, "conv", "full").select("conv", F.col("own.depth").alias("from"), F.coalesce("own.before", "total").alias("until"), F.coalesce("leaf", F.lit(True)).alias("leaf")), "trie-facts")
    later = F.col("from").isNull() | (F.col("from") > F.col("depth"))
    grouped = members.join(facts, "conv").groupBy("x", "y").agg(
        F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.first("px").alias("px"), F.first("py").alias("py"), F.first("words").alias("words"), F.count(F.lit(1)).alias("n_convs"),
        F.count(F.when(~F.col("last") & (F.col("from") <= F.col("depth") + 1), 1)).alias("n_children"), F.count(F.when(F.col("leaf"), 1)).alias("n_leaves"),
        F.sum(F.when(later, F.col("until") - F.col("before")).otherwise(F.lit(0))).alias("saved_tokens"),
    )
    grouped = settle(grouped, "trie-grouped")
    above = grouped.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("up"))
    stops = settle(digests_of_ends(settle(members.where("last").select("x", "y", "conv"), "trie-ends")), "trie-stops")
    rows = grouped.join(above, ["px", "py"], "left").join(stops, ["x", "y"], "left")
    # a node above that is not among them has one member, the same
    parent = F.when(F.col("depth") == 1, F.lit(least)).otherwise(F.coalesce("up", "conv"))
    ends = F.coalesce("ends_sha256", F.lit(NO_ENDS))
    return grouped, _node(rows, parent, F.col("n_convs"), F.col("n_children"), F.col("n_leaves"), F.col("saved_tokens"), ends)
