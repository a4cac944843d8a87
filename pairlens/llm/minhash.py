"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard checks.

Signatures: a first permutation scatters the shingle bins, a second one, shifted circularly by 0, 1, 2, ... places, gives
all coordinates, so two tables make any number of them. Bands of coordinates give candidate buckets.

Documents with equal shingle sets form a class, found by a 128-bit digest of the set, and only classes go on, so groups of
copies cost one row. In every bucket each class is first checked against a hub, the class that shares most bucket places
with others (in a group of edited copies: their origin). Where a bucket still holds several components after that, its
classes other than the hub are compared block by block, those of its largest component only with the others, and only links
that join components leave a task. So no pair of a bucket goes unchecked unless already connected, and no group is expanded
into pairs.

A set is sent to a check only after its outline, a bitmap a tenth of its size, was there: two outlines bound the number of
common shingles from above, so what they rule out is no link, and the rest is checked on full sets.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from pairlens.llm.common import ByteMemo, blobs, released, settle, shuffle_width, slices
from pairlens.llm.components import components
from pairlens.session import remove

BINS = 1 << 20
SEED = 20_240_607
BLOCK = 256
#: Bytes of a task's cache of word hashes.
WORD_BYTES = 64 << 20
SKETCH_SCHEMA = "doc_id long, n_shingles long, key binary, bands array<long>"
SET_SCHEMA = "doc_id long, key binary, shingles array<long>"
LINK_SCHEMA = "src binary, dst binary"
OUTLINE_SCHEMA = "key binary, n long, outline binary"
PAIR_SCHEMA = "hub binary, key binary"
BLOCK_SCHEMA = "bucket long, key binary, root binary, block int, lo int, hi int"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, size: int):
        self._size, self._words = size, ByteMemo(xxhash.xxh3_64_intdigest, WORD_BYTES)
        self._odd = np.random.default_rng(SEED).integers(1, 1 << 63, size + 1, dtype=np.uint64) | np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """Words are runs of bytes other than white space, A-Z lower-cased; fewer than ``size`` words are one shingle."""
        words = (text or b"").lower().split()
        h = np.fromiter(map(self._words.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self._size, len(words))
        if not k:
            return h
        with np.errstate(over="ignore"):
            total = np.full(len(h) - k + 1, np.uint64(k) * self._odd[-1])
            for i in range(k):
                total = _mixed(total + h[i : len(h) - k + 1 + i] * self._odd[i])
        return np.unique(total)


class Signer:
    """Circulant MinHash: coordinate j of a set is the least ``second[first[bin] + j]`` over its bins."""

    def __init__(self, bands: int, rows: int):
        self._bands, self._rows, k = bands, rows, bands * rows
        rng = np.random.default_rng(SEED + 1)
        self._first = rng.permutation(BINS).astype(np.int32)
        second = rng.permutation(BINS).astype(np.int32)
        self._shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k]]), k)
        self._odd = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self._band = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        spots = self._first[(shingles & np.uint64(BINS - 1)).astype(np.int64)]
        least = None
        for at in range(0, len(spots), 2048):
            part = self._shifted[spots[at : at + 2048]].min(axis=0)
            least = part if least is None else np.minimum(least, part)
        return least

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit bucket number per band; the band's index is part of it."""
        with np.errstate(over="ignore"):
            rows = self.signature(shingles).astype(np.uint64).reshape(self._bands, self._rows)
            total = self._band.copy()
            for i in range(self._rows):
                total = _mixed(total + (rows[:, i] + np.uint64(1)) * self._odd[i])
        return total.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def sketch(documents: DataFrame, size: int = 3, bands: int = 24, rows: int = 5) -> DataFrame:
    """Per row: doc_id, n_shingles, key (digest of the shingle set) and bands; both null where the set is empty."""

    def run(batches):
        shingle, sign = Shingler(size), Signer(bands, rows)
        for batch in slices(batches):
            sets = [shingle(t) for t in blobs(batch)]
            keys = [_digest(s) if len(s) else None for s in sets]
            marks = [sign.bands(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), _lists(marks)],
                names=["doc_id", "n_shingles", "key", "bands"],
            )

    return documents.select("doc_id", "text").mapInArrow(released(run), SKETCH_SCHEMA)


def shingle_sets(documents: DataFrame, size: int) -> DataFrame:
    """Per row with words: doc_id, key and the full shingle set, sorted."""

    def run(batches):
        shingle = Shingler(size)
        for batch in slices(batches):
            sets = [shingle(t) for t in blobs(batch)]
            full = [i for i, s in enumerate(sets) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(full, pa.int64())), pa.array([_digest(sets[i]) for i in full], pa.binary()), _lists([sets[i] for i in full])],
                names=["doc_id", "key", "shingles"],
            )

    return documents.select("doc_id", "text").mapInArrow(released(run), SET_SCHEMA)


def with_keys(rows: DataFrame, size: int) -> DataFrame:
    """Replace ``text`` by ``key``, the digest of its shingle set (null for none); all other columns are kept."""
    kept = [c for c in rows.columns if c not in ("text", "key")]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField("key", T.BinaryType())])

    def run(batches):
        shingle = Shingler(size)
        for batch in slices(batches):
            sets = [shingle(t) for t in blobs(batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())], names=[*kept, "key"])

    return rows.select(*kept, "text").mapInArrow(released(run), schema)


def _arrays(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    lists = batch.column(column)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _links(pairs: list[tuple[bytes, bytes]], names: tuple[str, str] = ("src", "dst")) -> pa.RecordBatch:
    left, right = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=list(names))


def _outline(shingles: np.ndarray) -> bytes:
    """Bitmap of a set, of a power of two of bits: 64, or four to eight for each shingle."""
    bits = 1 << max(6, (4 * len(shingles) - 1).bit_length())
    marks = np.zeros(bits, dtype=bool)
    marks[((shingles >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def _outlines(sets: DataFrame) -> DataFrame:
    """Per set: key, n (its size) and outline."""

    def run(batches):
        for batch in slices(batches, "shingles"):
            values = _arrays(batch, "shingles")
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([len(v) for v in values], pa.int64()), pa.array([_outline(v) for v in values], pa.binary())],
                names=["key", "n", "outline"],
            )

    return sets.select("key", "shingles").mapInArrow(released(run), OUTLINE_SCHEMA)


def _folded(outline: np.ndarray, size: int) -> np.ndarray:
    """The outline that a set has in ``size`` bytes, from one of that size or of twice as many."""
    return outline if len(outline) == size else outline[:size] | outline[size:]


def _may_link(n_left, n_right, bits_left, bits_right, common, least: Fraction):
    """Whether sets of these sizes, with so many bits in outlines of one size and ``common`` of them in both, can be alike.

    Each bit of one set alone stands for a shingle or more of that set alone, so the other shingles are all that both can have.
    """
    most = np.minimum(n_left - (bits_left - common), n_right - (bits_right - common))
    return least.denominator * most >= least.numerator * (n_left + n_right - most)


def _at_hubs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the keys of pairs (hub, key), each ``deal`` of a hub's pairs behind the hub's own row (role 0).

    A hub's pairs are dealt over all tasks. Rows are joined once, for hubs and keys together.
    """
    width = shuffle_width(pairs.sparkSession)
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(width)).cast("int"))
    members = dealt.select("hub", "deal", F.lit(1).alias("role"), "key")
    hubs = dealt.select("hub", "deal").distinct().select("hub", "deal", F.lit(0).alias("role"), F.col("hub").alias("key"))
    return members.union(hubs).join(rows, "key").repartition(width, "hub", "deal").sortWithinPartitions("hub", "deal", "role")


def _likely_pairs(pairs: DataFrame, outlines: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (hub, key) but those whose outlines show that their sets are not alike."""
    num, den = least.numerator, least.denominator

    def run(batches):
        own, n_own, mark = None, 0, np.zeros(0, np.uint8)
        for batch in slices(batches, "outline"):
            found = []
            for hub, role, key, n, outline in zip(*(batch.column(c).to_pylist() for c in ("hub", "role", "key", "n", "outline")), strict=True):
                bits = np.frombuffer(outline, np.uint8)
                if role == 0:
                    own, n_own, mark = hub, n, bits
                    continue
                if own != hub:
                    raise RuntimeError("a member without its hub")
                size = min(len(bits), len(mark))
                if den * min(n, n_own) < num * max(n, n_own):
                    continue
                if max(len(bits), len(mark)) <= 2 * size:
                    a, b = _folded(mark, size), _folded(bits, size)
                    if not _may_link(n_own, n, *(int(np.bitwise_count(x).sum()) for x in (a, b, a & b)), least):
                        continue
                found.append((hub, key))
            yield _links(found, ("hub", "key"))

    return _at_hubs(pairs, outlines).mapInArrow(released(run), PAIR_SCHEMA)


def _star_links(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (hub, key) whose sets are alike. A task holds one hub's set at a time."""
    num, den = least.numerator, least.denominator

    def run(batches):
        own, other = None, np.zeros(0, np.uint64)
        for batch in slices(batches, "shingles"):
            found = []
            for hub, role, key, values in zip(*(batch.column(c).to_pylist() for c in ("hub", "role", "key")), _arrays(batch, "shingles"), strict=True):
                if role == 0:
                    own, other = hub, values.copy()
                    continue
                if own != hub:
                    raise RuntimeError("a member without its hub")
                if den * min(len(values), len(other)) < num * max(len(values), len(other)):
                    continue
                spots = np.minimum(np.searchsorted(other, values), len(other) - 1)
                both = int((other[spots] == values).sum())
                if den * both >= num * (len(values) + len(other) - both):
                    found.append((hub, key))
            yield _links(found)

    return _at_hubs(pairs, sets).mapInArrow(released(run), LINK_SCHEMA)


def _open_pairs(roots: list[bytes], sides: list[int], sizes: np.ndarray, cross: bool, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the components, and the pairs (upper triangle) of different ones whose sizes allow a link; across two sides only, if wanted."""
    n, num, den = len(roots), least.numerator, least.denominator
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    label = np.array([number[r] for r in roots])
    side = np.array(sides)
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    open_pairs = (label[:, None] != label[None, :]) & (den * small >= num * large)
    if cross:
        open_pairs &= side[:, None] != side[None, :]
    return label, open_pairs & (np.arange(n)[:, None] < np.arange(n)[None, :])


def _live(roots: list[bytes], sides: list[int], sizes: list[int], outlines: list[bytes], cross: bool, least: Fraction) -> np.ndarray:
    """Which classes of one block, or of two, have a pair that outlines do not rule out."""
    n = np.array(sizes, dtype=np.int64)
    _, open_pairs = _open_pairs(roots, sides, n, cross, least)
    live = np.zeros(len(n), dtype=bool)
    lengths = np.array([len(o) for o in outlines])
    least_length, most_length = np.minimum.outer(lengths, lengths), np.maximum.outer(lengths, lengths)
    unlike = open_pairs & (most_length > 2 * least_length)
    live |= unlike.any(0) | unlike.any(1)
    for size in np.unique(lengths):
        here = open_pairs & (least_length == size) & (most_length <= 2 * size)
        at = np.flatnonzero(here.any(0) | here.any(1))
        if not len(at):
            continue
        marks = np.stack([_folded(np.frombuffer(outlines[i], np.uint8), size) for i in at])
        common = np.zeros((len(at), len(at)), dtype=np.float32)
        for start in range(0, size, 1024):
            part = np.unpackbits(marks[:, start : start + 1024], axis=1).astype(np.float32)
            common += part @ part.T
        both, own = np.rint(common).astype(np.int64), n[at]
        bits = both.diagonal()
        likely = here[np.ix_(at, at)] & _may_link(own[:, None], own[None, :], bits[:, None], bits[None, :], both, least)
        live[at] |= likely.any(0) | likely.any(1)
    return live


def _joining_links(keys: list[bytes], roots: list[bytes], sides: list[int], values: list[np.ndarray], cross: bool, least: Fraction) -> list[tuple[bytes, bytes]]:
    """Links between components among one block, or across two: counts of common shingles by matrix products."""
    n, num, den = len(keys), least.numerator, least.denominator
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    label, open_pairs = _open_pairs(roots, sides, sizes, cross, least)
    live = np.flatnonzero(open_pairs.any(0) | open_pairs.any(1))
    if not len(live):
        return []
    flat, inverse, counts = np.unique(np.concatenate([values[i] for i in live]), return_inverse=True, return_counts=True)
    owner = np.repeat(live, sizes[live])
    shared = counts > 1
    column = (np.cumsum(shared) - 1)[inverse]
    use = shared[inverse]
    owner, column = owner[use], column[use]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    for at in range(0, int(shared.sum()), 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        part = np.zeros((n, 8192), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        common += part @ part.T
    both = np.rint(common).astype(np.int64)
    linked = open_pairs & (den * both >= num * (sizes[:, None] + sizes[None, :] - both))
    out, up = [], list(range(int(label.max()) + 1))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(label[i]), top(label[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((keys[i], keys[j]))
    return out


def _live_rows(paired: DataFrame, outlines: DataFrame, least: Fraction) -> DataFrame:
    """Rows of ``paired(bucket, key, root, block, lo, hi)`` that have a pair in their group that outlines do not rule out."""
    names = ("bucket", "key", "root", "block", "lo", "hi")
    schema = pa.schema([("bucket", pa.int64()), ("key", pa.binary()), ("root", pa.binary()), ("block", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
    rows = paired.join(outlines, "key").repartition(shuffle_width(paired.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def kept(held):
        _, keys, roots, sides, lows, highs, sizes, marks = map(list, zip(*held, strict=True))
        return [row[:6] for row, live in zip(held, _live(roots, sides, sizes, marks, lows[0] != highs[0], least), strict=True) if live]

    def table(found):
        columns = zip(*found, strict=True) if found else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def run(batches):
        at, held = None, []
        for batch in slices(batches, "outline"):
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "n", "outline")), strict=True):
                group = row[0], row[4], row[5]
                if group != at:
                    if held:
                        found += kept(held)
                    at, held = group, []
                held.append(row)
            yield table(found)
        if held:
            yield table(kept(held))

    return rows.mapInArrow(released(run), BLOCK_SCHEMA)


def _block_links(rest: DataFrame, sets: DataFrame, least: Fraction, outlines: DataFrame | None = None) -> DataFrame:
    """Links that join components within ``rest(bucket, key, root, main, n_main, n_other)``.

    ``main`` is the bucket's largest component, with ``n_main`` classes; its classes are connected already and meet only
    the ``n_other`` others, which meet all. Either kind is dealt into blocks of about ``BLOCK`` classes, and every pair of
    blocks that may hold a link is a group of its own. A bucket of one block's size is one group. Outlines go to all groups,
    sets to what is left there by ``outlines``, which are those of ``sets``.
    """
    width = shuffle_width(rest.sparkSession)
    count = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("key", "bucket"), n).cast("int")
    small = F.col("n_main") + F.col("n_other") <= BLOCK
    own = F.col("root") == F.col("main")
    dealt = rest.withColumn("mains", F.when(small, 0).otherwise(count("n_main"))).withColumn("others", F.when(small, 1).otherwise(count("n_other")))
    block = F.when(small, F.lit(0)).when(own, F.col("others") + deal(F.col("mains"))).otherwise(deal(F.col("others")))
    meets = F.when(own | small, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    paired = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1))).select(
        "bucket", "key", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    )
    live = settle(_live_rows(paired, _outlines(sets) if outlines is None else outlines, least), "minhash-live")
    rows = live.join(sets, "key").repartition(width, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches):
        at, held = None, []
        for batch in slices(batches, "shingles"):
            found = []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "lo", "hi", "key", "root", "block"))
            for bucket, lo, hi, key, root, block, values in zip(*columns, _arrays(batch, "shingles"), strict=True):
                if (bucket, lo, hi) != at:
                    if held:
                        found += _joining_links(*map(list, zip(*held, strict=True)), at[1] != at[2], least)
                    at, held = (bucket, lo, hi), []
                held.append((key, root, block, values.copy()))
            yield _links(found)
        if held:
            yield _links(_joining_links(*map(list, zip(*held, strict=True)), at[1] != at[2], least))

    return rows.mapInArrow(released(run), LINK_SCHEMA)


def _one_per_key(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``rows(key, shingles)`` for each wanted key, without a shuffle of the sets.

    There are other rows only where a doc_id repeats: their numbers are found among the keys alone.
    """
    numbered = settle(rows.withColumn("row", F.monotonically_increasing_id()), "minhash-sets")
    names = numbered.select("row", "key")
    chosen = names.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    surplus = settle(names.select("row").join(chosen.select("row"), "row", "left_anti"), "minhash-surplus")
    return numbered.join(surplus, "row", "left_anti").select("key", "shingles")


def _spent(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            remove(table.sparkSession, folder)


def near_duplicates(documents: DataFrame, size: int = 3, least: Fraction = Fraction(85, 100), bands: int = 24, rows: int = 5) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard likeness of ``least`` or more, over chains of links.

    Returns per row: doc_id, n_shingles, key (16 bytes, equal for equal sets, null for none), root (some key of the group,
    the same for all of it), component_id (least doc_id of the group) and kept (doc_id = component_id). Null, empty and blank texts have the empty set, stay alone and are kept.
    A null doc_id takes part in links but never names a group; its row is not kept unless no row of the group has an id,
    in which case component_id is null and kept is true. Rows that repeat a doc_id count as rows of their own.
    Candidates: a pair at likeness s shares a bucket with probability 1 - (1 - s^rows)^bands, that is 1 - 8e-7 at 0.85.
    """
    wide = settle(sketch(documents, size, bands, rows), "minhash-sketch")
    # bands are nine tenths of a sketch and read once; the rest is kept to the end
    marks = settle(wide.drop("bands"), "minhash-marks")
    bands_of = wide.where("key is not null").groupBy("key").agg(F.first("bands").alias("bands"))
    classes = marks.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least_id"))
    spread = settle(bands_of.select("key", F.explode("bands").alias("bucket")), "minhash-spread")
    _spent(wide)
    # one shuffle of the places; a bucket has at most one narrow row of each class
    shared = settle(spread.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1"), "minhash-shared")
    central = shared.groupBy("key").agg(F.sum("n").alias("weight"))
    ranked = shared.join(central, "key")
    hubs = settle(ranked.groupBy("bucket").agg(F.max(F.struct("weight", "key")).getField("key").alias("hub")), "minhash-hub")
    placed = settle(shared.join(hubs, "bucket"), "minhash-hubs")
    _spent(spread, shared, hubs)
    pairs = settle(placed.where("key <> hub").select("hub", "key").distinct(), "minhash-pairs")

    wanted = settle(classes.select("key", "least_id").join(placed.select("key").distinct(), "key"), "minhash-wanted")
    texts = documents.select("doc_id", "text").join(wanted.select("least_id").distinct(), F.col("doc_id").eqNullSafe(F.col("least_id")), "left_semi")
    found = _one_per_key(shingle_sets(texts, size).select("key", "shingles"), wanted)
    # sets are dealt by key once; what is joined with them comes to where they are
    sets = found.repartition(shuffle_width(documents.sparkSession), "key").persist(StorageLevel.DISK_ONLY)
    sets.count()

    outlines = settle(_outlines(sets), "minhash-outlines")
    likely = settle(_likely_pairs(pairs, outlines, least), "minhash-likely")
    star = settle(_star_links(likely, sets, least), "minhash-star")
    first = components(star, "minhash-first")
    rest = placed.where("key <> hub").join(first.withColumnRenamed("id", "key"), "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    rest = settle(rest, "minhash-rest")
    parts = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    mixed = settle(mixed.select("bucket", F.col("top.root").alias("main"), F.col("top.n").alias("n_main"), (F.col("n") - F.col("top.n")).alias("n_other")), "minhash-mixed")
    more = settle(_block_links(rest.join(mixed, "bucket"), sets, least, outlines), "minhash-more")
    sets.unpersist()
    _spent(placed, pairs, likely, rest, mixed, wanted, found, outlines)
    groups = components(star.union(more), "minhash-groups")

    named = classes.select("key", "least_id").join(groups.withColumnRenamed("id", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    heads = settle(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "minhash-heads")
    of_class = settle(named.join(heads, "root").select("key", "root", "component_id"), "minhash-classes")
    joined = marks.join(of_class, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", "key", "root", component.alias("component_id")).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.col("component_id").isNull()))
