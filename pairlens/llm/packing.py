"""Best-two-fit packing of tokenized documents into sequences of fixed capacity.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the driver. The plan works on it: a bin is
filled greedily with the longest pieces that fit, then its smallest piece is replaced by the two unpacked pieces whose
sum fills the widened gap best, where that is fuller. A bin's pattern repeats for as long as all its lengths last, so
the plan has a few thousand rows however many documents there are. A piece finds its place by its rank among the pieces
of its length; ranks come from counts per (length, hash bucket), so a length that a third of all pieces share is
dealt over all tasks.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlens.llm.common import released, settle, shuffle_width, slices, strings

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids binary"
#: Bytes of ids that a worker holds before they leave, and of texts that it takes at a time.
FLUSH_BYTES, SLICE = 4 << 20, 2 << 20
#: White space as the encoder's pattern has it; its regex engine fails on runs of about a million.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]++")
LONG_RUN = 100_000


def load_encoding(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, run by the faster encoder.

    Both libraries merge the pair of least rank first; this holds only where token ids follow the merge list, which is
    checked here. Strings of added tokens become their ids, as the tokenizers library has it.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    merged = [ranks[bytes(byte_of[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in spec["model"]["merges"]]
    if merged != sorted(merged):
        raise ValueError("token ids do not follow the merge list")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)


def encode(encoding: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids of a text; a long run of blanks goes to the encoder as the one word that its pattern would make of it.

    That word is the run without its last blank, or all of it where the text ends or an added token follows.
    """
    parts, start = [], 0
    if len(text) >= LONG_RUN:
        ends = tuple(encoding.special_tokens_set)
        for run in BLANKS.finditer(text):
            low, high = run.span()
            if high - low >= LONG_RUN:
                if high < len(text) and not (ends and text.startswith(ends, high)):
                    high -= 1
                parts += [encoding.encode_to_numpy(text[start:low], allowed_special="all"), np.array(encoding._encode_single_piece(text[low:high]))]
                start = high
    return np.concatenate([*parts, encoding.encode_to_numpy(text[start:], allowed_special="all")]).astype("<u4")


def pieces(documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Tokenize whole texts, append ``end_id`` and cut what is longer than a sequence.

    Returns one row per piece: doc_id, piece (from 0), start (ids of the document before it), length, and ids as
    little-endian unsigned 32-bit integers. A document longer than ``capacity`` is cut into pieces of that length, the
    first taking the rest. A null text counts as empty and gives the one id ``end_id``; repeated rows each give their
    own pieces; other columns are not read.
    """

    def cut(batches):
        encoding = load_encoding(path)
        out, held = [], 0
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in slices(batches, most=SLICE):
            for key, text in zip(batch.column("doc_id").to_pylist(), strings(batch), strict=True):
                ids = np.append(encode(encoding, text or ""), np.uint32(end_id))
                first = len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for n, start in enumerate(starts):
                    part = ids[start : first if n == 0 else start + capacity]
                    out.append((key, n, start, len(part), part.tobytes()))
                    held += part.nbytes + 64
                    if held >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return documents.select("doc_id", "text").mapInArrow(released(cut), PIECE_SCHEMA)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Plan bins from counts per length: rows (length, first rank, end rank, copies in a bin, first bin, offset in bin).

    The pieces of a row's ranks fill consecutive bins, ``copies`` side by side from ``offset`` on.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a length of {length} does not fit {capacity}")
        left[length] = n
    taken = np.zeros(capacity + 1, dtype=np.int64)
    sizes, plan, bins = np.arange(capacity + 1), [], 0

    def longest(have: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(have > 0, sizes, 0))

    while True:
        have, gap, content = left.copy(), capacity, {}
        under = longest(have)
        while gap and (size := int(under[gap])):
            n = min(int(have[size]), gap // size)
            content[size] = n
            have[size] -= n
            gap -= n * size
            if not have[size]:
                under = longest(have)
        if not content:
            return plan
        small = min(content)
        if gap and sum(content.values()) > 1:
            room = gap + small
            under = longest(have)
            first = np.flatnonzero(have[: room] > 0)
            second = under[room - first]
            alone = (second == first) & (have[first] < 2)
            second = np.where(alone, under[np.maximum(np.minimum(first - 1, room - first), 0)], second)
            total = np.where(second > 0, first + second, 0)
            if len(total) and total.max() > small:
                best = int(total.argmax())
                content[small] -= 1
                for size in (int(first[best]), int(second[best])):
                    content[size] = content.get(size, 0) + 1
                content = {s: n for s, n in content.items() if n}
        times = min(int(left[s]) // n for s, n in content.items())
        offset = 0
        for size, n in sorted(content.items(), reverse=True):
            low = int(taken[size])
            plan.append((size, low, low + times * n, n, bins, offset))
            taken[size] += times * n
            left[size] -= times * n
            offset += n * size
        bins += times


def place(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that hold doc_id, piece and length (1 to ``capacity``).

    All other columns are carried along. ``rows`` is read twice and should be a written table. Sequences hold no gaps and
    offsets start at 0. Equal rows get places of their own. An empty table gives an empty table.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shuffle_width(spark))).cast("int"))
    counts = settle(dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "packing-counts")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    plan = best_two_fit(histogram, capacity)
    slots = spark.createDataFrame(plan, "length long, _low long, _end long, _copies long, _bin long, _at long")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_row", F.row_number().over(within)).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_row") - 1)
    slots = slots.withColumnRenamed("length", "_length")
    # bounded: a pattern has at most sqrt(2 * capacity) lengths and each pattern uses up a length
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_end")))
    nth = F.col("_rank") - F.col("_low")
    return placed.withColumns({
        "sequence_id": F.col("_bin") + F.expr("(_rank - _low) div _copies"),
        "offset": F.col("_at") + (nth % F.col("_copies")) * F.col("length"),
    }).select(*rows.columns, "sequence_id", "offset")


def pack(documents: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their ids and places."""
    return place(settle(pieces(documents, path, capacity, end_id), "packing-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (as in ``pieces``) and the doc_id and length of each piece.

    A group is bounded by the capacity.
    """
    part = F.struct("offset", "doc_id", "length", F.hex("ids").alias("ids"))
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return grouped.select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), "")).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["length"].alias("length"))).alias("parts"),
    )
