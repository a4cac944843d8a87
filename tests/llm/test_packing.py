from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pairlens.llm import packing
from pairlens.llm.queries import QUERIES, TOKENIZER


def expected_pieces(texts, capacity=1024):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for key, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            yield key, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())


def check_layout(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_query_against_tokenizers(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op5_best_two_fit"](spark, folder).collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(expected_pieces(texts))
    bins = check_layout(rows, 1024)
    assert bins <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


ODD = [
    (1, None), (2, ""), (3, "   \n\t  "), (4, "a<|endoftext|> b <|endoftext|>"), (5, "x" * 9000), (6, "naïve 🙂 'll're don't  z"),
    (7, "word " * 5000), (7, "word " * 5000), (None, "no id"), (8, "12 345   6789\r\n\r\n  end"),
]


def test_odd_rows_and_extra_columns(spark):
    table = spark.createDataFrame([(k, t, 5, 6) for k, t in ODD], "doc_id long, text string, length int, offset int")
    packed = packing.pack(table, TOKENIZER, 64)
    rows = packed.collect()
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows)
    assert got == sorted((-1 if k is None else k, *rest) for k, *rest in expected_pieces(ODD, 64))
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    check_layout(rows, 64)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in rows:
        assert bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).collect() == []


def test_a_bin_gets_two_for_its_smallest():
    # greedy gives 6 + 2 with 2 to spare; two threes less... the smallest (2) makes way for 2 + 2
    plan = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)
    first = [(r[0], r[3]) for r in plan if r[4] == 0]
    assert sum(size * n for size, n in first) == 10


def first_fit_decreasing(counts, capacity):
    """Sequences that a plain packing needs, by the room that is left in those begun, the least that fits first."""
    rooms = [0] * (capacity + 1)
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            room = next((r for r in range(size, capacity + 1) if rooms[r]), None)
            if room is None:
                room = capacity
                rooms[room] += 1
            rooms[room] -= 1
            rooms[room - size] += 1
    return sum(rooms)


@settings(max_examples=200, deadline=None)
@example({21: 9})
@example({1: 1, 14: 9, 27: 10})
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 50), min_size=1))
def test_plan_places_every_piece_once(counts):
    bins, ranks = {}, {}
    for size, low, end, copies, first, offset in packing.best_two_fit(counts, 40):
        for rank in range(low, end):
            bins.setdefault(first + (rank - low) // copies, []).append((offset + (rank - low) % copies * size, size))
        ranks.setdefault(size, []).extend(range(low, end))
    assert {s: len(r) for s, r in ranks.items()} == counts
    assert all(sorted(r) == list(range(counts[s])) for s, r in ranks.items())
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 40
    assert len(bins) <= 1.05 * first_fit_decreasing(counts, 40) + 2


def test_unfit_length_is_refused():
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_long_runs_of_blanks(monkeypatch):
    encoding = packing.load_encoding(TOKENIZER)
    for blanks in (" " * 2_000_000, "\n" * 2_000_000):
        ids = packing.encode(encoding, f"a{blanks}b c")
        assert encoding.decode(ids.tolist()) == f"a{blanks}b c"
    special = sorted(encoding.special_tokens_set)[0]
    texts = [f"{a}{b}{c}" for a in ("", "x", special) for b in (" " * 40, "\n" * 40, " \n\t" * 13, "\u3000 " * 20) for c in ("", "y z", "1", "'s", special, "\x1c" * 30 + "q")]
    whole = [encoding.encode(t, allowed_special="all") for t in texts]
    monkeypatch.setattr(packing, "LONG_RUN", 20)
    assert [packing.encode(encoding, t).tolist() for t in texts] == whole
