"""JSON arrays cut by many tasks: against the standard library, with ranges of a few bytes, and what is no array."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from pairlens.sources import arrays as AR
from pairlens.sources import readers as R

AWKWARD = ['a,b', '"', '\\', '\\\\"', '],[', '{', '}', "\\,\"", "é,ü", "", ",", "\n", "[1,2]", "\u2028", "x" * 700, "\\" * 9]


def rows_of(seed: int, n: int) -> list[dict]:
    rng = random.Random(seed)
    return [{"k": i, "text": "".join(rng.choices(AWKWARD, k=rng.randint(0, 4))), "deep": {"l": [rng.choice(AWKWARD), {"m": [i, [i]]}]}} for i in range(n)]


def values_of(found) -> dict[str, list]:
    out: dict[str, list] = {}
    for r in found.collect():
        out.setdefault(r.path.rsplit("/", 1)[-1], []).append((r.element, json.loads(r.value)))
    return out


def test_scanner_against_a_plain_loop_in_windows_of_any_size():
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.choices(b'"\\,[]a', k=60))
        wanted, inside, escaped = [], 0, False
        for byte in data:
            if byte == 34 and not escaped:
                inside ^= 1
            escaped = byte == 92 and not escaped
            wanted.append(inside)
        scanner, got, at = AR._Scanner(), [], 0
        while at < len(data):
            step = rng.randint(1, 9)
            got += scanner.scan(np.frombuffer(data[at : at + step], dtype=np.uint8)).tolist()
            at += step
        assert got == wanted


def test_arrays_on_one_line_and_on_many_in_small_ranges(spark, tmp_path, small_ranges):
    wanted = {}
    for k, (n, indent) in enumerate([(60, None), (60, 2), (1, 1), (0, None), (3, None)]):
        wanted[f"{k}.json"] = rows_of(k, n)
        (tmp_path / f"{k}.json").write_text(json.dumps(wanted[f"{k}.json"], indent=indent, ensure_ascii=False) + "\n" * k, encoding="utf-8")
    (tmp_path / "blank.json").write_text(" \n\n")
    (tmp_path / "mark.json").write_bytes(b"\xef\xbb\xbf [null, 7 ,\"a,b\"]")
    (tmp_path / "object.json").write_text(json.dumps({"a": [1, 2], "b": "x,y" * 300}, indent=1))
    assert AR._pieces(spark, str(tmp_path / "1.json")).select("block").distinct().count() > 8
    found = AR.json_values(spark, str(tmp_path))
    got = values_of(found)
    for name, rows in wanted.items():
        assert sorted((v["k"] for _, v in got.get(name, [])), key=int) == [r["k"] for r in rows]
        assert {json.dumps(v) for _, v in got.get(name, [])} == {json.dumps(r) for r in rows}
    assert sorted(map(str, got["mark.json"])) == sorted(map(str, [(True, None), (True, 7), (True, "a,b")]))
    assert got["object.json"] == [(False, {"a": [1, 2], "b": "x,y" * 300})]
    assert "blank.json" not in got and "3.json" not in got


@pytest.mark.parametrize("text", ["[1, 2", "[1, 2],", "[1,, 2]", "[1, ]", "[,1]", '["a]', "[1], [2]", "[1] [2]", "[{]}", "[1]]", "{\"a\": 1", "1, 2"])
def test_what_is_no_json_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text + "\n" if not text.endswith("],") else text)
    with pytest.raises(Exception, match="invalid JSON|MALFORMED|Malformed"):
        R.read_json_or_jsonl(spark, str(tmp_path), "a int").collect()


def test_one_array_is_read_by_many_tasks_into_typed_rows(spark, tmp_path, small_ranges):
    rows = rows_of(9, 300)
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=1), encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    got = R.read_json_or_jsonl(spark, str(tmp_path), "k int, text string, deep struct<l: array<string>>").collect()
    assert sorted((r.k, r.text) for r in got) == sorted([(r["k"], r["text"]) for r in rows] * 2)


def test_item_bank_from_an_array_in_small_ranges(spark, tmp_path, small_ranges):
    items = [{"item_id" if i % 2 else "id": f"i{i}", "question": f"q, \"{i}\"", "options": {"A": "[", "B": "}"}, "correct_answer": "A", "distractor": "B"} for i in range(50)]
    (tmp_path / "bank.json").write_text(json.dumps(items, indent=2))
    got = {r.id: r for r in R.read_item_bank(spark, str(tmp_path)).collect()}
    assert set(got) == {f"i{i}" for i in range(50)} and got["i3"].options == {"A": "[", "B": "}"} and got["i4"].question == 'q, "4"'
    (tmp_path / "bank.json").write_text(json.dumps([*items, items[0]]))
    with pytest.raises(ValueError, match="duplicate item id"):
        R.read_item_bank(spark, str(tmp_path))
