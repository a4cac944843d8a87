"""Archives as streams of lines: against the standard library, cut off at every place, and longer than what is held."""

from __future__ import annotations

import gzip
import io
import tarfile

import pytest

from pairlens.plans import reports as RP
from pairlens.sources import archives as AR


def packed(members, form=tarfile.PAX_FORMAT, end=True):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            archive.addfile(info, io.BytesIO(data))
    return out.getvalue()


MEMBERS = [
    ("run/exp1.jsonl", b'{"id": 1}\n\n  \n{"id": "\xc3\xa9\xff"}\r\nlast without end'), ("run/notes.txt", bytes(range(256)) * 9), ("run/other.jsonl", b"x\n"),
    ("run/" + "deep/" * 60 + "exp2.jsonl", b"a\n" * 3000), ("exp3.jsonl", b""), ("run/exp4.jsonl", b"\n\n\n"), ("exp5.jsonl", b"z" * 100_000 + b"\nend\n"),
]


def wanted(members):
    found = []
    for name, data in members:
        base = name.rsplit("/", 1)[-1]
        if base.startswith("exp") and base.endswith(".jsonl"):
            found += [(name, n, line.rstrip(b"\r\n").decode("utf-8", "replace")) for n, line in enumerate(io.BytesIO(data), 1)]
    return sorted(found)


def lines_of(data: bytes, path="x/a.tar.gz"):
    return list(AR._lines(path, iter(data[:-1].split(b"\n") if data.endswith(b"\n") else data.split(b"\n"))))


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
def test_members_as_the_standard_library_reads_them(spark, tmp_path, form):
    for k in range(3):
        (tmp_path / f"{k}.tar.gz").write_bytes(gzip.compress(packed(MEMBERS, form)))
    (tmp_path / "plain.jsonl.gz").write_bytes(gzip.compress(b"one\n\ntwo"))
    rows = AR.read_archives(spark, str(tmp_path)).collect()
    for k in range(3):
        assert sorted((r.file, r.line_number, r.value) for r in rows if r.path.endswith(f"/{k}.tar.gz")) == wanted(MEMBERS)
    assert [(r.file, r.line_number, r.value) for r in rows if r.path.endswith("plain.jsonl.gz")] == [("plain.jsonl.gz", 1, "one"), ("plain.jsonl.gz", 2, ""), ("plain.jsonl.gz", 3, "two")]


def test_an_archive_cut_off_anywhere_gives_what_it_holds_and_a_fault():
    members = [("exp1.jsonl", b"".join(b"line %d\n" % i for i in range(200))), ("exp2.jsonl", b"other\n" * 10)]
    data = packed(members)
    first = [(f"line {i}") for i in range(200)]
    for cut in [600, 700, 1111, 512 + len(members[0][1]), 2500, 3072, 3100]:
        rows = lines_of(data[:cut])
        assert rows[-1][4].startswith("broken archive"), cut
        got = [r[3] for r in rows[:-1] if r[1] == "exp1.jsonl"]
        whole = data[512:cut].count(b"\n")
        assert got[: min(whole, 200)] == first[: min(whole, 200)]
        assert len(got) <= 200 and [r[2] for r in rows[:-1] if r[1] == "exp1.jsonl"] == list(range(1, len(got) + 1))
    assert all(r[4] is None for r in lines_of(data))


def test_cut_gzip_and_noise(spark, tmp_path):
    whole = gzip.compress(packed([("exp1.jsonl", b"".join(b"%d line\n" % (i * 7919 % 100_003) for i in range(20_000)))]))
    (tmp_path / "a.tar.gz").write_bytes(whole[: len(whole) // 2])
    rows = AR.archive_lines(spark, str(tmp_path)).collect()
    assert sum(r.fault is not None for r in rows) == 1 and 1000 < len(rows) < 20_000
    with pytest.raises(Exception, match="broken archive"):
        AR.read_archives(spark, str(tmp_path)).collect()


def test_nothing_is_held_whole(tmp_path):
    """A member far longer than what a task holds, from a generator: memory stays that of a few blocks."""
    import tracemalloc

    n, line = 400_000, b"x" * 60
    info = tarfile.TarInfo("exp1.jsonl")
    info.size = n * 61
    head = info.tobuf(tarfile.PAX_FORMAT)

    def rows():
        yield head + line
        for _ in range(n - 1):
            yield line
        yield b"\0" * (-info.size % 512 + 1024)

    tracemalloc.start()
    count = sum(1 for r in AR._lines("a.tar.gz", rows()) if r[4] is None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n and peak < 2 << 20


def test_what_is_written_is_read(spark, tmp_path):
    rows = [(f"run/exp{k}.jsonl", n, f"{k} é {n}") for k in range(9) for n in range(1, 40 + k)] + [("exp_cut.jsonl", n, "cut") for n in range(1, 5)] + [("notes.txt", 1, "no")]
    table = spark.createDataFrame(rows, "file string, line_number long, value string")
    from pyspark.sql import functions as F

    AR.write_archives(table, str(tmp_path / "out"), 3, F.col("file") == "exp_cut.jsonl")
    got = AR.archive_lines(spark, str(tmp_path / "out")).collect()
    assert sorted((r.file, r.line_number, r.value) for r in got if not r.fault) == sorted(r for r in rows if r[0] != "notes.txt")
    assert [r.file for r in got if r.fault] == ["exp_cut.jsonl"]
    names = set()
    for part in (tmp_path / "out").glob("part-*.gz"):
        data = gzip.decompress(part.read_bytes())
        if data:
            names |= {m.name for m in tarfile.open(fileobj=io.BytesIO(data + b"\0" * 4096), mode="r:")}
    assert names == {r[0] for r in rows}


def test_trees_and_the_integrity_report_over_them(spark, tmp_path):
    deep = tmp_path / "run" / "below"
    deep.mkdir(parents=True)
    (deep / "exp1.jsonl").write_text('{"id": 1, "final_answer": "A"}\n\n{"id": 2\n')
    (deep / "other.jsonl").write_text("{}\n")
    (tmp_path / "a.tar.gz").write_bytes(gzip.compress(packed([("exp2.jsonl", b'{"id": 1, "final_answer": "B"}\n{"id": 1, "final_answer": "B"}\n')])))
    lines = AR.read_tree(spark, [str(tmp_path / "run"), str(tmp_path / "a.tar.gz"), str(tmp_path / "none")]).cache()
    assert [r.path.rsplit("/", 1)[-1] for r in lines.where("fault is not null").collect()] == ["none"]
    report = RP.integrity_report(lines.where("fault is null").drop("fault"))
    profile = {r.file: r for r in report["profile"].collect()}
    assert set(profile) == {"exp1.jsonl", "exp2.jsonl"}
    assert (profile["exp1.jsonl"].total_lines, profile["exp1.jsonl"].empty_lines, profile["exp1.jsonl"].json_failed) == (3, 1, 1)
    assert (profile["exp2.jsonl"].effective_samples, profile["exp2.jsonl"].item_id_duplicates) == (2, 1)
    assert [(r.file, r.line_number) for r in report["bad_lines"].collect()] == [("exp1.jsonl", 3)]
    lines.unpersist()
