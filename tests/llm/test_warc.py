from __future__ import annotations

import hashlib
import io

import duckdb
import pytest
import zstandard
from pyarrow import fs

from pairlens.llm import warc
from pairlens.llm.queries import ORACLES, QUERIES


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op9_seekable_bundles']})").fetchall()
    got = [tuple(r) for r in QUERIES["op9_seekable_bundles"](spark, folder).select(*columns).collect()]
    assert sorted(got) == sorted(want)


def brute(rows, least=1000):
    top = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            top[data] = max(page, top.get(data, page))
    for page, url, html in rows:
        data = (html or "").encode()
        keep = top.get(data)
        revisit = keep is not None and page != keep
        yield str(page), url, "revisit" if revisit else "response", keep if revisit else None, hashlib.sha1(data).hexdigest(), len(data), None if revisit else data


@pytest.fixture
def odd():
    big = "<p>é</p>" * 400
    return [
        (1, "http://a/", big), (2, None, big), (3, "http://c/ d\r\nX: y", big), (3, "http://c/", big), (None, "http://n/", big), (None, None, "q" * 2000),
        (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (8, "http://long/", "z\r\n\r\n" * 300_000), (9, "u", "x" * 1000), (10, "u", "x" * 1000),
    ]


def test_odd_rows(spark, odd, tmp_path):
    table = spark.createDataFrame([(*r, b"payload", "k") for r in odd], "page_id long, url string, html string, payload binary, record_type string")
    index = warc.write(warc.classify(table), f"file://{tmp_path}/bundles", bundle_bytes=2000)
    rows = warc.read(index, f"file://{tmp_path}/bundles").collect()
    key = lambda r: tuple(map(str, r))
    got = sorted(((str(r.page_id), r.url, r.record_type, r.refers_to, r.digest, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in rows), key=key)
    want = [(p, None if u is None else u.replace(" ", "%20").replace("\r", "%0D").replace("\n", "%0A"), *rest) for p, u, *rest in brute(odd)]
    assert got == sorted(want, key=key)
    assert warc.read(warc.write(warc.classify(table.limit(0)), f"{tmp_path}/none"), f"{tmp_path}/none").collect() == []


def test_any_zstandard_reader_reads_a_bundle(tmp_path):
    path, store = f"{tmp_path}/b.warc.zst", fs.LocalFileSystem()
    writer = warc.BundleWriter(store, path, 500)
    data = [warc.record(i, f"http://x/{i}", b"y" * (i * 40), "response", None, "2020-01-01T00:00:00Z")[1] for i in range(20)]
    places = [writer.add(d) for d in data]
    writer.close()
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read() == b"".join(data)
    reader = warc.BundleReader(store, path)
    assert len(reader) > 5
    for d, (frame, offset) in reversed(list(zip(data, places, strict=True))):
        assert reader.frame(frame)[offset : offset + len(d)] == d
        assert warc.parse(d)[1].endswith(b"y" * (len(d) and data.index(d) * 40))
    with pytest.raises(ValueError):
        warc.parse(data[3][:-5])


def test_short_pages_are_not_one_task(spark):
    """Also where the groups are too many to broadcast."""
    from pyspark.sql import functions as F

    pages = spark.range(4000).selectExpr("id AS page_id", "concat('u', id) AS url", "CASE WHEN id % 5 = 0 THEN repeat(cast(id % 100 AS string), 1000) ELSE 'short' END AS html")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(before, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        sizes = [r[0] for r in warc.classify(pages).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.when(F.length("payload") < 1000, 1))).select(F.col("count(CASE WHEN (length(payload) < 1000) THEN 1 END)")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 3200 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]
