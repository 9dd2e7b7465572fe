import base64
import hashlib
import io

from pyspark.sql import functions as F

from docloom.llm import warc
from docloom.llm.common import Scratch


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("newest", F.lit(2))


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (9, "http://c/\r\nX: y%", "same"), (3, "http://d/", None), (4, "http://e/", ""), (5, "http://f/", "für " * 40_000), (None, "http://g/", "same")]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows)).collect()}
    for key, _, html in rows:
        body = (html or "").encode()
        assert got[key].payload_bytes == len(body)
        assert got[key].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert got[9].record_type == "response" and got[9].refers_to is None
    assert {got[k].refers_to for k in (1, 2, None)} == {9}
    assert (got[3].record_type, got[3].refers_to, got[4].record_type) == ("revisit", 4, "response")


def test_pushdown_and_skipping(spark):
    path = Scratch(spark, "test").place("warc")
    warc.archive_pages(pages(spark, [(i, f"http://h{i % 3}/p", f"page {i} " * 500) for i in range(30)]), path)
    read = spark.read.format("warc").option("path", path).load()
    assert read.filter("record_type = 'response' and target_uri like 'http://h1%'").count() == 10
    assert read.filter(F.col("page_id").isin(3, 5)).count() == 2
    plan = read.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # the source has taken the predicate over
    light = spark.read.format("warc").options(path=path, payload="false").load()
    assert light.filter("payload is not null").count() == 0 and light.agg(F.sum("payload_bytes")).first()[0] == sum(len(f"page {i} " * 500) for i in range(30))


def test_unwanted_payloads_are_not_inflated():
    row = {"record_id": "urn:page:1", "record_type": "response", "target_uri": None, "page_id": 1, "refers_to": None, "payload_digest": "X", "payload_bytes": 10**6, "payload": bytes(10**6)}
    data = warc.member(warc.record_bytes(row)) * 3
    light = list(warc.read_records(io.BytesIO(data), [], False))
    assert len(light) == 3 and all(f.inflated < 600_000 for f in light)
    full = list(warc.read_records(io.BytesIO(data), [], True))
    assert [warc.row_of(f, True)["payload"] for f in full] == [bytes(10**6)] * 3
    assert list(warc.read_records(io.BytesIO(data), [("in", "record_type", ("revisit",))], True)) == []


def test_plain_records():
    row = {"record_id": "urn:page:1", "record_type": "response", "target_uri": "http://a/", "page_id": 1, "refers_to": None, "payload_digest": "X", "payload_bytes": 3, "payload": b"abc"}
    found = list(warc.read_records(io.BytesIO(warc.record_bytes(row) * 2), [], True))
    assert [warc.row_of(f, True)["payload"] for f in found] == [b"abc", b"abc"]


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def records(n, compressed):
    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "target_uri": None, "page_id": i, "refers_to": None, "payload_digest": "X", "payload_bytes": 40 * i, "payload": bytes((i * k) % 251 for k in range(40 * i))} for i in range(n)]
    rows[3]["payload"] = b"\x1f\x8b\x08 WARC/1.1\r\n" * 9  # looks like beginnings of records
    return b"".join(warc.member(warc.record_bytes(r)) if compressed else warc.record_bytes(r) for r in rows)


def test_parts_of_a_large_archive_have_each_record_once():
    for compressed in (True, False):
        data = records(60, compressed)
        for size in (997, 5_000, len(data)):
            bounds = [*range(0, len(data), size), len(data)]
            got = [warc.row_of(f, True)["page_id"] for a, b in zip(bounds, bounds[1:], strict=False) for f in warc.read_records(io.BytesIO(data), [], True, a, b)]
            assert got == list(range(60))


def test_large_archive_is_several_tasks(spark, tmp_path):
    (tmp_path / "big.warc.gz").write_bytes(records(80, True))
    warc.register(spark)
    frame = spark.read.format("warc").options(path=str(tmp_path), partitionbytes="4000").load()
    assert frame.rdd.getNumPartitions() > 3 and sorted(r.page_id for r in frame.select("page_id").collect()) == list(range(80))


def test_records_inside_payloads_are_no_records(spark, tmp_path):
    """Archives whose payloads hold WARC records, plain or compressed, read in parts of a few thousand bytes."""
    inner = [records(12, False), records(12, True)]
    rows = [{"record_id": f"urn:page:{i}", "record_type": "response", "target_uri": None, "page_id": i, "refers_to": None, "payload_digest": "X", "payload_bytes": len(inner[i % 2]), "payload": inner[i % 2]} for i in range(40)]
    for compressed in (False, True):
        folder = tmp_path / str(compressed)
        folder.mkdir()
        (folder / ("a.warc.gz" if compressed else "a.warc")).write_bytes(b"".join(warc.member(warc.record_bytes(r)) if compressed else warc.record_bytes(r) for r in rows))
        warc.register(spark)
        frame = spark.read.format("warc").options(path=str(folder), partitionbytes="3000").load()
        assert sorted((r.page_id, bytes(r.payload)) for r in frame.select("page_id", "payload").collect()) == [(r["page_id"], r["payload"]) for r in rows]
