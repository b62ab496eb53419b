import base64
import gzip
import hashlib
import pathlib

import pytest
from pyspark.sql import functions as F

from verdigrain.llm import queries, warc

SCHEMA = "page_id long, url string, html string, record string, record_type string"
TRICKY = ["<p>a</p>", None, "", "x\r\n\r\ny\r\n\r\n", "WARC/1.0\r\n\r\n", "\n\nHTTP/1.1 200", "é日本👍" * 10, "z" * 200_000, "<p>a</p>", ""]


def pages(spark):
    rows = [(i, None if i == 3 else f"http://a.example/{i} x", t, "clash", "clash") for i, t in enumerate(TRICKY)]
    rows += [rows[8], (None, "http://n", "<p>a</p>", "c", "c"), (None, "http://n", "only null", "c", "c"), (None, "http://n", "only null", "c", "c")]
    return spark.createDataFrame(rows, SCHEMA)


def check(spark, sf_dir):
    rows = queries.op8_warc(spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(rows) == len(table)
    html = {r.page_id: (r.html or "").encode() for r in table if r.page_id is not None}
    largest = {}
    for key, body in html.items():
        largest[body] = max(key, largest.get(body, key))
    responses = []
    for r in rows:
        if r.page_id is None:
            continue
        body = html[r.page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        lead = largest[body]
        if r.record_type == "response":
            assert r.page_id == lead and r.refers_to is None
            responses.append(body)
        else:
            assert r.refers_to == lead
    assert sorted(responses) == sorted(largest)
    return rows


def test_awkward(spark, tmp_path):
    pages(spark).write.parquet(f"{tmp_path}/pages.parquet")
    rows = check(spark, str(tmp_path))
    assert sorted(r.record_type for r in rows if r.page_id is None) == ["response", "revisit", "revisit"]
    assert sorted(r.record_type for r in rows if r.page_id == 8) == ["response", "revisit"]


def test_whole_table(spark):
    check(spark, "/root/testdata/sf0.001")


def test_empty_table(spark):
    assert warc.resolved(warc.read_archives(spark, warc.archived(pages(spark).where("false")))).count() == 0


def test_small_payloads_stay(spark):
    path = warc.archived(pages(spark).where("page_id IN (0, 8)"), least_bytes=9)
    assert {r.record_type for r in warc.resolved(warc.read_archives(spark, path)).collect()} == {"response"}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version, spark, tmp_path):
    records = [("http://a/ b", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\n\nbody\n2 3"), ("dns:a", "0.0.0.0", "2001", "text/dns", b"")]
    data = warc.arc_file(records, version)
    found = list(warc.arc_records(data))
    assert [(r.url, r.date, r.body, r.version) for r in found] == [("http://a/%20b", "20010203040506", records[0][4], version), ("dns:a", "2001", b"", version)]
    for cut in (1, 60, 200, len(data) - 1):
        assert list(warc.arc_records(gzip.compress(data[:cut]) + gzip.compress(data[cut:]))) == found
    made = [warc.warc_record(r) for r in found]
    (one, block), (two, _) = warc.warc_records(b"".join(r + b"\r\n\r\n" for r in made))
    assert one["WARC-Type"] == "response" and two["WARC-Type"] == "metadata" and block == records[0][4]
    assert one["WARC-Date"] == "2001-02-03T04:05:06Z" and two["WARC-Date"] == "2001-01-01T00:00:00Z"
    assert one["WARC-Payload-Digest"] == "sha1:" + warc.sha1_base32(b"body\n2 3")
    assert one["WARC-Record-ID"] == next(warc.warc_records(warc.warc_record(found[0]) + b"\r\n\r\n"))[0]["WARC-Record-ID"]
    (tmp_path / "x.arc.gz").write_bytes(gzip.compress(data))
    (content,) = [bytes(r.content) for r in warc.convert(spark, str(tmp_path)).collect()]
    assert [(h["WARC-Type"], h["WARC-Target-URI"], b) for h, b in warc.warc_records(content)] == [("response", "http://a/%20b", records[0][4]), ("metadata", "dns:a", b"")]
    for bad in (data[:-3], data.replace(b"filedesc", b"filedisc"), b"no line", gzip.compress(data)[:-9]):
        with pytest.raises(ValueError):
            list(warc.arc_records(bad))


def test_files_on_disk(spark, tmp_path):
    """Each record is a gzip member, files hold a bounded number of bytes, revisits have standard fields and no payload."""
    table = pages(spark).where("page_id IS NOT NULL").withColumn("when", F.format_string("2001%02d01000000", F.col("page_id") + 1)).coalesce(1)
    path = warc.archived(table, date_column="when", file_bytes=1000)
    files = sorted(f for f in pathlib.Path(path).iterdir() if f.name.startswith("part-"))
    assert len(files) > 3
    heads, responses = [], {}
    for f in files:
        data = f.read_bytes()
        assert gzip.decompress(data)
        parts = [p for p in warc._parts(data) if p]
        assert len(parts) == 1 or sum(map(len, parts)) <= 1000
        for part in parts:
            ((head, block),) = warc.warc_records(part)
            heads.append((head, block))
            if head["WARC-Type"] == "response":
                responses["<" + head["WARC-Record-ID"].strip("<>") + ">"] = head
    assert len(heads) == table.count() and len({h["WARC-Record-ID"] for h, _ in heads}) == len(heads)
    assert len({h["WARC-Date"] for h, _ in heads}) > 5
    again = [(h, b) for h, b in heads if h["WARC-Type"] == "revisit"]
    assert again
    for head, block in again:
        lead = responses[head["WARC-Refers-To"]]
        assert warc.payload_of(block) == b"" and head["WARC-Payload-Digest"] == lead["WARC-Payload-Digest"] and head["WARC-Profile"] == warc.PROFILE
        assert (head["WARC-Refers-To-Target-URI"], head["WARC-Refers-To-Date"]) == (lead["WARC-Target-URI"], lead["WARC-Date"])


def test_a_page_of_100_mb(spark):
    body = "0123456789" * 10_000_000
    table = spark.createDataFrame([(1, "u", "small")], "page_id long, url string, html string").withColumn("html", F.repeat(F.lit("0123456789"), 10_000_000))
    (row,) = warc.resolved(warc.read_archives(spark, warc.archived(table))).collect()
    assert row.payload_bytes == len(body) and row.payload_digest == warc.sha1_base32(body.encode())
