import base64
import glob
import gzip
import hashlib
import os
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringContains

from quarry.llm import warc as W
from quarry.llm.common import scratch_path

PAGES = "page_id long, url string, html string"


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b, f = (h or "").encode(), first.get(h or "")
        same = i == f
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if same else "revisit", None if same else f))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/1", "<p>same</p>"), (3, "http://a/2", "<p>same</p>"), (9, "http://a/3", "<p>same</p>"),
    (1, None, None), (2, "http://b", ""), (4, "u\r\nWARC-Type: bad", "x\r\n\r\nWARC/1.1\r\ny"), (6, "http://é", "é日😀\n"),
    (None, "http://n", "no id"), (None, "http://n", "<p>same</p>"), (7, "http://t", "tie"), (7, "http://t", "tie"),
    (8, "http://long", "<b>long</b> " * 300_000), (10, "", "\r\n\r\n"), (11, "http://z", "a\x00b"),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({"digest": F.lit("clash"), "block": F.lit(1)})
    got = sorted((tuple(r) for r in W.round_trip(pages.repartition(3)).collect()), key=str)
    assert got == brute(ROWS)
    assert W.round_trip(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_is_well_formed_and_read_in_parts(spark, compression):
    path = scratch_path(spark, "warc-test")
    W.write_warc(spark.createDataFrame(ROWS, PAGES).repartition(4), path, compression=compression)
    local = path.removeprefix("file:")
    records = 0
    for f in glob.glob(os.path.join(local, "part-*")):
        data = (gzip.open(f) if f.endswith(".gz") else open(f, "rb")).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            data, records = rest[n + 4 :], records + 1
    assert records == len(ROWS)
    df = W.read_warc(spark, path)
    assert df.count() == len(ROWS)
    found = df.filter((F.col("warc_type") == "response") & F.col("target_uri").startswith("http://a"))
    assert [r.payload for r in found.collect()] == [b"<p>same</p>"]
    assert df.filter("warc_type = 'revisit' AND payload IS NOT NULL AND length(payload) > 0").count() == 0
    assert df.filter("content_length > 1000000").count() == 1
    assert W.read_warc(spark, path, payload=False).filter("payload IS NOT NULL").count() == 0


def test_filters_reach_the_reader(spark, monkeypatch):
    path = scratch_path(spark, "warc-test")
    W.write_warc(spark.createDataFrame(ROWS, PAGES).coalesce(1), path, compression="none")
    reader = W.WarcReader({"path": path, "partitionbytes": "1"})
    kept, pushed = StringContains(("target_uri",), "a"), EqualTo(("warc_type",), "revisit")
    assert list(reader.pushFilters([kept, pushed])) == [kept]
    read = []
    plain = W.Records.read
    monkeypatch.setattr(W.Records, "read", lambda self, n: read.append(n) or plain(self, n))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["warc_type"] for r in rows} == {"revisit"} and len(read) == len(rows)
    plan = W.read_warc(spark, path).filter("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bFilter\b", plan)


def test_broken_archives_raise(tmp_path):
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort")
    reader = W.WarcReader({"path": str(tmp_path)})
    with pytest.raises(ValueError):
        list(reader.read(reader.partitions()[0]))


def test_foreign_archives(spark, tmp_path):
    """LF header ends, Latin-1 and folded headers, an HTTP block without an empty line, several gzip members."""
    def record(headers, block):
        return b"WARC/1.0\r\n" + headers + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"

    http = b"Content-Type: application/http; msgtype=response\r\n"
    url = b"WARC-Type: response\r\nWARC-Target-URI: http://a/%d\r\n"
    records = [
        record(url % 1 + http, b"HTTP/1.1 200 OK\nA: b\n\nbody\r\n\r\nmore"),
        record(url % 2 + http, b"HTTP/1.1 200 OK\r\n\r\n"),
        record(url % 3 + http, b"no empty line"),
        record(url % 4 + b"X-Note: caf\xe9\r\nX-Long: one\r\n\ttwo\r\n" + http, b"HTTP/1.1 200 OK\r\n\r\n\xff\n\n"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    rows = W.read_warc(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in rows] == [b"body\r\n\r\nmore", b"", b"no empty line", b"\xff\n\n"]
    reader = W.Records(gzip.open(tmp_path / "a.warc.gz"), False)
    headers = []
    while (h := reader.next_header()) is not None:
        headers.append(h)
        reader.skip(int(h["content-length"]))
    assert headers[3]["x-note"] == "café" and headers[3]["x-long"] == "one two"
