"""WARC archives: a writer, and a Python data source that reads them.

``spark.read.format("warc").load(folder)`` plans partitions of whole files,
small ones together.  Predicates on the record type and on other header columns
are pushed into the reader: it parses a record's header first, and a record
that fails them, or whose payload is not asked for (option ``payload`` =
``false``), has its block skipped without being decoded.

Archives are listed and opened with ``pyarrow.fs``, so the folder may be a path
or a URI that pyarrow knows (file, hdfs, s3, gs).  Files ending in .gz are
decompressed as a stream; in others a skipped block is sought over.

``write_warc`` writes one record for each page with Spark's text writer.  Of
pages with equal payloads the one with the smallest id is written as a
response, the others as revisits that refer to it and hold no payload.

Cases: a null html is an empty payload; a null url leaves out its header, and
control characters in a url become spaces; a null id leaves out its header and
is never the smallest unless all ids of its payload are null, then all are
responses; rows that repeat the smallest id and its payload are all responses;
an empty table makes an archive without records; extra columns are ignored.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
)

from quarry.llm.common import scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Extension headers: a page's id, its response's id, and the length of the full payload.
PAGE_ID, REFERS_TO_ID, PAYLOAD_LENGTH = "X-Page-ID", "X-Refers-To-Page-ID", "X-Payload-Length"
HTTP_HEADER = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

SCHEMA = (
    "warc_type string, record_id string, target_uri string, warc_date string, content_type string, "
    "content_length long, payload_digest string, refers_to string, headers map<string,string>, payload binary"
)
#: Columns that come from one header.
HEADERS = {
    "warc_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "warc_date": "warc-date",
    "content_type": "content-type",
    "content_length": "content-length",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
BLOCK = 1 << 20

_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x is not None and x in v,
    StringStartsWith: lambda x, v: x is not None and x.startswith(v),
    IsNotNull: lambda x, v: x is not None,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def filesystem(path: str):
    """The file system of a folder and its path there."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


#: The empty line that ends HTTP headers.
_HTTP_END = re.compile(rb"\r?\n\r?\n")


def header_text(line: bytes) -> str:
    line = line.rstrip(b"\r\n")
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


class Records:
    """The records of one archive, header first."""

    def __init__(self, stream, seekable: bool):
        self.stream, self.seekable = stream, seekable

    def next_header(self) -> dict[str, str] | None:
        """Lower-case names; a repeated header keeps its last value; None at the end.

        A line that begins with white space goes on with the header before it;
        bytes that are not UTF-8 are read as Latin-1.
        """
        line = self.stream.readline()
        while line in (b"\r\n", b"\n"):  # what ends the record before
            line = self.stream.readline()
        if not line:
            return None
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        header: dict[str, str] = {}
        while (line := self.stream.readline()) not in (b"\r\n", b"\n", b""):
            text = header_text(line)
            if text[:1] in (" ", "\t") and header:
                last = next(reversed(header))
                header[last] = f"{header[last]} {text.strip()}".strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            header.pop(name, None)  # the last header is the one to go on with
            header[name] = value.strip(" \t")
        return header

    def read(self, n: int) -> bytes:
        block = self.stream.read(n)
        if len(block) != n:
            raise ValueError("a record ends before its length")
        return block

    def skip(self, n: int) -> None:
        if self.seekable:
            self.stream.seek(n, io.SEEK_CUR)
            return
        while n:
            got = len(self.stream.read(min(n, BLOCK)))
            if not got:
                raise ValueError("a record ends before its length")
            n -= got


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """The entity body of an HTTP block, else the whole block.

    HTTP headers end at the first empty line, whether lines end in CR LF or LF;
    a block without one is given whole.
    """
    if header.get("content-type", "").lower().startswith("application/http"):
        end = _HTTP_END.search(block)
        return block[end.end() :] if end else block
    return block


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.partition_bytes = int(options.get("partitionbytes", 128 << 20))
        self.batch_bytes = int(options.get("batchbytes", 8 << 20))
        self.tests: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if type(f) in _TESTS and name in HEADERS:
                self.tests.append((name, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, folder = filesystem(self.path)
        found = where.get_file_info(fs.FileSelector(folder, recursive=True))
        files = sorted(
            (i.path, i.size or 0) for i in found if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))
        )
        groups: list[list[str]] = []
        room = 0
        for path, size in files:
            if not groups or size > room:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(path)
            room -= size
        return [Files(g) for g in groups] or [Files([])]

    def passes(self, row: dict) -> bool:
        return all(_TESTS[kind](row[name], value) for name, kind, value in self.tests)

    def records(self, paths: list[str]) -> Iterator[dict]:
        where, _ = filesystem(self.path)
        for path in paths:
            plain = not path.endswith(".gz")
            raw = where.open_input_file(path) if plain else where.open_input_stream(path, compression="gzip")
            with io.BufferedReader(raw, BLOCK) as stream:
                records = Records(stream, plain)
                while (header := records.next_header()) is not None:
                    row = {column: header.get(name) for column, name in HEADERS.items()}
                    length = row["content_length"] = int(row["content_length"] or 0)
                    wanted = self.passes(row)
                    if wanted and self.payload:
                        row["payload"] = payload_of(header, records.read(length))
                    else:
                        records.skip(length)
                    if wanted:
                        yield row | {"headers": list(header.items())}

    def read(self, partition):
        schema = pa.schema(
            [(c, pa.int64() if c == "content_length" else pa.string()) for c in HEADERS]
            + [("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
        )
        rows, held = [], 0
        for row in self.records(partition.paths):
            rows.append(row)
            held += len(row.get("payload") or b"") + 500
            if held > self.batch_bytes:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class WarcSource(DataSource):
    """WARC records; options: payload (true), partitionBytes, batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Registers the source, allows its filters to be pushed, and loads a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 20 bits of its hex are four characters."""
    digits = F.sha1(payload)
    fours = [
        F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("")), F.lit("|"), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    compression: str = "gzip",
) -> None:
    """Writes one record for each row of ``pages`` below ``path``."""
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x1F\x7F]+", " ").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    ).withColumn("digest", base32_sha1(F.encode("html", "UTF-8")))
    # Small rows find the first page of each payload; the join is one that Spark splits where a payload is frequent.
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(first, "digest")
    revisit = ~F.col("page_id").eqNullSafe(F.col("first_id"))
    block = F.when(revisit, F.lit(HTTP_HEADER)).otherwise(F.concat(F.lit(HTTP_HEADER), F.col("html")))
    head = F.concat_ws(
        "",  # leaves out headers whose value is null
        F.lit(f"{VERSION}\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("digest"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id"), F.col("digest")))),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header(PAGE_ID, F.col("page_id").cast("string")),
        _header(REFERS_TO_ID, F.when(revisit, F.col("first_id").cast("string"))),
        _header(PAYLOAD_LENGTH, F.octet_length("html").cast("string")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(F.col("block")).cast("string")),
        F.lit("\r\n"),
    )
    records = rows.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to.  Responses
    are measured on the payloads read; revisits are read without payloads.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    name = lambda h: F.col("headers")[h.lower()]
    responses = read_warc(spark, path).filter("warc_type = 'response'").select(
        name(PAGE_ID).cast(kind).alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.lit(None).cast(kind).alias("refers_to"),
    )
    revisits = read_warc(spark, path, payload=False).filter("warc_type = 'revisit'").select(
        name(PAGE_ID).cast(kind).alias("page_id"),
        name(PAYLOAD_LENGTH).cast("long").alias("payload_bytes"),
        F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        name(REFERS_TO_ID).cast(kind).alias("refers_to"),
    )
    return responses.unionByName(revisits)
