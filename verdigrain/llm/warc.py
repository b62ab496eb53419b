"""Legacy web archives: ARC files read and converted to WARC files, with equal payloads kept once.

An ARC file begins with a version block, whose header line names the version and whose body lists
the fields of all later header lines. Version 1 lines have url, address, date, type and length;
version 2 lines have also result code, checksum, location, offset and file name. Bodies have exactly
the declared length and end with a newline. The converter reads such lines by version, and makes an
equivalent WARC record of each body: an identifier, the date in ISO form, the record type by the kind
of body, and block and payload digests. Of bodies with equal payloads one becomes a response; the
others become revisit records that refer to it and have only the HTTP header as block.

Files are made of one gzip member for each record, so a reader can begin at any record, and hold about
FILE_BYTES of records before compression; a longer record is a file of its own. A file is one row of a
table on its way: Spark writes and reads it, so it can be in any storage that Spark knows. Duplicates
are found by digest and length with partial aggregation, so a payload with any number of copies sends
one row a task; which records of a file are revisits is joined to the file by its path, and the join
is by broadcast only where Spark finds that table small.

Null html is an empty payload. Rows with null or equal page ids are records each; of equal payloads,
the largest page_id is the response, other rows with that id too are revisits of it but one; where all
have null, one is the response. Null urls become `urn:missing`. Malformed archives raise. Empty tables
make no records. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.llm.shared import dropped_tables, fresh_path, hot_keys, join_hot, stored
from verdigrain.session import on_workers

# The fields of header lines by version, and the profile of revisits by payload.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
#: Bytes of records, before compression, that a file has about.
FILE_BYTES = 8 << 20
#: What Spark writes after a file's content: a gzip member of nothing.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 0xFF, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])


@dataclass(frozen=True)
class ArcRecord:
    url: str
    address: str
    date: str
    kind: str
    body: bytes
    version: int


# --- bytes ----------------------------------------------------------------------------------------


def member(data: bytes) -> bytes:
    """One gzip member."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _parts(data: bytes, step: int = 1 << 14) -> Iterator[bytes]:
    """A file's bytes; of a compressed one what each of its members holds, unpacked in turn."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        inflate = zlib.decompressobj(31)
        out = []
        while not inflate.eof and at < len(data):
            piece = data[at : at + step]
            out.append(inflate.decompress(piece))
            at += len(piece) - len(inflate.unused_data)
        if not inflate.eof:
            raise ValueError("a gzip member doesn't end")
        yield b"".join(out)


class _Stream:
    """Reads lines and blocks from parts of bytes; one part is held at a time."""

    def __init__(self, parts: Iterable[bytes]) -> None:
        self.parts, self.held, self.at = iter(parts), b"", 0

    def more(self) -> bool:
        """Whether anything is left."""
        while self.at >= len(self.held):
            part = next(self.parts, None)
            if part is None:
                return False
            self.held, self.at = part, 0
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What stands before a mark, which is passed; null if it doesn't come."""
        while (found := self.held.find(mark, self.at)) < 0:
            part = next(self.parts, None)
            if part is None:
                return None
            self.held, self.at = self.held[self.at :] + part, 0
        out, self.at = self.held[self.at : found], found + len(mark)
        return out

    def read(self, n: int) -> bytes:
        """So many bytes, or as many as there are."""
        out = []
        while n and self.more():
            out.append(self.held[self.at : self.at + n])
            self.at += len(out[-1])
            n -= len(out[-1])
        return b"".join(out)

    def skip(self, byte: bytes) -> bool:
        if self.more() and self.held[self.at : self.at + 1] == byte:
            self.at += 1
            return True
        return False


def arc_line(url: str, address: str, date: str, kind: str, body: bytes, version: int, name: str) -> bytes:
    """The header line of an ARC record."""
    url = re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) or "urn:missing"
    more = ["200", hashlib.md5(body).hexdigest(), "-", "0", name] if version == 2 else []
    return " ".join([url, address, date, kind, *more, str(len(body))]).encode()


def arc_block(version: int, name: str) -> bytes:
    """The version block that an ARC file begins with."""
    about = f"{version} 0 verdigrain\n{' '.join(FIELDS[version])}\n".encode()
    return arc_line(f"filedesc://{name}", "0.0.0.0", "19960923142103", "text/plain", about, version, name) + b"\n" + about + b"\n"


def arc_file(records: list[tuple[str, str, str, str, bytes]], version: int, name: str = "legacy.arc") -> bytes:
    """An ARC file, not compressed, of (url, address, 14-digit date, type, body)."""
    return arc_block(version, name) + b"".join(arc_line(*r, version, name) + b"\n" + r[4] + b"\n" for r in records)


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, plain or gzipped, in any version known; the version block isn't one."""
    stream, version = _Stream(_parts(data)), None
    while stream.more():
        head = stream.until(b"\n")
        if head is None:
            raise ValueError("an ARC header line doesn't end")
        line = head.decode("utf-8", "replace").split(" ")
        try:
            length = int(line[-1])
        except ValueError:
            raise ValueError(f"an ARC header line has no length: {line[-1][:40]!r}") from None
        body = stream.read(length)
        if len(body) != length:
            raise ValueError("an ARC body is shorter than declared")
        while stream.skip(b"\r"):
            pass
        stream.skip(b"\n")
        if version is None:
            if not line[0].startswith("filedesc:"):
                raise ValueError("an ARC file begins with a version block")
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        if len(line) != len(FIELDS[version]):
            raise ValueError(f"an ARC header line of version {version} has {len(line)} fields")
        field = dict(zip(FIELDS[version], line, strict=True))
        yield ArcRecord(field["URL"], field["IP-address"], field["Archive-date"], field["Content-type"], body, version)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _iso(date: str) -> str:
    """An ISO date of the first up to 14 digits; missing digits are the earliest."""
    digits = re.sub(r"\D", "", date)[:14]
    full = digits + "19700101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _split(body: bytes) -> tuple[bytes, bytes]:
    """The HTTP header of a body with its gap, and the payload; a body without a header is all payload."""
    if body[:5] == b"HTTP/":
        for gap in (b"\r\n\r\n", b"\n\n"):
            if (at := body.find(gap)) >= 0:
                return body[: at + len(gap)], body[at + len(gap) :]
    return b"", body


def payload_of(body: bytes) -> bytes:
    """What follows the HTTP header, if the body has one."""
    return _split(body)[1]


def record_id(record: ArcRecord, salt: str = "") -> str:
    """An identifier that depends on url, date, body and salt (such as the record's place) only."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.url} {_iso(record.date)} {sha1_base32(record.body)}{salt}')}"


def warc_record(record: ArcRecord, salt: str = "", refers: tuple[str, str, str] | None = None) -> bytes:
    """The equivalent WARC record, without its final separator; a revisit, if it refers to (id, uri, date) of another."""
    http, payload = _split(record.body)
    kind = "revisit" if refers else "response" if http else "metadata" if record.url.startswith("dns:") else "resource"
    block = http if refers else record.body
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id(record, salt)}>", "WARC-Date": _iso(record.date), "WARC-Target-URI": record.url, "WARC-IP-Address": record.address, "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}", "WARC-Block-Digest": f"sha1:{sha1_base32(block)}"}
    if refers:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{refers[0]}>", "WARC-Refers-To-Target-URI": refers[1], "WARC-Refers-To-Date": refers[2]}
    head |= {"Content-Type": "application/http; msgtype=response" if http else record.kind, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a WARC file, plain or gzipped; digests are checked."""
    stream = _Stream(_parts(data))
    while stream.more():
        lines = stream.until(RECORD_END)
        if lines is None or lines[:5] != b"WARC/":
            raise ValueError("a WARC record doesn't begin where it should")
        head = dict(line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
        length = int(head["Content-Length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != RECORD_END:
            raise ValueError("a WARC record doesn't end where it should")
        if head.get("WARC-Block-Digest") not in (None, "sha1:" + sha1_base32(block)):
            raise ValueError("a WARC block doesn't match its digest")
        if head["WARC-Type"] != "revisit" and head.get("WARC-Payload-Digest") not in (None, "sha1:" + sha1_base32(payload_of(block))):
            raise ValueError("a WARC payload doesn't match its digest")
        yield head, block


def page_of(block: bytes) -> int | None:
    """The page id that the HTTP header of a page's record has."""
    found = re.search(rb"^X-Page-ID: (-?\d+)\r?$", _split(block)[0], re.M)
    return int(found[1]) if found else None


# --- files ----------------------------------------------------------------------------------------


class _Files:
    """Collects members until a file is full."""

    def __init__(self, most: int) -> None:
        self.most, self.members, self.size, self.count = most, [], 0, 0

    def full(self, size: int) -> bytes | None:
        """The file so far, if a record of this size would be too much for it."""
        return self.end() if self.members and self.size + size > self.most else None

    def add(self, data: bytes) -> None:
        self.members.append(member(data))
        self.size += len(data)

    def end(self) -> bytes | None:
        out = b"".join(self.members) if self.members else None
        self.count += out is not None
        self.members, self.size = [], 0
        return out


def _content(data: bytes | None) -> Iterator[pa.RecordBatch]:
    if data is not None:
        yield pa.RecordBatch.from_arrays([pa.array([data], pa.large_binary()).cast(pa.binary())], names=["content"])


def arc_files(df: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", date_column: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """ARC files (content) of pages, of either version in turn; the page's id is a line of its HTTP header."""
    on_workers(df.sparkSession)
    date = F.lit("20000101000000") if date_column is None else F.col(date_column)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(file_bytes)
        for whole in batches:
            for begin in range(0, len(whole), 64):
                for key, url, html, when in zip(*(c.to_pylist() for c in whole.slice(begin, 64).columns), strict=True):
                    told = "" if key is None else f"X-Page-ID: {key}\r\n"
                    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{told}\r\n".encode() + (html or "").encode()
                    yield from _content(files.full(len(body)))
                    version = files.count % 2 + 1
                    if not files.members:
                        files.add(arc_block(version, "pages.arc"))
                    files.add(arc_line(url or "urn:missing", "127.0.0.1", when or "", "text/html", body, version, "pages.arc") + b"\n" + body + b"\n")
        yield from _content(files.end())

    return df.select(id_column, url_column, html_column, date).mapInArrow(made, "content binary")


def write_files(files: DataFrame, path: str | None = None) -> str:
    """Write each row's content as a file; gives their folder."""
    path = path or fresh_path(files.sparkSession, "archive")
    # bytes pass through a string column as they are; what ends a line is a member of nothing
    (files.select(F.expr("cast(content AS string)").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("compression", "none").option("maxRecordsPerFile", 1).text(path))
    return path


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """file, place, page_id, uri, date, record_id, payload_bytes, payload_digest of every ARC record under a path."""
    on_workers(spark)
    names = ["file", "place", "page_id", "uri", "date", "record_id", "payload_bytes", "payload_digest"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for k, r in enumerate(arc_records(content.as_py())):
                    payload = payload_of(r.body)
                    rows.append((file, k, page_of(r.body), r.url, _iso(r.date), record_id(r, f" {file} {k}"), len(payload), sha1_base32(payload)))
                yield _rows(rows, names, kinds)

    return _read(spark, path).mapInArrow(made, "file string, place bigint, page_id bigint, uri string, date string, record_id string, payload_bytes bigint, payload_digest string")


def revisits(catalogue: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """file, marks: of each file with revisits, their places and the id, uri and date of the responses that they refer to.

    Of records with equal payloads of at least `least_bytes`, that with the largest page_id is the response.
    """
    keys = ["payload_digest", "payload_bytes"]
    rows = stored(catalogue.where(F.col("payload_bytes") >= least_bytes), "warc-rows")
    lead = stored(rows.groupBy(*keys).agg(F.max(F.struct("page_id", "record_id", "uri", "date")).alias("lead"), F.count(F.lit(1)).alias("records")).where("records > 1"), "warc-leads")
    met = join_hot(rows.select("file", "place", "record_id", *keys), lead, keys, hot_keys(lead, "records")).where(F.col("record_id") != F.col("lead.record_id"))
    return met.groupBy("file").agg(F.collect_list(F.struct("place", F.col("lead.record_id").alias("id"), "lead.uri", "lead.date")).alias("marks"))


def convert(spark: SparkSession, path: str, marks: DataFrame | None = None, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """WARC files (content) of all ARC files under a path; records in `marks` become revisits."""
    on_workers(spark)
    kind = "array<struct<place:bigint,id:string,uri:string,date:string>>"
    files = _read(spark, path)
    files = files.withColumn("marks", F.lit(None).cast(kind)) if marks is None else files.join(marks.select("file", F.col("marks").cast(kind).alias("marks")), "file", "left")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files(file_bytes)
        for batch in batches:
            for file, content, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                refers = {m["place"]: (m["id"], m["uri"], m["date"]) for m in own or ()}
                for k, r in enumerate(arc_records(content.as_py())):
                    record = warc_record(r, f" {file} {k}", refers.get(k)) + RECORD_END
                    yield from _content(out.full(len(record)))
                    out.add(record)
        yield from _content(out.end())

    return files.select("file", "content", "marks").mapInArrow(made, "content binary")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, uri, record_id, record_type, refers_to (a record's id), payload_bytes (null for revisits), payload_digest of every WARC record under a path."""
    on_workers(spark)
    names = ["page_id", "uri", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, block in warc_records(content.as_py()):
                    again = head["WARC-Type"] == "revisit"
                    refers = head["WARC-Refers-To"].strip("<>") if again else None
                    rows.append((page_of(block), head["WARC-Target-URI"], head["WARC-Record-ID"].strip("<>"), head["WARC-Type"], refers, None if again else len(payload_of(block)), head["WARC-Payload-Digest"].removeprefix("sha1:")))
                yield _rows(rows, names, kinds)

    return _read(spark, path).select("content").mapInArrow(made, "page_id bigint, uri string, record_id string, record_type string, refers_to string, payload_bytes bigint, payload_digest string")


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page) of read_archives' rows."""
    records = stored(records, "warc-records")
    again = records.where("record_type = 'revisit'").select("page_id", "payload_digest", F.col("refers_to").alias("_id"))
    whole = records.where("record_type <> 'revisit'")
    leads = whole.select(F.col("record_id").alias("_id"), "payload_bytes", F.col("page_id").alias("refers_to"))
    hot = hot_keys(again.groupBy("_id").agg(F.count(F.lit(1)).alias("n")), "n")
    met = join_hot(again, leads, ["_id"], hot).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to")).unionByName(met)


def archived(df: DataFrame, *, least_bytes: int = 0, file_bytes: int = FILE_BYTES, **columns) -> str:
    """The folder of WARC files made of pages by way of ARC files, with equal payloads kept once."""
    spark = df.sparkSession
    legacy = write_files(arc_files(df, file_bytes=file_bytes, **columns))
    # stored, so that Spark knows the size of the marks before it chooses how files meet them
    marks = stored(revisits(read_arc(spark, legacy), least_bytes=least_bytes), "warc-marks")
    path = write_files(convert(spark, legacy, marks, file_bytes=file_bytes))
    dropped_tables(spark, [legacy])
    return path
