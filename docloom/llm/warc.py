"""WARC archives as a Spark data source.

`spark.read.format("warc")` plans partitions from the list of files, takes over predicates on the record type and
on the other header columns, parses a record's headers first, and decodes a payload only if the headers pass and
payloads are wanted. Records are gzip members of their own; the writer notes each member's length in the gzip
header (extra field `sl`, as the WARC standard's annex on gzip proposes), so that an unwanted record is skipped
without inflating the rest of it.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from docloom.llm.common import Scratch

SCHEMA = "record_id string, record_type string, target_uri string, page_id long, refers_to string, payload_digest string, payload_bytes long, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
#: Header names behind the columns that predicates reach.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "page_id": "X-Page-Id"}
#: Columns whose header text differs from the value only by this prefix and suffix.
_WRAPPED = {"record_id": ("<", ">"), "refers_to": ("<", ">"), "payload_digest": ("sha1:", "")}
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 64 << 20


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def _escaped(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unescaped(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(row: dict) -> bytes:
    """One record. A response holds the HTTP head and the payload, a revisit the HTTP head alone."""
    response = row["record_type"] == "response"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + (row["payload"] if response else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {DATE}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_escaped(row['target_uri'])}")
    if row["page_id"] is not None:
        lines.append(f"X-Page-Id: {row['page_id']}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 3) -> bytes:
    """A gzip member with its own length and the record's in an extra field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, whole, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _head(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {name.strip(): value.strip(" ") for name, _, value in (x.partition(":") for x in lines[1:]) if name}


def _value(column: str, headers: dict[str, str]) -> str | int | None:
    value = headers.get(HEADERS[column])
    if value is None:
        return None
    before, after = _WRAPPED.get(column, ("", ""))
    value = value.removeprefix(before).removesuffix(after)
    return int(value) if column == "page_id" else _unescaped(value) if column == "target_uri" else value


def _passes(headers: dict[str, str], tests: list[tuple]) -> bool:
    for kind, column, wanted in tests:
        value = _value(column, headers)
        if kind == "in" and value not in wanted or kind == "starts" and not (value or "").startswith(wanted) or kind == "known" and value is None:
            return False
    return True


@dataclass
class Found:
    """A record whose headers passed; `inflated` tells how many bytes were decoded to get it."""

    headers: dict[str, str]
    block: bytes | None
    inflated: int


def _begins_record(file: io.BufferedIOBase, at: int) -> bool:
    """Whether a record, compressed or plain, begins at a place.

    A compressed one must be whole and be followed by another member or the end of the archive, so that an archive in
    a payload isn't taken for the archive's own records.
    """
    file.seek(at)
    head = file.read(2048)
    if head[:2] != b"\x1f\x8b":
        return head.startswith(b"WARC/") and b"WARC-Type:" in head
    inflate, chunk, text = zlib.decompressobj(31), head, b""
    try:
        while chunk and not inflate.eof:
            part = inflate.decompress(chunk)
            text += part[: 2048 - len(text)]
            if not text.startswith(b"WARC/"[: len(text)]):
                return False
            chunk = b"" if inflate.eof else file.read(1 << 16)
    except zlib.error:
        return False
    if not inflate.eof or b"WARC-Type:" not in text:
        return False
    after = (inflate.unused_data + file.read(3))[:3]
    return not after or after == b"\x1f\x8b\x08"


def first_record(file: io.BufferedIOBase, start: int, end: int) -> int:
    """The first place from `start` on, before `end`, where a record begins; `end` where there is none."""
    at, held = start, b""
    while start and at < end:
        file.seek(at)
        held = file.read(min(1 << 20, end - at + 4))
        places = sorted(m.start() for m in re.finditer(rb"\x1f\x8b\x08|WARC/", held))
        for k in places:
            if at + k < end and _begins_record(file, at + k):
                return at + k
        if len(held) < 1 << 20:
            return end
        at += len(held) - 4
    return start if not start else end


def read_records(file: io.BufferedIOBase, tests: list[tuple], payloads: bool, start_at: int = 0, end_at: int | None = None) -> Iterator[Found]:
    """The records of one archive, gzip or plain, whose headers pass; of a part of it those that begin there."""
    at = first_record(file, start_at, end_at) if end_at is not None else start_at
    while end_at is None or at < end_at:
        file.seek(at)
        start = file.read(2)
        if not start:
            return
        if start == b"\x1f\x8b":
            rest = file.read(22)
            length = 0
            if rest[1] & 4 and rest[10:12] == b"sl":
                length = struct.unpack("<I", rest[14:18])[0]
            file.seek(at)
            inflate, text, end, used = zlib.decompressobj(31), b"", -1, 0
            while end < 0 and not inflate.eof:
                chunk = file.read(min(2048, length - used) if length else 2048)
                if not chunk:
                    raise ValueError("an archive ends inside a record")
                used += len(chunk)
                text += inflate.decompress(chunk)
                end = text.find(b"\r\n\r\n")
            headers = _head(text[:end])
            wanted = _passes(headers, tests)
            if length and not (wanted and payloads):
                at += length
            else:
                parts = [text]
                while not inflate.eof:
                    chunk = file.read(max(1, min(1 << 20, length - used)) if length else 1 << 16)
                    if not chunk:
                        raise ValueError("an archive ends inside a record")
                    used += len(chunk)
                    parts.append(inflate.decompress(chunk))
                text = b"".join(parts)
                at += used - len(inflate.unused_data)
            if wanted:
                n = int(headers["Content-Length"])
                yield Found(headers, text[end + 4 : end + 4 + n] if payloads else text[end + 4 :], len(text))
        elif start in (b"\r\n", b"\n\n"):
            at += 2
        else:
            file.seek(at)
            head = b""
            while (end := head.find(b"\r\n\r\n")) < 0:
                chunk = file.read(1024)
                if not chunk:
                    raise ValueError("an archive ends inside a record")
                head += chunk
            headers = _head(head[:end])
            n = int(headers["Content-Length"])
            if _passes(headers, tests):
                file.seek(at + end + 4)
                block = file.read(n if payloads else min(n, 1024))
                yield Found(headers, block, end + len(block))
            at += end + 4 + n


def row_of(found: Found, payloads: bool) -> dict:
    """A row of SCHEMA. The payload's length is the HTTP head's, so that it holds for revisits too."""
    http, _, payload = (found.block or b"").partition(b"\r\n\r\n")
    lengths = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    full = payloads and found.headers.get("WARC-Type") != "revisit"
    row = {c: _value(c, found.headers) for c in HEADERS}
    return row | {"payload_bytes": lengths[0] if lengths else None, "payload": payload if full else None}


@dataclass
class Files(InputPartition):
    """Files, or parts of them: name, where the part begins, and where it ends (None: the whole file)."""

    parts: tuple[tuple[str, int, int | None], ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() == "true"
        self.target = int(options.get("partitionbytes", ROLL_BYTES))
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo) or (isinstance(f, EqualNullSafe) and f.value is not None):
                self.tests.append(("in", column, (f.value,)))
            elif isinstance(f, In):
                self.tests.append(("in", column, tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append(("starts", column, f.value))
            elif isinstance(f, IsNotNull):
                self.tests.append(("known", column, None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Files in groups of about `partitionbytes`, larger compressed ones in parts of that size; those of finished writes where a writer's list is there.

        A plain archive is one stream of one task: nothing in its bytes tells a record from a payload that holds one.
        """
        store, path = open_store(self.path)
        infos = [x for x in store.get_file_info(pa.fs.FileSelector(path)) if x.is_file] if store.get_file_info(path).type == pa.fs.FileType.Directory else [store.get_file_info(path)]
        lists = [x for x in infos if x.base_name.startswith("_written-")]
        if lists:
            done = set()
            for x in lists:
                with store.open_input_stream(x.path) as file:
                    done.update(json.loads(file.read()))
            infos = [x for x in infos if x.base_name in done]
        infos = sorted((x for x in infos if x.base_name.endswith((".warc", ".warc.gz"))), key=lambda x: -x.size)
        groups: list[list] = []
        for x in infos:
            if x.size > 2 * self.target and x.base_name.endswith(".gz"):
                bounds = [*range(0, x.size, self.target), x.size]
                groups += [[self.target, (x.path, a, b)] for a, b in zip(bounds, bounds[1:], strict=False)]
            elif groups and groups[-1][0] + x.size <= self.target:
                groups[-1][0] += x.size
                groups[-1].append((x.path, 0, None))
            else:
                groups.append([x.size, (x.path, 0, None)])
        return [Files(tuple(g[1:])) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(self.path)
        rows, held = [], 0
        for name, start, end in partition.parts:
            with store.open_input_file(name) as raw:
                for found in read_records(io.BufferedReader(raw, 1 << 18), self.tests, self.payloads, start, end):
                    rows.append(row_of(found, self.payloads))
                    held += len(rows[-1]["payload"] or b"") + 200
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


@dataclass
class Written(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own names; a list of the finished tasks' files makes them visible."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.level = int(options.get("level", 3))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in (r for i in range(0, batch.num_rows, 200) for r in batch.slice(i, 200).to_pylist()):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{path}/{names[-1]}", compression=None), 0
                data = member(record_bytes(row), self.level)
                out.write(data)
                size += len(data)
                if size >= ROLL_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(tuple(names))

    def commit(self, messages: list[Written | None]) -> None:
        store, path = open_store(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/_written-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, path = open_store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{path}/{name}")


class WarcDataSource(DataSource):
    """Options: path; payload (true, or false to leave payloads undecoded); partitionbytes; level (gzip, for writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the source known to a session and turn on its pushing of filters into Python sources, which is off by default."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_of_hex(digest: Column) -> Column:
    """Base32 (RFC 4648 letters) of 40 hexadecimal digits: five of them are four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for g in range(8):
        value = F.conv(F.substring(digest, 1 + 5 * g, 5), 16, 10).cast("int")
        out += [F.substring(letters, F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def page_records(pages: DataFrame, min_revisit_bytes: int = 0, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """A row of the data source's schema for each page.

    Of pages with equal payloads of at least min_revisit_bytes, the one with the largest id is a response and the
    others are revisits that refer to it. Null html counts as empty; a null url leaves its header out; pages with a
    null id refer to the largest known id, and are responses where there is none; rows that share the largest id
    are all responses; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("target_uri"), F.coalesce(F.col(html_column), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    shared = rows.filter(F.length("payload") >= min_revisit_bytes).groupBy("sha").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = scratch.keep(shared, "shared")
    joined = rows.join(shared, "sha", "left")
    revisit = F.coalesce(F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("none")))
    return joined.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "page_id",
        F.when(revisit, name(F.col("newest"))).alias("refers_to"),
        base32_of_hex(F.col("sha")).alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def archive_pages(pages: DataFrame, path: str, **columns: str) -> None:
    """Write the pages' records under path."""
    register(pages.sparkSession)
    page_records(pages, **columns).write.format("warc").mode("append").option("path", path).save()


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id).

    Responses' lengths and digests are taken from the payload that was read, revisits' from their headers; payloads
    of revisits are never decoded. An empty table gives an empty archive and result.
    """
    spark = pages.sparkSession
    path = Scratch(spark, "archive").place("warc")
    archive_pages(pages, path)
    read = lambda **options: spark.read.format("warc").options(path=path, **options).load()
    responses = read().filter("record_type = 'response'").select("page_id", F.length("payload").cast("long").alias("payload_bytes"), base32_of_hex(F.sha1("payload")).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read(payload="false").filter("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.substring_index("refers_to", ":", -1).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)
