"""WARC records in ZIP packages, written and read back by range.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` (a line per record with its offset and length), both stored, not
compressed again. The reader needs nothing but ranges of the file: the end record and,
where it points there, the ZIP64 one, the central directory, the index member, then
each record's own bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import base

#: Bytes of payload in a package at most (a longer payload has its own).
PACKAGE = 64 << 20
#: Digests that are broadcast at most.
FEW = 1 << 18
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """A WARC/1.1 response, or a revisit of record refers_to, as one gzip member."""
    block = HTTP if refers_to else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Payload-Length: {len(payload)}"]
    head += [f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with names in lower case, block) of a record."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def write_package(out, records: Iterator[tuple[str, str | None, bytes, str | None]]) -> int:
    """Writes (record id, url, payload, refers to) records as a package to a binary stream."""
    lines, at = [], 0
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
        with package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as data:
            for record_id, url, payload, refers_to in records:
                member = record(record_id, url, payload, refers_to)
                data.write(member)
                lines.append((url or "", json.dumps({"url": url, "offset": at, "length": len(member), "filename": DATA}, ensure_ascii=True)))
                at += len(member)
        text = "".join(f"{json.dumps(key)[1:-1].replace(' ', '%20') or '-'} 20240101000000 {line}\n" for key, line in sorted(lines))
        package.writestr(zipfile.ZipInfo(INDEX), text)
    return len(lines)


@dataclass
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


def directory(file) -> dict[str, Member]:
    """The members of a ZIP file (read_at-style: seek and read), from its central directory."""
    size = file.seek(0, 2) if hasattr(file, "fileno") else file.size()

    def at(place: int, n: int) -> bytes:
        file.seek(place)
        return file.read(n)

    tail_at = max(0, size - 22 - 65535)
    tail = at(tail_at, size - tail_at)
    k = len(tail) - 22
    while k >= 0 and not (tail[k : k + 4] == b"PK\5\6" and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail)):
        k = tail.rfind(b"PK\5\6", 0, k + 3) if k > 0 else -1
    if k < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        locator = at(tail_at + k - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end = at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end, 32)
    raw, p, found = at(start, length), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        stored, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, p + 20)
        header = struct.unpack_from("<I", raw, p + 42)[0]
        name = raw[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        q, stop = p + 46 + n_name, p + 46 + n_name + n_extra
        while q + 4 <= stop:
            kind, n = struct.unpack_from("<HH", raw, q)
            if kind == 1:  # 64-bit values of just those fields that are full
                wide = iter(struct.unpack_from(f"<{n // 8}Q", raw, q + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + n
        found[name] = Member(name, method, full, stored, header)
        p = stop + n_comment
    return found


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin, past its local header."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    file.seek(member.header)
    local = file.read(30)
    if local[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def read_package(file) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """(headers, block, offset, length) of a package's records, in the order of its data."""
    members = directory(file)
    start = data_start(file, members[INDEX])
    file.seek(start)
    index = file.read(members[INDEX].size).decode()
    entries = sorted((json.loads(line.split(" ", 2)[2]) for line in index.splitlines()), key=lambda x: (x["filename"], x["offset"]))
    starts = {name: data_start(file, members[name]) for name in {x["filename"] for x in entries}}
    for x in entries:
        file.seek(starts[x["filename"]] + x["offset"])
        yield *parsed(file.read(x["length"])), x["offset"], x["length"]


def _packages(folder: str, size: int):
    """(id, url, payload, refers_to) -> (path, n_records): writes packages below folder."""
    names = ["path", "n_records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(folder)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        ahead = next(rows, None)
        while ahead is not None:

            def until_full():
                nonlocal ahead
                held = 0
                while ahead is not None and (not held or held + len(ahead[2]) <= size):
                    key, url, payload, refers_to = ahead
                    held += len(payload) + 1
                    yield f"urn:page:{key}" if key is not None else f"urn:uuid:{uuid.uuid4()}", url, payload, None if refers_to is None else f"urn:page:{refers_to}"
                    ahead = next(rows, None)

            name = f"{uuid.uuid4().hex}.wacz"  # a task that runs again writes another; the manifest names those of the one that counts
            with where.open_output_stream(f"{top}/{name}") as out:
                n = write_package(out, until_full())
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64())], names=names)

    return run


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system's name."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def write_archives(pages: DataFrame, least: int = 0, size: int = PACKAGE) -> DataFrame:
    """pages(page_id long, url string, html string, ...) -> (path, n_records) of the
    packages that hold a record for each row, in the shared folder.

    Of rows with equal payloads (html in UTF-8, null as empty) of at least ``least``
    bytes, those with the smallest page_id are responses, others revisits of it; smaller
    payloads are all responses. A row with a null page_id is a response, never revisited.
    """
    spark = pages.sparkSession
    base.tune(spark)
    folder = qualified(spark, base.place(spark, "warc"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = base.lean(pages, "page_id", "url", "html").select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    several = pages.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    several = base.written(several.where("first < last").select("digest", "first"), "payloads")
    linked = pages.join(F.broadcast(several) if several.count() <= FEW else several, "digest", "left")
    rows = linked.select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))
    return base.written(base.mapped(rows, _packages(folder, size), "path string, n_records long"), "manifest")


def _records(payloads: bool):
    kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)
            rows.clear()
            held = 0
            return batch

        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_file(name) as file:
                    for fields, block, offset, length in read_package(file):
                        body = block.partition(b"\r\n\r\n")[2]
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and sha1_base32(body) != digest:
                            raise ValueError(f"{path}, record at {offset}: its payload doesn't have its digest")
                        url = fields.get("warc-target-uri")
                        if url is not None:
                            url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        n = int(fields["x-payload-length"]) if revisit else len(body)
                        refers_to = fields.get("warc-refers-to")
                        rows.append((path, offset, length, fields["warc-record-id"].strip("<>"), fields["warc-type"], url, refers_to and refers_to.strip("<>"), digest, n, body if payloads and not revisit else None))
                        held += length + 256
                        if held > base.BATCH:
                            yield flush()
        yield flush()

    return run


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """manifest(path string, ...) of ZIP packages -> a row per record: path, offset, length
    (of its bytes in the data member), record_id, record_type, url, refers_to, payload_digest,
    payload_bytes (of the full payload, for revisits too), payload (null for revisits, and
    for all if payloads is False). Responses are checked against their digests. Each task
    takes whole packages and reads one record at a time.
    """
    spark = manifest.sparkSession
    base.tune(spark)
    paths = manifest.select("path").repartition(base.parts(spark), "path")
    return base.mapped(paths, _records(payloads), "path string, offset long, length long, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, payload binary")
