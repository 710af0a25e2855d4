"""WARC archives in ZIP packages: written by tasks to the shared folder and read back by byte ranges.

Each writing task makes one package: a stored (not compressed) member archive/data.warc.gz whose records are gzip members
of their own, a stored index member indexes/index.cdx with offset and length of every record, and datapackage.json.
The reader never extracts a package. It reads the end record, the ZIP64 end record if there is one, and the central
directory, finds the data of the stored members, reads the index, and then reads each record by its range.

Equal payloads are found in the JVM by their digest with partial aggregation (largest id of each digest); only digests
that occur twice travel. All rows of such a digest but those with the largest id become revisit records.

Files are named by task attempt, and only the names that successful tasks returned are read, so a lost executor leaves
at most an unused file. Paths go through pyarrow's file systems; the folder is spark.checkpoint.dir.

Defined cases: null and empty pages have the empty payload, which takes part in revisits if `min_revisit_bytes` is 0;
null urls have no target header; of repeated rows that share the largest id of their payload each is a
response; a null id is never referred to unless all ids of the payload are null; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:id:{quote(page_id, safe='')}>"


def id_of(uri: str | None) -> str | None:
    return unquote(uri[len("<urn:page:id:") : -1]) if uri and uri.startswith("<urn:page:id:") else None


def make_record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str = DATE) -> bytes:
    """One response or revisit record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased names) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


class PackageWriter:
    """Streams records into a ZIP package; nothing but the index stays in memory."""

    def __init__(self, sink, level: int = 1):
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.level, self.at, self.index = level, 0, []
        self._put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: %s\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (str(uuid.uuid4()).encode(), DATE.encode()))

    def _put(self, record: bytes) -> tuple[int, int]:
        data = gzip.compress(record, self.level, mtime=0)
        self.member.write(data)
        place = self.at, len(data)
        self.at += len(data)
        return place

    def add(self, page_id: str | None, record: bytes) -> None:
        offset, length = self._put(record)
        self.index.append(f"{record_id(page_id)} {offset} {length}\n")

    def close(self) -> None:
        self.member.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("".join(self.index).encode())
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}], "records": len(self.index)}))
        self.zip.close()


class PackageReader:
    """Stored members of a ZIP package, by ranges. `read(offset, length)` gives bytes, `size` is the package's length."""

    def __init__(self, read, size: int):
        self.read, self.size = read, size
        self.members = self._directory()

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """name -> offset of the local header, stored length, method."""
        tail_at = max(0, self.size - 65_557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":  # ZIP64 locator
            (at,) = struct.unpack_from("<Q", tail, end - 12)
            record = self.read(at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        data, at, out = self.read(start, length), 0, {}
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            method, packed, full = struct.unpack_from("<10xH8xII", data, at)
            n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
            (offset,) = struct.unpack_from("<I", data, at + 42)
            name = data[at + 46 : at + 46 + n_name].decode()
            extra = data[at + 46 + n_name : at + 46 + n_name + n_extra]
            packed, offset = self._zip64(extra, full, packed, offset)
            out[name] = (offset, packed, method)
            at += 46 + n_name + n_extra + n_comment
        return out

    @staticmethod
    def _zip64(extra: bytes, full: int, packed: int, offset: int) -> tuple[int, int]:
        """Values at their 32-bit maximum stand in the ZIP64 extra field, in this order and only those."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                place = at + 4 + 8 * (full == 0xFFFFFFFF)
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack_from("<Q", extra, place)
                    place += 8
                if offset == 0xFFFFFFFF:
                    (offset,) = struct.unpack_from("<Q", extra, place)
            at += 4 + size
        return packed, offset

    def data_range(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes are: offset and length."""
        offset, length, method = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is not stored")
        head = self.read(offset, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        n_name, n_extra = struct.unpack_from("<HH", head, 26)
        return offset + 30 + n_name + n_extra, length

    def records(self):
        """(headers, block) of every indexed record, each read by its own range."""
        start, length = self.data_range(INDEX)
        data_at, data_length = self.data_range(DATA)
        for line in io.BytesIO(self.read(start, length)):
            _, offset, size = line.split()
            offset, size = int(offset), int(size)
            if offset + size > data_length:
                raise ValueError("index points behind the archive")
            yield parse_record(zlib.decompress(self.read(data_at + offset, size), 31))


def _with_revisits(df: DataFrame, id_col: str, url_col: str, html_col: str, min_revisit_bytes: int) -> DataFrame:
    html = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    equal = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy(F.col("sha").alias("same")).agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    return rows.join(equal.where("n > 1"), rows.sha == F.col("same"), "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html",
        F.col("keeper").cast("string").alias("keeper"),
        F.coalesce(~F.col("page_id").eqNullSafe(F.col("keeper")) & F.col("same").isNotNull(), F.lit(False)).alias("revisit"),
    )


def write_packages(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Write all rows of df as records under `folder`; the packages: path, records. The result is already computed."""
    rows = _with_revisits(df, id_col, url_col, html_col, min_revisit_bytes)
    out = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        from pyarrow import fs

        system = writer = sink = None
        path, n = f"{folder}/{uuid.uuid4().hex}.wacz", 0
        for batch in batches:
            for part in common.slices(batch, 2):
                if writer is None:
                    system, local = fs.FileSystem.from_uri(path)
                    system.create_dir(local.rsplit("/", 1)[0], recursive=True)
                    sink = system.open_output_stream(local)
                    writer = PackageWriter(_Sink(sink))
                for page_id, url, html, keeper, revisit in zip(*(c.to_pylist() for c in part.columns)):
                    writer.add(page_id, make_record(page_id, url, html.encode(), keeper, revisit))
                    n += 1
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]}, schema=out)

    return common.written(rows.mapInArrow(run, "path string, records long"), "warc-packages")


class _Sink(io.RawIOBase):
    """A forward-only file object over an Arrow output stream."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self):
        return True

    def write(self, data):
        self.stream.write(bytes(data))
        return len(data)


def read_packages(packages: DataFrame) -> DataFrame:
    """page_id (string), url, payload (of a response, else null), payload_bytes, payload_digest, record_type, refers_to."""
    out = common.arrow_schema(READ)

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, local = fs.FileSystem.from_uri(path)
                with system.open_input_file(local) as f:
                    rows, size = [], 0
                    for headers, block in PackageReader(lambda at, n: f.read_at(n, at), f.size()).records():
                        rows.append(_row(headers, block))
                        size += len(block)
                        if size > common.SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=out)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return packages.select("path").mapInArrow(run, READ)


READ = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _row(headers: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    length = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    revisit = headers["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or digest(payload) != said):
        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    url = headers.get("warc-target-uri")
    return {
        "page_id": id_of(headers["warc-record-id"]), "url": url, "payload": None if revisit else payload, "payload_bytes": length,
        "payload_digest": said, "record_type": headers["warc-type"], "refers_to": id_of(headers.get("warc-refers-to")) if revisit else None,
    }


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    packages = write_packages(pages, common.scratch_path(spark, "warc"))
    kind = pages.schema["page_id"].dataType
    # one package a task: the list of paths is short, so it is dealt round-robin
    spread = packages.repartition(max(1, packages.count()))
    return read_packages(spread).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
