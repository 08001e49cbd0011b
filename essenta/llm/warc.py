"""WARC records in ZIP-packaged web archives, written and range-read without extraction.

A package is a ZIP file whose members are stored: ``archive/data.warc.gz`` with one gzip
member per record, and ``indexes/index.cdxj`` with a line per record (offset and length
inside the archive member). The reader looks at the end of a package for the end record,
follows the ZIP64 locator where there is one, walks the central directory to the stored
members, reads the index and then fetches records by byte ranges of the package itself.

Listing packages, reading indexes and reading records are separate distributed steps; a
record step gets the ranges of about ``RANGE_BYTES`` of one package. Files are reached
through ``pyarrow.fs``, so the folder can be in any store that it knows.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the ZIP format: signatures and record layouts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_REVISIT, PACKAGE_BYTES, RANGE_BYTES, TASK_BYTES = 100, 256 << 20, 4 << 20, 128 << 20
RECORD_DATE = "2024-01-01T00:00:00Z"  # the pages carry no capture time


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


# ---- writing -------------------------------------------------------------------------


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP header of its capture and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    named = lambda x: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{x}").urn
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <{named(page_id)}>",
        f"WARC-Date: {RECORD_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{named(refers_to)}>", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class PackageWriter:
    """Streams stored members into a ZIP file; sizes and sums follow in data descriptors."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name, self.at, 0, 0
        raw = name.encode()
        # a ZIP64 extra field in the local header says that the descriptor has 64-bit sizes
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45, 0x0808, 0, 0, 0x21, 0, MAX32, MAX32, len(raw), len(extra)) + raw + extra)
        self.data_start = self.at

    def write(self, data: bytes) -> int:
        """Offset of ``data`` inside the member."""
        where = self.size
        self.crc = zlib.crc32(data, self.crc)
        self.size += len(data)
        self._put(data)
        return where

    def end(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.crc, self.size, self.size))
        self.members.append((self.name.encode(), self.start, self.crc, self.size))

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.members:
            wide = self.zip64 or max(offset, size) >= MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            n, o = (MAX32, MAX32) if wide else (size, offset)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, n, n, len(raw), len(extra), 0, 0, 0, 0, o) + raw + extra)
        size, count = self.at - start, len(self.members)
        wide = self.zip64 or start >= MAX32
        if wide:
            end64 = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", END64, 44, 45, 45, 0, 0, count, count, size, start))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, end64, 1))
        self._put(struct.pack("<4sHHHHIIH", END, 0, 0, count, count, size, MAX32 if wide else start, 0))


def _write_step(folder: str, zip64: bool, package_bytes: int):
    """Each attempt of a task writes packages under names of its own and reports those it finished."""

    def step(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        writer = out = None
        lines: list[str] = []
        number, done = 0, []

        def finish():
            nonlocal writer, number
            writer.end()
            writer.begin(INDEX)
            writer.write("".join(sorted(lines)).encode())
            writer.end()
            writer.close()
            out.close()
            done.append((name, len(lines), writer.at))
            number, writer = number + 1, None
            lines.clear()

        for batch in batches:
            for page_id, url, payload, digest, refers_to, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    name = f"part-{task.partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.wacz"
                    out = fs.open_output_stream(f"{root}/{name}")
                    writer = PackageWriter(out, zip64)
                    writer.begin(ARCHIVE)
                data = gzip_member(record_bytes(page_id, url, payload, digest, refers_to, is_revisit))
                at = writer.write(data)
                entry = {"offset": at, "length": len(data), "filename": ARCHIVE, "digest": f"sha256:{digest}"}
                lines.append(f"{url_key(url)} {re.sub('[^0-9]', '', RECORD_DATE)} {json.dumps(entry)}\n")
                if writer.at >= package_bytes:
                    finish()
        if writer is not None:
            finish()
        columns = list(zip(*done)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["package", "records", "bytes"])

    return step


def url_key(url: str | None) -> str:
    """Sort key of the index: reversed host, then the path; never with white space."""
    m = re.match(r"(?:\w+://)?([^/?#]*)([^#]*)", re.sub(r"\s", "", (url or "").lower()))
    return ",".join(reversed(m[1].split("."))) + ")" + (m[2] or "/")


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, is_revisit`` of ``pages (page_id, url, html)``.

    Of equal payloads of at least ``LEAST_REVISIT`` bytes the smallest page_id is the
    response and the others revisit it. Rows that repeat this page_id, and all rows of a group
    without any page_id, are responses too; other rows without one are revisits.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    joined = rows.join(groups.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("is_revisit"))


def write_packages(pages: DataFrame, folder: str, zip64: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``pages`` as packages into ``folder``; returns ``package, records, bytes`` of each.

    The list of packages is a table in ``folder`` that Spark commits when all tasks are done,
    so files of lost or repeated attempts are never read. No pages give no package.
    """
    written = with_revisits(pages).mapInArrow(_write_step(f"{folder}/packages", zip64, package_bytes), "package string, records long, bytes long")
    written.write.parquet(f"{folder}/contents")
    return pages.sparkSession.read.schema(written.schema).parquet(f"{folder}/contents")


# ---- reading -------------------------------------------------------------------------


def central_directory(source, size: int) -> dict[str, tuple[int, int, int]]:
    """``name: (data offset, stored size, method)`` of a ZIP file open for random reads."""

    def read(at: int, n: int) -> bytes:
        if at < 0 or at + n > size:
            raise ValueError("damaged package: a record lies outside the file")
        source.seek(at)
        return source.read(n)

    tail_at = max(0, size - MAX16 - 22)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(END)
    while k >= 0 and (len(tail) - k < 22 or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(END, 0, k)  # the signature can be part of the comment
    if k < 0:
        raise ValueError("not a package: no end record")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    where = tail_at + k - 20
    if MAX16 in (count,) or MAX32 in (length, start) or (where >= 0 and read(where, 4) == LOCATOR64):
        signature, _, end64, _ = struct.unpack("<4sIQI", read(where, 20))
        if signature == LOCATOR64:
            head = read(end64, 56)
            if head[:4] != END64:
                raise ValueError("damaged package: no ZIP64 end record")
            count, length, start = struct.unpack_from("<QQQ", head, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at:at + 4] != CENTRAL:
            raise ValueError("damaged package: no directory entry")
        method, = struct.unpack_from("<H", directory, at + 10)
        packed, plain, names, extras, comment = struct.unpack_from("<IIHHH", directory, at + 20)
        offset, = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46:at + 46 + names].decode()
        extra, e = directory[at + 46 + names:at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                plain = next(wide) if plain == MAX32 else plain
                packed = next(wide) if packed == MAX32 else packed
                offset = next(wide) if offset == MAX32 else offset
            e += 4 + n
        local = read(offset, 30)
        if local[:4] != LOCAL:
            raise ValueError("damaged package: no member header")
        a, b = struct.unpack_from("<HH", local, 26)
        found[name] = (offset + 30 + a + b, packed, method)
        at += 46 + names + extras + comment
    return found


def _index_step(root: str, range_bytes: int):
    """Packages in, ranges of consecutive records out."""

    def step(batches):
        fs, top = file_system(root)
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                path = f"{top}/{name}"
                with fs.open_input_file(path) as f:
                    members = central_directory(f, f.size())
                    for member in (x for x in members if x.startswith("indexes/")):
                        at, size, method = members[member]
                        if method:
                            raise ValueError(f"{name}: {member} is not stored")
                        f.seek(at)
                        entries = [json.loads(line.split(" ", 2)[2]) for line in f.read(size).decode().splitlines()]
                        by_file = defaultdict(list)
                        for e in entries:
                            by_file[e["filename"]].append((int(e["offset"]), int(e["length"])))
                        for filename, spans in by_file.items():
                            base, _, method = members[filename]
                            if method:
                                raise ValueError(f"{name}: {filename} is not stored")
                            spans.sort()
                            first = 0
                            for k in range(len(spans)):
                                if k + 1 == len(spans) or spans[k + 1][0] - spans[first][0] >= range_bytes:
                                    out.append((name, [base + o for o, _ in spans[first:k + 1]], [n for _, n in spans[first:k + 1]]))
                                    first = k + 1
            yield pa.RecordBatch.from_pydict({
                "package": pa.array([x[0] for x in out], pa.string()), "offsets": pa.array([x[1] for x in out], pa.list_(pa.int64())),
                "lengths": pa.array([x[2] for x in out], pa.list_(pa.int64()))})

    return step


def parse_record(data: bytes) -> dict:
    """Headers (lower-case names), HTTP headers and payload of one WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    out = {k.lower(): v for k, v in fields.items()}
    block = rest[:int(out["content-length"])]
    if len(block) != int(out["content-length"]):
        raise ValueError("a record is cut off")
    http, _, payload = block.partition(b"\r\n\r\n")
    out["http"] = {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:])}
    out["payload"] = payload
    return out


def _record_step(root: str, with_payload: bool):
    def step(batches):
        fs, top = file_system(root)
        for batch in batches:
            for name, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                out = defaultdict(list)
                with fs.open_input_file(f"{top}/{name}") as f:
                    f.seek(offsets[0])
                    chunk = f.read(offsets[-1] + lengths[-1] - offsets[0])
                for at, n in zip(offsets, lengths):
                    record = parse_record(zlib.decompress(chunk[at - offsets[0]:at - offsets[0] + n], 31))
                    kind, said = record["warc-type"], record["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(record["payload"]).hexdigest() != said:
                        raise ValueError(f"{name}: a payload does not match its digest")
                    key, refers = record.get("x-page-id"), record.get("x-refers-to-page-id")
                    out["page_id"].append(None if key is None else int(key))
                    out["url"].append(record["warc-target-uri"])
                    # a revisit states the size of the payload it repeats in its HTTP header
                    out["payload_bytes"].append(int(record["http"]["content-length"]) if kind == "revisit" else len(record["payload"]))
                    out["payload_digest"].append(said)
                    out["record_type"].append(kind)
                    out["refers_to"].append(None if refers is None else int(refers))
                    out["captured_at"].append(datetime.strptime(record["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc))
                    out["payload"].append(record["payload"] if with_payload and kind == "response" else None)
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    return step


def read_packages(spark: SparkSession, folder: str, with_payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the packages in ``folder``: ids, digests, sizes, types and payloads.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, for revisits too; the
    payload itself is with the response that ``refers_to`` names. No packages give no rows.
    Page ids are whole numbers; a record with another one ends the reading with a ValueError.
    """
    packages = spark.read.schema("package string, bytes long").parquet(f"{folder}/contents")
    count, size = packages.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    least = 3 * spark.sparkContext.defaultParallelism
    # numbers are given, as adaptive execution would put the few names and ranges into one task
    tasks = lambda units: max(1, min(units, max(least, size // TASK_BYTES)))
    ranges = packages.select("package").repartition(tasks(count), "package").mapInArrow(
        _index_step(f"{folder}/packages", range_bytes), "package string, offsets array<long>, lengths array<long>")
    return ranges.repartition(tasks(count + size // range_bytes), "package", F.get("offsets", F.lit(0))).mapInArrow(
        _record_step(f"{folder}/packages", with_payload),
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, captured_at timestamp, payload binary")
