"""WARC archives: one gzip member per record, read back in byte ranges.

Writing: each task writes one archive file under a name of its own into the shared folder and reports it;
only files in the written report belong to the archive, so retried or lost tasks leave nothing that is read.
Records with equal payloads are stored once, the others are ``revisit`` records that name the stored one.

Reading: files are cut into byte ranges. A task looks for the gzip magic in its range, tries to decode the
header of a WARC record at each candidate, and owns the records that start in the range; the last record
is read past the range's end. Magic bytes inside a compressed record fail the trial and are passed over.

Files are opened with pyarrow's file systems, so the folder may be local, HDFS or an object store.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.session import materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 18
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "record_type string, key long, target string, digest string, refers_to long, payload_length long, payload binary, path string, offset long"


def sha1_base32(column: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 5 hex digits are 4 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts, hexed = [], F.sha1(column)
    for k in range(8):
        n = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(letters), F.shiftright(n, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def plan_records(pages: DataFrame, key: str, url: str, html: str, least: int = 0) -> DataFrame:
    """key, url, payload, payload_digest and the key of the record it revisits (null: it is a response).

    Of equal payloads of at least ``least`` bytes the largest key is the response. Null html is an empty
    payload. Null keys are smaller than any other and are responses if all keys of the group are null; rows
    that repeat the largest key are responses all.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("target"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", sha1_base32(F.col("payload")))
    first = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("key").alias("stored"))
    known = rows.join(first, "digest", "left")
    other = F.col("stored").isNotNull() & ~F.col("key").eqNullSafe(F.col("stored"))
    return known.select("key", "target", "payload", "digest", F.when(other, F.col("stored")).alias("refers_to"))


def _record(key, target, payload: bytes, digest: str, refers_to) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{key}")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if key is not None:
        head.append(f"Page-Key: {key}")
    if target is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c not in "%\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in target))
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {len(payload)}"]
    if refers_to is None:
        body = _HTTP + payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        body = _HTTP
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"Refers-To-Key: {refers_to}", "Content-Type: application/http; msgtype=response"]
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write_archive(records: DataFrame, folder: str) -> DataFrame:
    """Writes the planned records; returns the report (path, bytes, records), itself written down."""

    def run(batches):
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        path, out, size, count = f"{root}/part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for n in range(batch.num_rows):
                packed = _record(*(c[n].as_py() for c in columns))
                out = out or store.open_output_stream(path, compression=None)
                out.write(packed)
                size, count = size + len(packed), count + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([count])], ["path", "bytes", "records"])

    rows = records.select("key", "target", "payload", "digest", "refers_to")
    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-report")


class _Bytes:
    """Bytes of a file from a place on, fetched as they are needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, b""

    def upto(self, end: int) -> bool:
        while self.start + len(self.data) < min(end, self.size):
            self.file.seek(self.start + len(self.data))
            self.data += self.file.read(min(READ_BYTES, self.size - self.start - len(self.data)))
        return end <= self.size

    def drop(self, place: int) -> None:
        self.data, self.start = self.data[place - self.start :], place


def _member(view: _Bytes, place: int) -> tuple[bytes, int] | None:
    """The text of the gzip member at a place and where the next one starts; None if there is no WARC record."""
    unpack, out, at, known = zlib.decompressobj(31), [], place, b""
    while not unpack.eof:
        if not view.upto(at + 1):
            return None
        piece = view.data[at - view.start :]
        try:
            got = unpack.decompress(piece)
        except zlib.error:
            return None
        out.append(got)
        if len(known) < 8:
            known += got[:8]
            if not b"WARC/1.1".startswith(known[:8]):
                return None
        at += len(piece)
    return b"".join(out), at - len(unpack.unused_data)


def _parse(text: bytes) -> dict | None:
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        return None
    kind, target = fields["WARC-Type"], fields.get("WARC-Target-URI")
    number = lambda name: int(fields[name]) if name in fields else None
    if target is not None:
        target = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), target.encode()).decode()
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    return {
        "record_type": kind, "key": number("Page-Key"), "target": target, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number("Refers-To-Key"), "payload_length": number("Payload-Length"), "payload": payload if kind == "response" else None,
    }


def read_range(store, path: str, start: int, end: int, size: int):
    """Records of a file that start in [start, end), whatever the range cuts through."""
    with store.open_input_file(path) as file:
        view, place, synced = _Bytes(file, start, size), start, start == 0
        while place < end:
            view.upto(place + READ_BYTES)
            if not synced:
                hit = view.data.find(MAGIC, place - view.start)
                if hit < 0:
                    place = max(place, view.start + len(view.data) - len(MAGIC) + 1)
                    if not view.upto(place + len(MAGIC)):
                        return
                    view.drop(place)
                    continue
                place = view.start + hit
                if place >= end:
                    return
            member = _member(view, place)
            if member is None:
                if synced:
                    raise ValueError(f"{path}: no WARC record at byte {place}")
                place += 1
                continue
            text, following = member
            record = _parse(text)
            if record is None:
                raise ValueError(f"{path}: broken record at byte {place}")
            synced = True
            yield record | {"path": path, "offset": place}
            place = following
            view.drop(place)


def read_archive(spark: SparkSession, report: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the reported files (schema ``RECORD``). Each range is dealt to a task of its own number, so the
    tasks grow with the bytes; a number that is given is not merged at run time."""
    ranges = report.select("path", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / range_bytes))).alias("part"))
    ranges = ranges.select("path", "bytes", (F.col("part") * range_bytes).alias("start"))
    ranges = ranges.repartition(max(1, ranges.count()), F.col("path"), F.col("start"))

    def run(batches):
        store = fs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else fs.LocalFileSystem()
        names = [f.strip().split(" ")[0] for f in RECORD.split(",")]
        schema = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.strip().split(" ")[1]]) for n, f in zip(names, RECORD.split(","))])
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for record in read_range(store, path, start, min(start + range_bytes, size), size):
                    if record["payload"] is not None:
                        own = base64.b32encode(hashlib.sha1(record["payload"]).digest()).decode()
                        if own != record["digest"] or len(record["payload"]) != record["payload_length"]:
                            raise ValueError(f"{path}: payload at byte {record['offset']} does not match its digest")
                    rows.append(record)
                    held += len(record["payload"] or b"")
                    if held > READ_BYTES * 8:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(run, RECORD)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes the pages as archives into the shared folder and reads them back: the record table."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    report = write_archive(plan_records(pages, key, url, html, least), folder)
    return read_archive(spark, report, folder, range_bytes)
