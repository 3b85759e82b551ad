"""Operator 7: WARC archives of gzip members, written by tasks and read back in byte ranges.

Writing: records with equal payloads of at least ``min_bytes`` bytes become one response (the largest id) and
revisits that refer to it. Each task writes its records to archives of its own, one gzip member a record;
only archives of committed tasks are in the returned manifest.

Reading: a task gets a byte range, scans it for the gzip magic, and takes a candidate as a record if it
inflates to a WARC header, its check sum holds and its length is the header's. It owns the records that
start inside its range, and reads on beyond the end for the last. A record is held whole, nothing else is.

Archives lie in any folder that ``pyarrow.fs`` opens by URI. Null payloads are empty payloads; null urls and
ids come back as null. Control characters of a url are written percent-encoded.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridterrain.operators.skew import join_unique
from gridterrain.scratch import cut

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values of RFC 4648
_MAGIC = b"\x1f\x8b\x08"
_ID = "urn:record:"
_DATE = "2024-01-01T00:00:00Z"
_PIECE = 1 << 14
_READ = 1 << 20
ARCHIVE_BYTES, SPLIT_BYTES = 64 << 20, 8 << 20
_MANIFEST = "path string, length long, records long"
_RECORD = "path string, at long, type string, id long, uri string, date string, payload binary, payload_length long, payload_digest string, refers_to long"


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base32: 20 bits, which are five hexadecimal digits, make four letters."""
    digits = F.sha1(data)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def plan_records(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """``(id, uri, payload, digest, refers_to)``: a row to write for each page; ``refers_to`` is null for responses.

    Rows that share the largest id of their payload are all responses; a null id is never referred to.
    Rows are shuffled by digest, those of very frequent payloads stay where they are.
    """
    text = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("uri"), text.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload")))
    groups = rows.groupBy("digest").agg(F.max("id").alias("kept"), F.count("*").alias("n_rows"))
    joined = join_unique(rows, groups, ["digest"], "n_rows")
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept"))
    return joined.select("id", "uri", "payload", "digest", F.when(revisit, F.col("kept")).alias("refers_to"))


def _member(record: dict) -> bytes:
    payload, revisit = record["payload"], record["refers_to"] is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if record['id'] is None else record['id']}>", f"WARC-Date: {_DATE}"]
    if record["uri"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", record["uri"]))
    head.append(f"WARC-Payload-Digest: sha1:{record['digest']}")
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{record['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_warc(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write planned records below ``folder``; the manifest ``(path, length, records)``, itself a written table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "length": size, "records": n}], schema=pa.schema([("path", pa.string()), ("length", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for record in batch.slice(start, 256).to_pylist():
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    member = _member(record)
                    out.write(member)
                    size, n = size + len(member), n + 1
                    if size >= archive_bytes:
                        yield done()
                        out = None
        if out is not None:
            yield done()

    return cut(records.mapInArrow(write, _MANIFEST), "manifest")


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of the archives in a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


class _Bytes:
    """A file seen through one buffer that moves forward."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Bytes from ``at`` on, ``n`` at most, fewer only at the end of the file."""
        if at < self.base or at + n > self.base + len(self.held):
            self.base, self.held = at, self.file.read_at(max(0, min(max(n, _READ), self.size - at)), at)
        return self.held[at - self.base : at - self.base + n]


def _inflate(data: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The member at ``at`` and its packed length, if it is whole and begins as a WARC record."""
    unpack, parts, fed, sure = zlib.decompressobj(31), [], 0, False
    try:
        while not unpack.eof:
            piece = data.get(at + fed, _PIECE)
            if not piece:
                return None
            fed += len(piece)
            parts.append(unpack.decompress(piece))
            if not sure:
                begin = b"".join(parts)[:7]
                if not b"WARC/1.".startswith(begin):
                    return None
                sure = len(begin) == 7
    except zlib.error:
        return None
    return (b"".join(parts), fed - len(unpack.unused_data)) if sure else None


def _parse(member: bytes) -> dict | None:
    head, gap, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    fields = {k.lower(): v for k, v in fields.items()}
    if not gap or not fields.get("content-length", "").isdigit() or "warc-type" not in fields or len(rest) != int(fields["content-length"]) + 4:
        return None
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length: *(\d+)", http)
    number = lambda v: int(m[1]) if v and (m := re.fullmatch(rf"<{_ID}(-?\d+)>", v)) else None
    whole = fields["warc-type"] != "revisit"
    return {
        "type": fields["warc-type"], "id": number(fields.get("warc-record-id")), "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
        "payload": payload if whole else None, "payload_length": int(length[1]) if length else len(payload),
        "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number(fields.get("warc-refers-to")),
    }


def _records(data: _Bytes, start: int, end: int) -> Iterator[dict]:
    at = start
    while at < end:
        if data.get(at, len(_MAGIC)) != _MAGIC:
            seen = data.get(at, min(_READ, end - at + len(_MAGIC) - 1))
            found = seen.find(_MAGIC)
            at += found if found >= 0 else max(1, len(seen) - len(_MAGIC) + 1)
            continue
        member = _inflate(data, at)
        record = _parse(member[0]) if member else None
        if record:
            yield {"at": at} | record
        at += member[1] if record else 1


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of ``(path, length)`` archives, each read by the task in whose byte range it starts.

    Columns: ``path``, ``at`` (offset), ``type``, ``id``, ``uri``, ``date``, ``payload`` (null for revisits), ``payload_length``,
    ``payload_digest``, ``refers_to``. Bytes that are no whole record are passed over; no archives give no rows.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    ranges = archives.select("path", "length", F.explode(starts).alias("start"))
    ranges = ranges.repartition(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path", "start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("type", pa.string()), ("id", pa.int64()), ("uri", pa.string()), ("date", pa.string()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for part in batch.to_pylist():
                fs, path = _open(part["path"])
                rows, size = [], 0
                with fs.open_input_file(path) as file:
                    for record in _records(_Bytes(file, part["length"]), part["start"], min(part["start"] + split_bytes, part["length"])):
                        rows.append({"path": part["path"]} | record)
                        size += len(record["payload"] or b"")
                        if size > _READ or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return ranges.mapInArrow(read, _RECORD)
