"""WARC records in ZIP-packaged archives, written by tasks and read back by byte ranges.

An archive is a ZIP file with two stored (not deflated) members: ``archive/data.warc.gz``,
in which every record is a gzip member of its own, and ``indexes/index.cdxj``, which names
each record's offset and length inside the first.  The reader never extracts a member: it
finds the end-of-central-directory record (the ZIP64 one where the archive has it), parses
the central directory, turns each stored member into a byte range of the file, reads the
index, and then range-reads single records, in a task for every 16 MB of them.

Writing tasks give each archive a name of its own; only archives named in the committed
manifest are read, so a lost executor or a repeated task leaves at most an orphan file.
Archives are rolled at ``ARCHIVE_BYTES`` of payload, so memory is one record plus one
archive's index, and a hot payload is spread by the join's skew handling.

A null html is an empty payload; a null url writes no target header; null page ids keep
their records, cannot be referred to, and read back as null; rows that repeat the smallest
page id of a payload are all responses; an empty table gives no archive and no row.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import io
import json
import math
import struct
import uuid
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import Scratch, table

DATA = "archive/data.warc.gz"
INDEX = "indexes/index.cdxj"
#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
#: Bytes of one archive that one reading task takes.
RANGE_BYTES = 16 << 20


# ---- files -----------------------------------------------------------------------------

def _fs(path: str):
    from pyarrow import fs
    if "://" not in path:
        path = path[5:] if path.startswith("file:") else path
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Ranges:
    """Byte ranges of one file."""

    def __init__(self, path: str):
        fs, at = _fs(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def read(self, start: int, n: int) -> bytes:
        if start < 0 or n < 0 or start + n > self.size:
            raise ValueError(f"range {start}+{n} lies outside a file of {self.size} bytes")
        return self.file.read_at(n, start)

    def close(self):
        self.file.close()


# ---- ZIP directories -------------------------------------------------------------------

# Fixed values of the ZIP format: signatures and the marker "see the ZIP64 field"
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _directory(f) -> tuple[int, int, int]:
    """Offset, size and entry count of the central directory."""
    tail_at = max(0, f.size - (22 + FULL16))  # the comment has at most 65535 bytes
    tail = f.read(tail_at, f.size - tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(END, 0, at)  # the signature can also occur inside the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut off")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == entries or FULL32 in (size, offset):
        locator = f.read(tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("the ZIP64 locator is missing")
        end64 = f.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("the ZIP64 end of central directory is missing")
        entries, size, offset = struct.unpack_from("<QQQ", end64, 32)
    return offset, size, entries


def members(f) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data in the file, bytes) of every stored member."""
    offset, size, entries = _directory(f)
    block, at, found = f.read(offset, size), 0, {}
    for _ in range(entries):
        if block[at:at + 4] != CENTRAL:
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<HH", block, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", block, at + 20)
        header = struct.unpack_from("<I", block, at + 42)[0]
        name = block[at + 46:at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, x = block[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while x + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, x)
            if kind == 1:  # ZIP64: 8-byte values of the fields that are full, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, x + 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            x += 4 + n
        at += 46 + n_name + n_extra + n_comment
        if method == 0:
            local = f.read(header, 30)
            if local[:4] != LOCAL:
                raise ValueError(f"the local header of {name} is damaged")
            found[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return found


# ---- records ---------------------------------------------------------------------------

def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def encode_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record (its own gzip member): a response, or a revisit without payload."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"),
            ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", "2024-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        block = http + b"\r\n"
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 6, mtime=0)


def decode_record(raw: bytes) -> tuple[dict, bytes]:
    """Headers (lower-case names) and the payload below the HTTP header."""
    data = gzip.decompress(raw)
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = rest[:int(head["content-length"])]
    return head, block.partition(b"\r\n\r\n")[2]


def _page(urn: str | None):
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


# ---- writing ---------------------------------------------------------------------------

class _Archive:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        fs, at = _fs(self.path)
        self.out = fs.open_output_stream(at)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index, self.at, self.raw = io.StringIO(), 0, 0

    def add(self, page_id, url, payload, digest, refers_to):
        record = encode_record(page_id, url, payload, digest, refers_to)
        self.data.write(record)
        self.index.write(json.dumps({"urn": f"page:{page_id}", "offset": self.at, "length": len(record)}) + "\n")
        self.at += len(record)
        self.raw += len(payload)

    def close(self) -> str:
        self.data.close()
        self.zip.writestr(INDEX, self.index.getvalue())
        self.zip.close()
        self.out.close()
        return self.path


def with_references(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (null for revisits), digest, refers_to."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    big = F.octet_length("html") >= REVISIT_BYTES
    # one row per payload that occurs more than once: partial aggregation before the shuffle
    first = (base.where(big).groupBy(F.col("digest").alias("d"))
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    joined = base.join(first, big & (F.col("digest") == F.col("d")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("payload"), "digest",
                         F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records where they lie, no shuffle; the manifest: (path, records)."""

    def write(batches):
        archive, n, done = None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                archive = archive or _Archive(folder)
                archive.add(r["page_id"], r["url"], (r["payload"] or "").encode(), r["digest"], r["refers_to"])
                n += 1
                if archive.raw >= archive_bytes:
                    done.append((archive.close(), n))
                    archive, n = None, 0
        if archive:
            done.append((archive.close(), n))
        import pyarrow as pa
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()),
                                          pa.array([d[1] for d in done], pa.int64())], ["path", "records"])

    return records.mapInArrow(write, "path string, records long")


# ---- reading ---------------------------------------------------------------------------

def read_index(archives: DataFrame) -> DataFrame:
    """(path, start, length) of every record: absolute ranges in the ZIP files."""

    def locate(batches):
        import pandas as pd
        for pdf in batches:
            for path in pdf["path"]:
                f = Ranges(path)
                found = members(f)
                base, size = found[DATA]
                lines = f.read(*found[INDEX]).decode().splitlines()
                f.close()
                rows = [json.loads(x) for x in lines]
                if any(r["offset"] + r["length"] > size for r in rows):
                    raise ValueError(f"{path}: the index points beyond the records")
                yield pd.DataFrame({"path": path, "start": [base + r["offset"] for r in rows],
                                    "length": [r["length"] for r in rows]}).astype({"start": "int64", "length": "int64"})

    return archives.select("path").mapInPandas(locate, "path string, start long, length long")


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """page_id, type, digest (of the payload as read, or as told by a revisit), refers_to,
    payload_bytes and, where asked for, the payload."""
    schema = "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary"

    def read(batches):
        import hashlib

        import pandas as pd
        path, f = None, None
        for pdf in batches:
            out = []
            for p, start, length in zip(pdf["path"], pdf["start"], pdf["length"]):
                if p != path:
                    if f:
                        f.close()
                    path, f = p, Ranges(p)
                head, payload = decode_record(f.read(int(start), int(length)))
                told = head["warc-payload-digest"].removeprefix("sha256:")
                is_revisit = head["warc-type"] == "revisit"
                if not is_revisit and hashlib.sha256(payload).hexdigest() != told:
                    raise ValueError(f"{p}: the payload of {head['warc-record-id']} doesn't match its digest")
                out.append((_page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], told,
                            _page(head.get("warc-refers-to")), None if is_revisit else len(payload),
                            payload if payloads and not is_revisit else None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype(
                {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})
        if f:
            f.close()

    part = F.floor(F.col("start") / RANGE_BYTES)
    # the rows are small whatever the ranges hold, so the number of tasks comes from the bytes behind them
    total = ranges.agg(F.sum("length")).first()[0] or 0
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, math.ceil(total / RANGE_BYTES))
    spread = ranges.repartition(tasks, "path", part).sortWithinPartitions("path", "start")
    return spread.mapInPandas(read, schema)


def op7_zip_warc(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex[:16]}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    # tasks need the file system's name too: a bare path would be each executor's own disk
    folder = fs.makeQualified(at).toString()
    manifest = scratch.write(write_archives(with_references(table(spark, sf_dir, "pages")), folder), "manifest")
    index = scratch.write(read_index(manifest), "index")
    found = scratch.write(read_records(index, payloads=False).drop("payload", "url"), "records")
    scratch.drop("index")
    # a revisit has the length of the record that it refers to
    whole = found.where("record_type = 'response' and page_id is not null").groupBy(
        F.col("page_id").alias("p"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("bytes"))
    revisits = (found.where("record_type = 'revisit'")
                .join(whole, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
                .withColumn("payload_bytes", F.col("bytes")).drop("p", "d", "bytes"))
    return found.where("record_type = 'response'").unionByName(revisits).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM f
"""

QUERIES = {"op7_zip_warc": op7_zip_warc}
ORACLE = {"op7_zip_warc": _SQL}
