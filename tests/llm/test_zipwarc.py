import hashlib
import io
import zipfile

import pytest
from pyspark.sql import types as T

from lacuna.llm import zipwarc as Z
from lacuna.llm.common import Scratch

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("path", T.IntegerType())])


class Bytes:
    def __init__(self, data):
        self.data, self.size, self.asked = data, len(data), []

    def read(self, start, n):
        assert 0 <= start and start + n <= self.size
        self.asked.append((start, n))
        return self.data[start:start + n]


def packed(names, comment=b"", method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.comment = comment
        for name, data in names.items():
            z.writestr(name, data)
    return out.getvalue()


def test_directory_of_stored_members():
    names = {"a/x": b"first" * 50, "b/é.txt": b"second", "empty": b""}
    for comment in (b"", b"a comment", b"PK\x05\x06" + b"z" * 40):
        f = Bytes(b"leading bytes are fine"[:0] + packed(names, comment))
        got = Z.members(f)
        assert {n: f.data[s:s + k] for n, (s, k) in got.items()} == names


def test_deflated_members_are_not_located():
    assert Z.members(Bytes(packed({"a": b"x" * 500}, method=zipfile.ZIP_DEFLATED))) == {}


def test_zip64_directory(monkeypatch):
    names = {f"m{i}": bytes([i]) * (100 + i) for i in range(30)}
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 5)
    f = Bytes(packed(names))
    assert Z.END64 in f.data and Z.LOCATOR64 in f.data
    assert {n: f.data[s:s + k] for n, (s, k) in Z.members(f).items()} == names


def test_broken_archives_are_refused():
    data = packed({"a": b"x" * 200})
    for bad in (b"", b"not a zip at all", data[:-30]):
        with pytest.raises(ValueError):
            Z.members(Bytes(bad))


def test_records_round_trip():
    raw = Z.encode_record(7, "http://a/\r\nb", "héllo\r\n\r\nworld".encode(), "d", None)
    head, payload = Z.decode_record(raw)
    assert payload.decode() == "héllo\r\n\r\nworld" and head["warc-type"] == "response" and head["warc-target-uri"] == "http://a/%0D%0Ab"
    head, payload = Z.decode_record(Z.encode_record(8, None, b"ignored", "d", 7))
    assert payload == b"" and head["warc-type"] == "revisit" and Z._page(head["warc-refers-to"]) == 7 and "warc-target-uri" not in head


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)


def through(spark, rows, archive_bytes=Z.ARCHIVE_BYTES):
    import uuid

    from lacuna.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    import os
    os.makedirs(folder)
    manifest = Scratch(spark, "t").write(Z.write_archives(Z.with_references(frame(spark, rows)), folder, archive_bytes), "m")
    return manifest, Z.read_records(Z.read_index(manifest)).collect()


def test_archives_round_trip_with_revisits(spark):
    big = "<p>" + "long page " * 30_000
    rows = [(5, "u5", "same " * 40), (3, "u3", "same " * 40), (9, None, "same " * 40), (1, "u1", "short"), (2, "u2", "short"), (4, "u4", None),
            (6, "u6", ""), (7, "u7", big), (None, "u", "same " * 40), (3, "u3", "same " * 40), (8, "u8", "é" * 50), (10, "u10", "é" * 50)]
    manifest, out = through(spark, rows, archive_bytes=100)
    assert manifest.count() > 1 and sum(r["records"] for r in manifest.collect()) == len(rows) == len(out)
    got = {r["page_id"]: r for r in out}
    assert [got[i]["record_type"] for i in (3, 5, 9, None, 1, 2, 4, 6, 7, 8, 10)] == [
        "response", "revisit", "revisit", "revisit", "response", "response", "response", "response", "response", "response", "revisit"]
    assert got[5]["refers_to"] == got[9]["refers_to"] == got[None]["refers_to"] == 3 and got[10]["refers_to"] == 8
    texts = {r[0]: (r[2] or "") for r in rows}
    for r in out:
        raw = texts[r["page_id"]].encode()
        assert r["payload_digest"] == hashlib.sha256(raw).hexdigest()
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == raw and r["payload_bytes"] == len(raw)


def test_no_pages(spark):
    manifest, out = through(spark, [])
    assert manifest.count() == 0 and out == []
