"""ZIP packages of WARC records: directories against the standard library, round trips, damaged files, odd rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import random
import zipfile

import pytest
from pyarrow import BufferReader, py_buffer

from contractlake.llm import warc
from tests.conftest import rows


class Bytes:
    """Random access on bytes, as an Arrow file gives it."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


def package(names, zip64=False, comment=b"", before=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in names:
            info = zipfile.ZipInfo(name)
            info.compress_type = method
            with z.open(info, "w", force_zip64=zip64) as f:
                f.write(data)
        z.comment = comment
    return before + out.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"x" * 300, b"PK\5\6" + bytes(18)])
@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n"])
def test_directory_as_the_standard_library_reads_it(zip64, comment, before):
    names = [(f"archive/{k}.warc.gz", bytes([k]) * k * 10, zipfile.ZIP_DEFLATED if k == 3 else zipfile.ZIP_STORED) for k in range(6)] + [("indexes/ü.cdx", b"{}", 0)]
    data = package(names, zip64, comment, before)
    found = list(warc.read_members(Bytes(data), len(data)))
    infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    assert [(m.name, m.method, m.size, m.packed) for m in found] == [(i.filename, i.compress_type, i.file_size, i.compress_size) for i in infos]
    assert all(data[m.start:m.start + m.packed] == body for m, (_, body, method) in zip(found, names) if not method)
    assert BufferReader(py_buffer(data)).size() == len(data)


def test_zip64_end_record():
    data = package([(f"{k}", b"", 0) for k in range(0x10001)])
    assert b"PK\6\6" in data and sum(1 for _ in warc.read_members(Bytes(data), len(data))) == 0x10001
    with pytest.raises(ValueError):
        list(warc.read_members(Bytes(data[:-30]), len(data) - 30))


def plain(pages, least):
    """Expected rows: within equal payloads the smallest id (null last) is the response."""
    first = {}
    for key, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        first.setdefault((html or "").encode(), key)
    seen, out = set(), []
    for key, _, html in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        data = (html or "").encode()
        again = data in seen and len(data) >= least
        seen.add(data)
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "zip64", "size"), [(0, False, 8 << 20), (0, True, 300), (5, False, 40)])
def test_round_trip(spark, tmp_path, least, zip64, size):
    rng = random.Random(size)
    pages = [(k, f"http://x/{k}", rng.choice(["", None, "same", "a copied page é€", f"own {k}"])) for k in range(80)]
    pages += [(None, None, None), (None, "u", "null id"), (5, "twice", "same"), (5, "twice", "same"), (200, "a b\r\nWARC-Type: x", "x" * 300_000), (201, "z", "WARC/1.1\r\n\r\n" * 3)]
    rng.shuffle(pages)
    spark.createDataFrame([(*p, 1, "r") for p in pages], "page_id long, url string, html string, row int, payload string").repartition(5).write.parquet(f"{tmp_path}/in")
    archives = warc.write_archives(spark.read.parquet(f"{tmp_path}/in"), f"file://{tmp_path}/out", least, zip64=zip64, member_bytes=size, package_bytes=4 * size)
    read = warc.records(warc.located(archives), 2 * size)
    got = read.select(warc.page_key("record_id", "long").alias("id"), "payload_bytes", "payload_digest", "record_type", warc.page_key("refers_to", "long").alias("to"), "error").collect()
    assert all(r["error"] is None for r in got)
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(pages, least)
    assert archives.selectExpr("sum(n_records)").first()[0] == len(pages)
    texts = {r["page"]: bytes(r["payload"]).decode() for r in read.where("record_type = 'response'").select(warc.page_key("record_id", "long").alias("page"), "payload").collect()}
    assert texts[200] == "x" * 300_000 and texts[201] == "WARC/1.1\r\n\r\n" * 3
    assert read.where("url like 'a%'").first()["url"] == "a%20b%0D%0AWARC-Type:%20x"
    # every package is a sound ZIP file, and its members can be read without the index as well
    for r in archives.collect():
        z = zipfile.ZipFile(r["path"].removeprefix("file://"))
        assert z.testzip() is None and sum(gzip.decompress(z.read(n)).count(b"WARC-Record-ID") for n in z.namelist() if n.startswith("archive/")) == r["n_records"]


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.records(warc.located(warc.write_archives(empty, str(tmp_path / "none")))).collect() == []


def test_foreign_and_damaged_packages(spark, tmp_path):
    record = warc._record("urn:x", "http://x", b"body", None, "2000-01-01T00:00:00Z")[0]
    bare = gzip.decompress(record)
    wrong = gzip.compress(bare.replace(b"body", b"BODY"))
    files = {"unindexed": package([("archive/a.warc.gz", record + wrong, 0), ("archive/b.warc", bare * 2, 0), ("archive/c.warc.gz", record, zipfile.ZIP_DEFLATED)]),
             "torn": package([("archive/a.warc.gz", record, 0)])[:-10], "empty": b"", "junk": b"not a package" * 50,
             "bad_index": package([("archive/a.warc", b"nothing here", 0), ("indexes/i.cdxj", b"x\n- 0 {\"filename\": \"z.warc\", \"offset\": \"0\", \"length\": \"5\"}\n", 0)])}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in [*files, "missing"]], "path string")
    got = {}
    for r in warc.records(warc.located(paths)).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append((r["record_type"], r["payload_bytes"], r["error"]))
    assert sorted(got["unindexed"], key=repr) == [("response", 4, "the payload contradicts its digest"), *[("response", 4, None)] * 3]
    assert all(len(got[n]) == 1 and got[n][0][2] for n in ("torn", "empty", "junk", "missing", "bad_index"))
    listed = rows(warc.members(paths).where("error is null"), "name", "method")
    assert ("archive/c.warc.gz", 8) in listed and ("archive/b.warc", 0) in listed
