"""WARC records in ZIP packages: written by tasks, found through the packages' directories and indexes, read by byte ranges.

1. Pages with equal payloads of at least `least` bytes: the one with the smallest id is a response, the others revisit it. This is settled on
   (row number, id, SHA-1) alone; pages meet the answer by row number, so a payload that a third of all pages share is no crowded key.
2. Each task packs its pages into ZIP packages of bounded size: members `archive/<n>.warc.gz`, stored, one gzip member a record, and `indexes/index.cdxj`
   with a JSON line a record. File names are new for each attempt and the returned table lists the packages of tasks that succeeded, so a task that runs
   again leaves no record twice.
3. Reading parses the end record, its ZIP64 form where there is one, and the central directory, then indexes; members without an index line are walked
   once. Nothing is unpacked to disk: records are read by ranges of some megabytes, dealt out by (package, range), so one large package is many tasks.

Packages lie in any folder that `pyarrow.fs` reaches; all executors must see it. Members of a package that are compressed or encrypted can't be read by range and
are listed by `members` only. A record that can't be read gives a row with `error`, as does a payload that contradicts its digest.

A null payload is empty. A null id counts as the largest; a null url gives none. Rows that repeat id and payload: one is the response, the others revisit it. Control
characters and spaces of a url are percent-encoded. Very long payloads are a member of their own. Other columns, whatever their names, are not read. Pages must be read
from storage, so that their row numbers are the same in each pass. No pages, no packages, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Bytes after which a member, and a package, is closed; bytes read together.
MEMBER_BYTES = 8 << 20
PACKAGE_BYTES = 256 << 20
RANGE_BYTES = 4 << 20
READ_BYTES = 1 << 20

INDEX = "indexes/index.cdxj"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = ("path string, record_id string, record_type string, url string, refers_to string, payload binary, payload_bytes long, "
           "payload_digest string, error string")


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


# -- writing

def _record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> tuple[bytes, dict]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    plain = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m.group()), url)
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", plain),
              ("WARC-Profile", REVISIT if refers_to else None), ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", str(len(payload))),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    pack = zlib.compressobj(6, wbits=31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush(), {"url": plain, "digest": f"sha1:{digest}", "mime": "text/html"}


class _Package:
    """A ZIP package under construction: at most a member and the index are held in memory."""

    def __init__(self, folder: str, zip64: bool, member_bytes: int):
        system, base = _place(folder)
        name = f"part-{uuid.uuid4().hex}.wacz"
        system.create_dir(base)
        self.path, self.zip64, self.member_bytes = f"{folder}/{name}", zip64, member_bytes
        self.sink = system.open_output_stream(f"{base}/{name}")
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member, self.lines = bytearray(), []
        self.members = self.records = self.bytes = 0

    def _put(self, name: str, data: bytes) -> None:
        with self.zip.open(zipfile.ZipInfo(name), "w", force_zip64=self.zip64) as out:
            out.write(data)

    def add(self, data: bytes, entry: dict) -> None:
        if self.member and len(self.member) + len(data) > self.member_bytes:
            self.close_member()
        entry |= {"filename": f"{self.members}.warc.gz", "offset": str(len(self.member)), "length": str(len(data))}
        self.lines.append(json.dumps(entry))
        self.member += data
        self.records += 1
        self.bytes += len(data)

    def close_member(self) -> None:
        self._put(f"archive/{self.members}.warc.gz", self.member)
        self.member = bytearray()
        self.members += 1

    def close(self) -> tuple[str, int, int]:
        if self.member:
            self.close_member()
        self._put(INDEX, "".join(f"- 0 {line}\n" for line in self.lines).encode())
        self.zip.close()
        self.sink.close()
        return self.path, self.records, self.bytes


def write_archives(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   date: str = "2000-01-01T00:00:00Z", zip64: bool = False, member_bytes: int = MEMBER_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """(path, n_records, n_bytes) of the packages written below `folder`, a record for each page."""
    keyed = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"),
                         F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    small = keyed.where(F.octet_length("payload") >= least).select("row", "id", "order", F.sha1("payload").alias("sha"))
    leads = (small.groupBy("sha").agg(F.min(F.struct(F.col("order").isNull(), "order", "row", "id")).alias("lead"), F.count("*").alias("n"))
             .where("n > 1").select("sha", "lead"))
    revisits = small.join(leads, "sha").where("row <> lead.row").select("row", F.col("lead.id").alias("lead_id"), F.col("lead.row").alias("lead_row"))
    dealt = keyed.select("row", "id", "url", "payload").join(revisits, "row", "left")

    def write(batches):
        package, done = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                number, key, url, payload, lead, lead_row = (column[row].as_py() for column in batch.columns)
                if package is None:
                    package = _Package(folder, zip64, member_bytes)
                package.add(*_record(_record_id(key, number), url, payload.encode(), None if lead_row is None else _record_id(lead, lead_row), date))
                if package.bytes >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        for path, records, size in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [records], "n_bytes": [size]})

    return cut_lineage(dealt.select("row", "id", "url", "payload", "lead_id", "lead_row").mapInArrow(write, "path string, n_records long, n_bytes long"))


def _record_id(key: str | None, row: int) -> str:
    return f"urn:page:{'' if key is None else '=' + quote(key, safe='')}:{row}"


# -- directories

class Member(NamedTuple):
    name: str
    method: int
    encrypted: bool
    size: int
    packed: int
    start: int  # of its data


def _directory(f, size: int) -> tuple[int, int, int]:
    """Start and size of the central directory, and the bytes before the package itself."""
    length = min(size, 22 + 0xFFFF)
    tail = f.read_at(length, size - length)
    at = len(tail) - 22
    while (at := tail.rfind(b"PK\5\6", 0, at + 4)) >= 0:
        if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, entries, cd_size, cd_start, _ = struct.unpack_from("<4H2LH", tail, at + 4)
    end = size - length + at
    if 0xFFFF == entries or 0xFFFFFFFF in (cd_size, cd_start):
        locator = f.read_at(20, end - 20) if end >= 20 else b""
        if locator[:4] == b"PK\6\7":
            # the record stands right before its locator; its stated place is off by the bytes before the package
            stated = struct.unpack_from("<Q", locator, 8)[0]
            for place in (stated, end - 20 - 56):
                record = f.read_at(56, place) if 0 <= place <= size - 56 else b""
                if record[:4] == b"PK\6\6":
                    cd_size, cd_start = struct.unpack_from("<2Q", record, 40)
                    end = place
                    break
            else:
                raise ValueError("no ZIP64 end of the central directory")
    if cd_size > end:
        raise ValueError("the central directory is larger than the file")
    return end - cd_size, cd_size, end - cd_size - cd_start


def read_members(f, size: int) -> Iterator[Member]:
    """Members by the central directory, which is read in stretches."""
    at, left, before = _directory(f, size)
    stop, buffer = at + left, b""
    while at < stop or buffer:
        need = 46 if len(buffer) < 46 else 46 + sum(struct.unpack_from("<3H", buffer, 28))
        if len(buffer) < need:
            more = f.read_at(min(max(READ_BYTES, need), stop - at), at) if at < stop else b""
            if not more:
                raise ValueError("the central directory is cut off")
            at, buffer = at + len(more), buffer + more
            continue
        if buffer[:4] != b"PK\1\2":
            raise ValueError("no entry of the central directory")
        flags, method = struct.unpack_from("<2H", buffer, 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<2L3H", buffer, 20)
        header = struct.unpack_from("<L", buffer, 42)[0]
        name, extra = buffer[46:46 + n_name], buffer[46 + n_name:46 + n_name + n_extra]
        buffer = buffer[46 + n_name + n_extra + n_comment:]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                full, packed, header = (next(wide, x) if x == 0xFFFFFFFF else x for x in (full, packed, header))
            extra = extra[4 + length:]
        local = f.read_at(30, before + header)
        if local[:4] != b"PK\3\4":
            raise ValueError("no local header")
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, bool(flags & 1), full, packed, before + header + 30 + sum(struct.unpack_from("<2H", local, 26)))


# -- indexes

def _lines(f, member: Member) -> Iterator[bytes]:
    rest = b""
    for at in range(member.start, member.start + member.packed, READ_BYTES):
        *whole, rest = (rest + f.read_at(min(READ_BYTES, member.start + member.packed - at), at)).split(b"\n")
        yield from whole
    if rest:
        yield rest


def _walk(f, member: Member) -> Iterator[tuple[int, int]]:
    """Place and length of each record of a member without an index."""
    at, stop = member.start, member.start + member.packed
    while at < stop:
        begin = at
        if f.read_at(2, at) == b"\x1f\x8b":
            unpack = zlib.decompressobj(wbits=31)
            while not unpack.eof and at < stop:
                data = f.read_at(min(READ_BYTES, stop - at), at)
                at += len(data)
                while data and not unpack.eof:  # what comes out is dropped piece by piece
                    unpack.decompress(data, READ_BYTES)
                    data = unpack.unconsumed_tail
            at -= len(unpack.unused_data)
        else:
            head = b""
            while b"\r\n\r\n" not in head and at < stop:
                head += f.read_at(min(4096, stop - at), at)
                at = begin + len(head)
            length = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            if b"\r\n\r\n" not in head or not length:
                yield begin, stop - begin
                return
            at = min(stop, begin + head.index(b"\r\n\r\n") + 4 + int(length[1]) + 4)
        yield begin, at - begin


def members(archives: DataFrame) -> DataFrame:
    """(path, name, method, encrypted, size, packed, start, error) of every member of the packages."""
    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, error = [], None
                try:
                    system, place = _place(path)
                    with system.open_input_file(place) as f:
                        for m in read_members(f, f.size()):
                            rows.append((path, *m, None))
                            if len(rows) >= 10_000:
                                yield _rows(rows, 8)
                                rows = []
                except (OSError, ValueError, struct.error) as e:
                    error = str(e)
                    rows.append((path, None, None, None, None, None, None, error))
                if rows:
                    yield _rows(rows, 8)

    names = "path string, name string, method int, encrypted boolean, size long, packed long, start long, error string"

    def _rows(rows, n):
        kinds = (pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(n)], names=[x.split()[0] for x in names.split(", ")])

    return archives.select("path").mapInArrow(read, names)


def located(archives: DataFrame) -> DataFrame:
    """(path, at, length, error): the byte range of every record of the packages' stored members. A package that can't be read is one row with an error."""
    def entries(path: str) -> Iterator[tuple[int, int]]:
        system, place = _place(path)
        with system.open_input_file(place) as f:
            records, indexes = {}, []
            for m in read_members(f, f.size()):
                if m.method or m.encrypted:
                    continue
                if m.name.endswith((".cdxj", ".cdx")):
                    indexes.append(m)
                elif m.name.endswith((".warc", ".warc.gz")):
                    records[m.name.rpartition("/")[2]] = m
            seen = set()
            for index in indexes:
                for line in _lines(f, index):
                    start = line.find(b"{")
                    if start < 0:
                        continue
                    entry = json.loads(line[start:])
                    if (m := records.get(entry["filename"].rpartition("/")[2])) is not None:
                        seen.add(m.name)
                        yield m.start + int(entry["offset"]), int(entry["length"])
            for m in records.values():
                if m.name not in seen:
                    yield from _walk(f, m)

    def find(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, error = [], None
                try:
                    for place in entries(path):
                        found.append(place)
                        if len(found) >= 50_000:
                            yield _ranges(path, found, None)
                            found = []
                except (OSError, ValueError, KeyError, struct.error, zlib.error) as e:
                    error = str(e)
                if found:
                    yield _ranges(path, found, None)
                if error is not None:
                    yield _ranges(path, [(None, None)], error)

    return archives.select("path").mapInArrow(find, "path string, at long, length long, error string")


def _ranges(path: str, found: list, error: str | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()),
                                       pa.array([error] * len(found), pa.string())], names=["path", "at", "length", "error"])


# -- records

def _parse(path: str, data: bytes) -> tuple:
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, wbits=31)
    head, gap, block = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        raise ValueError("no record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    length = int(fields.get("content-length", len(block)))
    if len(block) < length:
        raise ValueError("the record is cut off")
    block = block[:length]
    kind = fields.get("warc-type")
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    size, payload, error = int(fields.get("warc-payload-length", len(block))), block, None
    if kind == "revisit":
        payload = None
    else:
        own = base64.b32encode(hashlib.sha1(block).digest()).decode()
        if digest and own != digest or size != len(block):
            error = "the payload contradicts its digest"
        digest, size = own, len(block)
    return path, *(fields.get(x, "").strip("<>") or None for x in ("warc-record-id",)), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to", "").strip("<>") or None, payload, size, digest or None, error


def records(ranges: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of `located` ranges, columns RECORDS. Neighbouring records are read together."""
    def read(batches):
        f, now, start, buffer = None, None, 0, b""
        rows, size = [], 0
        for batch in batches:
            places = list(zip(*(column.to_pylist() for column in batch.columns)))
            for k, (path, at, length, error) in enumerate(places):
                try:
                    if error is not None:
                        raise ValueError(error)
                    if path != now:
                        if f:
                            f.close()
                        system, place = _place(path)
                        f, now, buffer = system.open_input_file(place), path, b""
                    if not start <= at <= at + length <= start + len(buffer):
                        end = at + length
                        for other, o_at, o_length, _ in places[k + 1:]:
                            if other != path or o_at != end or end + o_length - at > range_bytes:
                                break
                            end += o_length
                        start, buffer = at, f.read_at(end - at, at)
                    rows.append(_parse(path, buffer[at - start:at - start + length]))
                except (OSError, ValueError, zlib.error) as e:
                    rows.append((path, None, None, None, None, None, None, None, str(e)))
                size += len(rows[-1][5] or b"") + 200
                if size > RANGE_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if f:
            f.close()
        if rows:
            yield _batch(rows)

    spread = ranges.select("path", "at", "length", "error").repartition("path", F.floor(F.col("at") / range_bytes)).sortWithinPartitions("path", "at")
    return spread.mapInArrow(read, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(),) * 5 + (pa.binary(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


def page_key(record_id: str, kind: str):
    """The id that a record id of `write_archives` carries, as a column of type `kind`."""
    text = F.regexp_extract(record_id, "^urn:page:=([^:]*):", 1)
    return F.when(F.col(record_id).startswith("urn:page:="), F.url_decode(text)).try_cast(kind)
