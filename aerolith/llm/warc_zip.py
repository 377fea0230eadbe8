"""WARC records in ZIP packages: written as stored members with an index, read back by ranges.

A package holds ``archive/data.warc.gz`` (one gzip member a record) and ``indexes/index.cdxj``
(one line a record: offset and length inside the archive member), both stored without
compression, so a record is a byte range of the package.  The reader parses the end record, its
ZIP64 form and the central directory, finds stored archive members and indexes, and reads
records by ranges; nothing is extracted.  Packages are opened through ``pyarrow.fs`` from their
URI, so they can be on any store that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.llm.common import materialize

# Fixed values of the ZIP format: signatures, sizes and the values that point to ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR64_SIZE = 30, 46, 22, 56, 20
MAX16, MAX32, MAX_COMMENT, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 0xFFFF, 1
#: A package is closed at this many bytes, and a read asks for about this many.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
ARCHIVES, INDEXES = ("archive/",), ("indexes/",)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP --------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header begins


class ZipPackage:
    """Appends stored members to an output stream; ``zip64`` writes ZIP64 fields even where not needed."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.central = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, header, size = name.encode(), zlib.crc32(data), self.at, len(data)
        wide = self.zip64 or size >= MAX32 or header >= MAX32
        short = MAX32 if wide else size
        extra = struct.pack("<HHQQ", ZIP64_FIELD, 16, size, size) if wide else b""
        self._put(struct.pack("<4sHHHHHIIIHH", LOCAL, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra)
        self._put(data)
        extra = struct.pack("<HHQQQ", ZIP64_FIELD, 24, size, size, header) if wide else b""
        self.central.append(struct.pack("<4sHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, 0x800, 0, 0, 33, crc, short, short,
                                        len(raw), len(extra), 0, 0, 0, 0, MAX32 if wide else header) + raw + extra)

    def close(self) -> None:
        start, n = self.at, len(self.central)
        for entry in self.central:
            self._put(entry)
        size = self.at - start
        wide = self.zip64 or n >= MAX16 or start >= MAX32 or size >= MAX32
        if wide:
            end64 = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", END64, END64_SIZE - 12, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", LOCATOR64, 0, end64, 1))
        self._put(struct.pack("<4sHHHHIIH", END, 0, 0, MAX16 if wide else n, MAX16 if wide else n,
                              MAX32 if wide else size, MAX32 if wide else start, 0))


def _read_at(f, start: int, size: int) -> bytes:
    f.seek(start)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"the package ends before byte {start + size}")
    return data


def directory(f, length: int) -> Iterator[Member]:
    """Members listed in the central directory of an open package of ``length`` bytes."""
    tail_at = max(0, length - END_SIZE - MAX_COMMENT - LOCATOR64_SIZE)
    tail = _read_at(f, tail_at, length - tail_at)
    end = tail.rfind(END)
    while end >= 0:  # a comment may hold the signature too: its length must reach the file's end
        if end + END_SIZE <= len(tail) and end + END_SIZE + struct.unpack_from("<H", tail, end + 20)[0] == len(tail):
            break
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    n, size, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= LOCATOR64_SIZE and tail[end - LOCATOR64_SIZE:end - LOCATOR64_SIZE + 4] == LOCATOR64:
        at = struct.unpack_from("<Q", tail, end - LOCATOR64_SIZE + 8)[0]
        record = _read_at(f, at, END64_SIZE)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        n, size, start = struct.unpack_from("<QQQ", record, 32)
    held, base, pos = b"", start, 0
    for _ in range(n):
        while len(held) - pos < CENTRAL_SIZE or len(held) - pos < CENTRAL_SIZE + sum(struct.unpack_from("<HHH", held, pos + 28)):
            more = min(1 << 20, start + size - base)
            if more <= 0:
                raise ValueError("the central directory is shorter than its number of members")
            held, pos = held[pos:] + _read_at(f, base, more), 0
            base += more
        if held[pos:pos + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, plain = struct.unpack_from("<H", held, pos + 10)[0], *struct.unpack_from("<II", held, pos + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", held, pos + 28)
        header = struct.unpack_from("<I", held, pos + 42)[0]
        name = held[pos + CENTRAL_SIZE:pos + CENTRAL_SIZE + n_name].decode("utf-8", "replace")
        extra, at = held[pos + CENTRAL_SIZE + n_name:pos + CENTRAL_SIZE + n_name + n_extra], 0
        while at + 4 <= len(extra):
            kind, n_field = struct.unpack_from("<HH", extra, at)
            if kind == ZIP64_FIELD:
                wide = list(struct.unpack_from(f"<{n_field // 8}Q", extra, at + 4))
                if plain == MAX32:
                    plain = wide.pop(0)
                if packed == MAX32:
                    packed = wide.pop(0)
                if header == MAX32:
                    header = wide.pop(0)
            at += 4 + n_field
        yield Member(name, method, packed, header)
        pos += CENTRAL_SIZE + n_name + n_extra + n_comment


def data_start(f, member: Member) -> int:
    local = _read_at(f, member.header, LOCAL_SIZE)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header + LOCAL_SIZE + sum(struct.unpack_from("<HH", local, 26))


# --- WARC -------------------------------------------------------------------------------------------------------

def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", *(f"{k}: {_one_line(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _one_line(v: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in v)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Lower-cased headers and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def _page_record(page_id, url, html: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _record_id(page_id, digest)), ("Content-Type", "application/http; msgtype=response"),
               ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if is_revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", _record_id(refers_to, digest))]
        return warc_record("revisit", headers, http)
    return warc_record("response", headers, http + html)


def _write_packages(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        records, index, size = [], [], 0

        def close():
            name = f"{root}/{uuid.uuid4().hex}.wacz"  # a retried task writes other names; the listing has those of the task that ended well
            with store.open_output_stream(name) as out:
                package = ZipPackage(out)
                package.add("archive/data.warc.gz", b"".join(records))
                package.add("indexes/index.cdxj", "".join(index).encode())
                package.close()
                n = package.at
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rsplit('/', 1)[1]}"]), pa.array([n], pa.int64()),
                                               pa.array([len(records)], pa.int64())], ["path", "length", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to", "is_revisit"))):
                data = _gzip(_page_record(*row))
                index.append(f"{row[3]} 0 " + json.dumps({"offset": size, "length": len(data), "filename": "data.warc.gz"}) + "\n")
                records.append(data)
                size += len(data)
                if size >= package_bytes:
                    yield close()
                    records, index, size = [], [], 0
        if records:
            yield close()
    return run


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 1000, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages (page_id, url, html)`` below ``folder`` (a URI);
    returns the listing ``(path, length, records)``.

    The payload is the html in UTF-8, empty for null.  Of rows with equal payloads of at least
    ``least_bytes`` bytes, those with the largest page_id become responses and the others revisits
    that refer to it; a null page_id counts as smaller than any (all null: all responses).  Rows
    repeated with the same page_id are all written.  An empty table writes no package.  Other
    columns are not read.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                       F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("digest", F.sha1("html"))
    again = (own.where(F.octet_length("html") >= least_bytes).groupBy("digest")
             .agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to"))
    rows = own.join(again, "digest", "left")
    is_revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    listed = rows.select("page_id", "url", "html", "digest", "refers_to", is_revisit.alias("is_revisit")).mapInArrow(
        _write_packages(folder, package_bytes), "path string, length long, records long")
    return materialize(listed, "packages")


def list_packages(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, length)`` of the packages in a folder (their content is not read)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select("path", "length")


def _locate(range_bytes: int):
    """Ranges of whole records: ``(path, start, sizes)``; ``sizes`` is empty for a member without an index."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    yield from _ranges(f, path, length, range_bytes)
    return run


def _range_batch(path: str, start: int, end: int, sizes: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([start], pa.int64()), pa.array([end], pa.int64()),
                                       pa.array([sizes], pa.list_(pa.int64()))], ["path", "start", "end", "sizes"])


def _ranges(f, path: str, length: int, range_bytes: int) -> Iterator[pa.RecordBatch]:
    archives, indexes = {}, []
    for m in directory(f, length):
        is_archive = m.name.startswith(ARCHIVES) and m.name.endswith((".warc", ".warc.gz"))
        is_index = m.name.startswith(INDEXES) and m.name.endswith((".cdx", ".cdxj"))
        if (is_archive or is_index) and m.method:
            raise ValueError(f"{path}: {m.name} is compressed in the package; records can be read by ranges from stored members only")
        if is_archive:
            archives[m.name.rsplit("/", 1)[1]] = m
        elif is_index:
            indexes.append(m)
    seen = set()
    for index in indexes:
        start, sizes, end, name = 0, [], None, None
        for line in _lines(f, data_start(f, index), index.size):
            entry = json.loads(line[line.index(b"{"):])
            if entry["filename"] not in archives:
                raise ValueError(f"{path}: the index names {entry['filename']}, which the package does not hold")
            base = data_start(f, archives[entry["filename"]]) if entry["filename"] != name else base
            seen.add(entry["filename"])
            offset = base + int(entry["offset"])
            if sizes and (offset != end or end - start >= range_bytes):
                yield _range_batch(path, start, end, sizes)
                sizes = []
            if not sizes:
                start = offset
            sizes.append(int(entry["length"]))
            end, name = offset + sizes[-1], entry["filename"]
        if sizes:
            yield _range_batch(path, start, end, sizes)
    for name, m in archives.items():
        if name not in seen:
            base = data_start(f, m)
            yield _range_batch(path, base, base + m.size, [])


def _lines(f, start: int, size: int) -> Iterator[bytes]:
    held = b""
    for at in range(start, start + size, RANGE_BYTES):
        *lines, held = (held + _read_at(f, at, min(RANGE_BYTES, start + size - at))).split(b"\n")
        yield from lines
    if held:
        yield held


def _records_in(f, start: int, end: int, sizes: list[int]) -> Iterator[bytes]:
    if sizes:
        data, at = _read_at(f, start, end - start), 0
        for n in sizes:
            part = data[at:at + n]
            yield zlib.decompress(part, 31) if part[:2] == b"\x1f\x8b" else part
            at += n
        return
    # no index: gzip members one after another, read in steps
    held, pos = b"", start
    while held or pos < end:
        d = zlib.decompressobj(31)
        out = []
        while not d.eof:
            if not held:
                if pos >= end:
                    raise ValueError("the last record of a member without an index is cut")
                held = _read_at(f, pos, min(RANGE_BYTES, end - pos))
                pos += len(held)
            out.append(d.decompress(held))
            held = d.unused_data
        yield b"".join(out)


RECORDS = "page_id long, url string, record_id string, record_type string, refers_to_id string, declared_digest string, payload_bytes long, payload binary"


def _read_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start, end, sizes in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end", "sizes"))):
            store, at = fs.FileSystem.from_uri(path)
            with store.open_input_file(at) as f:
                rows, held = [], 0
                for data in _records_in(f, start, end, sizes):
                    rows.append(_row(data))
                    held += len(data)
                    if held >= RANGE_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _row(data: bytes) -> tuple:
    h, block = parse_record(data)
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    kind, digest = h["warc-type"], h.get("warc-payload-digest", "")
    page = h.get("warc-page-id")
    hexed = base64.b32decode(digest[5:]).hex() if digest.startswith("sha1:") else None
    if kind == "response" and hexed and hashlib.sha1(payload).hexdigest() != hexed:
        raise ValueError(f"{h.get('warc-record-id')}: the payload does not have the digest its header gives")
    return (int(page) if page is not None else None, h.get("warc-target-uri"), h.get("warc-record-id"), kind, h.get("warc-refers-to"),
            hexed, int(http.get("content-length", len(payload))), payload if kind == "response" else None)


def read_records(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the listed packages ``(path, length)``: headers, the full payload's size and
    SHA-1 as its headers give them, and the payload (null for a revisit, whose payload is that of
    ``refers_to_id``).  A response whose payload has another digest, a package that is no ZIP file
    and archive members that are not stored raise an error; an empty listing gives no rows.
    """
    listed = packages.select("path", "length").repartition(F.col("path"))
    ranges = listed.mapInArrow(_locate(range_bytes), "path string, start long, end long, sizes array<long>")
    spread = ranges.repartition(F.col("path"), F.col("start"))
    return spread.mapInArrow(_read_ranges, RECORDS)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM r
"""
