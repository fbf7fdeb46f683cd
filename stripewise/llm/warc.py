"""Web archives packed into ZIP files: written per task, read by range without extraction.

A package holds `archive/data.warc.gz` (one gzip member per WARC record), `indexes/index.cdxj`
(a line per record: key, time, and JSON with the record's place) and `datapackage.json`, all as
stored members, so that a record's bytes lie at a fixed place in the package. The reader takes
any archives and indexes that a package's directory lists, plain or gzipped indexes alike.
"""

from __future__ import annotations

import base64
import gzip
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
from pyspark.sql import types as T

from stripewise.llm.common import cut, delete_at_end, shared_dir, steady

PACKAGE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20  # read at once where records are neighbours
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of their own
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"

# Fixed values of the ZIP format: signatures and record layouts, all little-endian.
LOCAL, CENTRAL, END = 0x04034B50, 0x02014B50, 0x06054B50
END64, LOCATOR64, EXTRA64 = 0x06064B50, 0x07064B50, 0x0001
LOCAL_HEADER = struct.Struct("<IHHHHHIIIHH")
CENTRAL_HEADER = struct.Struct("<IHHHHHHIIIHHHHHII")
END_RECORD = struct.Struct("<IHHHHIIH")
END64_RECORD = struct.Struct("<IQHHIIQQQQ")
LOCATOR_RECORD = struct.Struct("<IIQI")
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
UTF8_NAME, STORED, DOS_DATE = 0x0800, 0, 0x5821


@dataclass(frozen=True)
class Member:
    """A member as the central directory lists it; header is the place of its local header."""

    name: str
    method: int
    packed: int
    size: int
    crc: int
    header: int


def _open(path: str):
    files, inner = fs.FileSystem.from_uri(path)
    return files.open_input_file(inner)


class StoredZip:
    """Writes stored members one after the other; places and sizes may need 64 bits."""

    def __init__(self, out) -> None:
        self.out, self.at, self.members = out, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, chunks: list[bytes]) -> None:
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        big, raw, header = size >= FULL32, name.encode(), self.at
        extra = struct.pack("<HHQQ", EXTRA64, 16, size, size) if big else b""
        short = FULL32 if big else size
        self._write(
            LOCAL_HEADER.pack(LOCAL, 45, UTF8_NAME, STORED, 0, DOS_DATE, crc, short, short, len(raw), len(extra)) + raw + extra
        )
        for c in chunks:
            self._write(c)
        self.members.append(Member(name, STORED, size, size, crc, header))

    def close(self, zip64: bool = False) -> None:
        """zip64: write the 64-bit directory even where the numbers are small."""
        start = self.at
        for m in self.members:
            raw = m.name.encode()
            wide = [v for v in (m.size, m.packed, m.header) if zip64 or v >= FULL32]
            extra = struct.pack(f"<HH{len(wide)}Q", EXTRA64, 8 * len(wide), *wide) if wide else b""
            size, packed, header = (FULL32 if zip64 or v >= FULL32 else v for v in (m.size, m.packed, m.header))
            self._write(
                CENTRAL_HEADER.pack(
                    CENTRAL, 45, 45, UTF8_NAME, m.method, 0, DOS_DATE, m.crc, packed, size, len(raw), len(extra), 0, 0, 0, 0, header
                )
                + raw
                + extra
            )
        n, length = len(self.members), self.at - start
        if zip64 or n >= FULL16 or length >= FULL32 or start >= FULL32:
            at = self.at
            self._write(END64_RECORD.pack(END64, END64_RECORD.size - 12, 45, 45, 0, 0, n, n, length, start))
            self._write(LOCATOR_RECORD.pack(LOCATOR64, 0, at, 1))
            n, length, start = FULL16, FULL32, FULL32
        self._write(END_RECORD.pack(END, 0, 0, n, n, length, start, 0))


def _at(source, offset: int, length: int) -> bytes:
    source.seek(offset)
    data = source.read(length)
    if len(data) != length:
        raise ValueError(f"the archive ends within bytes {offset} to {offset + length}")
    return data


def directory(source) -> dict[str, Member]:
    """The members of a ZIP, read from its end: end record, 64-bit records where the short ones
    are full, then the central directory. Nothing else is read."""
    size = source.size()
    tail_at = max(0, size - END_RECORD.size - FULL16)
    tail = _at(source, tail_at, size - tail_at)
    end = len(tail)
    while True:  # a comment may look like a record; its length must fit
        end = tail.rfind(struct.pack("<I", END), 0, end)
        if end < 0:
            raise ValueError("not a ZIP archive")
        if end + END_RECORD.size <= len(tail):
            rec = END_RECORD.unpack_from(tail, end)
            if end + END_RECORD.size + rec[7] == len(tail):
                break
    n, length, start = rec[4], rec[5], rec[6]
    if n == FULL16 or length == FULL32 or start == FULL32:
        sign, _, at, _ = LOCATOR_RECORD.unpack(_at(source, tail_at + end - LOCATOR_RECORD.size, LOCATOR_RECORD.size))
        if sign != LOCATOR64:
            raise ValueError("no locator of the 64-bit directory")
        rec = END64_RECORD.unpack(_at(source, at, END64_RECORD.size))
        if rec[0] != END64:
            raise ValueError("no 64-bit end record")
        n, length, start = rec[7], rec[8], rec[9]
    raw, at, out = _at(source, start, length), 0, {}
    for _ in range(n):
        h = CENTRAL_HEADER.unpack_from(raw, at)
        if h[0] != CENTRAL:
            raise ValueError("a broken central directory")
        at += CENTRAL_HEADER.size
        name = raw[at : at + h[10]].decode()
        extra, i = raw[at + h[10] : at + h[10] + h[11]], 0
        at += h[10] + h[11] + h[12]
        packed, size_, header = h[8], h[9], h[16]
        while i + 4 <= len(extra):
            kind, k = struct.unpack_from("<HH", extra, i)
            if kind == EXTRA64:
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, i + 4))
                size_ = next(wide) if size_ == FULL32 else size_
                packed = next(wide) if packed == FULL32 else packed
                header = next(wide) if header == FULL32 else header
            i += 4 + k
        out[name] = Member(name, h[4], packed, size_, h[7], header)
    return out


def place(source, member: Member) -> int:
    """Where a stored member's bytes begin: its local header has lengths of its own."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is packed; only stored members can be read by range")
    h = LOCAL_HEADER.unpack(_at(source, member.header, LOCAL_HEADER.size))
    if h[0] != LOCAL:
        raise ValueError("a broken local header")
    return member.header + LOCAL_HEADER.size + h[9] + h[10]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id, row: int) -> str:
    """Of the row's place in the table, so that no two rows share one."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{row}')}>"


def _record(page_id, row: int, url: str, payload: bytes, first: dict | None) -> bytes:
    """A WARC record as a gzip member. A revisit (first: page_id and row of the response) carries
    the HTTP head and the digest and length of the payload, but not the payload."""
    revisit = first is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, row)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {_record_id(first['page_id'], first['row'])}")
        if first["page_id"] is not None:
            lines.append(f"X-Refers-To-Page-ID: {first['page_id']}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(raw, compresslevel=5, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of one WARC record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def _one_line(url: str) -> str:
    return "".join(c if c > " " else "%%%02X" % ord(c) for c in url)


def _package(path: str, records: list[tuple[str, dict, bytes]], zip64: bool) -> None:
    """Written under another name, then moved: a reader never meets half a package."""
    files, inner = fs.FileSystem.from_uri(path)
    files.create_dir(inner.rpartition("/")[0], recursive=True)
    lines, at = [], 0
    for url, fields, data in records:
        lines.append(f"{url} 20240101000000 {json.dumps(fields | {'offset': at, 'length': len(data)})}\n".encode())
        at += len(data)
    with files.open_output_stream(f"{inner}.part") as out:
        z = StoredZip(out)
        z.add(DATA, [r[2] for r in records])
        z.add(INDEX, [b"".join(lines)])
        z.add(PACKAGE, [json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode()])
        z.close(zip64)
    files.move(f"{inner}.part", inner)


def typed_pages(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """pages with what their record is to be: page_id, row (place in the scan), url, payload, and
    first: of a revisit, page_id and row of the response.

    Groups of equal payloads are found on narrow rows (page_id, row, digest), reduced where they
    are read. The groups are kept before rows meet them, so that Spark can split a digest with
    many copies; payloads then meet their record's kind by row, which no two of them share, so
    copies of one text lie with as many writers as any other pages.
    """
    pages = steady(pages)
    raw = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    row = F.monotonically_increasing_id().alias("row")
    digests = cut(
        pages.select(F.col(id_col).alias("page_id"), row, F.unhex(F.sha1(raw)).alias("digest"), F.octet_length(raw).alias("n"))
        .where(F.col("n") >= min_bytes)
        .drop("n")
    )
    groups = cut(
        digests.groupBy("digest")
        .agg(F.max(F.struct("page_id", "row")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    revisits = digests.join(groups, "digest").where("row <> first.row").select("row", "first")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), raw.alias("payload"), row)
    return rows.join(revisits, "row", "left").select("page_id", "row", "url", "payload", "first")


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    package_bytes: int = PACKAGE_BYTES,
    zip64: bool = False,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Writes a record per row of pages into packages in folder; returns path, records, bytes.

    Of records with equal payloads of at least min_bytes the one with the largest page_id (of
    repeated rows the last) is a response and the others revisit it. The list of packages is
    kept, so the files are written once; a task that is run again writes under new names, and
    what a lost try left behind is in no list. A package holds about package_bytes of payload.

    Null html counts as empty, a null url as none; a null page_id is below all others; an empty
    table gives no packages; other columns are not carried, so their names cannot clash.
    """
    schema = "path string, records long, bytes long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, held = [], 0

        def flush() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            _package(path, records, zip64)
            n, size = len(records), sum(len(r[2]) for r in records)
            records.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"]
            )

        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                page_id, row, url, payload, first = (c.as_py() for c in cells)
                url = _one_line(url or f"urn:page:{page_id}")
                kind = "text/html" if first is None else "warc/revisit"
                data = _record(page_id, row, url, payload, first)
                fields = {"url": url, "mime": kind, "status": "200", "digest": f"sha1:{digest32(payload)}", "filename": DATA.rpartition("/")[2]}
                records.append((url, fields, data))
                held += len(payload)
                if held >= package_bytes:
                    yield flush()
                    held = 0
        if records:
            yield flush()

    return cut(typed_pages(pages, min_bytes, id_col, url_col, html_col).mapInArrow(write, schema))


RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _wanted(source, members: dict[str, Member], url_prefix: str | None) -> list[tuple[str, int, int, str]]:
    """(archive member, offset, length, url) of the records that the package's indexes list, in the
    order of their places."""
    out = []
    for name, member in members.items():
        if not name.startswith("indexes/") or not name.endswith((".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")):
            continue
        raw = _at(source, place(source, member), member.size)
        for line in (gzip.decompress(raw) if name.endswith(".gz") else raw).decode().splitlines():
            url, _, entry = line.split(" ", 2)
            if not entry.startswith("{"):  # the head of an index
                continue
            fields = json.loads(entry)
            url = fields.get("url", url)
            if url_prefix is None or url.startswith(url_prefix):
                out.append((f"archive/{fields['filename']}", int(fields["offset"]), int(fields["length"]), url))
    return sorted(set(out))


def _records(source, members: dict[str, Member], wanted: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, str, bytes]]:
    """(offset, url, bytes) of the wanted records; neighbours are read together, up to RANGE_BYTES."""
    base = {name: place(source, members[name]) for name in {w[0] for w in wanted}}
    i = 0
    while i < len(wanted):
        name, first, length, _ = wanted[i]
        end, j = first + length, i + 1
        while j < len(wanted) and wanted[j][0] == name and wanted[j][1] == end and end + wanted[j][2] - first <= RANGE_BYTES:
            end, j = end + wanted[j][2], j + 1
        data = _at(source, base[name] + first, end - first)
        for _, offset, n, url in wanted[i:j]:
            yield offset, url, data[offset - first : offset - first + n]
        i = j


def read_archives(packages: DataFrame, payloads: bool = True, url_prefix: str | None = None, id_type: str = "long") -> DataFrame:
    """One row per record of the packages (a column `path`); see RECORD for the columns.

    From each package only the directory, the index members and the wanted records are read,
    each by its range. payload_digest and payload_bytes are of the full payload; a response's
    are computed from the bytes read, and differing from the record's fields is an error.
    payload is null for revisits, and for all where payloads is false. id_type is that of
    page_id and refers_to, `long` or `string`. An empty list gives no rows; other columns of
    packages are not carried.
    """
    names = RECORD.names
    id_of = {"long": int, "string": str}[id_type]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with _open(path) as source:
                    members = directory(source)
                    rows: list[tuple] = []
                    held = 0
                    for offset, url, data in _records(source, members, _wanted(source, members, url_prefix)):
                        fields, block = parse_record(data)
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        payload, size = None, fields.get("x-payload-length")
                        if fields["warc-type"] == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if len(payload) != int(size or len(payload)) or digest32(payload) != digest:
                                raise ValueError(f"a record of {path} differs from its digest")
                            size = len(payload)
                        page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append(
                            (
                                path,
                                offset,
                                fields["warc-type"],
                                page and id_of(page),
                                url,
                                size and int(size),
                                digest,
                                to and id_of(to),
                                payload if payloads else None,
                            )
                        )
                        held += len(block)
                        if held > RANGE_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    key = pa.int64() if id_type == "long" else pa.string()
    types = [pa.string(), pa.int64(), pa.string(), key, pa.string(), pa.int64(), pa.string(), key, pa.binary()]
    plain = T.StringType() if id_type == "string" else T.LongType()
    schema = T.StructType([T.StructField(f.name, plain if f.name in ("page_id", "refers_to") else f.dataType) for f in RECORD])

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    spread = packages.select("path").repartition(max(1, packages.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(read, schema)


def archive_folder(spark: SparkSession) -> str:
    """A fresh place for packages in the cluster's shared folder, cleared when the driver's JVM
    ends. Packages are written and read through pyarrow.fs, so the folder must be in a file
    system that it knows (a mount, HDFS, S3, GCS)."""
    base = shared_dir(spark)
    path = f"{base if '://' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path
