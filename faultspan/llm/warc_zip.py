"""WARC records in ZIP packages: write, find the members by the central directory, range-read records.

A package is a ZIP file that stores (does not compress) its members: `archive/data.warc.gz`, one gzip member for each
record, and `indexes/index.jsonl`, a line with page id, record type, offset and length for each. The reader takes the
end record, the ZIP64 end record if there is one, and the central directory, looks up where the data of a stored member
begins, reads the index and then only the ranges of records asked for; nothing is unpacked to disk. Packages of others are
read too: members are found by the directory, index lines may be CDXJ, an archive that no index names is read from end to
end, header names in any case, records without a digest, of other kinds, and HTTP messages are understood.

Packages lie in the folder that driver and executors share, by any URI that pyarrow.fs opens. Tasks write under a name
of their own and tell the path, so a repeated task leaves a stray file at most and is never read twice.

Of records with equal payloads of at least `least` bytes the one with the largest page id is the response and the others
revisit it; below that every record is a response. A null payload is empty; rows that repeat a page id and its
payload are alike, each with a record; a null page id counts as smaller than any other.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: A package is closed beyond so many bytes.
PACKAGE_BYTES = 256 << 20
#: Records that one read takes together, and the bytes of one read.
READ_BYTES = 4 << 20

# Fixed values of the ZIP format: signatures and record layouts.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_LAYOUT, CENTRAL_LAYOUT, END_LAYOUT, END64_LAYOUT, LOCATOR_LAYOUT = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ZipWriter:
    """Stored members to a stream that only goes forward; ZIP64 fields where sizes need them or `wide` asks for them."""

    def __init__(self, out: io.RawIOBase, wide: bool = False) -> None:
        self.out, self.wide, self.at, self.members = out, wide, 0, []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow behind the data, in 64 bits, as they aren't known yet."""
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        self.put(struct.pack(LOCAL_LAYOUT, LOCAL, 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(self.name), 20) + self.name + struct.pack("<2H2Q", 1, 16, 0, 0))

    def add(self, data: bytes) -> int:
        at, self.crc, self.size = self.size, zlib.crc32(data, self.crc), self.size + len(data)
        self.put(data)
        return at

    def end(self) -> None:
        self.put(struct.pack("<4sI2Q", b"PK\x07\x08", self.crc, self.size, self.size))
        self.members.append((self.name, self.start, self.crc, self.size))

    def close(self) -> None:
        first = self.at
        for name, start, crc, size in self.members:
            long = self.wide or max(start, size) >= FULL32
            extra = struct.pack("<2H3Q", 1, 24, size, size, start) if long else b""
            short = (FULL32, FULL32, FULL32) if long else (size, size, start)
            self.put(struct.pack(CENTRAL_LAYOUT, CENTRAL, 45, 45, 0x0808, 0, 0, 0x21, crc, *short[:2], len(name), len(extra), 0, 0, 0, 0, short[2]) + name + extra)
        length, at, n = self.at - first, self.at, len(self.members)
        long = self.wide or max(first, length) >= FULL32 or n >= FULL16
        if long:
            self.put(struct.pack(END64_LAYOUT, END64, 44, 45, 45, 0, 0, n, n, length, first) + struct.pack(LOCATOR_LAYOUT, LOCATOR, 0, at, 1))
        self.put(struct.pack(END_LAYOUT, END, 0, 0, *((FULL16, FULL16, FULL32, FULL32) if long else (n, n, length, first)), 0))
        self.out.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class ZipReader:
    """Members of a ZIP file by its central directory, read by ranges of a random access file."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, size = file, file.size()
        tail = self.read(at := max(0, size - 22 - FULL16), size - at)
        end = tail.rfind(END)
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] > len(tail)):
            end = tail.rfind(END, 0, end)
        if end < 0:
            raise ValueError("no end record: not a ZIP file")
        *_, n, length, first, _ = struct.unpack_from(END_LAYOUT, tail, end)
        # full values may be meant as they are: only a locator in front of the end record tells of a ZIP64 one
        locator = self.read(at + end - 20, 20) if at + end >= 20 else b""
        if (n == FULL16 or FULL32 in (length, first)) and locator[:4] == LOCATOR:
            wide = self.read(struct.unpack(LOCATOR_LAYOUT, locator)[2], 56)
            if wide[:4] != END64 or len(wide) < 56:
                raise ValueError("broken ZIP64 end record")
            *_, n, length, first = struct.unpack(END64_LAYOUT, wide)
        self.members, central, at = {}, self.read(first, length), 0
        for _ in range(n):
            if central[at : at + 4] != CENTRAL or at + 46 > len(central):
                raise ValueError("broken central directory")
            x = struct.unpack_from(CENTRAL_LAYOUT, central, at)
            method, stored, full, names, extras, notes, header = x[4], x[8], x[9], x[10], x[11], x[12], x[16]
            name, extra = central[at + 46 : at + 46 + names], central[at + 46 + names : at + 46 + names + extras]
            full, stored, header = self.wide(extra, full, stored, header)
            name = name.decode("utf-8" if x[3] & 0x800 else "cp437")
            self.members[name] = Member(name, method, full, stored, header)
            at += 46 + names + extras + notes

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at) if n > 0 else b""

    @staticmethod
    def wide(extra: bytes, *values: int) -> tuple[int, ...]:
        """Values of 32 bits, those that are full taken from the ZIP64 extra field."""
        at, out = 0, list(values)
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<2H", extra, at)
            if kind == 1:
                place = at + 4
                for i, v in enumerate(out):
                    if v == FULL32:
                        (out[i],) = struct.unpack_from("<Q", extra, place)
                        place += 8
            at += 4 + size
        return tuple(out)

    def start(self, name: str) -> int:
        """Where the data of a stored member begins."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(m.header, 30)
        if head[:4] != LOCAL or len(head) < 30:
            raise ValueError(f"{name} has no local header where the directory says")
        *_, names, extras = struct.unpack(LOCAL_LAYOUT, head)
        return m.header + 30 + names + extras

    def archives(self) -> list[str]:
        """Members that hold WARC records: those in archive/, or any if there are none there."""
        all_of = [m for m in self.members if re.search(r"\.warc(\.gz)?$", m, re.I)]
        return [m for m in all_of if m.startswith("archive/")] or all_of

    def indexes(self) -> list[str]:
        """Plain index members: lines of JSON, alone or behind a key and a time."""
        return [m for m in self.members if m.startswith("indexes/") and re.search(r"\.(jsonl|cdxj?)$", m, re.I) and not self.members[m].method]


def record(page: object, url: str, payload: bytes, digest: str, kind: str, refers: object) -> bytes:
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{page}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\nX-Payload-Length: {len(payload)}\r\n"
    if kind == "revisit":
        head += f"WARC-Refers-To: <urn:page:{refers}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        payload = b""
    return f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of the records in a stream of bytes."""
    held, left = bytearray(), iter(chunks)

    def more() -> bool:
        new = next(left, None)
        if new is not None:
            held.extend(new)
        return new is not None

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("not a WARC record")
                return
            while held[:2] == b"\r\n":
                del held[:2]
        version, *lines = re.sub(r"\r\n[ \t]+", " ", held[:end].decode("utf-8", "replace")).split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        stop = end + 4 + int(fields.get("content-length", 0))
        while len(held) < stop:
            if not more():
                raise ValueError("a WARC record breaks off")
        yield fields, bytes(held[end + 4 : stop])
        del held[:stop]


def unzipped(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The content of gzip members one after the other."""
    gz = zlib.decompressobj(31)
    for chunk in chunks:
        for k in range(0, len(chunk), 1 << 16):  # what is behind a member's end is copied, so it must be short
            data = chunk[k : k + (1 << 16)]
            while data:
                yield gz.decompress(data)
                data, gz = (gz.unused_data, zlib.decompressobj(31)) if gz.eof else (b"", gz)


def pieces(file: pa.NativeFile, at: int, size: int) -> Iterator[bytes]:
    for k in range(at, at + size, READ_BYTES):
        yield file.read_at(min(READ_BYTES, at + size - k), k)


def cut(data: bytes, lengths: list[int]) -> Iterator[bytes]:
    at = 0
    for n in lengths:
        yield data[at : at + n]
        at += n


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What the payload digest is of: of an HTTP message the part behind its head, else the whole block."""
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").lower().startswith("application/http") else block


def bare(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def decided(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Add __digest, and __refers: the page id of the response that a record revisits, else null; __revisit says which.

    Answers by digest are joined to narrow rows (id and digest), so that copies of one payload don't meet in one task with their
    payloads, and come back by id and digest; of rows alike in both one answer holds for all.
    """
    rows = pages.withColumn(payload, F.coalesce(F.col(payload), F.lit(""))).withColumn("__digest", F.sha1(F.encode(payload, "UTF-8")))
    long = F.octet_length(payload) >= least
    narrow = rows.where(long).select(F.col(key).alias("__key"), "__digest").distinct()
    best = rows.where(long).groupBy("__digest").agg(F.max(key).alias("__best"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    told = narrow.join(best, "__digest").where(~F.col("__key").eqNullSafe(F.col("__best"))).select("__key", F.col("__digest").alias("__own"), F.col("__best").alias("__refers"), F.lit(True).alias("__told"))
    out = rows.join(told, rows[key].eqNullSafe(told["__key"]) & (rows["__digest"] == told["__own"]), "left").drop("__key", "__own")
    return out.withColumn("__revisit", F.coalesce("__told", F.lit(False))).drop("__told")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, wide: bool = False, package: int = PACKAGE_BYTES) -> DataFrame:
    """Write packages to the folder; path, records, bytes of each."""
    rows = decided(pages, key, payload, least).select(key, url, payload, "__digest", "__revisit", "__refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        where.create_dir(base, recursive=True)
        zipped, index, name = None, [], ""

        def close() -> pa.RecordBatch:
            zipped.end()
            zipped.begin(INDEX)
            zipped.add("".join(index).encode())
            zipped.end()
            zipped.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([zipped.at], pa.int64())})

        for batch in batches:
            for k in range(batch.num_rows):
                page, link, text, digest, revisit, refers = (c[k].as_py() for c in batch.columns)
                if zipped is None:
                    name, index = f"{uuid.uuid4().hex}.zip", []
                    zipped = ZipWriter(where.open_output_stream(f"{base}/{name}"), wide)
                    zipped.begin(DATA)
                data = text.encode()
                kind = "revisit" if revisit else "response"
                packed = gzip.compress(record(page, (link or "").replace("\r", "%0D").replace("\n", "%0A"), data, bare(bytes.fromhex(digest)), kind, refers), 1, mtime=0)
                index.append(json.dumps({"page": page, "type": kind, "offset": zipped.add(packed), "length": len(packed)}) + "\n")
                if zipped.at > package:
                    yield close()
                    zipped = None
        if zipped is not None:
            yield close()

    return rows.mapInArrow(run, "path string, records bigint, bytes bigint")


def located(z: ZipReader) -> Iterator[tuple[str, int, int, list[int]]]:
    """(archive, offset in it, length, lengths of the records) of stretches by the indexes, or of whole archives that no index names."""
    archives, found = z.archives(), {}
    for index in z.indexes():
        lines = z.read(z.start(index), z.members[index].size).splitlines()
        for x in (json.loads(line[line.index(b"{") :]) for line in lines if b"{" in line):
            own = [m for m in archives if "filename" not in x or m == x["filename"] or m.endswith("/" + x["filename"])]
            if own and "offset" in x and "length" in x:
                found.setdefault(own[0], []).append((int(x["offset"]), int(x["length"])))
    for name in archives:
        held: list[tuple[int, int]] = []
        for at, n in sorted(set(found.get(name, []))):
            if held and (at != held[-1][0] + held[-1][1] or at + n - held[0][0] > READ_BYTES):
                yield name, held[0][0], held[-1][0] + held[-1][1] - held[0][0], [x for _, x in held]
                held = []
            held.append((at, n))
        if held:
            yield name, held[0][0], held[-1][0] + held[-1][1] - held[0][0], [x for _, x in held]
        elif name not in found:
            yield name, 0, z.members[name].size, []


def ranges(packages: DataFrame) -> DataFrame:
    """path, packed, offset, length, cuts: stretches of records that lie side by side, found by the directory and the indexes of each package; without an index the whole archive, and no cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, name = opened(path)
                with where.open_input_file(name) as f:
                    z = ZipReader(f)
                    out = [(m.lower().endswith(".gz"), z.start(m) + at, n, cuts) for m, at, n, cuts in located(z)]
                packed, offset, length, cuts = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"path": [path] * len(out), "packed": pa.array(packed, pa.bool_()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64()), "cuts": pa.array(cuts, pa.list_(pa.int64()))})

    return packages.mapInArrow(run, "path string, packed boolean, offset bigint, length bigint, cuts array<bigint>")


def read(stretches: DataFrame, payloads: bool = True) -> DataFrame:
    """record_id, url, record_type, refers_to string, payload_digest (of the header for revisits, else of the payload as read), payload_bytes long (null for revisits that do not tell), payload binary."""
    columns = "record_id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes bigint" + ", payload binary" * payloads

    def row(fields: dict[str, str], block: bytes) -> tuple:
        own = lambda v: (v or "").strip("<>").removeprefix("urn:page:") or None
        kind, payload = fields.get("warc-type"), payload_of(fields, block)
        told = fields.get("warc-payload-digest", "")
        told = told[5:].upper() if re.fullmatch(r"sha1:[A-Za-z2-7]{32}", told) else None
        digest = told if kind == "revisit" else bare(hashlib.sha1(payload).digest())
        if told and digest != told:
            raise ValueError(f"{fields.get('warc-record-id')}: the payload read has another digest than its header")
        size = fields.get("x-payload-length") if kind == "revisit" else len(payload)
        return own(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, own(fields.get("warc-refers-to")), digest, size and int(size), *([payload] * payloads)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string()] * 5 + [pa.int64(), pa.binary()], strict=False)], [c.split()[0] for c in columns.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                where, name = opened(x["path"])
                with where.open_input_file(name) as f:
                    chunks = pieces(f, x["offset"], x["length"]) if not x["cuts"] else cut(f.read_at(x["length"], x["offset"]), x["cuts"])
                    rows, held = [], 0
                    for fields, block in records(unzipped(chunks) if x["packed"] else chunks):
                        rows.append(row(fields, block))
                        held += len(block)
                        if held > READ_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    return stretches.mapInArrow(run, columns)


def round_trip(pages: DataFrame, folder: str, key: str = "page_id", least: int = 0, **columns: str) -> DataFrame:
    """Write the packages, keep their list, deal their stretches out and read the records back."""
    spark: SparkSession = pages.sparkSession
    listed = f"{folder}/list-{uuid.uuid4().hex}"
    write(pages, f"{folder}/packages-{uuid.uuid4().hex}", key, least=least, **columns).write.parquet(listed)
    packages = spark.read.schema("path string, records bigint, bytes bigint").parquet(listed)
    stretches = ranges(packages).repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = pages.schema[key].dataType
    number = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(kind)
    return read(stretches, payloads=False).select(number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
