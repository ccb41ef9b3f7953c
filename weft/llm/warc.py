"""WARC records in ZIP-packaged archives: writing, and range reads without extraction.

An archive is a ZIP whose members are stored, not deflated: ``archive/data.warc.gz`` holds one gzip member per record and
``indexes/index.jsonl`` a line per record with its offset and length. The reader parses the end record, the ZIP64 end
record where there is one, and the central directory; finds the stored members; and reads only the ranges it needs. It
takes any ZIP with stored members of these names, with or without ZIP64 fields.

Files are reached through the URI's file system (local paths, or any store that Arrow's file systems open), so the folder
must be one that all executors share. An archive is closed after ``archive_bytes``; a task that is run again writes new
files under new names, and only the names that the successful attempt returns are read.

Defined results: a null payload is empty; equal payloads (SHA-1 and length) give one response, that with the smallest
identifier, and revisits; rows that repeat the response's identifier and payload are responses too, since a record cannot
refer to itself; a null identifier is written under a name of its own and read back as null, is never referred to and
revisits any other; identifiers are escaped, so none can forge a header; a null url is empty; an empty table gives no archive
and no record; other columns are ignored. A payload that differs from what its record says stops the reader, unless
``strict`` is false.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.session import materialize, run_dir

DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"


# -- ZIP ----------------------------------------------------------------------------------------------------------------

def _extra(size: int, offset: int | None, force: bool) -> tuple[bytes, int, int]:
    """The ZIP64 extra field and what stands in the 32-bit fields for size and offset."""
    wide_size, wide_offset = force or size >= 0xFFFFFFFF, offset is not None and (force or offset >= 0xFFFFFFFF)
    body = (struct.pack("<QQ", size, size) if wide_size else b"") + (struct.pack("<Q", offset) if wide_offset else b"")
    field = struct.pack("<HH", 1, len(body)) + body if body else b""
    return field, 0xFFFFFFFF if wide_size else size, 0xFFFFFFFF if wide_offset else offset or 0


class StoredZip:
    """Writes stored members one after another to an output stream that cannot seek."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: list[bytes]) -> None:
        """chunks are held by the caller, so size and checksum stand in the local header."""
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        raw, start = name.encode(), self.at
        extra, small, _ = _extra(size, None, self.zip64)
        self._write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._write(c)
        self.entries.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.entries:
            extra, small, at = _extra(size, offset, self.zip64)
            self._write(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or start >= 0xFFFFFFFF or size >= 0xFFFFFFFF or n >= 0xFFFF:
            end = self.at
            self._write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            n, size, start = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, size, start, 0))


def _at(file, offset: int, length: int) -> bytes:
    file.seek(offset)
    return file.read(length)


def zip_members(file, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of the data, length) of the stored members, from the central directory."""
    tail_at = max(0, size - 65557 - 20)
    tail = _at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP archive")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        record = _at(file, at, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record where its locator points")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, p, found = _at(file, start, length), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, plain, a, b, c = struct.unpack_from("<IIHHH", directory, p + 20)
        (offset,) = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + a].decode("utf-8", "replace")
        extra, q = directory[p + 46 + a : p + 46 + a + b], 0
        while q + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # 64-bit values of the fields that are full, in this order
                values = iter(struct.unpack_from(f"<{m // 8}Q", extra, q + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            q += 4 + m
        if method == 0:
            local = _at(file, offset, 30)
            found[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        p += 46 + a + b + c
    return found


# -- WARC ---------------------------------------------------------------------------------------------------------------

def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


RECORD, NO_NAME = "urn:page:", "urn:page-without-name"


def _name(key: str | None) -> str:
    return NO_NAME if key is None else RECORD + quote(key, safe="")


def _key(name: str | None) -> str | None:
    """The identifier in a header's <name>; null for none."""
    return unquote(name[1 + len(RECORD) : -1]) if name and name.startswith("<" + RECORD) else None


def _record(key: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_name(key)}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(refers_to)}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 3, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (names in lower case), HTTP headers, payload of one compressed record."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = lambda h: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in h.decode("utf-8", "replace").split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = 64 << 20, zip64: bool = False) -> DataFrame:
    """(archive, records) of the files written for ``rows`` (key, url, payload, digest, refers_to: strings, payload binary)."""

    def write(batches):
        held, index, size, made = [], [], 0, []

        def close():
            store, path = fs.FileSystem.from_uri(folder)
            store.create_dir(path, recursive=True)
            name = f"{path}/{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(name) as out:
                z = StoredZip(out, zip64)
                z.member(DATA, held)
                z.member(INDEX, ["\n".join(index).encode()])
                z.close()
            made.append((f"{folder}/{name.rpartition('/')[2]}", len(index)))

        for batch in batches:
            for key, url, payload, digest, refers in zip(*(batch.column(j).to_pylist() for j in range(5))):
                record = _record(key, url or "", payload, digest, refers)
                index.append(json.dumps({"key": key, "offset": size, "length": len(record)}))
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    close()
                    held, index, size = [], [], 0
        if index:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    wanted = rows.select("key", "url", "payload", "digest", "refers_to")
    return materialize(wanted.mapInArrow(write, "archive string, records long"), "archives")


def read_archives(archives: DataFrame, block: int = 500, blocks_at_once: int = 4, strict: bool = True) -> DataFrame:
    """A row per record of all archives: archive, key, record_type, refers_to, url, payload_digest, payload_bytes, payload (null for revisits), verified."""

    def locate(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as file:
                    members = zip_members(file, file.size())
                    start, _ = members[DATA]
                    lines = _at(file, *members[INDEX]).decode().splitlines()
                places = [(start + x["offset"], x["length"]) for x in map(json.loads, lines)]
                for i in range(0, len(places), block):
                    part = places[i : i + block]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([uri]), pa.array([[p[0] for p in part]], pa.list_(pa.int64())), pa.array([[p[1] for p in part]], pa.list_(pa.int64()))], ["archive", "offsets", "lengths"]
                    )

    names = ["archive", "key", "record_type", "refers_to", "url", "payload_digest", "payload_bytes", "payload", "verified"]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.bool_()]

    def read(batches):
        for batch in batches:
            for uri, offsets, lengths in zip(*(batch.column(j).to_pylist() for j in range(3))):
                store, path = fs.FileSystem.from_uri(uri)
                out = []
                with store.open_input_file(path) as file:
                    for at, length in zip(offsets, lengths):
                        warc, http, payload = parse_record(_at(file, at, length))
                        full = warc["warc-type"] == "response"
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        key, refers = _key(warc["warc-record-id"]), _key(warc.get("warc-refers-to"))
                        size = int(http["content-length"])
                        # a payload that is here must be what its record says
                        sound = not full or (len(payload) == size and sha1_base32(payload) == digest)
                        if strict and not sound:
                            raise ValueError(f"{uri}: the payload of {key} is not what its record says")
                        out.append((uri, key, warc["warc-type"], refers, warc["warc-target-uri"], digest, size, payload if full else None, sound))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    # counts of tasks are given: rows that only name places are so small that all would be read by one task
    n = archives.agg(F.count(F.lit(1)).alias("archives"), F.sum(F.ceil(F.col("records") / block)).alias("blocks")).first()
    places = archives.select("archive").repartition(max(1, n.archives), "archive").mapInArrow(locate, "archive string, offsets array<long>, lengths array<long>")
    # blocks of one archive go to many tasks
    dealt = places.repartition(max(1, -(-(n.blocks or 0) // blocks_at_once)), "archive", F.col("offsets")[0])
    return dealt.mapInArrow(read, "archive string, key string, record_type string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, verified boolean")


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, archive_bytes: int = 64 << 20) -> DataFrame:
    """Archives of a record per row of ``pages``; of equal payloads of at least ``least`` bytes, one is stored in full."""
    spark: SparkSession = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    size = F.octet_length("payload").alias("size")
    alike = materialize(rows.groupBy("digest", size, "id").agg(F.count(F.lit(1)).alias("n")), "payloads")  # no payloads
    firsts = alike.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("ids")).where("ids > 1")
    again = alike.join(firsts, ["digest", "size"]).where(~F.col("id").eqNullSafe(F.col("first")))
    again = again.select(F.col("digest").alias("_digest"), F.col("id").alias("_id"), F.col("first").cast("string").alias("refers_to"))
    joined = rows.join(again, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    rows = joined.select(F.col("id").cast("string").alias("key"), "url", "payload", "digest", "refers_to")
    rows = rows.withColumn("digest", _base32(F.col("digest")))
    return write_archives(rows, f"{run_dir(spark)}/warc-{uuid.uuid4().hex}", archive_bytes)


def _base32(hexes):
    """RFC 4648 base32 of 40 hex digits: eight groups of five hex digits, four letters each."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(letters), F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])
