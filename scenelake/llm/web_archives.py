"""WARC records in ZIP packages: stored members, an index, and reads of single records by range.

A package holds `archive/data.warc.gz`, one gzip member a record, and
`indexes/index.cdx`, a line of JSON a record with its offset and length. Both
are stored in the ZIP without compression, so a record is read from the
package where it lies: the directory at the file's end (ZIP64 where needed)
gives the members, the index the ranges.

Records with equal payloads of at least `least` bytes: that with the smallest
page_id is a response, the others are revisits that refer to it, also where
rows repeat a page_id. So each row gives one record, and a payload is stored
once, but for rows without a page_id: those revisit a page that has one, and are
responses where none has. Of rows that repeat page_id and payload, that with the
smallest url is the response (null last); rows equal in all three are alike. A
null html is an empty payload, a null url about:blank. Other columns are not
looked at.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import shared_files

#: Payload in a package; bytes of equal payloads that may meet in one task; rows that are repeated in one.
PACKAGE_BYTES, HOT_BYTES, REPEATED = 64 << 20, 64 << 20, 10_000
COLUMNS = ["page_id", "url", "html", "size", "sha1", "refers_to"]
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").rstrip(">")
    return int(number) if number else None


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, size: int | None = None, sha1: str | None = None) -> bytes:
    """A response record, or a revisit that has only the HTTP head; a revisit may give its payload's size and SHA-1 (base32) instead."""
    size, sha1 = (len(payload), digest(payload)) if sha1 is None else (size, sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    uri = "".join(c for c in url or "about:blank" if c >= " " and c != "\x7f")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head[3:3] = [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Headers of a record (lower case), its HTTP headers and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    body = rest[: int(warc["content-length"])]
    if len(body) != int(warc["content-length"]) or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = body.partition(b"\r\n\r\n")
    return {"warc": warc, "http": {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, "payload": payload}


class PackageWriter:
    """A ZIP of stored members, in one pass; ZIP64 fields where sizes or offsets, or tests, ask for them."""

    def __init__(self, out, zip64_from: int = 0xFFFFFFFF):
        self.out, self.at, self.members, self.limit = out, 0, [], zip64_from

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        start, crc, raw = self.at, zlib.crc32(data), name.encode()
        wide = len(data) >= self.limit
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        size = 0xFFFFFFFF if wide else len(data)
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), start))

    def close(self) -> None:
        first = self.at
        for raw, crc, size, start in self.members:
            wide = [x for x in (size, size, start) if x >= self.limit]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            short = [0xFFFFFFFF if x >= self.limit else x for x in (size, start)]
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x800, 0, 0, 33, crc, short[0], short[0], len(raw), len(extra), 0, 0, 0, 0, short[1]) + raw + extra)
        size, n, end = self.at - first, len(self.members), self.at
        if wide := max(first, size) >= self.limit or n >= 0xFFFF:
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, first) + struct.pack("<IIQI", 0x07064B50, 0, end, 1))
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, *([0xFFFF] * 2 if wide else [n, n]), *([0xFFFFFFFF] * 2 if wide else [size, first]), 0))


def members(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the content of each stored member of a ZIP."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(b"PK\x05\x06")
    if k < 0:
        raise ValueError("no ZIP directory")
    n, length, first = struct.unpack_from("<HII", tail, k + 10)
    if 0xFFFFFFFF in (length, first) or n == 0xFFFF:
        mark, _, at, _ = struct.unpack("<IIQI", read(tail_at + k - 20, 20))
        if mark != 0x07064B50:
            raise ValueError("no ZIP64 locator")
        n, length, first = struct.unpack("<QQQ", read(at, 56)[32:56])
    directory, at, out = read(first, length), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, full, names, extras, notes, _, _, _, start = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, at)
        if mark != 0x02014B50:
            raise ValueError("a ZIP directory entry is broken")
        name = directory[at + 46 : at + 46 + names].decode()
        extra, e = directory[at + 46 + names : at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, m = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{m // 8}Q", extra, e + 4))
                full, packed, start = (wide.pop(0) if x == 0xFFFFFFFF else x for x in (full, packed, start))
            e += 4 + m
        at += 46 + names + extras + notes
        if method == 0 and not flags & 1:
            local = struct.unpack("<HH", read(start + 26, 4))
            out[name] = (start + 30 + sum(local), packed)
    return out


class Package:
    """Reads records of one package by range; nothing is extracted."""

    def __init__(self, uri: str):
        system, path = shared_files.opened(uri)
        self.file = system.open_input_file(path)
        self.members = members(self.file, self.file.size())

    def index(self) -> Iterator[dict]:
        for name in sorted(x for x in self.members if x.startswith("indexes/")):
            at, n = self.members[name]
            self.file.seek(at)
            for line in self.file.read(n).splitlines():
                yield json.loads(line.split(b" ", 2)[2])

    def record(self, entry: dict) -> dict:
        at, size = self.members[entry["filename"]]
        if entry["offset"] + entry["length"] > size:
            raise ValueError("a record lies beyond its member")
        self.file.seek(at + entry["offset"])
        return parsed(zlib.decompress(self.file.read(entry["length"]), 31))

    def close(self) -> None:
        self.file.close()


def with_referents(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """page_id, url, html, size, sha1 (hex) and refers_to: responses have html and no refers_to, revisits size and sha1 instead of html.

    Equal payloads meet only in counts: the smallest page_id of each digest is
    aggregated before rows move and written once. Only digests of several rows
    are joined back, those of many bytes without moving them. The rows that
    repeat their response's page_id and payload are counted by url and dealt
    out again in small numbers, without html, so that no task gets them all.
    """
    folder = folder or X.workdir(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("size", F.octet_length("html").cast("long"))
    pages = pages.withColumn("key", F.when(F.col("size") >= least, F.sha2(F.col("html").cast("binary"), 256)))
    held = (F.col("size") + F.coalesce(F.octet_length("url"), F.lit(0)) + 64).alias("held")
    ids = pages.select("key", "page_id", held).filter("key is not null")
    ids = ids.groupBy("key", "page_id").agg(F.count("*").alias("same"), F.sum("held").alias("held"))
    first = F.min_by(F.struct("page_id", "same"), F.struct(F.col("page_id").isNull(), "page_id"))
    keys = ids.groupBy("key").agg(first.alias("x"), F.sum("same").alias("w"), F.sum("held").alias("held")).filter("w > 1 and x.page_id is not null")
    keys = X.saved(keys.select("key", F.col("x.page_id").alias("first"), F.col("x.same").alias("same"), "held"), folder, "repeated-payloads")
    total = keys.agg(F.sum("held")).first()[0] or 0
    joined = X.spread_join(pages, keys, "key", "held", total, HOT_BYTES, how="left")
    at_first = F.col("page_id").eqNullSafe(F.col("first"))
    twice = at_first & (F.coalesce("same", F.lit(0)) > 1)
    refers_to = F.when(~at_first, F.col("first"))
    html = F.when(refers_to.isNull(), F.col("html"))
    sha1 = F.when(refers_to.isNotNull(), F.sha1(F.col("html").cast("binary")))
    out = joined.filter(~twice).select("page_id", "url", html.alias("html"), "size", sha1.alias("sha1"), refers_to.alias("refers_to"))
    if keys.filter("same > 1").isEmpty():
        return out
    return out.unionByName(_repeats(joined.filter(twice), folder))


def _repeats(rows: DataFrame, folder: str) -> DataFrame:
    """One response for each key, and revisits for its other rows; all rows of a key have one page_id and payload."""
    spark = rows.sparkSession
    sha1 = F.sha1(F.col("html").cast("binary")).alias("sha1")
    counts = rows.select("key", "page_id", "url", "size", sha1).groupBy("key", "page_id", "url", "size", "sha1").agg(F.count("*").alias("n"))
    counts = X.saved(counts, folder, "repeated-rows")
    least = F.min_by(F.struct("url"), F.struct(F.col("url").isNull(), "url"))
    winners = counts.groupBy("key").agg(least.alias("least"), F.count("*").alias("urls"))
    bodies = rows.groupBy("key", "page_id", "size").agg(F.first("html").alias("html"))
    none = F.lit(None)
    responses = bodies.join(winners, "key").select("page_id", F.col("least.url").alias("url"), "html", "size", none.cast("string").alias("sha1"), none.cast("long").alias("refers_to"))
    n_rows, n_urls = counts.agg(F.sum("n"), F.count("*")).first()
    others = X.spread_join(counts, winners, "key", "urls", n_urls)
    others = others.withColumn("n", F.col("n") - F.col("url").eqNullSafe(F.col("least.url")).cast("long")).filter("n > 0")
    # first in portions, which are spread, then each portion's rows
    others = others.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATED))))
    others = others.repartition(max(X.deal(spark, 0), (n_rows or 0) // (10 * REPEATED)), "key", "url", "k")
    others = others.withColumn("i", F.explode(F.sequence(F.col("k") * REPEATED + 1, F.least("n", (F.col("k") + 1) * REPEATED))))
    return responses.unionByName(others.select("page_id", "url", none.cast("string").alias("html"), "size", "sha1", F.col("page_id").alias("refers_to")))


def write(pages: DataFrame, folder: str, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes the packages; returns their paths, read from the folder."""
    shared_files.folder(f"{folder}/packages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        warc, index, size = io.BytesIO(), [], 0

        def put() -> pa.RecordBatch:
            path = f"{folder}/packages/part-{part:06d}-{k:06d}.wacz"
            with shared_files.written(path) as out:
                package = PackageWriter(out)
                package.add(ARCHIVE, warc.getvalue())
                package.add(INDEX, b"".join(index))
                package.close()
            return pa.RecordBatch.from_pylist([{"path": path, "records": len(index)}], pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for page_id, url, html, n, sha1, refers_to in zip(*(batch.column(c).to_pylist() for c in COLUMNS), strict=True):
                body = record(page_id, url, html.encode(), None) if refers_to is None else record(page_id, url, b"", refers_to, n, base64.b32encode(bytes.fromhex(sha1)).decode())
                packer = zlib.compressobj(3, zlib.DEFLATED, 31)
                data = packer.compress(body) + packer.flush()
                entry = {"page_id": page_id, "filename": ARCHIVE, "offset": warc.tell(), "length": len(data)}
                index.append(f"page:{'-' if page_id is None else page_id} 19700101000000 {json.dumps(entry)}\n".encode())
                warc.write(data)
                size += len(body)
                if size >= package_bytes:
                    yield put()
                    warc, index, size, k = io.BytesIO(), [], 0, k + 1
        if index:
            yield put()

    return X.saved(with_referents(pages, least, folder).select(*COLUMNS).mapInArrow(run, "path string, records long"), folder, "packages-list")


def read(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """Every record of the packages: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            package, rows = Package(path), []
            for entry in package.index():
                got = package.record(entry)
                warc, kind = got["warc"], got["warc"]["warc-type"]
                if kind == "response" and digest(got["payload"]) != warc["warc-payload-digest"].removeprefix("sha1:"):
                    raise ValueError(f"{path}: the payload of {warc['warc-record-id']} is not what was written")
                rows.append({
                    "page_id": page_of(warc["warc-record-id"]),
                    "url": warc["warc-target-uri"],
                    "payload": got["payload"] if kind == "response" else None,
                    "payload_bytes": int(got["http"]["content-length"]),
                    "payload_digest": warc["warc-payload-digest"].removeprefix("sha1:"),
                    "record_type": kind,
                    "refers_to": page_of(warc["warc-refers-to"]) if "warc-refers-to" in warc else None,
                })
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            package.close()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = packages.count()
    return packages.select("path").repartition(max(1, n)).mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")
