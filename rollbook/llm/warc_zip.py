"""WARC records packaged in ZIP archives: writer, and reader that range-reads without extraction.

Each archive holds stored (uncompressed) members: ``archive/data-N.warc.gz``, in which every record is a
gzip member of its own, and ``indexes/index.cdxj`` with the member, offset and length of every record.
The reader parses the central directory (and the ZIP64 one), finds the data of stored members and turns
the index into byte ranges of the archive; tasks then read ranges of whole records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path, spread, table
from .storage import create, open_range

MEMBER = 256 << 20
RANGE = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip-compressed record; a revisit holds the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": DATE,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
    }
    if url is not None:
        fields["WARC-Target-URI"] = json.dumps(url)[1:-1]  # line breaks and others escaped
    if refers_to is not None:
        fields |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": PROFILE}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(1, wbits=31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def parse_records(raw: bytes, sizes: list[int]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each gzip member in ``raw``; ``sizes`` are the members' lengths."""
    at, view = 0, memoryview(raw)
    for size in sizes:
        z = zlib.decompressobj(wbits=31)
        text = z.decompress(view[at : at + size]) + z.flush()
        if not z.eof or z.unused_data:
            raise ValueError("record and index differ")
        at += size
        head, _, rest = text.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        n = int(fields["content-length"])
        if rest[n : n + 4] != b"\r\n\r\n":
            raise ValueError("record length is wrong")
        yield fields, rest[:n]


def directory(file) -> dict[str, tuple[int, int, int]]:
    """``method, local header offset, stored size`` of each member, from the central or ZIP64 directory."""
    size = file.size()

    def at(offset: int, n: int) -> bytes:
        file.seek(offset)
        return file.read(n)

    start = max(0, size - 65557)
    tail = at(start, size - start)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, offset = struct.unpack("<HII", tail[end + 10 : end + 20])
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
        (where,) = struct.unpack("<Q", tail[end - 12 : end - 4])
        big = at(where, 56)
        if big[:4] != b"PK\6\6":
            raise ValueError("bad ZIP64 end of central directory")
        count, length, offset = struct.unpack("<QQQ", big[32:56])
    raw, pos, found = at(offset, length), 0, {}
    for _ in range(count):
        if raw[pos : pos + 4] != b"PK\1\2":
            raise ValueError("bad central directory")
        method, packed, full, n, extra, comment = struct.unpack("<10xH8xIIHHH", raw[pos : pos + 34])
        (local,) = struct.unpack("<I", raw[pos + 42 : pos + 46])
        name = raw[pos + 46 : pos + 46 + n].decode()
        fields, k = raw[pos + 46 + n : pos + 46 + n + extra], 0
        while k + 4 <= len(fields):
            kind, m = struct.unpack("<HH", fields[k : k + 4])
            if kind == 1:  # 64-bit values, in this order, for those that are full in the entry
                wide = iter(struct.unpack(f"<{m // 8}Q", fields[k + 4 : k + 4 + m // 8 * 8]))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                local = next(wide) if local == 0xFFFFFFFF else local
            k += 4 + m
        found[name] = (method, local, packed)
        pos += 46 + n + extra + comment
    return found


def data_start(file, entry: tuple[int, int, int]) -> int:
    """Where a stored member's bytes begin."""
    if entry[0]:
        raise ValueError("member is not stored")
    file.seek(entry[1])
    head = file.read(30)
    if head[:4] != b"PK\3\4":
        raise ValueError("bad local header")
    return entry[1] + 30 + sum(struct.unpack("<HH", head[26:30]))


def ranges(file, most: int = RANGE) -> Iterator[tuple[int, list[int]]]:
    """Offset of runs of whole records and their lengths, at most ``most`` bytes unless one record is longer."""
    members = directory(file)
    starts: dict[str, int] = {}
    lo = hi = -1
    sizes: list[int] = []
    for name in sorted(n for n in members if n.startswith("indexes/") and n.endswith(".cdxj")):
        file.seek(data_start(file, members[name]))
        for line in file.read(members[name][2]).decode().splitlines():
            x = json.loads(line.split(" ", 2)[2])
            if x["filename"] not in starts:
                starts[x["filename"]] = data_start(file, members[x["filename"]])
            a = starts[x["filename"]] + x["offset"]
            if a != hi or hi - lo + x["length"] > most:
                if sizes:
                    yield lo, sizes
                lo, sizes = a, []
            hi = a + x["length"]
            sizes.append(x["length"])
    if sizes:
        yield lo, sizes


def _write(folder: str, member: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, uri, index, n = None, "", [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                if archive is None:
                    uri, out = create(folder, f"part-{TaskContext.get().partitionId():06d}.wacz")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
                    to, name, at = None, "", 0
                if to is None:
                    name, at = f"archive/data-{n}.warc.gz", 0
                    to, n = archive.open(zipfile.ZipInfo(name), "w", force_zip64=True), n + 1
                raw = record(page_id, url, (html or "").encode("utf-8"), refers_to)
                to.write(raw)
                index.append(f"{page_id} {DATE} " + json.dumps({"filename": name, "offset": at, "length": len(raw)}))
                at += len(raw)
                if at >= member:
                    to.close()
                    to = None
        if archive:
            if to:
                to.close()
            with archive.open(zipfile.ZipInfo("indexes/index.cdxj"), "w", force_zip64=True) as f:
                f.write("\n".join(index).encode())
            archive.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "records": [len(index)]})

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html", member: int = MEMBER) -> DataFrame:
    """One archive for each partition of ``pages``; gives ``file, records``.

    Of pages with equal payloads (SHA-1) of at least ``min_bytes`` bytes the one with the largest id is
    the response and the others revisit it. Digests are grouped before a shuffle and only those that
    repeat are joined back. Null html is an empty payload; pages with a null id are responses; rows that
    repeat the largest id are all responses; an empty table gives no archive.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    sha = F.sha1(F.encode("html", "UTF-8"))
    sums = rows.where(F.octet_length("html") >= min_bytes).select("page_id", sha.alias("sha"))
    repeated = sums.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last")
    repeated = materialise(repeated, "repeated").withColumnRenamed("sha", "__sha")
    rows = rows.withColumn("sha", sha).join(repeated, F.col("sha") == F.col("__sha"), "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("last") != F.col("page_id"), F.col("last")).alias("refers_to"))
    return materialise(rows.mapInArrow(_write(folder, member), "file string, records long"), "archives")


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for uri in b.column(0).to_pylist():
            with open_range(uri) as f:
                rows = list(ranges(f))
            columns = [pa.array([uri] * len(rows), pa.string()), pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "sizes"])


def _row(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda x: None if x is None or x.endswith(":none>") else int(x.rpartition(":")[2].rstrip(">"))
    head, _, payload = block.partition(b"\r\n\r\n")
    told = fields["warc-payload-digest"].removeprefix("sha1:")
    n = next(int(x.partition(":")[2]) for x in head.decode().split("\r\n") if x.lower().startswith("content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != n or digest(payload) != told):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    uri = fields.get("warc-target-uri")
    url = None if uri is None else json.loads(f'"{uri}"')
    return number(fields["warc-record-id"]), url, n, told, fields["warc-type"], number(fields.get("warc-refers-to")), payload


def _read(payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, offset, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with open_range(uri) as f:
                    f.seek(offset)
                    raw = f.read(sum(sizes))
                rows = [_row(*x) for x in parse_records(raw, sizes)]
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = [pa.array([r[i] for r in rows], kinds[i]) for i in range(6)]
                if payload:
                    columns.append(pa.array([None if r[4] == "revisit" else r[6] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names + ["payload"] * payload)

    return run


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records of the archives in column ``file``: SCHEMA, and ``payload binary`` (null for revisits)."""
    n = spread(files.sparkSession)
    plan = files.select("file").repartition(n).mapInArrow(_plan, "file string, offset long, sizes array<long>")
    return plan.repartition(n).mapInArrow(_read(payload), SCHEMA + ", payload binary" * payload)


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as records of archives, read back; null html is empty, odd ids as in :func:`write_archives`."""
    files = write_archives(table(spark, sf_dir, "pages"), new_path(spark, "archives"))
    return read_archives(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
