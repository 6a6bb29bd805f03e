"""Token ids in bit-plane shuffled, zstandard-compressed files.

A file holds the ids of consecutive documents as unsigned 32-bit integers, cut into blocks of a fixed
number of ids. Each block is transposed into 4 byte planes (or 32 bit planes) and each plane is
compressed by itself: high planes are almost constant and vanish, low planes keep neighbours of equal
significance together.

    "PLANES01" | planes of block 0 | planes of block 1 | ... | index | length of index (8 bytes) | "PLANES01"

The index is a zstandard frame of: number of blocks, planes a block, ids a block, documents (4 x int64);
for each block its ids and the lengths of its planes (int64); for each document whether it has an id
(int64), the id (int64) and its tokens (int64). Readers read the index, then any block by a range read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, new_path, spread, table
from .storage import create, open_range
from .tokens import encoder, slices, vocabulary

MAGIC = b"PLANES01"
BLOCK = 1 << 16


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Byte or bit planes of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in np.ascontiguousarray(raw.T)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in np.ascontiguousarray(flat.T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """Inverse of :func:`to_planes`."""
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).reshape(-1, 4).view("<u4").ravel()


class Writer:
    """Streams documents into a file; holds one block at a time."""

    def __init__(self, out, bits: bool = False, block: int = BLOCK, level: int = 3):
        import zstandard

        self.out, self.bits, self.block = out, bits, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.held = np.zeros(0, "<u4")
        self.blocks: list[int] = []
        self.docs: list[np.ndarray] = []
        self.ids = 0
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents in a row, with the ids of all of them."""
        self.docs.append(np.array([(x is not None, x or 0, n) for x, n in zip(doc_ids, counts.tolist(), strict=True)], "<i8").reshape(-1, 3))
        self.ids += len(ids)
        ids, at = np.concatenate([self.held, ids]), 0
        while len(ids) - at >= self.block:
            self._flush(ids[at : at + self.block])
            at += self.block
        self.held = ids[at:].copy()

    def _flush(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.bits)]
        self.blocks += [len(ids), *map(len, planes)]
        for p in planes:
            self.out.write(p)

    def close(self) -> None:
        if len(self.held):
            self._flush(self.held)
        planes = 32 if self.bits else 4
        docs = np.concatenate([np.zeros((0, 3), "<i8"), *self.docs])
        head = np.array([len(self.blocks) // (planes + 1), planes, self.block, len(docs)], "<i8")
        index = self.zstd.compress(head.tobytes() + np.array(self.blocks, "<i8").tobytes() + docs.tobytes())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()


class Reader:
    """Index of a file and range reads of its blocks."""

    def __init__(self, file):
        import zstandard

        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        size = file.size()
        tail = self._at(size - 16, 16)
        if tail[8:] != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a plane file")
        n = int.from_bytes(tail[:8], "little")
        index = np.frombuffer(self.zstd.decompress(self._at(size - 16 - n, n)), "<i8")
        blocks, planes, self.block, docs = map(int, index[:4])
        cut = 4 + blocks * (planes + 1)
        self.blocks = index[4:cut].reshape(blocks, planes + 1)
        self.docs = index[cut:].reshape(docs, 3)
        self.starts = len(MAGIC) + np.r_[0, np.cumsum(self.blocks[:, 1:].sum(axis=1))].astype(int)

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def read_block(self, k: int) -> np.ndarray:
        raw, at, planes = self._at(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k])), 0, []
        for n in self.blocks[k, 1:]:
            planes.append(self.zstd.decompress(raw[at : at + n]))
            at += n
        return from_planes(planes, int(self.blocks[k, 0]))

    def documents(self) -> Iterator[tuple[int | None, int, int, Iterator[bytes]]]:
        """Doc id, start within the file, tokens, and the ids' bytes in pieces; one block is held at a time."""
        ends = np.r_[0, np.cumsum(self.blocks[:, 0])] if len(self.blocks) else np.zeros(1, int)
        held, ids, start = -1, None, 0
        for has, doc_id, n in self.docs.tolist():

            def pieces(at=start, end=start + n):
                nonlocal held, ids
                while at < end:
                    k = at // self.block
                    if k != held:
                        held, ids = k, self.read_block(k)
                    stop = min(end, int(ends[k + 1]))
                    yield ids[at - int(ends[k]) : stop - int(ends[k])].tobytes()
                    at = stop

            yield (doc_id if has else None), start, n, pieces()
            start += n


def _write(folder: str, path: str, end_id: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, writer, uri = encoder(path), TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for some in slices(batch, 1):
                if writer is None:
                    uri, out = create(folder, f"part-{part:06d}")
                    writer = Writer(out, bits)
                ids, counts = enc.encode(some.column(1), end_id)
                writer.add(some.column(0).to_pylist(), counts, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [uri], "ids": [writer.ids]})

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", bits: bool = False, parts: int | None = None) -> DataFrame:
    """Encode ``docs`` into plane files in ascending ``doc_id`` order; gives ``file, ids, start``.

    One file for each id range; ``start`` is the number of ids in all earlier files. Null text is empty
    (only the end id), null ids come first, rows that repeat an id are kept, ordered by text. An empty
    table gives no file.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts or spread(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    files = materialise(rows.mapInArrow(_write(folder, tokenizer, end_id, bits), "part long, file string, ids long"), "files")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    return files.select("file", "ids", F.coalesce(before, F.lit(0)).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for b in batches:
        for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = []
            with open_range(file) as f:
                for doc_id, start, n, pieces in Reader(f).documents():
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p, crc)
                    rows.append((doc_id, base + start, n, crc))
                    if len(rows) >= 10_000:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)


def read_index(files: DataFrame, parts: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files' blocks."""
    rows = files.select("file", "start").repartition(parts or spread(files.sparkSession))
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to plane files and read back.

    Null and empty texts hold the end id alone; null ids come first and rows that repeat an id are kept,
    ordered by text; very long texts span blocks; an empty table gives no row; other columns are ignored.
    """
    files = write_ids(table(spark, sf_dir, "documents"), new_path(spark, "planes"), vocabulary("byte_bpe_50k.json"))
    return read_index(files)
