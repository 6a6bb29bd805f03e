"""Order-preserving packing of documents into sequences by dynamic programming.

The stream of documents, in ascending id order, is cut into windows of at most ``size`` tokens. Cuts
lie at document ends, at sentence ends, and, where a sentence is long, at steps within it. A window
costs its padding (none at a power of two) plus ``per_window``; a cut costs ``sentence_cut`` or
``word_cut`` unless it is a document's end. The cheapest windows ending at each cut are found with a
monotone queue over ``cost so far + position``, as padding is linear in the window's start; windows at
a power of two are looked up directly. Each id range of the documents is one stream, solved in
segments of bounded length; a segment's last window is carried over to the next.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table
from .storage import settle
from .tokens import encoder, slices, vocabulary

SIZE = 2048
SEGMENT = 1 << 17
#: Bytes of text encoded together.
SLICE = 4 << 20
SENTENCE_CUT, WORD_CUT, PER_WINDOW = 4, 24, 2
LONG, STEP = 64, 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def windows(cuts: list[int], penalty: list[int], size: int = SIZE, per_window: int = PER_WINDOW) -> list[int]:
    """Cheapest cuts, as indices into ``cuts``; ``cuts[0]`` is the stream's start, the last one its end.

    Neighbouring cuts must be at most ``size`` apart.
    """
    place = np.asarray(cuts)
    full: list[tuple[int, ...]] = [()] * len(cuts)  # cuts at a power of two before each cut
    for k in (1 << x for x in range(8, size.bit_length())):
        at = np.minimum(np.searchsorted(place, place - k), len(place) - 1)
        found = np.flatnonzero(place[at] == place - k)
        for j, h in zip(found.tolist(), at[found].tolist(), strict=True):
            full[j] = (*full[j], h)
    cost, back = [0] * len(cuts), [0] * len(cuts)
    queue = deque([(0, 0, cuts[0])])  # cost + position, index, position
    for j in range(1, len(cuts)):
        p = cuts[j]
        while queue[0][2] < p - size:
            queue.popleft()
        best, i = queue[0][0] + size - p, queue[0][1]
        for h in full[j]:
            if cost[h] < best:
                best, i = cost[h], h
        best += per_window + penalty[j]
        cost[j], back[j] = best, i
        best += p
        while queue and queue[-1][0] > best:
            queue.pop()
        queue.append((best, j, p))
    out, j = [len(cuts) - 1], len(cuts) - 1
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def candidate_cuts(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cuts and their penalties from document ends and sentence ends; long gaps get steps."""
    penalty = np.full(int(ends[-1]) + 1, WORD_CUT)
    penalty[sentences] = SENTENCE_CUT
    penalty[ends] = penalty[0] = 0
    base = np.flatnonzero(penalty < WORD_CUT)
    gaps = np.diff(base)
    steps = np.where(gaps > LONG, (gaps - 1) // STEP, 0)
    cuts = np.repeat(base[:-1], steps) + STEP * (1 + np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps))
    cuts = np.sort(np.r_[base, cuts])
    return cuts, penalty[cuts]


class Packer:
    """Packs one stream; ``add`` and ``finish`` give lists of pieces (rows of SCHEMA)."""

    def __init__(self, is_end: np.ndarray, first_sequence: int, size: int = SIZE, segment: int = SEGMENT):
        self.is_end, self.sequence, self.size, self.segment = is_end, first_sequence, size, segment
        self.docs: list[tuple[int | None, bytes, int]] = []  # id, ids, tokens already packed
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.held += len(ids) // 4
        return self._solve(False) if self.held >= self.segment else []

    def finish(self) -> list[tuple]:
        return self._solve(True) if self.docs else []

    def _solve(self, last: bool) -> list[tuple]:
        ends = np.cumsum([len(x) // 4 - done for _, x, done in self.docs])
        flat = np.frombuffer(b"".join(x[4 * done :] for _, x, done in self.docs), "<u4")
        cuts, penalty = candidate_cuts(ends, np.flatnonzero(self.is_end[flat]) + 1)
        cuts = cuts.tolist()
        chosen = [cuts[i] for i in windows(cuts, penalty.tolist(), self.size)]
        if not last and len(chosen) > 2:
            chosen.pop()
        if last:  # the stream's last window may be far from full: cut it at powers of two if that is cheaper
            at, n = chosen[-2], chosen[-1] - chosen[-2]
            powers = [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]
            if len(powers) > 1 and self.size - n > (len(powers) - 1) * (WORD_CUT + PER_WINDOW):
                chosen[-1:] = (at + np.cumsum(powers)).tolist()
        out, k, at = [], 0, 0  # document, position
        for lo, hi in zip(chosen, chosen[1:], strict=False):
            while at < hi:
                doc_id, ids, done = self.docs[k]
                start = done + at - (int(ends[k - 1]) if k else 0)
                n = min(hi, int(ends[k])) - at
                out.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, self.sequence, at - lo))
                at += n
                k += at == ends[k]
            self.sequence += 1
        rest = self.docs[k:]
        if rest:
            doc_id, ids, done = rest[0]
            rest[0] = (doc_id, ids, done + at - (int(ends[k - 1]) if k else 0))
        self.docs, self.held = rest, int(ends[-1]) - at
        return out


def _pack(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, words=True)
        vocab = enc.tokenizer.get_vocab()
        is_end = np.zeros(max(vocab.values()) + 1, bool)
        is_end[[i for t, i in vocab.items() if t.endswith("</w>") and t[:-4] and set(t[:-4]) <= set(".!?") | set("\"')") and set(t[:-4]) & set(".!?")]] = True
        packer = Packer(is_end, TaskContext.get().partitionId() << 40, size)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            for some in slices(b, 1, SLICE):
                ids, counts = enc.encode(some.column(1), end_id)
                raw, at = ids.tobytes(), 0
                for doc_id, n in zip(some.column(0).to_pylist(), counts.tolist(), strict=True):
                    if rows := packer.add(doc_id, raw[4 * at : 4 * (at + n)]):
                        yield batch(rows)
                    at += n
        if rows := packer.finish():
            yield batch(rows)
        del packer
        settle()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SIZE, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Pieces of all documents (see SCHEMA) in sequences of at most ``size`` tokens.

    Null and empty texts are one piece holding the end id. Null ids come first; rows that repeat an id
    are separate documents, ordered by text; very long texts are cut over many sequences; an empty table
    gives no piece. ``sequence_id`` holds the id range in its high bits and counts up within it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(parts or spread(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(_pack(tokenizer, end_id, size), SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are one piece holding the end id; null ids come first and rows that repeat an id
    are documents of their own; very long texts span sequences; an empty table gives no row; other
    columns are ignored.
    """
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
