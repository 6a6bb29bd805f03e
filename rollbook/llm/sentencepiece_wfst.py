"""SentencePiece encoding and decoding as shortest paths of a weighted finite-state transducer.

Three transducers are compiled from the model file:

* the normaliser, which marks blanks, puts a mark in front and, where the model says so, squeezes blanks;
* the pieces, a prefix automaton whose final states bear a piece's id and weight;
* byte fallback, which takes a character outside the vocabulary to arcs for each of its UTF-8 bytes.

Composed with an input, their states are (position, last piece), and the ids are read off the shortest
path in the tropical semiring (min, +). For a unigram model an arc weighs minus the piece's score. A BPE
model's result is not the path of least score: it is the one path on which every two neighbouring pieces
are what merging their own characters gives, leftmost first where scores are equal. That condition is an
acceptor over pairs of pieces; pairs that fail it have infinite weight, all other arcs weigh 1, so the
shortest path is exactly the merge result, also in runs of blanks.

No piece holds a blank mark behind another character, so paths are found chunk by chunk: new short
chunks of many texts at once, as arrays, and long ones by themselves. Every Python worker keeps the ids
of short chunks it has seen in a bounded table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .tokens import LIMIT, LONGEST, assemble, gather, parts, slices, vocabulary

MARK = "\u2581"
FALLBACK = 1000.0
PAIRS = 1_000_000
#: Chunks that are composed together.
TOGETHER = 20_000
_RUN = re.compile(" |[^ ]+")
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


class Normaliser:
    """Sequential transducer: ``arcs[state, is blank]`` gives output, whether the input follows it, and the next state.

    ``FIRST`` is the state before any output, ``HELD`` the one after blanks that are dropped at the end
    of the text. As other characters than blanks loop in ``BODY``, a run of them is taken in one step.
    """

    FIRST, BODY, HELD = range(3)

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        mark = MARK if escape else " "
        front = mark if prefix else ""
        first, body, held = self.FIRST, self.BODY, self.HELD
        self.arcs = {(body, False): ("", True, body)}
        if squeeze:
            self.arcs |= {(first, True): ("", False, first), (first, False): (front, True, body), (body, True): ("", False, held), (held, True): ("", False, held), (held, False): (mark, True, body)}
        else:
            self.arcs |= {(first, True): (front + mark, False, body), (first, False): (front, True, body), (body, True): (mark, False, body)}

    def __call__(self, text: str, state: int = FIRST) -> str:
        out, arcs = [], self.arcs
        for run in _RUN.findall(text):
            put, copy, state = arcs[state, run == " "]
            out.append(put + run if copy else put)
        return "".join(out)


class Transducer:
    """Compiled model; ``encode_all`` gives ids of texts and their counts, ``decode`` a text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only normalisation without a character map and with prefix marks is supported")
        self.prefix = spec.add_dummy_prefix
        self.normalise = Normaliser(spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.merges = model.trainer_spec.model_type == pb.TrainerSpec.BPE
        kind = pb.ModelProto.SentencePiece
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [0] * 256
        self.spelt: list[bytes] = []
        self.unknown = 0
        for i, p in enumerate(model.pieces):
            raw = p.piece.replace(MARK, " ").encode()
            if p.type in (kind.NORMAL, kind.USER_DEFINED):
                self.ids[p.piece], self.score[p.piece] = i, p.score
            elif p.type == kind.BYTE:
                raw = bytes([int(p.piece[1:-1], 16)])
                self.bytes[raw[0]] = i
            elif p.type == kind.UNKNOWN:
                self.unknown, raw = i, " \u2047 ".encode()
            else:
                raw = b""
            self.spelt.append(raw)
        self.size = len(model.pieces)
        self.fallback = model.trainer_spec.byte_fallback
        if self.merges:  # pieces that merging never yields have no arc
            self.arcs = {p: 1.0 for p in self.ids if len(p) == 1 or self.merge(p) == [p]}
        else:
            self.arcs = {p: -s for p, s in self.score.items()}
        self.piece = {i: p for p, i in self.ids.items()}
        plain = self.prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        self.chunked = plain and not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids)
        self.seen: dict[str, bytes] = {}  # ids of normalised chunks, and of parts between blanks
        self.parts: dict[str, bytes] = {}
        self.pairs = np.zeros(0, np.int64)  # codes of pairs that were checked, in order, and whether they stand
        self.stands = np.zeros(0, bool)
        self._compile()

    def _compile(self) -> None:
        """The prefix automaton: sorted (state, character) keys, next states, and ids and weights of final states."""
        state = {"": 0}
        for p in self.arcs:
            for k in range(1, len(p) + 1):
                state.setdefault(p[:k], len(state))
        keys = np.array([(state[p[:-1]] << 21) + ord(p[-1]) for p in state if p], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array([n for p, n in state.items() if p])[order]
        self.final = np.full(len(state), -1)
        self.weight = np.zeros(self.size + 1)
        for p, w in self.arcs.items():
            self.final[state[p]] = self.ids[p]
            self.weight[self.ids[p]] = w
        self.single = np.sort(np.array([ord(p) for p in self.ids if len(p) == 1]))
        self.state = state

    def merge(self, s: str) -> list[str]:
        """BPE by definition: again and again the best pair, leftmost first."""
        parts, score = list(s), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair acceptor, for ids of pieces; whatever is outside the vocabulary goes with anything."""
        code = a * self.size + b
        inside = (a < self.size) & (b < self.size)
        if len(self.pairs) > PAIRS:
            self.pairs, self.stands = self.pairs[:0], self.stands[:0]
        want = np.unique(code[inside])
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
            want = want[self.pairs[at] != want]
        if len(want):
            piece, new = self.piece, []
            for c in want.tolist():
                x, y = piece[c // self.size], piece[c % self.size]
                new.append(self.merge(x + y) == [x, y])
            at = np.searchsorted(self.pairs, want)
            self.pairs, self.stands = np.insert(self.pairs, at, want), np.insert(self.stands, at, new)
        ok = np.ones(len(code), bool)
        ok[inside] = self.stands[np.searchsorted(self.pairs, code[inside])]
        return ok

    def compose(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Arcs of all three transducers over normalised ``chunks`` in a row: from, to, label, characters of labels past the vocabulary."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        end = np.repeat(np.cumsum(size), size)
        start, state, to = np.arange(len(code)), np.zeros(len(code), np.int64), np.arange(len(code))
        found = []
        while len(start):
            here = to < end[start]
            start, state, to = start[here], state[here], to[here]
            key = (state << 21) + code[to]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            here = self.keys[at] == key
            start, state, to = start[here], self.next[at[here]], to[here] + 1
            label = self.final[state]
            is_final = label >= 0
            found.append((start[is_final], to[is_final], label[is_final]))
        at = np.minimum(np.searchsorted(self.single, code), len(self.single) - 1)
        lone = np.flatnonzero(self.single[at] != code)
        other, label = np.unique(code[lone], return_inverse=True)
        found.append((lone, lone + 1, self.size + label))
        return (*(np.concatenate(x) for x in zip(*found, strict=True)), [chr(c) for c in other.tolist()])

    def spell(self, c: str) -> list[int]:
        """Labels of the byte arcs of a character outside the vocabulary."""
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]

    def shortest(self, chunks: list[str]) -> list[bytes]:
        """Ids along the shortest path of each of the normalised ``chunks``, none of them empty.

        Goes over positions within chunks, all chunks at once.
        """
        left, right, label, others = self.compose(chunks)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        first = np.cumsum(size) - size
        chunk = np.repeat(np.arange(len(chunks)), size)[left]
        order = np.lexsort((left, left - first[chunk]))
        left, right, label, chunk = left[order], right[order], label[order], chunk[order]
        own = np.where(label < self.size, self.weight[np.minimum(label, self.size)], FALLBACK)
        begin, stop = left - first[chunk], right - first[chunk]
        total, back = np.where(begin == 0, own, np.inf), np.full(len(left), -1)
        by_end = np.lexsort((right, stop))
        most = int(size.max())
        starts = np.searchsorted(begin, np.arange(most + 1))
        ends = np.searchsorted(stop[by_end], np.arange(most + 2))
        for j in range(1, most):
            here = np.arange(starts[j], starts[j + 1])
            prev = by_end[ends[j] : ends[j + 1]]
            prev = prev[total[prev] < np.inf]
            if not self.merges:
                prev = _least(prev, right[prev], total[prev])
            lo, hi = np.searchsorted(right[prev], left[here], "left"), np.searchsorted(right[prev], left[here], "right")
            here, lo, n = here[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(here):
                continue
            to = np.repeat(here, n)
            by = prev[np.arange(len(to)) + np.repeat(lo - np.cumsum(n) + n, n)]
            cost = total[by] + own[to]
            if self.merges:
                ok = self.follow(label[by], label[to])
                to, by, cost = to[ok], by[ok], cost[ok]
            best = _least(np.arange(len(to)), to, cost)
            total[to[best]], back[to[best]] = cost[best], by[best]
        last = by_end[(stop == size[chunk])[by_end] & (total[by_end] < np.inf)]
        last = last[np.argsort(chunk[last], kind="stable")]
        at = _least(last, chunk[last], total[last])
        steps = []
        while len(at):
            steps.append(at)
            at = back[at]
            at = at[at >= 0]
        path = np.concatenate(steps[::-1])
        path = path[np.argsort(chunk[path], kind="stable")]
        spelt = [self.spell(c) for c in others]
        labels = np.r_[np.arange(self.size), np.array([i for x in spelt for i in x], np.int64)].astype("<u4")
        ids, at = gather(labels, np.r_[np.ones(self.size, np.int64), np.array([len(x) for x in spelt], np.int64)], label[path])
        cut = (4 * at[np.searchsorted(chunk[path], np.arange(len(chunks) + 1))]).tolist()
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(cut, cut[1:], strict=False)]

    def shortest_of_long(self, s: str) -> bytes:
        """The same for one long chunk, state by state."""
        n, arcs, prefixes, checked, ids = len(s), self.arcs, self.state, self.merges, self.ids
        stands: dict[tuple[str, str], bool] = {}
        states: list[dict[str, tuple]] = [{} for _ in range(n + 1)]  # last piece: (weight, previous piece, its end)
        states[0][""] = (0.0, None, 0)
        for i in range(n):
            here = states[i]
            if not here:
                continue
            if not checked:  # without pair weights one state for each position is enough
                here = dict([min(here.items(), key=lambda x: x[1][0])])
            for k in range(i + 1, n + 1):
                piece = s[i:k]
                if piece not in prefixes:
                    break
                weight = arcs.get(piece)
                if weight is None:
                    continue
                for last, (total, _, _) in here.items():
                    if last and checked and last in arcs:
                        ok = stands.get((last, piece))
                        if ok is None:
                            ok = stands[last, piece] = self.merge(last + piece) == [last, piece]
                        if not ok:
                            continue
                    old = states[k].get(piece)
                    if old is None or total + weight < old[0]:
                        states[k][piece] = (total + weight, last, i)
            if s[i] not in ids:
                last, (total, _, _) = min(here.items(), key=lambda x: x[1][0])
                states[i + 1][s[i]] = (total + FALLBACK, last, i)
        piece, at, out = min(states[n], key=lambda x: states[n][x][0]), n, []
        while at:
            out.append([ids[piece]] if piece in ids else self.spell(piece))
            _, last, start = states[at][piece]
            piece, at = last, start
        return np.array([i for x in out[::-1] for i in x], "<u4").tobytes()

    def _short(self, chunks: list[str]) -> list[bytes]:
        return [x for i in range(0, len(chunks), TOGETHER) for x in self.shortest(chunks[i : i + TOGETHER])]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit bytes."""
        s = self.normalise(text) if text else ""
        if not s:
            return b""
        chunks = _CHUNK.findall(s) if self.chunked else [s]
        new = {c for c in chunks if c not in self.seen}
        extra = {c: self.shortest_of_long(c) for c in new if len(c) > LONGEST}
        short = [c for c in new if len(c) <= LONGEST]
        self.seen.update(zip(short, self._short(short), strict=True))
        return b"".join([self.seen[c] if c in self.seen else extra[c] for c in chunks])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the number of each; null counts as empty."""
        texts = pc.fill_null(texts, "")
        for known in (self.seen, self.parts):
            if len(known) >= LIMIT:
                known.clear()
        if not self.chunked or not len(texts):
            found = [self.encode(t.as_py()) for t in texts]
            return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)
        # a mark in a text is like a blank; a line feed starts a part, without a mark
        which, bounds, found = parts(pc.replace_substring(pc.replace_substring(texts, MARK, " "), "\n", " \n"))
        new = [c for c in found if c and c not in self.parts]
        body = self.normalise.BODY
        keys = [self.normalise(c if c[0] == "\n" else f" {c}", body) for c in new]
        short = [i for i, c in enumerate(keys) if len(c) <= LONGEST]
        self.parts.update(zip([new[i] for i in short], self._short([keys[i] for i in short]), strict=True))
        extra = {c: self.shortest_of_long(k) for c, k in zip(new, keys, strict=True) if len(k) > LONGEST}
        pieces = [self.parts[c] if c in self.parts else extra.get(c, b"") for c in found]
        # runs of blanks and blanks at either end give empty parts: such texts are cut with care
        odd = np.logical_or.reduceat(np.array([not c for c in found])[which], bounds[:-1])
        whole = {i: self.encode(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        return assemble(which, bounds, pieces, whole)

    def decode(self, ids: np.ndarray) -> str:
        spelt = self.spelt
        text = b"".join([spelt[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


def _least(items: np.ndarray, group: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The first of the cheapest ``items`` of each run of equal ``group``."""
    if not len(items):
        return items
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[start, len(items)])
    cheap = np.flatnonzero(cost == np.repeat(np.minimum.reduceat(cost, start), n))
    return items[cheap[np.unique(np.repeat(np.arange(len(start)), n)[cheap], return_index=True)[1]]]


_machines: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for each Python worker and model file."""
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def encode(docs: DataFrame, model: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """All columns of ``docs``, then ``ids array<int>`` and ``ids_crc32 long`` of the whole text.

    Null and empty texts give no ids. Columns already named like a result make way for it. No exchange:
    rows may be of any number, repeated, or none. With ``decoded``, a column of that name holds the text
    that the ids decode to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for b in slices(batch, at):
                ids, counts = machine.encode_all(b.column(at))
                ends = np.r_[0, np.cumsum(counts)]
                each = [ids[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                columns = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view(np.int32))), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                if decoded:
                    columns.append(pa.array([machine.decode(x) for x in each], pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, "ids", "ids_crc32", *([decoded] if decoded else [])])

    rows = docs.drop("ids", "ids_crc32", *([decoded] if decoded else []))
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_crc32", T.LongType())]
    return rows.mapInArrow(run, T.StructType(rows.schema.fields + fields + ([T.StructField(decoded, T.StringType())] if decoded else [])))


def decode(encoded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``encoded``, then the text of ``ids`` as ``out``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [machine.decode(x.values.to_numpy()) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    rows = encoded.drop(out)
    return rows.mapInArrow(run, T.StructType(rows.schema.fields + [T.StructField(out, T.StringType())]))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back.

    Null and empty texts give no ids; repeated rows are kept; an empty table gives no row; other columns
    are ignored.
    """
    model = vocabulary("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = encode(docs, model, decoded="decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", (F.col("decoded") == F.col("text")).alias("round_trip"), "ids")
