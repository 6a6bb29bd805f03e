"""Fast exact encoding with the public tokenizers.

Both tokenizers split a text at white space before merging, so the ids of a text are the ids of its
chunks in a row. Each Python worker keeps the ids of chunks it has seen in a bounded table and asks the
library only for new ones; the result is that of encoding the whole text with
``add_special_tokens=False``. As the library does, a special token spelt out in a text becomes that
token: such texts are given to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the tokenizers' own patterns see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
LIMIT = 500_000
#: Bytes of text encoded together, so that their new chunks share calls.
SLICE = 2 << 20
LONGEST = 64
#: Chunks in a joined call of the library.
JOINED = 50
#: Divides chunks of a joined call; chunks that hold it are encoded by themselves.
_BAR = "\x01"
#: Marks that never share a piece with a letter beside them; the apostrophe does.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: Letters that stay one letter when normalised, whatever stands beside them.
_LETTERS = frozenset(c for c in map(chr, range(256)) if c.isalpha() and c.lower() != c or "a" <= c <= "z" or "\xdf" <= c <= "\xff" and c.isalpha())


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE, rows: int = 4000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and about ``size`` bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts split at each blank: numbers of the parts, first part of each text (and the end), distinct parts."""
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def gather(table: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs ``which`` of ``table``, of which ``size`` gives the lengths, one after the other; and where each begins (and the end)."""
    start = np.cumsum(size) - size
    at = np.r_[0, np.cumsum(size[which])]
    return table[np.arange(int(at[-1])) + np.repeat(start[which] - at[:-1], size[which])], at


def assemble(which: np.ndarray, bounds: np.ndarray, pieces: list[bytes], whole: dict[int, bytes], front: list[bytes] | None = None, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts from the ids of their parts, and their counts.

    ``front`` goes before and ``end`` behind the parts of each text; texts in ``whole`` have its ids instead of front and parts.
    """
    n, none = len(bounds) - 1, len(pieces)
    pieces = [*pieces, b"", end]
    fronts = np.full(n, none)
    if front is not None:
        fronts = len(pieces) + np.arange(n)
        pieces += front
    for i, ids in whole.items():
        which[bounds[i] : bounds[i + 1]] = none
        fronts[i] = len(pieces)
        pieces.append(ids)
    which = np.insert(which, np.r_[bounds[1:], bounds[:-1]], np.r_[np.full(n, none + 1), fronts])
    size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    ids, at = gather(np.frombuffer(b"".join(pieces), "<u4"), size, which)
    return ids, np.diff(at[np.r_[bounds[:-1] + 2 * np.arange(n), len(which)]])


class Encoder:
    """``encode(texts, end)`` gives the ids of whole texts, each followed by ``end``, and their counts; null counts as empty.

    Distinct chunks of a call are looked up once. New ones are encoded in joined groups and cut apart
    again: a byte-level chunk starts at its blank or line feed, a word ends with its own kind of piece,
    and other chunks of words are divided by a bar.
    """

    def __init__(self, path: str, words: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = words
        self.seen: dict[str, bytes] = {}  # the latest chunks, and those before them
        self.older: dict[str, bytes] = {}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.starts, self.ends = np.zeros((2, max(vocab.values()) + 1), bool)
        if words:
            (bar,) = self.tokenizer.encode(_BAR, add_special_tokens=False).ids
            self.starts[bar] = True
            self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        else:
            self.starts[[i for t, i in vocab.items() if t[0] in "ĠĊ"]] = True

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelt(self, chunk: str) -> str:
        return chunk if self.words or chunk[:1] == "\n" else f" {chunk}"

    def _learn(self, chunks: list[str], plain: bool) -> None:
        """Ids of ``chunks``; ``plain``: words of letters only."""
        groups = [chunks[i : i + JOINED] for i in range(0, len(chunks), JOINED)]
        bar = self.words and not plain
        joined = [" ".join(g) if plain else "".join(f" {_BAR} {c}" if bar else self._spelt(c) for c in g) for g in groups]
        for group, ids in zip(groups, self._ids(joined), strict=True):
            at = np.flatnonzero(self.ends[ids]) + 1 if plain else np.flatnonzero(self.starts[ids])
            if len(at) != len(group):  # a chunk that looks like several
                for c, x in zip(group, self._ids([self._spelt(c) for c in group]), strict=True):
                    self.seen[c] = x.tobytes()
                continue
            raw, at = ids.tobytes(), (4 * at).tolist()
            first, last = ([0, *at[:-1]], at) if plain else (at, [*at[1:], len(raw)])
            skip = 4 * bar
            for c, i, j in zip(group, first, last, strict=True):
                self.seen[c] = raw[i + skip : j]

    def _learn_words(self, chunks: list[str]) -> None:
        """Ids of chunks of words: a word amid marks has the ids of marks, word and marks, as the library parts them."""
        seen, amid, plain, others, marks = self.seen, [], [], [], {""}
        for c in chunks:
            if c.isalpha():
                plain.append(c)
                continue
            word = c.strip(_MARKS)
            if word.isalpha() and word[0] in _LETTERS and word[-1] in _LETTERS:
                before, _, behind = c.partition(word)
                amid.append((c, before, word, behind))
                marks.add(before)
                marks.add(behind)
            else:
                others.append(c)
        words = {w for _, _, w, _ in amid}.difference(plain)
        self._learn(plain + [w for w in words if w not in seen], True)
        self._learn(others + [x for x in marks.difference(others) if x and x not in seen], False)
        seen[""] = b""
        for c, before, word, behind in amid:
            seen[c] = seen[before] + seen[word] + seen[behind]

    def _whole(self, text: str) -> bytes:
        """A text that chunks by blanks and line feeds don't fit."""
        if self.words or any(t in text for t in self.special):
            return self._ids([text])[0].tobytes()
        return b"".join(x.tobytes() for x in self._ids(_CHUNK.findall(text)))

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        even = pc.replace_substring(pc.ascii_lower(texts), "\n", " ") if self.words else pc.replace_substring(texts, "\n", " \n")
        which, bounds, chunks = parts(even)
        whole = pc.match_substring(even, "<|").to_numpy(zero_copy_only=False) if any("<|" in t for t in self.special) else np.zeros(len(texts), bool)
        if len(self.seen) >= LIMIT // 2:
            self.seen, self.older = {}, self.seen
        pieces = list(map(self.seen.get, chunks))
        missing = [i for i, x in enumerate(pieces) if x is None]
        new = [chunks[i] for i in missing]
        if self.older:
            self.seen.update((c, self.older[c]) for c in new if c in self.older)
            new = [c for c in new if c not in self.seen]
        odd: set[str] = set()
        if self.words:
            extra = [c for c in new if len(c) > LONGEST or _BAR in c]
            new = [c for c in new if c and len(c) <= LONGEST and _BAR not in c]
            self._learn_words(new)
            self.seen[""] = b""
        else:
            odd = {c for c in new if not (x := c[1:] if c[:1] == "\n" else c) or x[0].isspace() or x[-1].isspace()}
            extra = [c for c in new if len(c) > LONGEST and c not in odd]
            self._learn([c for c in new if len(c) <= LONGEST and c not in odd], False)
        for c in extra:
            self.seen[c] = self._ids([self._spelt(c)])[0].tobytes()
        for i in missing:
            pieces[i] = self.seen.get(chunks[i], b"")
        for c in extra:
            del self.seen[c]
        pieces.append(b"")
        # the part in front of the first blank has none of its own
        heads = [] if self.words else [chunks[i] for i in which[bounds[:-1]].tolist()]
        if not self.words:
            which[bounds[:-1]] = len(pieces) - 1
        if odd:
            bad = np.array([c in odd for c in chunks] + [False])[which]
            whole = whole | np.logical_or.reduceat(bad, bounds[:-1])
        alone = {i: self._whole(texts[i].as_py()) for i in np.flatnonzero(whole).tolist()}
        return assemble(which, bounds, pieces, alone, None if self.words else [x.tobytes() for x in self._ids(heads)], b"" if end is None else end.to_bytes(4, "little"))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, words: bool = False) -> Encoder:
    """One encoder for each Python worker, file and kind."""
    if (path, words) not in _encoders:
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; it must be at the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
