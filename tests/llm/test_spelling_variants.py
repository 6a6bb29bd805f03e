"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from rollbook.llm import spelling_variants

WORDS = "word string, n long"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, ratio=5):
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, vs in links.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None
    out = set()
    for w, f in form.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, f, root, words[w], len(links[w]), words[f] if f else None))
    return out


def vocabulary(n, letters, longest, seed=1):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(1, longest))): rng.choice((5, 6, 30, 31, 200, 1000, 5001)) for _ in range(n)}


@pytest.mark.parametrize("letters", [1, 60, 40_000])
@pytest.mark.parametrize("words", [vocabulary(300, "abé", 7), vocabulary(150, "abcdefgÿ", 4) | {"hub" + w: n for w, n in vocabulary(200, "xy", 6).items()}], ids=["short", "hub"])
def test_variants(spark, words, letters):
    """Whatever states are opened, each pair is found once."""
    got = spelling_variants.variants(spark.createDataFrame(list(words.items()), WORDS), letters=letters).collect()
    assert len(got) == len(words) and set(map(tuple, got)) == brute(words)


def test_chains_and_long_words(spark):
    words = {"a" * i: 5**i for i in range(1, 12)} | {"z" * 30_000: 7, "z" * 30_001: 900, "z" * 29_999 + "y": 5}
    for letters in (5, 40_000):
        got = spelling_variants.variants(spark.createDataFrame(list(words.items()), WORDS), letters=letters)
        assert set(map(tuple, got.collect())) == brute(words)


def test_no_words(spark):
    assert spelling_variants.variants(spark.createDataFrame([], WORDS)).collect() == []
    assert spelling_variants.near_words(spark.createDataFrame([("abc", 5)], WORDS)).collect() == []


def test_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 3)
    rng = random.Random(4)
    pool = ["Wörter", "wörter", "WÖRTER", "häuser×", "letters", "straße", "ünïcödé", "naïveté", "abc", "longer", "ÀÉÎÕÜÿ"]
    rows = [(i, " ".join(rng.choices(pool, k=40)) + "Ātail-of_run9here", "x") for i in range(60)] + [(None, "letters letters", "x"), (7, None, "x"), (8, "", "x"), (9, "letters", "x"), (9, "letters", "x")]
    want = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            want[run[:at] + run[at + 1 :] if h % 7 == 0 else run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}
    got = spelling_variants.word_counts(spark.createDataFrame(rows, "doc_id long, text string, word string"), every=7)
    assert {tuple(r) for r in got.collect()} == set(want.items()) and len(want) > 8
    assert spelling_variants.word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in ("x", "yy", "") for b in "abc" for c in ("ing", "ed", ""))
    arcs, final = spelling_variants.acceptor(words)
    found, seen, stack = [], set(), [(0, "")]
    while stack:
        s, w = stack.pop()
        seen.add(s)
        found += [w] * final[s]
        stack += [(t, w + c) for c, t in arcs[s].items()]
    assert sorted(found) == words

    def language(s, memo={}):  # noqa: B006
        if s not in memo:
            memo[s] = frozenset([""] if final[s] else []) | frozenset(c + w for c, t in arcs[s].items() for w in language(t))
        return memo[s]

    assert len({language(s) for s in seen}) == len(seen)
