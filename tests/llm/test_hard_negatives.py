"""Hard negatives against brute force in Python integers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from rollbook.llm import hard_negatives

VEC = "vec_id long, embedding array<float>, label int"


def brute(rows, every=10, positives=5, negatives=10, low=30, high=90, scale=256):
    fine = []
    for i, (v, x, y) in enumerate(rows):
        if v is not None and y is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            fine.append((i, v, [math.floor(float(np.float32(c)) * scale) for c in x], y))
    out = []
    for i, v, q, y in fine:
        if v % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), u, j, z) for j, u, p, z in fine if j != i and len(p) == len(q))
        for s, u, _, _ in [r for r in scored if r[3] == y][:positives]:
            ok = [(w, t) for t, w, _, z in scored if z != y and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(v, u, k + 1, w, -s, -t) for k, (w, t) in enumerate(ok)]
    return sorted(out)


def topical(n, dim, seed=3):
    """Vectors near a few centres, so that bounds along the tree leave candidates out."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((4, dim)) * 3
    return [(i, (centres[i % 4] + rng.standard_normal(dim) * 0.05).astype(np.float32).tolist(), (i // 4) % 3) for i in range(n)]


def random_rows(n, dim, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, rng.standard_normal(dim).astype(np.float32).tolist(), i % 4) for i in range(n)]


@pytest.mark.parametrize("rows", [topical(240, 6), random_rows(240, 5)], ids=["topical", "random"])
@pytest.mark.parametrize("blocks", [(512, 4096), (7, 40)], ids=["one", "several"])
def test_hard_negatives(spark, rows, blocks, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 32)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, VEC), every=10, anchors=blocks[0], candidates=blocks[1])
    want = brute(rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(3)], i % 2) for i in range(40)]  # many ties
    rows += [(100, None, 1), (101, [1.0, None, 2.0], 0), (110, [float("nan"), 1.0, 1.0], 1), (120, [1.0, 1.0, float("inf")], 1), (130, [1.0, 2.0, 2.0], None), (None, [2.0, 2.0, 2.0], 1)]
    rows += [(140, [1.0, 2.0], 1), (141, [1.0, 2.5], 1), (142, [1.0, 1.0], 0), (150, [], 0), (160, [0.0, 0.0, 0.0], 1)]
    rows += [(10, [1.0, 1.0, 1.0], 0), (5, [1.0, 1.0, 1.0], 1), (5, [1.0, 1.0, 1.0], 1)]  # ids that repeat
    wide = spark.createDataFrame([(*r, "x", 1) for r in rows], VEC + ", q string, row int")
    assert sorted(map(tuple, hard_negatives.hard_negatives(wide, every=10).collect())) == brute(rows)


def test_no_rows(spark):
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VEC)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], VEC)).collect() == []
    assert hard_negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], VEC)).collect() == []


def test_scores_beyond_long(spark):
    rows = [(0, [3e30], 1), (1, [2e30], 1), (2, [1e12], 2), (3, [2e12], 2), (4, [-1.0], 1)]
    got = {tuple(r) for r in hard_negatives.hard_negatives(spark.createDataFrame(rows, VEC), low=0, high=100).collect()}
    top = (1 << 63) - 1
    assert {(0, 1, 1, 2, top, top), (0, 1, 2, 3, top, top)} == {r for r in got if r[1] == 1}


def test_spanning_tree_is_least():
    x = np.random.default_rng(2).standard_normal((40, 3))
    order, parent, edge = hard_negatives.spanning_tree(x)
    assert sorted(order) == list(range(40)) and parent[0] == -1
    place = {v: i for i, v in enumerate(order)}
    assert all(place[parent[v]] < place[v] and np.isclose(edge[v], np.linalg.norm(x[v] - x[parent[v]])) for v in order[1:])
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    pairs, root, total = sorted((d[i, j], i, j) for i in range(40) for j in range(i)), list(range(40)), 0.0
    for w, i, j in pairs:  # Kruskal
        if root[i] != root[j]:
            total += w
            root = [root[j] if r == root[i] else r for r in root]
    assert np.isclose(edge.sum(), total)


def test_bounds_leave_candidates_out(spark):
    rows, stats = topical(800, 6), []
    q = [[float(math.floor(c * 256)) for c in r[1]] for r in rows]
    t = pa.table({"row": list(range(800)), "vec_id": list(range(800)), "label": [r[2] for r in rows], "q": q})
    tree = hard_negatives._tree(t.take(list(range(0, 800, 10))))
    hard_negatives._search(5, 30, 90, stats)(tree, t)
    assert sum(s for s, _ in stats) < 0.6 * sum(n for _, n in stats)
