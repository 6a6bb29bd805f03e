"""Hard negatives of anchors by bounds along a spanning tree of the anchors.

Vectors are cut to integers, so that every score is an exact integer. Anchors are dealt into blocks, and a
minimum spanning tree is laid through each. A task takes the tree of one block and one block of candidates:

* At the root all candidates are scored.
* At a child, the parent's score (or its bounds, where it was not computed) plus and minus the length of the
  edge times the candidate's norm bounds the child's score, by Cauchy and Schwarz.
* Only candidates whose bounds overlap what the child still looks for are scored anew: for positives the
  scores that enter its best few, for negatives the windows of its positives, above the worst of those kept.

Each task gives the few best for each anchor (and positive); Spark ranks these over all tasks, dropping all
but the best of each task before the shuffle. Anchors grow with the table and are never collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, ship, table

ANCHORS, CANDIDATES = 512, 4096
CHUNK = 1024
LONG = (1 << 63) - 1
_FOUND = "a long, j int, vec_id long, row long, score long"


def spanning_tree(x: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """Minimum spanning tree of the rows of ``x``: ``(order, parent, edge)``, parents before children; the first has parent -1."""
    n = len(x)
    order, parent, edge = [0], [-1] * n, np.zeros(n)
    near, of, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    for _ in range(n - 1):
        with np.errstate(over="ignore", invalid="ignore"):
            d = np.nan_to_num(np.sqrt(((x - x[order[-1]]) ** 2).sum(axis=1)), nan=np.inf)
        closer = left & (d < near)
        near[closer], of[closer] = d[closer], order[-1]
        v = int(np.flatnonzero(left)[np.argmin(near[left])])
        order.append(v)
        parent[v], edge[v], left[v] = int(of[v]), near[v], False
    return order, parent, edge


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(len(column), -1)


def _tree(part: pa.Table) -> pa.Table:
    """Anchors of a block in tree order, with ``at``, ``parent`` (a place in that order) and ``edge``."""
    part = part.sort_by("row")
    order, parent, edge = spanning_tree(_matrix(part["q"]))
    place = np.argsort(order)
    up = [-1 if parent[v] < 0 else int(place[parent[v]]) for v in order]
    part = part.take(pa.array(order))
    return part.append_column("at", pa.array(np.arange(len(order)), pa.int32())).append_column("parent", pa.array(up, pa.int32())).append_column("edge", pa.array(edge[order]))


def scorer(anchors: np.ndarray, rows: np.ndarray) -> Callable[[int, np.ndarray | slice], np.ndarray]:
    """Exact integer scores of an anchor with some rows; beyond the long range the ends of that range.

    Sums under 2^52 are exact in floats in any order; larger ones are taken in Python integers.
    """
    with np.errstate(over="ignore"):
        largest = max(np.abs(anchors).max(initial=0), 1.0) * max(np.abs(rows).max(initial=0), 1.0) * max(anchors.shape[1], 1)
    if largest < 2**52:
        return lambda v, at: (rows[at] @ anchors[v]).astype(np.int64)
    whole = [[int(c) for c in x] for x in rows]
    own = [[int(c) for c in x] for x in anchors]
    number = np.arange(len(rows))
    return lambda v, at: np.array([max(-LONG - 1, min(LONG, sum(map(int.__mul__, own[v], whole[i])))) for i in number[at].tolist()], np.int64)


class _Best:
    """The first ``k`` rows by score, then smaller id, then row."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((3, 0), np.int64)

    @property
    def least(self) -> float:
        return float(-self.rows[0, -1]) if self.rows.shape[1] == self.k else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if len(score):
            all_ = np.concatenate([self.rows, np.stack([-score.clip(-LONG), ids, row])], axis=1)
            self.rows = all_[:, np.lexsort(all_[::-1])[: self.k]]


def windows(positive: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Least and greatest integer n with ``low * p <= 100 * n <= high * p`` for each p."""
    return [(-(-low * p // 100), high * p // 100) for p in positive]


def _search(k: int, low: int, high: int, stats: list | None = None):
    """Tree of anchors x candidates. Anchors without a list ``ps`` look for positives, others for negatives in the windows of ``ps``."""

    def run(tree: pa.Table, rows: pa.Table) -> pa.Table:
        tree = tree.sort_by("at")
        a, x = _matrix(tree["q"]), _matrix(rows["q"]) if len(rows) else np.zeros((0, 0))
        n = len(a) if len(rows) else 0
        seeks = tree["ps"].to_pylist() if "ps" in tree.column_names else None
        spans = [windows(p or [], low, high) for p in seeks] if seeks else [[(-LONG - 1, LONG)]] * n
        best = [[_Best(k) for _ in s] for s in spans]
        own, label_a, parent, edge = (tree[c].to_numpy() for c in ("row", "label", "parent", "edge"))
        ids, row, label = (rows[c].to_numpy() for c in ("vec_id", "row", "label"))
        for start in range(0, len(rows) if n else 0, CHUNK):
            part = slice(start, start + CHUNK)
            chunk, ids_, row_, label_ = x[part], ids[part], row[part], label[part]
            score = scorer(a, chunk)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt((chunk**2).sum(axis=1))
                lo, hi = np.empty((n, len(chunk))), np.empty((n, len(chunk)))
                for v in range(n):
                    p = parent[v]
                    if p < 0:
                        lo[v], hi[v] = -np.inf, np.inf
                    else:
                        r = np.nan_to_num(edge[v] * norm * (1 + 1e-9) + np.abs(lo[p]) * 1e-12 + 0.5, nan=np.inf, posinf=np.inf)
                        lo[v], hi[v] = lo[p] - r, hi[p] + r
                    same = label_ == label_a[v]
                    open_ = same & (row_ != own[v]) if seeks is None else ~same
                    want = np.zeros(len(chunk), bool)
                    for (least, most), b in zip(spans[v], best[v], strict=True):
                        if least <= most:
                            want |= (hi[v] >= max(least, b.least)) & (lo[v] <= most)
                    want = want & open_ if p >= 0 else np.ones(len(chunk), bool)
                    at = slice(None) if 2 * want.sum() > len(want) else np.flatnonzero(want)
                    s = score(v, at)
                    lo[v, at] = hi[v, at] = s
                    if stats is not None:
                        stats.append((len(s), len(chunk)))
                    for (least, most), b in zip(spans[v], best[v], strict=True):
                        ok = open_[at] & (s >= least) & (s <= most) & (s >= b.least)
                        b.add(s[ok], ids_[at][ok], row_[at][ok])
        out = [(np.full(b.rows.shape[1], own[v]), np.full(b.rows.shape[1], j, np.int32), b.rows[1], b.rows[2], -b.rows[0]) for v in range(n) for j, b in enumerate(best[v])]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(np.concatenate([o[i] for o in out]) if out else [], t) for i, t in enumerate(types)], names=["a", "j", "vec_id", "row", "score"])

    return run


def quantised(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """``row, vec_id, label, dim, q``: floor of ``scale`` times each component, as whole doubles; rows that take no part go."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.transform(F.col(embedding).cast("array<double>"), lambda x: x * scale).alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("x", lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x).cast("double")).otherwise(x))  # larger doubles are whole
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(fine)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("x").alias("dim"), q.alias("q"))


def _dealt(row: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(row), F.col(blocks)).cast("int")


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", anchors: int = ANCHORS, candidates: int = CANDIDATES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of every anchor.

    Anchors are the rows whose id is divisible by ``every``. Their positives are the first ``positives`` other
    rows of the same label by score, then smaller id; for each, the first ``negatives`` rows of other labels
    with ``low * positive <= 100 * score <= high * positive`` are returned.

    Rows with a null id, label or vector, or a component that is null or not finite (also after scaling), take
    no part. Vectors of different lengths have no score. Rows that repeat an id count as rows of their own, so
    a repeated anchor's results repeat. Scores beyond the long range are the ends of that range. Anchors
    without positives, or without negatives in the window, give no row; so does an empty table. Other columns
    are ignored. ``anchors`` and ``candidates`` bound the blocks of a task, not the results.
    """
    ship(vectors.sparkSession)
    rows = materialise(quantised(vectors, vec_id, embedding, label, scale), "quantised")  # written once, so the numbers stay
    is_anchor = F.col("vec_id") % every == 0
    blocks = rows.groupBy("dim").agg(F.ceil(F.count_if(is_anchor) / anchors).cast("int").alias("gs"), F.ceil(F.count("*") / candidates).cast("int").alias("cs")).where("gs > 0")
    blocks = materialise(blocks, "blocks")  # a row for each length of vectors
    over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = rows.where(is_anchor).join(blocks, "dim").select("row", "vec_id", "label", "dim", "q", "cs", _dealt("row", "gs").alias("g"))
    shape = "row long, vec_id long, label long, dim int, q array<double>, cs int, g int, at int, parent int, edge double"
    trees = materialise(mine.groupBy("dim", "g").applyInArrow(_tree, shape), "trees")
    grid = ["dim", "g", "c"]
    dealt = rows.join(blocks, "dim").select("row", "vec_id", "label", "dim", "q", _dealt("row", "cs").alias("c"), over("gs").alias("g")).groupBy(*grid)
    spread = lambda t: t.select("row", "label", "q", "at", "parent", "edge", "dim", "g", *(c for c in t.columns if c == "ps"), over("cs").alias("c")).groupBy(*grid)
    found = spread(trees).cogroup(dealt).applyInArrow(_search(positives, low, high), _FOUND)
    pairs = _ranked(found, positives, "a").join(trees.select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id")), "a")
    pairs = materialise(pairs.select("a", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("j")), "positives")
    scores = pairs.groupBy("a").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "positive_score"))), lambda x: x["positive_score"]).alias("ps"))
    seeking = trees.join(scores.withColumnRenamed("a", "row"), "row", "left")
    found = spread(seeking).cogroup(dealt).applyInArrow(_search(negatives, low, high), _FOUND)
    best = _ranked(found, negatives, "a", "j").select("a", "j", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return best.join(pairs, ["a", "j"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every hundredth vector against all vectors, labels of ids divisible by 7 moved on by one; odd rows as in :func:`hard_negatives`."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


OP13_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 10
"""
