"""Near-duplicate vectors by iterative quantisation (ITQ) and multi-index Hamming tables.

* Rotations are learned on a bounded sample (about ``sample`` vectors and ``FLOATS`` components at most), each
  from a start of its own, so that the signs of the rotated, centred vectors are balanced binary codes.
* Each code is cut into substrings; each substring is the index of one table. Two vectors whose codes agree in
  the substring of any table meet in a bucket of it: with m tables every pair within m - 1 bits does.
* How wide substrings are, and how many tables there are, is measured: partners are planted at the wanted
  cosine around sampled vectors, in all directions and along those of the data, and tables are added until
  the wanted share of both kinds meets. So a common direction or topics in the data, which bring vectors
  closer than their codes, lead to more tables, never to fewer links. Of the widths that reach the recall the
  one is taken that costs least in copies and in chance meetings, which are measured on the sample too.
* Each bucket is reranked with the original vectors in double precision. A pair counts in the first table in
  which it meets, so candidates need no rows, and pairs that only share a bucket lead to nothing.

Lengths of vectors are laid out by themselves. Lengths that the sample hardly holds get random rotations
through the origin, whose bits differ by the angle alone. Equal vectors are one node with a weight. Pairs are
never rows: tasks give counts and spanning links. Buckets over ``bucket`` rows are compared block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, spread, table
from .components import components

SAMPLE, FLOATS = 20_000, 4_000_000
RECALL = 0.999
BUCKET = 2048
BITS = 64
#: Lengths up to which rotations are learned; longer vectors are folded to so many components first.
LONGEST = 4096
WIDTHS = (1, 2, 4, 6, 8, 10, 12, 14, 16, 20, 24, 28, 32)
#: Planted partners of each kind, most rotations, and chance meetings that cost as much as one more copy of a vector.
PLANTED, ROTATIONS, MEETINGS = 3000, 24, 50


def fit_rotation(vectors: np.ndarray, bits: int = BITS, rounds: int = 40, seed: int = 7, whiten: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimension x bits): principal directions, rotated by ITQ.

    With ``whiten`` all directions are scaled to the same spread first, so that bits don't follow a few strong
    ones, such as those between topics.
    """
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
    bits = min(bits, vectors.shape[1])
    x = vectors - mean
    _, spread_, v = np.linalg.svd(x.T @ x)
    p = v[:bits].T
    if whiten:
        p = p / np.sqrt(np.maximum(spread_[:bits], 1e-6 * max(float(spread_[0]), 1e-12)))
    r, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    z = x @ p
    for _ in range(rounds if len(vectors) else 0):
        a, _, b = np.linalg.svd(np.where(z @ r >= 0, 1.0, -1.0).T @ z)
        r = b.T @ a.T
    return mean, p @ r


def random_rotation(dim: int, bits: int = BITS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal random directions through the origin, for a length without a sample."""
    q, _ = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, min(bits, dim))))
    return np.zeros(dim), q


def fold(vectors: np.ndarray) -> np.ndarray:
    """Vectors of over ``LONGEST`` components as sums of these with random signs, which keep angles nearly as they were."""
    n, d = vectors.shape
    if d <= LONGEST:
        return vectors
    signed = np.zeros((n, -(-d // LONGEST) * LONGEST))
    signed[:, :d] = vectors * np.where(np.random.default_rng([7, d]).integers(0, 2, d) > 0, 1.0, -1.0)
    return signed.reshape(n, -1, LONGEST).sum(axis=1)


@dataclass
class Layout:
    """Rotations of one length of vectors, and the width of the substrings of their codes."""

    rotations: list[tuple[np.ndarray, np.ndarray]]
    width: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Substrings of the codes of unit vectors, a column for each table."""
        mask = np.uint64((1 << self.width) - 1)
        cut = [codes(unit, *r)[:, None] >> np.arange(0, whole_bits(r, self.width), self.width, dtype=np.uint64) & mask for r in self.rotations]
        return np.concatenate(cut, axis=1).astype(np.int64)


def codes(unit: np.ndarray, mean: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((unit - mean) @ p >= 0) @ (np.uint64(1) << np.arange(p.shape[1], dtype=np.uint64))


def whole_bits(rotation: tuple[np.ndarray, np.ndarray], width: int) -> int:
    """Bits of a code that whole substrings use."""
    return rotation[1].shape[1] // width * width


def agreements(differ: np.ndarray, bits: int, width: int) -> np.ndarray:
    """Number of substrings in which pairs of codes agree; ``differ`` holds the bits in which they don't."""
    mask = np.uint64((1 << width) - 1)
    return sum(((differ >> np.uint64(at)) & mask) == 0 for at in range(0, bits, width)) + np.zeros(len(differ), int)


def planted(unit: np.ndarray, least: float, rng: np.random.Generator, n: int = PLANTED) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs at cosine ``least`` around sampled vectors: parting in all directions, and along differences of sampled vectors."""
    out = []
    for along in (False, True):
        x = unit[rng.integers(0, len(unit), n)]
        z = unit[rng.integers(0, len(unit), n)] - unit[rng.integers(0, len(unit), n)] if along else rng.standard_normal(x.shape)
        z = z - (z * x).sum(axis=1, keepdims=True) * x
        size = np.linalg.norm(z, axis=1, keepdims=True)
        z = np.where(size > 1e-9, z / np.maximum(size, 1e-9), 0.0)
        out.append((x, least * x + np.sqrt(max(0.0, 1 - least**2)) * z))
    return out


def lay_out(unit: np.ndarray, labels: np.ndarray, rows: float, least: float, recall: float = RECALL, learn: bool = True, seed: int = 7, n: int = PLANTED) -> Layout:
    """Cheapest layout for ``rows`` vectors like the sampled ``unit`` ones that lets ``recall`` of the planted pairs meet; learned rotations with and without whitening are tried."""
    tried = [_search(unit, labels, rows, least, recall, rotation, seed, n) for rotation in ((fit_rotation, partial(fit_rotation, whiten=True)) if learn else (_through_origin,))]
    return min(tried, key=lambda x: x[0])[1]


def _through_origin(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return random_rotation(unit.shape[1], seed=seed)


def _search(unit: np.ndarray, labels: np.ndarray, rows: float, least: float, recall: float, rotation: Callable, seed: int, n: int) -> tuple[float, Layout]:
    """Cost and layout with one kind of rotation."""
    rng, dim = np.random.default_rng([seed, unit.shape[1]]), unit.shape[1]
    pairs = planted(unit, least, rng, n)
    i, j = rng.integers(0, len(unit), (2, 5 * n))
    i, j = i[i != j], j[i != j]
    same = labels[i] == labels[j]
    mates = rows * (same.mean() if len(same) else 1.0)  # vectors of a label that a vector can meet
    i, j = (i[same], j[same]) if same.any() else (i, j)
    widths = [w for w in WIDTHS if w <= min(BITS, dim)]
    hit = {w: [np.zeros(n, bool) for _ in pairs] for w in widths}
    tables, chance, rotations, best = dict.fromkeys(widths, 0), dict.fromkeys(widths, 0.0), [], None
    for turn in range(ROTATIONS):
        r = rotation(unit, seed=seed + turn)
        rotations.append(r)
        differ = [codes(a, *r) ^ codes(b, *r) for a, b in pairs]
        apart = codes(unit, *r)
        apart = apart[i] ^ apart[j]
        for w in list(widths):
            bits = whole_bits(r, w)
            for h, x in zip(hit[w], differ, strict=True):
                h |= agreements(x, bits, w) > 0
            chance[w] += float(agreements(apart, bits, w).mean()) if len(i) else 0.0
            tables[w] += r[1].shape[1] // w
            cost = MEETINGS * tables[w] + mates * chance[w]
            if min(h.mean() for h in hit[w]) >= recall and (best is None or cost < best[0]):
                best = cost, w, turn + 1
            if min(h.mean() for h in hit[w]) >= recall or (best is not None and cost >= best[0]):
                widths.remove(w)
        if not widths:
            break
    if best is None:  # the narrowest substrings nearly always meet
        return float("inf"), Layout(rotations, 1)
    return best[0], Layout(rotations[: best[2]], best[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # squares of large or tiny floats stay finite and above zero
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def unsampled(dim: int, rows: int, least: float, recall: float) -> Layout:
    """Layout for a length without a sample: random rotations, measured on random vectors."""
    some = _unit(np.random.default_rng([11, dim]).standard_normal((256, dim)))
    return lay_out(some, np.zeros(len(some), int), rows, least, recall, learn=False, n=1000)


def _keyed(layouts: dict[int, Layout], least: float, recall: float):
    """Substrings of all tables of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(layouts)
        for b in batches:
            dim, count = b.column(2).to_numpy(), b.column(3).to_numpy()
            keys: list = [None] * b.num_rows
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                short = min(d, LONGEST)
                if d not in own:
                    own[d] = unsampled(short, int(count[at[0]]), least, recall)
                x = _unit(fold(_unit(np.asarray(b.column(1).take(pa.array(at)).flatten(), float).reshape(-1, d))))
                for i, k in zip(at.tolist(), own[d].keys(x), strict=True):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.list_(pa.int64()))], names=["id", "keys"])

    return run


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            parent[p] = q
            out.append((x, y))
    return out


class _Found:
    """Spanning links, and ``(id, id, n)`` for the links of each vector."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    def add(self, ids: np.ndarray, weight: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
        if len(p):
            n = np.bincount(p, weight[q], len(ids)) + np.bincount(q, weight[p], len(ids))
            at = np.flatnonzero(n)
            tree = np.array(_forest(ids[p], ids[q]), np.int64).reshape(-1, 2)
            self.parts += [np.column_stack([tree, np.zeros(len(tree), np.int64)]), np.column_stack([ids[at], ids[at], n[at].astype(np.int64)])]

    def batch(self) -> pa.RecordBatch:
        rows = np.concatenate(self.parts) if self.parts else np.zeros((0, 3), np.int64)
        self.parts = []
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in rows.T], names=["a", "b", "n"])


def rerank(x: np.ndarray, keys: np.ndarray, t: int, left: np.ndarray, right: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs between ``left`` and ``right`` (None: within ``left``) at cosine ``least`` that meet in table ``t`` first."""
    ok = x[left] @ x[left if right is None else right].T >= least
    if right is None:
        ok = np.triu(ok, 1)
    p, q = np.nonzero(ok)
    p, q = left[p], (left if right is None else right)[q]
    agree = keys[p] == keys[q]
    first = agree[:, t] & ~agree[:, :t].any(axis=1) if len(p) else np.zeros(0, bool)
    return p[first], q[first]


_MET = "a long, b long, n long"


def _buckets(least: float):
    """Rows ``key, t, label, id, weight, keys, embedding`` clustered and sorted by the first three; a bucket may run over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held = rows.slice(last)
            if last:
                yield _verified(rows.slice(0, last), least)
        if held is not None:
            yield _verified(held, least)

    return run


def _verified(rows: pa.Table, least: float) -> pa.RecordBatch:
    found = _Found()
    key, t, label = rows["key"].to_numpy(), rows["t"].to_numpy(), rows["label"].to_numpy(zero_copy_only=False)
    new = np.r_[True, (key[1:] != key[:-1]) | (t[1:] != t[:-1]) | (label[1:] != label[:-1])] if len(key) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(key)]
    vectors, keys = rows["embedding"].combine_chunks(), rows["keys"].combine_chunks()
    at, keys_at = vectors.offsets.to_numpy(), keys.offsets.to_numpy()
    flat, keys_flat = vectors.values.to_numpy(zero_copy_only=False), keys.values.to_numpy()
    ids, weight = rows["id"].to_numpy(), rows["weight"].to_numpy()
    for s, e in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
        x, k = flat[at[s] : at[e]].astype(float).reshape(e - s, -1), keys_flat[keys_at[s] : keys_at[e]].reshape(e - s, -1)
        p, q = rerank(_unit(x), k, int(t[s]), np.arange(e - s), None, least)
        found.add(ids[s:e], weight[s:e], p, q)
    return found.batch()


def _tile(least: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _Found()
        i, j, t = rows["i"].iloc[0], rows["j"].iloc[0], int(rows["t"].iloc[0])
        x, keys = _unit(np.stack(rows["embedding"].to_numpy()).astype(float)), np.stack(rows["keys"].to_numpy())
        side = (rows["block"] == i).to_numpy()
        p, q = rerank(x, keys, t, np.flatnonzero(side), None if i == j else np.flatnonzero(~side), least)
        found.add(rows["id"].to_numpy(), rows["weight"].to_numpy(), p, q)
        return found.batch().to_pandas()

    return run


def links(nodes: DataFrame, keys: DataFrame, least: float, bucket: int = BUCKET) -> DataFrame:
    """``a, b, n``: spanning links (``a <> b``) and the number of each vector's links (``a = b``), in parts.

    ``nodes`` holds ``id, label, dim, weight, embedding``, ``keys`` the substrings ``keys`` of each id.
    """
    dealt = keys.join(nodes.select("id", "label", "dim"), "id").select("id", "label", "dim", F.posexplode("keys").alias("t", "v"))
    dealt = dealt.select("id", "t", F.xxhash64("label", "dim", "t", "v").alias("key"))
    sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sizes = materialise(sizes, "buckets")  # buckets of one vector are not looked at
    met = materialise(dealt.join(sizes, "key"), "met")
    full = nodes.select("id", "label", "dim", "weight", "embedding").join(keys, "id")
    small = met.where(F.col("n") <= bucket).select("id", "t", "key").join(full, "id").select("key", "t", "label", "dim", "id", "weight", "keys", "embedding")
    sorted_ = small.repartition(spread(nodes.sparkSession, 2), "key").sortWithinPartitions("key", "t", "label", "dim")
    found = sorted_.select("key", "t", F.concat_ws(" ", "dim", "label").alias("label"), "id", "weight", "keys", "embedding").mapInArrow(_buckets(least), _MET)
    blocks = F.ceil(F.col("n") / (bucket // 4)).cast("int")
    rest = met.where(F.col("n") > bucket).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "t", "id", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rest = rest.join(full, "id").select("key", "t", "label", "dim", "id", "weight", "keys", "embedding", "block", "i", "j")
    return found.unionByName(rest.groupBy("key", "t", "label", "dim", "i", "j").applyInPandas(_tile(least), _MET))


def near_duplicates(vectors: DataFrame, least: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", sample: int = SAMPLE, recall: float = RECALL, bucket: int = BUCKET) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector; links: equal label, cosine >= ``least``.

    Pairs right at ``least`` are found with a chance of ``recall`` (measured on planted pairs), closer ones with
    a higher one; no pair below it is linked. Vectors that are null, empty, zero or hold null or non-finite
    components, or have a null label, link with nothing, as do vectors of different lengths. Rows that repeat an
    id count as vectors of their own, linked by their own vectors. Null ids are kept, without links. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    nodes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("dim", F.size("embedding"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # written once, so the numbers stay
    lengths = nodes.groupBy("dim").agg(F.count("*").alias("count"))
    keys = nodes.select("id", "embedding", "dim").join(lengths, "dim").select("id", "embedding", "dim", "count")
    keys = materialise(keys.mapInArrow(_keyed(_learned(nodes, least, sample, recall), least, recall), "id long, keys array<long>"), "keys")
    met = materialise(links(nodes, keys, least, bucket), "links")
    counts = met.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    found = components(met.where("a <> b").select("a", "b"))
    first = nodes.select("id", "first").join(found, "id").groupBy("component").agg(F.min("first").alias("component_id"))
    known = nodes.select("label", "embedding", "id", "first", "weight").join(counts, "id", "left").join(found.join(first, "component"), "id", "left")
    known = known.select("label", "embedding", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = rows.join(known, ["label", "embedding"], "left")
    has_id = F.col("vec_id").isNotNull()
    mine = F.when(has_id, F.coalesce("component_id", "vec_id"))
    n_links = F.when(has_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", n_links.alias("n_links"), mine.alias("component_id"), F.coalesce(F.col("vec_id") == mine, F.lit(True)).alias("kept"))


def _learned(nodes: DataFrame, least: float, sample: int, recall: float) -> dict[int, Layout]:
    """Layouts of the lengths of which a bounded sample holds twice as many vectors as bits; all vectors of a small table are sampled."""
    able = nodes.where(F.col("dim") <= LONGEST)
    n, floats = able.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    share = min(1.0, sample / max(n, 1), FLOATS / max(floats, 1))
    drawn = able.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else able
    some: dict[int, list] = {}
    for r in drawn.select("embedding", "label", "dim").limit(int(2 * share * n) + 100).collect():  # twice the sample's expected size at most
        some.setdefault(r["dim"], []).append((np.array(r["embedding"], float), r["label"]))
    out = {}
    for d, rows in sorted(some.items()):
        if len(rows) >= 2 * min(BITS, d):  # fewer can't balance so many bits
            names = np.unique([y for _, y in rows], return_inverse=True)[1]
            out[d] = lay_out(_unit(np.stack([x for x, _ in rows])), names, len(rows) / share, least, recall)
    return out


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal label at a cosine of 0.98 or more; odd rows as in :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
