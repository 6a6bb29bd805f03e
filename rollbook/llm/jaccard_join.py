"""Exact Jaccard join of word n-gram sets by vertical partitioning.

Equal sets are one node throughout. Nodes that cannot link are put aside first, then the rest is joined:

1. Heads. A set's head are its least n-grams by hash: as many as a linked set may lack, and a tenth
   more. Linked sets share at least a known number of n-grams of their heads, so a set with fewer
   n-grams that any other head holds links with nothing. Only heads are shuffled.
2. Global order. N-grams of the remaining sets are counted. The order is: n-grams of one set, then
   rarer before more frequent ones by powers of two, then by hash. It is cut into fragments: each power
   of two into ``SLICES`` ranges of the hash.
3. Candidates. Linked sets share an n-gram of their prefixes in that order.
4. Overlaps. For each fragment, the partial overlaps of candidate pairs are counted by themselves;
   counts are summed for each pair, and integers decide.

Pairs are formed in rounds. In a round each node meets one node only, of the largest class of linked
nodes among those with its prefix n-grams, so groups of near copies collapse into classes without their
pairs. When the pairs left between classes are fewer than the prefix n-grams, or a round leaves more than
``LEFT`` of them, all of these are compared. No link between different classes is lost, and nothing is
capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialise, table
from .components import components
from .storage import settle

#: Bits of the filter that texts pass before they are shuffled; its broadcast side has at most BITS / 64 rows.
BITS = 1 << 23
#: Fragments of each power of two of the n-grams' document frequency.
SLICES = 4
ROWS = 500
#: Share of the pairs between classes that a round may leave and another one follow; part of a class among which later rounds choose.
LEFT, PART = 0.9, 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words: the whole sequence as one; no words: none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _ODD[0] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _least(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Fewest n-grams that a set of ``n`` shares with a linked one: ceil(n * num / den)."""
    return -(-n * num // den)


def _spare(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, n // 10)


def _sets(part: pa.Array, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Shingle sets and the two halves of their 128-bit digests."""
    sets = [shingles(t.as_py(), n) for t in part]
    raw = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
    return sets, np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.view(np.int64)))


def _heads(n: int, num: int, den: int):
    """Sizes, digests and heads of all rows.

    N-grams that several heads of a slice of rows hold are counted (``known``) and leave the heads; one
    more row without a set holds them for the other slices. So what most documents share is shuffled
    once for each slice, not for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets, halves = _sets(part.column(1), n)
                size = np.array([len(x) for x in sets])
                head = np.minimum(size, size - _least(size, num, den) + _spare(size))
                need = np.where(size > 0, _spare(_least(size, num, den)), 0)
                flat = np.concatenate([x[:k] for x, k in zip(sets, head, strict=True)])
                owner = np.repeat(np.arange(len(sets)), head)
                grams, where, count = np.unique(flat, return_inverse=True, return_counts=True)
                several = count[where] > 1
                known = np.bincount(owner[several], minlength=len(sets))
                own = np.bincount(owner[~several], minlength=len(sets))
                shared = grams[count > 1]
                rows = np.arange(row, row + len(sets))
                row += len(sets)
                numbers = [np.r_[x, 0] for x in (size, halves[:, 0], halves[:, 1], need, known)]
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([part.column(0), pa.nulls(1, pa.int64())]), pa.array([*rows.tolist(), None], pa.int64())]
                    + [pa.array(x, pa.int64()) for x in numbers]
                    + [_lists(np.r_[flat[~several], shared], np.r_[own, len(shared)])],
                    names=["doc_id", "row", "n_shingles", "d1", "d2", "need", "known", "head"],
                )
        settle()

    return run


HEADS = "doc_id long, row long, n_shingles long, d1 long, d2 long, need long, known long, head array<long>"


def _grams(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sets, halves = _sets(batch.slice(at, ROWS).column(0), n)
                size = np.array([len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), _lists(np.concatenate(sets), size)], names=["d1", "d2", "grams"])
        settle()

    return run


def with_digest(docs: DataFrame, text: str = "text", words: int = 5) -> DataFrame:
    """All columns of ``docs``, then ``d1, d2``, the digest of each text's shingle set; columns of these names make way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                _, halves = _sets(part.column(part.schema.get_field_index(text)), words)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=[*part.schema.names, "d1", "d2"])

    rows = docs.drop("d1", "d2")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())]))


def jaccard_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, component_id`` of every row; links: ``den * overlap >= num * union``.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text with fewer than ``words``
    words is one shingle; null text or no word: an empty set that links with nothing. Texts of any
    length are taken whole. ``d1, d2`` are the digest of the set. Each row is judged by its own text,
    also where ids repeat or are null; ``component_id`` is the smallest id that is not null among the
    rows reachable by links, itself included. An empty table gives an empty result.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parsed = materialise(base.mapInArrow(_heads(words, num, den), HEADS), "heads")
    heads = parsed.select("row", F.explode("head").alias("gram"))
    held = heads.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    counted = heads.where("row IS NOT NULL").join(held, "gram").groupBy("row").agg(F.count("*").alias("more"))
    filled = parsed.where("n_shingles > 0").select("row", "doc_id", "n_shingles", "d1", "d2", "need", "known")
    may = F.col("known") + F.coalesce("more", F.lit(0)) >= F.col("need")
    classes = filled.join(counted, "row", "left").groupBy("d1", "d2").agg(F.min("n_shingles").alias("n_shingles"), F.min("doc_id").alias("rep"), F.max(may).alias("may"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
    links = _links(base, classes.where("may"), words, num, den)
    found = components(links).withColumnRenamed("id", "node")
    grouped = classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = materialise(grouped.where("may").groupBy("component").agg(F.min("rep").alias("first")), "components")
    joined = grouped.join(least, "component", "left").select("d1", "d2", F.coalesce("first", "rep").alias("__c"))
    out = parsed.where("row IS NOT NULL").select("doc_id", "n_shingles", "d1", "d2").join(joined, ["d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", "d1", "d2", F.coalesce("__c", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row; options and rules are those of :func:`jaccard_rows`."""
    return jaccard_rows(docs, **options).select("doc_id", "n_shingles", "component_id")


def _ordered(base: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``node, n, alone, prefix, frag, before, grams``: fragments of each node that can link, in the global order.

    ``alone`` is the number of the node's n-grams that no other set has, ``before`` that of its n-grams in
    earlier fragments (those included), ``prefix`` that of its n-grams in its prefix.
    """
    texts = _maybe_in(base, nodes.select(F.col("rep").alias("doc_id")))
    sets = texts.select("text").mapInArrow(_grams(words), "d1 long, d2 long, grams array<long>")
    sets = sets.join(nodes.select("node", "d1", "d2", F.col("n_shingles").alias("n")), ["d1", "d2"]).dropDuplicates(["node"])
    grams = materialise(sets.select("node", "n", "grams"), "sets").select("node", "n", F.explode("grams").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    frag = (F.floor(F.log2("df")) * SLICES + F.shiftright(F.col("gram"), 62).bitwiseAND(F.lit(SLICES - 1))).cast("int")
    common = grams.join(counts, "gram").select("node", "n", frag.alias("frag"), "gram").repartition("node")
    pieces = common.groupBy("node", "n", "frag").agg(F.sort_array(F.collect_list("gram")).alias("grams"))
    along = Window.partitionBy("node").orderBy("frag")  # over the fragments of one set
    size = F.size("grams").cast("long")
    alone = F.col("n") - F.sum(size).over(Window.partitionBy("node"))
    before = alone + F.coalesce(F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = F.expr(f"n - (n * {num} + {den - 1}) div {den} + 1")
    pieces = pieces.select("node", "n", "frag", "grams", alone.alias("alone"), before.alias("before"), prefix.alias("prefix"))
    return pieces.where("alone < prefix")


def _overlapping(pairs: DataFrame, pieces: DataFrame, num: int, den: int) -> DataFrame:
    """Those of ``pairs`` (``a, b``) that link: partial overlaps of each fragment, summed for each pair."""
    left = pieces.select(F.col("node").alias("a"), F.col("n").alias("na"), "frag", F.col("grams").alias("ga"))
    right = pieces.select(F.col("node").alias("b"), F.col("n").alias("nb"), "frag", F.col("grams").alias("gb"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("both"))
    sums = partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))
    return sums.where(f"{den + num} * both >= {num} * (na + nb)").select("a", "b")


def _links(base: DataFrame, nodes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` with the same components as all links of ``nodes``."""
    pieces = materialise(_ordered(base, nodes, words, num, den), "pieces")
    inside = F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.col("prefix") - F.col("before")).cast("int"))
    posts = pieces.where("before < prefix").select("node", "n", "alone", "before", F.posexplode(inside).alias("at", "gram"))
    posts = materialise(posts.select("node", "n", (F.col("alone") / F.col("n")).alias("odd"), "gram", (F.col("before") + F.col("at") + 1).alias("place")), "posts")
    classed, links, before, turn = posts.withColumn("class", F.col("node")), None, None, 0
    while True:
        # the node with the least of its own is the likeliest to link; later turns look for it among a part of the class
        order = F.struct((F.lit(turn > 0) & (F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PART)) > 0)).alias("other"), "odd", "node")
        shares = classed.groupBy("gram", "class").agg(F.count("*").alias("m"), F.min(order).alias("one"))
        lists = shares.groupBy("gram").agg(F.count("*").alias("classes"), F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max(F.struct("m", -F.col("one.odd"), "class", "one")).alias("top"))
        lists = materialise(lists.where("classes > 1").select("gram", "rows", "same", F.col("top.class").alias("hub"), F.col("top.one.node").alias("centre")), "lists")
        left = classed.join(lists.select("gram", "hub", "centre"), "gram")
        apart, rows = lists.agg(F.coalesce(F.sum((F.col("rows") * F.col("rows") - F.col("same")) / 2), F.lit(0.0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if before is not None and (apart <= rows or apart > before * LEFT):
            break
        before, turn = apart, turn + 1
        votes = left.where("class <> hub").groupBy("node", "centre", "hub").agg(F.count("*").alias("votes"))
        stars = votes.groupBy("node").agg(F.max(F.struct("votes", "centre", "hub")).alias("x")).select(F.col("node").alias("a"), F.col("x.centre").alias("b"), F.col("x.hub").alias("hub"))
        stars = materialise(stars, "stars")
        new = materialise(_overlapping(stars.select("a", "b"), pieces, num, den), "links")
        links = new if links is None else links.unionByName(new)
        # a node goes over to the class that its partner had, and once more to where the first of that class goes
        moved = stars.join(new, ["a", "b"]).select(F.col("a").alias("node"), "hub")
        once = moved.select(F.col("node").alias("hub"), F.col("hub").alias("next"))
        moved = moved.join(once, "hub", "left").select("node", F.coalesce("next", "hub").alias("moved"))
        classed = classed.join(moved, "node", "left").withColumn("class", F.coalesce("moved", "class")).drop("moved")
        classed = materialise(classed, "classed")
    # sizes of linked sets differ by a factor of den / num at most: the larger one is in the same band or the next
    band = F.floor(F.log("n") / (float(np.log(den / num)) * (1 + 1e-6) + 1e-9)).alias("band")
    side = lambda c, at: left.select("gram", at, *(F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "class", "place")))
    reach = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    ordered = F.struct("n_a", "node_a") < F.struct("n_b", "node_b")
    fits = ordered & (F.col("class_a") != F.col("class_b")) & ((den + num) * reach >= num * (F.col("n_a") + F.col("n_b")))
    pairs = side("a", F.explode(F.array(band, band + 1)).alias("band")).join(side("b", band), ["gram", "band"]).where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    return links.unionByName(materialise(_overlapping(pairs, pieces, num, den), "links"))


def _maybe_in(base: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``base`` whose id may be among ``ids``, without an exchange of ``base``.

    A bitmap of hashed ids lets all of them and a few others through. As a table of 64-bit words it has
    at most BITS / 64 rows, so it is broadcast safely at any size of the corpus.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)).cast("int")
    bit = lambda p: F.expr(f"shiftleft(1L, {p} & 63)")
    words = ids.select(place("doc_id").alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.bit_or(bit("p")).alias("__bits"))
    placed = base.withColumn("__p", place("doc_id")).withColumn("__word", F.shiftright("__p", 6))
    return placed.join(F.broadcast(words), "__word").where(F.col("__bits").bitwiseAND(bit("__p")) != 0).drop("__p", "__word", "__bits")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 3-gram sets of all documents, linked at a Jaccard similarity of 0.9 or more; odd rows as in :func:`jaccard_rows`."""
    return jaccard_components(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
