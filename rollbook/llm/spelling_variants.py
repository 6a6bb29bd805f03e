"""Spelling variants among the words of a corpus by finite-state composition.

The vocabulary (words counted over all documents) is an acceptor; composed with a transducer that makes one
insertion, deletion or replacement, and with the acceptor again, it accepts the pairs of near words. Each pair
has one state at which it parts: the one that its longest common prefix leads to. So the composition is cut by
states near the initial one, and no pair is found twice:

* A state below which at most ``LETTERS`` letters lie is one group. Its task builds the minimised acceptor of
  what follows, composes it on the fly, and enumerates the accepted pairs.
* A larger state is opened. Pairs that part at it agree in all that follows the edit, so they meet by that
  remainder in an aggregation (at most one word for each symbol of the alphabet in a group); all other pairs
  part below one of its successors, which are looked at next.

A prefix that a large share of the vocabulary has in common is thus opened as far as needed, by rows that
Spark spreads, and nothing is left out. Long words meet in plain equality, never in an automaton.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, table
from .storage import settle

LETTERS = 40_000
HELD = 200_000
_RUN = r"[a-zÀ-ÿ]{%d,}"
_PAIRS = "a string, na long, b string, nb long"


def _count(least_chars: int, every: int):
    run_of = re.compile(_RUN % least_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run_of.findall(low)).items():
                    h = zlib.crc32(word.encode(), begun) if every else 1
                    if every and h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_chars:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield _counts(held)
                    held.clear()
        yield _counts(held)
        del held
        settle()

    return run


def _counts(held: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = 6, least: int = 5, every: int = 0) -> DataFrame:
    """``word, n``: maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of whole texts.

    Words of at least ``least_chars`` code points and ``least`` occurrences. With ``every``, runs lose one code
    point where ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id counts as ''. Occurrences are
    counted in the task before they are shuffled.
    """
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_count(least_chars, every), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def acceptor(words: list[str]) -> tuple[list[dict[str, int]], list[bool]]:
    """Minimal deterministic acceptor of sorted distinct words: ``(arcs, final)`` of its states; 0 is the initial one."""
    arcs: list[dict[str, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path, last = [0], ""

    def settle_below(depth: int) -> None:
        while len(path) - 1 > depth:
            s = path.pop()
            arcs[path[-1]][last[len(path) - 1]] = register.setdefault((final[s], *arcs[s].items()), s)

    for word in words:
        same = 0
        while same < min(len(word), len(last)) and word[same] == last[same]:
            same += 1
        settle_below(same)
        for c in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][c] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]], last = True, word
    settle_below(0)
    return arcs, final


def _spelt(link: tuple | None) -> str:
    out = []
    while link:
        link, c = link
        out.append(c)
    return "".join(reversed(out))


def compose(arcs: list[dict[str, int]], final: list[bool]) -> Iterator[tuple[str, str]]:
    """Pairs that acceptor, one edit and acceptor accept, each once; of an insertion the shorter word comes first.

    Before the edit both sides are in one state; after it they read the same symbols. An inserted symbol
    differs from the next one, so that the edit is where the two words part.
    """

    def common(s: int, t: int, but: str | None) -> Iterator[str]:
        stack: list[tuple[int, int, tuple | None]] = [(s, t, None)]
        while stack:
            s, t, tail = stack.pop()
            if final[s] and final[t]:
                yield _spelt(tail)
            fewer, more = (arcs[s], arcs[t]) if len(arcs[s]) < len(arcs[t]) else (arcs[t], arcs[s])
            for c in fewer:
                if c in more and (tail or c != but):
                    stack.append((arcs[s][c], arcs[t][c], (tail, c)))

    stack: list[tuple[int, tuple | None]] = [(0, None)]
    while stack:
        s, link = stack.pop()
        symbols, head = list(arcs[s].items()), None
        for i, (c, t) in enumerate(symbols):
            stack.append((t, (link, c)))
            for tail in common(s, t, c):
                head = _spelt(link) if head is None else head
                yield head + tail, head + c + tail
            for d, u in symbols[:i]:
                for tail in common(t, u, None):
                    head = _spelt(link) if head is None else head
                    yield head + c + tail, head + d + tail


def _accepted(part: pa.Table) -> pa.Table:
    """Pairs of near words of one state."""
    part = part.sort_by("word")
    words, n = part["word"].to_pylist(), part["n"].to_pylist()
    k = len(part["state"][0].as_py())
    rest = [w[k:] for w in words]
    at = {x: i for i, x in enumerate(rest)}
    pairs = [(at[x], at[y]) for x, y in compose(*acceptor(rest))]
    sides = [[x[i] for x in pairs] for i in (0, 1)]
    return pa.table([pa.array([col[i] for i in side], kind) for side in sides for col, kind in ((words, pa.string()), (n, pa.int64()))], names=["a", "na", "b", "nb"])


def _shared(low: str, high: str) -> Column:
    """Length of the common prefix of two strings, bit by bit from the largest."""
    grown = f"IF(at + step <= least(length({low}), length({high})) AND substring({low}, 1, at + step) = substring({high}, 1, at + step), at + step, at)"
    return F.expr(f"aggregate(transform(sequence(30, 0), i -> shiftleft(1, i)), 0, (at, step) -> {grown})")


def near_words(words: DataFrame, letters: int = LETTERS) -> DataFrame:
    """``a, na, b, nb``: each pair of distinct words (``word, n``) that differ by one edit, once.

    ``letters`` bounds the automata of a task, not the results.
    """
    ship(words.sparkSession)
    open_ = words.select("word", "n", F.substring("word", 1, 0).alias("state"))
    found, turn = [], 0
    while True:
        size = open_.groupBy("state").agg(F.count("*").alias("words"), F.sum(F.length("word") - F.length("state")).alias("letters"), F.min("word").alias("low"), F.max("word").alias("high"))
        large = size.where((F.col("words") > 1) & (F.col("letters") > letters)).withColumn("at", _shared("low", "high"))
        large = materialise(large.select("state", "at"), "states")  # at most all letters / ``letters`` rows
        found.append(open_.join(large, "state", "left_anti"))
        if large.isEmpty():
            break
        # one state deep at first; a path with very many large states is taken in longer and longer strides
        stride = 1 << max(0, turn - 8)
        below = materialise(open_.join(large, "state"), "open")
        where = F.explode(F.sequence(F.col("at"), F.least(F.length("word"), F.col("at") + stride - 1))).alias("k")
        edits = below.select("word", "n", where)
        symbol = F.expr("substring(word, k + 1, 1)")
        head = F.expr("substring(word, 1, k)")
        uses = edits.where("length(word) > k").select("word", "n", "k", symbol.alias("symbol"), head.alias("head"), F.expr("substring(word, k + 2)").alias("rest"))
        skips = edits.select("word", "n", "k", symbol.alias("symbol"), head.alias("head"), F.expr("substring(word, k + 1)").alias("rest"))
        # one word for each symbol, and the one without
        met = uses.unionByName(skips).groupBy("k", "head", "rest").agg(F.collect_list(F.struct("word", "n", "symbol")).alias("met")).where(F.size("met") > 1)
        pairs = met.select(F.explode("met").alias("x"), "met").select("x", F.explode("met").alias("y")).where("x.word < y.word AND x.symbol <> y.symbol")
        found.append(materialise(pairs.select(F.col("x.word").alias("a"), F.col("x.n").alias("na"), F.col("y.word").alias("b"), F.col("y.n").alias("nb")), "pairs"))
        open_ = below.where(F.length("word") >= F.col("at") + stride).select("word", "n", F.expr(f"substring(word, 1, at + {stride})").alias("state"))
        turn += 1
    groups = [x for x in found if "state" in x.columns]
    out = _together([x.where("length(word) > 0") for x in groups]).groupBy("state").applyInArrow(_accepted, _PAIRS)
    return _together([out, *(x for x in found if "state" not in x.columns)])


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def variants(words: DataFrame, ratio: int = 5, letters: int = LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each row of ``words`` (``word, n``; distinct words).

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is at least
    ``ratio`` times the word's, ``root`` where forms lead to in the end. Without words the result is empty.
    """
    words = materialise(words.select("word", "n"), "words")
    links = materialise(near_words(words, letters), "near")
    both = links.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")).alias("near"))
    both = both.unionByName(links.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("form")).alias("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    rows = materialise(rows, "forms")
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps; counts rise along forms, so there are no cycles
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among all words of six code points and more that occur five times.

    Null and empty texts have no words; texts of any length are taken whole; rows that repeat count again;
    ties go to the smaller word; an empty table gives an empty result; other columns are ignored.
    """
    return variants(word_counts(table(spark, sf_dir, "documents"), every=199))


OP11_SQL = """
WITH RECURSIVE t AS (SELECT list(x ORDER BY i) AS crc FROM (SELECT i, list_reduce(generate_series(1, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS x
           FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
      FROM documents WHERE text IS NOT NULL),
u AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS raw FROM r WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce(list_transform(generate_series(1, CAST(length(raw) AS BIGINT), 2), lambda k: CAST('0x' || substring(raw, k, 2) AS BIGINT)),
             lambda c, b: xor(c >> 8, t.crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM u, t),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, n, k, substring(word, 1, k - 1) || substring(word, k + 1) AS less FROM (SELECT word, n, unnest(generate_series(1, CAST(length(word) AS BIGINT))) AS k FROM w)),
l AS (SELECT x.word, y.word AS near, y.n AS near_n FROM v x JOIN v y ON x.k = y.k AND x.less = y.less AND x.word <> y.word
      UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.less = w.word
      UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.less = w.word),
b AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near FROM l QUALIFY row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) = 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
z AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON z.next = f.word)
SELECT f.word, form, z.at AS root, n, n_near, form_n FROM f JOIN z ON f.word = z.word AND z.next IS NULL
"""
