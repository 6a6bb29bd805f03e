"""Toxicity scores of texts from subword-bag embeddings under a linear softmax.

A word is the bag of its character n-grams (with marks at its ends) and itself, hashed to buckets; its vector is
the mean of their embeddings, a text's vector the mean over its words. A softmax over two classes reads the
text's vector. Embeddings and softmax are trained together by full-batch gradient steps in numpy on a bounded
sample of labelled texts, so words never seen, such as misspellings, are judged by the n-grams they share.

As means and softmax are linear up to the last step, the trained model is one number for each bucket and one
for the bias: scoring sends these to the tasks, and a word's number is the mean of its buckets'.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ship, table
from .language_id import held_out
from .storage import settle

DOCS, PASSAGE = 3000, 3000
WIDTH, DIM, EPOCHS = 1 << 17, 6, 100
GRAMS = 3, 4, 5
#: Text vectors are means times this, so that one word in hundreds moves the softmax after few steps.
GAIN = 200.0
CACHE = 300_000
ROWS = 200
_EDGE = ".,;:!?()[]{}\"'$%&*#|-+/_~=<>«»„“”‘’…¡¿"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased words of a text without punctuation at their ends."""
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w] if text else []


def buckets(found: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, owner)``: a bucket for each n-gram of each word and one for the word; owner is the word's place."""
    code = np.frombuffer("".join(f"\x02{w}\x03" for w in found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), [len(w) + 2 for w in found])
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found))
    hashes, owners, h = [whole * _ODD], [np.arange(len(found))], code
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * _ODD + code[n - 1 :] if len(h) else h
        if n in GRAMS and len(h):
            inside = owner[: len(h)] == owner[n - 1 :]
            hashes.append((h[inside] ^ (h[inside] >> np.uint64(29))) * _ODD)
            owners.append(owner[: len(h)][inside])
    at = np.concatenate(owners)
    order = np.argsort(at, kind="stable")
    return ((np.concatenate(hashes) >> np.uint64(40)) % np.uint64(width)).astype(np.int64)[order], at[order]


@dataclass
class Toxicity:
    """A number for each bucket, and the bias; a text's logit is the bias and the mean of its words' means."""

    weights: np.ndarray
    bias: float

    def of_words(self, found: list[str]) -> np.ndarray:
        bucket, owner = buckets(found, len(self.weights))
        return np.bincount(owner, self.weights[bucket], len(found)) / np.bincount(owner, minlength=len(found))

    def logits(self, texts: list[str | None], cache: dict[str, float]) -> list[float]:
        bags = [words(t) for t in texts]
        new = list({w for bag in bags for w in bag if w not in cache})
        own = dict(zip(new, self.of_words(new).tolist(), strict=True)) if new else {}
        if len(cache) + len(own) > CACHE:
            cache.clear()
            known = own | dict(zip(rest := list({w for bag in bags for w in bag} - own.keys()), self.of_words(rest).tolist() if rest else [], strict=True))
        else:
            cache |= {w: x for w, x in own.items() if len(w) <= 64}
            known = cache if all(len(w) <= 64 for w in own) else cache | own
        return [self.bias + (sum(map(known.__getitem__, bag)) / len(bag) if bag else 0.0) for bag in bags]


def train(texts: list[str], toxic: list[int], weight: list[float], width: int = WIDTH, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 3e-5, seed: int = 7) -> Toxicity:
    """Embeddings and softmax, jointly, by Adam over all texts at once. Words of a single text teach nothing by themselves."""
    bags = [Counter(words(t)) for t in texts]
    seen = Counter(w for bag in bags for w in bag)
    place = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n > 1 or len(texts) < 50))}
    if not place or len(set(toxic)) < 2:
        share = float(np.average(toxic, weights=weight)) if toxic else 0.0
        return Toxicity(np.zeros(width), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    bucket, owner = buckets(list(place), width)
    used, bucket = np.unique(bucket, return_inverse=True)
    per_word = np.bincount(owner).astype(np.float32)
    by_bucket = np.argsort(bucket, kind="stable")
    entry = [(i, place[w], n / bag.total()) for i, bag in enumerate(bags) for w, n in bag.items() if w in place]
    text, word = (np.array([e[k] for e in entry]) for k in (0, 1))
    part = np.array([e[2] for e in entry], np.float32)[:, None]
    by_word = np.argsort(word, kind="stable")
    first = lambda x: np.r_[0, np.flatnonzero(np.diff(x)) + 1]
    first_owner, first_bucket, first_text, first_word = first(owner), first(bucket[by_bucket]), first(text), first(word[by_word])
    texts_at, words_at = text[first_text], word[by_word][first_word]

    rng = np.random.default_rng(seed)
    p = [(rng.standard_normal(s) * 0.1).astype(np.float32) for s in ((len(used), dim), (dim, 2))] + [np.zeros(2, np.float32)]
    mean, square = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    target = np.eye(2, dtype=np.float32)[toxic]
    w = (np.array(weight, np.float32) / np.sum(weight))[:, None]
    for step in range(1, epochs + 1):
        embedding, softmax, bias = p
        vectors = np.add.reduceat(embedding[bucket], first_owner, axis=0) * (GAIN / per_word[:, None])
        x = np.zeros((len(bags), dim), np.float32)
        x[texts_at] = np.add.reduceat(vectors[word] * part, first_text, axis=0)
        z = x @ softmax + bias
        q = np.exp(z - z.max(axis=1, keepdims=True))
        g = (q / q.sum(axis=1, keepdims=True) - target) * w
        down = (g @ softmax.T)[text] * part
        to_words = np.zeros_like(vectors)
        to_words[words_at] = np.add.reduceat(down[by_word], first_word, axis=0)
        to_buckets = np.add.reduceat((to_words * (GAIN / per_word[:, None]))[owner[by_bucket]], first_bucket, axis=0)
        for i, grad in enumerate((to_buckets + decay * embedding, x.T @ g + decay * softmax, g.sum(axis=0))):
            mean[i] = 0.9 * mean[i] + 0.1 * grad
            square[i] = 0.999 * square[i] + 0.001 * grad * grad
            p[i] = p[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(width)
    weights[used] = GAIN * p[0] @ (p[1][:, 1] - p[1][:, 0])
    return Toxicity(weights, float(p[2][1] - p[2][0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", per_class: int = DOCS, passage: int = PASSAGE, **options) -> Toxicity:
    """Model from at most ``per_class`` passages of ``passage`` characters for each class of ``labels``.

    Keys are drawn from the labels by a hash, thinned while scanning, before any text is read: the drawn keys
    (at most 4 * ``per_class``) are broadcast to ``docs``, which is not shuffled. Passages are weighted by the
    size of their class, so that scores follow the share of toxic texts; what reaches the driver is bounded
    by the two parameters. Rows with null text or key, or a label other than 0 and 1, teach nothing. An empty
    text is taught as not toxic. A key that repeats teaches all its texts, within the bound.
    """
    wide = 1 << 40
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(5)), F.lit(wide))
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"), draw.alias("draw")).where("key IS NOT NULL AND toxic IN (0, 1)")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows at most
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 4 * per_class / sizes.get(1, 1)))).otherwise(F.lit(min(1.0, 4 * per_class / sizes.get(0, 1))))
    by_class = Window.partitionBy("toxic")
    first = lambda df, n, *by: df.withColumn("rank", F.row_number().over(by_class.orderBy(*by))).where(F.col("rank") <= n)
    drawn = first(rows.where(F.col("draw") <= share * wide), 2 * per_class, "draw", "key").drop("rank")
    at = F.floor(F.col("draw") / 7) % F.greatest(F.length("text") - passage, F.lit(1))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(drawn), "key")  # at most 4 * per_class keys
    passages = texts.select("toxic", "draw", F.substring("text", (at + 1).cast("int"), F.lit(passage)).alias("text"))
    taught = first(passages, per_class, "draw", "text").orderBy("toxic", "rank").collect()  # at most 2 * per_class passages
    found = Counter(r["toxic"] for r in taught)
    weight = [sizes[r["toxic"]] / found[r["toxic"]] for r in taught]
    return train([r["text"] for r in taught] + [""], [r["toxic"] for r in taught] + [0], [*weight, 0.01 * sum(weight) + 1], **options)


def score(docs: DataFrame, model: Toxicity, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but ``text``, then ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Whole texts are scored. Null and empty texts, and texts without a word, get the score of the bias alone.
    Columns already named like a result make way for it. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    names = [c for c in docs.columns if c not in (text, "score", "predicted")]
    rows = docs.select(*names, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                z = np.array(own.logits(part.column(part.num_columns - 1).to_pylist(), cache))
                s = 1 / (1 + np.exp(-z.clip(-700, 700)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])
        del own, cache
        settle()

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from four fifths of the labelled documents; odd rows as in :func:`score`.

    Ids that repeat are scored row by row.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
