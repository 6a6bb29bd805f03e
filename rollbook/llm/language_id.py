"""Language identification by compression.

For each language a zstandard raw-content dictionary is cut from labelled texts. A text is encoded with
each dictionary, in pieces of bounded length so that a long text keeps leaning on the dictionary rather
than on itself, and the language with the fewest bytes wins. The score is the relative margin to the
runner-up; narrow margins are rejected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table
from .storage import settle

DOCS, PASSAGE, PASSAGES = 300, 900, 20_000
PIECE = 2048
MIN_MARGIN = 0.01
_GAP = re.compile(r"[\W\d_]+")


def folded(text: str | None) -> str:
    """Letters of a text, lower-cased, with single blanks for everything between; '' without letters."""
    if not text:
        return ""
    out = _GAP.sub(" ", unicodedata.normalize("NFC", text)).lower()
    return out if any(map(str.isalpha, out)) else ""


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = DOCS, passage: int = PASSAGE, most: int = PASSAGES) -> dict[str, bytes]:
    """Dictionary of each language, from at most ``per_language`` passages of ``passage`` characters each.

    Documents are drawn by a hash of their key; the draw is thinned while scanning, by the number of
    documents of each language, so that what is shuffled and sent to the driver is bounded by the three
    parameters. Rows with null text or language teach nothing.
    """
    wide = 1 << 40
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(3)), F.lit(wide))
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), draw.alias("draw")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}  # a row for each language
    if not counts:
        return {}
    per_language = max(1, min(per_language, most // len(counts)))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 4.0 * per_language / n) * wide))))
    at = F.floor(F.col("draw") / 7) % F.greatest(F.length("text") - passage, F.lit(1))
    drawn = rows.where(F.col("draw") <= share[F.col("lang")]).select("lang", "draw", F.substring("text", (at + 1).cast("int"), F.lit(passage)).alias("text"))
    drawn = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("rank") <= per_language)
    texts: dict[str, list[str]] = {}
    for r in drawn.orderBy("lang", F.desc("rank")).collect():
        texts.setdefault(r["lang"], []).append(folded(r["text"]))
    return {k: " ".join(x for x in v if x).encode() for k, v in texts.items() if any(v)}


def _identify(shared: Broadcast, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as z

        dictionaries = shared.value
        names, coders = sorted(dictionaries), []
        for k in names:
            d = z.ZstdCompressionDict(dictionaries[k], dict_type=z.DICT_TYPE_RAWCONTENT)
            # matches of 4 bytes and more: shorter words and syllables tell languages apart
            params = z.ZstdCompressionParameters(format=z.FORMAT_ZSTD1_MAGICLESS, window_log=20, hash_log=17, chain_log=17, min_match=4, strategy=z.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0)
            d.precompute_compress(compression_params=params)
            coders.append(z.ZstdCompressor(compression_params=params, dict_data=d).compress)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                raw = folded(text.as_py()).encode()
                if not raw or not names:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
                sizes = sorted((sum(map(len, map(c, pieces))), k) for c, k in zip(coders, names, strict=True))
                langs.append(sizes[0][1])
                scores.append(1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)
            n = batch.num_columns - (not keep_text)
            columns = [*batch.columns[:n], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:n], "lang_pred", "score"])
            del batch, columns
        del coders
        settle()

    return run


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN, keep_text: bool = False) -> DataFrame:
    """All columns of ``docs``, ``text`` only with ``keep_text``, then ``lang_pred``, ``score`` and ``rejected``.

    Null text or text without a letter: ``und`` with score 0, rejected. With one language its score is
    1. Equal sizes go to the first language by name, with score 0. Whole texts are encoded. Columns
    already named like a result make way for it.
    """
    names = [c for c in docs.columns if c not in (text, "lang_pred", "score", "rejected")]
    rows = docs.select(*names, text)
    kept = [f for f in rows.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by ``fit``
    return rows.mapInArrow(_identify(shared, keep_text), schema).withColumn("rejected", F.col("score") < min_margin)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from four fifths of the labelled documents; odd rows as in :func:`identify`."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = fit(docs.where(~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), dictionaries)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
