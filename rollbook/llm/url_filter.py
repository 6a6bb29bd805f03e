"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame functions and Spark ML only. The model is trained on a small labelled URL table given as a
parameter.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEATURES = 1 << 18
GRAMS = (3, 4, 5)
#: Words to train on, in hosts and in paths.
_BAD = ("discount-pills", "casino-bonus", "free-viagra", "xxx-videos", "win-money-now", "hot-singles", "payday-loans", "replica-watches", "online-poker", "adult-cams", "weight-loss-miracle", "crack-serials", "free-porn", "best-casino", "buy-pills-online", "cheap-meds", "lottery-winner", "spam-links", "sexy-chat", "bet-jackpot", "ads-server", "ad-tracker", "track-clicks", "banner-ads", "casino", "poker-room", "slots", "roulette-bonus", "sports-betting", "jackpot-games", "viagra-online", "pharmacy-no-prescription", "diet-pills", "instant-loans", "cash-advance", "xxx", "sex-videos", "porn-tube", "live-cams", "escorts", "warez", "keygen", "cracked-software", "replica-bags", "adserver", "popup-ads", "tracking-pixel", "click-tracker", "spam", "make-money-fast", "free-iphone", "win-prizes", "lottery-results-win", "hot-girls", "adult-dating", "cheap-viagra", "betting-tips", "bitcoin-doubler")
_GOOD = ("library", "museum", "news", "university", "garden", "recipes", "history", "weather", "travel", "music", "science", "cityhall", "school", "theater", "hospital", "archive", "river-walks", "geometry", "orchestra", "neighbours", "open-data", "translation", "education", "city-stories", "book-review", "national-park", "cycling", "furniture", "pottery", "lighthouse", "railway", "bakery", "parliament", "astronomy", "literature", "gardening", "workshop", "cooperative", "public-health", "local-council", "council", "press", "forum", "journal", "institute", "clinic", "church", "market", "kitchen", "radio", "physics", "biology", "mathematics", "philosophy", "economics", "football", "chess", "photography", "painting", "ceramics", "sewing", "hiking", "sailing", "beekeeping", "farmers", "firefighters", "transport", "planning", "housing", "charity", "volunteers", "students", "teachers", "research", "conference", "dictionary", "encyclopedia", "documentation", "tutorials", "software", "hardware", "maps", "calendar", "events", "about", "contact", "blog", "articles", "stories", "interviews", "reports")
_AROUND = (("http://", ".example.com/", "12"), ("https://www.", ".example.org/", "en/page/7.html"), ("https://blog.", ".example.net/", "index?x=1"), ("http://m.", ".example.info/", "a/b/"))
_INTO = (("", "/"), ("shop/", ".html"), ("en/2020/", "?x=1"), ("a/", "/b"))
#: Where names stand: domains, ports and paths of many kinds, alike for both labels.
_DOMAINS = ("com", "org", "net", "info", "co.uk", "de", "fr", "io", "edu", "com:8080", "se", "org:443")
_PATHS = ("", "12", "en/44/", "de/page-7.html", "fr/2020/01/", "index.php?id=9", "a/b/c", "view?ref=x&page=2", "2019/report.pdf", "~home/", "item/44021#top", "s?q=term")
_PLAIN = ("http://example.com/", "https://www.example.org/", "https://example.net/", "http://m.example.info/")


def made_up(n: int, seed: int = 1) -> list[str]:
    """Names of plain syllables that mean nothing, by a rule: hosts that no word list knows are to be allowed."""
    heads = [a + b for a in ("", "b", "c", "d", "f", "g", "h", "l", "m", "n", "p", "r", "s", "t", "v", "w", "st", "th", "tr", "br") for b in "aeiou"]
    tails = ["", "n", "r", "s", "l", "m", "nd", "st", "ng", "rt", "th", "ck"]
    out = []
    for i in range(n):
        k, name = i * 7919 + seed * 104729, ""
        for _ in range(2 + i % 2):
            name += heads[k % len(heads)] + tails[k // len(heads) % len(tails)]
            k = (k * 48271 + 11) % 2147483647
        out.append(name)
    return out


def labelled(bad=_BAD, good=_GOOD, plain=600) -> tuple[tuple[str, int], ...]:
    """URLs to block (1) or allow (0): the words of host and path decide, all around them is alike for both kinds.

    ``plain`` made-up names stand among the good ones, in hosts and in paths, and every name stands under
    several domains, ports and paths.

    Hosts of each word have the same plain paths; paths of each word stand on plain hosts and on hosts of good
    words. Hosts of bad words with paths of good ones are blocked.
    """
    out = []
    for y, words in ((1, bad), (0, good)):
        for k, word in enumerate(words):
            for i, (a, b, c) in enumerate(_AROUND):
                left, right = _INTO[(i + k) % len(_INTO)]
                host = good[(k + 5 * i + 1) % len(good)]
                out += [(f"{a}{word}{b}{c}", y), (f"{a}{host}{b}{left}{word}{right}", y), (f"{_PLAIN[i]}{left}{word}{right}", y)]
                if y and i == k % len(_AROUND):
                    out.append((f"{a}{word}{b}{left}{host}{right}", y))
    prefix = ("", "www.", "blog.", "m.", "shop.")
    names = [(w, 1) for w in bad] * 3 + [(w, 0) for w in good] * 2 + [(w, 0) for w in made_up(plain)]
    for i, (word, y) in enumerate(names):
        at = f"{prefix[i % 5]}{word}"
        out += [(f"https://{at}.{_DOMAINS[(i + j) % 12]}/{_PATHS[(5 * i + 7 * j) % 12]}", y) for j in range(2)]
        out.append((f"http://{at}.example.{_DOMAINS[i % 4]}/{_PATHS[i % 12]}", y))
    return tuple(out)


#: Labelled URLs: 1 is block.
LABELS = labelled()


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; both empty without a URL or a ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url), r"(?s)\A.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    return df.withColumns({"host": F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "path": part(2)})


def best_rule(rules=RULES) -> Column:
    """The longest rule that fits host (or a parent domain) and path, else null; ties: first listed."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(reversed(rules), key=lambda r: len(r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def grams(host: Column, path: Column, sizes=GRAMS) -> Column:
    """Character n-grams of host and path, marked by where they stand; a shorter one is its own n-gram.

    One regular expression finds all of a size, so that the time grows with the length of the URL. The
    first class keeps it from starting amid a character of two UTF-16 units.
    """

    def of(mark: str, s: Column) -> list[Column]:
        s = F.concat(F.lit("^"), s, F.lit("$"))
        found = [F.regexp_extract_all(s, F.lit(f"(?s)(?=([^\\x{{DC00}}-\\x{{DFFF}}].{{{n - 1}}}))"), F.lit(1)) for n in sizes]
        return [F.transform(F.when(F.length(s) < n, F.array(s)).otherwise(x), lambda g: F.concat(F.lit(mark), g)) for n, x in zip(sizes, found, strict=True)]

    return F.concat(*of("h", host), *of("p", path))


def fit(spark: SparkSession, labels=LABELS, features: int = FEATURES, reg: float = 0.001) -> PipelineModel:
    """Model over the labelled URLs ``(url, 0 or 1)``."""
    rows = with_parts(spark.createDataFrame([(u, float(y)) for u, y in labels], "url string, label double"))
    rows = rows.withColumn("grams", grams(F.col("host"), F.col("path")))
    stages = [HashingTF(inputCol="grams", outputCol="features", numFeatures=features, binary=True), LogisticRegression(regParam=reg, maxIter=60, probabilityCol="p", rawPredictionCol="raw", predictionCol="y")]
    return Pipeline(stages=stages).fit(rows)


def judge(pages: DataFrame, model: PipelineModel, rules=RULES, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add ``host, path, rule, block_probability, verdict``; no exchange.

    Null URL or none with ``://``: empty host and path, so no rule fits and the model judges empty
    strings. A very long URL takes time and memory in proportion to its length. Columns already named like a result make way for it; repeated rows are judged alike.
    """
    results = ("host", "path", "rule", "block_probability", "verdict")
    own = [F.col("row")[c].alias(c) for c in pages.columns if c not in results]
    # users' columns stay inside one, so that no name of theirs meets one of the model's
    rows = with_parts(pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), F.col(f"`{url}`").alias("url")))
    rows = rows.withColumn("rule", best_rule(rules)).withColumn("grams", grams(F.col("host"), F.col("path")))
    scored = model.transform(rows).withColumn("block_probability", vector_to_array("p")[1])
    by_rule = F.create_map(*(F.lit(x) for kv in rules for x in kv))[F.col("rule")] if rules else F.lit(None).cast("string")
    verdict = F.coalesce(by_rule, F.when(F.col("block_probability") > threshold, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*own, *results)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; odd rows as in :func:`judge`, an empty table gives an empty result."""
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), fit(spark))
    return out.select("page_id", "host", "path", "rule", "verdict", "block_probability")
