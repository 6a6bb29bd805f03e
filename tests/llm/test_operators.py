"""Corpus operators against brute force, round trips and held-out accuracy, with odd rows in every input."""

import base64
import hashlib
import random
import re
import unicodedata
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.llm import embedding_dedup, fingerprint, jaccard_join, language_id, line_dedup, packing, sentencepiece_wfst, token_files, url_filter, warc_zip
from rollbook.llm.common import new_path, ship
from rollbook.llm.tokens import vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOC):
    ship(spark)
    return spark.createDataFrame(rows, schema)


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows, texts = [], []
    for i in range(120):
        if texts and rng.random() < 0.4:
            w = rng.choice(texts).split()
            for _ in range(rng.choice((0, 0, 1, 3))):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        else:
            text = " ".join(rng.choices(words, k=rng.choice((1, 2, 5, 30, 90, 200))))
        texts.append(text)
        rows.append((i * 3, text, "en", f"s{i % 3}", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \n\t ", None, "s1", 4), (1003, "One Two.\nThree  four! “Ünï” 中文 \u2028 x", "en", "s2", 1), (1004, "one two three four five", "en", "s2", 1), (1005, "ONE two\nthree four five", None, "s2", 1), (1006, "x y " * 5000, "en", "s1", 20000)]
    return rows


def components(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(i) for i in range(n)]


def word_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("words,num", [(3, 90), (5, 80), (3, 70), (1, 50)])
def test_jaccard_join(spark, words, num):
    rows = corpus()
    rows.sort()
    sets = [word_set(r[1], words) for r in rows]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = {(r[0], len(s), rows[c][0]) for r, s, c in zip(rows, sets, components(len(rows), pairs), strict=True)}
    got = jaccard_join.jaccard_components(frame(spark, rows), words=words, num=num, den=100).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want
    assert len({c for *_, c in want}) < len(rows) - 20


def test_jaccard_join_without_rows(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    assert jaccard_join.jaccard_components(frame(spark, [(5, None, None, None, None)])).collect()[0][:] == (5, 0, 5)


def test_jaccard_join_of_odd_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(7, long), (7, "other words that stand alone here"), (None, long + " x"), (3, long + " y"), (None, "nothing else is like this one"), (9, long), (9, long)]
    got = sorted(str(tuple(r)) for r in jaccard_join.jaccard_components(frame(spark, rows, "doc_id long, text string")).collect())
    assert got == sorted(map(str, [(7, 56, 3), (7, 2, 7), (None, 57, 3), (3, 57, 3), (None, 2, None), (9, 56, 3), (9, 56, 3)]))


def test_jaccard_join_of_many_near_copies(spark):
    """Two large families of near copies that share a passage; most members link with some others only."""
    rng = random.Random(6)
    passage, rows = [f"p{i}" for i in range(30)], []
    for f in range(2):
        base = [f"f{f}w{i}" for i in range(150)]
        for k in range(500):
            words = list(base)
            for at in rng.sample(range(150), rng.choice((0, 2, 4, 7, 9))):
                words[at] = f"x{rng.random()}"
            rows.append((1000 * f + k, " ".join(words + passage)))
    sets = [word_set(t, 5) for _, t in rows]
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = {r[0]: rows[c][0] for r, c in zip(rows, components(len(rows), pairs), strict=True)}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(frame(spark, rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) >= 2


def test_sentencepiece_is_the_library_s(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    odd = ["a    b\x01\U0001f600  naïve  ", "▁ \n\n x", "</s> <0x0A>", " " * 20_000, "ab" * 5000 + " x" + "中" * 300]
    odd += [" " * k + x for k in range(1, 40) for x in ("", "the", "\n")]
    odd += ["".join(rng.choices(["the", "a", "in", " ", "  ", "\n", "é", "▁", "1", "==", "\t"], k=12)) for _ in range(300)]
    rows = [*corpus(), *((2000 + i, x, None, None, None) for i, x in enumerate(odd)), (None, "x", None, None, None), (3, "y", None, None, None)]
    docs = frame(spark, rows).withColumn("ids", F.lit("own"))
    out = sentencepiece_wfst.decode(sentencepiece_wfst.encode(docs, path, decoded="again"), path).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r["text"] or ""
        assert list(r["ids"]) == lib.encode(text) and r["decoded"] == r["again"] == lib.decode(list(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert sentencepiece_wfst.encode(frame(spark, []), path).count() == 0


def small_model(tmp_path, kind, squeeze):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    names = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), "▁", "a", "b", "ab", "▁a", "aab", "bb", "▁ab", "abab"]
    for i, x in enumerate(names):
        p = m.pieces.add(piece=x, score=0.0 if i < 257 else -1.0 - (i * 7 % 5))
        p.type = p.UNKNOWN if i == 0 else p.BYTE if i < 257 else p.NORMAL
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.vocab_size = kind, True, len(names)
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, squeeze
    path = tmp_path / f"{kind}{squeeze}.model"
    path.write_bytes(m.SerializeToString())
    return str(path)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("squeeze", [False, True])
def test_sentencepiece_of_other_models(tmp_path, kind, squeeze):
    import sentencepiece

    path = small_model(tmp_path, kind, squeeze)
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_wfst.Transducer(path)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choices(["a", "b", " ", "é"], [6, 6, 2, 1], k=rng.randint(0, 12)))
        if kind == 2:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == lib.encode(text)
        score = lambda ids: sum(-1000.0 if i < 257 else own.score[own.piece[i]] for i in ids)
        assert own.decode(np.frombuffer(own.encode(text), "<u4")) == lib.decode(lib.encode(text))
        assert score(np.frombuffer(own.encode(text), "<u4").tolist()) == score(lib.encode(text))
        s = own.normalise(text)
        assert not s or own.shortest([s])[0] == own.shortest_of_long(s) or kind == 1


def test_line_dedup(spark):
    rows = [(i, f"Menu\nline {i} \n\n  Footer\t" + ("\nMenu" if i % 2 else ""), "en", "hot" if i < 60 else "rare", 1) for i in range(70)]
    rows += [(100, None, None, "hot", None), (101, "Menu", None, None, 4), (102, "", None, "hot", 0), (103, "Menu", "en", "hot", 4), (103, "Menu", "en", "hot", 4)]
    got = line_dedup.drop_boilerplate(frame(spark, rows).withColumn("host", F.lit("own"))).collect()
    assert len(got) == len(rows)
    pages = Counter(r[3] for r in rows)
    key = lambda x: x.strip(" \t\r")
    seen = Counter((r[3], k) for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} - {""})
    want = []
    for r in rows:
        lines = r[1].split("\n") if r[1] is not None else []
        cut = lambda x, s=r[3]: s is not None and seen[s, key(x)] >= 3 and seen[s, key(x)] > 0.1 * pages[s]
        kept = [x for x in lines if not cut(x)]
        want.append((r[0], "\n".join(kept) if r[1] is not None else None, len(lines), len(lines) - len(kept)))
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"], r["__lines"], r["__dropped"])) for r in got)
    assert sum(r["__dropped"] > 0 for r in got if r["source"] == "rare") == 10  # a small source is judged like any other
    assert line_dedup.drop_boilerplate(frame(spark, [])).count() == 0


def test_line_dedup_keeps_other_columns(spark):
    names = ["__boilerplate", "__kept", "__host", "row", "host", "lines", "kept", "a.b"]
    rows = [(i, "Menu\nline %d" % i, "s", *range(i, i + len(names))) for i in range(12)]
    wide = frame(spark, rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    got = sorted(map(tuple, line_dedup.drop_boilerplate(wide.withColumn("__lines", F.lit(9))).collect()))
    assert got == [(i, f"line {i}", "s", *range(i, i + len(names)), 2, 1) for i in range(12)]


def test_language_id_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    from rollbook.llm.language_id import op3_language_id

    got = {r["doc_id"]: r for r in op3_language_id(spark, sf_dir).collect()}
    rows = docs.select("doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    judged = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if r["lang"] and r["text"] and len(r["text"]) > 50 and got[r["doc_id"]]["held_out"]]
    assert np.mean(judged) > 0.9


def test_language_id_of_odd_texts(spark):
    odd = frame(spark, [(1, None, None, None, None), (2, "12 3!", "en", "a", 1), (3, "", "en", "a", 1)]).withColumn("score", F.lit("own"))
    got = language_id.identify(odd, {"aa": b"one two three", "bb": b"eins zwei drei"}).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in got} == {("und", 0.0, True)} and len(got) == 3
    assert language_id.fit(frame(spark, [])) == {}
    assert language_id.identify(frame(spark, [(1, "abc", None, None, None)]), {}).collect()[0]["lang_pred"] == "und"


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(240):
        v = centres[i % 12] + rng.normal(size=16) * rng.choice([0.01, 0.1, 0.8])
        rows.append((i, v.tolist(), f"l{i % 12 % 3}" if i % 7 else None))
    odd = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15]
    return rows + [(500 + i, v, "l0") for i, v in enumerate(odd)] + [(600, rows[3][1], rows[3][2]), (601, [2 * x for x in rows[3][1]], rows[3][2])]


@pytest.mark.parametrize("bucket", [2048, 12])
def test_embedding_dedup(spark, bucket):
    """With small buckets, most of them go through tiles."""
    rows = [*vectors(), *((700 + i, np.random.default_rng(i // 2).normal(size=3 + i // 2).tolist(), "l0") for i in range(160))]  # 80 further lengths
    df = frame(spark, rows, "vec_id long, embedding array<double>, label string").withColumn("n_links", F.lit("own"))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, 0.98, bucket=bucket).collect()}
    assert len(got) == len(rows)
    fine = [v is not None and None not in v and bool(np.isfinite(v).all()) and any(v) for _, v, _ in rows]
    unit = [np.array(v) / np.linalg.norm(v) if ok else None for (_, v, _), ok in zip(rows, fine, strict=True)]
    alike = lambda i, j: fine[i] and fine[j] and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98
    pairs = [(i, j) for j in range(len(rows)) for i in range(j) if alike(i, j)]
    true = Counter(x for p in pairs for x in p)
    found = sum(got[r[0]]["n_links"] for r in rows)
    assert found >= 0.9 * 2 * len(pairs) > 100
    assert all(got[r[0]]["n_links"] <= true[i] for i, r in enumerate(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in got.values())
    assert all(got[700 + i]["n_links"] == 1 for i in range(160))
    if found == 2 * len(pairs):
        want = [rows[c][0] for c in components(len(rows), pairs)]
        assert [got[r[0]]["component_id"] for r in rows] == want
    assert all(got[500 + i]["n_links"] == 0 and got[500 + i]["kept"] for i in range(5))
    assert embedding_dedup.near_duplicates(df.limit(0), 0.98).count() == 0


def test_embedding_dedup_of_repeated_ids(spark):
    x = np.random.default_rng(1).normal(size=(3, 8)).tolist()
    rows = [(1, x[0], "a"), (2, x[1], "a"), (1, x[1], "a"), (3, x[2], "a"), (3, x[2], "a"), (None, x[0], "a")]
    got = embedding_dedup.near_duplicates(frame(spark, rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 0, 1, True), (2, 1, 1, False), (1, 1, 1, True), (3, 1, 3, True), (3, 1, 3, True), (None, 0, None, True)]))


def partners(x, least=0.98, seed=6):
    """A partner at cosine ``least`` of each unit vector."""
    z = np.random.default_rng(seed).normal(size=x.shape)
    z = embedding_dedup._unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    return least * x + np.sqrt(1 - least**2) * z


@pytest.mark.parametrize("mean", [0.0, 0.9])
def test_embedding_recall_at_the_threshold(spark, mean):
    """Also where all vectors have a direction in common (``mean``: the mean cosine)."""
    rng = np.random.default_rng(5)
    shift = np.sqrt(mean / (1 - mean) * 64) * embedding_dedup._unit(rng.normal(size=(1, 64)))
    x = embedding_dedup._unit(rng.normal(size=(1000, 64)) + shift)
    assert abs((x.mean(axis=0) ** 2).sum() - mean) < 0.03
    both = np.concatenate([x, partners(x)])
    alike = np.triu(both @ both.T >= 0.98 - 1e-9, 1)
    df = frame(spark, [(i, v.tolist(), "a") for i, v in enumerate(both)], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(df, 0.98 - 1e-9).collect()}
    true = alike.sum(axis=0) + alike.sum(axis=1)
    assert all(got[i] <= true[i] for i in range(2000)) and alike.sum() >= 1000
    assert sum(got.values()) >= 0.995 * true.sum()


def test_topics_without_links(spark):
    """Vectors that are close within their topics, though below the threshold, meet in few buckets and link with nothing."""
    rng = np.random.default_rng(8)
    centre = embedding_dedup._unit(rng.normal(size=(6, 128)))
    x = embedding_dedup._unit(2 * np.repeat(centre, 200, axis=0) + embedding_dedup._unit(rng.normal(size=(1200, 128))))
    within = x[:200] @ x[:200].T
    assert 0.75 < np.median(within) < 0.85 and np.triu(within, 1).max() < 0.97
    got = embedding_dedup.near_duplicates(frame(spark, [(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string"))
    assert got.where("n_links > 0 OR NOT kept").count() == 0
    # the more vectors there are, the fewer of a topic meet, at the same recall
    meetings = []
    for n in (1200, 1e7):
        layout = embedding_dedup.lay_out(x, np.zeros(1200), n, 0.98)
        keys = layout.keys(x)
        meetings.append(sum((keys[:, t][:, None] == keys[:, t]).sum() - 1200 for t in range(keys.shape[1])))
        for a, b in embedding_dedup.planted(x, 0.98, np.random.default_rng(99)):
            assert (layout.keys(a) == layout.keys(b)).any(axis=1).mean() > 0.995
    assert meetings[1] < 0.3 * meetings[0]


def test_other_lengths_change_nothing(spark):
    rng = np.random.default_rng(9)
    x = embedding_dedup._unit(rng.normal(size=(300, 16)))
    rows = [(i, v.tolist(), "a") for i, v in enumerate(np.concatenate([x, partners(x, 0.985)]))]
    schema = "vec_id long, embedding array<double>, label string"
    alone = embedding_dedup.near_duplicates(frame(spark, rows, schema)).collect()
    other = [(1000, rng.normal(size=64).tolist(), "a"), (1001, rng.normal(size=10_000).tolist(), "a"), (1002, [1.0], "a"), (1003, [2.0], "a"), (1004, [-1.0], "a")]
    other.append((1005, [3 * c for c in other[1][1]], "a"))  # long vectors are folded, not compared folded
    beside = {r["vec_id"]: tuple(r) for r in embedding_dedup.near_duplicates(frame(spark, rows + other, schema)).collect()}
    assert {tuple(r) for r in alone} == {v for k, v in beside.items() if k < 1000}
    assert sum(r["n_links"] for r in alone) >= 600
    assert [beside[1000 + i][1:3] for i in range(6)] == [(0, 1000), (1, 1001), (1, 1002), (1, 1002), (0, 1004), (1, 1001)]


def test_url_filter(spark):
    urls = ["http://EXAMPLE.net/en/x?q", "https://a.example.net/de", "x://b.example.com/de/1", "http://notexample.com/de/1", "http://fr.org/fr/2#a", "http://orgx/fr/", "plain", None, "", "a://b://c/d", "http://host?x/y", "http://casino-bonus.example.org/x", "http://city-library.example.org/books"]
    pages = frame(spark, [(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("path", F.lit("own"))
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.fit(spark)).collect()}
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r, _ in url_filter.RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        if rule:
            assert got[i]["verdict"] == dict(url_filter.RULES)[rule]
    assert got[11]["verdict"] == "block" and got[12]["verdict"] == "allow"


def test_url_grams(spark):
    """Every n-gram of host and path, those of characters beyond 16 bits too; a very long URL is judged whole."""
    parts = [("", ""), ("a", "/"), ("h.example.com", "/a\nb/é漢$^"), ("x😀y", "/😀😀"), ("ab", "/" + "abc" * 50)]
    for r in frame(spark, parts, "h string, p string").select("h", "p", url_filter.grams(F.col("h"), F.col("p")).alias("g")).collect():
        want = [m + s[i : i + n] for m, s in (("h", f"^{r['h']}$"), ("p", f"^{r['p']}$")) for n in url_filter.GRAMS for i in range(max(1, len(s) - n + 1))]
        assert r["g"] == want
    long = "http://a.example.net/en/" + "long-path/" * 30_000
    got = url_filter.judge(frame(spark, [(1, long), (2, long.replace(".net", ".org"))], "page_id long, url string"), url_filter.fit(spark)).collect()
    assert [(r["host"], len(r["path"]), r["rule"]) for r in sorted(got, key=lambda r: r["page_id"])] == [("a.example.net", 300_004, "example.net/en/"), ("a.example.org", 300_004, None)]


def test_url_filter_on_held_out_words(spark):
    """Precision on words and made-up names that were not taught; empty tables."""
    bad, good = url_filter._BAD[::3], url_filter._GOOD[::3]
    taught = url_filter.labelled([w for w in url_filter._BAD if w not in bad], [w for w in url_filter._GOOD if w not in good])
    model = url_filter.fit(spark, taught)
    urls = [*url_filter.labelled(bad, good, 0), *((f"https://www.{w}.{d}/en/12/", 0) for w in url_filter.made_up(300, 99) for d in ("com", "example.org"))]
    got = url_filter.judge(spark.createDataFrame(urls, "url string, y int"), model, rules=()).where("verdict = 'block'")
    right, wrong = got.where("y = 1").count(), got.where("y = 0").count()
    assert right >= 20 and right / (right + wrong) > 0.93
    assert url_filter.judge(spark.createDataFrame([], "id int, url string"), model).count() == 0


def test_url_filter_judges_paths(spark):
    hosts = ["example.org", "www.example.com", "library.example.info", "unseen-place.example.com"]
    paths = {"block": ["casino-bonus/free-pills", "en/payday-loans.html", "2021/online-poker/"], "allow": ["museum/garden", "en/book-review.html", "2021/lighthouse/"]}
    rows = [(100 * i + 10 * j + (want == "block"), f"https://{h}/{p}", want) for want, own in paths.items() for i, h in enumerate(hosts) for j, p in enumerate(own)]
    pages = frame(spark, rows, "page_id long, url string, want string")
    got = url_filter.judge(pages, url_filter.fit(spark)).collect()
    assert sum(r["verdict"] == r["want"] for r in got) >= 22  # of 24, half of them to block


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "", None, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\n\r\n", "b" * 300_000, "<p>a</p>", "c"]
    rows = [(i, f"http://x/{i}\r\n\"é" if i else None, h) for i, h in enumerate(html)]
    pages = frame(spark, rows, "page_id long, url string, html string").withColumn("sha", F.lit("own"))
    files = warc_zip.write_archives(pages, new_path(spark, "archives"), member=1000)
    got = {r["page_id"]: r for r in warc_zip.read_archives(files).collect()}
    assert len(got) == len(rows)
    last = {h or "": i for i, _, h in rows}
    for i, url, h in rows:
        raw, first = (h or "").encode(), last[h or ""]
        r = got[i]
        assert (r["url"], r["payload_bytes"], r["payload_digest"]) == (url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", first))
        assert r["payload"] == (raw if first == i else None)
    assert warc_zip.read_archives(warc_zip.write_archives(pages.limit(0), new_path(spark, "archives"))).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    """Every size and offset of the directory, and its own place, in 64-bit fields."""
    from pyarrow import fs

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 0)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        for k in range(3):
            z.writestr(f"m{k}", b"x" * k + b"data")
    with open(path, "rb") as f:
        assert b"PK\6\6" in f.read()
    with fs.LocalFileSystem().open_input_file(path) as file:
        found = warc_zip.directory(file)
        assert list(found) == ["m0", "m1", "m2"]
        for k in range(3):
            start = warc_zip.data_start(file, found[f"m{k}"])
            file.seek(start)
            assert file.read(found[f"m{k}"][2]) == b"x" * k + b"data"


def test_warc_of_null_and_repeated_ids(spark):
    rows = [(None, None, "same"), (5, "u", "same"), (5, "v", "same"), (2, "w", "same"), (None, "x", None)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc_zip.read_archives(warc_zip.write_archives(pages, new_path(spark, "archives"))).collect())
    assert got == [("2", "revisit", 5), ("5", "response", None), ("5", "response", None), ("None", "response", None), ("None", "response", None)]


def library_ids(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


ODD_TEXTS = ["\n a\n\n b \t c <|endoftext|> ", "Don't stop. \x1c Ünï—中文 <|endoftext|>!\x01 x", "<|EndOfText|> <|startoftext|>", "x\t \ty\r\nz", "ab cd " * 70_000, "q" * 3000]


@pytest.mark.parametrize("bits", [False, True])
def test_token_planes_round_trip(spark, bits):
    ids = library_ids("byte_bpe_50k.json", 0)
    rows = [*corpus(), *((2000 + i, x, None, None, None) for i, x in enumerate(ODD_TEXTS)), (3, "again", None, None, None), (3, "again", None, None, None)]
    docs = frame(spark, [*rows, (None, "no id", None, None, None)]).withColumn("start", F.lit("own"))
    files = token_files.write_ids(docs, new_path(spark, "planes"), vocabulary("byte_bpe_50k.json"), bits=bits)
    got, at = sorted(tuple(r) for r in token_files.read_index(files).collect() if r["doc_id"] is not None), 0
    (none,) = (tuple(r) for r in token_files.read_index(files).where("doc_id IS NULL").collect())
    want = ids("no id")
    assert none == (None, 0, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
    at = len(want)
    assert len(got) == len(rows) and sum(r[2] for r in got) > 2 * token_files.BLOCK
    for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0], r[1] or "")), strict=True):
        want = ids(text)
        assert r == (doc_id, at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)
    assert token_files.read_index(token_files.write_ids(frame(spark, []), new_path(spark, "planes"), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_packing(spark):
    ids = library_ids("word_bpe_49k.json", 1)
    rows = [*corpus(), *((2000 + i, x, None, None, None) for i, x in enumerate(ODD_TEXTS)), (None, "no id", None, None, None)]
    repeats = [(3000, "again and again", None, None, None)] * 3
    docs = frame(spark, rows + repeats).withColumn("offset", F.lit("own"))
    got = packing.pack(docs, vocabulary("word_bpe_49k.json")).collect()
    of_doc, of_seq = defaultdict(list), defaultdict(list)
    for r in got:
        of_doc[r["doc_id"]].append(r)
        of_seq[r["sequence_id"]].append(r)
    assert len(of_doc) == len(rows) + 1 and sum(r["start"] == 0 for r in of_doc.pop(3000)) == 3
    assert max(r["doc_tokens"] for r in got) > packing.SEGMENT
    for doc_id, text, *_ in rows:
        want, at = np.array(ids(text), "<u4"), 0
        for r in sorted(of_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(want[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(want)
    padding = 0
    for pieces in of_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding < 0.05 * sum(r["length"] for r in got)
    assert packing.pack(frame(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_packing_windows_are_cheapest():
    rng = random.Random(2)
    for _ in range(30):
        cuts = [0]
        while len(cuts) < 40:
            cuts.append(cuts[-1] + rng.randint(1, 300))
        penalty = [0, *(rng.choice((0, 4, 24)) for _ in cuts[1:])]

        def price(i, j):
            n = cuts[j] - cuts[i]
            return (0 if n >= 256 and n & (n - 1) == 0 else 1024 - n) + 2 + penalty[j]

        best = [0]
        for j in range(1, len(cuts)):
            best.append(min(best[i] + price(i, j) for i in range(j) if cuts[j] - cuts[i] <= 1024))
        chosen = packing.windows(cuts, penalty, 1024, 2)
        assert chosen[0] == 0 and chosen[-1] == len(cuts) - 1
        assert sum(price(i, j) for i, j in zip(chosen, chosen[1:], strict=False)) == best[-1]


def canonical(text):
    n = lambda x: unicodedata.normalize("NFKC", x)
    return re.sub(r"\s+", " ", n(n(text).casefold())).strip(" ")


def test_fingerprints(spark, monkeypatch):
    rows = [*corpus(), (3000, "ﬁne  Straße", None, None, None), (3001, "FINE strasse", None, None, None), (3001, "FINE strasse", None, None, None)]
    df = frame(spark, rows).withColumn("fingerprint", F.lit("own"))
    got = fingerprint.with_fingerprint(df, "text", "fingerprint", fingerprint.split_buckets(df)).collect()
    by_print, by_text = defaultdict(set), defaultdict(set)
    for r in got:
        by_print[r["fingerprint"]].add(canonical(r["text"] or ""))
        by_text[canonical(r["text"] or "")].add(r["fingerprint"])
    assert len(got) == len(rows) and all(len(x) == 1 for x in [*by_print.values(), *by_text.values()])
    want = {(min(r[0] for r in rows if canonical(r[1] or "") == c), sum(canonical(r[1] or "") == c for r in rows)) for c in by_text}
    assert {(r["group_id"], r["n"]) for r in fingerprint.groups(df).collect()} == want
    assert fingerprint.groups(df.limit(0)).count() == 0
    # a hash that always collides: bytes decide
    monkeypatch.setattr(fingerprint, "wide_hash", lambda col, name: [F.lit(1).cast("long").alias(f"{name}1"), F.lit(2).cast("long").alias(f"{name}2")])
    got = fingerprint.with_fingerprint(df, "text", "fingerprint", fingerprint.split_buckets(df)).collect()
    assert len({r["fingerprint"] for r in got}) == len(by_text)


@pytest.mark.parametrize("collide", [False, True])
def test_edited_texts(spark, tmp_path, monkeypatch, collide):
    """All columns of the query against brute force, also where all hashes of documents collide."""
    rows = sorted([*corpus(), (3000, "twin text", None, None, None), (3001, "TWIN  text", None, None, None), (3002, "é" * 5, None, None, None)])
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    if collide:
        monkeypatch.setattr(fingerprint, "wide_hash", lambda col, name: [F.lit(1).cast("long").alias(f"{name}1"), F.lit(2).cast("long").alias(f"{name}2")])
    got = {r["doc_id"]: r for r in fingerprint.op9_fingerprint(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for (doc_id, text, *_), (_, after, *_) in zip(rows, rows[1:] + rows[:1], strict=True):
        text, after, r = text or "", after or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_next"] == float(canonical(text) == canonical(after)) and r["near_edited"] == float(canonical(text) == canonical(edited))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == bool(r["near_edited"])
    by_text = defaultdict(set)
    for doc_id, text, *_ in rows:
        by_text[text or ""].add(got[doc_id]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_next_rows_of_odd_ids(spark):
    rows = [(None, "b"), (None, "a"), (7, "d"), (7, "c"), (9, None)]
    got = sorted(str(tuple(r)) for r in fingerprint.with_next(frame(spark, rows, "doc_id long, text string")).select("doc_id", "text", "next_text").collect())
    assert got == sorted(map(str, [(None, "a", "b"), (None, "b", "c"), (7, "c", "d"), (7, "d", None), (9, None, "a")]))
    assert fingerprint.with_next(frame(spark, [], "doc_id long, text string")).count() == 0


def test_other_columns_stay(spark):
    names = ["__bucket", "__halo", "row", "id", "halo", "__c", "__f1", "f2", "split", "a.b"]
    rows = [(i, f"text {i % 3}", *range(i, i + len(names))) for i in range(9)]
    wide = frame(spark, rows, "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    got = sorted(map(tuple, fingerprint.with_next(wide).collect()))
    assert got == [(*r, rows[(i + 1) % 9][1]) for i, r in enumerate(rows)]
    out = fingerprint.with_fingerprint(wide, "text", "fingerprint", fingerprint.split_buckets(wide))
    assert out.columns == [*wide.columns, "fingerprint"] and sorted(tuple(r)[:-1] for r in out.collect()) == rows


def test_next_rows(spark):
    rows = sorted(corpus())
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(frame(spark, rows)).collect()}
    assert got == {a[0]: b[1] for a, b in zip(rows, rows[1:] + rows[:1], strict=True)}
