"""Classifiers, placement, URL rules, top-k search and the pipeline: awkward rows, brute force, held-out accuracy."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, components, hits, secrets, without_hits
from pyspark.sql import functions as F

import corpus_pipeline
from tabulon.llm import graph, language, near_duplicates, quality, registered, sharding, topk, url_filter

SCHEMA = "doc_id long, text string"


def _quality_rows(n=160):
    draw = random.Random(1)
    word = lambda: "".join(draw.choice("aeioutrns") for _ in range(draw.randint(2, 8)))
    rows = []
    for k in range(n):
        bad = k % 4 == 0
        words = [word() + ("###" if bad else "") for _ in range(draw.randint(3, 60))]
        rows.append((k, " ".join(words), 0 if bad else 1))
    return rows


def test_quality_learns_and_takes_awkward_rows(spark):
    rows = _quality_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], SCHEMA)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows[:100]] + [(0, 1), (None, 1), (5, None), (6, 7)], "doc_id long, label int")
    model = quality.fit_quality(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert all((scored[d] >= 0.7) == (y == 1) for d, _, y in rows[100:])
    odd = quality.score_quality(spark.createDataFrame([(d, t, "x") for d, t in AWKWARD], SCHEMA + ", Score string"), model)
    out = odd.collect()
    assert len(out) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if not (r["text"] or "").strip()}) == 1
    assert quality.score_quality(docs.where("false"), model).count() == 0


def test_quality_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, label int")
    assert quality.fit_quality(docs, labels).score(b"x") > 0.99
    assert quality.fit_quality(docs, labels.where("false")).score(b"x") == pytest.approx(0.5)


LINES = {
    "en": "the cat sat on the mat and then it went with the other thing",
    "de": "der Hund und die Katze sind nicht über das große Haus gegangen",
    "fr": "le chat était sur la table et ça ne va pas très bien aujourd'hui",
}


def test_language_learns_and_takes_awkward_rows(spark):
    draw = random.Random(2)
    rows = []
    for k in range(90):
        name = sorted(LINES)[k % 3]
        words = LINES[name].split()
        draw.shuffle(words)
        rows.append((k, " ".join(words[: draw.randint(6, 12)]), name))
    docs = spark.createDataFrame(rows + [(200, None, "en"), (201, "rien", None)], SCHEMA + ", lang string")
    model = language.fit_language(docs.where("doc_id >= 30"))
    out = language.identify(docs, model).where("doc_id < 30").collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in out)
    odd = spark.createDataFrame([(d, t, 1) for d, t in AWKWARD], SCHEMA + ", LANG_PRED int")
    for r in language.identify(odd, model).collect():
        letters = re.search(r"[^\W\d_]", r["text"] or "")
        assert (r["lang_pred"] == "und" and r["score"] == 0) == (not letters)
    nothing = language.fit_language(docs.where("false"))
    assert {tuple(r) for r in language.identify(docs, nothing).select("lang_pred", "score").collect()} == {("und", 0.0)}


def test_document_frequencies_count_every_row(spark):
    docs = spark.createDataFrame([("aab",), ("ba",), ("",), (None,)], "text string")
    found, n = language.document_frequencies(docs.repartition(3))
    assert n == 4
    want = np.zeros(language.COLUMNS, np.int64)
    for t in (b"aab", b"ba"):
        want[language.run_counts(t)[0]] += 1
    assert (found == want).all()


def test_temperature_is_the_best_of_a_grid():
    draw = np.random.default_rng(3)
    ys = draw.integers(0, 3, 200)
    odds = draw.normal(size=(200, 3)) * 4
    odds[np.arange(200), ys] += 3
    got = language.fit_temperature(odds, ys)

    def loss(t):
        s = odds / t
        return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(200), ys]).mean())

    assert loss(got) < min(loss(t) for t in (0.2, 0.5, 5.0, 20.0)) and 0.5 < got < 10


def test_slots_by_the_letter_of_the_method():
    names = ["a", "b", "c"]
    got = sharding.fill_slots(names, 13)
    start = {s: sharding._number("start:" + s) % 13 for s in names}
    step = {s: sharding._number("step:" + s) % 12 + 1 for s in names}
    order = {s: [(start[s] + k * step[s]) % 13 for k in range(13)] for s in names}
    want: dict[int, int] = {}
    while len(want) < 13:
        for k, s in enumerate(names):
            if len(want) < 13:
                want[next(p for p in order[s] if p not in want)] = k
    assert got == [want[k] for k in range(13)]
    counts = np.bincount(sharding.fill_slots())
    assert counts.max() - counts.min() <= 1 and counts.sum() == sharding.SLOTS
    fewer = sharding.fill_slots(sharding.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(sharding.fill_slots(), fewer))
    assert moved < 0.1 * sharding.SLOTS
    for bad in (dict(slots=12), dict(shards=["a", "a"]), dict(shards=[])):
        with pytest.raises(ValueError):
            sharding.fill_slots(**bad)


def test_placement_of_awkward_keys(spark, tmp_path):
    rows = [(str(k), k, "s") for k in range(300)] + [("1", 7, "s"), ("", 8, "s"), ("", 9, "s")]
    rows += [(None, k, "s") for k in range(200)]
    df = spark.createDataFrame(rows, "key string, n int, Shard string")
    out = sharding.place(df, "key").collect()
    assert len(out) == len(rows)
    by_key = {}
    for r in out:
        if r["key"] is not None:
            assert by_key.setdefault(r["key"], r["shard"]) == r["shard"]
    assert len({r["shard"] for r in out if r["key"] is None}) > 30
    assert sharding.place(df.where("false"), "key").count() == 0
    sharding.write_shards(df, str(tmp_path / "out"), "key", files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


URLS = [
    None, "", "no scheme", "http://", "http://Example.COM", "http://example.com/", "http://www.example.com/en/1?x=/de/",
    "https://m.example.com/en/1", "http://example.com/EN/1", "http://notexample.com/en/1", "http://a.net/es/2#/fr/",
    "http://a.net/fr/", "http://a.net/fr", "http://spam-farm.org/x", "http://x.spam-farm.org", "http://spam-farms.org/",
    "http://a.org/login", "http://a.org/login/x", "http://a.org/loginx", "http://a.org/wp-login?x", "http://a.org:80/cart",
    "ftp://u://v/es/", "http://a.net?/es/", "x" * 20_000 + "://a.net/es/", "http://spam-farm.com/x", "http://a\nb.net/es/\n",
]


def _judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = []
    for r in url_filter.PLACE_RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(r.text), r.text, r.verdict))
    if fits:
        return host, path, *max(fits)[1:]
    spam = re.search(r"(^|\.)(spam-farm|cheap-pills|ads-track|casino-win|adult-x|free-bets)\.", host)
    machine = re.search(r"/(wp-login|cart|login|search)([^0-9A-Za-z]|\Z)", path)
    return host, path, None, "block" if spam or machine else "allow"


def test_url_verdicts_against_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS + URLS[:8])], "page_id long, url string, Host string")
    out = url_filter.judge_urls(pages).collect()
    assert len(out) == len(URLS) + 8
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == _judged(r["url"]), r["url"]
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [url_filter.pattern_rule("block", p) for p in ("||ads.example.", "*banner*", "*/x/y/")]
    index = url_filter.RuleIndex(rules, {"ads": 1, "example": 50, "x": 9, "y": 3})
    assert {t: [r.text for r, _ in held] for t, held in index.filed.items()} == {
        "ads": ["||ads.example."], "": ["*banner*"], "y": ["*/x/y/"],
    }
    assert index.judge("a.org", "/mybanners") == (None, "block") and index.judge("myads.example.org", "/") == (None, "allow")


VECTORS = [
    (0, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, None), (3, [0.1, None, 0.2]), (4, [float("nan"), 0.0, 1.0]),
    (5, [float("inf"), 0.0, 0.0]), (6, []), (7, [1.0]), (20, [-1.0, 2.0, 0.3]), (None, [9.0, 9.0, 9.0]), (1, [0.5, -0.25, 1.0]),
]


def _nearest(rows, k):
    held = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, q in held:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in held if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("k", [1, 3, 20])
def test_top_k_of_awkward_vectors(spark, k):
    df = spark.createDataFrame([(*r, 1) for r in VECTORS], "vec_id long, embedding array<double>, rank int")
    asks = F.col("vec_id") % 20 == 0
    got = topk.top_k(df, asks, k).collect()
    assert sorted(map(tuple, got)) == sorted(_nearest(VECTORS, k))
    assert topk.top_k(df.where("false"), asks, k).count() == 0
    assert topk.top_k(df.where("vec_id = 7"), asks, k).count() == 0


def test_top_k_in_many_blocks_with_copies_and_large_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 150)
    draw = np.random.default_rng(4)
    rows = [(k, draw.normal(size=8).tolist()) for k in range(400)] + [(1000 + k, [0.25] * 8) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()}
    assert got == _nearest(rows, 20)
    large = [(k, [float(x) * 1e7 for x in v]) for k, v in rows[:60]]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame(large, df.schema), F.col("vec_id") % 20 == 0, 5).collect()}
    assert got == _nearest(large, 5)


def test_index_proves_what_it_leaves_out():
    draw = np.random.default_rng(5)
    vectors = draw.integers(-30, 30, (3000, 12)).astype(float)
    index = topk.SegmentIndex(vectors)
    for q in vectors[:25]:
        left = index.possible(q, 20)
        assert set(np.argsort(-(vectors @ q), kind="stable")[:20]) <= set(left)


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101 + k) for k in range(50)] + [(200, 199), (199, 200), (300, 300)]
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {out[k] for k in range(41)} == {0} and {out[100 + k] for k in range(51)} == {100}
    assert out[199] == out[200] == 199 and len(out) == 41 + 51 + 2
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB_EDGES", 5)
    draw = random.Random(8)
    edges = [(50, k) for k in range(60)] + [(1000, 70 + k) for k in range(40)] + [(500 + k, 501 + k) for k in range(9)]
    edges += [(draw.randrange(2000, 2100), draw.randrange(2000, 2100)) for _ in range(90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    out = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    """Documents of all kinds that the stages act on, with the other tables they read."""
    root = tmp_path_factory.mktemp("corpus")
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("aeioutrnsl") for _ in range(draw.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(20)) for k in range(5)]
    rows = [(k, text(draw.randint(20, 90))) for k in range(120)]
    rows += [(200 + k, " ".join(w + "###" for w in text(40).split())) for k in range(40)]
    rows += [(300, rows[3][1]), (301, rows[4][1] + " extra"), (302, text(30) + " " + items[0][1] + " " + text(30))]
    inner = items[3][1].split()
    rows += [(307, text(40)), (309, text(50)), (309, text(60)), (310, rows[5][1]), (310, text(45))]
    rows += [(308, text(900) + " " + " ".join(inner[:10]) + " " + items[2][1] + " " + " ".join(inner[10:]) + " " + text(9))]
    rows += [(311, text(30))] * 3
    rows += [(303, text(900) + " " + items[1][1]), (304, text(30) + " password=abcdefgh12 " + text(9)), (305, "")]
    docs = [(d, t, "en", "s", len(t)) for d, t in rows] + [(306, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    marks = [(d, 0 if 200 <= d < 300 else 1, 0) for d, _ in rows if d < 300]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), [(d, t) for d, t, *_ in docs], [t for _, t in items]


def test_pipeline_against_brute_force(spark, small_corpus):
    root, rows, items = small_corpus
    out = [(r["doc_id"], list(r["ids"]), r["exact"]) for r in corpus_pipeline.run(spark, root).collect()]
    labels = registered.table(spark, root, "labels").select("doc_id", F.col("quality").alias("label"))
    documents = registered.table(spark, root, "documents")
    scored = quality.score_quality(documents, quality.fit_quality(documents, labels.where(registered.remainder(4) != 2)))
    kept = {(r["doc_id"], r["text"]) for r in scored.where("score >= 0.7").select("doc_id", "text").collect()}
    assert {d for d, _ in kept if d < 200} == set(range(120)) and not {d for d, _ in kept if 200 <= d < 300}
    known = dict(enumerate(sorted(kept, key=lambda r: (r[0], r[1] or ""))))  # rows equal in all columns are one
    root_of, _ = components({k: t for k, (_, t) in known.items()})
    known = {k: r for k, r in known.items() if known[root_of[k]][0] == r[0]}
    left = []
    for d, t in known.values():
        words, marked, _ = hits(t, items)
        if not (marked and 20 * len(marked) >= len(words)):
            left.append((d, without_hits(t or "", items)))
    assert sorted(d for d, *_ in out) == sorted(d for d, _ in left)
    ids = [d for d, *_ in out]
    assert not {300, 301, 302} & set(ids) and {303, 307, 308} <= set(ids) and [ids.count(d) for d in (309, 310, 311)] == [2, 1, 1]
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(registered.vocabulary())
    want = []
    for d, t in left:
        assert not hits(t, items)[1]
        for _, a, b in reversed(secrets(t)):
            t = t[:a] + "[secret]" + t[b:]
        want.append((d, reference.encode(t, add_special_tokens=False).ids, True))
    assert sorted(out) == sorted(want)


def test_near_copies_by_text_where_ids_repeat(spark):
    draw = random.Random(12)
    a, b, c = (" ".join("".join(draw.choice("aeioutrns") for _ in range(5)) for _ in range(60)) for _ in range(3))
    rows = [(3, a, 1), (5, a + " more", 1), (5, b, 1), (7, c, 1), (7, c, 1), (7, c, 2), (8, c, 1), (None, a, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 int")
    got = sorted(((r[0], r[2], r[3]) for r in near_duplicates.near_duplicates(df).collect()), key=str)
    assert got == sorted([(3, 3, True), (5, 3, False), (5, 5, True), *[(7, 7, True)] * 3, (8, 7, False), (None, None, True)], key=str)
    left = near_duplicates.without_near_duplicates(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[5], rows[7]], key=str)
    assert near_duplicates.without_near_duplicates(df.where("false")).count() == 0


def test_stages_keep_the_columns_of_documents(spark, small_corpus):
    root = small_corpus[0]
    docs = registered.table(spark, root, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, root)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    empty = registered.table(spark, root, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).count() == 0
