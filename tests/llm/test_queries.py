"""Queries without SQL, run on the given tables and compared column by column."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
from helpers import components, shingles

from tabulon.llm import language, quality, registered


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [tuple(r) for r in registered.table(spark, sf, "documents").select("doc_id", "text", "lang").collect()]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def encoded(documents):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(registered.vocabulary())
    ids = {d: reference.encode(t or "", add_special_tokens=False).ids for d, t, _ in documents}
    return reference, ids


def test_ids_and_decoded_texts(spark, sf, encoded):
    reference, ids = encoded
    want = {(d, len(i), _sha(",".join(map(str, i))), _sha(reference.decode(i, skip_special_tokens=False))) for d, i in ids.items()}
    assert {tuple(r) for r in registered.op1_bpe(spark, sf).collect()} == want


def test_context_limits(spark, sf, encoded):
    lengths = sorted(len(i) for i in encoded[1].values())
    got = {r["n_tokens"]: r for r in registered.op9_token_counts(spark, sf).collect()}
    assert set(got) == set(lengths)
    for n, docs in collections.Counter(lengths).items():
        r = got[n]
        assert (r["n_docs"], r["docs_over"], r["tokens_all"]) == (docs, sum(x > n for x in lengths), sum(lengths))
        assert r["tokens_kept"] == sum(min(x, n) for x in lengths) and r["tokens_whole"] == sum(x for x in lengths if x <= n)
        assert r["share_fitting"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))


def test_components_of_near_copies(spark, sf, documents):
    texts = {d: t or "" for d, t, _ in documents}
    root, sizes = components(texts)
    want = {(d, sizes[d], root[d], root[d] == d) for d in texts}
    assert {tuple(r) for r in registered.op10_near_duplicates(spark, sf).collect()} == want and any(shingles(t) for t in texts.values())


def test_quality_of_held_out_documents(spark, sf, documents):
    labels = {r["doc_id"]: r["quality"] for r in registered.table(spark, sf, "labels").collect()}
    rows = registered.op5_quality(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d for d, *_ in documents)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    pairs = [(a > b) + (a == b) / 2 for a in good for b in bad]
    assert not pairs or sum(pairs) / len(pairs) > 0.9


def test_language_of_held_out_documents(spark, sf, documents):
    langs = {d: x for d, _, x in documents}
    rows = registered.op8_language(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(langs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"] and langs[r["doc_id"]]]
    assert sum(held) / len(held) > 0.95


def test_fits_do_not_depend_on_the_order_of_rows_with_one_id(spark):
    rows = [(k // 2, f"{'alpha beta' if k % 3 else 'gamma ### delta'} number {k} here", "en" if k % 3 else "xx") for k in range(120)]
    tables = [spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n) for x, n in ((rows, 2), (rows[::-1], 5))]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, label int")
    a, b = (quality.fit_quality(t, labels).weights for t in tables)
    assert (a == b).all()
    a, b = (language.fit_language(t) for t in tables)
    assert a.names == b.names and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_equal_language_scores_go_to_the_first_of_the_alphabet(spark):
    same = [(k, "same words in both", lang) for k, lang in enumerate(["zz", "aa"] * 20)]
    model = language.fit_language(spark.createDataFrame(same, "doc_id long, text string, lang string"))
    model.weights = model.weights * 0
    assert model.guess("same words".encode())[0] == "aa"
