"""Fill-in-middle texts and whitened embeddings against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from helpers import AWKWARD
from pyspark.sql import functions as F

from tabulon.llm import infill, registered, whitening

LINES = re.compile(r"[^\n]*\n|[^\n]+")
TEXTS = ["", None, "\n", "\n\n", "a", "a\n", "a\nb", "é\n中文 x\n½", "x <P> y\n", "<S>", "end <M", "<\n<S\n<M\nP>S>", "one two\nthree  four\n five",
         "a\r\nb\rc\n", "  lead", "don't stop, now!", "\n".join(f"line {k}" for k in range(3000))]


def cut(i, text, units, percent=100, suffix_first=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < suffix_first:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def _units(text, unit):
    text = text or ""
    if unit == "lines":
        return LINES.findall(text)
    if unit == "chars":
        return list(text)
    wordly = lambda c: c.isascii() and c.isalnum() or not c.isascii()
    starts = []
    for k, c in enumerate(text):
        if wordly(c):
            if k == 0 or not wordly(text[k - 1]):
                starts.append(k)
        elif unit == "tokens" and c not in "\n\t\v\f\r ":
            starts.append(k)
    if not text:
        return []
    if not starts:
        return [text]
    edges = [0, *starts[1:], len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("unit", ["lines", "words", "tokens", "chars"])
def test_cuts_against_brute_force(spark, unit):
    draw = random.Random(3)
    made = ["".join(draw.choice("ab é\n\n.,中 \t") for _ in range(draw.randint(0, 90))) for _ in range(300)]
    rows = [*enumerate(TEXTS + made), *AWKWARD, (3, "again\nwith\nan id")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, FORM int").repartition(4)
    got = infill.fill_in_middle(df, unit=unit, percent=70, suffix_first=40)
    assert [c for c in got.columns] == ["doc_id", "text", "n_units", "form", "prefix_chars", "middle_chars", "fim_text"]
    out = got.withColumn("back", infill.restored(F.col("fim_text"), F.col("form"))).collect()
    want = sorted(((i, t, *cut(i, t, _units(t, unit), 70, 40)) for i, t in rows), key=str)
    assert sorted((tuple(r)[:-1] for r in out), key=str) == want
    assert all(r["back"] == (r["text"] or "") for r in out)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}


def test_cuts_of_nothing_and_of_unknown_units(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(df).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(df, unit="pages")


def test_rank_and_select_of_every_class():
    draw = np.random.default_rng(1)
    for n in (1, 63, 64, 65, 1000):
        classes = draw.integers(0, 6, n).astype(np.uint8)
        matrix = infill.WaveletMatrix(classes)
        for c in range(8):
            held = np.flatnonzero(classes == c)
            assert matrix.rank(c, np.arange(n + 1)).tolist() == [int((held < k).sum()) for k in range(n + 1)]
            if len(held):
                assert matrix.select(c, np.arange(len(held))).tolist() == held.tolist()


def _whitened(rows, k=4):
    """``n``, deviations, eigenvalues, shares and whitened values, from a dense covariance."""
    held = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in held)
    x = np.array([[int(np.floor(256 * c)) for c in v] + [0] * (width - len(v)) for _, v in held])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    some = e > 1e-9 * e[0]
    e, u = e[some], u[:, some]
    return n, [i for i, _ in held], ((n * x - s) ** 2).sum(axis=1), e, e / (centred**2).sum() * n, (x - s / n) @ u / np.sqrt(e)


def _check(rows, got):
    n, ids, deviations, e, shares, values = _whitened(rows)
    k = len(e)
    assert len(got) == k * len(ids) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10
    for j in range(k):
        mine = sorted(((r["vec_id"], r["deviation"], r["whitened"]) for r in got if r["component"] == j + 1), key=lambda r: (str(r[0]), r[1], r[2]))
        want = sorted(zip(ids, deviations.tolist(), values[:, j].tolist()), key=lambda r: (str(r[0]), r[1], r[2]))
        turned = sorted(zip(ids, deviations.tolist(), (-values[:, j]).tolist()), key=lambda r: (str(r[0]), r[1], r[2]))
        assert [r[:2] for r in mine] == [r[:2] for r in want]
        a = np.array([r[2] for r in mine])
        assert min(np.abs(a - np.array([r[2] for r in w])).max() for w in (want, turned)) < 1e-9
        assert [r["explained"] for r in got if r["component"] == j + 1] == [pytest.approx(shares[j], rel=1e-11)] * len(ids)


def test_whitening_against_a_dense_solution(spark):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(300, 12)) * np.array([3, 2.5, 2, 1.7, 1.6, 1, 1, 1, 0.5, 0.5, 0.1, 0.1]) + 5
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(500 + k, base[0].tolist()) for k in range(200)]
    rows += [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (None, base[3].tolist()), (904, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, component int").repartition(5)
    _check(rows, whitening.whitened(df).collect())


def test_whitening_of_few_narrow_flat_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    narrow = [(k, [float(k), float(k * k % 7)]) for k in range(20)]
    _check(narrow, whitening.whitened(spark.createDataFrame(narrow, schema)).collect())
    line = [(k, [float(k), 2.0 * k, -float(k)]) for k in range(9)]
    _check(line, whitening.whitened(spark.createDataFrame(line, schema)).collect())
    two = [(1, [0.0] * 6), (2, [1.0] * 6), (3, [1.0] * 6)]
    _check(two, whitening.whitened(spark.createDataFrame(two, schema)).collect())
    for rows in ([(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, None)], [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0


def test_pairs_of_close_and_equal_eigenvalues():
    draw = np.random.default_rng(3)
    for values in ([5, 4, 3 + 1e-6, 3, 3 - 1e-6, 1] + [0.5] * 60, [2, 2, 2, 2, 2, 1] + [0.1] * 20, np.exp(-np.arange(80) / 40), [1.0] * 30, [1, 0, 0, 0, 0, 0, 0]):
        values = np.array(values, float)
        q, _ = np.linalg.qr(draw.normal(size=(len(values), len(values))))
        matrix = (q * values) @ q.T
        calls = []
        e, u = whitening.leading_pairs(lambda b: (calls.append(b.shape), matrix @ b)[1], len(values), 4)  # noqa: B023
        assert np.allclose(e, np.sort(values)[::-1][:4], atol=1e-12) and np.abs(u.T @ u - np.eye(4)).max() < 1e-12
        assert np.linalg.norm(matrix @ u - u * e) < 1e-11 and len(calls) < 400


def test_queries_on_given_tables(spark, sf):
    rows = [tuple(r) for r in registered.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    _check(rows, registered.op12_whitening(spark, sf).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = set()
    for i, t in registered.table(spark, sf, "documents").select("doc_id", "text").collect():
        *head, out = cut(i, t, _units(t, "lines"))
        want.add((i, *head, sha(out), sha(t or "")))
    assert {tuple(r) for r in registered.op11_fill_in_middle(spark, sf).collect()} == want
