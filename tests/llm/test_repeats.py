"""Repeated strings against brute force."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from helpers import AWKWARD

from tabulon.llm import registered, repeats


def brute(rows, least):
    """``(id, n_bytes, n_removed, n_spans, kept_sha256)`` from a count of all strings of ``least`` bytes."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(x[p : p + least] for _, x in data for p in range(len(x) - least + 1))
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for p in range(len(x) - least + 1):
            if seen[x[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _rows(seed, least):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(least // 3) for _ in range(4)]
    rows = [(k, text(draw.randint(0, 60))) for k in range(40)]
    for k in range(40, 90):
        parts = [draw.choice(shared) if draw.random() < 0.4 else text(draw.randint(1, 12)) for _ in range(draw.randint(1, 6))]
        rows.append((k, draw.choice(["", " ", "x"]).join(parts)))
    base = text(150)
    for k in range(90, 120):  # near copies: a place or two changed
        words = base.split()
        for _ in range(draw.randint(0, 2)):
            words[draw.randrange(len(words))] = word()
        rows.append((k, " ".join(words)))
    line = text(least // 4)
    rows += [(120 + k, text(5) + line + text(5)) for k in range(60)]
    rows += [(200, "ab" * 3 * least), (201, "a" * (least + 3)), (202, "a" * (least - 1)), (203, "z" * least), (204, "z" * least)]
    rows += [(205, rows[7][1]), (205, rows[7][1]), (7, rows[9][1])]
    return rows + AWKWARD


@pytest.mark.parametrize("least, seed", [(8, 1), (24, 2), (24, 3), (200, 4)])
def test_repeats_against_brute_force(spark, least, seed):
    rows = _rows(seed, least)
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n_removed int, K1 string").repartition(5)
    got = sorted(map(tuple, repeats.repeat_digests(df, least=least).collect()), key=str)
    assert got == brute(rows, least)


def test_repeats_where_many_runs_share_an_anchor(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MANY_KINDS", 2)
    monkeypatch.setattr(repeats, "BUCKET_ROWS", 30)
    monkeypatch.setattr(repeats, "PIECE", 100)
    rows = _rows(5, 24)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, repeats.repeat_digests(df, least=24).collect()), key=str) == brute(rows, 24)


def test_texts_without_repeats(spark):
    rows = [(1, "0123456789 first 0123456789"), (2, "0123456789 ab"), (3, None), (4, "same same same"), (4, "same same same")]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, Kept binary")
    got = sorted(((r["doc_id"], r["text"], bytes(r["kept"]), r["n_spans"]) for r in repeats.without_repeats(df, least=10).collect()), key=str)
    assert got == [
        (1, rows[0][1], b"first ", 2), (2, rows[1][1], b"ab", 1), (3, None, b"", 0), (4, rows[3][1], b"", 1), (4, rows[3][1], b"", 1)
    ]
    assert repeats.without_repeats(df.where("false")).count() == 0 and repeats.repeat_digests(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(df, least=2000)


def test_query_on_given_documents(spark, sf):
    rows = [tuple(r) for r in registered.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted(map(tuple, registered.op13_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows, 200) and any(r[2] for r in got)
