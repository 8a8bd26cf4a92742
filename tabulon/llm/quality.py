"""Document quality from supervised subword embeddings.

Every word and every run of three or four characters is hashed to a row of one
embedding table; a word that repeats the one before it adds one row that all words
share.  A document is the mean of its rows, a softmax over two classes sits
on top, and both are learned by plain stochastic gradient descent in numpy.  Since
everything after the table is linear, a fitted model keeps one number per row, and a
document's score is the mean of these numbers, put through the logistic function.

Fitting reads a bounded sample of labelled documents (``SAMPLE_DOCS``, by hash of the
id); scoring reads every whole text and nothing but the text.

Defined results: a null or empty text has the end mark as its only row, so it gets the
score of a text about which nothing is known; without labelled rows, or with one class
only, every score is the share of label 1, one half if there is none.  A document
labelled twice takes the larger label.  Rows are scored one by one, so ties and
repeated rows need no rule.  Given columns stay; one named ``score`` is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import binaries, extend, mixed, numbers, texts_of, word_hashes

SAMPLE_DOCS = 3000
BUCKETS = 1 << 16
WIDTHS = (3, 4)
DIMENSIONS = 8
STEPS = 18_000
"""Gradient steps of a fit; a small sample is gone through more often."""

RATE = 0.5
SEED = 11

FEATURES = T.StructType([T.StructField("rows", T.BinaryType()), T.StructField("counts", T.BinaryType())])


def buckets_of(text: bytes) -> np.ndarray:
    """Table rows of a text: its words and character runs, the end mark (row 0), a mark per repeated word (row 1)."""
    parts = [np.zeros(1, np.int64)]
    words = word_hashes(text, "spaced")
    if len(words):
        parts.append(_row(words))
        parts.append(np.ones(int((words[1:] == words[:-1]).sum()), np.int64))
        letters = np.frombuffer((" " + text.decode("utf-8", "replace") + " ").encode("utf-32-le"), np.uint32)
        letters = letters.astype(np.uint64)
        for width in WIDTHS:
            n = len(letters) - width + 1
            if n > 0:
                key = np.full(n, width, np.uint64)
                for j in range(width):
                    key *= np.uint64(0x100000001B3)
                    key += letters[j : j + n]
                parts.append(_row(mixed(key)))
    return np.concatenate(parts)


def _row(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS - 2)).astype(np.int64) + 2


@dataclass
class QualityModel:
    """One number per table row: how far it moves the odds of label 1."""

    weights: np.ndarray
    constant: float = 0.0

    def score(self, text: bytes) -> float:
        odds = self.constant + float(self.weights[buckets_of(text)].mean())
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, odds))))


def fit_embeddings(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> QualityModel:
    """Gradient descent over ``(rows, counts, label)``, one document at a time."""
    labels = [y for _, _, y in examples]
    if len(set(labels)) < 2:
        share = min(max(sum(labels) / len(labels) if labels else 0.5, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(BUCKETS, np.float32), math.log(share / (1 - share)))
    random = np.random.default_rng(SEED)
    table = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    top = np.zeros((2, DIMENSIONS), np.float32)
    epochs = -(-STEPS // len(examples))
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in random.permutation(len(examples)):
            rows, counts, label = examples[k]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ table[rows]
            odds = top @ hidden
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ top
            top -= rate * np.outer(p, hidden)
            table[rows] -= rate * share[:, None] * back
    return QualityModel((table @ (top[1] - top[0])).astype(np.float32))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> QualityModel:
    """Fit on at most ``sample`` labelled documents.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, label`` (0 or 1), already cut
    down to the rows that may be learned from.
    """
    chosen = (
        labels.where("doc_id is not null and label in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
    one = F.min_by("text", F.struct(F.xxhash64("text"), F.length("text")))  # of an id with several texts
    known = met.groupBy("doc_id", "label").agg(one.alias("text"))

    def begin():
        def work(column):
            made = [np.unique(buckets_of(x), return_counts=True) for x in texts_of(column)]
            return [
                binaries([r.astype(np.int32).tobytes() for r, _ in made]),
                binaries([c.astype(np.float32).tobytes() for _, c in made]),
            ]

        return work

    rows = extend(known, FEATURES, begin, ["text"]).select("doc_id", "label", "rows", "counts").limit(sample)
    fitted = rows.mapInArrow(_fit_rows, "weights binary, constant double").first()
    return fit_embeddings([]) if fitted is None else QualityModel(np.frombuffer(fitted["weights"], np.float32), fitted["constant"])


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fit, in one task that holds the whole sample; only the model goes to the driver."""
    examples = [
        (r["doc_id"], np.frombuffer(r["rows"], np.int32), np.frombuffer(r["counts"], np.float32), r["label"])
        for b in batches
        for r in b.to_pylist()
    ]
    examples.sort(key=lambda e: (e[0], e[3], len(e[1])))
    model = fit_embeddings([e[1:] for e in examples])
    yield pa.RecordBatch.from_arrays([binaries([model.weights.tobytes()]), numbers([model.constant], np.float64)], names=["weights", "constant"])


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """Append ``score``: the model's probability of label 1 for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin():
        fitted = shared.value
        return lambda column: [numbers([fitted.score(x) for x in texts_of(column)], np.float64)]

    return extend(docs, T.StructType([T.StructField("score", T.DoubleType())]), begin, [text])
