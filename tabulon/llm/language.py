"""Language of a document by sparse logistic regression on character runs.

Runs of one to three lower-cased characters are hashed to columns; a text is the
TF-IDF vector of its runs at length 1.  Document frequencies count every document
that may be learned from.  The weights come from follow-the-regularised-leader with an
elastic-net penalty, over a bounded sample of documents per language; a fifth of that
sample is kept back to fit one temperature, so that scores can be read as
probabilities.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is
every text if nothing can be learned.  With one language known, that is the answer
with score 1.  Equal scores go to the language first in the alphabet.  Repeated rows
are judged one by one.  Given columns stay; one named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import extend, mixed, small_batches, texts_of

PER_LANGUAGE = 600
SPARE = 4
SAMPLE_DOCS = 6000
COLUMNS = 1 << 14
WIDTHS = (1, 2, 3)
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

LETTER = regex.compile(r"\p{L}")
COUNTS = T.StructType([T.StructField("column", T.IntegerType()), T.StructField("docs", T.LongType())])
FEATURES = T.StructType([T.StructField("columns", T.BinaryType()), T.StructField("counts", T.BinaryType())])
GUESS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def run_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a text's character runs and how often each occurs."""
    letters = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32).astype(np.uint64)
    found = []
    for width in WIDTHS:
        n = len(letters) - width + 1
        if n > 0:
            key = np.full(n, width, np.uint64)
            for j in range(width):
                key *= np.uint64(0x100000001B3)
                key += letters[j : j + n]
            found.append(mixed(key) % np.uint64(COLUMNS))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=COLUMNS)
    columns = np.flatnonzero(counts)
    return columns, counts[columns]


@dataclass
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # columns x languages
    temperature: float = 1.0

    def vector(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[columns]
        return x / (np.sqrt((x * x).sum()) or 1.0)

    def guess(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.names or not LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0
        columns, counts = run_counts(text)
        odds = self.vector(columns, counts) @ self.weights[columns] / self.temperature
        p = np.exp(odds - odds.max())
        best = int(p.argmax())
        return self.names[best], float(p[best] / p.sum())


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each column occurs, and the number of documents; over all rows."""
    small_batches(docs.sparkSession)

    def count(batches):
        total, rows = np.zeros(COLUMNS, np.int64), 0
        for b in batches:
            for x in texts_of(b.column(0)):
                total[run_counts(x)[0]] += 1
            rows += b.num_rows
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(total[used], rows))], names=["column", "docs"]
        )

    sums = docs.select(text).mapInArrow(count, COUNTS).groupBy("column").agg(F.sum("docs").alias("docs"))
    out, n = np.zeros(COLUMNS, np.int64), 0
    for r in sums.collect():  # at most COLUMNS + 1 rows
        if r["column"] < 0:
            n = r["docs"]
        else:
            out[r["column"]] = r["docs"]
    return out, n


def fit_weights(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], classes: int) -> np.ndarray:
    """Follow the regularised leader, one example after another."""
    z = np.zeros((COLUMNS, classes))
    n = np.zeros((COLUMNS, classes))

    def leader(zs, ns):
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    random = np.random.default_rng(5)
    for _ in range(EPOCHS):
        for k in random.permutation(len(xs)):
            columns, x = xs[k]
            w = leader(z[columns], n[columns])
            odds = x @ w
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[ys[k]] -= 1
            g = np.outer(x, p)
            before = n[columns]
            after = before + g * g
            z[columns] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[columns] = after
    return leader(z, n)


def fit_temperature(odds: np.ndarray, ys: np.ndarray) -> float:
    """The temperature with the smallest log loss on kept-back examples (golden section).

    One example's worth of doubt is spread over the languages, so that a sample
    without errors does not make the scores certain.
    """
    if not len(ys):
        return 1.0
    doubt = 1.0 / (len(ys) + 2)
    wanted = np.full(odds.shape, doubt / odds.shape[1])
    wanted[np.arange(len(ys)), ys] += 1 - doubt

    def loss(t: float) -> float:
        s = odds / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - (wanted * s).sum(axis=1)).mean())

    low, high, ratio = -5.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE_DOCS) -> LanguageModel:
    """Fit on ``doc_id, text, lang`` rows that may be learned from.

    Document frequencies read all of them; the weights at most ``per_language`` rows
    of a language and ``sample`` in all, by hash of the id.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    frequency, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    ids = known.select("doc_id", "lang").distinct()
    many = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # about SPARE times the wanted rows of a language are ranked, however many there are
    near = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < F.lit(float(SPARE * per_language << 30)) / F.col("n")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = (
        ids.join(many, "lang")
        .where(near)
        .select("doc_id", "lang", F.row_number().over(order).alias("place"))
        .where(F.col("place") <= per_language)
        .orderBy("place", "lang")
        .limit(sample)
    )
    met = known.join(F.broadcast(chosen.drop("place")), ["doc_id", "lang"])  # at most ``sample`` rows
    held = met.groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))

    def begin():
        def work(column):
            made = [run_counts(x) for x in texts_of(column)]
            return [
                pa.array([c.astype(np.int32).tobytes() for c, _ in made], pa.binary()),
                pa.array([v.astype(np.int32).tobytes() for _, v in made], pa.binary()),
            ]

        return work

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (r["doc_id"], r["lang"], np.frombuffer(r["columns"], np.int32), np.frombuffer(r["counts"], np.int32))
            for b in batches
            for r in b.to_pylist()
        ]
        model = _fit_rows(rows, idf)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.names], pa.list_(pa.string())), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.temperature])],
            names=["names", "weights", "temperature"],
        )

    features = extend(held, FEATURES, begin, ["text"]).drop("text").repartition(1)  # the whole sample, for one task
    made = features.mapInArrow(fit, "names array<string>, weights binary, temperature double").first()
    if made is None:
        return _fit_rows([], idf)
    weights = np.frombuffer(made["weights"], float).reshape(COLUMNS, -1)
    return LanguageModel(list(made["names"]), idf, weights, made["temperature"])


def _fit_rows(rows: list[tuple], idf: np.ndarray) -> LanguageModel:
    """The model of a sample: a fifth is kept back for the temperature."""
    rows.sort(key=lambda r: (r[1], r[0]))
    names = sorted({r[1] for r in rows})
    model = LanguageModel(names, idf, np.zeros((COLUMNS, max(1, len(names)))))
    xs = [(c, model.vector(c, v)) for _, _, c, v in rows]
    ys = [names.index(r[1]) for r in rows]
    back = [k for k in range(len(rows)) if k % 5 == 0]
    learn = [k for k in range(len(rows)) if k % 5]
    if names:
        model.weights = fit_weights([xs[k] for k in learn], [ys[k] for k in learn], len(names))
        odds = np.array([xs[k][1] @ model.weights[xs[k][0]] for k in back])
        model.temperature = fit_temperature(odds, np.array([ys[k] for k in back]))
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score`` for each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin():
        fitted = shared.value

        def work(column):
            made = [fitted.guess(x) for x in column.cast(pa.binary()).to_pylist()]
            return [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())]

        return work

    return extend(docs, GUESS, begin, [text])
