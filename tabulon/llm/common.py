"""What the text operators share: Arrow batches that keep the given columns, and word hashes."""

from __future__ import annotations

import ctypes
import ctypes.util
import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 512
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once; documents are large rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return what a finished task freed to the machine; workers stay alive and wait beside others."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(libc), "malloc_trim", None) if libc else None
    if trim is not None:
        trim(0)


def extend(df: DataFrame, added: T.StructType, begin: Callable[[], Callable], reads: Sequence[str]) -> DataFrame:
    """Append columns computed from whole Arrow batches.

    ``begin()`` runs once per task and returns a function from the arrays of the
    columns ``reads`` to the arrays of ``added``.  Given columns stay as they are;
    one with the name of an added column (in any case) is replaced.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in added}
    kept = [i for i, f in enumerate(df.schema) if f.name.lower() not in new]
    place = [_place(df, c) for c in reads]
    schema = T.StructType([df.schema[i] for i in kept] + list(added))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = begin()
        for b in batches:
            made = work(*[b.column(i) for i in place])
            columns = [b.column(i) for i in kept] + list(made)
            yield pa.RecordBatch.from_arrays(
                [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow
            )
            del b, made, columns
        del work
        give_back()

    return df.mapInArrow(run, schema)


def _place(df: DataFrame, name: str) -> int:
    for i, c in enumerate(df.columns):
        if c.lower() == name.lower():
            return i
    raise ValueError(f"no column {name}; there are {', '.join(df.columns)}")


# Arrow arrays from buffers: ``pa.array`` loads pandas, some 25 MB in every worker of every executor.


def numbers(values: Sequence | np.ndarray, kind: type = np.int64) -> pa.Array:
    """An array of numbers without nulls."""
    held = np.ascontiguousarray(values, kind)
    return pa.Array.from_buffers(pa.from_numpy_dtype(held.dtype), len(held), [None, pa.py_buffer(held)])


def binaries(values: Sequence[bytes | None], kind: pa.DataType = pa.binary()) -> pa.Array:
    """An array of bytes, or of texts given as UTF-8; None is null."""
    ends = _ends([len(x or b"") for x in values])
    joined = b"".join([x or b"" for x in values])
    return pa.Array.from_buffers(kind, len(values), [_valid([x is not None for x in values]), ends, pa.py_buffer(joined)])


def lists(lengths: Sequence[int | None], values: pa.Array) -> pa.Array:
    """An array of lists of so many values each; None is null."""
    ends, valid = _ends([n or 0 for n in lengths]), _valid([n is not None for n in lengths])
    return pa.Array.from_buffers(pa.list_(values.type), len(lengths), [valid, ends], children=[values])


def _ends(lengths: Sequence[int]) -> pa.Buffer:
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("the values of one batch take more than 2 GB")
    return pa.py_buffer(ends.astype(np.int32))


def _valid(known: Sequence[bool]) -> pa.Buffer | None:
    return None if all(known) else pa.py_buffer(np.packbits(np.array(known, bool), bitorder="little"))


def content_keys(text: str) -> list[Column]:
    """Two hashes, ``k1`` and ``k2``, that name a content; null reads as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2")]


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null reads as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


MAP_WORDS = 1 << 18
"""Most rows of a broadcast bit map, 2 MB of bits."""


def marked_likely(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Adds ``_maybe``: whether a row's ``key`` may be among the wanted ones, without a shuffle of ``df``.

    Wanted keys set bits in a map, sized by their number up to a bound, which is broadcast.
    A bit that two keys share marks a row too many, so an exact step has to follow; beyond
    the bound more and more rows are marked, and none is missed.
    """
    words = min(MAP_WORDS, max(64, wanted.count() // 4))
    word, bit = F.expr(f"pmod(xxhash64(`{key}`), {words}L)"), F.expr(f"cast(shiftright(xxhash64(`{key}`), 40) & 63 as int)")
    bits = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")
    )
    found = df.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")  # at most MAP_WORDS rows
    inside = F.expr(f"(_bits & shiftleft(1L, cast(shiftright(xxhash64(`{key}`), 40) & 63 as int))) != 0")
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(inside, F.lit(False)).alias("_maybe"))


def likely(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among the wanted ones, without a shuffle of ``df``."""
    return marked_likely(df, wanted, key).where("_maybe").drop("_maybe")


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers one to one, so that near inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_KEYS = np.zeros(0, np.uint64)


def position_keys(n: int) -> np.ndarray:
    """A random odd multiplier for every position in a word, the same on every machine."""
    global _KEYS
    if len(_KEYS) < n:
        _KEYS = mixed(np.arange(1, max(n, 256) * 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _KEYS


@functools.lru_cache(maxsize=8)
def byte_classes(kind: str) -> bytes:
    """Byte table: A-Z lower-cased, bytes outside a word turned into a blank.

    ``spaced``: a word is a run without ASCII white space.  ``plain``: a word is a
    run of digits, letters and bytes of non-ASCII characters.
    """
    table = bytearray(range(256))
    for c in range(65, 91):
        table[c] = c + 32
    if kind == "spaced":
        blank = [32, *range(9, 14)]
    else:
        blank = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
    for c in blank:
        table[c] = 32
    return bytes(table)


def word_hashes(text: bytes, kind: str) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    a = np.frombuffer(text.translate(byte_classes(kind)), np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64)
    inside = a != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    letters = a[inside].astype(np.uint64)
    letters += np.uint64(1)
    first = np.cumsum(lengths) - lengths
    keys = position_keys(int(lengths.max()) + 1)
    letters *= keys[np.arange(len(letters)) - np.repeat(first, lengths)]
    return mixed(np.add.reduceat(letters, first) + lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_set(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; fewer words are one run."""
    if not len(words):
        return words
    n = len(words) - min(width, len(words)) + 1
    runs = np.zeros(n, np.uint64)
    for j in range(min(width, len(words))):
        runs = mixed(runs * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n])
    if len(words) < width:  # a short text never equals a part of a longer one
        runs = mixed(runs + np.uint64(len(words)))
    return np.unique(runs)
