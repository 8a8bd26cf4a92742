"""Cutting out every byte string of a given length that stands in the corpus more than once.

Suffixes are told apart by prefix doubling: the rank of the first 2h bytes at a position
is the pair of the ranks of h bytes there and h bytes further on.  A position is dropped
as soon as its rank is unique and is a repeat once ranks cover ``least`` bytes.  Ranks are
64-bit fingerprints of pairs, so a task doubles them in its own texts without asking
others; Spark groups ranks with positions where it must be known who else holds them:

1. *Rank of a sample.*  Among the ranks of a short prefix inside a string of ``least``
   bytes the least one is its anchor, which the string alone decides: equal strings have
   equal anchors at equal places.  Strings that start side by side mostly share one, so a
   text is a list of runs ``(anchor rank, rank of all the run's strings)``, about one for
   every 60 bytes.  Runs whose anchor rank is unique hold no repeat and go.
2. *Rank of the whole run*, from the ranks of its first and last string.  A run that occurs
   twice is removed whole, with whatever occurs often being counted before it is moved.
3. *Rank of every string*, only for runs that are alone but share their anchor with
   others, against those others (one of each kind).  They meet in buckets of bounded size;
   an anchor with too many kinds of runs is counted string by string instead.

Anchor and string ranks are compared together, so 128 bits have to agree.

Defined results: a null text is empty; texts shorter than ``least`` bytes lose nothing and
hold no repeats; equal texts lose all of themselves; matches never go from one text into
the next, and repeated rows, also those with the same id, count as different texts.  An
empty table gives an empty result.  What is left may start or end inside a character, so
it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import content_keys, likely, mixed, small_batches
from tabulon.session import settle

LEAST = 200
PIECE = 49_152
"""Bytes whose ranks are doubled together; a place in a piece must fit 16 bits."""

BITS = 10
BUCKET_ROWS = 20_000
MANY_KINDS = 2_000

KEYS = ("k1", "k2")
_BYTE_RANKS = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

RUNS = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("run", "anchor", "whole")])
SPANS = T.StructType([T.StructField(n, T.LongType()) for n in ("k1", "k2", "start", "end")])
PIECES = T.StructType([*SPANS.fields[:2], T.StructField("run", T.LongType()), T.StructField("anchor", T.LongType()),
                       T.StructField("often", T.BooleanType()), T.StructField("hot", T.BooleanType()),
                       T.StructField("piece", T.BinaryType())])
STRINGS = T.StructType([*SPANS.fields[:3], T.StructField("anchor", T.LongType()), T.StructField("string", T.LongType()),
                        T.StructField("often", T.BooleanType())])
CUT = T.StructType([*SPANS.fields[:2], T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                    T.StructField("kept", T.BinaryType())])


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rank of each pair of ranks."""
    out = left * _FIRST
    out += right
    out ^= out >> np.uint64(32)
    out *= _SECOND
    return out


def doubled(ranks: np.ndarray, length: int, wanted: int) -> np.ndarray:
    """Ranks of ``wanted`` bytes from ranks of ``length`` bytes, doubling the offset."""
    while length < wanted:
        step = min(length, wanted - length)
        ranks = paired(ranks[:-step], ranks[step:])
        length += step
    return ranks


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def prefix_length(least: int) -> int:
    return max(least * 8 // 25, 2)


def runs_of(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of all texts in ``data``: text, start, last start, anchor place, anchor rank, rank of the whole."""
    short = prefix_length(least)
    parts: list[tuple[np.ndarray, ...]] = []
    for begin in range(0, max(len(data) - least + 1, 0), PIECE):
        ranks = doubled(_BYTE_RANKS[data[begin : begin + PIECE + least - 1]], 1, short)
        strings = doubled(ranks, short, least)
        places = np.arange(len(ranks), dtype=np.uint64)
        places |= ranks & ~np.uint64(0xFFFF)  # of equal ranks the first
        anchor = (_least_of(places, least - short + 1) & np.uint64(0xFFFF)).astype(np.int64)
        at = np.arange(begin, begin + len(anchor))
        text = np.searchsorted(ends, at, side="right")
        inside = at + least <= ends[np.minimum(text, len(ends) - 1)]
        first = inside.copy()
        first[1:] &= ~(inside[:-1] & (anchor[1:] == anchor[:-1]))
        start = np.flatnonzero(first)
        stops = np.flatnonzero(inside & ~np.append(inside[1:], False))
        if not len(start):
            continue
        last = np.minimum(np.append(start[1:], len(anchor)) - 1, stops[np.searchsorted(stops, start)])
        whole = paired(strings[start], strings[last]) ^ mixed((last - start).astype(np.uint64) * _FIRST + (anchor[start] - start).astype(np.uint64))
        parts.append((text[start], start + begin, last + begin, anchor[start] + begin, ranks[anchor[start]], whole))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def runs(df: DataFrame, text: str, least: int) -> DataFrame:
    """Two key columns and arrays ``run, anchor, whole`` of every row, in place of its text.

    ``run`` packs the start, the number of further starts and the way to the anchor.
    """
    small_batches(df.sparkSession)
    held = df.select(*content_keys(text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([*SPANS.fields[:2], *RUNS.fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = np.array([len(x) for x in texts], np.int64)
            ends = np.cumsum(sizes)
            of, start, last, anchor, rank, whole = runs_of(np.frombuffer(b"".join(texts), np.uint8), ends, least)
            packed = ((start - (ends - sizes)[of]) << 2 * BITS) | ((last - start) << BITS) | (anchor - start)
            edges = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (packed, rank.view(np.int64), whole.view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), *lists], names=schema.fieldNames())

    return held.mapInArrow(work, schema)


def _unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return run >> 2 * BITS, (run >> BITS) & ((1 << BITS) - 1)


def _pieces(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in PIECES.fields]
            for k1, k2, text, asked in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "asked"))):
                for a in asked:
                    start, more = a["run"] >> 2 * BITS, (a["run"] >> BITS) & ((1 << BITS) - 1)
                    row = (k1, k2, a["run"], a["anchor"], a["often"], a["hot"], text[start : start + more + least])
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (*[pa.int64()] * 4, pa.bool_(), pa.bool_(), pa.binary()))], names=PIECES.fieldNames()
            )

    return work


def _strings(table: pa.Table | pa.RecordBatch, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start in the text and rank of every string of the runs."""
    start, more = _unpacked(table.column("run").to_numpy())
    size = more + least
    data = np.frombuffer(b"".join(table.column("piece").to_pylist()), np.uint8)
    ranks = [
        doubled(_BYTE_RANKS[data[k : k + PIECE + least - 1]], 1, least) for k in range(0, max(len(data) - least + 1, 0), PIECE)
    ]
    row = np.repeat(np.arange(len(size)), more + 1)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
    every = np.concatenate(ranks) if ranks else np.zeros(0, np.uint64)
    return row, start[row] + offset, every[(np.cumsum(size) - size)[row] + offset]


def _meet(least: int):
    """Strings of lone runs that stand in another run of the bucket too, as spans."""

    def work(bucket: pa.Table) -> pa.Table:
        row, at, string = _strings(bucket, least)
        anchor = bucket.column("anchor").to_numpy()[row]
        order = np.lexsort((string, anchor))
        same = (string[order][1:] == string[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
        shared = np.zeros(len(row), bool)
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        shared &= ~bucket.column("often").to_numpy(zero_copy_only=False)[row]
        row, at = row[shared], at[shared]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1))[: len(row)])
        final = np.append(first[1:], len(row)) - 1
        keys = [bucket.column(k).to_numpy()[row[first]] for k in KEYS]
        return pa.table([pa.array(x) for x in (*keys, at[first], at[final] + least)] if len(row) else [pa.array([], pa.int64())] * 4, names=SPANS.fieldNames())

    return work


def _one_by_one(least: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, at, string = _strings(b, least)
            columns = [b.column(k).to_numpy()[row] for k in KEYS] + [at, b.column("anchor").to_numpy()[row], string.view(np.int64)]
            often = b.column("often").to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, often)], names=STRINGS.fieldNames())

    return work


def contents(df: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """Each wanted content once, ``k1, k2, text`` as bytes; copies are folded before they move."""
    held = likely(df.select(*content_keys(text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")), wanted, "k1")
    return held.groupBy(*KEYS).agg(F.first("text").alias("text"))


def repeated_spans(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``k1, k2, start, end`` of strings that stand elsewhere too; spans of a content may overlap."""
    if not 8 <= least < 1 << BITS:
        raise ValueError(f"least must lie between 8 and {(1 << BITS) - 1}")
    listed = settle(runs(df, text, least))
    every = listed.select(*KEYS, F.inline(F.arrays_zip("run", "anchor", "whole")))
    shared = settle(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    some = likely(every, shared, "anchor")
    kinds = settle(some.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEYS, "run")).alias("one")))

    often = kinds.where("n > 1").select("anchor", "whole")
    start = F.shiftright("run", 2 * BITS)
    whole_runs = (
        some.join(often, ["anchor", "whole"], "left_semi")
        .select(*KEYS, start.alias("start"), (start + F.shiftright("run", BITS).bitwiseAND((1 << BITS) - 1) + least).alias("end"))
    )

    mixed_anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.count_if(F.col("n") == 1).alias("lone"))
    asked = (
        kinds.join(mixed_anchors.where("kinds > 1 and lone > 0"), "anchor")
        .select("one.*", "anchor", (F.col("n") > 1).alias("often"), (F.col("kinds") > MANY_KINDS).alias("hot"))
        .groupBy(*KEYS)
        .agg(F.collect_list(F.struct("run", "anchor", "often", "hot")).alias("asked"))  # at most the runs of one text
    )
    asked = settle(asked)
    pieces = settle(contents(df, asked, text).join(asked, list(KEYS)).mapInArrow(_pieces(least), PIECES))
    few = pieces.where("not hot")
    buckets = max(1, -(-few.count() // BUCKET_ROWS))
    met = few.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")).applyInArrow(_meet(least), SPANS)

    single = pieces.where("hot").mapInArrow(_one_by_one(least), STRINGS)
    again = single.groupBy("anchor", "string").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "string")
    alone = single.where("not often").join(again, ["anchor", "string"], "left_semi")
    return whole_runs.unionByName(met).unionByName(alone.select(*KEYS, "start", (F.col("start") + least).alias("end")))


def cut_contents(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``k1, k2, n_removed, n_spans, kept`` of each content that loses something."""
    spans = settle(repeated_spans(df, text, least).groupBy(*KEYS).agg(F.collect_set(F.struct("start", "end")).alias("spans")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, number, kept = [], [], []
            for x, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                left, n = [], 0
                at = 0
                for a, e in sorted((q["start"], q["end"]) for q in s):
                    if a > at or not n:
                        left.append(x[at:a])
                        n += 1
                    at = max(at, e)
                left.append(x[at:])
                kept.append(b"".join(left))
                removed.append(len(x) - len(kept[-1]))
                number.append(n)
            yield pa.RecordBatch.from_arrays(
                [b.column("k1"), b.column("k2"), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(kept, pa.binary())],
                names=CUT.fieldNames(),
            )

    return contents(df, spans, text).join(spans, list(KEYS)).mapInArrow(work, CUT)


def without_repeats(df: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """All rows with ``n_removed``, ``n_spans`` and ``kept``, the bytes that are left; such columns given before are replaced."""
    given = [c for c in df.columns if c.lower() not in ("n_removed", "n_spans", "kept")]
    cut = cut_contents(df, text, least).withColumnsRenamed({k: f"_{k}" for k in KEYS})
    keyed = df.select(*[F.col(f"`{c}`") for c in given], *[c.alias(f"_{n}") for c, n in zip(content_keys(text), KEYS)])
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return keyed.join(cut, [f"_{k}" for k in KEYS], "left").select(
        *[F.col(f"`{c}`") for c in given],
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept", whole).alias("kept"),
    )


def repeat_digests(df: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; only texts that lose something are moved."""
    cut = cut_contents(df, text, least).select(*KEYS, "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha"))
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    heads = df.select(
        F.col(id).alias("id"), *content_keys(text), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha")
    )
    return heads.join(cut, list(KEYS), "left").select(
        F.col("id").alias(id),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("cut_sha", "sha").alias("kept_sha256"),
    )
