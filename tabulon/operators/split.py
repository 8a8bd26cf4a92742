"""Exact, reproducible train/test splits and folds without a hot window.

Rows are ordered by an md5 of their key.  The digest is uniform, so its first
hex digits cut any group, even one holding a third of all rows, into even
buckets; a row's number in its group is the bucket's offset plus its rank
inside the bucket.  The join and the window share one shuffle on the bucket.

Where only the side of a row is asked for, the digest of the last test row of each
group is found from the keys alone, and no row moves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.coercion import quoted
from tabulon.functions.hashing import order_key, row_fingerprint
from tabulon.session import settle

SEED = 42
ROWS_PER_BUCKET = 1_000_000


def _digits(rows: int) -> int:
    return max(math.ceil(math.log(max(rows / ROWS_PER_BUCKET, 1), 16)), 1)


def numbered(
    df: DataFrame, key: Sequence[str] | None = None, by: Sequence[str] = (), seed: int = SEED, rows: int | None = None
) -> DataFrame:
    """Adds ``_row`` (1-based, by md5 order inside the group) and ``_total`` (group size).

    The key has to identify a row.  Without one the whole row is the key.
    """
    return _ranked(_keyed(df, key, seed), "_split_key", by, df.count() if rows is None else rows, key).drop("_split_key")


def places(df: DataFrame, order: str, by: Sequence[str], rows: int) -> DataFrame:
    """Adds ``position``, the row's place in its group by a column of md5 digests."""
    return _ranked(df, order, by, rows).withColumn("position", F.col("_row").cast("bigint")).drop("_row", "_total")


def _keyed(df: DataFrame, key: Sequence[str] | None, seed: int) -> DataFrame:
    return df.withColumn("_split_key", order_key(seed, *[quoted(k) for k in key])) if key else _salted(df, seed)


def _grouped(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The groups as text, a missing one included."""
    groups = [F.coalesce(quoted(b).cast("string"), F.lit("\u0000")).alias(f"_by{k}") for k, b in enumerate(by)]
    return df.select("*", *groups), [f"_by{k}" for k in range(len(by))]


def _bucket_offsets(marked: DataFrame, names: Sequence[str]) -> DataFrame:
    """``_before``, the rows of the group in earlier buckets, ``_size`` and ``_total``; one row per bucket."""
    sizes = marked.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    upto = F.sum("_size").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.select(*names, "_bucket", "_size", (upto - F.col("_size")).alias("_before"), F.sum("_size").over(whole).alias("_total"))


def _ranked(df: DataFrame, order: str, by: Sequence[str], rows: int, ties: Sequence[str] | None = None) -> DataFrame:
    marked, names = _grouped(df.withColumn("_bucket", F.substring(order, 1, _digits(rows))), by)
    inside = Window.partitionBy(*names, "_bucket").orderBy(order, *[quoted(k) for k in ties or ()])
    return (
        marked.join(_bucket_offsets(marked, names).drop("_size"), [*names, "_bucket"])
        .withColumn("_row", F.col("_before") + F.row_number().over(inside))
        .select(*[quoted(c) for c in df.columns], "_row", "_total")
    )


def _salted(df: DataFrame, seed: int) -> DataFrame:
    """Whole-row key plus the number of the copy, the same however the rows are dealt out.

    Copies of a row are interchangeable: whichever of them is called the third, the
    third of them has one key.  They are numbered inside the partition they were
    written in, from an offset per partition, so a row that a third of the table
    repeats is never in one window.
    """
    first, second = row_fingerprint(df)
    held = settle(df.withColumns({"_h1": first, "_h2": second, "_part": F.spark_partition_id()}))
    sizes = held.groupBy("_h1", "_h2", "_part").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("_h1", "_h2").orderBy("_part")  # as many rows as partitions hold copies
    offsets = sizes.select("_h1", "_h2", "_part", (F.sum("_size").over(earlier) - F.col("_size")).alias("_offset"))
    inside = Window.partitionBy("_h1", "_h2", "_part").orderBy("_h1")
    numbered = held.withColumn("_copy", F.row_number().over(inside)).join(offsets, ["_h1", "_h2", "_part"])
    key = order_key(seed, F.col("_h1"), F.col("_h2"), F.col("_copy") + F.col("_offset"))
    return settle(numbered.select(*[quoted(c) for c in df.columns], key.alias("_split_key")))


def _test_rows(test_size: float, stratified: bool):
    share = F.col("_total") * F.lit(test_size)
    return F.round(share) if stratified else F.ceil(share)


def split(
    df: DataFrame,
    test_size: float = 0.2,
    key: Sequence[str] | None = None,
    stratify: str | None = None,
    seed: int = SEED,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``is_test`` and ``position``, the row's place among its side of its class."""
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must lie between 0.1 and 0.5")
    cut = _test_rows(test_size, stratify is not None)
    ordered = numbered(df, key, [stratify] if stratify else [], seed, rows)
    return ordered.select(
        *[quoted(c) for c in df.columns],
        (F.col("_row") <= cut).alias("is_test"),
        F.when(F.col("_row") <= cut, F.col("_row")).otherwise(F.col("_row") - cut).cast("bigint").alias("position"),
    )


def split_in_place(
    df: DataFrame,
    test_size: float = 0.2,
    key: Sequence[str] | None = None,
    stratify: str | None = None,
    seed: int = SEED,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``is_test``, on the rows of ``split``, and ``_split_key``, the digest that orders them.

    Three scans read the key and the class only; rows stay where they are.  Rows that share
    a key, which should identify them, are on one side.  Without a key the rows are written out
    first, as ``split`` does.
    """
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must lie between 0.1 and 0.5")
    by = [stratify] if stratify else []
    keyed, names = _grouped(_keyed(df, key, seed), by)
    digits = _digits(df.count() if rows is None else rows)
    marked = keyed.select(*names, "_split_key", F.substring("_split_key", 1, digits).alias("_bucket"))
    cut = _test_rows(test_size, bool(by)) - F.col("_before")
    last = settle(  # the bucket that holds the last test row of each group
        _bucket_offsets(marked, names).withColumn("_cut", cut).where("_cut between 1 and _size").select(*names, "_bucket", "_cut")
    )
    inside = Window.partitionBy(*names, "_bucket").orderBy("_split_key")  # one bucket of each group
    found = marked.join(last, [*names, "_bucket"]).withColumn("_row", F.row_number().over(inside))
    ends = settle(found.where("_row = _cut").select(*names, F.col("_split_key").alias("_last")))
    met = keyed.join(ends, names, "left") if names else keyed.join(F.broadcast(ends), F.lit(True), "left")  # one row
    side = F.coalesce(F.col("_split_key") <= F.col("_last"), F.lit(False)).alias("is_test")
    return met.select(*[quoted(c) for c in df.columns], side, "_split_key")


def folds(
    df: DataFrame,
    k: int = 5,
    key: Sequence[str] | None = None,
    stratify: str | None = None,
    seed: int = SEED,
    rows: int | None = None,
) -> DataFrame:
    """Adds ``fold`` 0..k-1, dealt out in md5 order inside each class."""
    if not 3 <= k <= 10:
        raise ValueError("the number of folds must lie between 3 and 10")
    ordered = numbered(df, key, [stratify] if stratify else [], seed, rows)
    return ordered.withColumn("fold", F.pmod(F.col("_row") - 1, F.lit(k)).cast("int")).drop("_row", "_total")
