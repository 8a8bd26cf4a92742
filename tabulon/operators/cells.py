"""The long form: one row per cell, counted once, behind every column profile.

A cell is spread over three typed slots (whole number, double, text) instead of
being printed to text, so numbers and dates travel as 8 bytes.  Text of any length is its
own key, so that equality, order and spelling mean the same for all of it.  One ``groupBy``
over the slots, partially aggregated before the shuffle, then serves missing
counts, distinct counts, top values, samples and type inference alike.  A value
held by a third of all rows is one row per task after the partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.coercion import FLOATING, INTEGRAL, is_text, quoted
from tabulon.session import small_table

_STACK_LIMIT = 50
_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

CELL_KEYS = ("ordinal", "i", "d", "s")


def _ntz_micros(c: Column) -> Column:
    seconds = F.unix_date(c.cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * 1000000 + (F.date_part(F.lit("SECOND"), c) * 1000000).cast("bigint")


def _slots(column: Column, dtype: T.DataType) -> tuple[Column, Column, Column]:
    whole, double, text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))
    if isinstance(dtype, INTEGRAL):
        whole = column.cast("bigint")
    elif isinstance(dtype, T.BooleanType):
        whole = column.cast("int").cast("bigint")
    elif isinstance(dtype, FLOATING):
        wide = column.cast("double")
        double = F.when(~F.isnan(wide), wide)
    elif isinstance(dtype, T.DateType):
        whole = F.unix_date(column).cast("bigint")
    elif isinstance(dtype, T.TimestampType):
        whole = F.unix_micros(column)
    elif isinstance(dtype, T.TimestampNTZType):
        whole = _ntz_micros(column)
    elif is_text(dtype):
        text = column.cast("string")
    elif isinstance(dtype, T.DecimalType):
        text = column.cast("string")
    elif isinstance(dtype, T.BinaryType):
        text = F.base64(column)
    else:
        nested = isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        text = F.to_json(column) if nested else column.cast("string")
    return whole, double, text


def cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Unpivot to ``(ordinal, i, d, s)``; ordinal is the position in ``df``."""
    wanted = list(columns) if columns is not None else df.columns
    rows = [
        (F.lit(df.columns.index(n)), *_slots(quoted(n), df.schema[n].dataType)) for n in wanted
    ]
    if len(rows) <= _STACK_LIMIT:
        flat = [c for row in rows for c in row]
        return df.select(F.stack(F.lit(len(rows)), *flat).alias(*CELL_KEYS))
    structs = [F.struct(*[c.alias(k) for c, k in zip(row, CELL_KEYS)]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(ordinal, i, d, s, n)``: every distinct value of every column, nulls included.

    The ordinal is declared non-null, so that joins on it add no filter of their
    own below the aggregation and all readers share one shuffle.
    """
    long = cells(df, columns).withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))
    return long.groupBy(*CELL_KEYS).agg(F.count(F.lit(1)).alias("n"))


def is_missing() -> Column:
    return F.col("i").isNull() & F.col("d").isNull() & F.col("s").isNull()


def counted(condition: Column) -> Column:
    """A filter on value counts that stays above the aggregation.

    Pushed below, it would make the shuffle differ from the one the other
    readers of the same counts use, and the source would be read again.
    """
    return F.when(F.col("n") > 0, condition)


def display(df: DataFrame) -> Column:
    """The text of a cell, given the column types of ``df``."""
    def ordinals(kind) -> list[int]:
        return [k for k, f in enumerate(df.schema.fields) if isinstance(f.dataType, kind)]

    shown = F.when(F.col("s").isNotNull(), F.col("s")).when(
        F.col("d").isNotNull(), F.col("d").cast("string")
    )
    typed = (
        (T.BooleanType, (F.col("i") == 1).cast("string")),
        (T.DateType, F.date_from_unix_date(F.col("i").cast("int")).cast("string")),
        (T.TimestampType, F.timestamp_micros(F.col("i")).cast("string")),
        (
            T.TimestampNTZType,
            (
                F.expr(_NTZ_EPOCH)
                + F.make_dt_interval(
                    secs=(F.col("i").cast("decimal(20,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(18,6)")
                )
            ).cast("string"),
        ),
    )
    for kind, text in typed:
        held = ordinals(kind)
        if held:
            shown = shown.when(F.col("ordinal").isin(held), text)
    return shown.otherwise(F.col("i").cast("string"))


def names_of(df: DataFrame) -> DataFrame:
    """``(ordinal, column, spark_type)`` of a table; as many rows as it has columns."""
    rows = [(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema.fields)]
    return small_table(df.sparkSession, rows, "ordinal int, column string, spark_type string")


def top_values(
    df: DataFrame, columns: Sequence[str], k: int = 10, counts: DataFrame | None = None
) -> DataFrame:
    """The k most frequent values per column, ties by value.

    ``rank <= k`` lets Spark keep k rows per column in every task before the
    shuffle, so no task ever holds all the values of one column.
    """
    ordered = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc_nulls_last("value"))
    return _ranked(df, columns, ordered, k, counts)


def sample_values(
    df: DataFrame, columns: Sequence[str] | None = None, k: int = 5, counts: DataFrame | None = None
) -> DataFrame:
    """k distinct values per column, the first in value order."""
    ordered = Window.partitionBy("ordinal").orderBy("i", "d", "s")
    return _ranked(df, list(columns or df.columns), ordered, k, counts)


def _ranked(df, columns, ordered, k, counts) -> DataFrame:
    wanted = [df.columns.index(c) for c in columns]
    source = value_counts(df, columns) if counts is None else counts.where(counted(F.col("ordinal").isin(wanted)))
    ranked = (
        source.where(counted(~is_missing()))
        .withColumn("value", display(df))
        .withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= k)
        .select("ordinal", "value", "n", "rank")
    )
    return ranked.join(F.broadcast(names_of(df)), "ordinal").select("ordinal", "column", "rank", "value", "n")
