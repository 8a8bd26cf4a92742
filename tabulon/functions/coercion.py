"""Numeric coercion, clipping and date parsing as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The spelling of a number, and of a whole number.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
TEXT = (T.StringType, T.CharType, T.VarcharType)


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers, and booleans, which count as numbers throughout."""
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEXT)


def quoted(name: str) -> Column:
    """A column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def text_to_number(text: Column) -> Column:
    """Text to double, anything that is not a plain number to null.

    The guard keeps Java's ``1d``/``5f`` suffixes and the words inf/nan out.
    """
    return F.when(looks_numeric(text), F.trim(text).try_cast("double"))


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Any scalar column as a double, with NaN and non-numbers as null."""
    if isinstance(dtype, FLOATING):
        wide = column.cast("double")
        return F.when(~F.isnan(wide), wide)
    if is_numeric(dtype):
        return column.cast("double")
    if is_text(dtype):
        return text_to_number(column)
    return F.lit(None).cast("double")


def number_of(df: DataFrame, name: str) -> Column:
    return as_number(quoted(name), df.schema[name].dataType)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null, once, at entry; other columns pass through untouched."""
    floats = {
        f.name: F.when(~F.isnan(quoted(f.name)), quoted(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, FLOATING)
    }
    return df.select(
        *[floats.get(n, quoted(n)).alias(n) if n in floats else quoted(n) for n in df.columns]
    )


def clip(column: Column, low: Column | float, high: Column | float) -> Column:
    """Clamp to [low, high]; a null stays null (greatest/least would fill it)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(column.isNotNull(), F.greatest(F.least(column, high), low))


def outside(column: Column, low: Column | float, high: Column | float) -> Column:
    """True for a value beyond the bounds, false for null."""
    return F.coalesce((column < low) | (column > high), F.lit(False))


def keep_inside(column: Column, low: Column | float, high: Column | float) -> Column:
    """Values beyond the bounds become null, to be imputed later."""
    return F.when(column.between(low, high), column)


def first_of_each(values: Column) -> Column:
    """The distinct elements of an array, in the order of their first places."""
    return F.array_distinct(values)


def error_flag(text: Column) -> Column:
    """1 where the raw value was there but was not a number."""
    return (text.isNotNull() & text_to_number(text).isNull()).cast("int")


# The spellings of a date that are read, tried in this order, each with an optional clock time.
# An ambiguous 03/04/2020 is the fourth of March; with dots the day comes first.
DATE_SPELLINGS = (
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"(0?[1-9]|1[0-2])/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "d/M/yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "d.M.yyyy"),
    (r"[A-Za-z]{3} \d{1,2} \d{4}", "MMM d yyyy"),
    (r"[A-Za-z]{4,9} \d{1,2} \d{4}", "MMMM d yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4}", "d MMMM yyyy"),
)
_CLOCK = r"[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?"


def text_to_timestamp(text: Column) -> Column:
    """Parse date text in one of ``DATE_SPELLINGS``; anything else is null.

    Bare numbers (years, postcodes) and clock times without a date are no dates.
    """
    plain = F.trim(text)
    clock = F.regexp_replace(F.regexp_extract(plain, f"({_CLOCK})$", 1), "^[ T]", "")
    day = F.regexp_replace(F.regexp_replace(plain, f"{_CLOCK}$", ""), r"(\d), ", "$1 ")
    read = F.coalesce(*[F.when(day.rlike(f"^{p}$"), F.try_to_timestamp(day, F.lit(form))) for p, form in DATE_SPELLINGS])
    timed = F.try_to_timestamp(F.concat(F.date_format(read, "yyyy-MM-dd "), clock))
    return F.when(clock == "", read).otherwise(timed)


# The seven calendar parts a date column is expanded into.
DATE_PARTS = ("year", "month", "day", "dayofweek", "hour", "is_weekend", "quarter")


def date_part(column: Column, part: str) -> Column:
    """One calendar part as an int; weeks start on Monday = 0."""
    if part == "dayofweek":
        return F.weekday(column)
    if part == "is_weekend":
        return (F.weekday(column) >= 5).cast("int")
    reader = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "quarter": F.quarter}
    return reader[part](column)
