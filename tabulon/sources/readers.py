"""Table readers: suffix dispatch, text encodings, null markers, type inference."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.coercion import INTEGER_PATTERN, is_text, looks_numeric, quoted, text_to_number
from tabulon.sources.quoted_csv import ENCODINGS, read_quoted

# Cell spellings that a flat-file scan reads as missing.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Spellings of a boolean cell.
BOOLEAN_WORDS = ("True", "TRUE", "true", "False", "FALSE", "false")

SUFFIXES = ("csv", "parquet", "json", "orc")


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read by file suffix: csv, parquet, json or orc; anything else is refused."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        raise ValueError(f"unsupported file format: .{suffix}; expected one of {', '.join(SUFFIXES)}")
    if suffix == "csv":
        return read_csv(spark, path, **options)
    return getattr(spark.read.options(**options), suffix)(path)


def text_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 if every line decodes, else iso-8859-1, which accepts every byte.

    The text source hands the bytes through unchecked, so the test is one
    distributed scan that stops at the first bad line.
    """
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return "ISO-8859-1" if broken else "UTF-8"


def read_csv(
    spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = True, infer: bool = True, **options
) -> DataFrame:
    """Header CSV with null markers and column types inferred from all rows.

    Line breaks inside quotes belong to the cell.  Many tasks read a file (``quoted_csv``) unless
    reader options other than ``sep`` or an encoding that is no superset of ASCII are asked for; then a
    file is one task.  Where no cell holds a line break, ``multi_line=False`` takes Spark's own splits.
    """
    separator = options.get("sep", ",")
    if multi_line and set(options) <= {"sep"} and len(separator.encode()) == 1 and (encoding or "UTF-8").upper() in ENCODINGS:
        names = _built_in(spark, path, encoding or "ISO-8859-1", True, options).columns
        # names as bytes of one-byte characters, read again as UTF-8 where they are
        names = names if encoding else [_as_utf8(n) for n in names]
        marked = read_quoted(spark, path, [n.removesuffix("\r") for n in names], encoding, separator)
        if marked is not None:
            marked = null_markers(marked)
            return infer_columns(marked) if infer else marked
    marked = null_markers(_built_in(spark, path, encoding or text_encoding(spark, path), multi_line, options))
    return infer_columns(marked) if infer else marked


def _as_utf8(name: str) -> str:
    try:
        return name.encode("iso-8859-1").decode("utf-8-sig")
    except UnicodeError:
        return name


def _built_in(spark: SparkSession, path: str, encoding: str, multi_line: bool, options: Mapping) -> DataFrame:
    return (
        spark.read.option("header", True)
        .option("encoding", encoding)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .options(**options)
        .csv(path)
    )


def null_markers(df: DataFrame, markers: Iterable[str] = NULL_MARKERS) -> DataFrame:
    """Marker cells of text columns become null."""
    words = list(markers)
    return df.select(
        *[
            F.when(~quoted(f.name).isin(words), quoted(f.name)).alias(f.name) if is_text(f.dataType) else quoted(f.name)
            for f in df.schema.fields
        ]
    )


def infer_columns(df: DataFrame) -> DataFrame:
    """Whole number, double or boolean where every non-null text cell allows it; one pass."""
    names = [f.name for f in df.schema.fields if is_text(f.dataType)]
    if not names:
        return df
    tests = []
    for k, n in enumerate(names):
        c = quoted(n)
        whole = c.rlike(INTEGER_PATTERN) & F.trim(c).try_cast("bigint").isNotNull()
        tests += [
            F.count(c).alias(f"n{k}"),
            F.count_if(whole).alias(f"whole{k}"),
            F.count_if(looks_numeric(c)).alias(f"number{k}"),
            F.count_if(c.isin(*BOOLEAN_WORDS)).alias(f"bool{k}"),
        ]
    seen = df.agg(*tests).first()

    def typed(k: int, n: str):
        total = seen[f"n{k}"]
        if not total:
            return F.lit(None).cast("double")
        if seen[f"whole{k}"] == total:
            return F.trim(quoted(n)).try_cast("bigint")
        if seen[f"number{k}"] == total:
            return text_to_number(quoted(n))
        if seen[f"bool{k}"] == total:
            return quoted(n).try_cast("boolean")
        return quoted(n)

    place = {n: k for k, n in enumerate(names)}
    return df.select(*[typed(place[n], n).alias(n) if n in place else quoted(n) for n in df.columns])


def from_records(spark: SparkSession, rows: Iterable[Mapping], schema: str | T.StructType | None = None) -> DataFrame:
    """A request's rows as a DataFrame; columns absent from a row are null."""
    held = [dict(r) for r in rows]
    if schema is not None:
        return spark.createDataFrame(held, schema)
    names = list(dict.fromkeys(n for r in held for n in r))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in held], names)


def read_records(df: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """Rows that a column holds as JSON objects, a text each, by ``schema``; parsed where they lie.

    Fields that an object leaves out are null, other fields are passed over, and a field of
    another type is null.  A text that is no object is refused; a null is a row of nulls.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    parsed = F.from_json(quoted(column), kind, {"mode": "PERMISSIVE"})
    whole = F.startswith(F.ltrim(quoted(column)), F.lit("{")) & F.try_parse_json(quoted(column)).isNotNull()
    refused = F.raise_error(F.concat(F.lit("no JSON object: "), F.substring(quoted(column), 1, 100)))
    held = df.select(F.when(quoted(column).isNull() | whole, parsed).otherwise(refused.cast(kind)).alias("_record"))
    return held.select(*[F.col("_record")[n].alias(n) for n in kind.fieldNames()])
