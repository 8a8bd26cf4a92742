"""Input tables and derived views, in Spark and, word for word, in SQL.

The given tables hold no nulls, text errors or copies, so the views derive them
from the values: every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.sources.readers import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def documents_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels; most have none, so quality and toxic miss cells."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


SQL_DOCUMENTS_LABELLED = """(
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def events_mixed(spark: SparkSession, sf: str) -> DataFrame:
    """``raw`` is a number as text, or a word: four fifths, seven tenths, all but a few numbers."""
    text = F.col("value").cast("string")
    return table(spark, sf, "events").select(
        "event_id",
        "value",
        F.when(F.col("event_type") == "error", "error_data").otherwise(text).alias("raw"),
        F.when(F.col("event_type").isin("error", "view"), F.concat(F.lit("item "), text)).otherwise(text).alias("half"),
        F.when(F.col("value") > 150, "n/a").otherwise(text).alias("clean"),
    )


SQL_EVENTS_MIXED = """(
    SELECT event_id, value,
        CASE WHEN event_type = 'error' THEN 'error_data' ELSE CAST(value AS VARCHAR) END AS raw,
        CASE WHEN event_type IN ('error', 'view') THEN 'item ' || CAST(value AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS half,
        CASE WHEN value > 150 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS clean
    FROM events)"""


def events_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Large values, most event types and few user ids are missing."""
    return table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("value") <= 50, F.col("value")).alias("value"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.col("event_type")).alias("event_type"),
        F.when(F.col("user_id") >= 10, F.col("user_id")).alias("user_id"),
    )


SQL_EVENTS_MISSING = """(
    SELECT event_id,
        CASE WHEN value <= 50 THEN value END AS value,
        CASE WHEN event_type IN ('purchase', 'signup') THEN event_type END AS event_type,
        CASE WHEN user_id >= 10 THEN user_id END AS user_id
    FROM events)"""


def lineitem_constant(spark: SparkSession, sf: str) -> DataFrame:
    """Flags held by 98 and by 90 percent of the rows."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_quantity") > 49, "x").otherwise("y").alias("flag"),
        F.when(F.col("l_quantity") > 45, 1.0).otherwise(0.0).alias("rare"),
        F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("level"),
    )


SQL_LINEITEM_CONSTANT = """(
    SELECT l_orderkey,
        CASE WHEN l_quantity > 49 THEN 'x' ELSE 'y' END AS flag,
        CAST(CASE WHEN l_quantity > 45 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS rare,
        CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END AS level
    FROM lineitem)"""


def lineitem_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Five low-cardinality columns, so many rows repeat."""
    return table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


SQL_LINEITEM_TERMS = "(SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem)"


def orders_outlier(spark: SparkSession, sf: str) -> DataFrame:
    """Large urgent orders are fifty times as dear."""
    odd = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000)
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(odd, F.col("o_totalprice") * 50).otherwise(F.col("o_totalprice")).alias("price"),
    )


SQL_ORDERS_OUTLIER = """(
    SELECT o_orderkey, o_orderstatus,
        CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN o_totalprice * 50 ELSE o_totalprice END AS price
    FROM orders)"""


def orders_datestr(spark: SparkSession, sf: str) -> DataFrame:
    """The order date as text."""
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_text"), "o_orderdate",
    )


SQL_ORDERS_DATESTR = """(
    SELECT o_orderkey, o_orderstatus, o_orderpriority,
        strftime(o_orderdate, '%Y-%m-%d') AS date_text, o_orderdate
    FROM orders)"""


def lineitem_predicted(spark: SparkSession, sf: str) -> DataFrame:
    """A label with a rule-based prediction and score, as a model would leave them."""
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.when(F.col("l_tax") > 0.04, 1).otherwise(0).alias("prediction"),
        (F.col("l_tax") * 10).alias("score"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label3"),
        F.when(F.col("l_tax") < 0.03, 0).when(F.col("l_tax") < 0.06, 1).otherwise(2).alias("prediction3"),
        F.col("l_extendedprice").alias("y"),
        (F.col("l_quantity") * 2000).alias("yhat"),
    )


SQL_LINEITEM_PREDICTED = """(
    SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
        CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS prediction,
        l_tax * 10 AS score,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label3,
        CASE WHEN l_tax < 0.03 THEN 0 WHEN l_tax < 0.06 THEN 1 ELSE 2 END AS prediction3,
        l_extendedprice AS y, l_quantity * 2000 AS yhat
    FROM lineitem)"""


# Column kinds of the tables the profile queries use.
COLUMNS = {
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
        ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
        ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ],
    "documents": [
        ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ],
    "part": [
        ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
        ("p_retailprice", "double"),
    ],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
        ("c_mktsegment", "string"),
    ],
    SQL_DOCUMENTS_LABELLED: [
        ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
        ("quality", "int"), ("toxic", "int"),
    ],
    SQL_EVENTS_MISSING: [
        ("event_id", "bigint"), ("value", "double"), ("event_type", "string"), ("user_id", "bigint"),
    ],
    SQL_EVENTS_MIXED: [
        ("event_id", "bigint"), ("value", "double"), ("raw", "string"), ("half", "string"), ("clean", "string"),
    ],
    SQL_LINEITEM_CONSTANT: [
        ("l_orderkey", "bigint"), ("flag", "string"), ("rare", "double"), ("level", "string"),
    ],
    SQL_ORDERS_DATESTR: [
        ("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"),
        ("date_text", "string"), ("o_orderdate", "timestamp_ntz"),
    ],
    SQL_LINEITEM_TERMS: [
        ("l_quantity", "double"), ("l_discount", "double"), ("l_tax", "double"),
        ("l_returnflag", "string"), ("l_linestatus", "string"),
    ],
}

NUMERIC = ("bigint", "int", "double")


def named(source: str, kinds=None) -> list[tuple[int, str, str]]:
    """``(ordinal, column, kind)`` of a source, optionally of some kinds only."""
    return [(k, n, t) for k, (n, t) in enumerate(COLUMNS[source]) if kinds is None or t in kinds]


def per_column(source: str, measures: str, kinds=None) -> str:
    """UNION ALL of one aggregate SELECT per column; ``{c}`` stands for the column."""
    return "\nUNION ALL\n".join(
        f"SELECT CAST({k} AS INTEGER) AS ordinal, '{n}' AS \"column\", {measures.replace('{c}', n).replace('{t}', t)} FROM {source}"
        for k, n, t in named(source, kinds)
    )


# The spelling of a number, as in the library.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(text: str) -> str:
    """SQL for text to double, null when it is not a number."""
    return f"CASE WHEN regexp_matches({text}, '{NUMBER}') THEN TRY_CAST(trim({text}) AS DOUBLE) END"


def profile_sql(source: str) -> str:
    """SQL for the column profile: counts, shares, conversion and text kinds."""
    parts = []
    for k, n, t in named(source):
        if t == "string":
            convertible = f"count({number(n)})"
            kinds = f"count(DISTINCT CASE WHEN NOT regexp_matches({n}, '{NUMBER}') THEN lower(trim({n})) END)"
            markers = (
                f"count(DISTINCT CASE WHEN lower(trim({n})) IN ('na','n/a','null','none','missing','','nan','unknown','undefined')"
                f" THEN {n} END)"
            )
        else:
            convertible, kinds, markers = "0", "0", "0"
        top = f"(SELECT max(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY {n}))"
        parts.append(
            f"SELECT CAST({k} AS INTEGER) AS ordinal, '{n}' AS \"column\", '{t}' AS spark_type, count(*) AS \"rows\", "
            f"count(*) - count({n}) AS missing_count, count(DISTINCT {n}) AS distinct_count, {top} AS top_count, "
            f"CAST({convertible} AS BIGINT) AS convertible, {kinds} AS all_kinds, {markers} AS all_markers FROM {source}"
        )
    body = "\nUNION ALL\n".join(parts)
    return f"""
        SELECT *, missing_count * 100.0 / "rows" AS missing_pct, distinct_count * 100.0 / "rows" AS distinct_pct,
            top_count * 100.0 / "rows" AS top_pct,
            CASE WHEN "rows" > missing_count THEN convertible / ("rows" - missing_count) END AS conversion_rate
        FROM ({body})"""


def typed_sql(source: str) -> str:
    """SQL for the column catalog: the profile with the detected type."""
    return f"""
        SELECT *, CASE WHEN spark_type LIKE 'timestamp%' THEN 'datetime'
            WHEN spark_type <> 'string' THEN 'numerical'
            WHEN conversion_rate >= 0.8 THEN 'numerical'
            WHEN conversion_rate >= 0.5 AND (all_markers > 0 OR all_kinds <= 3) THEN 'numerical'
            WHEN conversion_rate >= 0.5 THEN 'categorical'
            WHEN distinct_count < 0.1 * "rows" OR distinct_count < 20 THEN 'categorical'
            ELSE 'text' END AS detected_type
        FROM ({profile_sql(source)})"""


def verdict_sql(source: str) -> str:
    """SQL for the column verdicts: drop, hash encode and the warnings joined by `` | ``."""
    leaders = "\nUNION ALL\n".join(
        f"""SELECT {k} AS ordinal, (SELECT coalesce(CAST({n} AS VARCHAR), 'nan') FROM {source} GROUP BY {n} ORDER BY count(*) DESC LIMIT 1) AS leader"""
        for k, n, _ in named(source)
    )
    return f"""
        SELECT *, concat_ws(' | ',
            CASE WHEN missing_pct > 50 THEN "column" || printf(': %.1f%% missing values - RECOMMEND DROPPING', missing_pct)
                 WHEN missing_pct > 30 THEN "column" || printf(': %.1f%% missing values - consider dropping', missing_pct) END,
            CASE WHEN top_pct > 95 THEN "column" || printf(': %.1f%% same value (''%s'') - RECOMMEND DROPPING', top_pct, leader)
                 WHEN top_pct > 85 THEN "column" || printf(': %.1f%% same value (''%s'') - low variance', top_pct, leader) END,
            CASE WHEN should_hash_encode THEN "column" || printf(': %d unique categories - RECOMMEND HASH ENCODING', distinct_count)
                 WHEN spark_type = 'string' AND NOT should_drop AND distinct_count > 50 AND distinct_count > 0.5 * "rows"
                 THEN "column" || printf(': %d unique categories - consider hash encoding', distinct_count) END,
            CASE WHEN spark_type = 'string' AND NOT should_drop AND conversion_rate > 0.2 AND conversion_rate < 0.8
                 THEN "column" || printf(': Mixed numeric/text content (%.1f%% numeric)', conversion_rate * 100) END) AS warnings
        FROM (SELECT *, spark_type = 'string' AND NOT should_drop AND distinct_count > 100 AND distinct_count > 0.8 * "rows" AS should_hash_encode
            FROM (SELECT p.*, leader, missing_pct > 50 OR top_pct > 95 AS should_drop FROM ({typed_sql(source)}) p JOIN ({leaders}) USING (ordinal)))"""
