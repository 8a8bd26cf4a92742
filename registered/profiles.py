"""Column statistics: counts, moments, quantiles, top values, histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import views as v
from registered.base import registrar
from tabulon.functions.coercion import first_of_each
from tabulon.operators import cells, correlation, eda, inference, profile, quantiles
from tabulon.plans.exploration import shown_columns, shown_values
from tabulon.plans.training import target_extent
from tabulon.session import small_table

REGISTERED, register = registrar()


def rounded(df, places=6, skip=("ordinal",)):
    """Round the double columns, as the SQL does."""
    return df.select(
        *[F.round(c, places).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes]
    )


@register("a01_shape", 'SELECT count(*) AS "rows", CAST(11 AS BIGINT) AS columns FROM lineitem')
def a01(spark, sf):
    return profile.shape(v.table(spark, sf, "lineitem"))


_MISSING = "count(*) - count({c}) AS missing_count"
_MISSING_PCT = "round((count(*) - count({c})) * 100.0 / count(*), 6) AS missing_pct"


@register("a02_missing_count", v.per_column(v.SQL_EVENTS_MISSING, _MISSING))
def a02(spark, sf):
    return profile.missing_by_column(v.events_missing(spark, sf)).drop("missing_pct")


@register("a03_missing_percentage", v.per_column(v.SQL_DOCUMENTS_LABELLED, _MISSING_PCT))
def a03(spark, sf):
    return rounded(profile.missing_by_column(v.documents_labelled(spark, sf)).drop("missing_count"))


@register(
    "a04_total_missing",
    f"""SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing,
        CAST(count(*) FILTER (WHERE missing_count > 0) AS BIGINT) AS columns_with_missing,
        round(sum(missing_count) * 100.0 / sum("rows"), 6) AS missing_pct
        FROM ({v.per_column(v.SQL_EVENTS_MISSING, _MISSING + ', count(*) AS "rows"')})""",
)
def a04(spark, sf):
    return rounded(profile.missing_total(v.events_missing(spark, sf)))


_DISTINCT = "count(DISTINCT {c}) AS distinct_count"


@register("a05_distinct_count", v.per_column("lineitem", _DISTINCT))
def a05(spark, sf):
    return profile.distinct_counts(v.table(spark, sf, "lineitem"))


@register("a05_distinct_text", v.per_column("documents", _DISTINCT))
def a05_text(spark, sf):
    return profile.distinct_counts(v.table(spark, sf, "documents"))


@register(
    "a06_distinct_percentage",
    v.per_column(v.SQL_DOCUMENTS_LABELLED, "round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS distinct_pct"),
)
def a06(spark, sf):
    df = profile.profile(v.documents_labelled(spark, sf))
    return rounded(df.select("ordinal", "column", "distinct_pct"), 2)


_NUMERIC = (
    "round(avg({c}), 4) AS mean, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS median, "
    "round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
    "round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25, round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75"
)


@register("a07_to_a11_numeric_profile", v.per_column("lineitem", _NUMERIC, v.NUMERIC))
def a07(spark, sf):
    return rounded(profile.numeric_profile(v.table(spark, sf, "lineitem")), 4)


@register("a07_mean_with_missing", v.per_column(v.SQL_EVENTS_MISSING, "round(avg({c}), 4) AS mean", v.NUMERIC))
def a07_missing(spark, sf):
    return rounded(profile.numeric_profile(v.events_missing(spark, sf)).select("ordinal", "column", "mean"), 4)


@register(
    "a08_median", v.per_column(v.SQL_EVENTS_MISSING, "round(CAST(median({c}) AS DOUBLE), 4) AS median", v.NUMERIC)
)
def a08(spark, sf):
    return rounded(profile.numeric_profile(v.events_missing(spark, sf)).select("ordinal", "column", "median"), 4)


@register("a09_standard_deviation", v.per_column("orders", "round(stddev_samp({c}), 4) AS std", v.NUMERIC))
def a09(spark, sf):
    return rounded(profile.numeric_profile(v.table(spark, sf, "orders")).select("ordinal", "column", "std"), 4)


@register(
    "a10_min_max",
    v.per_column(v.SQL_DOCUMENTS_LABELLED, "CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max", v.NUMERIC),
)
def a10(spark, sf):
    return profile.numeric_profile(v.documents_labelled(spark, sf)).select("ordinal", "column", "min", "max")


@register(
    "a11_quartiles_by_narrowing",
    v.per_column(
        "lineitem",
        "round(CAST(quantile_cont({c}, 0.25) AS DOUBLE), 4) AS q25, round(CAST(quantile_cont({c}, 0.5) AS DOUBLE), 4) AS q50, "
        "round(CAST(quantile_cont({c}, 0.75) AS DOUBLE), 4) AS q75",
        v.NUMERIC,
    ),
)
def a11(spark, sf):
    """Quartiles alone; lineitem has more rows than one interval may hold, so the search narrows."""
    df = v.table(spark, sf, "lineitem")
    names = [(k, n) for k, n, _ in v.named("lineitem", v.NUMERIC)]
    found = quantiles.quantiles(df, {n: F.col(n) for _, n in names}, (0.25, 0.5, 0.75))
    rows = [(k, n, *[float(q) for q in found[n]]) for k, n in names]
    return rounded(small_table(spark, rows, "ordinal int, column string, q25 double, q50 double, q75 double"), 4)


def _top_sql(source, columns, k):
    parts = []
    for o, n, _ in v.named(source):
        if n in columns:
            parts.append(
                f"""SELECT CAST({o} AS INTEGER) AS ordinal, '{n}' AS "column", CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({n} AS VARCHAR)) AS INTEGER) AS rank,
                CAST({n} AS VARCHAR) AS value, count(*) AS n FROM {source} WHERE {n} IS NOT NULL GROUP BY {n} QUALIFY rank <= {k}"""
            )
    return "\nUNION ALL\n".join(parts)


@register("a12_categorical_profile", _top_sql("documents", ("lang", "source"), 10))
def a12(spark, sf):
    return cells.top_values(v.table(spark, sf, "documents"), ["lang", "source"])


@register(
    "a12_most_frequent",
    f"""SELECT "column", value AS most_frequent, n AS most_frequent_count FROM ({_top_sql("orders", ("o_orderstatus", "o_orderpriority"), 1)})""",
)
def a12_first(spark, sf):
    tops = cells.top_values(v.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], 1)
    return tops.select("column", F.col("value").alias("most_frequent"), F.col("n").alias("most_frequent_count"))


@register(
    "a13_datetime_profile",
    v.per_column(
        "lineitem",
        "min({c}) AS min_date, max({c}) AS max_date, CAST(date_sub('hour', min({c}), max({c})) // 24 AS BIGINT) AS date_range_days",
        ("timestamp_ntz",),
    ),
)
def a13(spark, sf):
    return profile.datetime_profile(v.table(spark, sf, "lineitem"))


@register(
    "a14_text_profile",
    v.per_column(
        "documents",
        "round(avg(length({c})), 6) AS avg_length, max(length({c})) AS max_length, min(length({c})) AS min_length",
        ("string",),
    ),
)
def a14(spark, sf):
    return rounded(profile.text_profile(v.table(spark, sf, "documents")))


@register(
    "a15_numeric_quality",
    v.per_column(
        "customer",
        "CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean_value, "
        "round(stddev_samp({c}), 4) AS std_value, count(*) FILTER (WHERE {c} = 0) AS zeros_count, "
        "count(*) FILTER (WHERE {c} < 0) AS negative_count",
        v.NUMERIC,
    ),
)
def a15(spark, sf):
    return rounded(profile.numeric_quality(v.table(spark, sf, "customer")), 4)


_BLANKS = """(SELECT page_id, CASE WHEN html LIKE '%/fr%' THEN '' WHEN url LIKE '%www%' THEN '   ' ELSE url END AS url FROM pages)"""


@register(
    "a16_text_quality",
    f"""SELECT CAST(1 AS INTEGER) AS ordinal, 'url' AS "column", round(avg(length(url)), 1) AS avg_length, max(length(url)) AS max_length,
        count(*) FILTER (WHERE url = '') AS empty_strings, count(*) FILTER (WHERE trim(url) = '') AS whitespace_only FROM {_BLANKS}""",
)
def a16(spark, sf):
    pages = v.table(spark, sf, "pages")
    url = F.when(F.col("html").like("%/fr%"), "").when(F.col("url").like("%www%"), "   ").otherwise(F.col("url"))
    return profile.text_quality(pages.select("page_id", url.alias("url")))


@register(
    "a17_near_constant_share",
    f"""SELECT ordinal, "column", top_count, round(top_pct, 6) AS top_pct FROM ({v.profile_sql(v.SQL_EVENTS_MISSING)})""",
)
def a17(spark, sf):
    df = profile.profile(v.events_missing(spark, sf))
    return rounded(df.select("ordinal", "column", "top_count", "top_pct"))


@register(
    "a18_conversion_rate",
    f"""SELECT ordinal, "column", convertible, round(conversion_rate, 6) AS conversion_rate FROM ({v.profile_sql(v.SQL_EVENTS_MIXED)})
        WHERE spark_type = 'string'""",
)
def a18(spark, sf):
    df = profile.profile(v.events_mixed(spark, sf)).where("spark_type = 'string'")
    return rounded(df.select("ordinal", "column", "convertible", "conversion_rate"))


_DUPLICATES = """SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
    round(sum(n - 1) * 100.0 / sum(n), 6) AS duplicate_pct FROM (SELECT count(*) AS n FROM {source} GROUP BY ALL)"""


def _duplicates(source, columns):
    inner = f"SELECT {columns}, count(*) AS n FROM {source} GROUP BY {columns}"
    return _DUPLICATES.replace("(SELECT count(*) AS n FROM {source} GROUP BY ALL)", f"({inner})")


@register("a19_duplicate_rows", _duplicates("lineitem", "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"))
def a19(spark, sf):
    return rounded(profile.duplicates(v.lineitem_terms(spark, sf)))


@register("a19_duplicate_texts", _duplicates("documents", "text, lang, n_chars"))
def a19_text(spark, sf):
    return rounded(profile.duplicates(v.table(spark, sf, "documents").select("text", "lang", "n_chars")))


@register("a19_duplicates_with_missing", _duplicates(v.SQL_EVENTS_MISSING, "event_type, user_id"))
def a19_missing(spark, sf):
    return rounded(profile.duplicates(v.events_missing(spark, sf).select("event_type", "user_id")))


_CORR = [n for _, n, _ in v.named("lineitem", v.NUMERIC)]


def _corr_sql(source, columns):
    parts = [
        f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, '{a}' AS col1, '{b}' AS col2, "
        + ("CAST(1.0 AS DOUBLE)" if i == j else f"round(corr({a}, {b}), 6)")
        + f" AS correlation FROM {source}" + (" LIMIT 1" if i == j else "")
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    return "\nUNION ALL\n".join(f"SELECT * FROM ({p})" for p in parts)


@register("a20_correlation_matrix", _corr_sql("lineitem", _CORR))
def a20(spark, sf):
    return rounded(correlation.correlation_matrix(v.table(spark, sf, "lineitem"), _CORR))


_LINKED = """(SELECT p_partkey, p_size, p_retailprice, p_retailprice * 2 + p_size AS gross, p_partkey * p_size AS volume FROM part)"""


def _linked(spark, sf):
    part = v.table(spark, sf, "part")
    return part.select(
        "p_partkey", "p_size", "p_retailprice",
        (F.col("p_retailprice") * 2 + F.col("p_size")).alias("gross"),
        (F.col("p_partkey") * F.col("p_size")).alias("volume"),
    )


_LINKED_COLUMNS = ["p_partkey", "p_size", "p_retailprice", "gross", "volume"]


@register(
    "a21_high_correlation_pairs",
    f"SELECT * FROM ({_corr_sql(_LINKED, _LINKED_COLUMNS)}) WHERE i < j AND abs(correlation) > 0.7",
)
def a21(spark, sf):
    return rounded(eda.strong_pairs(correlation.correlations(_linked(spark, sf), _LINKED_COLUMNS)))


_ROW_MISSING = """SELECT (value IS NULL)::INT + (event_type IS NULL)::INT + (user_id IS NULL)::INT + (event_id IS NULL)::INT AS k FROM """


@register(
    "a22_row_missing_patterns",
    f"""SELECT CAST(k AS BIGINT) AS missing_columns_count, count(*) AS rows_with_pattern,
        round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS percentage
        FROM ({_ROW_MISSING} {v.SQL_EVENTS_MISSING}) GROUP BY k ORDER BY 2 DESC, 1 LIMIT 5""",
)
def a22(spark, sf):
    return rounded(eda.missing_patterns(v.events_missing(spark, sf)))


@register(
    "a23_missing_pattern_class",
    f"""SELECT CASE WHEN n = 0 THEN 'No missing data' WHEN n < 0.5 * total THEN 'Systematic' ELSE 'Random' END AS pattern,
        n AS rows_affected, round(n * 100.0 / total, 2) AS rows_affected_percentage
        FROM (SELECT count(*) FILTER (WHERE k > 0) AS n, count(*) AS total FROM ({_ROW_MISSING} {v.SQL_EVENTS_MISSING}))""",
)
def a23(spark, sf):
    return eda.missing_pattern_class(v.events_missing(spark, sf))


@register(
    "a25_type_distribution",
    f"SELECT detected_type, count(*) AS columns FROM ({v.typed_sql('lineitem')}) GROUP BY detected_type",
)
def a25(spark, sf):
    return inference.type_distribution(inference.column_types(v.table(spark, sf, "lineitem")))


_SKEW = (
    "count({c}) AS n, round(var_pop({c}), 4) AS variance, round((avg(CAST({c} AS DOUBLE)^3) - 3 * avg({c}) * avg(CAST({c} AS DOUBLE)^2)"
    " + 2 * avg({c})^3) / pow(var_pop({c}), 1.5), 4) AS skewness"
)


@register("a29_a30_moments", v.per_column("part", _SKEW, v.NUMERIC))
def a29(spark, sf):
    return rounded(profile.moments(v.table(spark, sf, "part")), 4)


@register(
    "a30_population_variance",
    v.per_column("lineitem", "round(var_pop({c}), 3) AS variance", ("double",)),
)
def a30(spark, sf):
    names = [n for _, n, _ in v.named("lineitem", ("double",))]
    return rounded(profile.moments(v.table(spark, sf, "lineitem"), names).select("ordinal", "column", "variance"), 3)


@register(
    "a37_target_extent",
    "SELECT max(o_totalprice) - min(o_totalprice) AS target_range, max(abs(o_totalprice)) AS target_scale FROM orders",
)
def a37(spark, sf):
    return target_extent(v.table(spark, sf, "orders"), "o_totalprice")


@register(
    "a38_estimated_size",
    """SELECT CAST(count(*) * 16 + sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source)) AS BIGINT) AS estimated_bytes,
        round((count(*) * 16 + sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source))) / 1048576.0, 2) AS estimated_size_mb
        FROM documents""",
)
def a38(spark, sf):
    return profile.estimated_size(v.table(spark, sf, "documents"))


@register("w01_top_values", _top_sql("orders", ("o_orderstatus", "o_orderpriority", "o_custkey"), 10))
def w01(spark, sf):
    return cells.top_values(v.table(spark, sf, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


_SAMPLES = [("doc_id", "doc_id"), ("text", "text"), ("lang", "lang"), ("source", "source"), ("n_chars", "n_chars"),
            ("quality", "quality"), ("toxic", "toxic")]


@register(
    "w06_distinct_samples",
    "\nUNION ALL\n".join(
        f"""SELECT '{n}' AS "column", CAST(row_number() OVER (ORDER BY {n}) AS INTEGER) AS rank, CAST({n} AS VARCHAR) AS value, count(*) AS n
            FROM {v.SQL_DOCUMENTS_LABELLED} WHERE {n} IS NOT NULL GROUP BY {n} QUALIFY rank <= 5"""
        for n, _ in _SAMPLES
    ),
)
def w06(spark, sf):
    return cells.sample_values(v.documents_labelled(spark, sf)).drop("ordinal")


@register(
    "w06_text_samples",
    """SELECT 'text' AS "column", CAST(row_number() OVER (ORDER BY text) AS INTEGER) AS rank, text AS value, count(*) AS n
        FROM documents GROUP BY text QUALIFY rank <= 5""",
)
def w06_text(spark, sf):
    return cells.sample_values(v.table(spark, sf, "documents"), ["text"]).drop("ordinal")


@register("t01_category_chart", _top_sql("orders", ("o_orderstatus", "o_orderpriority"), 10))
def t01(spark, sf):
    return eda.category_chart(v.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


@register(
    "t02_missing_chart",
    f"""SELECT ordinal, "column", missing_count FROM ({v.per_column(v.SQL_EVENTS_MISSING, _MISSING)})
        WHERE missing_count > 0 ORDER BY missing_count DESC""",
)
def t02(spark, sf):
    return eda.missing_chart(profile.missing_by_column(v.events_missing(spark, sf))).drop("missing_pct")


@register(
    "t03_top_missing_patterns",
    """SELECT CAST(k AS BIGINT) AS missing_columns_count, count(*) AS rows_with_pattern,
        round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percentage
        FROM (SELECT (l.quality IS NULL)::INT + (l.toxic IS NULL)::INT AS k FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
        GROUP BY k ORDER BY 2 DESC, 1 LIMIT 5""",
)
def t03(spark, sf):
    return rounded(eda.missing_patterns(v.documents_labelled(spark, sf)))


_HIST = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@register(
    "t07_histograms",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column", CAST(least(floor(({c} - lo) / CAST(hi - lo AS DOUBLE) * 30) + 1, 30) AS BIGINT) AS bin, count(*) AS n
            FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY ALL"""
        for c in _HIST
    ),
)
def t07(spark, sf):
    return eda.histograms(v.table(spark, sf, "lineitem"), _HIST)


@register(
    "t09_display_limits",
    f"""SELECT ordinal, "column", spark_type FROM ({v.profile_sql('lineitem')}) ORDER BY ordinal LIMIT 10""",
)
def t09(spark, sf):
    return shown_columns(profile.profile(v.table(spark, sf, "lineitem"))).select("ordinal", "column", "spark_type")


@register(
    "t09_shown_values",
    """SELECT lang, list_sort(list(DISTINCT source))[1:5] AS sources, CAST(greatest(count(DISTINCT source) - 5, 0) AS INTEGER) AS more
        FROM documents GROUP BY lang""",
)
def t09_values(spark, sf):
    held = v.table(spark, sf, "documents").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return shown_values(held, "sources")


@register(
    "u02_ordered_dedup",
    """SELECT string_agg(w, ' ' ORDER BY first) AS words, conv_id FROM
        (SELECT conv_id, role AS w, min(turn) AS first FROM conversations GROUP BY conv_id, role) GROUP BY conv_id""",
)
def u02(spark, sf):
    spoken = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    said = v.table(spark, sf, "conversations").groupBy("conv_id").agg(spoken.alias("roles"))
    return said.select("conv_id", F.array_join(first_of_each(F.col("roles")), " ").alias("words"))


@register(
    "u03_long_form",
    "\nUNION ALL\n".join(
        f"SELECT CAST({k} AS INTEGER) AS ordinal, count(*) AS \"cells\", count({n}) AS present FROM lineitem"
        for k, n, _ in v.named("lineitem")
    ),
)
def u03(spark, sf):
    long = cells.cells(v.table(spark, sf, "lineitem"))
    return long.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~cells.is_missing()).alias("present")
    )
