"""Inference, verdicts, suggestions, the quality report and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered import views as v
from registered.base import registrar
from registered.profiles import _DISTINCT, _MISSING, rounded
from tabulon.functions import coercion, grading
from tabulon.operators import inference, outliers, profile
from tabulon.operators.encoders import CategoryEncoder
from tabulon.operators.engineering import FeatureEngineer, date_features, interaction_plan, interactions
from tabulon.plans import quality
from tabulon.plans.preparation import class_labels, index_classes, numeric_label

REGISTERED, register = registrar()


_TERMS = "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


def _score_sql(source, columns):
    names = [c.strip() for c in columns.split(",")]
    missing = " + ".join(f"count(*) - count({c})" for c in names)
    return f"""
        SELECT greatest(round(score, 1), 0.0) AS overall_score,
            CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 80 THEN 'Good' WHEN score >= 70 THEN 'Fair'
                WHEN score >= 60 THEN 'Poor' ELSE 'Critical' END AS grade,
            round(-a, 6) AS missing_data_impact, round(-b, 6) AS duplicate_impact
        FROM (SELECT *, 100.0 - a - b AS score FROM (
            SELECT least(m * 2, CAST(50 AS DOUBLE)) AS a, least(d * 3, CAST(30 AS DOUBLE)) AS b FROM
                (SELECT ({missing}) * 100.0 / (count(*) * {len(names)}) AS m FROM {source}),
                (SELECT sum(n - 1) * 100.0 / sum(n) AS d FROM (SELECT {columns}, count(*) AS n FROM {source} GROUP BY {columns}))))"""


@register("a24_quality_score_copies", _score_sql("lineitem", _TERMS))
def a24(spark, sf):
    return rounded(quality.quality_score(v.lineitem_terms(spark, sf)))


@register("a24_quality_score_missing", _score_sql(v.SQL_EVENTS_MISSING, "event_id, value, event_type, user_id"))
def a24_missing(spark, sf):
    return rounded(quality.quality_score(v.events_missing(spark, sf)))


@register(
    "f01_numeric_coercion",
    f"SELECT event_id, {v.number('raw')} AS raw, {v.number('half')} AS half, {v.number('clean')} AS clean FROM {v.SQL_EVENTS_MIXED}",
)
def f01(spark, sf):
    df = v.events_mixed(spark, sf)
    return df.select("event_id", *[coercion.number_of(df, c).alias(c) for c in ("raw", "half", "clean")])


@register(
    "f02_clip_keeps_nulls",
    f"SELECT event_id, CASE WHEN value IS NOT NULL THEN greatest(least(value, 40.0), 5.0) END AS value FROM {v.SQL_EVENTS_MISSING}",
)
def f02(spark, sf):
    return v.events_missing(spark, sf).select("event_id", coercion.clip(F.col("value"), 5, 40).alias("value"))


@register(
    "f03_outlier_to_null",
    f"SELECT event_id, CASE WHEN value BETWEEN 5 AND 40 THEN value END AS value FROM {v.SQL_EVENTS_MISSING}",
)
def f03(spark, sf):
    return v.events_missing(spark, sf).select("event_id", coercion.keep_inside(F.col("value"), 5, 40).alias("value"))


def _parts_sql(source, column, key):
    c = column
    return f"""SELECT {key}, CAST(year({c}) AS INTEGER) AS d_year, CAST(month({c}) AS INTEGER) AS d_month, CAST(day({c}) AS INTEGER) AS d_day,
        CAST(isodow({c}) - 1 AS INTEGER) AS d_dayofweek, CAST(hour({c}) AS INTEGER) AS d_hour,
        CAST(isodow({c}) >= 6 AS INTEGER) AS d_is_weekend, CAST(quarter({c}) AS INTEGER) AS d_quarter FROM {source}"""


@register("f04_date_parts", _parts_sql("events", "ts", "event_id"))
def f04(spark, sf):
    df = v.table(spark, sf, "events").select("event_id", F.col("ts").alias("d"))
    return date_features(df, ["d"]).drop("d")


@register(
    "f05_date_text_detection",
    """SELECT CAST(o AS INTEGER) AS ordinal, c AS "column", r AS parse_rate, r > 0.8 AS is_date_text FROM (
        SELECT 1 AS o, 'o_orderstatus' AS c, CAST(count(TRY_CAST(o_orderstatus AS TIMESTAMP)) AS DOUBLE) / count(*) AS r FROM orders UNION ALL
        SELECT 2, 'o_orderpriority', CAST(count(TRY_CAST(o_orderpriority AS TIMESTAMP)) AS DOUBLE) / count(*) FROM orders UNION ALL
        SELECT 3, 'date_text', CAST(count(TRY_CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP)) AS DOUBLE) / count(*) FROM orders)""",
)
def f05(spark, sf):
    return inference.date_text_columns(v.orders_datestr(spark, sf))


@register(
    "f06_text_to_datetime",
    f"""SELECT o_orderkey, CAST(TRY_CAST(date_text AS TIMESTAMP) AS VARCHAR) AS moment,
        CAST(TRY_CAST(o_orderpriority AS TIMESTAMP) AS VARCHAR) AS none FROM {v.SQL_ORDERS_DATESTR}""",
)
def f06(spark, sf):
    return v.orders_datestr(spark, sf).select(
        "o_orderkey",
        coercion.text_to_timestamp(F.col("date_text")).cast("string").alias("moment"),
        coercion.text_to_timestamp(F.col("o_orderpriority")).cast("string").alias("none"),
    )


_SPELLED = ("us", "german", "month", "day_first", "bare_year", "clock")


def _spelled(spark, sf):
    moment = F.col("o_orderdate")
    forms = ("MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMMM yyyy HH:mm", "yyyy", "HH:mm")
    return v.table(spark, sf, "orders").select("o_orderkey", *[F.date_format(moment, f).alias(n) for f, n in zip(forms, _SPELLED)])


@register(
    "f05_spelled_dates",
    """SELECT CAST(k AS INTEGER) AS ordinal, name AS "column", CAST(rate AS DOUBLE) AS parse_rate, rate > 0.8 AS is_date_text
        FROM (VALUES (1, 'us', 1.0), (2, 'german', 1.0), (3, 'month', 1.0), (4, 'day_first', 1.0), (5, 'bare_year', 0.0), (6, 'clock', 0.0)) t(k, name, rate)
        WHERE (SELECT count(o_orderdate) FROM orders) > 0""",
)
def f05_spelled(spark, sf):
    """American, German and month-name dates are dates; bare years and clock times are not."""
    return inference.date_text_columns(_spelled(spark, sf))


@register(
    "f06_spelled_dates",
    """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS us, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS german,
        CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS month, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day_first FROM orders""",
)
def f06_spelled(spark, sf):
    read = {n: coercion.text_to_timestamp(F.col(n)).cast("date").cast("string").alias(n) for n in _SPELLED[:4]}
    return _spelled(spark, sf).select("o_orderkey", *read.values())


@register(
    "f07_f08_interactions",
    """SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS l_quantity_x_l_extendedprice,
        round(l_quantity / l_extendedprice, 9) AS l_quantity_div_l_extendedprice, round(l_quantity * l_discount, 4) AS l_quantity_x_l_discount,
        round(l_quantity * l_tax, 4) AS l_quantity_x_l_tax, round(l_extendedprice * l_discount, 4) AS l_extendedprice_x_l_discount
        FROM lineitem""",
)
def f07(spark, sf):
    df = v.table(spark, sf, "lineitem")
    plan = interaction_plan(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    made = interactions(df, plan)
    return made.select(
        "l_orderkey", "l_linenumber", *[F.round(n, 9 if "_div_" in n else 4).alias(n) for n, _, _ in plan]
    )


_SEVERITY = "CASE WHEN {p} > 50 THEN 'Critical' WHEN {p} > 20 THEN 'High' WHEN {p} > 5 THEN 'Medium' ELSE 'Low' END"


@register(
    "f09_missing_severity",
    f"""SELECT ordinal, "column", missing_count, round(missing_pct, 2) AS missing_percentage, {_SEVERITY.replace('{p}', 'missing_pct')} AS severity
        FROM ({v.profile_sql(v.SQL_EVENTS_MISSING)}) WHERE missing_count > 0""",
)
def f09(spark, sf):
    return quality.missing_columns(v.events_missing(spark, sf))


def _fence_sql(source, column, ordinal, method="iqr"):
    iqr = f"count(*) FILTER (WHERE {column} < lo OR {column} > hi)"
    z = f"count(*) FILTER (WHERE abs({column} - mean) / pop > 3)"
    found = {"iqr": iqr, "zscore": z, "both": f"least({iqr} + {z}, count(*))"}[method]
    lower, upper = ("mean - 3 * sample", "mean + 3 * sample") if method == "zscore" else ("lo", "hi")
    return f"""SELECT CAST({ordinal} AS INTEGER) AS ordinal, '{column}' AS "column", round(any_value({lower}), 4) AS lower,
        round(any_value({upper}), 4) AS upper, {found} AS outliers_detected, round({found} * 100.0 / count(*), 6) AS outlier_percentage,
        CASE WHEN {found} * 100.0 / count(*) > 15 THEN 'High' WHEN {found} * 100.0 / count(*) > 5 THEN 'Medium' ELSE 'Low' END AS severity
        FROM {source}, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, mean, pop, sample FROM
            (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3, avg({column}) AS mean,
                stddev_pop({column}) AS pop, stddev_samp({column}) AS sample FROM {source}))"""


def _fences(df):
    return df.select(
        "ordinal", "column", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"),
        "outliers_detected", F.round("outlier_percentage", 6).alias("outlier_percentage"), "severity",
    )


@register("a26_iqr_bounds", _fence_sql(v.SQL_ORDERS_OUTLIER, "price", 2))
def a26(spark, sf):
    return _fences(outliers.outlier_report(v.orders_outlier(spark, sf), ["price"]))


@register("a27_zscore_bounds", _fence_sql(v.SQL_ORDERS_OUTLIER, "price", 2, "zscore"))
def a27(spark, sf):
    return _fences(outliers.outlier_report(v.orders_outlier(spark, sf), ["price"], method="zscore"))


@register("a28_both_counts", _fence_sql("events", "value", 4, "both"))
def a28(spark, sf):
    return _fences(outliers.outlier_report(v.table(spark, sf, "events"), ["value"], method="both"))


@register(
    "f10_f16_outlier_analysis",
    "\nUNION ALL\n".join(
        _fence_sql("lineitem", c, k) for k, c, _ in v.named("lineitem", v.NUMERIC)
    ),
)
def f10(spark, sf):
    return _fences(outliers.outlier_report(v.table(spark, sf, "lineitem"), [n for _, n, _ in v.named("lineitem", v.NUMERIC)]))


@register(
    "f11_cardinality_class",
    f"""SELECT ordinal, "column", CASE WHEN distinct_count <= 10 THEN 'Low' WHEN distinct_count <= 1000 THEN 'Medium' ELSE 'High' END AS cardinality
        FROM ({v.per_column('lineitem', _DISTINCT)})""",
)
def f11(spark, sf):
    return profile.profile(v.table(spark, sf, "lineitem")).select("ordinal", "column", "cardinality")


@register(
    "f12_score_grade",
    """SELECT doc_id, CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 80 THEN 'Good' WHEN s >= 70 THEN 'Fair' WHEN s >= 60 THEN 'Poor' ELSE 'Critical' END AS grade
       FROM (SELECT doc_id, n_chars % 101 AS s FROM documents)""",
)
def f12(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", grading.score_grade(F.col("n_chars") % 101).alias("grade"))


@register(
    "f13_column_issues",
    f"""SELECT ordinal, "column", concat_ws('; ', CASE WHEN missing_pct > 50 THEN 'High missing data (>50%)'
            WHEN missing_pct > 20 THEN 'Moderate missing data (>20%)' END,
        CASE WHEN distinct_count = 1 THEN 'Constant values' WHEN distinct_count = "rows" THEN 'All unique values' END) AS issues
        FROM ({v.profile_sql(v.SQL_EVENTS_MISSING)})""",
)
def f13(spark, sf):
    df = profile.profile(v.events_missing(spark, sf))
    return df.select("ordinal", "column", F.array_join("issues", "; ").alias("issues"))


@register(
    "f14_recommendations",
    f"""SELECT CAST(row_number() OVER (ORDER BY part, ordinal) AS INTEGER) AS position, recommendation FROM (
        SELECT 1 AS part, 0 AS ordinal, 'Consider removing columns with >50% missing data: ' || string_agg("column", ', ' ORDER BY ordinal) AS recommendation
            FROM ({v.profile_sql(v.SQL_EVENTS_MISSING)}) WHERE missing_pct > 50 HAVING count(*) > 0
        UNION ALL SELECT 3, ordinal, 'Column ''' || "column" || ''' has very high cardinality - consider feature engineering'
            FROM ({v.profile_sql(v.SQL_EVENTS_MISSING)}) WHERE distinct_count > 0.8 * "rows")""",
)
def f14(spark, sf):
    return quality.recommendations(v.events_missing(spark, sf))


@register(
    "f14_recommend_dedup",
    f"""SELECT CAST(1 AS INTEGER) AS position, 'Remove ' || sum(n - 1) || ' duplicate rows to improve data quality' AS recommendation
        FROM (SELECT {_TERMS}, count(*) AS n FROM lineitem GROUP BY {_TERMS})""",
)
def f14_copies(spark, sf):
    return quality.recommendations(v.lineitem_terms(spark, sf))


@register(
    "f15_preparation_actions",
    f"""SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS position, category, "column", action FROM (
        SELECT 1 AS k, 'outlier_treatment' AS category, 'price' AS "column",
            'Applied IQR outlier clipping to ''price'' (' || outliers_detected || ' outliers)' AS action
            FROM ({_fence_sql(v.SQL_ORDERS_OUTLIER, "price", 2)}) WHERE outliers_detected > 0
        UNION ALL SELECT 2, 'encoding_applied', 'o_orderstatus',
            'Applied OneHot (cardinality: ' || count(DISTINCT o_orderstatus) || ') encoding to ''o_orderstatus''' FROM orders)""",
)
def f15(spark, sf):
    df = v.orders_outlier(spark, sf)
    info = {
        "outliers": outliers.OutlierClipper(inputCols=["price"]).fit(df).state["records"],
        "encoding": CategoryEncoder(inputCols=["o_orderstatus"]).fit(df).described(),
    }
    return quality.preparation_actions(df, info)


@register(
    "f15_engineered_actions",
    """SELECT * FROM (SELECT CAST(1 AS INTEGER) AS position, 'feature_engineering' AS category, CAST(NULL AS VARCHAR) AS "column", 'Created 7 new features' AS action
        UNION ALL SELECT CAST(1 + i AS INTEGER), 'feature_engineering', 'o_orderdate_' || p, 'Generated feature: ''o_orderdate_' || p || ''''
            FROM (VALUES (1, 'year'), (2, 'month'), (3, 'day'), (4, 'dayofweek'), (5, 'hour')) t(i, p)
        UNION ALL SELECT CAST(7 AS INTEGER), 'feature_engineering', NULL, '... and 2 more')
        WHERE (SELECT count(o_orderdate) FROM orders) > 0""",
)
def f15_dates(spark, sf):
    df = v.table(spark, sf, "orders")
    return quality.preparation_actions(df, {"engineered": FeatureEngineer().fit(df).feature_names()})


def _types(df):
    return df.select("ordinal", "column", "detected_type")


@register("f17_semantic_types", f'SELECT ordinal, "column", detected_type FROM ({v.typed_sql("lineitem")})')
def f17(spark, sf):
    return _types(inference.column_types(v.table(spark, sf, "lineitem")))


@register("f17_types_of_mixed_text", f'SELECT ordinal, "column", detected_type FROM ({v.typed_sql(v.SQL_EVENTS_MIXED)})')
def f17_mixed(spark, sf):
    return _types(inference.column_types(v.events_mixed(spark, sf)))


@register("f17_types_of_documents", f'SELECT ordinal, "column", detected_type FROM ({v.typed_sql("documents")})')
def f17_documents(spark, sf):
    return _types(inference.column_types(v.table(spark, sf, "documents")))


def _verdict(source):
    return f'SELECT ordinal, "column", detected_type, should_drop, should_hash_encode, warnings FROM ({v.verdict_sql(source)})'


def _shown(df):
    texts = F.transform("warnings", lambda w: F.regexp_replace(w, "^Column '([^']*)'", "$1"))
    return inference.column_verdicts(df).select(
        "ordinal", "column", "detected_type", "should_drop", "should_hash_encode",
        F.array_join(texts, " | ").alias("warnings"),
    )


@register("f18_verdicts_constant", _verdict(v.SQL_LINEITEM_CONSTANT))
def f18(spark, sf):
    return _shown(v.lineitem_constant(spark, sf))


@register("f18_verdicts_missing", _verdict(v.SQL_EVENTS_MISSING))
def f18_missing(spark, sf):
    return _shown(v.events_missing(spark, sf))


@register("f18_verdicts_mixed", _verdict(v.SQL_EVENTS_MIXED))
def f18_mixed(spark, sf):
    return _shown(v.events_mixed(spark, sf))


@register("f18_verdicts_documents", _verdict("documents"))
def f18_documents(spark, sf):
    return _shown(v.table(spark, sf, "documents"))


_KEYWORDS = " OR ".join(f"contains(lower(\"column\"), '{w}')" for w in inference.TARGET_KEYWORDS)


def _targets(source):
    return f"""SELECT ordinal, "column", reason FROM (SELECT *, CASE WHEN {_KEYWORDS} THEN 'keyword'
        WHEN ordinal = (SELECT max(ordinal) FROM ({v.typed_sql(source)})) THEN 'last column'
        WHEN detected_type = 'numerical' AND distinct_count > 1 AND distinct_count < 0.9 * "rows" THEN 'varied number' END AS reason
        FROM ({v.typed_sql(source)})) WHERE reason IS NOT NULL"""


@register("f19_target_suggestions", _targets("lineitem"))
def f19(spark, sf):
    return inference.target_suggestions(inference.column_types(v.table(spark, sf, "lineitem")))


@register("f19_targets_of_documents", _targets(v.SQL_DOCUMENTS_LABELLED))
def f19_documents(spark, sf):
    return inference.target_suggestions(inference.column_types(v.documents_labelled(spark, sf)))


_TARGETS = (
    ("lineitem", "l_returnflag", "string"), ("lineitem", "l_extendedprice", "double"), ("lineitem", "l_linenumber", "int"),
    ("labels", "quality", "int"), ("orders", "o_totalprice", "double"), ("part", "p_size", "int"),
    ("customer", "c_nationkey", "int"), ("orders", "o_orderkey", "bigint"),
)


def _problem_sql(source, column, kind):
    if kind == "string":
        return f"SELECT '{column}' AS target, 'classification' AS problem_type FROM (SELECT count({column}) FROM {source})"
    wide = "hi - lo > 1000 AND kinds > 20" if kind in ("int", "bigint") else "FALSE"
    return f"""SELECT '{column}' AS target, CASE WHEN kinds = 2 AND lo = 0 AND hi = 1 THEN 'classification'
        WHEN kinds <= 10 AND kinds < 0.05 * n THEN 'classification' WHEN ({wide}) OR kinds > 20 OR kinds > 0.1 * n THEN 'regression'
        ELSE 'classification' END AS problem_type
        FROM (SELECT count(*) AS n, count(DISTINCT {column}) AS kinds, min({column}) AS lo, max({column}) AS hi FROM {source})"""


@register("f20_problem_type", "\nUNION ALL\n".join(_problem_sql(*t) for t in _TARGETS))
def f20(spark, sf):
    out = None
    for source, column, _ in _TARGETS:
        part = inference.problem_type(v.table(spark, sf, source), column)
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "f21_label_encoding",
    "SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS DOUBLE) AS label FROM events",
)
def f21(spark, sf):
    df = v.table(spark, sf, "events")
    return index_classes(df, "event_type", class_labels(df, "event_type")).select("event_id", "label")


@register(
    "f22_numeric_target",
    f"SELECT event_id, CAST({v.number('CAST(value AS VARCHAR)')} AS DOUBLE) AS label FROM events",
)
def f22(spark, sf):
    df = v.table(spark, sf, "events").withColumn("text_value", F.col("value").cast("string"))
    return numeric_label(df, "text_value").select("event_id", "label")


@register(
    "f23_error_flag",
    f"SELECT event_id, CAST(raw IS NOT NULL AND ({v.number('raw')}) IS NULL AS INTEGER) AS raw_error FROM {v.SQL_EVENTS_MIXED}",
)
def f23(spark, sf):
    return v.events_mixed(spark, sf).select("event_id", coercion.error_flag(F.col("raw")).alias("raw_error"))


@register("f24_rounding", "SELECT event_id, round(value, 1) AS one, round(value / 3, 2) AS two FROM events")
def f24(spark, sf):
    return v.table(spark, sf, "events").select(
        "event_id", F.round("value", 1).alias("one"), F.round(F.col("value") / 3, 2).alias("two")
    )


@register(
    "report_overview",
    f"""SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(5 AS BIGINT) AS total_columns,
        round((sum(n) * 24 + (SELECT sum(strlen(l_returnflag) + strlen(l_linestatus)) FROM lineitem)) / 1048576.0, 2) AS estimated_size_mb,
        CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, round(sum(n - 1) * 100.0 / sum(n), 2) AS duplicate_percentage
        FROM (SELECT {_TERMS}, count(*) AS n FROM lineitem GROUP BY {_TERMS})""",
)
def report_overview(spark, sf):
    return quality.overview(v.lineitem_terms(spark, sf))


@register(
    "report_missing",
    f"""SELECT CAST(sum(missing_count) AS BIGINT) AS total_missing_values,
        CAST(count(*) FILTER (WHERE missing_count > 0) AS BIGINT) AS columns_with_missing,
        round(sum(missing_count) * 100.0 / sum("rows"), 2) AS missing_data_percentage
        FROM ({v.per_column(v.SQL_DOCUMENTS_LABELLED, _MISSING + ', count(*) AS "rows"')})""",
)
def report_missing(spark, sf):
    return quality.missing_analysis(v.documents_labelled(spark, sf))


def _column_report_sql(source):
    samples = "\nUNION ALL\n".join(
        f"""SELECT {k} AS ordinal, (SELECT string_agg(x, ',' ORDER BY r) FROM (SELECT CAST({n} AS VARCHAR) AS x, row_number() OVER (ORDER BY {n}) AS r
            FROM {source} WHERE {n} IS NOT NULL GROUP BY {n}) WHERE r <= 5) AS sample_values"""
        for k, n, _ in v.named(source)
    )
    numbers = v.per_column(
        source,
        "CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, round(avg({c}), 4) AS mean_value, "
        "round(stddev_samp({c}), 4) AS std_value, count(*) FILTER (WHERE {c} = 0) AS zeros_count, count(*) FILTER (WHERE {c} < 0) AS negative_count",
        v.NUMERIC,
    )
    texts = v.per_column(
        source,
        "round(avg(length({c})), 1) AS avg_length, max(length({c})) AS max_length, "
        "count(*) FILTER (WHERE {c} = '') AS empty_strings, count(*) FILTER (WHERE trim({c}) = '') AS whitespace_only",
        ("string",),
    )
    return f"""SELECT p.ordinal, p."column" AS column_name, detected_type, spark_type, distinct_count AS unique_values,
        round(distinct_pct, 2) AS unique_percentage, missing_count, round(missing_pct, 2) AS missing_percentage,
        CASE WHEN distinct_count <= 10 THEN 'Low' WHEN distinct_count <= 1000 THEN 'Medium' ELSE 'High' END AS cardinality,
        concat_ws('; ', CASE WHEN missing_pct > 50 THEN 'High missing data (>50%)' WHEN missing_pct > 20 THEN 'Moderate missing data (>20%)' END,
            CASE WHEN distinct_count = 1 THEN 'Constant values' WHEN distinct_count = "rows" THEN 'All unique values' END) AS data_quality_issues,
        sample_values, min_value, max_value, mean_value, std_value, zeros_count, negative_count,
        avg_length, max_length, empty_strings, whitespace_only
        FROM ({v.typed_sql(source)}) p JOIN ({samples}) s ON p.ordinal = s.ordinal
        LEFT JOIN ({numbers}) n ON p.ordinal = n.ordinal LEFT JOIN ({texts}) t ON p.ordinal = t.ordinal"""


@register("report_columns", _column_report_sql(v.SQL_DOCUMENTS_LABELLED))
def report_columns(spark, sf):
    df = quality.column_analysis(v.documents_labelled(spark, sf))
    return df.withColumns(
        {
            "sample_values": F.array_join("sample_values", ","),
            "data_quality_issues": F.array_join("data_quality_issues", "; "),
            "mean_value": F.round("mean_value", 4),
            "std_value": F.round("std_value", 4),
        }
    )
