"""Fitted column steps, feature selection, splits and folds."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from registered import views as v
from registered.base import registrar
from registered.profiles import _LINKED, _LINKED_COLUMNS, _corr_sql, _linked, rounded
from tabulon.operators import selection, split
from tabulon.operators.encoders import CategoryEncoder, HashEncoder, category_counts, encoding_routes
from tabulon.operators.engineering import FeatureEngineer
from tabulon.operators.imputers import ConstantImputer, MedianImputer
from tabulon.operators.normality import normality
from tabulon.operators.outliers import OutlierClipper
from tabulon.operators.scalers import MINMAX, ROBUST, STANDARD, AutoScaler, scaling_report
from tabulon.plans.preparation import prepare
from tabulon.session import small_table

REGISTERED, register = registrar()


_FENCE = f"""(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, mean - 3 * sd AS zlo, mean + 3 * sd AS zhi FROM
    (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, avg(price) AS mean, stddev_samp(price) AS sd
     FROM {v.SQL_ORDERS_OUTLIER}))"""


def _treated(spark, sf, **options):
    df = v.orders_outlier(spark, sf)
    fitted = OutlierClipper(inputCols=["price"], **options).fit(df)
    return fitted.transform(df).select("o_orderkey", F.round("price", 4).alias("price"))


@register(
    "m01_outlier_clip",
    f"SELECT o_orderkey, round(greatest(least(price, hi), lo), 4) AS price FROM {v.SQL_ORDERS_OUTLIER}, {_FENCE}",
)
def m01(spark, sf):
    return _treated(spark, sf)


@register(
    "m01_outlier_zscore_to_null",
    f"SELECT o_orderkey, round(CASE WHEN price BETWEEN zlo AND zhi THEN price END, 4) AS price FROM {v.SQL_ORDERS_OUTLIER}, {_FENCE}",
)
def m01_zscore(spark, sf):
    return _treated(spark, sf, method="zscore", clip_outliers=False)


@register(
    "m01_outlier_both",
    f"SELECT o_orderkey, round(greatest(least(price, hi), lo), 4) AS price FROM {v.SQL_ORDERS_OUTLIER}, {_FENCE}",
)
def m01_both(spark, sf):
    return _treated(spark, sf, method="both")


@register(
    "m02_median_imputer",
    f"""SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {v.SQL_EVENTS_MISSING})), 6) AS value,
        coalesce(CAST(user_id AS DOUBLE), (SELECT median(user_id) FROM {v.SQL_EVENTS_MISSING})) AS user_id
        FROM {v.SQL_EVENTS_MISSING}""",
)
def m02(spark, sf):
    df = v.events_missing(spark, sf)
    fitted = MedianImputer(inputCols=["value", "user_id"]).fit(df)
    return rounded(fitted.transform(df).drop("event_type"))


@register(
    "m03_constant_imputer", f"SELECT event_id, coalesce(event_type, 'missing') AS event_type FROM {v.SQL_EVENTS_MISSING}"
)
def m03(spark, sf):
    df = v.events_missing(spark, sf).select("event_id", "event_type")
    return ConstantImputer(inputCols=["event_type"]).transform(df)


def _scaling_sql(source, columns):
    """The chosen method of columns with more than 5000 values."""
    parts = []
    for k, c in columns:
        parts.append(f"""
            SELECT CAST({k} AS INTEGER) AS ordinal, '{c}' AS "column", CASE WHEN beyond * 100.0 / n > 10 THEN 'RobustScaler'
                WHEN (lo >= 0 AND hi <= 1) OR hi - lo < 10 THEN 'MinMaxScaler' WHEN abs(skew) < 1 THEN 'StandardScaler' ELSE 'RobustScaler' END AS method,
                lo, hi, mean, sd, med, q1, q3
            FROM (SELECT count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS beyond, any_value(s) AS st FROM {source},
                    (SELECT CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3, 1 AS s FROM {source})),
                 (SELECT count({c}) AS n, CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi, avg({c}) AS mean, stddev_pop({c}) AS sd,
                    CAST(median({c}) AS DOUBLE) AS med, CAST(quantile_cont({c}, 0.25) AS DOUBLE) AS q1, CAST(quantile_cont({c}, 0.75) AS DOUBLE) AS q3,
                    (avg(CAST({c} AS DOUBLE)^3) - 3 * avg({c}) * avg(CAST({c} AS DOUBLE)^2) + 2 * avg({c})^3) / pow(var_pop({c}), 1.5) AS skew FROM {source})""")
    return f"""SELECT ordinal, "column", method,
        round(CASE method WHEN 'StandardScaler' THEN mean WHEN 'MinMaxScaler' THEN lo ELSE med END, 4) AS center,
        round(CASE method WHEN 'StandardScaler' THEN sd WHEN 'MinMaxScaler' THEN hi - lo ELSE q3 - q1 END, 4) AS scale
        FROM ({' UNION ALL '.join(parts)})"""


_SCALED = [(k, n) for k, n, _ in v.named("lineitem", v.NUMERIC)]


@register("m04_scaler_choice", _scaling_sql("lineitem", _SCALED))
def m04(spark, sf):
    return rounded(scaling_report(v.table(spark, sf, "lineitem"), [n for _, n in _SCALED]), 4)


@register("m04_scaler_choice_skewed", _scaling_sql("events", [(4, "value"), (2, "user_id")]))
def m04_events(spark, sf):
    return rounded(scaling_report(v.table(spark, sf, "events"), ["value", "user_id"]), 4)


def _rank_sql(source, columns):
    """Every row ranked by itself, and its score from a rational approximation of the normal quantile."""
    def quantile(p):
        tail = lambda q: (
            f"(((((-7.784894002430293e-03*{q}-3.223964580411365e-01)*{q}-2.400758277161838)*{q}-2.549732539343734)*{q}"
            f"+4.374664141464968)*{q}+2.938163982698783)/((((7.784695709041462e-03*{q}+3.224671290700398e-01)*{q}"
            f"+2.445134137142996)*{q}+3.754408661907416)*{q}+1)"
        )
        r = f"(({p}-0.5)*({p}-0.5))"
        return (
            f"CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2*ln({p}))')} WHEN {p} > 0.97575 THEN -{tail(f'sqrt(-2*ln(1-{p}))')} ELSE "
            f"({p}-0.5)*(((((-39.69683028665376*{r}+220.9460984245205)*{r}-275.9285104469687)*{r}+138.3577518672690)*{r}"
            f"-30.66479806614716)*{r}+2.506628277459239)/(((((-54.47609879822406*{r}+161.5858368580409)*{r}-155.6989798598866)*{r}"
            f"+66.80131188771972)*{r}-13.28068155288572)*{r}+1) END"
        )

    def of(k, c):
        return f"""SELECT CAST({k} AS INTEGER) AS ordinal, '{c}' AS "column", max(n) AS n,
            round(pow(sum((x - mean) * z), 2) / (max(n) * max(v) * sum(z * z)), 4) AS statistic,
            pow(sum((x - mean) * z), 2) / (max(n) * max(v) * sum(z * z)) >= 1 - exp(-1.2725 + 1.0521 * (max(b) - max(a))
                + 1.6448536269514722 * (1.0308 - 0.26758 * (max(b) + 2 / max(a)))) AS normal
            FROM (SELECT x, mean, v, n, a, ln(a) AS b, {quantile('p')} AS z
                FROM (SELECT x, mean, v, n, ln(least(n, 5000)) AS a, (r - 0.375) / (n + 0.25) AS p
                    FROM (SELECT CAST({c} AS DOUBLE) AS x, row_number() OVER (ORDER BY {c}) AS r, avg({c}) OVER () AS mean,
                        var_pop({c}) OVER () AS v, count(*) OVER () AS n FROM {source} WHERE {c} IS NOT NULL)))"""

    return "\nUNION ALL\n".join(of(k, c) for k, c in columns)


def _peaks(spark, sf):
    """Beside real columns, a sum of twelve digests (near normal) and the same with its halves pushed apart."""
    near = sum((F.conv(F.substring(F.md5(F.col("l_rowid")), 2 * k + 1, 2), 16, 10).cast("double") for k in range(12)), F.lit(0.0))
    rows = v.table(spark, sf, "lineitem").withColumn(
        "l_rowid", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    )
    return rows.select("l_quantity", "l_extendedprice", near.alias("near")).withColumn(
        "peaks", F.when(F.col("near") > 1530, F.col("near") + 1000).otherwise(F.col("near") - 1000)
    )


_SQL_PEAKS = (
    "(SELECT *, CASE WHEN near > 1530 THEN near + 1000 ELSE near - 1000 END AS peaks FROM (SELECT l_quantity, l_extendedprice, "
    + " + ".join(f"CAST(('0x' || substr(h, {2 * k + 1}, 2))::INTEGER AS DOUBLE)" for k in range(12))
    + " AS near FROM (SELECT *, md5(concat_ws('-', l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS VARCHAR))) AS h FROM lineitem)))"
)
_PEAK_COLUMNS = list(enumerate(["l_quantity", "l_extendedprice", "near", "peaks"]))


@register("m04_normality_by_ranks", _rank_sql(_SQL_PEAKS, _PEAK_COLUMNS))
def m04_ranks(spark, sf):
    found = normality(_peaks(spark, sf), [n for _, n in _PEAK_COLUMNS])
    return found.select("ordinal", "column", "n", F.round("statistic", 4).alias("statistic"), "normal")


def _scaled(spark, sf, method):
    df = v.table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(3.0).alias("same"))
    return rounded(AutoScaler(inputCols=["c_acctbal", "same"], method=method).fit(df).transform(df))


@register(
    "m05_standard_scaler",
    """SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS c_acctbal,
        CAST(0 AS DOUBLE) AS same FROM customer""",
)
def m05(spark, sf):
    return _scaled(spark, sf, STANDARD)


@register(
    "m06_minmax_scaler",
    """SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 6) AS c_acctbal,
        CAST(0 AS DOUBLE) AS same FROM customer""",
)
def m06(spark, sf):
    return _scaled(spark, sf, MINMAX)


@register(
    "m07_robust_scaler",
    """SELECT c_custkey, round((c_acctbal - (SELECT median(c_acctbal) FROM customer))
        / (SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer), 6) AS c_acctbal,
        CAST(0 AS DOUBLE) AS same FROM customer""",
)
def m07(spark, sf):
    return _scaled(spark, sf, ROBUST)


@register(
    "m08_encoding_routes",
    """SELECT "column", cardinality, CASE WHEN cardinality <= 10 THEN 'OneHot' WHEN cardinality <= 1000 THEN 'Frequency' ELSE 'Hash' END AS route
       FROM (SELECT 'c_name' AS "column", count(DISTINCT c_name) AS cardinality FROM customer UNION ALL
             SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM customer UNION ALL
             SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer)""",
)
def m08(spark, sf):
    return encoding_routes(category_counts(v.table(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_nationkey"]))


@register(
    "m09_one_hot",
    """SELECT event_id, CAST(event_type = 'error' AS DOUBLE) AS event_type_error, CAST(event_type = 'purchase' AS DOUBLE) AS event_type_purchase,
        CAST(event_type = 'signup' AS DOUBLE) AS event_type_signup, CAST(event_type = 'view' AS DOUBLE) AS event_type_view FROM events""",
)
def m09(spark, sf):
    df = v.table(spark, sf, "events").select("event_id", "event_type")
    return CategoryEncoder(inputCols=["event_type"]).fit(df).transform(df).drop("event_type")


@register(
    "m10_frequency",
    f"""SELECT event_id, CAST(n AS DOUBLE) AS event_type_freq FROM (SELECT event_id, coalesce(event_type, 'missing') AS t FROM {v.SQL_EVENTS_MISSING})
        JOIN (SELECT coalesce(event_type, 'missing') AS t, count(*) AS n FROM {v.SQL_EVENTS_MISSING} GROUP BY 1) USING (t)""",
)
def m10(spark, sf):
    df = v.events_missing(spark, sf).select("event_id", "event_type")
    steps = Pipeline(stages=[ConstantImputer(inputCols=["event_type"]), CategoryEncoder(inputCols=["event_type"], low=2)])
    return steps.fit(df).transform(df).drop("event_type")


@register(
    "m11_hash_buckets",
    """SELECT c_custkey, CAST(1 AS DOUBLE) AS marks, CAST(CAST('0x' || substr(md5(c_name), 1, 8) AS BIGINT) % 32 AS DOUBLE) AS name_bucket,
        CAST(CAST('0x' || substr(md5(c_mktsegment), 1, 8) AS BIGINT) % 32 AS DOUBLE) AS segment_bucket FROM customer""",
)
def m11(spark, sf):
    """Every row marks one bucket, and it is the bucket of the value's digest."""
    df = HashEncoder(inputCols=["c_name", "c_mktsegment"]).transform(v.table(spark, sf, "customer"))
    names, segments = ([F.col(f"{c}_hash_{b}") for b in range(32)] for c in ("c_name", "c_mktsegment"))

    def bucket(marks):
        return sum((m * b for b, m in enumerate(marks)), F.lit(0.0))

    return df.select(
        "c_custkey", sum(names, F.lit(0.0)).alias("marks"), bucket(names).alias("name_bucket"), bucket(segments).alias("segment_bucket")
    )


@register(
    "m12_feature_engineer",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
        CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek,
        CAST(hour(o_orderdate) AS INTEGER) AS o_orderdate_hour, CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS o_orderdate_is_weekend,
        CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter, round(o_custkey * o_totalprice, 2) AS o_custkey_x_o_totalprice,
        round(o_custkey / o_totalprice, 6) AS o_custkey_div_o_totalprice FROM orders""",
)
def m12(spark, sf):
    df = v.table(spark, sf, "orders")
    fitted = FeatureEngineer(inputCols=["o_custkey", "o_totalprice", "o_orderdate"], pairs=True).fit(df)
    made = fitted.transform(df).select("o_orderkey", *fitted.feature_names())
    return made.withColumns(
        {
            "o_custkey_x_o_totalprice": F.round("o_custkey_x_o_totalprice", 2),
            "o_custkey_div_o_totalprice": F.round("o_custkey_div_o_totalprice", 6),
        }
    )


_WEAK = [n for _, n, _ in v.named("lineitem", v.NUMERIC)]


@register(
    "m13_low_variance",
    "\nUNION ALL\n".join(
        f"""SELECT '{c}' AS "column" FROM (SELECT var_pop({c}) AS x FROM lineitem) WHERE x <= 0.01""" for c in _WEAK
    ),
)
def m13(spark, sf):
    gone = selection.low_variance(v.table(spark, sf, "lineitem"), _WEAK)
    return small_table(spark, [(c,) for c in gone], "column string")


@register(
    "m14_correlation_filter",
    f'SELECT DISTINCT col2 AS "column" FROM ({_corr_sql(_LINKED, _LINKED_COLUMNS)}) WHERE i < j AND abs(correlation) > 0.7',
)
def m14(spark, sf):
    gone = selection.correlated(_linked(spark, sf), _LINKED_COLUMNS, 0.7)
    return small_table(spark, [(c,) for c in gone], "column string")


def _wide(spark, sf):
    df = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")
    df = df.withColumn("label", F.col("quality").cast("double"))
    hashed = HashEncoder(inputCols=["lang", "source", "text"])
    encoded = CategoryEncoder(inputCols=["lang", "source"]).fit(df)
    names = ["doc_id", "n_chars", *hashed.feature_names(), *encoded.feature_names()]
    return encoded.transform(hashed.transform(df)).select(*names, "label"), names


@register(
    "m15_m16_model_selection",
    """SELECT true AS one_outcome_each, true AS under_the_cap, count(DISTINCT lang) + count(DISTINCT source) > 0 AS tried
        FROM documents JOIN labels USING (doc_id)""",
)
def m15(spark, sf):
    """Over a hundred features: variance, correlation and forest importance in turn."""
    df, names = _wide(spark, sf)
    fitted = selection.selector_for(names, "classification", "label").fit(df)
    rows = [
        *[(n, "selected") for n in fitted.state["selected"]],
        *[(n, k) for k in ("removed_constant", "removed_correlated", "removed_by_model") for n in fitted.state[k]],
    ]
    return small_table(
        spark,
        [(sorted(n for n, _ in rows) == sorted(names), len(fitted.state["selected"]) <= 50, bool(rows))],
        "one_outcome_each boolean, under_the_cap boolean, tried boolean",
    )


_ORDER = "md5('42|' || {k}), {k}"


def _ranked_sql(source, key, by=""):
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT *, row_number() OVER ({part} ORDER BY {_ORDER.replace('{k}', key)}) AS rn, count(*) OVER ({part}) AS total FROM {source})"""


@register(
    "m17_plain_split",
    f"SELECT o_orderkey, rn <= ceil(total * CAST(0.2 AS DOUBLE)) AS is_test FROM {_ranked_sql('orders', 'o_orderkey')}",
)
def m17(spark, sf):
    return split.split_in_place(v.table(spark, sf, "orders"), 0.2, ["o_orderkey"]).select("o_orderkey", "is_test")


@register(
    "w02_stratified_split",
    f"""SELECT event_id, event_type, rn <= round(total * CAST(0.3 AS DOUBLE)) AS is_test,
        CAST(CASE WHEN rn <= round(total * CAST(0.3 AS DOUBLE)) THEN rn ELSE rn - round(total * CAST(0.3 AS DOUBLE)) END AS BIGINT) AS position
        FROM {_ranked_sql('events', 'event_id', 'event_type')}""",
)
def w02(spark, sf):
    df = split.split(v.table(spark, sf, "events"), 0.3, ["event_id"], stratify="event_type")
    return df.select("event_id", "event_type", "is_test", "position")


@register(
    "w03_stratified_folds",
    f"SELECT event_id, event_type, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM {_ranked_sql('events', 'event_id', 'event_type')}",
)
def w03(spark, sf):
    return split.folds(v.table(spark, sf, "events"), 5, ["event_id"], "event_type").select("event_id", "event_type", "fold")


@register(
    "w03_plain_folds",
    f"SELECT p_partkey, CAST((rn - 1) % 4 AS INTEGER) AS fold FROM {_ranked_sql('part', 'p_partkey')}",
)
def w03_plain(spark, sf):
    return split.folds(v.table(spark, sf, "part"), 4, ["p_partkey"]).select("p_partkey", "fold")


@register(
    "m18_whole_row_split",
    """SELECT l_returnflag, count(*) AS "rows", CAST(round(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS test_rows FROM lineitem GROUP BY l_returnflag""",
)
def m18_whole_row(spark, sf):
    """Without a key; copies of a row spread over both sides, the class sizes stay exact."""
    df = split.split(v.lineitem_terms(spark, sf), 0.2, stratify="l_returnflag")
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"))


_DATE_NAMES = ", ".join(
    f"('o_orderdate_{p}')" for p in ("year", "month", "day", "dayofweek", "hour", "is_weekend", "quarter")
)


@register(
    "m19_feature_names",
    f"""SELECT f AS feature FROM (VALUES ('o_orderkey'), ('o_custkey'), {_DATE_NAMES}) t(f) UNION ALL
        SELECT 'o_orderstatus_' || o_orderstatus FROM orders WHERE o_orderstatus > (SELECT min(o_orderstatus) FROM orders) GROUP BY o_orderstatus UNION ALL
        SELECT 'o_orderpriority_' || o_orderpriority FROM orders WHERE o_orderpriority > (SELECT min(o_orderpriority) FROM orders) GROUP BY o_orderpriority""",
)
def m19(spark, sf):
    made = prepare(v.table(spark, sf, "orders"), "o_totalprice", key=["o_orderkey"])
    return small_table(spark, [(n,) for n in made.feature_names], "feature string")


_LABELLED = _ranked_sql("(SELECT d.*, quality, toxic FROM documents d JOIN labels USING (doc_id))", "doc_id", "quality")


@register(
    "m18_full_preparation",
    f"""WITH d AS (SELECT *, round(total * CAST(0.2 AS DOUBLE)) AS cut FROM {_LABELLED}),
        t AS (SELECT * FROM d WHERE rn > cut),
        q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS z FROM t),
        c AS (SELECT doc_id, least(greatest(CAST(n_chars AS DOUBLE), a - 1.5 * (z - a)), z + 1.5 * (z - a)) AS x FROM d, q),
        k AS (SELECT count(*) AS n, min(x) AS low, max(x) AS high, avg(x) AS mean, stddev_pop(x) AS sd, quantile_cont(x, 0.5) AS m,
              quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS z FROM c JOIN t USING (doc_id)),
        f AS (SELECT avg(CAST(x < 2.5 * a - 1.5 * z OR x > 2.5 * z - 1.5 * a AS INTEGER)) AS out, avg(((x - mean) / sd)^3) AS skew
              FROM c JOIN t USING (doc_id), k),
        w AS (SELECT CASE WHEN n < 10 THEN mean WHEN out > 0.1 THEN m WHEN high - low < 10 THEN low WHEN abs(skew) < 1 THEN mean ELSE m END AS mid,
              CASE WHEN n < 10 THEN sd WHEN out > 0.1 THEN z - a WHEN high - low < 10 THEN high - low WHEN abs(skew) < 1 THEN sd ELSE z - a END AS wide FROM k, f),
        s AS (SELECT source, CAST(count(*) AS DOUBLE) AS seen FROM t GROUP BY source),
        v AS (SELECT CAST(6 + (SELECT count(DISTINCT lang) FROM t) - 1 - 2
              + (SELECT CASE WHEN count(DISTINCT text) > 100 AND count(DISTINCT text) > 0.8 * count(*) THEN 32 ELSE 0 END FROM d) AS BIGINT) AS width)
        SELECT CAST(quality AS DOUBLE) AS label, rn <= cut AS is_test, CAST(CASE WHEN rn <= cut THEN rn ELSE rn - cut END AS BIGINT) AS position,
            round((x - mid) / CASE WHEN wide = 0 THEN 1 ELSE wide END, 6) AS n_chars,
            CASE WHEN lang = (SELECT min(lang) FROM t) THEN '' ELSE lang END AS lang, coalesce(seen, 0) AS source_freq,
            CAST(CAST('0x' || substr(md5(text), 1, 8) AS BIGINT) % 32 AS INTEGER) AS text_bucket, width
        FROM d JOIN c USING (doc_id) LEFT JOIN s USING (source), w, v""",
)
def m18(spark, sf):
    """Feature values of every labelled document: scaled length, language flag, frequency of the source, bucket of the text."""
    df = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")
    made = prepare(df, "quality", "classification", key=["doc_id"])
    x, place = vector_to_array("features"), {n: k for k, n in enumerate(made.feature_names)}
    langs = [n for n in place if n.startswith("lang_")]
    buckets = [n for n in place if n.startswith("text_hash_")]
    sides = made.train.withColumn("is_test", F.lit(False)).unionByName(made.test.withColumn("is_test", F.lit(True)))
    return sides.select(
        "label",
        "is_test",
        F.col("position").cast("bigint").alias("position"),
        F.round(x[place["n_chars"]], 6).alias("n_chars"),
        F.concat(*[F.when(x[place[n]] == 1, F.lit(n.removeprefix("lang_"))).otherwise("") for n in langs]).alias("lang"),
        x[place["source_freq"]].alias("source_freq"),
        (F.array_position(F.slice(x, place[buckets[0]] + 1, len(buckets)), 1.0) - 1).cast("int").alias("text_bucket"),
        F.lit(len(place)).cast("bigint").alias("width"),
    )
