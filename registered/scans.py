"""Scans, sources, sinks, projections, filters and joins."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString
from pyspark.sql import functions as F

from registered import views as v
from registered.base import registrar
from tabulon.operators.encoders import CategoryEncoder, FittedCategories
from tabulon.operators.inference import column_types, column_verdicts
from tabulon.operators.outliers import iqr_frame
from tabulon.operators.profile import distinct_counts, missing_by_column, per_column, profile
from tabulon.operators.selection import FittedSelection
from tabulon.plans.preparation import class_labels, index_classes, route_columns, separate
from tabulon.plans.quality import high_missing
from tabulon.plans.training import candidates
from tabulon.session import scratch_path, small_table
from tabulon.sources import readers, registry
from tabulon.sources.profiles import DISTINCT_ERROR, QUANTILE_ERROR

REGISTERED, register = registrar()


@register(
    "s01_csv_scan",
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def s01(spark, sf):
    path = scratch_path(spark, "part") + ".csv"
    v.table(spark, sf, "part").write.option("header", True).csv(path)
    return readers.read_table(spark, path)


@register(
    "s01_csv_latin1",
    "SELECT doc_id, CASE WHEN lang = 'de' THEN 'fünf' ELSE 'été' END AS word, source FROM documents",
)
def s01_latin1(spark, sf):
    path = scratch_path(spark, "latin") + ".csv"
    words = v.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "de", "fünf").otherwise("été").alias("word"), "source"
    )
    words.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_table(spark, path)


@register(
    "s02_null_markers",
    f"SELECT event_id, event_type, value FROM {v.SQL_EVENTS_MISSING}",
)
def s02(spark, sf):
    path = scratch_path(spark, "markers") + ".csv"
    v.events_missing(spark, sf).select(
        "event_id",
        F.coalesce("event_type", F.lit("N/A")).alias("event_type"),
        F.coalesce(F.col("value").cast("string"), F.lit("NaN")).alias("value"),
    ).write.option("header", True).csv(path)
    return readers.read_table(spark, path)


@register(
    "s03_read_by_suffix",
    """SELECT 'json' AS format, count(*) AS "rows", count(DISTINCT c_name) AS names, round(sum(c_acctbal), 2) AS balance FROM customer
       UNION ALL SELECT 'orc', count(*), count(DISTINCT c_name), round(sum(c_acctbal), 2) FROM customer
       UNION ALL SELECT 'parquet', count(*), count(DISTINCT c_name), round(sum(c_acctbal), 2) FROM customer""",
)
def s03(spark, sf):
    source = v.table(spark, sf, "customer")
    out = None
    for kind in ("json", "orc", "parquet"):
        path = f"{scratch_path(spark, 'customer')}.{kind}"
        getattr(source.write, kind)(path)
        part = readers.read_table(spark, path).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("c_name").alias("names"),
            F.round(F.sum("c_acctbal"), 2).alias("balance"),
        ).withColumn("format", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "s04_register_dataset",
    """SELECT 'orders' AS filename, (SELECT count(*) FROM orders) AS "rows", CAST(6 AS BIGINT) AS columns,
        'o_orderkey,o_custkey,o_totalprice,o_orderpriority' AS suggestions,
        CASE WHEN (SELECT max(o_orderkey) - min(o_orderkey) > 1000 AND count(DISTINCT o_orderkey) > 20 FROM orders)
            THEN 'regression' ELSE 'other' END AS problem_type,
        'numerical,numerical,categorical,numerical,datetime,categorical' AS types""",
)
def s04(spark, sf):
    _, info = registry.register_dataset(v.table(spark, sf, "orders"), "orders", scratch_path(spark, "sets"))
    return info.select(
        "filename",
        F.col("shape")[0].alias("rows"),
        F.col("shape")[1].alias("columns"),
        F.array_join("target_suggestions", ",").alias("suggestions"),
        "problem_type",
        F.array_join(F.transform("columns", lambda c: F.col("column_types")[c]), ",").alias("types"),
    )


@register("s05_load_dataset", "SELECT * FROM customer")
def s05(spark, sf):
    root = scratch_path(spark, "sets")
    held, _ = registry.register_dataset(v.table(spark, sf, "customer"), "customer", root)
    return registry.load_dataset(spark, held, root)[0]


_EVENT_COLUMNS = ["event_id", "user_id", "event_type", "ts", "value", "props"]


def _stored_profile_sql():
    def of(k, c):
        x = f"CAST({c} AS DOUBLE)" if c in ("event_id", "user_id", "value") else "CAST(NULL AS DOUBLE)"
        return (
            f"""SELECT CAST({k} AS INTEGER) AS ordinal, '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing_count,
            min({x}) AS low, max({x}) AS high, round(avg({x}), 4) AS mean, round(stddev_samp({x}), 4) AS std,
            count(DISTINCT {c}) AS distinct_count, TRUE AS distinct_near, TRUE AS median_near FROM events"""
        )

    return "\nUNION ALL\n".join(of(k, c) for k, c in enumerate(_EVENT_COLUMNS))


@register("s04_appended_dataset", _stored_profile_sql())
def s04_appended(spark, sf):
    """Events stored in two parts; the profile of both is put together from theirs and held against exact counts."""
    events = v.table(spark, sf, "events").select(*_EVENT_COLUMNS)
    root, late = scratch_path(spark, "sets"), F.col("user_id") % 3 == 0
    held, _ = registry.register_dataset(events.where(~late | late.isNull()), "events", root)
    registry.append_dataset(events.where(late), held, root)
    found = registry.dataset_profile(spark, held, root)
    middles = {r["column"]: r["median"] for r in found.where("median is not null").select("column", "median").collect()}
    below = per_column(
        events,
        {
            n: [("below", F.avg((F.col(n) < m).cast("double"))), ("upto", F.avg((F.col(n) <= m).cast("double")))]
            for n, m in middles.items()
        },
    ).drop("ordinal")
    exact = distinct_counts(events).drop("ordinal")
    near = F.abs(F.col("distinct_estimate") - F.col("distinct_count")) <= 4 * DISTINCT_ERROR * F.col("distinct_count") + 0.5
    middle = (F.col("below") <= 0.5 + QUANTILE_ERROR) & (F.col("upto") >= 0.5 - QUANTILE_ERROR)
    return found.join(F.broadcast(exact), "column").join(F.broadcast(below), "column", "left").select(  # a row per column
        "ordinal", "column", "rows", "missing_count", "low", "high", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        "distinct_count", near.alias("distinct_near"), F.coalesce(middle, F.lit(True)).alias("median_near"),
    )


@register(
    "p01_target_separation",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority, o_totalprice AS label FROM orders""",
)
def p01(spark, sf):
    return separate(v.table(spark, sf, "orders"), "o_totalprice")


def _drops(df):
    return [r.asDict() for r in column_verdicts(df).collect()]


@register("p02_drop_flagged", f"SELECT l_orderkey, rare, level AS label FROM {v.SQL_LINEITEM_CONSTANT}")
def p02(spark, sf):
    df = v.lineitem_constant(spark, sf)
    flagged = [r["column"] for r in _drops(df) if r["should_drop"]]
    return separate(df, "level", [*flagged, "no_such_column"])


@register(
    "p03_column_routing",
    f"""SELECT "column", CASE WHEN distinct_count > 100 AND distinct_count > 0.8 * "rows" AND spark_type = 'string' THEN 'hash'
            WHEN detected_type = 'numerical' THEN 'numerical' WHEN detected_type = 'categorical' THEN 'categorical' END AS route
        FROM ({v.typed_sql('customer')}) WHERE detected_type IN ('numerical', 'categorical')
            OR (distinct_count > 100 AND distinct_count > 0.8 * "rows" AND spark_type = 'string')""",
)
def p03(spark, sf):
    routes = route_columns(_drops(v.table(spark, sf, "customer")))
    rows = [
        *[(c, "numerical") for c in routes.numerical],
        *[(c, "categorical") for c in routes.categorical],
        *[(c, "hash") for c in routes.hash_encoded],
    ]
    return small_table(spark, rows, "column string, route string")


@register(
    "p04_processed_only",
    "SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice AS label, o_orderstatus FROM orders",
)
def p04(spark, sf):
    df = v.table(spark, sf, "orders")
    routes = route_columns(_drops(df), "o_totalprice")
    kept = [*routes.numerical, *routes.categorical, *routes.hash_encoded]
    return separate(df, "o_totalprice").select(*kept, "label")


@register("p05_chosen_features", "SELECT p_size, p_retailprice FROM part")
def p05(spark, sf):
    dropped = [c for c in v.table(spark, sf, "part").columns if c not in ("p_size", "p_retailprice")]
    return FittedSelection.of(removed=dropped).transform(v.table(spark, sf, "part"))


@register(
    "s10_row_records",
    """SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS o_custkey,
        CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS o_totalprice FROM orders""",
)
def s10(spark, sf):
    """Orders as requests would bring them, a JSON text each; a field that a text leaves out is null."""
    orders = v.table(spark, sf, "orders")
    sent = orders.select(
        F.to_json(
            F.struct(
                "o_orderpriority", "o_orderkey",
                F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("o_custkey"),
                F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("o_totalprice"),
                F.col("o_orderstatus").alias("not_asked_for"),
            )
        ).alias("body")
    )
    asked = ("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")
    return readers.read_records(sent, "body", ", ".join(f"{n} {orders.schema[n].dataType.simpleString()}" for n in asked))


@register("s01_csv_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def s01_documents(spark, sf):
    """Whole texts, with line breaks and quotes, through a flat file and back by default options."""
    path = scratch_path(spark, "documents") + ".csv"
    v.table(spark, sf, "documents").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_table(spark, path)


@register(
    "p06_columns_with_missing",
    f"""SELECT ordinal, "column", missing_count, round(missing_pct, 6) AS missing_pct FROM (
        {v.per_column(v.SQL_DOCUMENTS_LABELLED, "count(*) - count({c}) AS missing_count, (count(*) - count({c})) * 100.0 / count(*) AS missing_pct")})
        WHERE missing_count > 0""",
)
def p06(spark, sf):
    found = missing_by_column(v.documents_labelled(spark, sf)).where("missing_count > 0")
    return found.withColumn("missing_pct", F.round("missing_pct", 6))


@register(
    "p07_high_missing",
    f"""SELECT ordinal, "column", round(missing_pct, 6) AS missing_pct FROM ({v.profile_sql(v.SQL_DOCUMENTS_LABELLED)})
        WHERE missing_pct > 50""",
)
def p07(spark, sf):
    found = high_missing(profile(v.documents_labelled(spark, sf)))
    return found.withColumn("missing_pct", F.round("missing_pct", 6))


@register(
    "p08_model_filter",
    """SELECT 'classification' AS problem_type, 'Random Forest' AS model_name, count(*) AS usable_rows FROM labels
       UNION ALL SELECT 'classification', 'SVM', count(*) FROM labels""",
)
def p08(spark, sf):
    names = candidates("classification", ["SVM", "Random Forest", "no such model"])
    rows = v.table(spark, sf, "labels").agg(F.count(F.lit(1)).alias("usable_rows"))
    chosen = small_table(spark, [("classification", n) for n in names], "problem_type string, model_name string")
    return chosen.crossJoin(F.broadcast(rows))  # two names, one count


_FENCES = f"""
    SELECT quantile_cont(price, 0.25) - 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS lo,
        quantile_cont(price, 0.75) + 1.5 * (quantile_cont(price, 0.75) - quantile_cont(price, 0.25)) AS hi
    FROM {v.SQL_ORDERS_OUTLIER}"""


@register(
    "p09_outlier_rows",
    f"SELECT o_orderkey, o_orderstatus, round(price, 2) AS price FROM {v.SQL_ORDERS_OUTLIER} o, ({_FENCES}) f WHERE price < lo OR price > hi",
)
def p09(spark, sf):
    return iqr_frame(v.orders_outlier(spark, sf), "price").withColumn("price", F.round("price", 2))


@register(
    "j01_frequency_lookup",
    "SELECT p.p_partkey, CAST(f.n AS DOUBLE) AS p_brand_freq FROM part p JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand) f USING (p_brand)",
)
def j01(spark, sf):
    df = v.table(spark, sf, "part")
    return CategoryEncoder(inputCols=["p_brand"]).fit(df).transform(df).select("p_partkey", "p_brand_freq")


@register(
    "j01_unseen_category",
    """SELECT l.event_id, CAST(coalesce(f.n, 0) AS DOUBLE) AS event_type_freq FROM events l
       LEFT JOIN (SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY event_type) f USING (event_type)""",
)
def j01_unseen(spark, sf):
    df = v.table(spark, sf, "events")
    fitted: FittedCategories = CategoryEncoder(inputCols=["event_type"], low=2).fit(df.where("event_type <> 'click'"))
    return fitted.transform(df).select("event_id", "event_type_freq")


@register(
    "j02_positional_concat",
    """SELECT p_partkey, CAST(p_type = 'LARGE' AS DOUBLE) AS p_type_LARGE, CAST(p_type = 'MEDIUM' AS DOUBLE) AS p_type_MEDIUM,
        CAST(p_type = 'PROMO' AS DOUBLE) AS p_type_PROMO, CAST(p_type = 'SMALL' AS DOUBLE) AS p_type_SMALL,
        CAST(p_type = 'STANDARD' AS DOUBLE) AS p_type_STANDARD, CAST(f.n AS DOUBLE) AS p_name_freq
       FROM part JOIN (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) f USING (p_name)""",
)
def j02(spark, sf):
    df = v.table(spark, sf, "part")
    fitted = CategoryEncoder(inputCols=["p_type", "p_name"]).fit(df)
    return fitted.transform(df).select("p_partkey", *fitted.feature_names())


@register(
    "j03_class_remap",
    "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders",
)
def j03(spark, sf):
    df = v.table(spark, sf, "orders")
    return index_classes(df, "o_orderpriority", class_labels(df, "o_orderpriority")).select("o_orderkey", "label")


@register("j04_inverse_label", "SELECT l_orderkey, l_returnflag AS predicted FROM lineitem")
def j04(spark, sf):
    df = v.table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    labels = class_labels(df, "l_returnflag")
    back = IndexToString(inputCol="label", outputCol="predicted", labels=labels)
    return back.transform(index_classes(df, "l_returnflag", labels)).select("l_orderkey", "predicted")


@register(
    "u01_missing_words",
    f"""SELECT "column", CAST(all_kinds AS BIGINT) AS text_kinds, all_markers AS marker_values FROM ({v.profile_sql(v.SQL_EVENTS_MIXED)})
        WHERE conversion_rate >= 0.5 AND conversion_rate < 0.8""",
)
def u01(spark, sf):
    found = column_types(v.events_mixed(spark, sf))
    return found.where("conversion_rate >= 0.5 and conversion_rate < 0.8").select("column", "text_kinds", "marker_values")
