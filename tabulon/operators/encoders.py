"""Category encoding routed by cardinality: one-hot, frequency or hash buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import quoted
from tabulon.operators.stages import ColumnStage, FittedColumns, declare
from tabulon.session import small_table

ONEHOT, FREQUENCY, HASH = "OneHot", "Frequency", "Hash"
HASH_BUCKETS = 32
BROADCAST_KEYS = 100_000
"""Frequency tables up to this many keys are broadcast; larger ones are joined by shuffle."""


def hash_bucket(column: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Bucket of a whole value, from the first 32 bits of its MD5, so that any engine can recompute it."""
    digits = F.substring(F.md5(F.coalesce(column, F.lit("\u0000"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def hash_names(name: str, buckets: int = HASH_BUCKETS) -> list[str]:
    return [f"{name}_hash_{b}" for b in range(buckets)]


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of the given text columns, from one shuffle."""
    flat = [c for n in columns for c in (F.lit(n), quoted(n).cast("string"))]
    return (
        df.select(F.stack(F.lit(len(columns)), *flat).alias("column", "value"))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def encoding_routes(counts: DataFrame, low: int = 10, high: int = 1000) -> DataFrame:
    """``(column, cardinality, route)`` from category counts."""
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("cardinality")).withColumn(
        "route",
        F.when(F.col("cardinality") <= low, ONEHOT).when(F.col("cardinality") <= high, FREQUENCY).otherwise(HASH),
    )


class FittedCategories(FittedColumns):
    """Adds the encoded columns; the source columns stay for others to use."""

    def _rewrite(self, df: DataFrame) -> DataFrame:
        for plan in self.state["plans"]:
            df = getattr(self, f"_add_{plan['route'].lower()}")(df, plan)
        return df

    @staticmethod
    def _add_onehot(df: DataFrame, plan: dict) -> DataFrame:
        c = quoted(plan["column"]).cast("string")
        flags = {
            f"{plan['column']}_{v}": F.coalesce((c == F.lit(v)), F.lit(False)).cast("double")
            for v in plan["categories"][1:]
        }
        return df.withColumns(flags) if flags else df

    @staticmethod
    def _add_frequency(df: DataFrame, plan: dict) -> DataFrame:
        """Counts seen in training; unseen values get 0."""
        out = f"{plan['column']}_freq"
        seen = small_table(df.sparkSession, plan["counts"], "_key string, _seen double")
        if len(plan["counts"]) <= BROADCAST_KEYS:
            seen = F.broadcast(seen)
        joined = df.join(seen, quoted(plan["column"]).cast("string") == F.col("_key"), "left")
        return joined.withColumn(out, F.coalesce("_seen", F.lit(0.0))).drop("_key", "_seen")

    @staticmethod
    def _add_hash(df: DataFrame, plan: dict) -> DataFrame:
        return add_hash_buckets(df, plan["column"], plan["buckets"])

    def feature_names(self) -> list[str]:
        names = []
        for plan in self.state["plans"]:
            if plan["route"] == ONEHOT:
                names += [f"{plan['column']}_{v}" for v in plan["categories"][1:]]
            elif plan["route"] == FREQUENCY:
                names.append(f"{plan['column']}_freq")
            else:
                names += hash_names(plan["column"], plan["buckets"])
        return names

    def described(self) -> dict[str, str]:
        return {p["column"]: f"{p['route']} (cardinality: {p['cardinality']})" for p in self.state["plans"]}


def add_hash_buckets(df: DataFrame, name: str, buckets: int = HASH_BUCKETS) -> DataFrame:
    held = hash_bucket(quoted(name).cast("string"), buckets)
    return df.withColumns({out: (held == b).cast("double") for b, out in enumerate(hash_names(name, buckets))})


class CategoryEncoder(ColumnStage, Estimator):
    """Routes each column by its distinct count in the training rows.

    Only categories of low and medium columns come to the driver, at most
    ``high`` per column by construction.
    """

    low = declare("low", "most categories for one-hot")
    high = declare("high", "most categories for frequency encoding")

    @keyword_only
    def __init__(self, *, inputCols=None, low=10, high=1000):
        super().__init__()
        self._setDefault(low=10, high=1000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FittedCategories:
        names = self.columns()
        if not names:
            return FittedCategories.of(plans=[])
        counts = category_counts(df, names)
        routes = {
            r["column"]: r
            for r in encoding_routes(counts, self.getOrDefault("low"), self.getOrDefault("high")).collect()
        }
        listed = [n for n, r in routes.items() if r["route"] != HASH]
        held: dict[str, list] = {n: [] for n in listed}
        if listed:
            for r in counts.where(F.col("column").isin(listed)).collect():
                held[r["column"]].append((r["value"], float(r["n"])))
        plans = []
        for n in names:
            route, kinds = (routes[n]["route"], routes[n]["cardinality"]) if n in routes else (ONEHOT, 0)
            plan = {"column": n, "route": route, "cardinality": kinds}
            if route == ONEHOT:
                plan["categories"] = sorted(v for v, _ in held.get(n, []))
            elif route == FREQUENCY:
                plan["counts"] = sorted(held[n])
            else:
                plan["buckets"] = max(min(HASH_BUCKETS, kinds // 10), 1)
            plans.append(plan)
        return FittedCategories.of(plans=plans)


class HashEncoder(ColumnStage, Transformer):
    """Hash buckets for columns listed as having too many categories."""

    buckets = declare("buckets", "number of buckets")

    @keyword_only
    def __init__(self, *, inputCols=None, buckets=HASH_BUCKETS):
        super().__init__()
        self._setDefault(buckets=HASH_BUCKETS)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        for n in self.columns():
            df = add_hash_buckets(df, n, self.getOrDefault("buckets"))
        return df

    def feature_names(self) -> list[str]:
        return [h for n in self.columns() for h in hash_names(n, self.getOrDefault("buckets"))]
