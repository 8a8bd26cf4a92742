"""Outlier bounds, counts and treatment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import clip, keep_inside, number_of, outside
from tabulon.functions.grading import outlier_severity
from tabulon.operators.quantiles import quantiles
from tabulon.operators.stages import ColumnStage, FittedColumns, declare
from tabulon.session import small_table

METHODS = ("iqr", "zscore", "both")


def outlier_table(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "iqr",
    threshold: float = 1.5,
    z_threshold: float = 3.0,
    rows: int | None = None,
) -> list[dict]:
    """Bounds and counts per column: one record per column on the driver.

    z-scores are counted with the population deviation while the treatment
    bounds use the sample deviation; ``both`` adds the two counts, capped at the
    number of rows.  Shares are of all rows, missing ones included.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    values = {n: number_of(df, n) for n in columns}
    if not values:
        return []
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            f(x).alias(f"{f.__name__}{k}")
            for k, x in enumerate(values.values())
            for f in ((F.count,) if method == "iqr" else (F.count, F.avg, F.stddev_pop, F.stddev_samp))
        ],
    ).first()
    total = base["rows"]
    quarters = quantiles(df, values, (0.25, 0.75), {n: base[f"count{k}"] for k, n in enumerate(values)}) if method != "zscore" else {}
    bounds: dict[str, dict[str, tuple]] = {n: {} for n in values}
    tallies: list[Column] = []
    for k, (name, x) in enumerate(values.items()):
        if method != "zscore" and quarters[name][0] is not None:
            q1, q3 = quarters[name]
            low, high = q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)
            bounds[name]["iqr"] = (low, high)
            tallies.append(F.count_if(outside(x, low, high)).alias(f"iqr{k}"))
        if method != "iqr" and base[f"avg{k}"] is not None:
            mean, pop, sample = base[f"avg{k}"], base[f"stddev_pop{k}"], base[f"stddev_samp{k}"]
            if sample is not None:
                bounds[name]["zscore"] = (mean - z_threshold * sample, mean + z_threshold * sample)
            tallies.append(
                (F.count_if(F.abs(x - mean) / pop > z_threshold) if pop else F.lit(0).cast("bigint")).alias(f"zscore{k}")
            )
    tally = df.agg(F.count(F.lit(1)).alias("rows"), *tallies).first().asDict()
    out = []
    for k, name in enumerate(values):
        found = min(tally.get(f"iqr{k}", 0) + tally.get(f"zscore{k}", 0), total)
        treat = bounds[name].get("iqr" if method != "zscore" else "zscore")
        out.append(
            {
                "ordinal": df.columns.index(name),
                "column": name,
                "lower": treat[0] if treat else None,
                "upper": treat[1] if treat else None,
                "outliers_detected": found,
                "outlier_percentage": found / total * 100 if total else 0.0,
            }
        )
    return out


OUTLIER_SCHEMA = (
    "ordinal int, column string, lower double, upper double, outliers_detected bigint, outlier_percentage double"
)


def outlier_report(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """``outlier_table`` as a DataFrame, with a severity."""
    return outlier_summary(df, outlier_table(df, columns, **options))


def outlier_summary(df: DataFrame, records: Sequence[Mapping]) -> DataFrame:
    table = small_table(df.sparkSession, [dict(r) for r in records], OUTLIER_SCHEMA)
    return table.withColumn("severity", outlier_severity(F.col("outlier_percentage")))


def iqr_frame(df: DataFrame, column: str, threshold: float = 1.5) -> DataFrame:
    """The rows whose value in ``column`` lies beyond the quartile fences."""
    [record] = outlier_table(df, [column], threshold=threshold)
    if record["lower"] is None:
        return df.limit(0)
    return df.where(outside(number_of(df, column), record["lower"], record["upper"]))


class FittedOutlierClipper(FittedColumns):
    """Clips to the fitted bounds, or nulls what lies beyond them."""

    def _rewrite(self, df: DataFrame) -> DataFrame:
        treat = clip if self.state["clip"] else keep_inside
        done = {}
        for record in self.state["records"]:
            name, x = record["column"], number_of(df, record["column"])
            done[name] = x if record["lower"] is None else treat(x, F.lit(record["lower"]), F.lit(record["upper"]))
        return df.withColumns(done)

    def summary(self, df: DataFrame) -> DataFrame:
        return outlier_summary(df, self.state["records"])


class OutlierClipper(ColumnStage, Estimator):
    """Learns outlier bounds on the training rows; ``both`` counts by both rules and treats by quartiles."""

    method = declare("method", "iqr, zscore or both")
    threshold = declare("threshold", "quartile-range multiplier")
    z_threshold = declare("z_threshold", "z-score limit")
    clip_outliers = declare("clip_outliers", "clip to the bounds, else set to null")

    @keyword_only
    def __init__(self, *, inputCols=None, method="iqr", threshold=1.5, z_threshold=3.0, clip_outliers=True):
        super().__init__()
        self._setDefault(method="iqr", threshold=1.5, z_threshold=3.0, clip_outliers=True)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FittedOutlierClipper:
        records = outlier_table(
            df,
            self.columns(),
            self.getOrDefault("method"),
            self.getOrDefault("threshold"),
            self.getOrDefault("z_threshold"),
        )
        return FittedOutlierClipper.of(records=records, clip=self.getOrDefault("clip_outliers"))
