"""Scaling with a method chosen per column from its distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import number_of, outside
from tabulon.operators.normality import normal_limit, rank_statistics
from tabulon.operators.quantiles import quantiles
from tabulon.operators.stages import ColumnStage, FittedColumns, declare
from tabulon.session import small_table

STANDARD, MINMAX, ROBUST = "StandardScaler", "MinMaxScaler", "RobustScaler"

SKEWNESS, RANKS = "skewness", "ranks"
"""How a column counts as normal: by its skewness alone, or by its ordered values as well."""

NORMAL_SKEW = 1.0
"""A column counts as normal, whatever its size, if its skewness is smaller than this."""

SCALING_SCHEMA = "ordinal int, column string, method string, center double, scale double"


def _choose(n: int, outlier_pct: float, low: float, high: float, normal: bool) -> str:
    if n < 10:
        return STANDARD
    if outlier_pct > 10:
        return ROBUST
    if (low >= 0 and high <= 1) or high - low < 10:
        return MINMAX
    return STANDARD if normal else ROBUST


def scaling_table(
    df: DataFrame, columns: Sequence[str], method: str | None = None, normality: str = SKEWNESS
) -> list[dict]:
    """Method, centre and scale per column; ``method`` forces one for all.

    Deviations are population ones, and a spread of zero counts as one.  With ``normality``
    set to ``ranks``, columns that their skewness lets pass are ranked, if it matters to the choice.
    """
    if normality not in (SKEWNESS, RANKS):
        raise ValueError(f"normality is {SKEWNESS} or {RANKS}, not {normality}")
    values = {n: number_of(df, n) for n in columns}
    if not values:
        return []
    measures = (F.count, F.min, F.max, F.avg, F.stddev_pop, F.skewness)
    facts = df.agg(
        *[f(x).alias(f"{f.__name__}{k}") for k, x in enumerate(values.values()) for f in measures],
    ).first()
    marks = quantiles(df, values, (0.25, 0.5, 0.75), {n: facts[f"count{k}"] for k, n in enumerate(values)})
    beyond = df.agg(
        F.lit(0).alias("none"),
        *[
            F.count_if(outside(x, 2.5 * q1 - 1.5 * q3, 2.5 * q3 - 1.5 * q1)).alias(f"o{k}")
            for k, (n, x) in enumerate(values.items())
            for q1, _, q3 in [marks[n]]
            if q1 is not None
        ],
    ).first().asDict()
    normal = {n: (skew := facts[f"skewness{k}"]) is not None and abs(skew) < NORMAL_SKEW for k, n in enumerate(values)}
    if normality == RANKS and not method:
        known = {n: (facts[f"count{k}"], facts[f"avg{k}"], facts[f"stddev_pop{k}"]) for k, n in enumerate(values)}
        asked = {
            n: x
            for k, (n, x) in enumerate(values.items())
            if normal[n]
            and _choose(known[n][0], beyond.get(f"o{k}", 0) / known[n][0] * 100, facts[f"min{k}"], facts[f"max{k}"], False)
            != _choose(known[n][0], beyond.get(f"o{k}", 0) / known[n][0] * 100, facts[f"min{k}"], facts[f"max{k}"], True)
        }
        for n, w in rank_statistics(df, asked, known).items():
            normal[n] = w is not None and w >= normal_limit(known[n][0])
    out = []
    for k, n in enumerate(values):
        count, low, high = facts[f"count{k}"], facts[f"min{k}"], facts[f"max{k}"]
        if not count:
            chosen, center, scale = method or STANDARD, 0.0, 1.0
        else:
            chosen = method or _choose(count, beyond.get(f"o{k}", 0) / count * 100, low, high, normal[n])
            q1, middle, q3 = marks[n]
            center, scale = {
                STANDARD: (facts[f"avg{k}"], facts[f"stddev_pop{k}"]),
                MINMAX: (low, high - low),
                ROBUST: (middle, q3 - q1),
            }[chosen]
        out.append(
            {"ordinal": df.columns.index(n), "column": n, "method": chosen, "center": center, "scale": scale or 1.0}
        )
    return out


def scaling_report(
    df: DataFrame, columns: Sequence[str], method: str | None = None, normality: str = SKEWNESS
) -> DataFrame:
    return small_table(df.sparkSession, scaling_table(df, columns, method, normality), SCALING_SCHEMA)


class FittedScaler(FittedColumns):
    def _rewrite(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                r["column"]: (number_of(df, r["column"]) - F.lit(r["center"])) / F.lit(r["scale"])
                for r in self.state["records"]
            }
        )


class AutoScaler(ColumnStage, Estimator):
    """Standard, min-max or robust scaling, picked per column unless ``method`` is set."""

    method = declare("method", "force one method, empty to choose per column")
    normality = declare("normality", "skewness or ranks: how a column counts as normal")

    @keyword_only
    def __init__(self, *, inputCols=None, method="", normality=SKEWNESS):
        super().__init__()
        self._setDefault(method="", normality=SKEWNESS)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FittedScaler:
        chosen, rule = self.getOrDefault("method") or None, self.getOrDefault("normality")
        return FittedScaler.of(records=scaling_table(df, self.columns(), chosen, rule))
