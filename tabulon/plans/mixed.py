"""Three ways to use a mostly numeric text column, compared on one split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import error_flag, number_of, quoted
from tabulon.operators.imputers import MedianImputer
from tabulon.operators.metrics import regression_metrics
from tabulon.operators.scalers import STANDARD, AutoScaler
from tabulon.operators.split import split_in_place
from tabulon.session import settle, small_table

STRATEGIES = ("one-hot", "clean numeric", "numeric + error flag")


def compare_mixed_strategies(
    df: DataFrame, column: str, target: str, test_size: float = 0.2, key: Sequence[str] | None = None
) -> DataFrame:
    """``(strategy, features, r2)``; one-hot is only counted, it is one feature per distinct value."""
    flagged = df.select(
        *[quoted(k) for k in key or () if k not in (column, target)],
        quoted(column).alias("raw"),
        number_of(df, column).alias("x"),
        error_flag(quoted(column)).cast("double").alias("flag"),
        number_of(df, target).alias("label"),
    )
    marked = settle(split_in_place(flagged, test_size, key).drop("_split_key"))
    train, test = marked.where(~F.col("is_test")), marked.where("is_test")
    filled = MedianImputer(inputCols=["x"]).fit(train)
    train, test = filled.transform(train), filled.transform(test)
    scaled = AutoScaler(inputCols=["x"], method=STANDARD).fit(train)
    train, test = scaled.transform(train), scaled.transform(test)
    kinds = marked.agg(F.count_distinct(F.coalesce("raw", F.lit("missing")))).first()[0]
    rows = [(STRATEGIES[0], kinds, None)]
    for name, inputs in ((STRATEGIES[1], ["x"]), (STRATEGIES[2], ["x", "flag"])):
        pack = VectorAssembler(inputCols=inputs, outputCol="features")
        model = LinearRegression(solver="normal").fit(pack.transform(train))
        fit = regression_metrics(model.transform(pack.transform(test))).first()
        rows.append((name, len(inputs), fit["r2_score"]))
    return small_table(df.sparkSession, rows, "strategy string, features bigint, r2 double")
