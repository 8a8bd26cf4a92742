"""Median and constant imputation."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.coercion import number_of, quoted
from tabulon.operators.quantiles import quantiles
from tabulon.operators.stages import ColumnStage, FittedColumns, declare


class FittedMedians(FittedColumns):
    def _rewrite(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {n: F.coalesce(number_of(df, n), F.lit(m)) for n, m in self.state["medians"].items()}
        )


class MedianImputer(ColumnStage, Estimator):
    """Fills missing numbers with the exact training median, 0 for an empty column."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> FittedMedians:
        middle = quantiles(df, {n: number_of(df, n) for n in self.columns()}, (0.5,))
        return FittedMedians.of(medians={n: 0.0 if m is None else m for n, [m] in middle.items()})


class ConstantImputer(ColumnStage, Transformer):
    """Turns category columns to text and names the missing ones."""

    fill = declare("fill", "text that stands for a missing category")

    @keyword_only
    def __init__(self, *, inputCols=None, fill="missing"):
        super().__init__()
        self._setDefault(fill="missing")
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fill = F.lit(self.getOrDefault("fill"))
        return df.withColumns({n: F.coalesce(quoted(n).cast("string"), fill) for n in self.columns()})
