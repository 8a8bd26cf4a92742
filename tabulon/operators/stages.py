"""Base classes of the fitted column steps.

A fitted step holds a small plain record (numbers, names, categories), saves
with the standard ML writer, and rewrites columns with expressions only, so it
works on streaming DataFrames too.
"""

from __future__ import annotations

from pyspark.ml import Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame


def declare(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc)


class ColumnStage(Params, DefaultParamsReadable, DefaultParamsWritable):
    """An estimator or transformer over a list of columns."""

    inputCols = Param(Params._dummy(), "inputCols", "columns to work on", TypeConverters.toListString)

    def columns(self) -> list[str]:
        return list(self.getOrDefault("inputCols")) if self.isDefined("inputCols") else []


class FittedColumns(Model, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted step whose whole state is one JSON-friendly record."""

    record = Param(Params._dummy(), "record", "fitted state")

    @classmethod
    def of(cls, **state):
        fitted = cls()
        fitted._set(record=state)
        return fitted

    @property
    def state(self) -> dict:
        return self.getOrDefault("record")

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._rewrite(df)

    def _rewrite(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError
