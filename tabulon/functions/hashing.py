"""Row fingerprints and the reproducible row order used by splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.coercion import quoted


def _hashable(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.MapType, T.VariantType)):
        return F.to_json(quoted(name))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(quoted(name)), quoted(name))
    return quoted(name)


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> tuple[Column, Column]:
    """Two independently seeded 64-bit hashes of a row, 128 bits together.

    Equal rows always agree; two different rows among 10^12 agree with a
    probability near 10^-15.  ``xxhash64`` passes over nulls, so the null flags
    are hashed as well.  Shuffling 16 bytes replaces shuffling the whole row.
    """
    names = list(columns or df.columns)
    cells = [_hashable(df, n) for n in names]
    flags = [c.isNull() for c in cells]
    return (
        F.xxhash64(F.lit(1), *cells, *flags),
        F.xxhash64(*flags, F.lit(7919), *reversed(cells)),
    )


def order_key(seed: int, *keys: Column) -> Column:
    """md5 of ``seed|key|key``: a uniform order any engine can recompute."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
