"""Exact quantiles with linear interpolation, the same way at any size.

Every wanted rank lies in an open interval of values.  A sketch proposes two values
around it, one pass counts the rows below and up to each of them, and the rank is
then either one of the two values or in a much smaller open interval.  A value that
many rows share is met as an end point and settles its ranks at once, so intervals
never stay large because of it.  What is left in an interval of few rows is counted
value by value.

The source is read three times, whatever its size: for the first sketch, for the first
counts, and for the values inside the intervals left by then, a few in ten thousand
rows.  Where some of these are still large, they are written out, and every later round
reads that table only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.session import settle

BRACKET_ROWS = 20_000
"""Rows an interval may hold to be counted value by value, in one task per interval."""

SKETCH_ACCURACY = 10_000


@dataclass(frozen=True)
class _Bracket:
    """Ranks of one column that lie strictly between two values (None: no limit on that side)."""

    name: str
    low: float | None
    high: float | None
    below: int  # rows up to and including ``low``
    inside: int
    ranks: tuple[int, ...]
    home: int | None = None  # the interval it is written out under
    base: int = 0  # rows up to the lower end of that one

    def value(self, slot: Mapping[str, str]) -> Column:
        """The column's value in the source, null in written rows of other intervals."""
        return F.col(slot[self.name]) if self.home is None else F.when(F.col("k") == self.home, F.col("x"))

    def holds(self, x: Column) -> Column:
        kept = x.isNotNull()
        if self.low is not None:
            kept = kept & (x > self.low)
        return kept if self.high is None else kept & (x < self.high)


def quantiles(
    df: DataFrame, exprs: Mapping[str, Column], probs: Sequence[float], counts: Mapping[str, int] | None = None
) -> dict[str, list[float | None]]:
    """Exact quantiles of each expression, as plain numbers on the driver.

    ``counts`` are the numbers of non-null values, if they are known already.  The
    result holds ``len(exprs) * len(probs)`` numbers, whatever the data.
    """
    if not exprs:
        return {}
    source = df.select(*[c.cast("double").alias(f"x{k}") for k, c in enumerate(exprs.values())])
    slot = {n: f"x{k}" for k, n in enumerate(exprs)}
    if counts is None:
        row = source.agg(*[F.count(x).alias(x) for x in slot.values()]).first()
        counts = {n: row[x] for n, x in slot.items()}
    places = {n: [(counts[n] - 1) * p for p in probs] if counts[n] else [] for n in exprs}
    found: dict[str, dict[int, float]] = {n: {} for n in exprs}
    open_ones = [
        _Bracket(n, None, None, 0, counts[n], tuple(sorted({r for at in held for r in (math.floor(at), math.ceil(at))})))
        for n, held in places.items()
        if held
    ]
    small = [b for b in open_ones if b.inside <= BRACKET_ROWS]
    large = [_Bracket(b.name, None, None, 0, b.inside, p) for b in open_ones if b.inside > BRACKET_ROWS for p in _near(b.ranks)]
    written = False
    while large:
        narrowed = _narrow(source, slot, large, found)
        small += [b for b in narrowed if b.inside <= BRACKET_ROWS]
        large = [b for b in narrowed if b.inside > BRACKET_ROWS]
        if large and not written:
            source, small, large = _write_out(source, slot, small, large)
            written = True
    _settle(source, slot, small, found)
    return {n: [_between(found[n], at) for at in held] if held else [None] * len(probs) for n, held in places.items()}


def _near(ranks: Sequence[int]) -> list[tuple[int, ...]]:
    """Neighbouring ranks together: they interpolate one quantile and share an interval."""
    out: list[list[int]] = []
    for r in ranks:
        if out and r == out[-1][-1] + 1:
            out[-1].append(r)
        else:
            out.append([r])
    return [tuple(p) for p in out]


def _between(found: Mapping[int, float], at: float) -> float:
    a, b = found[math.floor(at)], found[math.ceil(at)]
    part = at - math.floor(at)
    return a if a == b else (1 - part) * a + part * b


def _picked(source: DataFrame, slot, brackets: Sequence[_Bracket]) -> DataFrame:
    """The values inside each interval as rows ``(k, x)``, ``k`` its place in the list."""
    picks = [
        F.when(b.holds(x), F.struct(F.lit(k).alias("k"), x.alias("x")))
        for k, b in enumerate(brackets)
        for x in [b.value(slot)]
    ]
    return source.select(F.inline(F.array_compact(F.array(*picks))))


def _write_out(source: DataFrame, slot, small: Sequence[_Bracket], large: Sequence[_Bracket]):
    """The values inside all intervals as a table of its own, and the intervals over that table."""
    brackets = [*small, *large]
    table = settle(_picked(source, slot, brackets))
    moved = [replace(b, home=k, base=b.below) for k, b in enumerate(brackets)]
    return table, moved[: len(small)], moved[len(small) :]


def _narrow(source: DataFrame, slot, brackets: Sequence[_Bracket], found) -> list[_Bracket]:
    """One sketch pass and one counting pass; every interval loses its two marks at least."""
    margin = 2.0 / SKETCH_ACCURACY
    sketches = []
    for k, b in enumerate(brackets):
        x, span = b.value(slot), max(b.inside - 1, 1)
        marks = [max((b.ranks[0] - b.below) / span - margin, 0.0), min((b.ranks[-1] - b.below) / span + margin, 1.0)]
        sketches.append(F.percentile_approx(F.when(b.holds(x), x), marks, SKETCH_ACCURACY).alias(f"b{k}"))
    drawn = source.agg(*sketches).first()
    tallies = []
    for k, b in enumerate(brackets):
        x, (low, high) = b.value(slot), drawn[k]
        tallies += [
            F.count_if(test).alias(f"{label}{k}")
            for label, test in (("a", x < low), ("b", x <= low), ("c", x < high), ("d", x <= high))
        ]
    tally = source.agg(*tallies).first()
    out: dict[tuple, list[int]] = {}
    for k, b in enumerate(brackets):
        low, high = drawn[k]
        under, upto, before, through = (b.base + tally[f"{label}{k}"] for label in "abcd")
        for r in b.ranks:
            if r < under:
                place = (b.name, b.low, low, b.below, under - b.below, b.home, b.base)
            elif r < upto:
                found[b.name][r] = low
                continue
            elif r < before:
                place = (b.name, low, high, upto, before - upto, b.home, b.base)
            elif r < through:
                found[b.name][r] = high
                continue
            else:
                place = (b.name, high, b.high, through, b.below + b.inside - through, b.home, b.base)
            out.setdefault(place, []).append(r)
    return [_Bracket(*place[:5], tuple(ranks), *place[5:]) for place, ranks in out.items()]


def _settle(source: DataFrame, slot, brackets: Sequence[_Bracket], found) -> None:
    """Count the values inside small intervals and read the ranks off."""
    if not brackets:
        return
    counted = _picked(source, slot, brackets).groupBy("k", "x").agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # BRACKET_ROWS at most
    wanted = F.array(*[F.array(*[F.lit(r - b.below) for r in b.ranks]) for b in brackets])
    upto, n = F.col("upto"), F.col("n")
    hits = (
        counted.withColumn("upto", F.sum("n").over(running))
        .where(F.exists(F.element_at(wanted, F.col("k") + 1), lambda r: (upto > r) & (upto - n <= r)))
        .select("k", "x", "n", "upto")
        .collect()  # at most one row per wanted rank
    )
    for hit in hits:
        b = brackets[hit["k"]]
        for r in b.ranks:
            if hit["upto"] - hit["n"] <= r - b.below < hit["upto"]:
                found[b.name][r] = hit["x"]
