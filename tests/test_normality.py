from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import normality, scalers


def plain(x):
    """The statistic by the definition, row by row."""
    x, n, normal = np.sort(x), len(x), NormalDist()
    m = np.array([normal.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return ((x - x.mean()) @ m) ** 2 / (((x - x.mean()) ** 2).sum() * (m @ m))


def test_quantile_expression_and_sum_of_squares(spark):
    ps = [1e-12, 1e-4, 0.02, 0.02425, 0.3, 0.5, 0.8, 0.97575, 0.98, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(normality.normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-6, abs=1e-8)
    for n in (5, 101, 60_001):
        want = sum(NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) ** 2 for i in range(1, n + 1))
        assert normality.score_squares(n) == pytest.approx(want, rel=1e-7)


def test_statistic_by_definition_in_any_number_of_ranges(spark, monkeypatch):
    draw = np.random.default_rng(8)
    n = 1000
    table = {
        "normal": draw.normal(1e6, 3, n),
        "flat": draw.uniform(0, 100, n),
        "peaks": np.where(np.arange(n) % 2, 20.0, -20.0) + draw.normal(size=n),
        "skewed": draw.exponential(5, n),
        "hot": np.where(np.arange(n) % 3 == 0, 7.0, draw.normal(0, 50, n)),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*table.values())], ", ".join(f"{c} double" for c in table))
    df = df.select("*", F.lit(2.0).alias("same"), F.lit(None).cast("double").alias("never"), F.when(F.col("flat") > 50, F.col("normal")).alias("gaps"))
    found = {r["column"]: r.asDict() for r in normality.normality(df, df.columns).collect()}
    for name, x in table.items():
        assert found[name]["statistic"] == pytest.approx(plain(x), abs=2e-4 if name == "hot" else 1e-7)
    assert {n for n, r in found.items() if r["normal"]} == {"normal", "gaps"}
    assert found["same"]["statistic"] is None and found["never"]["statistic"] is None and found["gaps"]["n"] == (table["flat"] > 50).sum()
    monkeypatch.setattr(normality, "RANGE_ROWS", 300)
    again = {r["column"]: r["statistic"] for r in normality.normality(df.repartition(7), df.columns).collect()}
    assert {n: s for n, s in again.items() if s is not None} == pytest.approx(
        {n: r["statistic"] for n, r in found.items() if r["statistic"] is not None}, rel=1e-9
    )


def test_the_same_rule_for_many_rows(spark):
    u = (F.col("id") + 0.5) / 600_000
    df = spark.range(600_000).select(normality.normal_quantile(u).alias("normal"), (u * 100).alias("flat"))
    df = df.withColumn("normal", F.col("normal") * 30).withColumn("peaks", F.when(F.col("normal") > 0, F.col("normal") + 90).otherwise(F.col("normal") - 90))
    assert {r["column"]: r["normal"] for r in normality.normality(df, df.columns).collect()} == {"normal": True, "flat": False, "peaks": False}
    by_ranks = {r["column"]: r["method"] for r in scalers.scaling_table(df, df.columns, normality="ranks")}
    assert by_ranks == {"normal": scalers.STANDARD, "flat": scalers.ROBUST, "peaks": scalers.ROBUST}
    assert {r["method"] for r in scalers.scaling_table(df, df.columns)} == {scalers.STANDARD}
    model = scalers.AutoScaler(inputCols=["flat"], normality="ranks").fit(df)
    assert model.state["records"][0]["method"] == scalers.ROBUST
    with pytest.raises(ValueError, match="normality"):
        scalers.scaling_table(df, ["flat"], normality="other")
