import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.session import scratch_path
from tabulon.sources import profiles, registry


def rows_of(df):
    return {r["column"]: r.asDict() for r in df.collect()}


def test_parts_add_up_to_the_profile_of_the_whole(spark):
    draw = np.random.default_rng(5)
    values = [None if k % 11 == 0 else float(v) for k, v in enumerate(draw.normal(1e8, 1, 5000))]
    df = spark.createDataFrame(
        [(k, v, f"t{k % 70}" if k % 5 else None, float("nan") if k % 2 else -0.0, None) for k, v in enumerate(values)],
        "id bigint, far double, text string, zero double, never double",
    )
    parts = [df.where(F.col("id") % 3 == k) for k in range(3)] + [df.where("id < 0")]
    together = parts[0]
    stacked = profiles.partial_profile(together)
    for part in parts[1:]:
        stacked = stacked.unionByName(profiles.partial_profile(part))
    found, whole = rows_of(profiles.spelled_out(stacked)), rows_of(profiles.spelled_out(profiles.partial_profile(df)))
    held = df.toPandas()
    for name, row in found.items():
        for label in ("ordinal", "kind", "rows", "missing_count", "zeros", "negatives", "low", "high"):
            assert row[label] == whole[name][label], (name, label)
        assert row["missing_count"] == held[name].isna().sum()
        exact = held[name].nunique()
        assert abs(row["distinct_estimate"] - exact) <= 4 * profiles.DISTINCT_ERROR * exact + 0.5
    assert found["far"]["std"] == pytest.approx(held["far"].std(), rel=1e-6)
    assert found["far"]["mean"] == pytest.approx(held["far"].mean(), rel=1e-12)
    under = (held["far"] <= found["far"]["median"]).sum() / held["far"].count()
    assert abs(under - 0.5) <= profiles.QUANTILE_ERROR + 1e-3
    assert found["zero"]["distinct_estimate"] == 1 and found["zero"]["zeros"] == 2500
    assert found["never"]["median"] is None and found["never"]["mean"] is None and found["never"]["distinct_estimate"] == 0
    assert found["text"]["avg_length"] == pytest.approx(held["text"].dropna().str.len().mean())


def test_an_append_reads_its_own_rows_only(spark, monkeypatch):
    root = scratch_path(spark, "sets")
    df = spark.range(1000).select("id", (F.col("id") % 10).cast("string").alias("kind"))
    held, info = registry.register_dataset(df.where("id < 700"), "rows", root)
    read, real = [], profiles.partial_profile
    monkeypatch.setattr(profiles, "partial_profile", lambda part: read.append(part.inputFiles()) or real(part))
    part = registry.append_dataset(df.where("id >= 700"), held, root)
    [files] = read
    assert sorted(files) == sorted(part.inputFiles()) and part.count() == 300
    stored, _ = registry.load_dataset(spark, held, root)
    assert stored.count() == 1000 and stored.columns == ["id", "kind"]
    found = registry.dataset_profile(spark, held, root)
    assert found.inputFiles() and all("/profile/" in f for f in found.inputFiles())
    assert [(r["column"], r["rows"], r["low"], r["high"]) for r in found.orderBy("ordinal").collect()] == [
        ("id", 1000, 0.0, 999.0), ("kind", 1000, None, None)
    ]
    with pytest.raises(ValueError, match="differ"):
        registry.append_dataset(df.select("id"), held, root)
    with pytest.raises(ValueError, match="not found"):
        registry.dataset_profile(spark, "no such id", root)
