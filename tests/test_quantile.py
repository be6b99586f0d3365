"""Distributed selection against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.operators import quantile

SHARES = [0.0, 0.025, 0.2, 0.25, 0.5, 0.75, 0.95, 1.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_all_shapes(spark, seed):
    rng = np.random.default_rng(seed)
    near = 1000 + rng.integers(0, 50, 400) * 2.0**-43
    groups = {
        "one": [3.5], "two": [2.0, -7.0], "ties": [1.0] * 90 + [2.0] * 10, "near": near, "signs": rng.normal(0, 1, 501), "outlier": np.r_[rng.uniform(0, 1, 300), 1e300], "small": rng.uniform(-1, 1, 100) * 1e-305,
        "zero": np.zeros(7), "wide": np.exp(rng.uniform(-600, 600, 400)), "cents": rng.integers(90_000, 210_000, 2000) / 100, "negative": -np.exp(rng.uniform(0, 9, 333)),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: r.q for r in quantile.quantiles(df, "g", "x", SHARES).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(np.quantile(np.sort(xs), SHARES).tolist(), rel=1e-12, abs=1e-315), g
    assert quantile.quantiles(df, None, "x", [0.5]).collect()[0].q == pytest.approx([np.median([x for _, x in rows if x is not None])])
    assert quantile.quantiles(df.limit(0), "g", "x", SHARES).count() == 0 and quantile.median(df, "g", "x").count() == len(groups)


def test_a_group_of_a_million_values(spark):
    """No node of the plan orders or gathers more than a slice of the group."""
    df = spark.range(1_000_000).select(F.when(F.col("id") % 97 == 0, "b").otherwise("a").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 8.0 + 1000).alias("x"))
    got = {r.g: r.q for r in quantile.quantiles(df, "g", "x", SHARES).collect()}
    ids = np.arange(1_000_000)
    xs = (ids * 7919 % 1_000_003) / 8.0 + 1000
    for g, some in (("b", ids % 97 == 0), ("a", ids % 97 != 0)):
        assert got[g] == pytest.approx(np.quantile(xs[some], SHARES).tolist(), rel=1e-13)
    # What the last step puts in order: the values of the slices that hold a rank.
    ranks = F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 2))
    plan = quantile.ranked(df, "g", "x", ranks)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median" not in plan
    largest = df.where("g = 'a'").groupBy(quantile._magnitude(F.col("x")).alias("m")).count().agg(F.max("count")).first()[0]
    assert largest < 1000
