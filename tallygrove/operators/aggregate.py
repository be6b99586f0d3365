"""Group means, macro means and their variants, all in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantile


def person_group_mean(rows: DataFrame, person: str, group: str, value: str) -> DataFrame:
    """Mean of what is not null; a person without responses in a group has no row."""
    return rows.where(F.col(value).isNotNull()).groupBy(person, group).agg(F.avg(value).alias("mean"))


def group_means(means: DataFrame, group: str) -> DataFrame:
    return means.groupBy(group).agg(F.avg("mean").alias("mean"), F.count("*").alias("persons"))


def macro(rows: DataFrame, person: str, group: str, value: str) -> DataFrame:
    """Within person and group, then over persons, then equally over groups that have any value."""
    per_group = group_means(person_group_mean(rows, person, group, value), group)
    return per_group.agg(F.avg("mean").alias("macro"), F.count("*").alias("groups"))


def transitions(rows: DataFrame, a: str, b: str, levels: DataFrame, most: int = 10_000) -> DataFrame:
    """Dense counts and row shares over all pairs of ``levels`` (one column, distinct); more than ``most`` levels are an error, since the matrix is dense."""
    x = levels.columns[0]
    held = levels.agg(F.sort_array(F.collect_set(x)).alias("_all")).withColumn("_all", F.when(F.size("_all") > most, F.raise_error(F.lit("too many levels")).cast(f"array<{dict(levels.dtypes)[x]}>")).otherwise(F.col("_all")))
    grid = held.select(F.explode("_all").alias("a"), "_all").select("a", F.explode("_all").alias("b"))
    counts = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    dense = grid.join(counts, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return dense.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("a"))))


def quantiles(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Linear interpolation, exact, by distributed selection."""
    got = quantile.quantiles(rows, group, value, [0.0, 0.25, 0.5, 0.75, 0.95, 1.0])
    return got.select(group, *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("min", "p25", "median", "p75", "p95", "max"))))


def item_correlation(rows: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """Pearson r of items with more than two pairs and spread on both sides."""
    got = rows.groupBy(item).agg(F.corr(a, b).alias("r"), F.count("*").alias("n"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return got.where("n > 2 and sa > 0 and sb > 0").select(item, "r")


def average_runs(runs: DataFrame, keys: list[str], value: str, count: int) -> DataFrame:
    """Mean over repeated runs; null if any run has none. Keys that miss a run raise when read."""
    got = runs.groupBy(*keys).agg(F.count("*").alias("runs"), F.count(value).alias("known"), F.avg(value).alias("m"))
    whole = F.when(F.col("runs") != count, F.raise_error(F.lit("a key misses a run")).cast("double"))
    return got.select(*keys, whole.when(F.col("known") == count, F.col("m")).alias(value))


def cell_difference(left: DataFrame, right: DataFrame, person: str, group: str) -> DataFrame:
    """Differences of person-group means."""
    met = left.select(person, group, F.col("mean").alias("l")).join(right.select(person, group, F.col("mean").alias("r")), [person, group])
    return met.select(person, group, (F.col("l") - F.col("r")).alias("mean"))
