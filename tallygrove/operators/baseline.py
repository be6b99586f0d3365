"""Baselines fitted on training rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bin_index
from . import quantile


def option_counts(train: DataFrame, item: str, code: str, levels: int) -> DataFrame:
    """Counts of all options of every item, zeros included."""
    items = train.select(item).distinct().select(item, F.explode(F.sequence(F.lit(1), F.lit(levels))).alias(code))
    counts = train.groupBy(item, F.col(code).cast("int").alias(code)).agg(F.count("*").alias("n"))
    return items.join(counts, [item, code], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def smoothed(train: DataFrame, item: str, code: str, levels: int) -> DataFrame:
    """(n_k + 1) / (N + K)."""
    counts = option_counts(train, item, code, levels)
    total = counts.groupBy(item).agg(F.sum("n").alias("total"))
    return counts.join(total, item).select(item, code, ((F.col("n") + 1) / (F.col("total") + levels)).alias("p"))


def mode(train: DataFrame, item: str, code: str) -> DataFrame:
    """Most frequent code, the lowest of equals."""
    counts = train.groupBy(item, code).agg(F.count("*").alias("n"))
    return counts.groupBy(item).agg(F.max_by(code, F.struct("n", -F.col(code))).alias("mode"))


def looked_up(rows: DataFrame, stats: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of the trained statistics; a row whose key has no training support makes the query fail when it is read."""
    met = rows.join(stats.select(*keys, value, F.lit(True).alias("_known")), keys, "left")
    kind = stats.schema[value].dataType
    said = F.concat_ws("|", F.lit("no training support"), *(F.col(k).cast("string") for k in keys))
    return met.withColumn(value, F.when(F.col("_known"), F.col(value)).otherwise(F.raise_error(said).cast(kind))).drop("_known")


def median(train: DataFrame, item: str, value: str) -> DataFrame:
    return quantile.median(train, item, value)


def price_edges(train: DataFrame, item: str, price: str) -> DataFrame:
    """Fifths of each item's prices, equal ones once."""
    return quantile.quantiles(train, item, price, [0.2, 0.4, 0.6, 0.8]).select(item, F.array_distinct("q").alias("edges"))


def price_binned(rows: DataFrame, edges: DataFrame, item: str, price: str) -> DataFrame:
    """``rows`` with ``bin``, the number of the item's edges at or below the price; items without edges go."""
    return rows.join(edges, item).withColumn("bin", bin_index(F.col(price), F.col("edges"))).drop("edges")


def price_rates(binned: DataFrame, item: str, code: str, levels: int, weight: float = 5.0) -> DataFrame:
    """Option rates of binned training rows by price bin, drawn to the item's smoothed distribution: (local + w * prior) / (n + w).

    Bins, then items, are sums of the same cells, so the rows are grouped once.
    """
    cells = binned.groupBy(item, "bin").agg(F.count("*").alias("n"), *(F.count_if(F.col(code) == k).alias(f"n_{k}") for k in range(1, levels + 1)))
    long = cells.select(item, "bin", "n", F.explode(F.array(*(F.struct(F.lit(k).alias(code), F.col(f"n_{k}").alias("local")) for k in range(1, levels + 1)))).alias("s")).select(item, "bin", "n", "s.*")
    totals = long.groupBy(item, code).agg(((F.sum("local") + 1) / (F.sum("n") + levels)).alias("p"))
    return long.join(totals, [item, code]).select(item, "bin", code, ((F.col("local") + weight * F.col("p")) / (F.col("n") + weight)).alias("rate"))
