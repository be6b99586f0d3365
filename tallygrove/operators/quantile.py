"""Exact quantiles by distributed selection: no task ever holds the values of a whole group.

Values are counted once per group (``freq``). Then the wanted ranks are sought in ranges:
first by order of magnitude, then in a million equal slices of the one range that holds a rank, and only the
values of that slice are put in order. A range of the first step spans a factor of
exp(2^-12), a slice of the second at most 2^-32 of that value, so what is ordered
together is bounded by the number of doubles in a slice, whatever the group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICES = float(1 << 20)


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as ``v`` rises; zero and numbers below 1e-300 share one."""
    size = F.greatest(F.abs(v), F.lit(1e-300))
    return (F.signum(v) * (F.floor(F.ln(size) * 4096.0) + 4_000_000)).cast("long")


def _found(wanted: DataFrame, cells: DataFrame, keys: list[str], part: str) -> DataFrame:
    """``wanted`` ranks with the cell that holds each, and what is left of the rank within it."""
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = cells.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n")).drop("_n")
    met = wanted.join(placed, keys).where((F.col("_left") >= F.col("_from")) & (F.col("_left") < F.col("_upto")))
    return met.withColumn("_left", F.col("_left") - F.col("_from")).drop("_from", "_upto")


def ranked(rows: DataFrame, group: str, value: str, ranks: Column) -> DataFrame:
    """``(group, n, rank, value)``: the values at the places ``ranks`` (an array from 0, of ``n``) in each group's order.

    Nulls count nowhere; a group without values has no row. ``group`` must not be null.
    """
    freq = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")).withColumn("_a", _magnitude(F.col("_v")))
    coarse = freq.groupBy("_g", "_a").agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    totals = coarse.groupBy("_g").agg(F.sum("_n").alias("n"))
    wanted = totals.select("_g", "n", F.explode(F.array_distinct(ranks)).alias("_rank")).withColumn("_left", F.col("_rank"))
    first = _found(wanted, coarse, ["_g"], "_a")
    ends = first.select("_g", "_a", "_lo", "_hi").distinct()
    share = F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    near = freq.join(ends, ["_g", "_a"]).select("_g", "_a", F.floor(share * _SLICES).alias("_b"), "_v", "_n")
    fine = near.groupBy("_g", "_a", "_b").agg(F.sum("_n").alias("_n"))
    second = _found(first.drop("_lo", "_hi"), fine, ["_g", "_a"], "_b")
    held = near.join(second.select("_g", "_a", "_b").distinct(), ["_g", "_a", "_b"], "left_semi")
    return _found(second, held, ["_g", "_a", "_b"], "_v").select(F.col("_g").alias(group), "n", F.col("_rank").alias("rank"), F.col("_v").alias("value"))


def quantiles(rows: DataFrame, group: str | None, value: str, shares: list[float], name: str = "q") -> DataFrame:
    """``(group, name)``: exact quantiles with linear interpolation, as an array in the order of ``shares``; without ``group`` one row over all."""
    key = group or "_all"
    source = rows if group else rows.withColumn("_all", F.lit(0))
    places = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    whole = lambda x: x.cast("long")
    got = ranked(source, key, value, F.array(*(f for p in places for f in (whole(F.floor(p)), whole(F.ceil(p))))))
    by_rank = got.groupBy(key, "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))

    def between(p: Column) -> Column:
        low, high = F.col("_at")[whole(F.floor(p))], F.col("_at")[whole(F.ceil(p))]
        return low + (high - low) * (p - F.floor(p))

    out = by_rank.select(key, F.array(*map(between, places)).alias(name))
    return out if group else out.drop(key)


def median(rows: DataFrame, group: str, value: str, name: str = "median") -> DataFrame:
    """``(group, name)``: exact medians."""
    return quantiles(rows, group, value, [0.5], "_q").select(group, F.get("_q", F.lit(0)).alias(name))
