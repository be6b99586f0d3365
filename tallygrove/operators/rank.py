"""Ranked cells of a result table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_best(cells: DataFrame, key: list[str], metrics: dict[str, bool], eligible: Column, digits: int = 4) -> DataFrame:
    """``(metric, key..., score, place, mark)``: one row per cell and metric.

    ``metrics`` says of each column whether more is better. Places are dense ranks of the
    rounded, shown scores among ``eligible`` cells that have one, so cells that look equal share a place;
    others have place 0. The best two places are marked.
    """
    shown = lambda name: F.round(F.col(name), digits)
    rows = [F.struct(F.lit(name).alias("metric"), shown(name).alias("score"), (shown(name) if more else -shown(name)).alias("better")) for name, more in metrics.items()]
    long = cells.select(*key, F.coalesce(eligible, F.lit(False)).alias("eligible"), F.explode(F.array(*rows)).alias("m"))
    ranks = F.col("eligible") & F.col("m.better").isNotNull()
    place = F.dense_rank().over(Window.partitionBy("m.metric", ranks).orderBy(F.col("m.better").desc()))
    placed = long.withColumn("place", F.when(ranks, place).otherwise(0).cast("long"))
    return placed.select("m.metric", *key, "m.score", "place", F.when(F.col("place") == 1, "best").when(F.col("place") == 2, "second").alias("mark"))
