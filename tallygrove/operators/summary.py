"""The summary of a run, and the difference of two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import resample


def summarize(rows: DataFrame, person: str, group: str, metrics: list[str], draws: int, seed: str) -> DataFrame:
    """One row per metric: ``metric, macro, lo, hi, micro, responses, groups, persons``.

    Macro: within person and group, across persons, then over groups that have the metric at all;
    its interval comes from resampling all persons of the run. Micro weighs rows alike. Missing values count
    nowhere; ``persons`` are those of all rows. A metric without any value has no row.
    """
    long = rows.unpivot([person, group], metrics, "metric", "value").where("value is not null")
    means = written(long.groupBy("metric", person, group).agg(F.avg("value").alias("mean"), F.sum("value").alias("total"), F.count("*").alias("n")), "means")
    per_group = means.groupBy("metric", group).agg(F.avg("mean").alias("m"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    point = per_group.groupBy("metric").agg(F.avg("m").alias("macro"), (F.sum("total") / F.sum("n")).alias("micro"), F.sum("n").alias("responses"), F.count("*").alias("groups"))
    weights = resample.draw_weights(rows.select(person).distinct(), person, draws, seed)
    drawn = means.join(weights, person).groupBy("draw", "metric", group).agg((F.sum(F.col("times") * F.col("mean")) / F.sum("times")).alias("m"))
    drawn = drawn.groupBy("draw", "metric").agg(F.avg("m").alias("m")).groupBy("metric").agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    persons = rows.agg(F.count_distinct(person).alias("persons"))
    return point.join(drawn, "metric").crossJoin(F.broadcast(persons))


def complement(mean: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """One less a mean with its interval: the ends change places."""
    return 1 - mean, 1 - high, 1 - low


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``delta``, its value less that of the row of ``right`` with the same key.

    Both sides must have the same unique keys, and values where the other has: else the query fails with a message.
    """
    other = right.groupBy(F.col(key).alias("other_key")).agg(F.count("*").alias("other_n"), F.first(value).alias("other_value"))
    counted = left.withColumn("own_value", F.col(value)).join(left.groupBy(F.col(key).alias("own_key")).agg(F.count("*").alias("own_n")), F.col(key).eqNullSafe(F.col("own_key")), "left")
    met = counted.join(other, F.col("own_key").eqNullSafe(F.col("other_key")), "full")
    same = F.coalesce((F.col("own_n") == 1) & (F.col("other_n") == 1), F.lit(False))
    checked = F.when(~same, F.raise_error(F.lit("both sides need the same unique keys"))).when(F.col("own_value").isNull() != F.col("other_value").isNull(), F.raise_error(F.lit("one side lacks a value"))).otherwise(F.col("own_value") - F.col("other_value"))
    return met.select(*left.columns, checked.alias("delta"))


def paired_difference(left: DataFrame, right: DataFrame, key: str, person: str, group: str, value: str, draws: int, seed: str) -> DataFrame:
    """One row: macro difference ``difference``, its interval ``lo, hi``, and the number of ``groups``."""
    means = written(paired(left, right, key, value).where("delta is not null").groupBy(person, group).agg(F.avg("delta").alias("mean")), "deltas")
    point = means.groupBy(group).agg(F.avg("mean").alias("m")).agg(F.avg("m").alias("difference"), F.count("*").alias("groups"))
    return point.crossJoin(resample.bootstrap_macro(means, person, group, draws, seed).select("lo", "hi"))
