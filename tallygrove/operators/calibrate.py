"""Calibration and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def fit_temperature(rows: DataFrame, person: str, group: str, probs: str, truth: str, points: int = 161, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """``(t, nll)`` with the least macro loss on a log-spaced grid; the first of equals.

    Rows of a person and group with equal probabilities and truth are counted first, so the grid is tried once for each kind of
    row; its losses are summed by person and group before they leave their task.
    """
    grid = [10 ** (low + (high - low) * i / (points - 1)) for i in range(points)]
    kinds = rows.groupBy(person, group, probs, truth).agg(F.count("*").alias("n"))
    long = kinds.select(person, group, probs, truth, "n", F.explode(F.array(*(F.lit(t) for t in grid))).alias("t"))
    loss = scoring.nll(scoring.tempered(F.col(probs), F.col("t")), F.col(truth))
    cells = long.select("t", person, group, (loss * F.col("n")).alias("x"), F.when(loss.isNotNull(), F.col("n")).alias("n")).groupBy("t", person, group).agg((F.sum("x") / F.sum("n")).alias("m"))
    per_t = cells.groupBy("t", group).agg(F.avg("m").alias("m")).groupBy("t").agg(F.avg("m").alias("nll"))
    return per_t.agg(F.min(F.struct("nll", "t")).alias("b")).select("b.t", "b.nll")


def decision(low: Column, high: Column, above: str, below: str, neither: str) -> Column:
    """What an interval says of its sign."""
    return F.when(low > 0, above).when(high < 0, below).otherwise(neither)


def accepted(gain: Column, high: Column, least: float = 0.02) -> Column:
    """A relative gain of ``least`` or more, and an interval of differences below nought."""
    return (gain >= least) & (high < 0)


def metric_of(rules: dict[str, str], aliases: dict[str, str], purpose: str = "selection", default: str | None = None) -> str:
    """The metric that a rule names. Each purpose may have a rule of its own, else that of ``selection`` holds, else ``default``; an unknown rule is an error."""
    rule = rules.get(purpose, rules.get("selection", default))
    if rule not in aliases:
        raise ValueError(f"unknown selection rule: {rule}")
    return aliases[rule]


def guarded_best(outcomes: DataFrame, by: str, candidate: str, value: str, low: float = 0.0, high: float = 1.0, digits: int = 9) -> DataFrame:
    """``(by, winner, score, challengers, floor, blocked)``: the best of the candidates whose outcomes are all there, and whether it may be taken.

    A missing outcome (a null ``value``) lies between ``low`` and ``high``, so a candidate's mean lies between two bounds.
    Those whose upper bound reaches the winner's score, ties included, are challengers: while there is one, the choice is blocked.
    ``floor`` is the best lower bound of a challenger (null: none). Of equal scores the first candidate by name wins; without a complete candidate
    there is no winner and the choice is blocked.
    """
    bound = lambda x: F.round(F.sum(F.coalesce(F.col(value), F.lit(x))) / F.count("*"), digits)
    means = outcomes.groupBy(by, candidate).agg(F.count_if(F.col(value).isNull()).alias("_absent"), bound(low).alias("_low"), bound(high).alias("_high"))
    whole = F.col("_absent") == 0
    best = means.groupBy(by).agg(F.min(F.when(whole, F.struct((-F.col("_low")).alias("s"), F.col(candidate).alias("c")))).alias("_w"))
    met = means.join(best, by).withColumn("_may", ~whole & F.coalesce(F.col("_high") >= -F.col("_w.s"), F.lit(True)))
    out = met.groupBy(by).agg(F.first("_w").alias("_w"), F.count_if("_may").alias("challengers"), F.max(F.when(F.col("_may"), F.col("_low"))).alias("floor"))
    return out.select(by, F.col("_w.c").alias("winner"), (-F.col("_w.s")).alias("score"), "challengers", "floor", (F.col("_w").isNull() | (F.col("challengers") > 0)).alias("blocked"))


def loss(value: Column, larger_is_better: bool) -> Column:
    """What selection lessens; a value that is not finite is an error."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(~finite, F.raise_error(F.lit("score is not finite")).cast("double")).otherwise(-value if larger_is_better else value)
