"""Hashed resampling, splitting and scheduling: the same draws on any number of partitions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bisect, hash_int
from ..sources.scratch import written
from . import order


def draw_weights(people: DataFrame, pid: str, draws: int, seed: str) -> DataFrame:
    """``(draw, pid, times)``: people resampled with replacement, each draw of as many as there are people.

    People are numbered once (a table of distinct ids), each draw picks numbers
    by hash, and picks are summed before any join.
    """
    numbered = order.numbered(people.select(pid), [F.col(pid)], "i").withColumn("i", F.col("i") - 1)
    n = people.agg(F.count("*").alias("n"))
    picks = numbered.select("i").crossJoin(F.broadcast(n)).select(F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "i", "n")
    picked = picks.select("draw", F.pmod(hash_int(seed, F.col("draw"), F.col("i")), F.col("n")).alias("i")).groupBy("draw", "i").agg(F.count("*").alias("times"))
    return picked.join(numbered, "i").select("draw", pid, "times")


def bootstrap_macro(means: DataFrame, pid: str, group: str, draws: int, seed: str) -> DataFrame:
    """Interval of the macro mean when people are resampled with all their groups.

    The means are written first: people are numbered, counted and joined from that small table, not from what it was made of.
    """
    means = written(means.select(pid, group, "mean"), "means")
    weights = draw_weights(means.select(pid).distinct(), pid, draws, seed)
    per_group = means.join(weights, pid).groupBy("draw", group).agg((F.sum(F.col("times") * F.col("mean")) / F.sum("times")).alias("m"))
    per_draw = per_group.groupBy("draw").agg(F.avg("m").alias("m"))
    return per_draw.agg(F.avg("m").alias("center"), F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))


def bootstrap_groups(means: DataFrame, pid: str, group: str, draws: int, seed: str) -> DataFrame:
    """``(group, mean, lo, hi, persons)``: an interval for each group's mean over persons, all from the same draws of persons, so groups can be compared."""
    means = written(means.select(pid, group, "mean"), "means")
    weights = draw_weights(means.select(pid).distinct(), pid, draws, seed)
    drawn = means.join(weights, pid).groupBy("draw", group).agg((F.sum(F.col("times") * F.col("mean")) / F.sum("times")).alias("m"))
    ends = drawn.groupBy(group).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"))
    return means.groupBy(group).agg(F.avg("mean").alias("mean"), F.count("*").alias("persons")).join(ends, group).select(group, "mean", "lo", "hi", "persons")


def split(people: DataFrame, pid: str, seed: str, shares: tuple[float, float] = (0.7, 0.15), pinned: tuple = ()) -> DataFrame:
    """train, dev, test by hash order; pinned people come first. No task orders all of them."""
    first = F.when(F.col(pid).isin(*pinned), 0).otherwise(1) if pinned else F.lit(1)
    hashed = hash_int(seed, F.col(pid))
    ranked = order.numbered(people.select(pid), [first, hashed, F.col(pid)], "k")
    total = people.agg(F.count("*").alias("n"))
    cut = ranked.crossJoin(F.broadcast(total))
    a, b = F.floor(F.col("n") * shares[0]), F.floor(F.col("n") * (shares[0] + shares[1]))
    return cut.select(pid, F.when(F.col("k") <= a, "train").when(F.col("k") <= b, "dev").otherwise("test").alias("split"))


def schedule(people: DataFrame, tasks: DataFrame, pid: str, task: str, rounds: int, seed: str) -> DataFrame:
    """Every round has every person once; each person walks through a cycle of all tasks, dealt anew after every full cycle."""
    count = tasks.agg(F.count("*").alias("k"))
    turns = people.crossJoin(F.broadcast(count)).select(pid, "k", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    turns = turns.withColumns({"cycle": F.floor(F.col("round") / F.col("k")), "place": F.pmod("round", "k") + 1})
    cycles = turns.select(pid, "cycle").distinct().crossJoin(F.broadcast(tasks))
    dealt = cycles.withColumn("place", F.row_number().over(Window.partitionBy(pid, "cycle").orderBy(hash_int(seed, F.col(pid), F.col("cycle"), F.col(task)), F.col(task))).cast("long"))
    return turns.join(dealt, [pid, "cycle", "place"]).select(pid, "round", task)


def best_subset(items: DataFrame, key: str, item: str, length: str, target: DataFrame, subsets: int, seed: str) -> DataFrame:
    """Of ``subsets`` hashed halves of each key's items, the one whose length comes nearest its target; ties: the first."""
    drawn = items.select(key, item, length, F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))).alias("s"))
    sums = drawn.where(F.pmod(hash_int(seed, F.col("s"), F.col(item)), F.lit(2)) == 0).groupBy(key, "s").agg(F.sum(length).alias("total"), F.count("*").alias("n"))
    met = sums.join(target, key).withColumn("off", F.abs(F.col("total") - F.col("target")))
    return met.groupBy(key).agg(F.min(F.struct("off", "s", "total", "n")).alias("b")).select(key, "b.s", "b.total", "b.off", "b.n")


def packed(lengths, parents, shared, chosen) -> int:
    """Length of the ``chosen`` items (ascending places): of each parent's items, all but the first leave out their shared wording."""
    import numpy as np

    _, first = np.unique(parents[chosen], return_index=True)
    later = np.ones(len(chosen), bool)
    later[first] = False
    return int(lengths[chosen].sum() - shared[chosen][later].sum())


def near_length(lengths, parents, shared, target: int, count: int, seed, starts: int = 256, swaps: int = 2048):
    """Places of ``count`` items whose packed length comes near ``target``: the best of ``starts`` random sets, then random swaps that do not worsen it.

    Lengths alone decide, never what the items say. Everything if there are no more than ``count``.
    """
    import numpy as np

    n = len(lengths)
    if count >= n or count == 0:
        return np.arange(min(n, count))
    rng, best, error = np.random.default_rng(seed), None, None
    for _ in range(starts):
        chosen = np.sort(rng.choice(n, count, replace=False))
        off = abs(packed(lengths, parents, shared, chosen) - target)
        if error is None or off < error:
            best, error = chosen, off
        if not error:
            return best
    for slot, other in zip(rng.integers(0, count, swaps), rng.integers(0, n, swaps), strict=True):
        if (best == other).any():
            continue
        trial = best.copy()
        trial[slot] = other
        trial.sort()
        off = abs(packed(lengths, parents, shared, trial) - target)
        if off <= error:
            best, error = trial, off
        if not error:
            break
    return best


def length_matched(items: DataFrame, by: list[str], item: str, length: str, actual: str, parent: str, shared: str, chosen: str, seed: int = 42, tries: int = 8, within: float = 0.02) -> DataFrame:
    """``(by, item, tries, off)``: for each ``by`` as many items as are marked ``chosen``, of about the same length, drawn without looking at them.

    Sets are sought by estimated ``length`` (see :func:`near_length`), but judged by ``actual``; the sought target is moved by what the
    last set missed, at most ``tries`` times, until the actual packed lengths differ by ``within`` of the chosen ones' or less. ``tries``
    says how many were needed, ``off`` the relative difference of the best set. The search has no relational form:
    one Arrow batch of numbers for each ``by``, whose items are one person's. A ``by`` without chosen items has no row.
    """
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in items.schema}

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        import zlib

        import numpy as np

        frame = frame.sort_values(item, kind="stable").reset_index(drop=True)
        lengths, real, wording = (frame[c].to_numpy(np.int64) for c in (length, actual, shared))
        parents = np.unique(frame[parent].astype(str).to_numpy(), return_inverse=True)[1]
        wanted = np.flatnonzero(frame[chosen].to_numpy(bool))
        key = zlib.crc32("|".join(str(frame[c].iloc[0]) for c in by).encode())
        goal, sought, best, used = packed(real, parents, wording, wanted), packed(lengths, parents, wording, wanted), None, 0
        error = lambda s: abs(packed(real, parents, wording, s) - goal)
        for turn in range(tries + 1):
            trial = near_length(lengths, parents, wording, sought, len(wanted), [seed, key, turn])
            if best is None or error(trial) < error(best):
                best = trial
            used = turn
            if error(best) <= within * max(1, goal) or len(wanted) in (0, len(frame)):
                break
            sought += goal - packed(real, parents, wording, trial)
        out = frame.loc[best, [*by, item]].copy()
        out["tries"], out["off"] = used, error(best) / max(1, goal)
        return out

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*by, item]), "tries long, off double"])
    return items.groupBy(*by).applyInPandas(search, schema)


def weighted_choice(rows: DataFrame, by: list[str], choice: str, weight: str, draws: DataFrame, uniform) -> DataFrame:
    """``draws`` with ``choice``: one of their ``by``'s choices, in proportion to its weight.

    ``uniform`` is a column of whole numbers that is spread evenly modulo any total. Weights are summed by choice, run up
    in order of the choice, and kept as one array per ``by``, in which each draw finds its place by bisection. A
    choice without weight is never taken; draws whose ``by`` has no choice go.
    """
    sums = rows.groupBy(*by, F.col(choice).alias("_c")).agg(F.sum(weight).cast("long").alias("_w")).where("_w > 0")
    upto = F.sum("_w").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ladders = sums.withColumn("_upto", upto).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_upto", "_c"))).alias("_ladder"), F.sum("_w").alias("_total"))
    met = draws.join(ladders, by).withColumn("_at", F.pmod(uniform, F.col("_total")))
    rung = bisect(F.transform("_ladder", lambda r: r["_upto"]), F.col("_at"))
    return met.withColumn(choice, F.get("_ladder", rung)["_c"]).drop("_ladder", "_total", "_at")


def predict_batches(rows: DataFrame, predict, schema: str) -> DataFrame:
    """Adapter for an outside predictor: pandas batches in, pandas batches out."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            yield predict(frame)

    return rows.mapInPandas(run, schema)
