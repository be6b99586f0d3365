"""Keyed matching with its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import order


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their number: empty if the key is one."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_differences(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Keys of one side only, with ``side``: empty if the key sets are equal."""
    a = left.select(*keys).distinct().withColumn("l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("r", F.lit(1))
    return a.join(b, list(keys), "full").where("l is null or r is null").select(*keys, F.when(F.col("r").isNull(), "left").otherwise("right").alias("side"))


def pair(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], check: bool = True) -> DataFrame:
    """One row per key with ``<field>_l`` and ``<field>_r``; with ``check``, unequal or repeated keys raise."""
    if check:
        bad = key_differences(left, right, *keys).limit(1).count() or duplicate_keys(left, *keys).limit(1).count() or duplicate_keys(right, *keys).limit(1).count()
        if bad:
            raise ValueError("pairs need the same unique keys on both sides")
    name = lambda side, df: df.select(*keys, *(F.col(f).alias(f"{f}_{side}") for f in fields))
    return name("l", left).join(name("r", right), keys)


def remaining(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def reconcile(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """One row of counters: a full join and one conditional aggregate."""
    a = expected.select(key, F.col(value).alias("e"), F.lit(1).alias("in_e"))
    b = found.select(key, F.col(value).alias("f"), F.lit(1).alias("in_f"))
    both = a.join(b, key, "full")
    n = lambda c: F.count_if(c)
    in_e, in_f = F.col("in_e").isNotNull(), F.col("in_f").isNotNull()
    return both.agg(
        n(in_e).alias("expected"), n(in_e & ~in_f).alias("missing"), n(~in_e & in_f).alias("unexpected"),
        n(in_e & in_f & F.col("e").eqNullSafe(F.col("f"))).alias("unchanged"), n(in_e & in_f & ~F.col("e").eqNullSafe(F.col("f"))).alias("changed"),
    )


def donors(people: DataFrame, pid: str, seed: str, rank: Column) -> DataFrame:
    """A bijection without fixed points (for two people or more): each one's donor is the next in hash order, the last's the first.

    ``people`` is a table of distinct ids; no task orders all of them.
    """
    return order.successors(people.select(pid), pid, rank, "donor")


def as_of(facts: DataFrame, at: str, phases: DataFrame, start: str, settings: list[str]) -> DataFrame:
    """Each fact with the settings of all phases begun by then: the latest value that is not null.

    ``phases`` is a short list: it is turned into one row of ordered arrays that every task holds.
    """
    steps = phases.agg(F.array_sort(F.collect_list(F.struct(start, *settings))).alias("steps"))
    met = facts.crossJoin(F.broadcast(steps))
    for s in settings:
        met = met.withColumn(s, _latest(at, start, s))
    return met.drop("steps")


def _latest(at: str, start: str, setting: str) -> Column:
    known = F.filter("steps", lambda p: (p[start] <= F.col(at)) & p[setting].isNotNull())
    return F.when(F.size(known) > 0, F.element_at(known, -1)[setting])


def fill_expected(names: DataFrame, results: DataFrame, key: str, value: str, missing: str) -> DataFrame:
    """Every expected name, with its result or a word for none."""
    return names.join(results, key, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(missing)))


def fan_out(rows: DataFrame, by: Column, result: Column, name: str) -> DataFrame:
    """Work done once per distinct content and given to every row that has it."""
    keyed = rows.withColumn("content", by)
    once = keyed.dropDuplicates(["content"]).select("content", result.alias(name))
    return keyed.join(once, "content").drop("content")
