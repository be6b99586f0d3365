"""Audits that return counts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recomputed(rows: DataFrame, stored: Column, again: Column, tolerance: float = 1e-10) -> DataFrame:
    differs = F.coalesce(F.abs(stored - again) > tolerance, ~stored.eqNullSafe(again))
    return rows.agg(F.count("*").alias("checked"), F.count_if(differs).alias("differing"))


def ordered(rows: DataFrame, exact: str, agreement: str) -> DataFrame:
    good = (F.col(exact) >= 0) & (F.col(exact) <= F.col(agreement)) & (F.col(agreement) <= 1)
    return rows.agg(F.count("*").alias("checked"), F.count_if(~good).alias("violations"))


def replayed(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Largest absolute difference of two arrays of probabilities."""
    off = F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    return rows.agg(F.round(F.max(off), 6).alias("most"), F.count("*").alias("n"))


def responses(expected: DataFrame, found: DataFrame, membership: DataFrame, person: str, keys: list[str], reserved: str = "test") -> DataFrame:
    """One row of 23 counters: what became of every expected response, unchanged, missing and unexpected ones included.

    ``expected``: ``person``, ``keys``, ``early``, ``late``, ``stimulus``, once per key; ``found``: ``person``, ``keys``, ``value``, ``invalid``, ``stimulus``, once per key;
    ``membership``: ``person``, ``split``. Reserved persons are left out, but counted; a found person without membership makes the query fail.
    Both sides meet on the whole key in one full join, and persons in another; nothing is dropped from the denominators.
    """
    member = membership.select(F.col(person).alias("_p"), "split")
    open_ = member.where(F.col("split") != reserved).select("_p")
    place = found.join(member, F.col(person) == F.col("_p"), "left")
    known = F.when(F.col("_p").isNull(), F.raise_error(F.concat(F.lit("unknown participant: "), F.col(person).cast("string"))).cast("string")).otherwise(F.col("split"))
    own = place.withColumn("split", known).where(F.col("split") != reserved).select(person, *keys, "value", "invalid", F.col("stimulus").alias("_seen"), F.lit(True).alias("_there"))
    ask = expected.join(open_, F.col(person) == F.col("_p")).select(person, *keys, "early", "late", "stimulus", F.lit(True).alias("_asked"))
    both = ask.join(own, [person, *keys], "full")
    asked, there = F.col("_asked").isNotNull(), F.col("_asked").isNotNull() & F.col("_there").isNotNull()
    value, early, late = F.col("value"), F.col("early"), F.col("late")
    alike = F.col("_seen").eqNullSafe(F.col("stimulus"))
    fair = there & value.isNotNull() & late.isNotNull() & alike
    changed = fair & early.isNotNull() & (early != late)
    unchanged = fair & early.isNotNull() & (early == late)
    n = F.count_if
    counts = both.agg(
        n(asked).alias("expected_responses"), n(asked & ~there).alias("missing_responses"), n(there).alias("present_responses"), n(there & F.col("invalid")).alias("invalid_responses"), n(there & value.isNull()).alias("missing_or_invalid_values"),
        n(asked & (early.isNull() | late.isNull())).alias("reference_missing_values"), n(asked & (early != late)).alias("changed_responses"), n(asked & (early == late)).alias("unchanged_responses"), n(there & ~alike).alias("stimulus_mismatches"),
        n(fair).alias("comparable_responses"), n(fair & (value == late)).alias("matches"), n(fair & (value != late)).alias("disagreements"),
        n(changed).alias("changed_comparisons"), n(changed & (value == late)).alias("changed_matches"), n(changed & (value != late)).alias("changed_disagreements"),
        n(unchanged).alias("unchanged_comparisons"), n(unchanged & (value == late)).alias("unchanged_matches"), n(unchanged & (value != late)).alias("unchanged_disagreements"), n(~asked).alias("unexpected_keys"),
    )
    people = member.join(found.select(F.col(person).alias("_p"), F.lit(True).alias("_came")).distinct(), "_p", "left")
    wanted = F.col("split") != reserved
    persons = people.agg(n(wanted).alias("expected_participants"), n(wanted & F.col("_came").isNotNull()).alias("participants"), n(wanted & F.col("_came").isNull()).alias("missing_participants"), n(~wanted).alias("reserved_excluded"))
    return counts.crossJoin(F.broadcast(persons))
