"""Scores of a predicted answer against a true one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-12


def agreement(kind: Column, truth: Column, guess: Column, low: Column, high: Column) -> Column:
    """0 or 1 for nominal and binary; 1 - distance over range for ordinal and bounded; null for unbounded or a range of nothing."""
    near = 1 - F.try_divide(F.abs(truth - guess), high - low)
    same = F.when(truth == guess, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(kind.isin("nominal", "binary"), same).when(kind.isin("ordinal", "bounded_numeric"), near)


def exact(truth: Column, guess: Column) -> Column:
    return F.when(truth == guess, F.lit(1.0)).otherwise(F.lit(0.0))


def uniform_categorical(truth: Column, levels: Column, ordinal: bool) -> Column:
    """Expected agreement of a uniform guess over levels."""
    ks = F.sequence(F.lit(1), levels)
    one = (lambda k: 1 - F.try_divide(F.abs(truth - k), levels - 1)) if ordinal else (lambda k: F.when(k == truth, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.aggregate(F.transform(ks, lambda k: one(k).cast("double")), F.lit(0.0), lambda s, x: s + x) / levels


def uniform_bounded(truth: Column, low: Column, high: Column) -> Column:
    width = high - low
    return 1 - F.try_divide((truth - low) * (truth - low) + (high - truth) * (high - truth), 2 * width * width)


def nll(probs: Column, truth: Column) -> Column:
    return -F.ln(F.greatest(F.element_at(probs, truth.cast("int")), F.lit(FLOOR)))


def brier(probs: Column, truth: Column) -> Column:
    off = F.transform(probs, lambda p, k: F.pow(p - F.when(k + 1 == truth, 1.0).otherwise(0.0), F.lit(2.0)))
    return F.aggregate(off, F.lit(0.0), lambda s, x: s + x)


def is_distribution(probs: Column, levels: Column, tolerance: float = 1e-6) -> Column:
    total = F.aggregate(probs, F.lit(0.0), lambda s, x: s + x)
    return (F.size(probs) == levels) & F.forall(probs, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0)) & (F.abs(total - 1) < tolerance)


def argmax(probs: Column) -> Column:
    """1-based; the first of equals."""
    return F.array_position(probs, F.array_max(probs))


def tempered(probs: Column, t: Column) -> Column:
    """Softmax of log-probabilities over t; changes probabilities only."""
    logs = F.transform(probs, lambda p: F.ln(F.greatest(p, F.lit(FLOOR))) / t)
    powers = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def scored(kind: Column, truth: Column, guess: Column, low: Column, high: Column, levels: Column) -> dict[str, Column]:
    """Columns invalid, exact, agreement, absolute_error. An invalid guess scores 0 and has no error."""
    whole = kind.isin("nominal", "binary", "ordinal")
    bad = guess.isNull() | F.when(whole, (guess < 1) | (guess > levels) | (guess != F.floor(guess))).otherwise((guess < low) | (guess > high))
    bad = F.coalesce(bad, F.lit(False))
    lo, hi = F.when(whole, F.lit(1.0)).otherwise(low), F.when(whole, levels.cast("double")).otherwise(high)
    return {
        "invalid": bad,
        "exact": F.when(kind != "unbounded_numeric", F.when(bad, F.lit(0.0)).otherwise(exact(truth, guess))),
        "agreement": F.when(kind != "unbounded_numeric", F.when(bad, F.lit(0.0)).otherwise(agreement(kind, truth, guess, lo, hi))),
        "absolute_error": F.when(~whole & ~bad, F.abs(truth - guess)),
    }
