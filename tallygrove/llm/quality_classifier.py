"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over text statistics are grown on a bounded sample of
labelled rows; every path from a root becomes a conjunctive rule; a lasso
logistic fit keeps few of the rules and weighs them; what is kept is compiled
into one Spark column expression, so scoring is a single projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

STATS = ("chars", "words", "word_length", "symbols", "capitals", "digits", "marks", "exclaims", "beyond_ascii", "lines", "repeated_words", "repeated_lines", "blank")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column of :data:`STATS`: ratios and counts of the whole text, null as empty."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text, rest, words, lines, ascii_, blank, out = fresh(docs, "t", "rest", "words", "lines", "ascii", "blank", "stats")
    # What is neither a small letter nor beyond ASCII: a short string that all marks are counted on.
    staged = docs.withColumn(text, t).withColumns(
        {
            rest: F.regexp_replace(text, r"[a-z\u0080-\x{10FFFF}]+", ""),
            words: F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""),
            lines: F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0),
            ascii_: F.length(F.regexp_replace(text, r"[\x00-\x7F]+", "")),
            text: F.length(text),
        }
    )
    n, some = F.greatest(F.col(text), F.lit(1)), lambda x: F.greatest(x, F.lit(1))
    only = lambda kept: F.length(F.regexp_replace(rest, f"[^{kept}]+", "")) / n
    staged = staged.withColumn(blank, only(r"\x20\x09-\x0D"))
    nw = F.size(words)
    figures = {
        "chars": F.col(text), "words": nw, "word_length": (1 - F.col(blank)) * n / some(nw), "symbols": only(r"#*$%&|<>"), "capitals": only("A-Z"), "digits": only("0-9"),
        "marks": only(r".,;:?"), "exclaims": only("!"), "beyond_ascii": F.col(ascii_) / n, "lines": F.size(lines), "repeated_words": 1 - F.size(F.array_distinct(words)) / some(nw),
        "repeated_lines": 1 - F.size(F.array_distinct(lines)) / some(F.size(lines)), "blank": F.col(blank),
    }
    return staged.withColumn(out, F.struct(*(figures[k].cast("double").alias(k) for k in STATS))).drop(text, rest, words, lines, ascii_, blank)


Condition = tuple[int, bool, float]  # statistic, above?, threshold


@dataclass
class RuleEnsemble:
    """Score = sigmoid(bias + sum of weights of the rules that hold)."""

    bias: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, stats: str) -> Column:
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = None
            for stat, above, cut in conditions:
                value = F.col(stats)[STATS[stat]]
                one = value > cut if above else value <= cut
                holds = one if holds is None else holds & one
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hess: np.ndarray, depth: int, least: int) -> list[tuple[tuple[Condition, ...], np.ndarray, float]]:
    """Leaves and inner nodes of one tree: (path, rows, value)."""
    out: list = []

    def split(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        g, h = residual[rows].sum(), hess[rows].sum()
        if path:
            out.append((path, rows, g / (h + 1.0), True))
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-6, None)
        for j, edges in enumerate(cuts):
            if not len(edges):
                continue
            at = x[rows, j]
            bins = np.searchsorted(edges, at, side="left")
            gs, hs, ns = (np.cumsum(np.bincount(bins, w, len(edges) + 1))[:-1] for w in (residual[rows], hess[rows], None))
            ok = (ns >= least) & (len(rows) - ns >= least)
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1), 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (j, edges[k]))
        if best[1] is not None:
            j, cut = best[1]
            if path:
                out[-1] = (*out[-1][:3], False)
            up = x[rows, j] > cut
            split(rows[~up], (*path, (j, False, float(cut))))
            split(rows[up], (*path, (j, True, float(cut))))

    split(np.arange(len(x)), ())
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, valid: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 48) -> RuleEnsemble:
    """Fit on plain arrays; ``valid`` marks the rows that choose the lasso penalty. Deterministic."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(y):
        return RuleEnsemble()
    prior = (y.sum() + 1) / (len(y) + 2)
    constant = RuleEnsemble(bias=float(np.log(prior / (1 - prior))))
    if len(set(y.tolist())) < 2:
        return constant
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    margin, rng, paths = np.full(len(y), constant.bias), np.random.default_rng(0), {}
    least = max(2, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        part = np.sort(rng.choice(len(y), max(2, len(y) * 7 // 10), replace=False))
        nodes = _grow(x[part], cuts, (y - p)[part], (p * (1 - p))[part], depth, least)
        for path, _, value, leaf in nodes:
            paths.setdefault(_tidy(path), None)
            if leaf:
                margin += rate * np.clip(value, -4, 4) * _holds(x, path)
    rules = list(paths)
    if not rules:
        return constant
    r = np.stack([_holds(x, path) for path in rules], axis=1).astype(float)
    fit, best = ~valid if valid.any() and len(set(y[~valid].tolist())) == 2 else np.ones(len(y), bool), (np.inf, None)
    check = valid if valid.any() else fit
    w, b = np.zeros(len(rules)), constant.bias
    for penalty in np.geomspace(0.03, 0.0003, 9):
        w, b = _lasso(r[fit], y[fit], penalty, w, b)
        p = np.clip(1 / (1 + np.exp(-(r[check] @ w + b))), 1e-9, 1 - 1e-9)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
        if loss < best[0] - 1e-4:
            best = (loss, (w.copy(), b))
    w, b = best[1]
    return RuleEnsemble(float(b), [(rules[k], float(w[k])) for k in np.flatnonzero(w)])


def _tidy(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound per statistic and side."""
    tight: dict[tuple[int, bool], float] = {}
    for stat, above, cut in path:
        key = (stat, above)
        tight[key] = (max if above else min)(tight.get(key, cut), cut)
    return tuple(sorted((s, a, c) for (s, a), c in tight.items()))


def _holds(x: np.ndarray, path: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for stat, above, cut in path:
        out &= x[:, stat] > cut if above else x[:, stat] <= cut
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic loss with an L1 penalty; the bias is free."""
    full = np.hstack([r, np.ones((len(r), 1))])
    now = np.r_[w, b]
    v = np.ones(full.shape[1])
    for _ in range(12):  # largest eigenvalue bounds the curvature
        v = full.T @ (full @ v)
        norm = np.linalg.norm(v)
        v /= norm
    size, ahead, t = 4 * len(y) / (norm * 1.02), now.copy(), 1.0
    for _ in range(steps):
        grad = full.T @ (1 / (1 + np.exp(-np.clip(full @ ahead, -60, 60))) - y) / len(y)
        after = ahead - size * grad
        after[:-1] = np.sign(after[:-1]) * np.maximum(np.abs(after[:-1]) - size * penalty, 0)
        t_after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, moved = after + (t - 1) / t_after * (after - now), np.abs(after - now).max()
        now, t = after, t_after
        if moved < 1e-6:
            break
    return now[:-1], float(now[-1])


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)), F.lit(0))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", **options) -> RuleEnsemble:
    """Fit on about ``sample_rows`` labelled ids at most, taken by hash; held-out ids are never read.

    Each id and label gives one row, of the text with the least hash where several rows have the id, so the driver
    gets no more rows than were picked. Rows without id, label or document are passed over; without two classes the
    ensemble is the smoothed prior alone.
    """
    return fit_rules(*sample(docs, labels, sample_rows, id_col, text_col, label_id, label_col), **options)


def sample(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What :func:`train` fits on: statistics, labels, and the rows that choose the penalty."""
    known = labels.where(F.col(label_id).isNotNull() & F.col(label_col).isNotNull() & (fold(label_id) != 0)).select(F.col(label_id).alias("i"), F.col(label_col).cast("int").alias("y")).distinct()
    number = known.count()
    part = min(1.0, sample_rows / max(1, number))
    picked = known.where(F.pmod(F.xxhash64("i", F.lit(13)), F.lit(1_000_000)) < int(part * 1_000_000))
    # The sample is bounded by sample_rows, so its few numbers may go to every task.
    near = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).join(F.broadcast(picked), "i")
    stats = statistics(near.withColumn("h", F.xxhash64("text"))).groupBy("i", "y").agg(F.min(F.struct("h", "_tg_stats")).alias("one"))
    rows = stats.select("i", "y", F.pmod(F.xxhash64("i", F.lit(17)), F.lit(5)).alias("f"), "one._tg_stats.*").orderBy("i", "y").collect()
    return np.array([[r[k] for k in STATS] for r in rows]).reshape(len(rows), len(STATS)), np.array([r.y for r in rows]), np.array([r.f == 0 for r in rows], bool)


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_name: str | None = None) -> DataFrame:
    """``docs`` with a score from 0 to 1. Null and empty texts are scored as empty; every row stays."""
    name = score_name or fresh(docs, "score")[0]
    stats = fresh(docs, "stats")[0]
    return statistics(docs, text_col).withColumn(name, model.column(stats)).drop(stats)


def reject_low(docs: DataFrame, labels: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns kept.

    Null and empty texts are scored as empty; rows of equal text score alike, so ties and repeated rows stay or go together; an empty table stays empty.
    """
    name = fresh(docs, "score")[0]
    return score(docs, train(docs, labels, **options), score_name=name).where(F.col(name) >= least).drop(name)


def op1_quality_classifier(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """Contract digest of :func:`score` with a model of :func:`train`: ``doc_id, held_out, score, predicted``, one row per row.

    Null and empty texts are scored as empty; a null id counts as held out; repeated rows get equal scores; extra columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model, score_name="score")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
