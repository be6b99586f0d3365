"""Hand examples of guards, audits, intervals and Markdown structure."""

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import audit, baseline, calibrate, markdown, resample, summary


def test_a_missing_outcome_that_could_tie_blocks(spark):
    rows = [("free", "a", 0.9), ("free", "a", 0.7), ("free", "b", 0.2), ("free", "b", None), ("tie", "a", 0.5), ("tie", "b", None), ("tie", "b", 0.0), ("none", "a", None), ("even", "b", 0.5), ("even", "a", 0.5), ("own", "a", 0.1), ("own", "a", None)]
    got = {r.s: (r.winner, r.score, r.challengers, r.floor, r.blocked) for r in calibrate.guarded_best(spark.createDataFrame(rows, "s string, c string, v double"), "s", "c", "v").collect()}
    assert got == {"free": ("a", 0.8, 0, None, False), "tie": ("a", 0.5, 1, 0.0, True), "none": (None, None, 1, 0.0, True), "even": ("a", 0.5, 0, None, False), "own": (None, None, 1, 0.05, True)}


def test_rules_name_their_metric():
    aliases = {"least loss": "nll", "most credit": "agreement"}
    assert calibrate.metric_of({}, aliases, default="least loss") == "nll"
    assert calibrate.metric_of({"selection": "most credit"}, aliases, "checkpoint") == "agreement"
    assert calibrate.metric_of({"selection": "most credit", "checkpoint": "least loss"}, aliases, "checkpoint") == "nll"
    with pytest.raises(ValueError, match="other"):
        calibrate.metric_of({"selection": "other"}, aliases)


def test_lookup_fails_without_support(spark):
    stats = spark.createDataFrame([("x", 1), ("y", None)], "i string, m int")
    rows = spark.createDataFrame([("x",), ("y",)], "i string")
    assert {r.i: r.m for r in baseline.looked_up(rows, stats, ["i"], "m").collect()} == {"x": 1, "y": None}
    with pytest.raises(Exception, match="no training support|z"):
        baseline.looked_up(rows.union(spark.createDataFrame([("z",)], "i string")), stats, ["i"], "m").collect()


def test_a_found_person_without_membership_fails(spark):
    expected = spark.createDataFrame([(1, "a", 1.0, 2.0, "s"), (1, "b", 1.0, 1.0, "s"), (9, "a", 1.0, 1.0, "s")], "p int, k string, early double, late double, stimulus string")
    found = spark.createDataFrame([(1, "a", 2.0, False, "s"), (1, "c", 1.0, False, "s"), (9, "a", 0.0, True, "t")], "p int, k string, value double, invalid boolean, stimulus string")
    member = spark.createDataFrame([(1, "train"), (2, "dev"), (9, "test")], "p int, split string")
    got = audit.responses(expected, found, member, "p", ["k"]).first().asDict()
    assert got["expected_responses"] == 2 and got["missing_responses"] == got["unexpected_keys"] == got["matches"] == got["changed_matches"] == got["missing_participants"] == got["reserved_excluded"] == 1 and len(got) == 23
    with pytest.raises(Exception, match="unknown participant"):
        audit.responses(expected, found, member.where("p <> 1"), "p", ["k"]).collect()


def test_intervals_of_groups_share_their_draws(spark):
    """Two groups with the same values have the same interval; a constant has none."""
    rows = [(p, g, {"a": float(p % 7), "b": float(p % 7), "c": 2.5}[g]) for p in range(60) for g in "abc"]
    got = {r.g: r for r in resample.bootstrap_groups(spark.createDataFrame(rows, "p int, g string, mean double"), "p", "g", 50, "s").collect()}
    assert got["a"].lo == pytest.approx(got["b"].lo) and got["a"].hi == pytest.approx(got["b"].hi) and got["a"].lo < got["a"].mean < got["a"].hi
    assert got["c"].lo == pytest.approx(2.5) and got["c"].hi == pytest.approx(2.5) and got["c"].persons == 60
    mean, low, high = spark.range(1).select(*(x.alias(n) for n, x in zip("mlh", summary.complement(F.lit(0.7), F.lit(0.6), F.lit(0.9)), strict=True))).first()
    assert (mean, low, high) == pytest.approx((0.3, 0.1, 0.4))


def test_markdown_by_hand(spark):
    text = "# One two\n```py\n# not one\n[in](#gone)\n```\n## Über_x, y-z!\n# One two\n##### five\n#none\n[a](#one-two-1) [b](other.md#über_x-y-z) ![c](pic.png) [d](http://x#y) [e](#one-two-2)\n[f]()"
    df = spark.createDataFrame([("me.md", text), ("other.md", "## Über_x, y-z!\r\n```\n# open"), ("empty", None)], "k string, t string")
    marked = markdown.lines(df, "k", F.col("t"))
    assert {r.k: r.unclosed for r in marked.select("k", "unclosed").distinct().collect()} == {"me.md": False, "other.md": True, "empty": False}
    heads = markdown.headings(marked, "k")
    assert sorted((r.k, r.n, r.level, r.anchor) for r in heads.collect()) == [("me.md", 0, 1, "one-two"), ("me.md", 5, 2, "über_x-y-z"), ("me.md", 6, 1, "one-two-1"), ("other.md", 0, 2, "über_x-y-z")]
    got = markdown.checked(markdown.links(marked, "k"), heads, df.select("k", F.col("k").alias("name")), "k")
    assert sorted((r.n, r.file, r.fragment, r.state) for r in got.collect()) == [(3, "", "gone", "no anchor"), (9, "", "one-two-1", "ok"), (9, "", "one-two-2", "no anchor"), (9, "other.md", "über_x-y-z", "ok"), (9, "pic.png", None, "no file")]
