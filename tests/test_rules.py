"""Hand examples and the rules that scoring, matching and resampling must keep."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import scalars, scoring
from tallygrove.operators import aggregate, baseline, calibrate, match, nested, resample, retrieve
from tallygrove.sources import jsonl, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_agreement_by_kind(spark):
    score = lambda kind, t, p, lo, hi: one(spark, scoring.agreement(F.lit(kind), F.lit(t), F.lit(p), F.lit(lo), F.lit(hi)))
    assert score("nominal", 1, 2, 1, 5) == 0 and score("ordinal", 1, 2, 1, 5) == 0.75
    assert score("unbounded_numeric", 10, 20, 0, 1) is None and score("bounded_numeric", 1, 1, 3, 3) is None


@pytest.mark.parametrize(("guess", "want"), [(30.0, (False, 0.0, 0.9, 10.0)), (200.0, (True, 0.0, 0.0, None)), (None, (True, 0.0, 0.0, None)), (20.0, (False, 1.0, 1.0, 0.0))])
def test_invalid_guesses_stay_and_score_nothing(spark, guess, want):
    got = scoring.scored(F.lit("bounded_numeric"), F.lit(20.0), F.lit(guess).cast("double"), F.lit(0.0), F.lit(100.0), F.lit(None).cast("int"))
    row = spark.range(1).select(*(c.alias(n) for n, c in got.items())).first()
    assert tuple(row) == pytest.approx(want)


def test_zero_is_valid_and_nothing_is_clipped(spark):
    state = lambda raw: one(spark, scalars.state(F.lit(raw).cast("string"), scalars.number(F.lit(raw).cast("string")), F.lit(0), F.lit(20)))
    assert [state(x) for x in ("0", "21", "", None, "abc", " 20 ")] == ["valid", "invalid", "missing", "missing", "invalid", "valid"]


@pytest.mark.parametrize(("raw", "want"), [("1,000", 1000.0), (" .5 ", 0.5), ("5d", None), ("nan", None), ("inf", None), ("1_000", None), ("", None), ("-2e3", -2000.0), ("1e999", None)])
def test_number(spark, raw, want):
    assert one(spark, scalars.number(F.lit(raw))) == want


def test_route_and_kind_fail_closed(spark):
    route = lambda k, n: one(spark, scalars.route(F.lit(k), F.lit(n), {"q1": "fixed"}, [("Ab", "first"), ("A", "second")]))
    assert route("q1", "Abx") == "fixed" and route("q2", "Abx") == "first" and route("q2", "Ax") == "second"
    with pytest.raises(Exception, match="unmapped"):
        route("q2", "zzz")
    with pytest.raises(Exception, match="unreviewed"):
        one(spark, scalars.kind(F.lit("MC"), F.lit(1), F.lit(False)))
    assert one(spark, scalars.price(F.lit("Product priced at: $12.50"), strict=True)) == 12.5
    with pytest.raises(Exception, match="no price"):
        one(spark, scalars.price(F.lit("nothing"), strict=True))


def test_canonical_hash_ignores_key_order(spark):
    a, b = (one(spark, scalars.canonical_hash(F.lit(x))) for x in ('{"b": 1, "a": {"d": 2, "c": 3}}', '{"a":{"c":3,"d":2},"b":1}'))
    assert a == b


def test_losses(spark):
    rows = spark.createDataFrame([([0.8, 0.2], 1), ([0.3, 0.7], 2)], "p array<double>, y int")
    got = rows.agg(F.avg(scoring.brier(F.col("p"), F.col("y"))).alias("b"), F.avg(scoring.nll(F.col("p"), F.col("y"))).alias("n"), F.avg((scoring.argmax(F.col("p")) == F.col("y")).cast("int"))).first()
    assert tuple(got) == pytest.approx((0.13, (-math.log(0.8) - math.log(0.7)) / 2, 1.0))


def test_temperature_moves_probabilities_only(spark):
    rows = spark.createDataFrame([(float(t),) for t in (0.1, 0.5, 1, 3, 10)], "t double").withColumn("p", F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3)))
    got = rows.select("t", scoring.tempered(F.col("p"), F.col("t")).alias("q")).select("t", scoring.argmax(F.col("q")).alias("k"), scoring.is_distribution(F.col("q"), F.lit(3)).alias("ok"), "q").collect()
    assert all(r.k == 2 and r.ok for r in got) and next(r.q for r in got if r.t == 1) == pytest.approx([0.2, 0.5, 0.3])


def test_macro_weighs_groups_equally_and_skips_nulls(spark):
    rows = spark.createDataFrame([("a", "Pricing", 1.0)] * 40 + [("b", "Pricing", 0.0), ("a", "Anchoring", 0.0), ("b", "Anchoring", 0.0), ("b", "Anchoring", None)], "pid string, g string, v double")
    assert aggregate.macro(rows, "pid", "g", "v").first().macro == pytest.approx(0.25)
    small = spark.createDataFrame([("a", "S", 1.0)] + [("b", "L", 0.0)] * 40, "pid string, g string, v double")
    assert aggregate.macro(small, "pid", "g", "v").first().macro == pytest.approx(0.5)
    pooled = spark.createDataFrame([("a", "g", 0.0), ("a", "g", 1.0), ("a", "g", 1.0)], "pid string, g string, v double")
    assert aggregate.person_group_mean(pooled, "pid", "g", "v").first()["mean"] == pytest.approx(2 / 3)


def test_baselines_see_training_rows_only(spark):
    train = spark.createDataFrame([("q", 1), ("q", 1), ("q", 2)], "item string, code int")
    assert {r.code: r.p for r in baseline.smoothed(train, "item", "code", 2).collect()} == pytest.approx({1: 0.6, 2: 0.4})
    tie = spark.createDataFrame([("q", 2), ("q", 1)], "item string, code int")
    assert baseline.mode(tie, "item", "code").first()["mode"] == 1


def test_pairs_need_equal_unique_keys(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    assert match.pair(a, a, ["k"], ["v"]).count() == 2
    for bad in (a.where("k = 'x'"), a.union(a)):
        with pytest.raises(ValueError):
            match.pair(a, bad, ["k"], ["v"])


def test_donors_are_a_derangement_whatever_the_order(spark):
    people = spark.createDataFrame([(str(i),) for i in range(50)], "pid string")
    first, again = ({r.pid: r.donor for r in match.donors(p, "pid", "d", scalars.hash_int("d", F.col("pid"))).collect()} for p in (people, people.orderBy(F.desc("pid"))))
    assert first == again and sorted(first.values()) == sorted(first) and all(k != v for k, v in first.items())


def test_repeats_are_averaged_before_anything_else(spark):
    runs = spark.createDataFrame([("p", "k", 1.0), ("p", "k", 0.0), ("p", "n", 1.0), ("p", "n", None)], "pid string, key string, v double")
    got = {r.key: r.v for r in aggregate.average_runs(runs, ["pid", "key"], "v", 2).collect()}
    assert got == {"k": 0.5, "n": None}
    with pytest.raises(Exception, match="misses a run"):
        aggregate.average_runs(runs.limit(3), ["pid", "key"], "v", 2).collect()


def test_rank_fusion(spark):
    rows = spark.createDataFrame([(0, 0, 0.0, -0.1), (0, 1, 2.0, -0.2), (0, 2, 1.0, -0.3)], "q int, d int, k double, s double")
    got = {r.d: r.fused for r in retrieve.fused(rows, "q", "d", "k", "s").collect()}
    assert got == pytest.approx({0: 1 / 61, 1: 1 / 61 + 1 / 62, 2: 1 / 62 + 1 / 63})


def test_ambiguous_rows_stay_whole(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["x", "y"]), (2, ["a", "b", "c"], ["x", "y"])], "id int, r array<string>, a array<string>")
    got = sorted(tuple(r) for r in nested.split_rows(rows, ["id"], "r", "a").collect() if r.id == 1)
    assert got == [(1, False, "a", "x"), (1, False, "b", "y")]
    assert [tuple(r) for r in nested.split_rows(rows, ["id"], "r", "a").where("id = 2").collect()] == [(2, True, None, None)]


def test_question_positions(spark):
    rows = spark.createDataFrame([(1, [(" A ", [("q1",), ("q1",)]), ("B", [("q1",)])])], "pid int, blocks array<struct<BlockName:string,Questions:array<struct<QuestionID:string>>>>")
    got = nested.question_records(rows, ["pid"], "blocks").select("bi", "qi", "block_name", nested.field("question", "QuestionID")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, "A", "q1"), (0, 1, "A", "q1"), (1, 0, "B", "q1")]


def test_constant_bootstrap(spark):
    means = spark.createDataFrame([(str(i), "g", 0.7) for i in range(20)], "pid string, g string, mean double")
    got = resample.bootstrap_macro(means, "pid", "g", 50, "s").first()
    assert (got.lo, got.hi) == pytest.approx((0.7, 0.7))


def test_split_is_disjoint_and_pinned(spark):
    people = spark.createDataFrame([(i,) for i in range(100)], "pid long")
    got = {r.pid: r.split for r in resample.split(people, "pid", "s", pinned=(98, 99)).collect()}
    assert len(got) == 100 and got[98] == got[99] == "train" and sorted(got.values()).count("train") == 70


def test_schedule_is_balanced(spark):
    people, tasks = (spark.createDataFrame([(f"{k}{i}",) for i in range(n)], f"{k} string") for k, n in (("p", 6), ("t", 4)))
    got = resample.schedule(people, tasks, "p", "t", 8, "s").toPandas()
    assert len(got) == 48 and (got.groupby(["p", "t"]).size() == 2).all() and (got.groupby("round").p.nunique() == 6).all()


def test_matched_sets_have_the_count_and_the_length(spark):
    """Short rows of a few parents, which share much of their wording, beside long single items."""
    rng = random.Random(3)
    rows = [(p, i, rng.choice([3, 5, 40, 90]), i // 4, 2 + i % 2, i % 9 == p % 9) for p in range(12) for i in range(60)] + [(50, i, 7, i, 0, True) for i in range(3)] + [(51, 0, 5, 0, 0, False)]
    items = spark.createDataFrame(rows, "p int, i int, n int, parent int, shared int, chosen boolean").withColumn("real", F.col("n") + F.pmod("i", F.lit(3)))
    args = (["p"], "i", "n", "real", "parent", "shared", "chosen")
    got, again = (resample.length_matched(x, *args).toPandas() for x in (items, items.repartition(7)))
    assert sorted(got.itertuples(index=False)) == sorted(again.itertuples(index=False)) and set(got.p) == {*range(12), 50}

    def length(some):
        seen, total = set(), 0
        for x in sorted(some):
            n, parent, shared = next((r[2] + r[1] % 3, r[3], r[4]) for r in rows if r[:2] == x)
            total += n - (shared if parent in seen else 0)
            seen.add(parent)
        return total

    for p, mine in got.groupby("p"):
        wanted = [r[:2] for r in rows if r[0] == p and r[5]]
        assert len(mine) == mine.i.nunique() == len(wanted)
        off = abs(length((p, i) for i in mine.i) - length(wanted)) / length(wanted)
        assert off == pytest.approx(mine.off.iloc[0]) and (off <= 0.02 or mine.tries.iloc[0] == 8)
    assert (got.off <= 0.02).mean() > 0.9 and (got[got.p < 12].groupby("p").i.apply(set) != items.where("chosen and p < 12").toPandas().groupby("p").i.apply(set)).any()


def test_the_target_moves_when_estimates_are_wrong(spark):
    """Estimates that say nothing of the actual lengths: sets are judged by the latter, at most eight more tries."""
    items = spark.range(80).select(F.lit(1).alias("p"), F.col("id").alias("i"), F.lit(10).alias("n"), (F.pmod(F.col("id") * 37, F.lit(101)) + 1).alias("real"), F.col("id").alias("parent"), F.lit(0).alias("shared"), (F.col("id") < 6).alias("chosen"))
    got = resample.length_matched(items, ["p"], "i", "n", "real", "parent", "shared", "chosen", within=0.0).toPandas()
    assert len(got) == 6 and (got.tries == 8).all() and got.off.iloc[0] < 0.2


def test_choices_come_in_proportion(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 4), ("a", "z", 3), ("a", "none", 0), ("b", "only", 5)], "g string, c string, w int")
    draws = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 10 == 1, "absent").otherwise("a").alias("g"), "id")
    got = resample.weighted_choice(rows, ["g"], "c", "w", draws, F.expr("id div 10")).groupBy("g", "c").count().collect()
    assert {(r.g, r.c): r["count"] for r in got} == {("a", "x"): 80, ("a", "y"): 480, ("a", "z"): 240, ("b", "only"): 100}


def test_bisect(spark):
    from tallygrove.functions.scalars import bisect

    rng = random.Random(1)
    rows = [(sorted(rng.randrange(20) for _ in range(rng.randrange(9))), x) for x in range(-1, 22) for _ in range(4)]
    import bisect as plain

    got = spark.createDataFrame(rows, "s array<int>, x int").select("s", "x", bisect(F.col("s"), F.col("x")).alias("k")).collect()
    assert all(r.k == plain.bisect_right(r.s, r.x) for r in got)


def test_ranking_stays_within_a_person(spark):
    """Another person's items change nothing; items without a shared term have score 0."""
    items = [("p", 1, "the cat sat"), ("p", 2, "a cat and a cat"), ("p", 3, None), ("p", 4, "dogs"), ("q", 1, "cat " * 50), ("q", 2, "the the"), ("r", 1, "cat")]
    asked = spark.createDataFrame([("p", 9, "Cat, the cat?"), ("q", 9, "the"), ("z", 9, "cat")], "p string, q int, t string")
    run = lambda rows: sorted((r.p, r.i, r.score) for r in retrieve.within(asked, spark.createDataFrame(rows, "p string, i int, t string"), "p", "q", "i", "t").collect())
    whole = run(items)
    assert [x for x in whole if x[0] == "p"] == run([x for x in items if x[0] == "p"]) and {x[:2] for x in whole} == {(p, i) for p, i, _ in items if p != "r"}
    score = {x[:2]: x[2] for x in whole}
    assert score["p", 4] == score["p", 3] == 0 and score["p", 1] > score["p", 2] > 0

    def plain(query, docs):
        n, avg = len(docs), max(sum(map(len, docs)) / len(docs), 1)
        idf = lambda t: math.log(1 + (n - sum(t in d for d in docs) + 0.5) / (sum(t in d for d in docs) + 0.5))
        return [sum(idf(t) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query) for d in docs]

    want = plain({"cat", "the"}, [["the", "cat", "sat"], ["a", "cat", "and", "a", "cat"], [], ["dogs"]])
    assert [score["p", i] for i in (1, 2, 3, 4)] == pytest.approx(want)


def test_assembly_fails_rather_than_cuts_or_leaks(spark):
    items = spark.createDataFrame([(1, 0, "name"), (1, 1, "x"), (1, 2, "y"), (2, 0, "n2")], "p int, i int, t string")
    order = retrieve.source_order(spark.createDataFrame([(1, 2), (1, 1)], "p int, i int"), spark.createDataFrame([(1, 0), (1, 2), (2, 0)], "p int, i int"), ["p"], "i")
    assert sorted(map(tuple, order.collect())) == [(1, 0, True, 1), (1, 1, False, 3), (1, 2, True, 2), (2, 0, True, 1)]
    run = lambda most, target: {r.p: r.history for r in retrieve.assemble(order, items, ["p"], "i", "t", "place", most, spark.createDataFrame([(1, target)], "p int, t string")).collect()}
    assert run(100, "z") == {1: "name\ny\nx", 2: "n2"}
    for most, target, said in ((5, "z", "longer"), (100, "y", "target")):
        with pytest.raises(Exception, match=said):
            run(most, target)


def test_predictor_adapter(spark):
    got = resample.predict_batches(spark.range(5), lambda f: f.assign(p=f.id * 2.0), "id long, p double").toPandas()
    assert got.p.tolist() == [0, 2, 4, 6, 8]


def test_torn_tail_is_dropped_and_garbage_raises(spark, tmp_path):
    good, bad = tmp_path / "good", tmp_path / "bad"
    for d, text in ((good, '{"a": 1}\n{"a":'), (bad, '{"a": 1}\n{oops}\n{"a": 2}\n')):
        d.mkdir()
        (d / "x.jsonl").write_text(text)
    assert [r.a for r in jsonl.read_recovered(spark, str(good), "a int").collect()] == [1]
    assert (good / "x.jsonl").read_text().endswith('{"a":')
    with pytest.raises(Exception):  # noqa: B017
        jsonl.read_recovered(spark, str(bad), "a int").collect()


def test_csv_sink(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, None), (2, "b")], "a int, b string"), f"{tmp_path}/out", ["b", "a"])
    text = next((tmp_path / "out").glob("*.csv")).read_text()
    assert text.splitlines() == ["b,a", ",1", "b,2"]


def test_append_and_resume(spark, tmp_path):
    path, work = f"{tmp_path}/log", spark.range(10)
    tables.append_json(work.where("id < 4"), path)
    rest = match.remaining(work, spark.read.schema("id long").json(path), "id")
    tables.append_json(rest, path)
    assert spark.read.schema("id long").json(path).distinct().count() == 10 == spark.read.schema("id long").json(path).count()


def test_reserved_people_are_filtered_before_parsing(spark):
    rows = spark.createDataFrame([("a", '{"x": 1}'), ("t", "{broken")], "pid string, j string")
    seen = spark.createDataFrame([("a",)], "pid string")
    got = rows.join(seen, "pid", "left_semi").select("pid", F.parse_json("j").alias("v"))
    assert got.select(F.to_json("v")).collect()[0][0] == '{"x":1}'


def test_membership_and_values(spark):
    got = tables.membership(spark.createDataFrame([([1, 2], [3], [])], "train array<int>, dev array<int>, test array<int>"))
    assert sorted(map(tuple, got.collect())) == [("dev", "3"), ("train", "1"), ("train", "2")]
    parse = lambda t, n, e=True: one(spark, scalars.values_list(F.lit(t), n, F.lit(e)))
    assert parse("1, 2.5", 2) == [1.0, 2.5] and parse("1,2", 3) is None and parse("1,x", 2) is None and parse("1,2", 2, False) is None


def test_decisions(spark):
    assert one(spark, calibrate.decision(F.lit(0.1), F.lit(0.2), "up", "down", "open")) == "up"
    assert one(spark, calibrate.decision(F.lit(-0.1), F.lit(0.2), "up", "down", "open")) == "open"
    assert one(spark, calibrate.accepted(F.lit(0.03), F.lit(-0.01))) is True
    with pytest.raises(Exception, match="finite"):
        one(spark, calibrate.loss(F.lit(float("nan")), True))


def test_filters_and_columns_reach_the_scan(spark):
    df = tables.table(spark, "/root/testdata/sf0.001", "lineitem").where("l_quantity > 40").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_paired_rows_need_the_same_keys(spark):
    from tallygrove.operators import summary

    left = spark.createDataFrame([(1, "a", "g", 0.5), (2, "b", "g", None)], "k long, person string, grp string, v double")
    right = spark.createDataFrame([(1, 0.25), (2, None)], "k long, v double")
    assert {r.k: r.delta for r in summary.paired(left, right, "k", "v").collect()} == {1: 0.25, 2: None}
    for wrong in ([(1, 0.25)], [(1, 0.25), (2, None), (3, 1.0)], [(1, 0.25), (2, 0.5)], [(1, 0.25), (1, 0.25), (2, None)]):
        with pytest.raises(Exception, match="both sides need|lacks a value"):
            summary.paired(left, spark.createDataFrame(wrong, "k long, v double"), "k", "v").collect()


def test_two_best_cells_share_places_by_shown_score(spark):
    from pyspark.sql import functions as F

    from tallygrove.operators import rank

    cells = spark.createDataFrame([("a", 0.12341, 3.0), ("b", 0.12344, 1.0), ("c", 0.1, None), ("d", 0.9, 0.5)], "name string, up double, down double")
    got = {(r.metric, r.name): (r.place, r.mark) for r in rank.two_best(cells, ["name"], {"up": True, "down": False}, F.col("name") != "d").collect()}
    assert got[("up", "a")] == got[("up", "b")] == (1, "best") and got[("up", "c")] == (2, "second") and got[("up", "d")] == (0, None)
    assert got[("down", "b")] == (1, "best") and got[("down", "a")] == (2, "second") and got[("down", "c")] == got[("down", "d")] == (0, None)


def test_documents_are_walked_as_text_or_parsed(spark):
    text = '[{"BlockName": " one ", "Questions": [{"QuestionID": "a", "Answers": {"n": 1}}, {"QuestionID": "b", "Rows": ["x"]}]}, {"BlockName": "none"}, {"Questions": [{"QuestionID": 7}]}]'
    got = nested.question_records(spark.createDataFrame([(1, text), (2, "[]")], "k int, d string"), ["k"], "d")
    said = [(r.bi, r.qi, r.block_name, r.id, r.n) for r in got.select("*", nested.field("question", "QuestionID").alias("id"), nested.field("question", "Answers.n", "int").alias("n")).collect()]
    assert said == [(0, 0, "one", "a", 1), (0, 1, "one", "b", None), (2, 0, "", "7", None)]
    with pytest.raises(Exception):  # noqa: B017
        nested.question_records(spark.createDataFrame([(1, '{"a":')], "k int, d string"), ["k"], "d").collect()


def test_matrix_rows_and_what_does_not_fit(spark):
    rows = [("s", ["a", "b"], ["x", "y"], ["1", "2"]), ("t", None, ["x", "y"], ["5"]), ("u", ["a"], ["x", "y"], ["1", "2"]), ("v", None, ["x"], ["1", "2"]), ("w", None, [], [])]
    df = spark.createDataFrame(rows, "s string, ids array<string>, r array<string>, a array<string>")
    got = sorted((r.path, r.row, r.answer, r.ambiguous) for r in nested.matrix_rows(df, "s", F.col("ids"), F.col("r"), F.col("a")).collect())
    assert got == [("s/rowa", "x", "1", False), ("s/rowb", "y", "2", False), ("t/row1", "x", "5", False), ("t/row2", "y", "5", False), ("u", None, None, True), ("v", None, None, True), ("w", None, None, True)]


def test_rows_merge_only_if_they_agree(spark):
    rows = [(1, "q/row1", "a", 5), (2, "q/row2", "a", 6), (3, "q/row3", "b", 7), (4, "p", "a", 8), (5, "p", "a", 9), (6, "q/row1", "b", 1)]
    df = spark.createDataFrame([("k", *r) for r in rows], "k string, n int, path string, s string, v int").repartition(3)
    got = nested.merge_rows(df, ["k"], ["n"], "path", ["v"], ["s"], strict=False).orderBy("run").collect()
    assert [(r.parent, r.clash, r.s, r.v) for r in got] == [("q", False, "a", [5, 6]), ("q", True, "b", [7]), ("p", False, "a", [8]), ("p", False, "a", [9]), ("q", False, "b", [1])]
    with pytest.raises(Exception, match="rows disagree: q"):
        nested.merge_rows(df, ["k"], ["n"], "path", ["v"], ["s"]).collect()
    assert nested.merge_rows(df.where("n <> 3"), ["k"], ["n"], "path", ["v"], ["s"]).count() == 4
