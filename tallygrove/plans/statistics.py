"""Aggregates, baselines, windows over groups, resampling, calibration and audits as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.scalars import hash_int, quotient
from ..operators import aggregate, baseline, quantile, resample, summary
from ..sources.tables import table
from .registry import CAT, PAIRS, PREDS, cat, h, macro_sql, pairs, preds, query, r6


@query(f"WITH {PAIRS} SELECT person, grp, round(avg(agreement), 6) AS mean FROM pairs GROUP BY 1, 2")
def person_group_mean(spark, sf):
    return aggregate.person_group_mean(pairs(spark, sf), "person", "grp", "agreement").select("person", "grp", r6(F.col("mean")).alias("mean"))


@query(f"WITH {PAIRS} SELECT round(macro, 6) AS macro, groups FROM ({macro_sql('pairs', 'agreement')})")
def macro_mean(spark, sf):
    return aggregate.macro(pairs(spark, sf), "person", "grp", "agreement").select(r6(F.col("macro")).alias("macro"), "groups")


@query(f"""WITH {PAIRS}, f AS (SELECT *, grp || '/' || (json_extract_string(props, '$.k')::INTEGER % 2) AS family FROM pairs)
SELECT family, round(avg(m), 6) AS mean, count(*) AS persons FROM (SELECT person, family, avg(agreement) AS m FROM f GROUP BY 1, 2) GROUP BY 1""")
def macro_by_family(spark, sf):
    parity = F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(2))
    rows = pairs(spark, sf).withColumn("family", F.concat_ws("/", "grp", parity.cast("string")))
    got = aggregate.group_means(aggregate.person_group_mean(rows, "person", "family", "agreement"), "family")
    return got.select("family", r6(F.col("mean")).alias("mean"), "persons")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def value_counts(spark, sf):
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_partkey) AS first_part FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def reused_keys(spark, sf):
    got = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("l_partkey")).alias("p")).where("n > 1")
    return got.select("l_orderkey", "l_linenumber", "n", F.size("p").cast("long").alias("parts"), F.get("p", F.lit(0)).alias("first_part"))


_QS = ", ".join(f"round(quantile_cont(n_chars, {q}), 6) AS {n}" for n, q in (("min", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("max", 1.0)))


@query(f"SELECT lang, {_QS}, round(avg(CASE WHEN n_chars > 8192 THEN 1e0 ELSE 0e0 END), 6) AS long_share FROM documents GROUP BY 1")
def quantile_summary(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.col("n_chars").cast("double").alias("n"))
    qs = aggregate.quantiles(docs, "lang", "n")
    over = docs.groupBy("lang").agg(r6(F.avg((F.col("n") > 8192).cast("double"))).alias("long_share"))
    return qs.select("lang", *(r6(F.col(c)).alias(c) for c in qs.columns[1:])).join(over, "lang")


@query(f"WITH {CAT}, c AS (SELECT item, code3, count(*) AS n FROM cat WHERE split = 'train' GROUP BY 1, 2) SELECT item, code3 AS mode FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, code3) AS k FROM c) WHERE k = 1")
def baseline_mode(spark, sf):
    return baseline.mode(cat(spark, sf).where("split = 'train'"), "item", "code3")


@query(f"WITH {CAT} SELECT item, round(median(price), 6) AS median FROM cat WHERE split = 'train' GROUP BY 1")
def baseline_median(spark, sf):
    return baseline.median(cat(spark, sf).where("split = 'train'"), "item", "price").select("item", r6(F.col("median")).alias("median"))


_LAPLACE = """counts AS (SELECT i.item, k.code, count(c.item) AS n FROM (SELECT DISTINCT item FROM cat WHERE split = 'train') i CROSS JOIN (SELECT unnest([1, 2, 3]) AS code) k LEFT JOIN (SELECT item, code3 FROM cat WHERE split = 'train') c ON c.item = i.item AND c.code3 = k.code GROUP BY 1, 2)"""


@query(f"WITH {CAT}, {_LAPLACE} SELECT item, code AS code3, round((n + 1) / (sum(n) OVER (PARTITION BY item) + 3), 6) AS p FROM counts")
def laplace_probs(spark, sf):
    return baseline.smoothed(cat(spark, sf).where("split = 'train'"), "item", "code3", 3).select("item", "code3", r6(F.col("p")).alias("p"))


_EDGES = """edges AS (SELECT item, quantile_cont(price, 0.2) AS e1, quantile_cont(price, 0.4) AS e2, quantile_cont(price, 0.6) AS e3, quantile_cont(price, 0.8) AS e4 FROM cat WHERE split = 'train' GROUP BY 1),
binned AS (SELECT c.*, (e1 <= price)::INT + (e2 <= price AND e2 > e1)::INT + (e3 <= price AND e3 > e2)::INT + (e4 <= price AND e4 > e3)::INT AS bin FROM cat c JOIN edges USING (item))"""


@query(f"WITH {CAT}, {_EDGES} SELECT item, bin::BIGINT AS bin, count(*) AS n FROM binned GROUP BY 1, 2")
def price_bins(spark, sf):
    rows = cat(spark, sf)
    edges = baseline.price_edges(rows.where("split = 'train'"), "item", "price")
    return baseline.price_binned(rows, edges, "item", "price").groupBy("item", F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


_PRICE = f"""{_EDGES}, prior AS (SELECT item, (count(*) FILTER (code = 1) + 1e0) / (count(*) + 2) AS p1, (count(*) FILTER (code = 2) + 1e0) / (count(*) + 2) AS p2 FROM cat WHERE split = 'train' GROUP BY 1),
rates AS (SELECT item, bin, (count(*) FILTER (code = 1) + 5 * any_value(p1)) / (count(*) + 5) AS r1, (count(*) FILTER (code = 2) + 5 * any_value(p2)) / (count(*) + 5) AS r2 FROM binned JOIN prior USING (item) WHERE split = 'train' GROUP BY 1, 2)"""


@query(f"WITH {CAT}, {_PRICE} SELECT item, bin::BIGINT AS bin, 1 AS code, round(r1, 6) AS rate FROM rates UNION ALL SELECT item, bin, 2, round(r2, 6) FROM rates")
def price_aware(spark, sf):
    train = cat(spark, sf).where("split = 'train'")
    got = baseline.price_rates(baseline.price_binned(train, baseline.price_edges(train, "item", "price"), "item", "price"), "item", "code", 2)
    return got.select("item", F.col("bin").cast("long").alias("bin"), "code", r6(F.col("rate")).alias("rate"))


@query(f"WITH {CAT}, {_PRICE} SELECT b.bin::BIGINT AS bin, count(*) AS n, round(avg(CASE WHEN code = 1 THEN 1e0 ELSE 0e0 END), 6) AS observed, round(avg(r1), 6) AS predicted FROM binned b JOIN rates r ON b.item = r.item AND b.bin = r.bin WHERE split = 'dev' GROUP BY 1")
def calibration_bins(spark, sf):
    rows = cat(spark, sf)
    binned = baseline.price_binned(rows, baseline.price_edges(rows.where("split = 'train'"), "item", "price"), "item", "price")
    rates = baseline.price_rates(binned.where("split = 'train'"), "item", "code", 2).where("code = 1").select("item", "bin", "rate")
    met = binned.where("split = 'dev'").join(rates, ["item", "bin"])
    return met.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), r6(F.avg((F.col("code") == 1).cast("double"))).alias("observed"), r6(F.avg("rate")).alias("predicted"))


@query(f"WITH {PAIRS} SELECT count(*) AS items, round(avg(r), 6) AS mean_r FROM (SELECT person, corr(earlier, later) AS r FROM pairs GROUP BY 1 HAVING count(*) > 2 AND stddev_pop(earlier) > 0 AND stddev_pop(later) > 0)")
def item_correlation(spark, sf):
    return aggregate.item_correlation(pairs(spark, sf), "person", "earlier", "later").agg(F.count("*").alias("items"), r6(F.avg("r")).alias("mean_r"))


@query("""WITH t AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), l AS (SELECT DISTINCT event_type AS x FROM events),
g AS (SELECT p.x AS a, q.x AS b, (SELECT count(*) FROM t WHERE t.a = p.x AND t.b = q.x) AS n FROM l p CROSS JOIN l q)
SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS share FROM g""")
def transition_matrix(spark, sf):
    events = table(spark, sf, "events")
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    got = aggregate.transitions(events.select(F.col("event_type").alias("a"), after.alias("b")).where("b is not null"), "a", "b", events.select("event_type").distinct())
    return got.select("a", "b", "n", r6(F.col("share")).alias("share"))


@query(f"WITH {PAIRS}, e AS (SELECT grp, CASE WHEN event_id % 13 = 0 THEN NULL ELSE abs(later - earlier) END AS err FROM pairs) SELECT grp, round(avg(err), 6) AS mae, round(median(err), 6) AS median_ae, count(err) AS valid, count(*) AS attempted FROM e GROUP BY 1")
def numeric_errors(spark, sf):
    err = F.when(F.pmod("event_id", F.lit(13)) != 0, F.abs(F.col("later") - F.col("earlier")))
    rows = pairs(spark, sf).withColumn("err", err)
    counts = rows.groupBy("grp").agg(r6(F.avg("err")).alias("mae"), F.count("err").alias("valid"), F.count("*").alias("attempted"))
    return counts.join(quantile.median(rows, "grp", "err"), "grp", "left").select("grp", "mae", r6(F.col("median")).alias("median_ae"), "valid", "attempted")


_METRICS = ("exact", "agreement", "nll", "brier", "invalid")
#: Answers with a ninth invalid and a fifth without probabilities; one group has no negative log-likelihood at all.
_SCORED = f"""{PREDS}, s AS (SELECT person, grp, CASE WHEN doc_id % 9 <> 0 AND guess = truth THEN 1e0 ELSE 0e0 END AS exact, CASE WHEN doc_id % 9 <> 0 THEN 1e0 - abs(guess - truth) ELSE 0e0 END AS agreement,
  CASE WHEN doc_id % 5 <> 0 AND grp <> 'fr' THEN nll END AS nll, CASE WHEN doc_id % 5 <> 0 THEN brier END AS brier, CASE WHEN doc_id % 9 = 0 THEN 1e0 ELSE 0e0 END AS invalid FROM scored),
long AS (""" + " UNION ALL ".join(f"SELECT '{m}' AS metric, person, grp, {m} AS value FROM s WHERE {m} IS NOT NULL" for m in _METRICS) + ")"


def _scored(spark, sf):
    invalid, scored = F.pmod("doc_id", F.lit(9)) == 0, F.pmod("doc_id", F.lit(5)) != 0
    return preds(spark, sf).select("person", "grp", F.when(~invalid & (F.col("guess") == F.col("truth")), 1.0).otherwise(0.0).alias("exact"), F.when(~invalid, 1.0 - F.abs(F.col("guess") - F.col("truth"))).otherwise(0.0).alias("agreement"),
        F.when(scored & (F.col("grp") != "fr"), F.col("nll")).alias("nll"), F.when(scored, F.col("brier")).alias("brier"), F.when(invalid, 1.0).otherwise(0.0).alias("invalid"))


@query(f"WITH {_SCORED} SELECT grp, metric, round(avg(m), 6) AS mean FROM (SELECT person, grp, metric, avg(value) AS m FROM long GROUP BY ALL) GROUP BY 1, 2")
def per_task_scores(spark, sf):
    """Five metrics by task; a task without any value of a metric has no row for it."""
    long = _scored(spark, sf).unpivot(["person", "grp"], list(_METRICS), "metric", "value").where("value is not null")
    means = long.groupBy("person", "grp", "metric").agg(F.avg("value").alias("m"))
    return means.groupBy("grp", "metric").agg(r6(F.avg("m")).alias("mean"))


@query(f"WITH {PREDS} SELECT grp, round(count(*) FILTER (doc_id % 5 <> 0) / count(*)::DOUBLE, 6) AS coverage FROM scored GROUP BY 1")
def prob_coverage(spark, sf):
    return preds(spark, sf).groupBy("grp").agg(r6(F.count_if(F.pmod("doc_id", F.lit(5)) != 0) / F.count("*")).alias("coverage"))


_RETEST = f"""WITH {PAIRS}, b AS (SELECT * FROM pairs WHERE grp <> 'error'), e AS ({macro_sql('b', 'exact')}), a AS ({macro_sql('b', 'agreement')})
SELECT round(e.macro, 6) AS exact, round(a.macro, 6) AS partial, round(1 - e.macro, 6) AS changed, round(1 - a.macro, 6) AS disagreement, (SELECT count(*) FROM pairs WHERE grp = 'error') AS excluded FROM e, a"""


@query(_RETEST)
def retest_compare(spark, sf):
    # One pass: the excluded group's cells are counted beside the others' means.
    cells = pairs(spark, sf).groupBy("person", "grp").agg(F.avg("exact").alias("e"), F.avg("agreement").alias("a"), F.count("*").alias("n")).groupBy("grp").agg(F.avg("e").alias("e"), F.avg("a").alias("a"), F.sum("n").alias("n"))
    own = F.col("grp") != "error"
    means = cells.agg(F.avg(F.when(own, F.col("e"))).alias("e"), F.avg(F.when(own, F.col("a"))).alias("a"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("excluded"))
    return means.select(r6(F.col("e")).alias("exact"), r6(F.col("a")).alias("partial"), r6(1 - F.col("e")).alias("changed"), r6(1 - F.col("a")).alias("disagreement"), "excluded")


@query(f"""WITH {PAIRS}, k AS (SELECT *, CASE WHEN grp IN ('click', 'view') THEN 'binary' ELSE 'ordinal' END AS kind FROM pairs)
SELECT kind, round(avg(m), 6) AS partial, count(*) AS groups FROM (SELECT kind, grp, avg(m) AS m FROM (SELECT kind, person, grp, avg(agreement) AS m FROM k GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def retest_by_kind(spark, sf):
    rows = pairs(spark, sf).withColumn("kind", F.when(F.col("grp").isin("click", "view"), "binary").otherwise("ordinal"))
    means = rows.groupBy("kind", "person", "grp").agg(F.avg("agreement").alias("m")).groupBy("kind", "grp").agg(F.avg("m").alias("m"))
    return means.groupBy("kind").agg(r6(F.avg("m")).alias("partial"), F.count("*").alias("groups"))


@query("""SELECT c_mktsegment, round(avg(m), 6) AS mean, count(*) AS persons FROM (SELECT o_custkey, avg(m) AS m FROM (SELECT o_custkey, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1) JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def subgroup_means(spark, sf):
    cells = aggregate.person_group_mean(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_totalprice")
    people = cells.groupBy("o_custkey").agg(F.avg("mean").alias("m"))
    met = people.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return met.groupBy("c_mktsegment").agg(r6(F.avg("m")).alias("mean"), F.count("*").alias("persons"))


@query("""WITH d AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS draw FROM events), p AS (SELECT * FROM d WHERE draw <= (SELECT count(*) // 3 FROM events))
SELECT count(*) AS draws, count(DISTINCT user_id) AS persons, count(DISTINCT user_id || event_type) AS cells, round(count(*) / (SELECT count(*) FROM events)::DOUBLE, 6) AS ratio FROM p""")
def schedule_coverage(spark, sf):
    """Coverage of the first third of the draws: the cut is found as an exact rank, not by numbering all rows in one task."""
    events = table(spark, sf, "events").select("ts", "event_id", "user_id", "event_type")
    days = events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = events.withColumn("day", F.to_date("ts")).join(F.broadcast(offsets), "day")
    draw = F.col("skip") + F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
    total = events.agg(F.count("*").alias("total"))
    prefix = ranked.withColumn("draw", draw).crossJoin(F.broadcast(total)).where("draw <= total div 3")
    return prefix.agg(F.count("*").alias("draws"), F.countDistinct("user_id").alias("persons"), F.countDistinct("user_id", "event_type").alias("cells"), r6(F.count("*") / F.max("total")).alias("ratio"))


@query("SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) FILTER (value > 100) AS hits FROM events GROUP BY 1")
def timing_rollup(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), r6(F.avg("value")).alias("mean"), F.count_if(F.col("value") > 100).alias("hits"))


@query(f"WITH {PAIRS}, e AS (SELECT abs(later - earlier) / later AS x FROM pairs) SELECT round(avg(x), 6) AS mean, round(max(x), 6) AS most, round(avg(CASE WHEN x <= 0.02 THEN 1e0 ELSE 0e0 END), 6) AS within FROM e")
def length_match_diag(spark, sf):
    """A later value of 0 has an infinite share, or none (NaN) if the earlier one was 0 too; a missing share is not within."""
    x = quotient(F.abs(F.col("later") - F.col("earlier")), F.col("later"))
    return pairs(spark, sf).select(x.alias("x")).agg(r6(F.avg("x")).alias("mean"), r6(F.max("x")).alias("most"), r6(F.avg(F.when(F.col("x") <= 0.02, 1.0).otherwise(0.0))).alias("within"))


_RUNS = f"""runs AS (SELECT event_id, run, CASE WHEN run = 2 AND event_id % 29 = 0 THEN NULL ELSE {h("'run|' || run || '|' || event_id")} % 2 END AS v FROM events, (SELECT unnest([1, 2, 3]) AS run))"""


@query(f"WITH {_RUNS} SELECT event_id, CASE WHEN count(v) = 3 THEN round(avg(v), 6) END AS v FROM runs GROUP BY 1")
def avg_assignments(spark, sf):
    events = table(spark, sf, "events").select("event_id", F.explode(F.array(*(F.lit(k) for k in (1, 2, 3)))).alias("run"))
    v = F.when((F.col("run") != 2) | (F.pmod("event_id", F.lit(29)) != 0), F.pmod(hash_int("run", F.col("run"), F.col("event_id")), F.lit(2)).cast("double"))
    return aggregate.average_runs(events.withColumn("v", v), ["event_id"], "v", 3).select("event_id", r6(F.col("v")).alias("v"))


@query(f"WITH {PAIRS}, m AS (SELECT person, grp, avg(later) - avg(earlier) AS d FROM pairs GROUP BY 1, 2) SELECT grp, round(avg(d), 6) AS mean, count(*) AS persons FROM m GROUP BY 1")
def matrix_diff(spark, sf):
    rows = pairs(spark, sf)
    left, right = (aggregate.person_group_mean(rows, "person", "grp", c) for c in ("later", "earlier"))
    got = aggregate.group_means(aggregate.cell_difference(left, right, "person", "grp"), "grp")
    return got.select("grp", r6(F.col("mean")).alias("mean"), "persons")


@query(f"WITH {PREDS}, e AS (SELECT person, grp, CASE WHEN grp <> 'fr' THEN nll END AS nll FROM scored) SELECT round(macro, 6) AS macro, groups FROM ({macro_sql('e', 'nll')})")
def eligible_macro(spark, sf):
    rows = preds(spark, sf).withColumn("nll", F.when(F.col("grp") != "fr", F.col("nll")))
    return aggregate.macro(rows, "person", "grp", "nll").select(r6(F.col("macro")).alias("macro"), "groups")


@query("SELECT c_mktsegment, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 6) AS share FROM customer GROUP BY 1")
def share_of_total(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counts.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("""WITH f AS (SELECT label, arg_min(embedding, vec_id) AS e0 FROM embeddings GROUP BY 1), x AS (SELECT vec_id, embedding::DOUBLE[] AS a, e0::DOUBLE[] AS b FROM embeddings JOIN f USING (label))
SELECT vec_id, round(list_max(list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - b[i]))), 5) AS most, round(sqrt(list_sum(list_transform(range(1, len(a) + 1), lambda i: pow(a[i] - b[i], 2)))) / sqrt(list_dot_product(b, b)), 5) AS relative, round(list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)), 5) AS cosine FROM x""")
def vector_compare(spark, sf):
    from ..functions.scalars import dot

    vectors = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    first = vectors.groupBy("label").agg(F.min_by("a", "vec_id").alias("b"))
    met = vectors.join(first, "label").withColumn("d", F.zip_with("a", "b", lambda x, y: x - y))
    most = F.array_max(F.transform("d", lambda x: F.abs(x)))
    cosine = dot(F.col("a"), F.col("b")) / F.sqrt(dot(F.col("a"), F.col("a")) * dot(F.col("b"), F.col("b")))
    return met.select("vec_id", F.round(most, 5).alias("most"), F.round(F.sqrt(dot(F.col("d"), F.col("d"))) / F.sqrt(dot(F.col("b"), F.col("b"))), 5).alias("relative"), F.round(cosine, 5).alias("cosine"))


# --- resampling ---------------------------------------------------------------

_DRAWS = f"""people AS (SELECT person, row_number() OVER (ORDER BY person) - 1 AS i FROM (SELECT DISTINCT person FROM means)), n AS (SELECT count(*) AS n FROM people),
picks AS (SELECT draw, {h("'boot|' || draw || '|' || p.i")} % n.n AS i FROM people p, n, (SELECT unnest(range(100)) AS draw)),
weights AS (SELECT draw, person, count(*) AS times FROM picks JOIN people USING (i) GROUP BY 1, 2)"""


_DIFF = f"""WITH {PAIRS}, md AS (SELECT grp, median(later) AS md FROM pairs GROUP BY 1), d AS (SELECT person, grp, agreement - (1 - abs(later - md) / (hi - lo)) AS diff FROM pairs JOIN md USING (grp)),
means AS (SELECT person, grp, avg(diff) AS mean FROM d WHERE diff IS NOT NULL GROUP BY 1, 2), {_DRAWS},
b AS (SELECT draw, avg(m) AS m FROM (SELECT draw, grp, sum(times * mean) / sum(times) AS m FROM means JOIN weights USING (person) GROUP BY 1, 2) GROUP BY 1)
SELECT round(avg(m), 6) AS difference, count(*) AS groups, (SELECT round(quantile_cont(m, 0.025), 6) FROM b) AS lo, (SELECT round(quantile_cont(m, 0.975), 6) FROM b) AS hi FROM (SELECT grp, avg(mean) AS m FROM means GROUP BY 1)"""


@query(_DIFF)
def paired_diff(spark, sf):
    rows = pairs(spark, sf)
    medians = quantile.median(rows, "grp", "later", "md")
    other = 1 - F.try_divide(F.abs(F.col("later") - F.col("md")), F.col("hi") - F.col("lo"))
    right = rows.join(medians, "grp").select("event_id", other.alias("agreement"))
    got = summary.paired_difference(rows.select("event_id", "person", "grp", "agreement"), right, "event_id", "person", "grp", "agreement", 100, "boot")
    return got.select(r6(F.col("difference")).alias("difference"), "groups", r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"))


@query(f"""WITH {_SCORED},
means AS (SELECT metric, person, grp, avg(value) AS mean FROM long GROUP BY ALL), {_DRAWS},
b AS (SELECT draw, metric, avg(m) AS m FROM (SELECT draw, metric, grp, sum(times * mean) / sum(times) AS m FROM means JOIN weights USING (person) GROUP BY ALL) GROUP BY ALL),
ends AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM b GROUP BY 1),
macro AS (SELECT metric, avg(m) AS macro, count(*) AS groups FROM (SELECT metric, grp, avg(mean) AS m FROM means GROUP BY 1, 2) GROUP BY 1),
micro AS (SELECT metric, avg(value) AS micro, count(*) AS responses FROM long GROUP BY 1)
SELECT metric, round(macro, 6) AS macro, round(lo, 6) AS lo, round(hi, 6) AS hi, round(micro, 6) AS micro, responses, groups, (SELECT count(DISTINCT person) FROM s) AS persons FROM macro JOIN micro USING (metric) JOIN ends USING (metric)""")
def run_summary(spark, sf):
    rows = _scored(spark, sf)
    got = summary.summarize(rows, "person", "grp", list(_METRICS), 100, "boot")
    return got.select("metric", *(r6(F.col(c)).alias(c) for c in ("macro", "lo", "hi", "micro")), "responses", "groups", "persons")


@query(f"""WITH {PAIRS}, means AS (SELECT person, grp, avg(agreement) AS mean FROM pairs GROUP BY 1, 2), {_DRAWS},
d AS (SELECT draw, avg(m) AS m FROM (SELECT draw, grp, sum(times * mean) / sum(times) AS m FROM means JOIN weights USING (person) GROUP BY 1, 2) GROUP BY 1)
SELECT round(avg(m), 6) AS center, round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM d""")
def bootstrap_macro(spark, sf):
    means = aggregate.person_group_mean(pairs(spark, sf), "person", "grp", "agreement")
    got = resample.bootstrap_macro(means, "person", "grp", 100, "boot")
    return got.select(*(r6(F.col(c)).alias(c) for c in got.columns))


@query(f"""WITH means AS (SELECT c_custkey AS person, avg(o_totalprice) AS mean FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1), {_DRAWS},
d AS (SELECT draw, sum(times * mean) / sum(times) AS m FROM means JOIN weights USING (person) GROUP BY 1) SELECT round(avg(m), 4) AS center, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM d""")
def bootstrap_mean(spark, sf):
    means = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person")).agg(F.avg("o_totalprice").alias("mean")).withColumn("grp", F.lit("all"))
    got = resample.bootstrap_macro(means, "person", "grp", 100, "boot")
    return got.select(*(F.round(c, 4).alias(c) for c in got.columns))


@query(f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_custkey IN (3, 5) THEN 0 ELSE 1 END, {h("'part|' || c_custkey")}, c_custkey) AS k, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CASE WHEN k <= floor(n * 0.7e0) THEN 'train' WHEN k <= floor(n * 0.85e0) THEN 'dev' ELSE 'test' END AS split FROM r""")
def split_assign(spark, sf):
    return resample.split(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "part", pinned=(3, 5))


@query(f"SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY {h("'cohort|' || c_custkey")}, c_custkey) AS k FROM customer) WHERE k <= 100")
def cohort_sample(spark, sf):
    """A cohort of a hundred: the limit is the operator."""
    return table(spark, sf, "customer").orderBy(hash_int("cohort", F.col("c_custkey")), "c_custkey").limit(100).select("c_custkey")


@query(f"""WITH p AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events), k AS (SELECT count(*) AS k FROM t), r AS (SELECT user_id, round, round // k AS cycle, round % k + 1 AS place FROM p, k, (SELECT unnest(range(12)) AS round)),
d AS (SELECT user_id, cycle, event_type, row_number() OVER (PARTITION BY user_id, cycle ORDER BY {h("'turn|' || user_id || '|' || cycle || '|' || event_type")}, event_type) AS place FROM (SELECT DISTINCT user_id, cycle FROM r), t)
SELECT user_id, round::BIGINT AS round, event_type FROM r JOIN d USING (user_id, cycle, place)""")
def balanced_schedule(spark, sf):
    events = table(spark, sf, "events")
    got = resample.schedule(events.select("user_id").distinct(), events.select("event_type").distinct(), "user_id", "event_type", 12, "turn")
    return got.withColumn("round", F.col("round").cast("long"))


@query(f"""WITH e AS (SELECT user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS question FROM events), p AS (SELECT DISTINCT user_id FROM events), t AS (SELECT DISTINCT event_type FROM events), k AS (SELECT count(*) AS k FROM t),
r AS (SELECT user_id, round, round // k AS cycle, round % k + 1 AS place FROM p, k, (SELECT unnest(range(12)) AS round)),
d AS (SELECT user_id, cycle, event_type, row_number() OVER (PARTITION BY user_id, cycle ORDER BY {h("'turn|' || user_id || '|' || cycle || '|' || event_type")}, event_type) AS place FROM (SELECT DISTINCT user_id, cycle FROM r), t),
s AS (SELECT user_id, round, event_type FROM r JOIN d USING (user_id, cycle, place)),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id, event_type ORDER BY question) AS upto, sum(n) OVER (PARTITION BY user_id, event_type) AS total FROM (SELECT user_id, event_type, question, count(*) AS n FROM e WHERE question IS NOT NULL GROUP BY ALL))
SELECT s.user_id, s.round::BIGINT AS round, s.event_type, question FROM s JOIN c ON s.user_id = c.user_id AND s.event_type = c.event_type AND {h("'question|' || s.user_id || '|' || s.round")} % total >= upto - n AND {h("'question|' || s.user_id || '|' || s.round")} % total < upto""")
def weighted_schedule(spark, sf):
    """The balanced schedule with a question each, drawn in proportion to the person's responses to it."""
    events = table(spark, sf, "events").select("user_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("question"))
    turns = resample.schedule(events.select("user_id").distinct(), events.select("event_type").distinct(), "user_id", "event_type", 12, "turn")
    rows = events.where("question is not null").withColumn("one", F.lit(1))
    got = resample.weighted_choice(rows, ["user_id", "event_type"], "question", "one", turns, hash_int("question", F.col("user_id"), F.col("round")))
    return got.select("user_id", F.col("round").cast("long").alias("round"), "event_type", "question")


_SUBSETS = f"""drawn AS (SELECT source, s, sum(n_chars) AS total, count(*) AS n FROM documents, (SELECT unnest(range(16)) AS s) WHERE {h("'subset|' || s || '|' || doc_id")} % 2 = 0 GROUP BY 1, 2), target AS (SELECT source, sum(n_chars) // 2 AS target FROM documents GROUP BY 1)"""


@query(f"WITH {_SUBSETS} SELECT source, s::BIGINT AS s, total::BIGINT AS total, off::BIGINT AS off, n FROM (SELECT *, abs(total - target) AS off, row_number() OVER (PARTITION BY source ORDER BY abs(total - target), s) AS k FROM drawn JOIN target USING (source)) WHERE k = 1")
def matched_random(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    target = docs.groupBy("source").agg(F.expr("sum(n_chars) div 2").alias("target"))
    return resample.best_subset(docs, "source", "doc_id", "n_chars", target, 16, "subset").withColumn("s", F.col("s").cast("long"))


# --- calibration and audits -----------------------------------------------------


@query(f"""WITH {PREDS}, grid AS (SELECT pow(10, -1 + i / 80.0e0) AS t FROM (SELECT unnest(range(161)) AS i)),
x AS (SELECT person, grp, t, -ln(greatest(pow(CASE truth WHEN 1 THEN p1 ELSE p2 END, 1 / t) / (pow(p1, 1 / t) + pow(p2, 1 / t)), 1e-12)) AS nll FROM preds, grid),
m AS (SELECT t, avg(m) AS macro FROM (SELECT t, grp, avg(m) AS m FROM (SELECT t, person, grp, avg(nll) AS m FROM x GROUP BY ALL) GROUP BY ALL) GROUP BY 1)
SELECT round(arg_min(t, macro), 6) AS temperature, round(min(macro), 6) AS nll FROM m""")
def fit_temperature(spark, sf):
    """The first of 161 temperatures with the least macro loss; cells are summed before the grid is averaged."""
    from ..operators import calibrate

    got = calibrate.fit_temperature(preds(spark, sf), "person", "grp", "probs", "truth")
    return got.select(r6(F.col("t")).alias("temperature"), r6(F.col("nll")).alias("nll"))


@query(f"""WITH {PAIRS}, d AS (SELECT grp, avg(later - earlier) AS m, stddev_samp(later - earlier) / sqrt(count(*)) AS se FROM pairs GROUP BY 1)
SELECT grp, CASE WHEN m - 1.96e0 * se > 0 THEN 'up' WHEN m + 1.96e0 * se < 0 THEN 'down' ELSE 'open' END AS decision FROM d""")
def ci_decision(spark, sf):
    from ..operators import calibrate

    d = F.col("later") - F.col("earlier")
    got = pairs(spark, sf).groupBy("grp").agg(F.avg(d).alias("m"), (F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("se"))
    return got.select("grp", calibrate.decision(F.col("m") - 1.96 * F.col("se"), F.col("m") + 1.96 * F.col("se"), "up", "down", "open").alias("decision"))


@query(f"WITH {PAIRS} SELECT count(*) AS checked, count(*) FILTER (abs(agreement - ((hi - lo) - abs(earlier - later)) / (hi - lo)) > 1e-10) AS differing FROM pairs")
def audit_recompute(spark, sf):
    from ..operators import audit

    rows = pairs(spark, sf)
    again = ((F.col("hi") - F.col("lo")) - F.abs(F.col("earlier") - F.col("later"))) / (F.col("hi") - F.col("lo"))
    return audit.recomputed(rows, F.col("agreement"), again)


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 50 = 0) AS unfinished, round(sum(value) * 2, 4) AS projected FROM events GROUP BY 1")
def audit_by_kind(spark, sf):
    rows = table(spark, sf, "events").withColumn("open", F.pmod("event_id", F.lit(50)) == 0)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("open").alias("unfinished"), F.round(F.sum("value") * 2, 4).alias("projected"))


@query(f"WITH {PAIRS} SELECT count(*) AS checked, count(*) FILTER (NOT (0 <= exact AND exact <= agreement AND agreement <= 1)) AS violations, (SELECT count(*) FROM lineitem) - (SELECT sum(k * n) FROM (SELECT k, count(*) AS n FROM (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) GROUP BY 1))::BIGINT AS unreconciled FROM pairs")
def invariants(spark, sf):
    from ..operators import audit

    lines = table(spark, sf, "lineitem")
    per_size = lines.groupBy("l_orderkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    open_ = lines.agg(F.count("*").alias("all")).crossJoin(per_size.agg(F.sum(F.col("k") * F.col("n")).alias("again"))).select((F.col("all") - F.col("again")).alias("unreconciled"))
    return audit.ordered(pairs(spark, sf), "exact", "agreement").crossJoin(open_)


@query(f"WITH {PREDS} SELECT round(max(greatest(abs(p1 - (p1 + (doc_id % 3) * 1e-3)), abs(p2 - p2))), 6) AS most, count(*) AS n FROM preds")
def replay_diff(spark, sf):
    from ..operators import audit

    rows = preds(spark, sf)
    replay = rows.select("doc_id", F.transform("probs", lambda p, i: F.when(i == 0, p + F.pmod("doc_id", F.lit(3)) * 1e-3).otherwise(p)).alias("again"))
    return audit.replayed(rows.join(replay, "doc_id"), "probs", "again")
