"""Keyed matching, order and sets as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_int
from ..operators import contain, match, order, quantile, rank
from ..sources.tables import table
from .registry import h, query, r6

_SPLIT = f"CASE WHEN {h("'split|' || c_custkey")} % 100 < 70 THEN 'train' WHEN {h("'split|' || c_custkey")} % 100 < 85 THEN 'dev' ELSE 'test' END"


def _split():
    x = F.pmod(hash_int("split", F.col("c_custkey")), F.lit(100))
    return F.when(x < 70, "train").when(x < 85, "dev").otherwise("test")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority AS later, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS earlier FROM orders)
SELECT count(*) AS pairs, count(*) FILTER (earlier = later) AS unchanged, count(*) FILTER (earlier <> later) AS changed FROM o WHERE earlier IS NOT NULL""")
def retest_pairs(spark, sf):
    before = F.lag("o_orderpriority").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    both = table(spark, sf, "orders").withColumn("earlier", before).where("earlier is not null")
    same = F.col("earlier") == F.col("o_orderpriority")
    return both.agg(F.count("*").alias("pairs"), F.count_if(same).alias("unchanged"), F.count_if(~same).alias("changed"))


@query(f"SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE {_SPLIT} = 'train')")
def split_semi(spark, sf):
    train = table(spark, sf, "customer").where(_split() == "train").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(train, "o_custkey", "left_semi").select("o_orderkey")


@query("""WITH f AS (SELECT CASE WHEN o_orderkey % 19 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 23 <> 0)
SELECT count(o_orderkey) AS expected, count(*) FILTER (o_orderkey IS NOT NULL AND k IS NULL) AS missing, count(*) FILTER (o_orderkey IS NULL) AS unexpected,
 count(*) FILTER (o_orderkey IS NOT NULL AND k IS NOT NULL AND s = o_orderstatus) AS unchanged, count(*) FILTER (o_orderkey IS NOT NULL AND k IS NOT NULL AND s <> o_orderstatus) AS changed FROM orders FULL JOIN f ON o_orderkey = k""")
def audit_reconcile(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    found = orders.where(F.pmod(k, F.lit(23)) != 0).select(F.when(F.pmod(k, F.lit(19)) == 0, -k - 1).otherwise(k).alias("o_orderkey"), F.when(F.pmod(k, F.lit(7)) == 0, "changed").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return match.reconcile(orders, found, "o_orderkey", "o_orderstatus")


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def leakage_guard(spark, sf):
    docs, items = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    return contain.contained(docs, items, "doc_id", "item_id", "text")


@query(f"SELECT event_id FROM events WHERE {h("'done|' || event_id")} % 2 = 1")
def resume_anti(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return match.remaining(events, events.where(F.pmod(hash_int("done", F.col("event_id")), F.lit(2)) == 0), "event_id")


@query(f"""WITH p AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, coalesce(lead(user_id) OVER w, first_value(user_id) OVER (ORDER BY {h("'donor|' || user_id")}, user_id)) AS donor FROM p WINDOW w AS (ORDER BY {h("'donor|' || user_id")}, user_id)""")
def donor_derangement(spark, sf):
    people = table(spark, sf, "events").select("user_id").distinct()
    return match.donors(people, "user_id", "donor", hash_int("donor", F.col("user_id")))


@query("SELECT doc_id, length(text)::BIGINT AS result FROM documents")
def dedup_fanout(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return match.fan_out(docs, F.sha2("text", 256), F.length("text").cast("long"), "result").select("doc_id", "result")


@query("""WITH c AS (SELECT cast(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), k AS (SELECT day, n * 2e0 AS checkpoint FROM c WHERE day(day) % 5 = 0)
SELECT strftime(c.day, '%Y-%m-%d') AS day, n, checkpoint FROM c LEFT JOIN k ON c.day = k.day""")
def curve_left_join(spark, sf):
    curve = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    sparse = curve.where(F.pmod(F.dayofmonth("day"), F.lit(5)) == 0).select("day", (F.col("n") * 2.0).alias("checkpoint"))
    return curve.join(sparse, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "checkpoint")


@query("""SELECT CASE WHEN o_orderkey >= 1000 THEN 32 WHEN o_orderkey >= 500 THEN 16 ELSE 8 END::BIGINT AS batch, CASE WHEN o_orderkey >= 500 THEN 'wide' ELSE 'thin' END AS mode, count(*) AS n FROM orders GROUP BY 1, 2""")
def asof_phase(spark, sf):
    phases = spark.createDataFrame([(0, 8, "thin"), (500, 16, "wide"), (1000, 32, None)], "start long, batch long, mode string")
    return match.as_of(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", phases, "start", ["batch", "mode"]).groupBy("batch", "mode").agg(F.count("*").alias("n"))


@query("""WITH names AS (SELECT DISTINCT event_type AS name FROM events UNION ALL SELECT 'absent') SELECT name, coalesce(c.n::VARCHAR, 'Pending') AS n FROM names LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c ON name = event_type""")
def expected_fill(spark, sf):
    events = table(spark, sf, "events")
    names = events.select(F.col("event_type").alias("name")).distinct().union(spark.createDataFrame([("absent",)], "name string"))
    counts = events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return match.fill_expected(names, counts, "name", "n", "Pending")


@query("""SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS by_number, row_number() OVER (ORDER BY c_custkey::VARCHAR) AS by_text FROM customer""")
def sorted_examples(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("said"))
    by_number = order.numbered(people, [F.col("c_custkey")], "by_number")
    return order.numbered(by_number, [F.col("said")], "by_text").drop("said")


@query("""WITH s AS (SELECT event_type AS name, round(avg(value), 1) AS loss, min(event_id) AS pos FROM events GROUP BY 1) SELECT name, loss FROM s ORDER BY loss, pos LIMIT 1""")
def select_best(spark, sf):
    runs = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 1).alias("loss"), F.min("event_id").alias("pos"))
    return runs.agg(F.min_by(F.struct("name", "loss"), F.struct("loss", "pos")).alias("b")).select("b.name", "b.loss")


@query(f"""WITH a AS (SELECT c_custkey AS k FROM customer WHERE {_SPLIT} = 'train'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.9) FROM orders))
SELECT (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS only_a, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS only_b, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS either""")
def set_ops(spark, sf):
    a = table(spark, sf, "customer").where(_split() == "train").select(F.col("c_custkey").alias("k"))
    orders = table(spark, sf, "orders")
    cut = quantile.quantiles(orders, None, "o_totalprice", [0.9]).select(F.get("q", F.lit(0)).alias("cut"))
    b = orders.crossJoin(F.broadcast(cut)).where("o_totalprice > cut").select(F.col("o_custkey").alias("k")).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "k", "full")
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return both.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count("*").alias("either"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def first_per_key(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_per_key(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type) AS group_rows, round(sum(value) OVER (PARTITION BY user_id, event_type), 4) AS group_sum FROM events")
def group_total_window(spark, sf):
    w = Window.partitionBy("user_id", "event_type")
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("group_rows"), F.round(F.sum("value").over(w), 4).alias("group_sum"))


@query("""SELECT event_id, round(m, 6) AS m FROM (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING)) WHERE n = 8""")
def moving_mean(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-7, 0)
    got = table(spark, sf, "events").select("event_id", F.avg("value").over(w).alias("m"), F.count("*").over(w).alias("n"))
    return got.where("n = 8").select("event_id", r6(F.col("m")).alias("m"))


@query("""WITH c AS (SELECT l_returnflag, l_linestatus, avg(l_discount) AS discount, avg(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
m AS (SELECT l_returnflag, l_linestatus, 'discount' AS metric, round(discount, 4) AS score, round(discount, 4) AS better FROM c UNION ALL SELECT l_returnflag, l_linestatus, 'tax', round(tax, 4), -round(tax, 4) FROM c),
r AS (SELECT metric, l_returnflag, l_linestatus, dense_rank() OVER (PARTITION BY metric ORDER BY better DESC) AS place FROM m WHERE l_linestatus = 'F')
SELECT m.metric, m.l_returnflag, m.l_linestatus, score, coalesce(place, 0) AS place, CASE place WHEN 1 THEN 'best' WHEN 2 THEN 'second' END AS mark FROM m LEFT JOIN r ON m.metric = r.metric AND m.l_returnflag = r.l_returnflag AND m.l_linestatus = r.l_linestatus""")
def rank_cells(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"))
    return rank.two_best(cells, ["l_returnflag", "l_linestatus"], {"discount": True, "tax": False}, F.col("l_linestatus") == "F")


@query("""WITH a AS (SELECT *, count(*) FILTER (role <> 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations)
SELECT conv_id, turn, section, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id, section ORDER BY turn ROWS UNBOUNDED PRECEDING) AS sub FROM a""")
def section_numbering(spark, sf):
    upto = lambda *by: Window.partitionBy(*by).orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = table(spark, sf, "conversations").withColumn("section", F.count_if(F.col("role") != "assistant").over(upto("conv_id")))
    return got.select("conv_id", "turn", "section", F.count_if(F.col("role") == "assistant").over(upto("conv_id", "section")).alias("sub"))
