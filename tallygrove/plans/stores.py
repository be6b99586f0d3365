"""Sources and sinks as queries: each writes what it derives from the tables to the shared folder, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, match
from ..sources import jsonl, sealed, tables
from ..sources.scratch import shared_path
from ..sources.tables import table
from .registry import h, query

_LOGS = 4


@query(f"""WITH p AS (SELECT event_id, event_type, value, event_id % {_LOGS} AS log FROM events)
SELECT event_id, event_type, value FROM p QUALIFY event_id <> max(event_id) OVER (PARTITION BY log)""")
def jsonl_recover(spark, sf):
    """Logs whose last line was cut in the middle: everything but those lines comes back."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value", F.pmod("event_id", F.lit(_LOGS)).alias("log"))
    last = events.groupBy("log").agg(F.max("event_id").alias("event_id")).withColumn("torn", F.lit(True))
    said = F.to_json(F.struct("event_id", "event_type", "value"))
    rows = events.join(last, ["log", "event_id"], "left").select("log", "event_id", F.when(F.col("torn"), F.substring(said, 1, 15)).otherwise(F.concat(said, F.lit("\n"))).alias("said"))
    path = shared_path(spark, "logs")
    # The blank that ends each written row stands at the beginning of the next line, so a torn line is the last of its file, without a line feed.
    rows.repartition(_LOGS, "log").sortWithinPartitions("log", "event_id").select("log", "said").write.partitionBy("log").option("lineSep", " ").text(path)
    return jsonl.read_recovered(spark, path, "event_id long, event_type string, value double")


@query("SELECT r_regionkey, r_name, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def sink_csv(spark, sf):
    """A table of results to CSV and back: header, given order of fields, null as nothing."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    met = nation.join(region, nation.n_regionkey == region.r_regionkey).withColumn("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")))
    path = shared_path(spark, "csv")
    tables.write_csv(met, path, ["r_regionkey", "r_name", "n_nationkey", "n_name"])
    kinds = dict(met.dtypes)
    return spark.read.option("header", True).schema(", ".join(f"{c} {kinds[c]}" for c in ("r_regionkey", "r_name", "n_nationkey", "n_name"))).csv(path)


_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_SAID = " || '|' || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _COLUMNS)


@query(f"""WITH d AS (SELECT {h("o_orderkey::VARCHAR")} % 16 AS part, sha256({_SAID}) AS d FROM orders),
s AS (SELECT part, count(*) AS n, {', '.join(f"sum(('0x' || substr(d, {1 + 15 * k}, 15))::BIGINT::HUGEINT) AS s{k}" for k in range(4))} FROM d GROUP BY 1)
SELECT part, n, sha256(n || '|' || s0 || '|' || s1 || '|' || s2 || '|' || s3) AS digest FROM s""")
def sealed_manifest(spark, sf):
    """The manifest of a table, verified against that of the same rows written in another order to other files."""
    orders = table(spark, sf, "orders").select(*_COLUMNS)
    path = shared_path(spark, "sealed")
    orders.repartition(7, "o_custkey").sortWithinPartitions(F.desc("o_orderkey")).write.parquet(path)
    again = spark.read.parquet(path)
    return sealed.verified(sealed.manifest(orders, "o_orderkey", _COLUMNS), sealed.manifest(again, "o_orderkey", _COLUMNS), "part")


@query("SELECT doc_id, length(text)::BIGINT AS n, sha256(text) IS NOT NULL AS known FROM documents")
def kept_by_content(spark, sf):
    """Results by content: a first part of the documents is computed and kept, then only the rest."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = shared_path(spark, "kept")
    compute = lambda rows: rows.withColumn("n", F.length("text").cast("long"))
    digest = F.sha2("text", 256)
    sealed.kept_results(docs.where(F.col("doc_id") % 3 == 0), digest, compute, path, "length 1")
    got = sealed.kept_results(docs, digest, compute, path, "length 1")
    return got.select("doc_id", "n", digest.isNotNull().alias("known"))


@query("SELECT event_id, event_type, round(value * 2, 4) AS doubled FROM events")
def append_resume(spark, sf):
    """A run that was stopped after a part of its rows: what was appended counts, the rest is appended, nothing twice."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    path, schema = shared_path(spark, "run"), "event_id long, event_type string, doubled double"
    work = lambda rows: rows.select("event_id", "event_type", F.round(F.col("value") * 2, 4).alias("doubled"))
    tables.append_json(work(events.where(F.pmod("event_id", F.lit(3)) == 1)), path)
    tables.append_json(work(match.remaining(events, jsonl.read_recovered(spark, path, schema), "event_id")), path)
    return jsonl.read_recovered(spark, path, schema)


_HALF = f"{h("'plan|' || c_custkey")} % 2"


@query(f"""WITH s AS (SELECT c_custkey, CASE WHEN {_HALF} = 0 THEN 'train' ELSE 'test' END AS split FROM customer),
m AS (SELECT split, avg(o_totalprice) AS mean, max(o_totalprice) AS most FROM orders JOIN s ON o_custkey = c_custkey GROUP BY 1) SELECT split, 'most' AS metric, round(most, 4) AS score FROM m""")
def planned_metric(spark, sf):
    """A plan and its splits as a JSON document: written whole, read back, and followed: the checkpoint rule, not the selection rule, names the metric."""
    customer = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("pid"))
    half = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("plan|"), F.col("pid"))), 1, 8), 16, 10).cast("long"), F.lit(2))
    path = shared_path(spark, "plan")
    sealed.write_json(spark, {"rules": {"selection": "by mean", "checkpoint": "by largest"}}, f"{path}/plan.json")
    # A document for every thousandth of the ids, so that none holds them all.
    part = F.pmod(F.xxhash64("pid"), F.lit(1000))
    lists = customer.groupBy(part.alias("part")).agg(*(F.collect_list(F.when(half == k, F.col("pid"))).alias(n) for k, n in enumerate(("train", "test")))).drop("part")
    lists.write.json(f"{path}/splits")
    rules = tables.json_document(spark, f"{path}/plan.json").select("rules.*").first().asDict()
    metric = calibrate.metric_of(rules, {"by mean": "mean", "by largest": "most"}, "checkpoint")
    splits = tables.membership(spark.read.schema("train array<string>, test array<string>").json(f"{path}/splits"), ("train", "test"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("pid"), "o_totalprice")
    figures = orders.join(splits, "pid").groupBy("split").agg(F.avg("o_totalprice").alias("mean"), F.max("o_totalprice").alias("most"))
    return figures.select("split", F.lit(metric).alias("metric"), F.round(metric, 4).alias("score"))
