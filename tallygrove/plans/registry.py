"""Registered queries, each with the SQL that says the same, and the views that several share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_int
from ..sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column) -> Column:
    return F.round(x, 6)


def h(said: str) -> str:
    """SQL of the 32-bit hash of a text expression."""
    return f"('0x' || substr(md5({said}), 1, 8))::BIGINT"


PAIRS = """lagged AS (SELECT event_id, user_id AS person, event_type AS grp, ts, props, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS earlier, value AS later FROM events),
bounds AS (SELECT event_type AS grp, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1),
pairs AS (SELECT l.*, lo, hi, 1 - abs(later - earlier) / (hi - lo) AS agreement, CASE WHEN earlier = later THEN 1.0e0 ELSE 0.0e0 END AS exact
  FROM lagged l JOIN bounds USING (grp) WHERE earlier IS NOT NULL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive values of a person in a group, with the group's bounds and their agreement."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("person"), F.col("event_type").alias("grp"), "ts", "props", "value")
    before = F.lag("value").over(Window.partitionBy("person", "grp").orderBy("ts", "event_id"))
    lagged = events.withColumns({"earlier": before, "later": F.col("value")}).drop("value").where("earlier is not null")
    bounds = events.groupBy("grp").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    met = lagged.join(bounds, "grp")
    return met.withColumns({"agreement": 1 - F.try_divide(F.abs(F.col("later") - F.col("earlier")), F.col("hi") - F.col("lo")), "exact": F.when(F.col("earlier") == F.col("later"), 1.0).otherwise(0.0)})


CAT = f"""cat AS (SELECT p_brand AS item, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS code, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code3,
  l_extendedprice / l_quantity AS price, l_suppkey AS person, CASE WHEN {h("'cat|' || l_suppkey")} % 10 < 7 THEN 'train' ELSE 'dev' END AS split FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categorical answers per item with a price and a split by person."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("item"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    code3 = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    split = F.when(F.pmod(hash_int("cat", F.col("l_suppkey")), F.lit(10)) < 7, "train").otherwise("dev")
    return lines.select("item", F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("code"), code3.alias("code3"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_suppkey").alias("person"), split.alias("split"))


PREDS = f"""preds AS (SELECT doc_id, source AS person, lang AS grp, truth, CASE WHEN truth = 1 THEN pt ELSE 1 - pt END AS p1, CASE WHEN truth = 2 THEN pt ELSE 1 - pt END AS p2
  FROM (SELECT d.doc_id, source, lang, quality + 1 AS truth, CASE WHEN {h("'7|' || d.doc_id")} % 4 <> 0 THEN 0.95e0 ELSE 0.05e0 END AS pt FROM labels l JOIN documents d ON l.doc_id = d.doc_id)),
scored AS (SELECT *, -ln(greatest(CASE truth WHEN 1 THEN p1 ELSE p2 END, 1e-12)) AS nll, pow(p1 - CASE truth WHEN 1 THEN 1 ELSE 0 END, 2) + pow(p2 - CASE truth WHEN 2 THEN 1 ELSE 0 END, 2) AS brier,
  CASE WHEN p1 >= p2 THEN 1 ELSE 2 END AS guess FROM preds)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way predictions that are surer than they should be, with scores."""
    from ..functions import scoring

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("person"), F.col("lang").alias("grp"))
    met = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") + 1).alias("truth")).join(docs, "doc_id")
    pt = F.when(F.pmod(hash_int("7", F.col("doc_id")), F.lit(4)) != 0, F.lit(0.95)).otherwise(F.lit(0.05))
    probs = F.array(F.when(F.col("truth") == 1, pt).otherwise(1 - pt), F.when(F.col("truth") == 2, pt).otherwise(1 - pt))
    met = met.withColumn("probs", probs)
    return met.withColumns({"nll": scoring.nll(F.col("probs"), F.col("truth")), "brier": scoring.brier(F.col("probs"), F.col("truth")), "guess": scoring.argmax(F.col("probs")).cast("int")})


def macro_sql(source: str, value: str, person: str = "person", group: str = "grp") -> str:
    return f"SELECT avg(m) AS macro, count(*) AS groups FROM (SELECT {group}, avg(m) AS m FROM (SELECT {person}, {group}, avg({value}) AS m FROM {source} WHERE {value} IS NOT NULL GROUP BY 1, 2) GROUP BY 1)"
