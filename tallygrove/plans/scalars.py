"""Scans, projections and scalar functions as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars, scoring
from ..operators import nested
from ..sources.tables import table
from .registry import PAIRS, PREDS, h, pairs, preds, query, r6


@query("SELECT event_id, user_id, event_type FROM events")
def scan_project(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type")


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, turn, trim(role) AS role FROM conversations")
def nested_posexplode(spark, sf):
    folded = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim("role").alias("role")))).alias("turns"))
    return nested.unnest(folded, ["conv_id"], "turns", "pos").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 1::BIGINT AS kept FROM events")
def struct_allowlist(spark, sf):
    props = F.from_json("props", "map<string,string>")
    extended = F.map_concat(props, F.create_map(F.lit("answer"), F.col("event_type")))
    kept = table(spark, sf, "events").select("event_id", nested.allow(extended, ["k"]).alias("m"))
    return kept.select("event_id", F.col("m")["k"].alias("k"), F.size("m").cast("long").alias("kept"))


@query("""WITH o AS (SELECT l_orderkey, list(cast(l_quantity AS INTEGER) ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS q, list(l_linestatus ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS s0 FROM lineitem GROUP BY 1),
p AS (SELECT l_orderkey, q, CASE WHEN len(q) % 2 = 1 THEN s0[2:] ELSE s0 END AS s FROM o)
SELECT l_orderkey, len(q) <> len(s) AS ambiguous, CASE WHEN len(q) = len(s) THEN q[i]::VARCHAR END AS "row", CASE WHEN len(q) = len(s) THEN s[i] END AS answer
FROM (SELECT *, unnest(range(1, CASE WHEN len(q) = len(s) THEN len(q) ELSE 1 END + 1)) AS i FROM p)""")
def matrix_row_split(spark, sf):
    key = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*key, "l_linestatus"))).alias("r"))
    rows = rows.select("l_orderkey", F.transform("r", lambda x: x["l_quantity"].cast("int")).alias("q"), F.transform("r", lambda x: x["l_linestatus"]).alias("s"))
    uneven = F.when(F.pmod(F.size("q"), F.lit(2)) == 1, F.slice("s", F.lit(2), F.size("s"))).otherwise(F.col("s"))
    return nested.split_rows(rows.withColumn("s", uneven), ["l_orderkey"], "q", "s")


@query("""WITH a AS (SELECT user_id, event_type, ts, event_id, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT user_id, run::BIGINT AS run, event_type, count(*) AS n FROM b GROUP BY ALL""")
def pack_runs(spark, sf):
    return nested.runs(table(spark, sf, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""SELECT conv_id, turn, count(CASE WHEN role <> 'assistant' THEN 1 END) OVER w AS seen, max(CASE WHEN role <> 'assistant' THEN turn END) OVER w AS last_seen
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def running_context(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.collect_list(F.when(F.col("role") != "assistant", F.col("turn"))).over(w)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.size(seen).cast("long").alias("seen"), F.array_max(seen).alias("last_seen"))


@query("""WITH x AS (SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS code FROM lineitem)
SELECT l_returnflag, chr(64 + code) AS letter, 'A. x' || chr(10) || 'B. y' || chr(10) || 'C. ' || l_returnflag AS options, count(*) AS n FROM x GROUP BY ALL""")
def render_options(spark, sf):
    code = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    counted = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return counted.select("l_returnflag", scalars.letters(code).alias("letter"), scalars.options_text(F.array(F.lit("x"), F.lit("y"), F.col("l_returnflag"))).alias("options"), "n")


@query("""WITH a AS (SELECT l_returnflag, round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean, max(l_quantity) AS most FROM lineitem GROUP BY 1)
SELECT l_returnflag, metric, value FROM (UNPIVOT a ON total, mean, most INTO NAME metric VALUE value)""")
def melt_scores(spark, sf):
    wide = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 4).alias("total"), r6(F.avg("l_quantity")).alias("mean"), F.max("l_quantity").alias("most"))
    return nested.melt(wide, ["l_returnflag"], ["total", "mean", "most"], "metric", "value")


@query("""WITH x AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN 'inf' WHEN 4 THEN '1,' || lpad((event_id % 1000)::VARCHAR, 3, '0') WHEN 5 THEN ' ' || event_id || '.5 ' ELSE '5d' END AS raw FROM events)
SELECT event_id, CASE WHEN regexp_full_match(replace(trim(raw), ',', ''), '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN try_cast(replace(trim(raw), ',', '') AS DOUBLE) END AS value FROM x""")
def number_parse(spark, sf):
    i = F.col("event_id")
    m = F.pmod(i, F.lit(7))
    raw = F.when(m == 0, None).when(m == 1, "").when(m == 2, "abc").when(m == 3, "inf").when(m == 4, F.concat(F.lit("1,"), F.lpad(F.pmod(i, F.lit(1000)).cast("string"), 3, "0"))).when(m == 5, F.concat(F.lit(" "), i.cast("string"), F.lit(".5 "))).otherwise("5d")
    return table(spark, sf, "events").select("event_id", scalars.number(raw).alias("value"))


@query("""WITH x AS (SELECT event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CASE WHEN event_id % 3 = 0 THEN round(value) ELSE value END END AS v FROM events)
SELECT event_type, CASE WHEN v IS NULL THEN 'missing' WHEN v BETWEEN 1 AND 300 AND v = floor(v) THEN 'valid' ELSE 'invalid' END AS state, count(*) AS n FROM x GROUP BY ALL""")
def validate_range(spark, sf):
    v = F.when(F.pmod("event_id", F.lit(17)) != 0, F.when(F.pmod("event_id", F.lit(3)) == 0, F.round("value")).otherwise(F.col("value")))
    state = scalars.state(v.cast("string"), v, F.lit(1), F.lit(300), levels=True)
    return table(spark, sf, "events").groupBy("event_type", state.alias("state")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_retailprice::DOUBLE AS price FROM part")
def regex_price(spark, sf):
    said = F.concat(F.lit("Product priced at: $"), F.col("p_retailprice").cast("decimal(12,4)").cast("string"), F.lit(" only"))
    return table(spark, sf, "part").select("p_partkey", scalars.price(said, strict=True).alias("price"))


@query("""SELECT CASE WHEN p_partkey = 1 THEN 'pinned' WHEN starts_with(p_type, 'S') THEN 's' WHEN starts_with(p_type, 'E') THEN 'e' WHEN starts_with(p_type, 'P') THEN 'p' ELSE 'other' END AS family, count(*) AS n FROM part GROUP BY 1""")
def family_route(spark, sf):
    family = scalars.route(F.col("p_partkey").cast("string"), F.col("p_type"), {"1": "pinned"}, [("S", "s"), ("E", "e"), ("P", "p"), ("", "other")])
    return table(spark, sf, "part").groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@query("""SELECT name, levels, CASE WHEN levels = 2 THEN 'binary' WHEN levels BETWEEN 3 AND 10 THEN 'ordinal' ELSE 'bounded_numeric' END AS kind FROM (
SELECT 'l_linestatus' AS name, count(DISTINCT l_linestatus) AS levels FROM lineitem UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem)""")
def kind_infer(spark, sf):
    names = ["l_linestatus", "l_returnflag", "l_quantity"]
    wide = table(spark, sf, "lineitem").agg(*(F.countDistinct(n).alias(n) for n in names))
    long = wide.unpivot([], names, "name", "levels")
    return long.select("name", "levels", scalars.kind(F.lit("MC"), F.col("levels"), F.col("levels") > 10).alias("kind"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash(spark, sf):
    return table(spark, sf, "documents").groupBy(scalars.content_hash(F.col("text")).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::BIGINT AS tokens FROM documents")
def tokenize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(scalars.tokens(F.col("text"))).cast("long").alias("tokens"))


@query(f"WITH {PAIRS} SELECT event_id, round(agreement, 6) AS agreement FROM pairs")
def agreement(spark, sf):
    got = scoring.agreement(F.lit("bounded_numeric"), F.col("later"), F.col("earlier"), F.col("lo"), F.col("hi"))
    return pairs(spark, sf).select("event_id", r6(got).alias("agreement"))


@query(f"""WITH {PAIRS} SELECT event_id, round(1 - (pow(later - lo, 2) + pow(hi - later, 2)) / (2 * pow(hi - lo, 2)), 6) AS bounded, round((4 - (abs(k - 1) + abs(k - 2) + abs(k - 3) + abs(k - 4) + abs(k - 5)) / 4.0e0 + 1) / 5, 6) AS ordinal
FROM (SELECT *, event_id % 5 + 1 AS k FROM pairs)""")
def uniform_expected(spark, sf):
    k = (F.pmod("event_id", F.lit(5)) + 1).cast("int")
    return pairs(spark, sf).select("event_id", r6(scoring.uniform_bounded(F.col("later"), F.col("lo"), F.col("hi"))).alias("bounded"), r6(scoring.uniform_categorical(k, F.lit(5), True)).alias("ordinal"))


@query(f"WITH {PREDS} SELECT doc_id, round(nll, 6) AS nll, round(brier, 6) AS brier FROM scored")
def nll_brier(spark, sf):
    return preds(spark, sf).select("doc_id", r6(F.col("nll")).alias("nll"), r6(F.col("brier")).alias("brier"))


@query(f"""WITH {PREDS} SELECT grp, count(*) FILTER (p1 >= 0 AND q2 >= 0 AND abs(p1 + q2 - 1) < 1e-6) AS valid, count(*) AS n FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN p2 + 0.5e0 ELSE p2 END AS q2 FROM preds) GROUP BY 1""")
def prob_validate(spark, sf):
    spoilt = F.when(F.pmod("doc_id", F.lit(11)) == 0, F.array(F.get("probs", F.lit(0)), F.get("probs", F.lit(1)) + 0.5)).otherwise(F.col("probs"))
    return preds(spark, sf).groupBy("grp").agg(F.count_if(scoring.is_distribution(spoilt, F.lit(2))).alias("valid"), F.count("*").alias("n"))


@query(f"WITH {PREDS} SELECT doc_id, guess, guess = truth AS right_guess FROM scored")
def argmax_first(spark, sf):
    return preds(spark, sf).select("doc_id", "guess", (F.col("guess") == F.col("truth")).alias("right_guess"))


@query(f"WITH {PREDS} SELECT doc_id, round(sqrt(p1) / (sqrt(p1) + sqrt(p2)), 6) AS p1, round(sqrt(p2) / (sqrt(p1) + sqrt(p2)), 6) AS p2 FROM preds")
def temperature_scale(spark, sf):
    got = preds(spark, sf).select("doc_id", scoring.tempered(F.col("probs"), F.lit(2.0)).alias("t"))
    return got.select("doc_id", r6(F.get("t", F.lit(0))).alias("p1"), r6(F.get("t", F.lit(1))).alias("p2"))


@query(f"""WITH {PAIRS} SELECT event_id, bad AS invalid, CASE WHEN bad THEN 0 ELSE exact0 END AS exact, round(CASE WHEN bad THEN 0 ELSE 1 - abs(later - g) / (hi - lo) END, 6) AS agreement, round(CASE WHEN NOT bad THEN abs(later - g) END, 6) AS absolute_error
FROM (SELECT *, coalesce(g < lo OR g > hi, true) AS bad, CASE WHEN g = later THEN 1.0e0 ELSE 0.0e0 END AS exact0 FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN hi + 1 ELSE earlier END AS g FROM pairs))""")
def score_rows(spark, sf):
    guess = F.when(F.pmod("event_id", F.lit(13)) == 0, F.col("hi") + 1).otherwise(F.col("earlier"))
    kept = pairs(spark, sf).withColumn("g", guess).drop("exact", "agreement")
    got = scoring.scored(F.lit("bounded_numeric"), F.col("later"), F.col("g"), F.col("lo"), F.col("hi"), F.lit(None).cast("int"))
    return kept.withColumns(got).select("event_id", "invalid", "exact", r6(F.col("agreement")).alias("agreement"), r6(F.col("absolute_error")).alias("absolute_error"))


@query("""WITH x AS (SELECT l_returnflag, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN cast(l_quantity AS INTEGER) || ', ' || l_linenumber WHEN 1 THEN cast(l_quantity AS INTEGER) || ',x' ELSE cast(l_quantity AS INTEGER)::VARCHAR END AS t, l_quantity FROM lineitem)
SELECT l_returnflag, count(CASE WHEN l_linenumber % 3 = 0 THEN 1 END) AS parsed, round(sum(CASE WHEN l_linenumber % 3 = 0 THEN cast(l_quantity AS INTEGER) + l_linenumber END), 3)::DOUBLE AS total FROM x GROUP BY 1""")
def parse_values(spark, sf):
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber")
    said = F.when(F.pmod(n, F.lit(3)) == 0, F.concat(q, F.lit(", "), n.cast("string"))).when(F.pmod(n, F.lit(3)) == 1, F.concat(q, F.lit(",x"))).otherwise(q)
    got = table(spark, sf, "lineitem").select("l_returnflag", scalars.values_list(said, 2).alias("v"))
    total = F.get("v", F.lit(0)) + F.get("v", F.lit(1))
    return got.groupBy("l_returnflag").agg(F.count("v").alias("parsed"), F.round(F.sum(total), 3).alias("total"))


@query("""WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS target FROM pages), paths AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages)
SELECT page_id, count(*) AS links, count(*) FILTER (target NOT IN (SELECT path FROM paths)) AS broken FROM links GROUP BY 1""")
def link_check(spark, sf):
    pages = table(spark, sf, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1))).alias("target"))
    paths = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1).alias("target"), F.lit(1).alias("there")).distinct()
    return links.join(paths, "target", "left").groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(F.col("there").isNull()).alias("broken"))
