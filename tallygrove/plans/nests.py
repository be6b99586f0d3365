"""Nested documents as queries: customers' orders as blocks, their lines as questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import parent, tokens
from ..operators import nested, retrieve
from ..sources.tables import table
from .registry import query


#: An order of lines without ties; numbers of lines repeat within an order.
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_BY = ", ".join(_ORDER)


def _documents(spark, sf):
    """``(o_custkey, doc)``: a customer's orders by number, each with its lines by number, as the structs of a document."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER))), lambda x: F.struct(F.concat(F.lit("P"), x["l_partkey"].cast("string")).alias("QuestionID"), F.struct(x["l_quantity"].cast("int").alias("Value")).alias("Answers")))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(cells.alias("Questions"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left")
    block = F.struct(F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias("BlockName"), "Questions")
    return orders.select("o_custkey", "o_orderkey", block.alias("block")).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "block"))), lambda x: x["block"]).alias("doc"))


@query(f"""WITH b AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS bi FROM orders),
q AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_BY}) - 1 AS qi FROM lineitem)
SELECT o_custkey, bi, qi, trim(o_orderpriority) AS block_name, 'P' || l_partkey AS qid, l_quantity::INT::BIGINT AS answer FROM b JOIN q ON o_orderkey = l_orderkey""")
def double_unnest(spark, sf):
    """Blocks, then questions, with both places: from JSON texts for every other customer, from parsed documents for the rest."""
    docs = _documents(spark, sf)
    texts = docs.where("o_custkey % 2 = 0").withColumn("doc", F.to_json("doc"))
    found = nested.question_records(texts, ["o_custkey"], "doc").unionByName(nested.question_records(docs.where("o_custkey % 2 <> 0"), ["o_custkey"], "doc"))
    return found.select("o_custkey", F.col("bi").cast("long").alias("bi"), F.col("qi").cast("long").alias("qi"), "block_name", nested.field("question", "QuestionID").alias("qid"), nested.field("question", "Answers.Value", "long").alias("answer"))


@query(f"""WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY {_BY}) AS r, list(l_quantity::INT ORDER BY {_BY}) AS q FROM lineitem GROUP BY 1),
p AS (SELECT *, CASE l_orderkey % 3 WHEN 0 THEN list_transform(r, lambda x: 'r' || x) END AS ids, CASE l_orderkey % 4 WHEN 0 THEN q[1:1] WHEN 1 THEN q[2:] ELSE q END AS a FROM o),
s AS (SELECT *, len(a) <> len(r) AND len(a) <> 1 AS ambiguous FROM p)
SELECT l_orderkey, ambiguous, CASE WHEN ambiguous THEN 'Q' || l_orderkey ELSE 'Q' || l_orderkey || '/row' || coalesce(ids[i], i::VARCHAR) END AS path, CASE WHEN NOT ambiguous THEN r[i]::VARCHAR END AS "row", CASE WHEN NOT ambiguous THEN (CASE WHEN len(a) = 1 THEN a[1] ELSE a[i] END)::VARCHAR END AS answer
FROM (SELECT *, unnest(range(1, CASE WHEN ambiguous THEN 1 ELSE len(r) END + 1)) AS i FROM s)""")
def matrix_rows(spark, sf):
    """Rows with given or default ids; an answer for all rows, one for each, or a number of answers that fits neither."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_ORDER))).alias("x"))
    q = F.transform("x", lambda x: x["l_quantity"].cast("int"))
    m = F.pmod("l_orderkey", F.lit(4))
    answer = F.when(m == 0, F.slice(q, 1, 1)).when(m == 1, F.slice(q, F.lit(2), F.size("x"))).otherwise(q)
    ids = F.when(F.pmod("l_orderkey", F.lit(3)) == 0, F.transform("x", lambda x: F.concat(F.lit("r"), x["l_partkey"].cast("string"))))
    source = rows.select("l_orderkey", F.concat(F.lit("Q"), F.col("l_orderkey").cast("string")).alias("source"), ids.alias("ids"), F.transform("x", lambda x: x["l_partkey"]).alias("parts"), answer.alias("a"))
    got = nested.matrix_rows(source, "source", F.col("ids"), F.col("parts"), F.col("a"))
    return got.select("l_orderkey", "ambiguous", "path", "row", "answer")


@query(f"""WITH i AS (SELECT o_custkey, l_orderkey, {_BY}, l_returnflag, 'Q' || l_orderkey AS parent, l_linenumber % 5 <> 0 AS is_row FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT *, coalesce(lag(parent) OVER w = parent AND lag(is_row) OVER w AND is_row, false) AS follows, lag(l_returnflag) OVER w AS was FROM i WINDOW w AS (PARTITION BY o_custkey ORDER BY l_orderkey, {_BY})),
r AS (SELECT *, follows AND was <> l_returnflag AS clash, sum(CASE WHEN follows AND was = l_returnflag THEN 0 ELSE 1 END) OVER (PARTITION BY o_custkey ORDER BY l_orderkey, {_BY} ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT o_custkey, run::BIGINT AS run, any_value(parent) AS parent, bool_or(clash) AS clash, any_value(l_returnflag) AS l_returnflag, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_orderkey, {_BY}) AS parts FROM r GROUP BY 1, 2""")
def merge_rows(spark, sf):
    """Consecutive rows of an order merged while their return flags agree; a fifth line is no row and stands alone."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    base = F.concat(F.lit("Q"), F.col("l_orderkey").cast("string"))
    path = F.when(F.pmod("l_linenumber", F.lit(5)) != 0, F.concat(base, F.lit("/row"), F.col("l_linenumber").cast("string"))).otherwise(base)
    items = lines.join(orders, "l_orderkey").select("o_custkey", "l_orderkey", *_ORDER, "l_returnflag", path.alias("path"))
    got = nested.merge_rows(items, ["o_custkey"], ["l_orderkey", *_ORDER], "path", ["l_partkey"], ["l_returnflag"], strict=False)
    return got.select("o_custkey", "run", "parent", "clash", "l_returnflag", F.array_join(F.transform("l_partkey", lambda p: p.cast("string")), ",").alias("parts"))


@query("""WITH i AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity::INT AS q, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
t AS (SELECT *, len(regexp_extract_all(lower('q' || l_orderkey || ' ' || o_orderpriority || ' flag ' || l_returnflag), '[a-z0-9]+')) AS shared, len(regexp_extract_all(lower('q' || l_orderkey || ' ' || o_orderpriority || ' flag ' || l_returnflag || ' row ' || l_partkey || ' ' || q), '[a-z0-9]+')) AS whole FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, l_orderkey ORDER BY l_linenumber, l_partkey, q) AS k FROM t)
SELECT o_custkey, count(*) AS items, sum(whole)::BIGINT AS tokens, sum(whole - CASE WHEN k > 1 THEN shared ELSE 0 END)::BIGINT AS packed FROM p GROUP BY 1""")
def packing_metadata(spark, sf):
    """Lengths in tokens of items and of the wording they share with their parent's other rows, and what a person's items take when that is said once."""
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    items = table(spark, sf, "lineitem").join(orders, "l_orderkey")
    path = F.concat(F.lit("q"), F.col("l_orderkey").cast("string"), F.lit("/row"), F.col("l_linenumber").cast("string"))
    common = F.concat_ws(" ", parent(path), "o_orderpriority", F.lit("flag"), "l_returnflag")
    whole = F.concat_ws(" ", common, F.lit("row"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    number = lambda text: F.size(tokens(text)).cast("long")
    place = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    told = items.select("o_custkey", parent(path).alias("parent"), place.alias("place"), number(whole).alias("length"), number(common).alias("shared"))
    sums = told.groupBy("o_custkey").agg(F.sum("length").alias("tokens"))
    packed = retrieve.packed_length(told, "o_custkey", "parent", "place", "length", "shared")
    return packed.join(sums, "o_custkey").select("o_custkey", "items", "tokens", F.col("packed").cast("long").alias("packed"))
