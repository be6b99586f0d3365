"""Queries against their SQL on made tables: values that the given ones lack."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallygrove import plans
from tallygrove.functions.scalars import unit
from tallygrove.operators import retrieve


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given frames."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, said = plans.QUERIES[name](spark, str(folder)), con.sql(plans.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(said.columns)
    key = lambda rows: sorted((tuple(str(x) if isinstance(x, float) else x for x in r) for r in rows), key=str)
    return key(tuple(r) for r in got.select(*order).collect()), key(said.select(*order).fetchall())


@pytest.mark.parametrize("values", [[1.0, 0.0, 2.0, 2.0], [0.0, 0.0, 3.0], [5.0, -0.0, 5.0], [4.0, 4.0, None, 4.0, 3.0], [1.0, 1.01, 2.0]])
def test_shares_of_zero(spark, tmp_path, values):
    rows = [(k, 1, "click", v) for k, v in enumerate(values)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_seconds(event_id) AS ts", "'{}' AS props")
    got, want = both(spark, tmp_path, "length_match_diag", events=events)
    assert got == want


@pytest.mark.parametrize("block", [8192, 7])
def test_nearest_are_the_best_of_all_pairs(spark, block):
    """Copies by the dozen, near ties, repeated keys, vectors of other lengths, zeros, nulls and NaN, over several batches and blocks."""
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)]
    rows += [(k, [1.0, 2.0] * 4) for k in range(300, 420)] + [(k, [1.0, 2.0 + 1e-8 * k] * 4) for k in range(420, 440)]
    rows += [(0, rows[1][1]), (50, rows[50][1]), (440, None), (441, [0.0] * 8), (442, [math.nan] * 8), (443, [1.0] * 5), (444, [2.0, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 8), (450, None), (460, [1.0, 1.0, 1.0, 2.0, 1.0]), (470, [math.nan, 1.0] * 4)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>").repartition(3).select("id", unit(F.col("v")).alias("e")).cache()
    queries = vectors.where("id % 10 = 0")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        got, want = (sorted((r.query, r["rank"], r.doc, str(r.score and round(r.score, 12) + 0.0)) for r in retrieve.top_k(x, "query", F.col("score"), "doc", 16).collect()) for x in (retrieve.nearest(vectors, queries, "id", "e", 16, block), retrieve.cosine(vectors, queries, "id", "e")))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want and len(got) > 600


@pytest.fixture
def corpus(spark):
    """Items without a word or without a vector, vectors of no item or document."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choice("a b c d e f g h".split()) for _ in range(n))
    docs = [(k, words(rng.randrange(6)), "en", "s", 1) for k in range(120)]
    items = [(0, "a b"), (50, None), (100, "éé 漢"), (150, "c z"), (200, "zz"), (250, "h")]
    return {"documents": spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "benchmark": spark.createDataFrame(items, "item_id long, text string"), "embeddings": spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)], 1) for k in range(0, 220)], "vec_id long, embedding array<float>, label int")}


def test_fusion_asks_only_items_with_words(spark, tmp_path, corpus):
    got, want = both(spark, tmp_path, "rrf_hybrid", **corpus)
    assert got == want and got


def test_policies_are_made_of_one_scoring(spark, tmp_path, corpus):
    got, want = both(spark, tmp_path, "select_policy", **corpus)
    assert got == want and got
    # A branch of its own for every policy would compare the vectors three times.
    compared = lambda name: plans.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().count("zip_with")
    assert compared("select_policy") == compared("rrf_hybrid") > 0


def test_policies_are_given_for_every_item(spark, tmp_path, corpus):
    """Also for items whose number no fifty divides."""
    more = spark.createDataFrame([(7, "a d"), (13, None), (49, "漢"), (51, "b g h"), (219, "c"), (300, "e")], "item_id long, text string")
    corpus["benchmark"] = corpus["benchmark"].unionByName(more)
    got, want = both(spark, tmp_path, "select_policy", **corpus)
    assert got == want
    rows, items = plans.QUERIES["select_policy"](spark, str(tmp_path)).collect(), {r.item_id for r in corpus["benchmark"].collect()}
    assert {(r.query, r.doc) for r in rows if r.mode == "full_history"} == {(i, d) for i in items for d in range(120)}
    assert all({r.mode for r in rows if r.query == i} == {"full_history", "hybrid", "semantic", "keyword"} for i in (0, 7, 51, 219))


def test_scores_are_summed_where_a_document_lies(spark, tmp_path, corpus):
    """No shuffle of a row for every query that asks for a document's term."""
    for name in ("benchmark", "documents"):
        corpus[name].write.parquet(f"{tmp_path}/{name}.parquet")
    items, docs = (spark.read.parquet(f"{tmp_path}/{name}.parquet") for name in ("benchmark", "documents"))
    scores = retrieve.bm25(items, docs, "item_id", "doc_id", "text")
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(doc#" in plan and "Exchange hashpartitioning(query#" not in plan
