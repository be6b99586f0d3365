"""Ranking queries: every fiftieth row is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import tokens, unit
from ..operators import retrieve
from ..sources.tables import table
from .registry import query

_BM25 = """docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), corpus AS (SELECT count(*) AS n, greatest(avg(len(w)), 1) AS avgdl FROM docs),
terms AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark WHERE item_id % 50 = 0),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
scores AS (SELECT query, doc_id AS doc, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN terms USING (term), corpus GROUP BY 1, 2)"""


def _asked(spark, sf):
    return table(spark, sf, "benchmark").where(F.pmod("item_id", F.lit(50)) == 0)


def _bm25(spark, sf, items):
    return retrieve.bm25(items, table(spark, sf, "documents"), "item_id", "doc_id", "text")


@query(f"WITH {_BM25} SELECT query, doc, round(score, 6) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS k FROM scores) WHERE k <= 16")
def bm25_topk(spark, sf):
    got = retrieve.top_k(_bm25(spark, sf, _asked(spark, sf)), "query", F.col("score"), "doc", 16)
    return got.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_COSINE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), sims AS (SELECT q.vec_id AS query, d.vec_id AS doc, list_dot_product(q.e, d.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(d.e, d.e)) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)"""


def _vectors(spark, sf):
    """Unit vectors, and those of them that are queries."""
    vectors = table(spark, sf, "embeddings").select("vec_id", unit(F.col("embedding")).alias("e"))
    return vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0)


@query(f"WITH {_COSINE} SELECT query, doc, round(score, 6) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS k FROM sims) WHERE k <= 16")
def cosine_topk(spark, sf):
    got = retrieve.top_k(retrieve.nearest(*_vectors(spark, sf), "vec_id", "e", 16), "query", F.col("score"), "doc", 16)
    return got.select("query", "doc", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_FUSED = f"""{_BM25}, {_COSINE}, near AS (SELECT s.query, s.doc, s.score FROM sims s JOIN documents d ON d.doc_id = s.doc WHERE s.query IN (SELECT query FROM terms)),
met AS (SELECT coalesce(n.query, b.query) AS query, coalesce(n.doc, b.doc) AS doc, coalesce(b.score, 0) AS keyword, n.score AS semantic FROM near n FULL JOIN scores b ON b.query = n.query AND b.doc = n.doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(keyword, 9) DESC, doc) AS rk, row_number() OVER (PARTITION BY query ORDER BY round(semantic, 9) DESC NULLS LAST, doc) AS rs FROM met),
fused AS (SELECT *, CASE WHEN keyword > 0 THEN 1 / (60e0 + rk) ELSE 0 END + CASE WHEN semantic IS NOT NULL THEN 1 / (60e0 + rs) ELSE 0 END AS fused FROM ranked)"""


def _fused(spark, sf, items):
    """Scores and ranks of every document that the words or vector of one of ``items`` reach."""
    vectors, _ = _vectors(spark, sf)
    # Only vectors of items that ask for a word are compared, not those of all queries.
    asked = items.where(F.size(tokens(F.col("text"))) > 0).select(F.col("item_id").alias("vec_id"))
    sims = retrieve.cosine(vectors, vectors.join(asked, "vec_id", "left_semi"), "vec_id", "e")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"))
    met = sims.join(docs, "doc").withColumnRenamed("score", "semantic")
    met = met.join(_bm25(spark, sf, items).withColumnRenamed("score", "keyword"), ["query", "doc"], "full").withColumn("keyword", F.coalesce("keyword", F.lit(0.0)))
    return retrieve.fused(met, "query", "doc", "keyword", "semantic")


@query(f"WITH {_FUSED} SELECT query, doc, round(fused, 9) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, doc) AS k FROM fused) WHERE k <= 16")
def rrf_hybrid(spark, sf):
    got = retrieve.top_k(_fused(spark, sf, _asked(spark, sf)), "query", F.col("fused"), "doc", 16)
    return got.select("query", "doc", F.round("fused", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH d AS (SELECT lang, source, n_chars, least(n_chars, 40) AS shared, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rn FROM documents)
SELECT lang, (sum(n_chars) - sum(CASE WHEN rn > 1 THEN shared ELSE 0 END))::BIGINT AS packed, count(*) AS items FROM d GROUP BY 1""")
def packed_length(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars", F.least("n_chars", F.lit(40)).alias("shared"))
    return retrieve.packed_length(docs, "lang", "source", "doc_id", "n_chars", "shared")


# A policy is given for every item: the full history is no search, and its items are those of the others.
_EVERY = _FUSED.replace(" WHERE item_id % 50 = 0", "").replace("q.vec_id % 50 = 0", "q.vec_id IN (SELECT item_id FROM benchmark)")


@query(f"""WITH {_EVERY}, top AS (SELECT query, doc, 'hybrid' AS mode, row_number() OVER (PARTITION BY query ORDER BY round(fused, 9) DESC, doc) AS k FROM fused
UNION ALL SELECT query, doc, 'semantic', row_number() OVER (PARTITION BY query ORDER BY round(semantic, 9) DESC NULLS LAST, doc) FROM fused UNION ALL SELECT query, doc, 'keyword', row_number() OVER (PARTITION BY query ORDER BY round(keyword, 9) DESC, doc) FROM fused)
SELECT mode, query, doc FROM top WHERE k <= 16 UNION ALL SELECT 'full_history', item_id, doc_id FROM benchmark, documents""")
def select_policy(spark, sf):
    items = table(spark, sf, "benchmark")
    # Ranks by keyword and by vector are there already; one more gives all three policies of one scoring.
    ranks = {"hybrid": "rf", "semantic": "rs", "keyword": "rk"}
    scores = retrieve.top_k(_fused(spark, sf, items), "query", F.col("fused"), "doc", None, "rf")
    modes = F.array(*(F.when(F.col(c) <= 16, F.lit(name)) for name, c in ranks.items()))
    tops = scores.select(F.explode(F.array_compact(modes)).alias("mode"), "query", "doc")
    # The full history is every document, scored or not.
    full = table(spark, sf, "documents").select(F.col("doc_id").alias("doc")).crossJoin(items.select(F.col("item_id").alias("query")))
    return tops.unionByName(full.select(F.lit("full_history").alias("mode"), "query", "doc"))
