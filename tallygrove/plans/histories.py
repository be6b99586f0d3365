"""Histories of persons as queries: a conversation's last user turn is the question, the turns before it are the person's items.

System turns are the fixed part (a person's attributes); the others are candidates of
retrieval. Nothing of another person enters a ranking.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot, hash_int, hashed_vector, tokens, unit
from ..operators import match, resample, retrieve
from ..sources.tables import table
from .registry import h, query

_TOP, _SIZE = 3, 32

_ITEMS = """turns AS (SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS target FROM conversations),
asked AS (SELECT conv_id, turn, text FROM turns WHERE turn = target), items AS (SELECT conv_id, turn, text, role = 'system' AS fixed FROM turns WHERE turn < target), candidates AS (SELECT conv_id, turn, text FROM items WHERE NOT fixed)"""

_BM25 = f"""{_ITEMS}, words AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM candidates), corpus AS (SELECT conv_id, count(*) AS n, greatest(avg(len(w)), 1) AS avgdl FROM words GROUP BY 1),
terms AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM asked),
tf AS (SELECT conv_id, turn, dl, term, count(*) AS tf FROM (SELECT conv_id, turn, len(w) AS dl, unnest(w) AS term FROM words) WHERE (conv_id, term) IN (SELECT (conv_id, term) FROM terms) GROUP BY ALL),
df AS (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
hits AS (SELECT conv_id, turn, sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score FROM tf JOIN df USING (conv_id, term) JOIN corpus USING (conv_id) GROUP BY 1, 2),
keyword AS (SELECT conv_id, turn, coalesce(score, 0) AS keyword FROM candidates LEFT JOIN hits USING (conv_id, turn))"""


def _parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Questions ``(conv_id, turn, text)`` and items ``(conv_id, turn, text, fixed)``."""
    turns = table(spark, sf, "conversations")
    targets = turns.where("role = 'user'").groupBy("conv_id").agg(F.max("turn").alias("target"))
    met = turns.join(targets, "conv_id")
    items = met.where("turn < target").select("conv_id", "turn", "text", (F.col("role") == "system").alias("fixed"))
    return met.where("turn = target").select("conv_id", "turn", "text"), items


def _keyword(asked: DataFrame, items: DataFrame) -> DataFrame:
    got = retrieve.within(asked.withColumnRenamed("turn", "asked"), items.where("not fixed"), "conv_id", "asked", "turn", "text")
    return got.select("conv_id", "turn", F.col("score").alias("keyword"))


@query(f"WITH {_BM25} SELECT conv_id, turn, round(keyword, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(keyword, 9) DESC, turn) AS rank FROM keyword) WHERE rank <= {_TOP}")
def bm25_by_person(spark, sf):
    got = retrieve.top_k(_keyword(*_parts(spark, sf)), "conv_id", F.col("keyword"), "turn", _TOP)
    return got.select("conv_id", "turn", F.round("keyword", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_VECTOR = f"list_transform(range(0, {_SIZE}), lambda k: len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: {h("'vector|' || t")} % {_SIZE} = k))::DOUBLE)"
_POLICIES = f"""{_BM25}, vectors AS (SELECT conv_id, turn, {_VECTOR} AS v FROM candidates), goals AS (SELECT conv_id, {_VECTOR} AS q FROM asked),
sims AS (SELECT conv_id, turn, CASE WHEN list_dot_product(v, v) > 0 AND list_dot_product(q, q) > 0 THEN list_dot_product(v, q) / sqrt(list_dot_product(v, v)) / sqrt(list_dot_product(q, q)) END AS semantic FROM vectors JOIN goals USING (conv_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(keyword, 9) DESC, turn) AS rk, row_number() OVER (PARTITION BY conv_id ORDER BY round(semantic, 9) DESC NULLS LAST, turn) AS rs FROM keyword JOIN sims USING (conv_id, turn)),
fused AS (SELECT *, CASE WHEN keyword > 0 THEN 1 / (60e0 + rk) ELSE 0 END + CASE WHEN semantic IS NOT NULL THEN 1 / (60e0 + rs) ELSE 0 END AS fused FROM ranked),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(fused, 9) DESC, turn) AS rf FROM fused)"""


def _ranked(asked: DataFrame, items: DataFrame) -> DataFrame:
    """Keyword, semantic and fused scores of all candidates."""
    # In steps, so that neither terms nor counts are made twice.
    vector = lambda df, name: df.withColumn(name, tokens(F.col("text"))).withColumn(name, hashed_vector(F.col(name), _SIZE, "vector")).withColumn(name, unit(F.col(name)))
    pairs = vector(items.where("not fixed"), "v").join(vector(asked, "q").select("conv_id", "q"), "conv_id").select("conv_id", "turn", dot(F.col("v"), F.col("q")).alias("semantic"))
    return retrieve.fused(_keyword(asked, items).join(pairs, ["conv_id", "turn"]), "conv_id", "turn", "keyword", "semantic")


def policies(asked: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """Chosen items of every policy: ``(conv_id, owner, turn)``; the fixed ones come on top, but for ``question_only``.

    Full histories hold every item, those of ``shuffled`` are another person's. ``random`` is as many items of about the same length as ``hybrid`` takes.
    """
    own = lambda df: df.select("conv_id", F.col("conv_id").alias("owner"), "turn")
    scores = _ranked(asked, items)
    best = lambda c: retrieve.top_k(scores, "conv_id", F.col(c), "turn", _TOP)
    donors = match.donors(asked.select("conv_id"), "conv_id", "donor", hash_int("donor", F.col("conv_id")))
    shuffled = donors.join(items.select(F.col("conv_id").alias("donor"), "turn"), "donor").select("conv_id", F.col("donor").alias("owner"), "turn")
    return {
        "full_history": own(items), "shuffled": shuffled, "question_only": own(items).limit(0), "demographics": own(items.where("fixed")), "bm25": own(best("keyword")), "semantic": own(best("semantic")), "hybrid": own(best("fused")),
        "random": own(matched(items, best("fused"))),
    }


def matched(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(conv_id, turn, tries, off)`` of :func:`resample.length_matched` for the items that ``chosen`` has."""
    return resample.length_matched(_lengths(items, chosen), ["conv_id"], "turn", "length", "actual", "parent", "shared", "chosen")


def _lengths(items: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates with their estimated and actual lengths, and the wording that two neighbours share."""
    number = F.size(tokens(F.col("text"))).cast("long")
    met = items.where("not fixed").join(chosen.select("conv_id", "turn", F.lit(True).alias("chosen")), ["conv_id", "turn"], "left")
    return met.select("conv_id", "turn", F.ceil(F.length("text") / 5).alias("length"), number.alias("actual"), F.expr("turn div 2").alias("parent"), F.least(number, F.lit(2)).alias("shared"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


_DONORS = f"SELECT conv_id, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS donor FROM asked WINDOW w AS (ORDER BY {h("'donor|' || conv_id")}, conv_id)"


@query(f"""WITH {_POLICIES}, donors AS ({_DONORS}), picked AS (SELECT 'full_history' AS mode, conv_id, conv_id AS owner, turn FROM items UNION ALL SELECT 'shuffled', d.conv_id, donor, turn FROM donors d JOIN items i ON i.conv_id = donor
UNION ALL SELECT 'bm25', conv_id, conv_id, turn FROM ranked WHERE rk <= {_TOP} UNION ALL SELECT 'semantic', conv_id, conv_id, turn FROM ranked WHERE rs <= {_TOP} UNION ALL SELECT 'hybrid', conv_id, conv_id, turn FROM best WHERE rf <= {_TOP}
UNION ALL SELECT mode, conv_id, conv_id, turn FROM items, (SELECT unnest(['demographics', 'bm25', 'semantic', 'hybrid']) AS mode) WHERE fixed)
SELECT mode, p.conv_id, owner, turn, row_number() OVER (PARTITION BY mode, p.conv_id ORDER BY fixed DESC, turn) AS place FROM picked p JOIN (SELECT conv_id AS owner, turn, fixed FROM items) USING (owner, turn)""")
def policies_by_person(spark, sf):
    """Items of all policies but the seeded one (``matched_control``), fixed ones first, then in source order; ``question_only`` has none."""
    asked, items = _parts(spark, sf)
    fixed = items.where("fixed").select("conv_id", "turn")
    out = []
    for mode, chosen in policies(asked, items).items():
        if mode == "random":
            continue
        marked = chosen.withColumn("mode", F.lit(mode))
        whose = marked.select("mode", "conv_id", "owner").distinct() if mode == "shuffled" else asked.select(F.lit(mode).alias("mode"), "conv_id", F.col("conv_id").alias("owner"))
        with_fixed = whose.join(fixed.withColumnRenamed("conv_id", "owner"), "owner").select("mode", "conv_id", "owner", "turn")
        placed = retrieve.source_order(marked, with_fixed if mode != "question_only" else with_fixed.limit(0), ["mode", "conv_id", "owner"], "turn")
        out.append(placed.select("mode", "conv_id", "owner", "turn", "place"))
    return reduce(lambda a, b: a.unionByName(b), out)


_PACKED = """numbers AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS actual, turn // 2 AS parent FROM candidates),
target AS (SELECT conv_id, count(*) AS count, sum(actual - CASE WHEN k > 1 THEN least(actual, 2) ELSE 0 END)::BIGINT AS target FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, parent ORDER BY turn) AS k FROM numbers JOIN (SELECT conv_id, turn FROM best WHERE rf <= 3) USING (conv_id, turn)) GROUP BY 1)"""


@query(f"WITH {_POLICIES}, {_PACKED} SELECT conv_id, count, target, count AS matched, true AS sound FROM target")
def matched_control(spark, sf):
    """The seeded control holds exactly as many items as retrieval chose, and its length, measured anew from the items, is within 2 % unless all tries were used."""
    asked, items = _parts(spark, sf)
    chosen = retrieve.top_k(_ranked(asked, items), "conv_id", F.col("fused"), "turn", _TOP).select("conv_id", "turn")
    numbers = _lengths(items, chosen)
    control = resample.length_matched(numbers, ["conv_id"], "turn", "length", "actual", "parent", "shared", "chosen")
    size = lambda some, n, length: retrieve.packed_length(numbers.join(some, ["conv_id", "turn"], "left_semi"), "conv_id", "parent", "turn", "actual", "shared").select("conv_id", F.col("items").alias(n), F.col("packed").cast("long").alias(length))
    effort = control.groupBy("conv_id").agg(F.max("tries").alias("tries"))
    met = size(chosen, "count", "target").join(size(control, "matched", "length"), "conv_id", "left").join(effort, "conv_id", "left")
    near = (F.abs(F.col("length") - F.col("target")) <= 0.02 * F.greatest(F.col("target"), F.lit(1))) | (F.col("tries") == 8)
    return met.select("conv_id", "count", "target", "matched", F.coalesce(near, F.lit(False)).alias("sound"))


@query(f"""WITH {_POLICIES}, picked AS (SELECT conv_id, turn, text, fixed FROM items LEFT JOIN (SELECT conv_id, turn, rf FROM best) USING (conv_id, turn) WHERE fixed OR rf <= {_TOP})
SELECT conv_id, count(*) AS items, md5(string_agg(text, chr(10) ORDER BY fixed DESC, turn) || chr(10) || 'QUESTION ' || any_value(question)) AS digest FROM picked JOIN (SELECT conv_id, text AS question FROM asked) USING (conv_id) WHERE text IS DISTINCT FROM question GROUP BY 1""")
def prompt_assembly(spark, sf):
    """Chosen items as one text before the question; items that repeat the question are kept out, and the guard would fail if one came through."""
    asked, items = _parts(spark, sf)
    said = asked.select("conv_id", F.col("text").alias("question"))
    clean = items.join(said, "conv_id").where(~F.col("text").eqNullSafe(F.col("question"))).drop("question")
    chosen = retrieve.top_k(_ranked(asked, items), "conv_id", F.col("fused"), "turn", _TOP).select("conv_id", "turn")
    ordered = retrieve.source_order(chosen, items.where("fixed").select("conv_id", "turn"), ["conv_id"], "turn")
    texts = retrieve.assemble(ordered, clean.select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", "place", 1 << 24, guard=asked.select("conv_id", "text"))
    counts = ordered.join(clean.select("conv_id", "turn"), ["conv_id", "turn"], "left_semi").groupBy("conv_id").agg(F.count("*").alias("items"))
    met = texts.join(said, "conv_id").join(counts, "conv_id")
    return met.select("conv_id", "items", F.md5(F.concat("history", F.lit("\nQUESTION "), F.col("question"))).alias("digest"))
