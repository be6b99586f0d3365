"""Rendered values, names and run figures as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rendering
from ..operators import aggregate
from ..sources.tables import table
from .registry import query, r6

_GROUPS = {"click": "touch", "view": "touch", "purchase": "deal", "signup": "deal", "error": "fault"}
_LABELS = {"click": "Click rate", "view": "Views", "purchase": "Purchases", "signup": "Sign-ups", "error": "Errors"}
_PREFIXES = {"sft_": "Tuned", "frozen_": "Frozen"}


@query("""WITH x AS (SELECT l_linenumber % 3 AS kind, CASE l_linenumber % 3 WHEN 0 THEN CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END WHEN 1 THEN l_quantity * 1e11 / 4 ELSE -l_quantity / 1e3 END AS v FROM lineitem)
SELECT kind::BIGINT AS kind, CASE kind WHEN 0 THEN chr(64 + v::INT) ELSE printf('%.12g', v) END AS said, count(*) AS n FROM x GROUP BY ALL""")
def render_answers(spark, sf):
    """Letters of levels; numbers with twelve digits, some large enough for an exponent."""
    kind = F.pmod("l_linenumber", F.lit(3))
    code = F.when(F.col("l_returnflag") == "A", 1.0).when(F.col("l_returnflag") == "N", 2.0).otherwise(3.0)
    value = F.when(kind == 0, code).when(kind == 1, F.col("l_quantity") * 1e11 / 4).otherwise(-F.col("l_quantity") / 1e3)
    said = rendering.answer_text(value, F.when(kind == 0, F.lit(3)))
    return table(spark, sf, "lineitem").groupBy(kind.cast("long").alias("kind"), said.alias("said")).agg(F.count("*").alias("n"))


def _case(what: str, entries: dict[str, str]) -> str:
    return f"CASE {what} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items()) + " END"


@query(f"""WITH n AS (SELECT event_type, CASE event_id % 3 WHEN 0 THEN 'sft_' || event_type WHEN 1 THEN 'frozen_' || event_type ELSE event_type || '_x.' || event_id % 2 END AS name FROM events)
SELECT name, {_case("event_type", _GROUPS)} AS task, CASE WHEN starts_with(name, 'sft_') THEN 'Tuned / ' || {_case("event_type", _LABELS)} WHEN starts_with(name, 'frozen_') THEN 'Frozen / ' || {_case("event_type", _LABELS)} ELSE replace(name, '_', ' ') END AS label, regexp_full_match(name, '[A-Za-z0-9_-]+') AS safe, count(*) AS n FROM n GROUP BY ALL""")
def run_labels(spark, sf):
    """Names of runs with their task group, their label and whether they may name a folder; an unmapped task would fail."""
    i, kind = F.col("event_id"), F.col("event_type")
    name = F.when(i % 3 == 0, F.concat(F.lit("sft_"), kind)).when(i % 3 == 1, F.concat(F.lit("frozen_"), kind)).otherwise(F.concat(kind, F.lit("_x."), (i % 2).cast("string")))
    named = table(spark, sf, "events").groupBy(name.alias("name"), "event_type").agg(F.count("*").alias("n"))
    return named.select("name", rendering.mapped(F.col("event_type"), _GROUPS).alias("task"), rendering.label(F.col("name"), _LABELS, _PREFIXES).alias("label"), rendering.safe_name(F.col("name")).alias("safe"), "n")


@query("""WITH r AS (SELECT event_type, event_id % 3 AS seed, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1, 2) SELECT event_type, round(avg(total), 4) AS total, round(avg(mean), 6) AS mean FROM r GROUP BY 1 HAVING count(*) = 3""")
def seed_timing(spark, sf):
    """Figures of a run as means over its three seeds; a run that lacks a seed fails."""
    runs = table(spark, sf, "events").groupBy("event_type", F.pmod("event_id", F.lit(3)).alias("seed")).agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))
    total, mean = (aggregate.average_runs(runs, ["event_type"], c, 3) for c in ("total", "mean"))
    return total.join(mean, "event_type").select("event_type", F.round("total", 4).alias("total"), r6(F.col("mean")).alias("mean"))


@query("""WITH k AS (SELECT p_brand AS item, count(DISTINCT p_type) AS levels FROM part GROUP BY 1) SELECT item, levels, round(ln(levels), 6) AS uniform_nll FROM k""")
def uniform_loss(spark, sf):
    """The loss of a uniform guess among an item's levels."""
    levels = table(spark, sf, "part").groupBy(F.col("p_brand").alias("item")).agg(F.countDistinct("p_type").alias("levels"))
    return levels.select("item", "levels", r6(F.ln("levels")).alias("uniform_nll"))


_HEAD = r"regexp_replace(substr(text, 1, 24), '[\x00-\x1F\x22\x5C\x7F]', '', 'g')"
_SAID = f"""'{{"head":"' || {_HEAD} || '","lang":"' || lang || '","n":' || n_chars || '}}'"""


@query(rf"""WITH j AS (SELECT doc_id, {_SAID} AS j FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)
SELECT doc_id, sha256(j) AS plain, sha256(coalesce(list_aggregate(list_transform(regexp_extract_all(j, '[\x00-\x7F]+|[^\x00-\x7F]'), lambda p: CASE WHEN unicode(p) < 128 THEN p WHEN unicode(p) < 65536 THEN '\u' || printf('%04x', unicode(p)) ELSE '\u' || printf('%04x', 55296 + (unicode(p) - 65536) // 1024) || '\u' || printf('%04x', 56320 + (unicode(p) - 65536) % 1024) END), 'string_agg', ''), '')) AS escaped FROM j""")
def canonical_digests(spark, sf):
    """Digests of canonical JSON in both encodings, whatever order and blanks the text had."""
    docs = table(spark, sf, "documents").where("text is not null and lang is not null")
    head = F.regexp_replace(F.substring("text", 1, 24), r"[\x00-\x1F\x22\x5C\x7F]", "")
    said = F.concat(F.lit('{ "n": '), F.col("n_chars").cast("string"), F.lit(', "lang" :"'), F.col("lang"), F.lit('", "head": "'), head, F.lit('"}'))
    return docs.select("doc_id", F.sha2(rendering.canonical_json(said), 256).alias("plain"), F.sha2(rendering.canonical_json(said, ascii_only=True), 256).alias("escaped"))
