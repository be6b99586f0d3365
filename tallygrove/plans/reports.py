"""Decisions, guards, audits and the structure of reports as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import aggregate, audit, baseline, calibrate, markdown, resample, summary
from ..sources.tables import table
from .registry import CAT, PAIRS, PREDS, cat, h, pairs, preds, query, r6
from .statistics import _DRAWS


@query(f"""WITH {PAIRS}, m AS (SELECT person, grp, avg(later) - avg(earlier) AS mean FROM pairs GROUP BY 1, 2), means AS (SELECT * FROM m), {_DRAWS},
b AS (SELECT draw, grp, sum(times * mean) / sum(times) AS m FROM means JOIN weights USING (person) GROUP BY 1, 2)
SELECT grp, round(avg(mean), 6) AS mean, (SELECT round(quantile_cont(m, 0.025), 6) FROM b WHERE b.grp = means.grp) AS lo, (SELECT round(quantile_cont(m, 0.975), 6) FROM b WHERE b.grp = means.grp) AS hi, count(*) AS persons FROM means GROUP BY grp""")
def matrix_interval(spark, sf):
    """Differences of person-by-group means, with an interval for each group from one resampling of persons."""
    rows = pairs(spark, sf)
    left, right = (aggregate.person_group_mean(rows, "person", "grp", c) for c in ("later", "earlier"))
    got = resample.bootstrap_groups(aggregate.cell_difference(left, right, "person", "grp"), "person", "grp", 100, "boot")
    return got.select("grp", *(r6(F.col(c)).alias(c) for c in ("mean", "lo", "hi")), "persons")


@query(f"""WITH {PAIRS}, means AS (SELECT person, grp, avg(agreement) AS mean FROM pairs WHERE grp <> 'error' GROUP BY 1, 2), {_DRAWS},
d AS (SELECT draw, avg(m) AS m FROM (SELECT draw, grp, sum(times * mean) / sum(times) AS m FROM means JOIN weights USING (person) GROUP BY 1, 2) GROUP BY 1), e AS (SELECT avg(m) AS mean, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM d)
SELECT round(mean, 6) AS partial, round(lo, 6) AS lo, round(hi, 6) AS hi, round(1 - mean, 6) AS disagreement, round(1 - hi, 6) AS disagreement_lo, round(1 - lo, 6) AS disagreement_hi FROM e""")
def retest_intervals(spark, sf):
    means = aggregate.person_group_mean(pairs(spark, sf).where("grp <> 'error'"), "person", "grp", "agreement")
    got = resample.bootstrap_macro(means, "person", "grp", 100, "boot")
    mean, low, high = summary.complement(F.col("center"), F.col("lo"), F.col("hi"))
    return got.select(r6(F.col("center")).alias("partial"), r6(F.col("lo")).alias("lo"), r6(F.col("hi")).alias("hi"), r6(mean).alias("disagreement"), r6(low).alias("disagreement_lo"), r6(high).alias("disagreement_hi"))


@query(f"""WITH {PREDS}, t AS (SELECT *, -ln(greatest(sqrt(CASE truth WHEN 1 THEN p1 ELSE p2 END) / (sqrt(p1) + sqrt(p2)), 1e-12)) AS other FROM scored),
means AS (SELECT person, grp, avg(other - nll) AS mean FROM t GROUP BY 1, 2), base AS (SELECT grp, avg(m) AS base FROM (SELECT person, grp, avg(nll) AS m FROM t GROUP BY 1, 2) GROUP BY 1), {_DRAWS},
b AS (SELECT draw, grp, sum(times * mean) / sum(times) AS m FROM means JOIN weights USING (person) GROUP BY 1, 2), i AS (SELECT grp, quantile_cont(m, 0.975) AS hi FROM b GROUP BY 1), p AS (SELECT grp, avg(mean) AS mean FROM means GROUP BY 1)
SELECT grp, round(-mean / base, 6) AS gain, round(hi, 6) AS hi, -mean / base >= 0.02 AND hi < 0 AS accepted FROM p JOIN i USING (grp) JOIN base USING (grp)""")
def acceptance(spark, sf):
    """Whether softer probabilities are accepted, by group: a relative gain of 2 % and a paired interval below nought."""
    rows = preds(spark, sf)
    rows = rows.withColumn("diff", scoring.nll(scoring.tempered(F.col("probs"), F.lit(2.0)), F.col("truth")) - F.col("nll"))
    diffs = resample.bootstrap_groups(aggregate.person_group_mean(rows, "person", "grp", "diff"), "person", "grp", 100, "boot")
    base = aggregate.group_means(aggregate.person_group_mean(rows, "person", "grp", "nll"), "grp").select("grp", F.col("mean").alias("base"))
    gain = -F.col("mean") / F.col("base")
    return diffs.join(base, "grp").select("grp", r6(gain).alias("gain"), r6(F.col("hi")).alias("hi"), calibrate.accepted(gain, F.col("hi")).alias("accepted"))


_OUTCOMES = f"""{PAIRS}, o AS (SELECT event_id % 3 AS stage, grp, CASE WHEN event_id % 3 = 0 AND grp = 'click' AND event_id % 4 <> 1 THEN NULL WHEN event_id % 3 = 1 AND grp = 'view' AND event_id % 40 = 1 THEN NULL ELSE CASE WHEN event_id % 3 = 1 AND grp = 'view' THEN agreement / 2 ELSE agreement END END AS v FROM pairs),
m AS (SELECT stage, grp, count(*) - count(v) AS absent, round(sum(coalesce(v, 0)) / count(*), 9) AS low, round(sum(coalesce(v, 1)) / count(*), 9) AS high FROM o GROUP BY 1, 2),
w AS (SELECT stage, grp AS winner, low AS score FROM (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY low DESC, grp) AS k FROM m WHERE absent = 0) WHERE k = 1)"""


@query(f"WITH {_OUTCOMES} SELECT stage::BIGINT AS stage, winner, round(any_value(score), 6) AS score, count(*) FILTER (absent > 0 AND high >= score) AS challengers, count(*) FILTER (absent > 0 AND high >= score) > 0 AS blocked FROM m JOIN w USING (stage) GROUP BY 1, 2")
def revision_guard(spark, sf):
    """Choice among saved candidates of three stages: one with outcomes missing that could still win, one with some that could not, one complete."""
    rows = pairs(spark, sf)
    stage, e = F.pmod("event_id", F.lit(3)), F.col("event_id")
    halved = F.when((stage == 1) & (F.col("grp") == "view"), F.col("agreement") / 2).otherwise(F.col("agreement"))
    lost = ((stage == 0) & (F.col("grp") == "click") & (F.pmod(e, F.lit(4)) != 1)) | ((stage == 1) & (F.col("grp") == "view") & (F.pmod(e, F.lit(40)) == 1))
    got = calibrate.guarded_best(rows.select(stage.cast("long").alias("stage"), "grp", F.when(~lost, halved).alias("v")), "stage", "grp", "v")
    return got.select("stage", "winner", r6(F.col("score")).alias("score"), "challengers", "blocked")


@query(f"""WITH {CAT}, c AS (SELECT item, code3, count(*) AS n FROM cat WHERE split = 'train' GROUP BY 1, 2), m AS (SELECT item, code3 AS mode FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, code3) AS k FROM c) WHERE k = 1)
SELECT item, count(*) AS n, round(avg(CASE WHEN code3 = mode THEN 1e0 ELSE 0e0 END), 6) AS met FROM cat JOIN m USING (item) WHERE split = 'dev' GROUP BY 1""")
def baseline_lookup(spark, sf):
    """Held-out answers against the trained mode of their item; an item without training support would fail."""
    rows = cat(spark, sf)
    mode = baseline.mode(rows.where("split = 'train'"), "item", "code3")
    met = baseline.looked_up(rows.where("split = 'dev'"), mode, ["item"], "mode")
    return met.groupBy("item").agg(F.count("*").alias("n"), r6(F.avg((F.col("code3") == F.col("mode")).cast("double"))).alias("met"))


_AUDIT = f"""{PAIRS}, member AS (SELECT DISTINCT user_id AS person, CASE WHEN {h("'audit|' || user_id")} % 10 < 6 THEN 'train' WHEN {h("'audit|' || user_id")} % 10 < 8 THEN 'dev' ELSE 'test' END AS split FROM events),
e AS (SELECT p.person, grp, event_id, CASE WHEN event_id % 37 <> 0 THEN earlier > 40 END AS early, CASE WHEN event_id % 31 <> 0 THEN later > 40 END AS late, props AS stimulus FROM pairs p JOIN member m ON p.person = m.person WHERE split <> 'test'),
f AS (SELECT p.person, grp, CASE WHEN event_id % 19 = 0 THEN -event_id - 1 ELSE event_id END AS event_id, CASE WHEN event_id % 17 <> 0 AND event_id % 13 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN later > 40 ELSE earlier > 40 END END AS value, event_id % 13 = 0 AS invalid, CASE WHEN event_id % 11 = 0 THEN 'changed' ELSE props END AS seen
  FROM pairs p JOIN member m ON p.person = m.person WHERE split <> 'test' AND event_id % 23 <> 0 AND p.person % 7 <> 3),
b AS (SELECT e.event_id IS NOT NULL AS asked, f.event_id IS NOT NULL AS there, early, late, value, invalid, seen = stimulus AS alike FROM e FULL JOIN f ON e.person = f.person AND e.grp = f.grp AND e.event_id = f.event_id),
x AS (SELECT *, asked AND there AS held, asked AND there AND value IS NOT NULL AND late IS NOT NULL AND alike AS fair FROM b)"""
_COUNTS = {"expected_responses": "asked", "missing_responses": "asked AND NOT there", "present_responses": "held", "invalid_responses": "held AND invalid", "missing_or_invalid_values": "held AND value IS NULL", "reference_missing_values": "asked AND (early IS NULL OR late IS NULL)", "changed_responses": "asked AND early <> late", "unchanged_responses": "asked AND early = late", "stimulus_mismatches": "held AND NOT alike", "comparable_responses": "fair", "matches": "fair AND value = late", "disagreements": "fair AND value <> late",
    "changed_comparisons": "fair AND early <> late", "changed_matches": "fair AND early <> late AND value = late", "changed_disagreements": "fair AND early <> late AND value <> late", "unchanged_comparisons": "fair AND early = late", "unchanged_matches": "fair AND early = late AND value = late", "unchanged_disagreements": "fair AND early = late AND value <> late", "unexpected_keys": "NOT asked"}


@query(f"""WITH {_AUDIT} SELECT {', '.join(f"count(*) FILTER ({c}) AS {n}" for n, c in _COUNTS.items())},
(SELECT count(*) FROM member WHERE split <> 'test') AS expected_participants, (SELECT count(*) FROM member WHERE split <> 'test' AND person IN (SELECT person FROM f)) AS participants, (SELECT count(*) FROM member WHERE split <> 'test' AND person NOT IN (SELECT person FROM f)) AS missing_participants, (SELECT count(*) FROM member WHERE split = 'test') AS reserved_excluded FROM x""")
def full_audit(spark, sf):
    """Expected responses against found ones on the composite key (person, group, event), with responses and persons lost, added, spoilt and changed."""
    rows, e = pairs(spark, sf), F.col("event_id")
    no = lambda k: F.pmod(e, F.lit(k)) != 0
    x = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit("audit|"), F.col("user_id").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(10))
    membership = table(spark, sf, "events").select("user_id").distinct().select(F.col("user_id").alias("person"), F.when(x < 6, "train").when(x < 8, "dev").otherwise("test").alias("split"))
    high = lambda c: F.col(c) > 40
    expected = rows.select("person", "grp", "event_id", F.when(no(37), high("earlier")).alias("early"), F.when(no(31), high("later")).alias("late"), F.col("props").alias("stimulus"))
    kept = rows.where(no(23) & (F.pmod("person", F.lit(7)) != 3))
    value = F.when(no(17) & no(13), F.when(~no(2), high("later")).otherwise(high("earlier")))
    found = kept.select("person", "grp", F.when(no(19), e).otherwise(-e - 1).alias("event_id"), value.alias("value"), (~no(13)).alias("invalid"), F.when(no(11), F.col("props")).otherwise("changed").alias("stimulus"))
    return audit.responses(expected, found, membership, "person", ["grp", "event_id"])


# --- Markdown made of documents ------------------------------------------------

_MARKDOWN = """raw AS (SELECT doc_id, i - 1 AS n, l[i] AS said FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
made AS (SELECT doc_id, n, CASE WHEN (n + doc_id) % 9 = 4 THEN '```' WHEN (n + doc_id) % 3 = 0 THEN repeat('#', (1 + n % 4)::INT) || ' ' || CASE WHEN n % 2 = 0 THEN 'Part' ELSE substr(said, 1, 12) || '!' END WHEN (n + doc_id) % 3 = 1 THEN 'see [x](d' || (doc_id + n % 3 * 1000000) || '#part' || CASE WHEN n % 4 < 2 THEN '' ELSE '-1' END || ') and [y](#part) or ![z](https://a/b)' ELSE said END AS line FROM raw),
fenced AS (SELECT *, starts_with(line, '```') OR coalesce(count(*) FILTER (starts_with(line, '```')) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS fenced, count(*) FILTER (starts_with(line, '```')) OVER (PARTITION BY doc_id) % 2 = 1 AS unclosed FROM made),
heads AS (SELECT doc_id, n, length(regexp_extract(line, '^(#{1,4}) (.+)$', 1)) AS level, replace(regexp_replace(lower(regexp_extract(line, '^(#{1,4}) (.+)$', 2)), '[^\\p{L}\\p{N}_ -]', '', 'g'), ' ', '-') AS slug FROM fenced WHERE NOT fenced AND regexp_matches(line, '^(#{1,4}) (.+)$')),
anchors AS (SELECT doc_id, n, level, CASE WHEN k > 1 THEN slug || '-' || (k - 1) ELSE slug END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY n) AS k FROM heads))"""


def _markdown(spark, sf):
    """Documents as Markdown: some of their lines become headings (many alike), fences or links."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("l"))

    def line(said, n):
        place, n = F.pmod(n + F.col("doc_id"), F.lit(9)), n.cast("long")
        title = F.when(n % 2 == 0, "Part").otherwise(F.concat(F.substring(said, 1, 12), F.lit("!")))
        link = F.concat(F.lit("see [x](d"), (F.col("doc_id") + n % 3 * 1000000).cast("string"), F.lit("#part"), F.when(n % 4 < 2, "").otherwise("-1"), F.lit(") and [y](#part) or ![z](https://a/b)"))
        return F.when(place == 4, "```").when(place % 3 == 0, F.concat(F.repeat(F.lit("#"), (n % 4 + 1).cast("int")), F.lit(" "), title)).when(place % 3 == 1, link).otherwise(said)

    return markdown.lines(docs.select("doc_id", F.array_join(F.transform("l", line), "\n").alias("md")), "doc_id", F.col("md"))


@query(f"WITH {_MARKDOWN} SELECT doc_id, n, level, anchor FROM anchors")
def markdown_headings(spark, sf):
    """Headings outside fences with their anchors; repeated slugs are numbered."""
    return markdown.headings(_markdown(spark, sf), "doc_id").select("doc_id", "n", "level", "anchor")


@query(f"""WITH {_MARKDOWN}, found AS (SELECT doc_id, unnest(regexp_extract_all(line, '!?\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS target FROM fenced),
links AS (SELECT doc_id, CASE WHEN starts_with(target, '#') THEN 'd' || doc_id ELSE split_part(target, '#', 1) END AS file, split_part(target, '#', 2) AS fragment FROM found WHERE NOT regexp_matches(target, '^(https?|mailto):')),
names AS (SELECT doc_id AS to_id, 'd' || doc_id AS file FROM (SELECT DISTINCT doc_id FROM made)), there AS (SELECT DISTINCT doc_id AS to_id, anchor AS fragment, 1 AS yes FROM anchors)
SELECT doc_id, CASE WHEN to_id IS NULL THEN 'no file' WHEN yes IS NULL AND fragment <> '' THEN 'no anchor' ELSE 'ok' END AS state, count(*) AS n FROM links LEFT JOIN names USING (file) LEFT JOIN there USING (to_id, fragment) GROUP BY 1, 2""")
def markdown_links(spark, sf):
    """Links to texts and their headings, by whether they lead anywhere."""
    marked = _markdown(spark, sf)
    names = marked.select("doc_id").distinct().withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    got = markdown.checked(markdown.links(marked, "doc_id"), markdown.headings(marked, "doc_id"), names, "doc_id")
    return got.groupBy("doc_id", "state").agg(F.count("*").alias("n"))
