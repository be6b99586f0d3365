"""The operators as queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

from . import decontam, fim, line_dedup, mixing, pii, quality_classifier, quality_rules, resampling, secrets_crf, sharding, simhash, suffix_dedup, warc
from .common import table


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier.op1_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_histogram_sharding(spark, sf_dir):
    return sharding.op2_sharding(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontam.op3_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_feistel_pseudonyms(spark, sf_dir):
    return pii.op4_pseudonyms(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules.op5_quality_rules(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark, sf_dir):
    return secrets_crf.op6_secrets(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.op7_line_dedup(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark, sf_dir):
    return simhash.op8_simhash(table(spark, sf_dir, "documents"))


def op9_warc_derivatives(spark, sf_dir):
    return warc.op9_warc(table(spark, sf_dir, "pages"))


def op10_entropy_mixing(spark, sf_dir):
    return mixing.op10_mixing(table(spark, sf_dir, "documents"))


def op11_resampling(spark, sf_dir):
    return resampling.op11_resampling(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.op12_suffix_dedup(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    return fim.op13_fill_in_middle(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_histogram_sharding, op3_decontamination, op4_feistel_pseudonyms, op5_quality_rules, op6_secret_scan, op7_line_dedup, op8_simhash_dedup, op9_warc_derivatives, op10_entropy_mixing, op11_resampling, op12_suffix_dedup, op13_fill_in_middle)}

_OP3 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows x ON p.g = x.g AND p.n = x.n),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hits GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN listed l ON w.doc_id = l.doc_id
"""


def _op5() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    rules = " AND ".join(r.sql() for r in quality_rules.RULES)
    return rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM base WHERE len(w) >= 5)
), twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY doc_id),
counted AS (
  SELECT base.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(list_filter(w, lambda x: lower(rtrim(x, '.,')) IN ({stop}))) AS BIGINT) AS n_stop_words
  FROM base LEFT JOIN covered ON base.doc_id = covered.doc_id
), tested AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {rules} AS kept FROM tested
"""


_OP9 = rf"""
WITH refs AS (SELECT {{names}} AS names, {{chars}} AS chars, {{c1}} AS c1), made AS (
  SELECT page_id, url, coalesce(html, '') AS body FROM pages
), blocks AS (
  SELECT *, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) AS head FROM made
), ids AS (
  SELECT *, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|' || sha256(head || chr(13) || chr(10) || chr(13) || chr(10) || body)) AS h FROM blocks
), named AS (
  SELECT *, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS rid, 'sha256:' || sha256(body) AS payload_digest FROM ids
), texts AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(body, {{COMMENT}}, '', 'g'), {{HIDDEN}}, '', 'g'), {{TITLE}}, '', 'g') AS shown,
    regexp_extract(body, {{TITLE}}, 1) AS raw_title, regexp_extract(body, {{LANGUAGE}}, 1) AS language,
    regexp_extract_all(body, {{LINK_SQL}}, 1) AS raw_links
  FROM named
), plain AS (
  SELECT *, {{unescape_title}} AS title0, {{unescape_shown}} AS text0,
    list_filter(list_transform(list_transform(raw_links, lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')), lambda y: trim(regexp_replace({{unescape_y}}, '[\r\n\t]+', '', 'g'), ' ')), lambda z: z <> '') AS all_links
  FROM (SELECT *, regexp_replace(regexp_replace(shown, {{BREAK}}, chr(10), 'g'), {{TAG}}, '', 'g') AS stripped FROM texts), refs
), done AS (
  SELECT *, list_filter(all_links, lambda x, i: list_position(all_links, x) = i) AS links,
    replace(regexp_replace(regexp_replace(regexp_replace(title0, '{warc.BLANKS}', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g'), chr(10), ' ') AS title,
    regexp_replace(regexp_replace(regexp_replace(text0, '{warc.BLANKS}', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS plain_text FROM plain
), records AS (
  SELECT page_id, url, rid, payload_digest, 'conversion' AS warc_type, 'text/plain; charset=utf-8' AS content_type, plain_text AS block FROM done
  UNION ALL
  SELECT page_id, url, rid, payload_digest, 'metadata', 'application/warc-fields',
    'source-status: ' || replace(head, chr(13) || chr(10), chr(13) || chr(10) || 'source-header: ') || chr(13) || chr(10) || 'source-payload-digest: ' || payload_digest || chr(13) || chr(10) ||
    'title: ' || title || chr(13) || chr(10) || 'language: ' || language || chr(13) || chr(10) || coalesce(list_aggregate(list_transform(links, lambda x: 'outlink: ' || x || chr(13) || chr(10)), 'string_agg', ''), '')
  FROM done
), hashed AS (
  SELECT *, md5(warc_type || '|' || rid || '|' || sha256(block)) AS h FROM records
), final AS (
  SELECT page_id, warc_type, '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '>' AS record_id, rid AS refers_to, url AS target_uri, content_type,
    CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest, payload_digest, block FROM hashed
)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, payload_digest,
  'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: ' || warc_type || chr(13) || chr(10) || 'WARC-Record-ID: ' || record_id || chr(13) || chr(10) || 'WARC-Date: {warc.DATE}' || chr(13) || chr(10) ||
  coalesce('WARC-Target-URI: ' || replace(replace(target_uri, chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10), '') || 'WARC-Refers-To: ' || refers_to || chr(13) || chr(10) || 'WARC-Block-Digest: ' || block_digest || chr(13) || chr(10) ||
  'WARC-Source-Payload-Digest: ' || payload_digest || chr(13) || chr(10) || 'Content-Type: ' || content_type || chr(13) || chr(10) || 'Content-Length: ' || content_length || chr(13) || chr(10) AS headers,
  block FROM final
"""


_OP13 = """
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cuts AS (SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, left(t, least(x, y)) AS prefix, substring(t, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substring(t, greatest(x, y) + 1) AS suffix FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
"""


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _unescape_sql(x: str) -> str:
    code = "CASE WHEN p[3:3] IN ('x', 'X') THEN ('0x' || p[4:length(p) - 1])::BIGINT ELSE p[3:length(p) - 1]::BIGINT END"
    known = f"CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN chr(65533) WHEN {code} BETWEEN 128 AND 159 THEN c1[{code} - 127] ELSE chr(({code})::INT) END"
    read = f"CASE WHEN p[1:1] <> '&' OR p = '&' THEN p WHEN p[2:2] = '#' THEN {known} ELSE coalesce(chars[list_position(names, p)], p) END"
    return f"coalesce(list_aggregate(list_transform(regexp_extract_all({x}, {_quoted(warc.PIECE)}), lambda p: {read}), 'string_agg', ''), '')"


def _op9() -> str:
    said = {"names": f"[{', '.join(map(_quoted, warc.NAMES))}]", "chars": f"[{', '.join(map(_quoted, warc.NAMES.values()))}]", "c1": f"[{', '.join(map(_quoted, warc.C1))}]"}
    said |= {name: _quoted(warc.plain_pattern(getattr(warc, name))) for name in ("COMMENT", "HIDDEN", "TITLE", "LANGUAGE", "LINK_SQL", "BREAK", "TAG")}
    said |= {"unescape_title": _unescape_sql("raw_title"), "unescape_shown": _unescape_sql("stripped"), "unescape_y": _unescape_sql("y")}
    sql = _OP9
    for name, value in said.items():
        sql = sql.replace("{" + name + "}", value)
    return sql


ORACLE_SQL = {
    "op3_decontamination": _OP3,
    "op5_quality_rules": _op5(),
    "op9_warc_derivatives": _op9(),
    "op13_fill_in_middle": _OP13,
}
