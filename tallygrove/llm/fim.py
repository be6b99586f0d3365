"""Fill-in-middle transformation, in DuckDB inside Arrow batches.

Each slice of an Arrow batch is registered as a table; SQL cuts its texts into code
points (``regexp_extract_all``), takes the three parts (``list_slice``,
``array_to_string``), joins them in their new order and digests them
(``sha256``); the answer returns as Arrow. No row passes through Python. Where a
text is cut, and which form it takes, its id and the seed alone decide, so a
lost task that is run again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh

#: Bytes of text that one SQL statement gets; a longer text goes alone. A code point takes about 100 bytes on the way.
SLICE_BYTES = 1 << 20


def _cut_sql(seed: int, plain_from: int, spm_below: int) -> str:
    """``id, text`` to ``n, form, prefix_chars, middle_chars, output``."""
    word = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::BIGINT"
    return f"""
WITH units AS (SELECT text, regexp_extract_all(text, '(?s).') AS u, sha256('{seed}:' || id) AS h FROM slice),
drawn AS (SELECT *, len(u) AS n, {word(0)} % (len(u) + 1) AS x, {word(1)} % (len(u) + 1) AS y, {word(2)} % 100 AS p, {word(3)} % 100 AS q FROM units),
formed AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR p >= {plain_from} THEN 'plain' WHEN q < {spm_below} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, 1, a), '') END AS prefix, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, a + 1, b), '') END AS middle,
  CASE WHEN form <> 'plain' THEN array_to_string(list_slice(u, b + 1, n), '') END AS suffix FROM formed)
SELECT n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
  CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM parts"""


def _restore_sql(output: str, form: str) -> str:
    """The text again, from the output and its form alone: no text in a form other than plain holds a mark, so each mark is found once."""
    first = f"string_split(substr({output}, 4), CASE {form} WHEN 'psm' THEN '<S>' ELSE '<P>' END)"
    second = f"string_split({first}[2], '<M>')"
    return f"CASE {form} WHEN 'plain' THEN {output} WHEN 'psm' THEN {first}[1] || {second}[2] || {second}[1] ELSE {second}[1] || {second}[2] || {first}[1] END"


def _slices(text: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text, at least a row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto - at
        at = upto


def _through(docs: DataFrame, inputs: list[str], sql: str, added: list[StructField]) -> DataFrame:
    """``docs`` with the columns that ``sql`` over the table ``slice`` gives for each row; ``inputs`` become ``c0, c1, ...`` there."""
    places = [docs.columns.index(c) for c in inputs]
    names = [*docs.columns, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            for at, rows in _slices(batch.column(places[0])):
                part = batch.slice(at, rows)
                con.register("slice", pa.table([part.column(p) for p in places], names=[f"c{k}" for k in range(len(places))]))
                got = con.sql(sql).to_arrow_table()
                con.unregister("slice")
                yield pa.record_batch([*part.columns, *(pa.concat_arrays(c.chunks) for c in got.columns)], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20, digests: bool = False) -> DataFrame:
    """``docs`` with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``, under other names where taken.

    Forms: ``plain`` (the text), ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) and ``spm``
    (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). Empty texts and texts that hold a mark are plain, and
    so are about ``100 - plain_from`` in a hundred. With ``digests``, instead of ``output``: its SHA-256 and that
    of the text that :func:`restore` makes of it. Null texts count as empty, a null id as no digits;
    rows of one id are cut by the same four numbers; every row and all columns stay; an
    empty table gives an empty result. Whole texts are cut; memory grows with the longest one.
    """
    text, ident, out = fresh(docs, "text", "id", "output")
    staged = docs.withColumns({text: F.coalesce(F.col(text_col).cast("string"), F.lit("")), ident: F.coalesce(F.col(id_col).cast("string"), F.lit(""))})
    cut = _cut_sql(seed, plain_from, spm_below).replace("FROM slice", "FROM (SELECT c0 AS text, c1 AS id FROM slice)")
    names = ["n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digests else ["output"])]
    kinds = [LongType(), StringType(), LongType(), LongType(), *([StringType()] * (len(names) - 4))]
    if digests:
        cut = f"SELECT n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({_restore_sql('output', 'form')}) AS restored_sha256 FROM ({cut})"
    taken = {c.lower() for c in docs.columns}
    final = [x if x not in taken else y for x, y in zip(names, fresh(docs, *names), strict=True)]
    return _through(staged, [text, ident], cut, [StructField(x, k) for x, k in zip(final, kinds, strict=True)]).drop(text, ident)


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``rows`` with the text that each output was made from; a null output or form gives null."""
    sql = f"SELECT {_restore_sql('c0', 'c1')} AS restored FROM slice"
    return _through(rows, [output_col, form_col], sql, [StructField(name, StringType())])


def op13_fill_in_middle(docs: DataFrame) -> DataFrame:
    """Contract digest of :func:`transform`, which says what nulls, empty texts, ties and repeated rows do; extra columns are ignored."""
    return transform(docs.select("doc_id", "text"), digests=True).drop("text")
