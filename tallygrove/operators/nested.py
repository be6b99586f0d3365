"""Unnesting, splitting and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.scalars import parent


def unnest(df: DataFrame, keys: list[str], array: str, pos: str) -> DataFrame:
    """One row per element with its place; struct fields become columns."""
    return df.select(*keys, F.posexplode(array).alias(pos, "_e")).select(*keys, pos, "_e.*")


def question_records(df: DataFrame, keys: list[str], document: str) -> DataFrame:
    """``(keys, bi, qi, block_name, question)``: blocks, then questions, both with their places; block names trimmed.

    ``document`` is a JSON text, or an array of structs that was parsed before. What a question holds is left open: it is a VARIANT, read
    by path (:func:`field`). A block without questions gives nothing; a text that is no such document is an error.
    """
    text = F.col(document) if df.schema[document].dataType == StringType() else F.to_json(F.col(document))
    blocks = F.from_json(text, "array<struct<BlockName:string,Questions:array<variant>>>", {"mode": "FAILFAST"})
    outer = df.select(*keys, F.posexplode(blocks).alias("bi", "_block"))
    return outer.select(*keys, "bi", F.trim(F.coalesce("_block.BlockName", F.lit(""))).alias("block_name"), F.posexplode("_block.Questions").alias("qi", "question")).select(*keys, "bi", "qi", "block_name", "question")


def field(question: Column | str, path: str, kind: str = "string") -> Column:
    """What a VARIANT has at ``path``, null where it has nothing or another kind."""
    return F.try_variant_get(question, f"$.{path}", kind)


def matrix_rows(df: DataFrame, source: str, ids: Column, rows: Column, answer: Column) -> DataFrame:
    """``df`` with one row per row of a matrix: ``path`` (``source``/row``id``), ``row_id``, ``row``, ``answer``, ``ambiguous``.

    Without ids rows count from 1. An ``answer`` of one element is that of all rows; otherwise elements go with rows. Where the lengths of rows,
    ids and answers disagree nothing is guessed: the record stays whole, with its ``source`` as path.
    """
    number = F.size(rows)
    told = F.when(F.size(answer) == 1, F.array_repeat(F.get(answer, F.lit(0)), number)).otherwise(answer)
    named = default_ids(ids, rows)
    aligned = F.coalesce((F.size(named) == number) & (F.size(told) == number) & (number > 0), F.lit(False))
    text = "string"
    cells = F.transform(named, lambda i, k: F.struct(F.concat(F.col(source), F.lit("/row"), i.cast(text)).alias("path"), i.cast(text).alias("row_id"), F.get(rows, k).cast(text).alias("row"), F.get(told, k).cast(text).alias("answer"), F.lit(False).alias("ambiguous")))
    none = F.lit(None).cast(text)
    whole = F.array(F.struct(F.col(source).alias("path"), none.alias("row_id"), none.alias("row"), none.alias("answer"), F.lit(True).alias("ambiguous")))
    return df.withColumn("_cells", F.when(aligned, cells).otherwise(whole)).select("*", F.explode("_cells").alias("_cell")).drop("_cells").select("*", "_cell.*").drop("_cell")


def merge_rows(df: DataFrame, by: list[str], order: list[str], path: str, lists: list[str], agree: list[str], strict: bool = True) -> DataFrame:
    """Consecutive rows of one parent as one record: ``by``, ``run``, ``parent``, ``clash``, ``agree`` columns, and ``lists`` columns as arrays in order.

    The parent is ``path`` without its last row part; a path without one is a record of its own. The ``agree`` columns must say the same in all rows
    of a run: with ``strict`` the query fails where they do not, otherwise another record begins there and is marked ``clash``.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    is_row = F.col(path) != F.col("_parent")
    follows = F.coalesce(F.lag("_parent").over(w).eqNullSafe(F.col("_parent")) & F.lag("_row").over(w) & F.col("_row"), F.lit(False))
    same = F.lag("_said").over(w).eqNullSafe(F.col("_said"))
    marked = df.withColumn("_parent", parent(F.col(path))).withColumn("_row", is_row).withColumn("_said", F.struct(*agree)).withColumn("_follows", follows).withColumn("_clash", F.col("_follows") & ~same)
    if strict:
        marked = marked.withColumn("_clash", F.when(F.col("_clash"), F.raise_error(F.concat(F.lit("rows disagree: "), F.col("_parent"))).cast("boolean")).otherwise(F.col("_clash")))
    begins = F.when(F.col("_follows") & ~F.col("_clash"), 0).otherwise(1)
    run = F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    packed = marked.withColumn("run", run).groupBy(*by, "run").agg(F.first("_parent").alias("parent"), F.bool_or("_clash").alias("clash"), F.first("_said").alias("_said"), F.array_sort(F.collect_list(F.struct(*order, *(F.col(c).alias(f"_{c}") for c in lists)))).alias("_rows"))
    listed = lambda c: F.transform("_rows", lambda r: r[f"_{c}"]).alias(c)
    return packed.select(*by, F.col("run").cast("long").alias("run"), "parent", "clash", *(F.col("_said")[c].alias(c) for c in agree), *map(listed, lists))


def split_rows(df: DataFrame, keys: list[str], rows: str, answers: str) -> DataFrame:
    """Aligned arrays give a row per element; unequal lengths keep the record whole, tagged ``ambiguous``."""
    aligned = F.size(rows) == F.size(answers)
    one = F.array(F.struct(F.lit(None).cast("string").alias("row"), F.lit(None).cast("string").alias("answer")))
    zipped = F.zip_with(rows, answers, lambda r, a: F.struct(r.cast("string").alias("row"), a.cast("string").alias("answer")))
    return df.select(*keys, (~aligned).alias("ambiguous"), F.explode(F.when(aligned, zipped).otherwise(one)).alias("s")).select(*keys, "ambiguous", "s.*")


def default_ids(ids: Column, rows: Column) -> Column:
    """Row ids, or 1 to n."""
    return F.coalesce(ids, F.transform(F.sequence(F.lit(1), F.size(rows)), lambda i: i.cast("string")))


def runs(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Consecutive equal values: gaps and islands."""
    w = Window.partitionBy(by).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = df.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(by, "run", value).agg(F.count("*").alias("n"))


def allow(map_col: Column, names: list[str]) -> Column:
    """Only the listed keys of a map."""
    return F.map_filter(map_col, lambda k, _: k.isin(*names))


def melt(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)
