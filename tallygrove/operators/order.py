"""Numbers and neighbours in one order over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

#: Rows that one task may order.
SLICE_ROWS = 100_000
#: Slices at most, which bounds the sample that the driver holds; beyond, slices grow and are sorted on disk.
MOST_SLICES = 4096


def _cuts(keyed: DataFrame, rows: int, slice_rows: int, per_slice: int = 32) -> list:
    """Keys that part the rows into slices of about ``slice_rows``: weighted quantiles of a sample of keys.

    The sample is chosen by hash of the key and comes with the number of rows of each, about ``per_slice`` keys a
    slice: that is all the driver holds, and a rerun picks the same.
    """
    slices = min(-(-rows // slice_rows), MOST_SLICES)
    part = min(1.0, slices * per_slice / rows)
    picked = keyed.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1)
    sample = picked.groupBy("_key").agg(F.count("*").alias("n")).orderBy("_key").collect()
    total, seen, next_, out = sum(r.n for r in sample), 0, 1, []
    for r in sample:
        if seen * slices >= total * next_:
            out.append(r._key)
            next_ = seen * slices // total + 1
        seen += r.n
    return out


def _dealt(df: DataFrame, order: list[Column], slice_rows: int) -> DataFrame:
    """``df`` with ``_key``, its place in the order as a struct, and ``_bucket``, the number of cuts at or below it.

    Each row finds its slice in two steps through a list of lists of cuts, one small row that every task gets.
    """
    keyed = df.withColumn("_key", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order))))
    rows = keyed.count()
    cuts = _cuts(keyed.select("_key"), rows, slice_rows) if rows > slice_rows else []
    if not cuts:
        return keyed.withColumn("_bucket", F.lit(0))
    wide = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    kind = keyed.schema["_key"].dataType
    schema = StructType([StructField("_firsts", ArrayType(kind)), StructField("_blocks", ArrayType(ArrayType(kind)))])
    ends = df.sparkSession.createDataFrame([([b[0] for b in blocks], blocks)], schema)
    upto = lambda cuts: F.size(F.filter(cuts, lambda c: c <= F.col("_key")))
    block = keyed.crossJoin(F.broadcast(ends)).withColumn("_block", upto("_firsts"))
    within = F.when(F.col("_block") > 0, upto(F.get("_blocks", F.col("_block") - 1))).otherwise(0)
    return block.withColumn("_bucket", F.greatest(F.col("_block") - 1, F.lit(0)) * wide + within).drop("_firsts", "_blocks", "_block")


def numbered(df: DataFrame, order: list[Column], name: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``name``: its place from 1 in ascending ``order``, nulls first.

    Rows are dealt into slices of about ``slice_rows`` by cuts taken from their own keys, so neither an outlier nor a
    common beginning of texts crowds a slice; slices are counted, and rows numbered within. Only rows equal in all of
    ``order`` can't be parted; among them any may come first. An empty table stays empty. The
    table is counted when the plan is built, and sampled if it needs more than one slice.
    """
    dealt = _dealt(df, order, slice_rows)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    skip = dealt.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_skip"))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key")) + F.col("_skip")
    return dealt.join(F.broadcast(skip), "_bucket").withColumn(name, place.cast("long")).drop("_bucket", "_skip", "_key")


def successors(df: DataFrame, key: str, number: Column, name: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with ``name``: the ``key`` that follows in order of ``number``, then ``key``; the first follows the last."""
    dealt = _dealt(df, [number, F.col(key)], slice_rows)
    firsts = dealt.groupBy("_bucket").agg(F.min_by(key, "_key").alias("_first"))
    slices, around = Window.orderBy("_bucket"), Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = firsts.select("_bucket", F.coalesce(F.lead("_first").over(slices), F.first_value("_first").over(around)).alias("_next"))
    found = F.coalesce(F.lead(key).over(Window.partitionBy("_bucket").orderBy("_key")), F.col("_next"))
    return dealt.join(F.broadcast(following), "_bucket").withColumn(name, found).drop("_bucket", "_next", "_key")
