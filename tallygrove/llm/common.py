"""Shared helpers of the training-data operators: scratch tables, names, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Words are runs of anything but blank and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. On a single machine, as in tests, a temporary one where it is unset; a cluster must name it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _temporary()
    return path.rstrip("/")


@cache
def _temporary() -> str:
    return tempfile.mkdtemp(prefix="tallygrove-")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet to the shared folder and read it again.

    A lost executor costs no more than the running stage. Files stay until the
    cluster clears its checkpoint folder, or until :func:`forget`. The shuffle files of the
    write go when it ends, and so do the tables that ``df`` was made from, as far as :func:`holding` names them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tallygrove/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    forget(*getattr(df, "_held", ()))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def holding(df: DataFrame, *frames: DataFrame) -> DataFrame:
    """``df``, which alone still reads the scratch tables ``frames``: once it is materialized they go."""
    df._held = frames
    return df


def forget(*frames: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has not, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        pick = f"_tg_{name}"
        while pick.lower() in taken:
            pick += "_"
        taken.add(pick.lower())
        out.append(pick)
    return out


def count_words(text: Column) -> Column:
    """Number of words, JVM-side, without an array of them: each word becomes one letter, then blanks go."""
    marked = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` of longs gives ``(node, root)``, root the smallest node.

    Alternating large-star and small-star passes: every pass keeps at most as
    many edges as it got, and the minimum travels as a partial aggregate, so a
    hub node is never gathered in one task (joins on a hub are split by AQE).
    Each round is written to the shared folder. Self loops and nulls are
    ignored; an empty graph gives an empty table.
    """

    def with_min(directed: DataFrame) -> DataFrame:
        low = directed.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return directed.join(low, "u")

    # Hash order would do; an ordered pair makes both passes plain.
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = with_min(large).select("u", "v", "m")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct())
        forget(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
