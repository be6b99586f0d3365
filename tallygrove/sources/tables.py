"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def membership(splits: DataFrame, names: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """``(split, pid)`` from one row of arrays."""
    return splits.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))).alias("split", "pids")).select("split", F.explode(F.col("pids").cast("array<string>")).alias("pid"))


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """One file with a header, fields in the given order, null as nothing. For results small enough to be read by people."""
    df.select(*fields).coalesce(1).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
