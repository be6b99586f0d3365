"""Append logs of JSON lines whose last line may be torn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line)``: the lines of every file under ``path`` that end in a line feed.

    Files are split like any text, so a large log is read by many tasks. A first pass sums the bytes of each file's lines and
    finds its last line by place: where a line feed too few was read, that line is torn, and the second pass leaves it out.
    Files are read, never changed; what is appended after the call is not seen.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    placed = scan.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("_nth")).alias("_place"))
    ends = placed.groupBy("_file").agg(F.sum(F.octet_length("line") + 1).alias("_read"), F.first("_size").alias("_size"), F.max("_place").alias("_last"))
    torn = ends.where("_read > _size").select("_file", F.col("_last").alias("_place"))
    return placed.join(torn, ["_file", "_place"], "left_anti").select("line")


def read_recovered(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of the complete lines (see :func:`complete_lines`); blank lines are passed over, a malformed complete line is an error when it is read."""
    lines = complete_lines(spark, path).where(F.trim("line") != "")
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
