"""Sealed tables and files: digests that refuse change, documents written whole or not at all, results kept by content."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import file_system


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row: its values as text, nulls marked apart, each with its length before it."""
    said = (F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns)
    return F.sha2(F.concat_ws("|", *said), 256)


def manifest(df: DataFrame, key: str, columns: list[str], parts: int = 16) -> DataFrame:
    """``(part, n, digest)``: one digest for each ``parts``-th of the keys, whatever the order of rows and files.

    Row digests are cut into four numbers and summed, so a part is a partial aggregate and its rows are never gathered;
    repeated rows count as often as they occur. Null keys are part 0.
    """
    digest = row_digest(columns)
    number = lambda k: F.conv(F.substring("_d", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    keyed = df.select(F.coalesce(F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(parts)), F.lit(0)).alias("part"), digest.alias("_d"))
    sums = keyed.groupBy("part").agg(F.count("*").alias("n"), *(F.sum(number(k)).alias(f"_{k}") for k in range(4)))
    return sums.select("part", "n", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n", "_0", "_1", "_2", "_3"))), 256).alias("digest"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length, digest)``: SHA-256 of every file's bytes below ``path``, each hashed where it is read; names are relative. Empty files have no row: file scans pass over them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    fs, where = file_system(spark, path)
    root = fs.makeQualified(where).toUri().getPath().rstrip("/") + "/"
    name = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    return found.select(F.when(name.startswith(root), F.substring(name, F.lit(len(root) + 1), F.length(name))).otherwise(name).alias("file"), "length", F.sha2("content", 256).alias("digest"))


def verified(now: DataFrame, sealed: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """``now`` if it has exactly the keys and digests of ``sealed``; else the first read fails and names what changed."""
    other = sealed.select(F.col(key).alias("_key"), F.col(digest).alias("_sealed"), F.lit(True).alias("_there"))
    met = now.withColumn("_here", F.lit(True)).join(other, F.col(key) == F.col("_key"), "full")
    said = F.concat(F.lit("changed since it was sealed: "), F.coalesce(F.col(key).cast("string"), F.col("_key").cast("string"), F.lit("null")))
    same = F.col("_here").isNotNull() & F.col("_there").isNotNull() & F.col(digest).eqNullSafe(F.col("_sealed"))
    return met.withColumn(digest, F.when(F.coalesce(same, F.lit(False)), F.col(digest)).otherwise(F.raise_error(said).cast("string"))).select(*now.columns)


def write_json(spark: SparkSession, value, path: str) -> None:
    """A document in one file that is there whole or not at all: written beside, then renamed. NaN and infinities are errors."""
    text = json.dumps(value, allow_nan=False, ensure_ascii=False, indent=2) + "\n"
    fs, target = file_system(spark, path)
    _, beside = file_system(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"could not rename to {path}")


def kept_results(rows: DataFrame, digest: Column, compute: Callable[[DataFrame], DataFrame], path: str, identity: str) -> DataFrame:
    """``rows`` joined to results kept below ``path`` by the digest of their content; only what is not there yet is computed.

    ``compute`` gets one row per missing digest, with column ``_digest``, and must keep that column; its other new columns are the result. They are
    appended with the ``identity`` of what computed them (a model and its version). If another identity's results
    are there, the call fails and nothing is written. A second call with the same rows computes nothing.
    """
    spark = rows.sparkSession
    fs, where = file_system(spark, path)
    keyed = rows.withColumn("_digest", digest)
    wanted = keyed.dropDuplicates(["_digest"]).where("_digest is not null")
    there = fs.exists(where)
    if there:
        old = spark.read.parquet(path)
        strange = old.where(F.col("_identity") != identity).select("_identity").limit(1).collect()
        if strange:
            raise ValueError(f"results below {path} are of {strange[0][0]}, not of {identity}")
        wanted = wanted.join(old.select("_digest"), "_digest", "left_anti")
    made = compute(wanted)
    fresh = [c for c in made.columns if c not in rows.columns and c != "_digest"]
    if not there or not wanted.isEmpty():
        made.select("_digest", *fresh, F.lit(identity).alias("_identity")).write.mode("append").parquet(path)
    held = spark.read.parquet(path).select("_digest", *fresh)
    return keyed.join(held, "_digest", "left").drop("_digest")
