"""Structure of Markdown texts: fences, headings with their anchors, links and whether they lead anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The patterns of the format.
FENCE = "```"
HEADING = r"^(#{1,4}) (.+)$"
LINK = r"!?\[[^\]]*\]\(([^)]+)\)"
OUTSIDE = r"^(?:https?|mailto):"


def lines(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``(key, n, line, fenced, unclosed)``: the lines of each text, whether they stand in a fence (its own lines included), and whether the text leaves one open.

    A fence is open on a line if an odd number of fence lines stands before it; the parity runs over the lines of one text.
    """
    rows = df.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("n", "line"))
    marks = F.col("line").startswith(FENCE)
    order = Window.partitionBy(key).orderBy("n")
    before = F.coalesce(F.count_if(marks).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.count_if(marks).over(Window.partitionBy(key))
    return rows.select(key, F.col("n").cast("long").alias("n"), "line", (marks | (F.pmod(before, F.lit(2)) == 1)).alias("fenced"), (F.pmod(total, F.lit(2)) == 1).alias("unclosed"))


def slug(title: Column) -> Column:
    """Lower-cased letters, numbers, underscores and hyphens; blanks become hyphens."""
    return F.replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_ -]", ""), F.lit(" "), F.lit("-"))


def headings(marked: DataFrame, key: str) -> DataFrame:
    """``(key, n, level, title, anchor)`` of the headings outside fences; a slug that a text has before gets its number of repeats."""
    found = marked.where(~F.col("fenced") & F.col("line").rlike(HEADING)).select(key, "n", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title"))
    named = found.withColumn("_slug", slug(F.col("title")))
    again = F.row_number().over(Window.partitionBy(key, "_slug").orderBy("n")) - 1
    return named.withColumn("_again", again).select(key, "n", F.col("level").cast("long").alias("level"), "title", F.when(F.col("_again") > 0, F.concat_ws("-", "_slug", F.col("_again").cast("string"))).otherwise(F.col("_slug")).alias("anchor"))


def links(marked: DataFrame, key: str) -> DataFrame:
    """``(key, n, file, fragment)`` of links that do not lead outside, in or out of fences; an empty ``file`` is the text itself."""
    found = marked.select(key, "n", F.explode(F.regexp_extract_all("line", F.lit(LINK), F.lit(1))).alias("target")).where(~F.col("target").rlike(OUTSIDE))
    return found.select(key, "n", F.substring_index("target", "#", 1).alias("file"), F.when(F.instr("target", "#") > 0, F.substring("target", F.instr("target", "#") + 1, F.length("target"))).alias("fragment"))


def checked(found: DataFrame, anchors: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``found`` links with ``state``: ``ok``, ``no file`` or ``no anchor``. ``names`` has each text's ``key`` and ``name``."""
    own = names.select(F.col(key).alias("_own"), F.col("name").alias("_own_name"))
    target = F.when(F.col("file") == "", F.col("_own_name")).otherwise(F.col("file"))
    met = found.join(own, F.col(key) == F.col("_own")).withColumn("_name", target)
    met = met.join(names.select(F.col(key).alias("_to"), F.col("name").alias("_name")), "_name", "left")
    there = anchors.select(F.col(key).alias("_to"), F.col("anchor").alias("fragment"), F.lit(True).alias("_there")).distinct()
    met = met.join(there, ["_to", "fragment"], "left")
    lacks = F.coalesce(F.col("fragment") != "", F.lit(False)) & F.col("_there").isNull()
    return met.select(*found.columns, F.when(F.col("_to").isNull(), "no file").when(lacks, "no anchor").otherwise("ok").alias("state"))
