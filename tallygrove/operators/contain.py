"""Which texts hold which items, word for word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

WORD = r"[^\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _run(words: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from place ``at`` on, counted from 0."""
    return F.xxhash64(*(F.get(words, at + k) for k in range(length)))


def contained(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str, length: int = 3, block: int = 1000, block_bytes: int = 1 << 20) -> DataFrame:
    """``(doc, item)`` wherever a document's text contains an item's text, each pair of rows once.

    All words of an item but the first and last must stand in the document as they are, and so must every run of
    ``length`` of its inner words. The documents' words are read once for the runs that any item has; the rarest of an item's runs
    is the key its candidates are joined on (an item with a run that no document has is nowhere), so a frequent run such as
    ``of the in`` serves only items that have no other; ``contains`` then decides. Items with fewer inner words are searched
    in every text, in blocks of about ``block`` items and ``block_bytes`` bytes. Null texts contain and are contained in nothing; an empty
    item is in every text. Equal rows of items count once.
    """
    asked = items.select(F.col(item).alias("_item"), F.col(text).alias("_said")).where("_said is not null").distinct().withColumn("_w", _words(F.col("_said")))
    long_enough = F.size("_w") >= length + 2
    runs_of = lambda df, *keys: df.where(long_enough).select(*keys, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("_w") - length - 1), lambda i: _run(F.col("_w"), i, length)))).alias("_run"))
    own = runs_of(asked, "_item", "_said")
    words = docs.select(F.col(doc).alias("_doc"), _words(F.col(text)).alias("_w"))
    hits = written(runs_of(words, "_doc").join(own.select("_run").distinct(), "_run", "left_semi"), "runs")
    often = hits.groupBy("_run").agg(F.count("*").alias("_n"))
    rarest = own.join(often, "_run", "left").groupBy("_item", "_said").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_run")).alias("_r")).where("_r._n > 0")
    candidates = hits.join(rarest.select("_item", "_said", F.col("_r._run").alias("_run")), "_run").select("_doc", "_item", "_said").distinct()
    found = [docs.join(candidates, F.col(doc).eqNullSafe(F.col("_doc"))).where(F.contains(text, "_said")).select(doc, F.col("_item").alias(item))]
    short = asked.where(~long_enough).select("_item", "_said")
    number, size = short.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_said")), F.lit(0))).first()
    blocks = max(-(-number // block), -(-size // block_bytes))
    for k in range(blocks):
        part = short.where(F.pmod(F.xxhash64("_item", "_said"), F.lit(blocks)) == k).agg(F.collect_list(F.struct("_item", "_said")).alias("_items"))
        met = docs.select(doc, text).crossJoin(F.broadcast(part)).select(doc, F.explode(F.filter("_items", lambda i: F.contains(F.col(text), i["_said"]))).alias("_i"))
        found.append(met.select(doc, F.col("_i._item").alias(item)))
    return reduce(lambda a, b: a.unionAll(b), found)
