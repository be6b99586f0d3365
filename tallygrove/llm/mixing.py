"""Mixing sources to target weights by entropy balancing.

Rates are the closest to 1 (in the bounded entropy on [0, ``most``]) for which
each source's words come to its target. The dual is convex with one multiplier
per source: ``rate = most / (1 + (most - 1) * exp(-lam * x))`` with x the
document's size over its source's mean size. Documents enter only through the
histogram (source, size, number), summed map-side, so a source with a third of
all rows is no larger than another. Safeguarded Newton steps run over that
histogram as distributed sums until every source's words match.

Rates become copies: systematic rounding from the largest size down, then
corrections that add or take back whole documents no larger than what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, forget, holding, materialize

WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size)`` with ``target``: ``share`` of all words, dealt by weight, none above ``most`` times its size.

    Sources by code point, null last, take the weights in turn. Sharing the
    excess again until none is above fills to one level: the sources capped are
    those with the least size per weight, so one pass in that order finds it.
    """
    kinds = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", F.get(kinds, F.pmod("k", F.lit(len(weights)))))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", "k")
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumns({"capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "all": share * F.sum("source_size").over(everything), "w_all": F.sum("w").over(everything)})
    # The level if only those before it are capped; the first row that is not above it sets it for the rest.
    ranked = ranked.withColumn("level", (F.col("all") - F.col("capped")) / (F.col("w_all") - F.col("w_before")))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.when(F.col("level").isNull() | (F.col("w") * F.col("level") > F.col("cap")), F.col("cap")).otherwise(F.col("w") * F.col("level"))
    return ranked.select("source", "source_size", target.alias("target"))


def _rate(lam: Column, x: Column, most: float) -> Column:
    """Bounded exponential tilt; 1 at lam = 0 whatever x."""
    tilt = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -lam * x))
    return most / (1 + (most - 1) * F.exp(tilt))


def balance(cells: DataFrame, targets: DataFrame, most: float = 2.0, tolerance: float = 1e-9, max_rounds: int = 60) -> DataFrame:
    """Multipliers ``lam`` of the sources; ``cells(source, size, n)``, ``targets(source, source_size, target, mean)``.

    A source at its cap has lam = infinity (null here, rate ``most``); one
    without words has lam = 0. Null is a source like any other; equal sizes are one cell; without sources the result is
    empty. Steps that do not settle within ``max_rounds`` are an error.
    """
    full = (F.col("target") >= most * F.col("source_size") * (1 - 1e-12)) | (F.col("source_size") == 0)
    start = F.lit(0.0)
    now = materialize(targets.select("source", "source_size", "target", "mean", full.alias("still"), start.alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")))
    for _ in range(max_rounds):
        if now.where(~F.col("still")).isEmpty():
            return now
        at = cells.join(now.where(~F.col("still")).select(F.col("source").alias("s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("s")))
        x = F.col("size") / F.col("mean")
        at = at.select("s", "n", "size", x.alias("x"), _rate(F.col("lam"), x, most).alias("r"))
        sums = at.groupBy("s").agg(F.sum(F.col("n") * F.col("size") * F.col("r")).alias("words"), F.sum(F.col("n") * F.col("size") * F.col("x") * F.col("r") * (1 - F.col("r") / most)).alias("slope"))
        new = now.join(sums, F.col("source").eqNullSafe(F.col("s")), "left")
        miss = F.col("words") - F.col("target")
        low = F.when(miss < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        new = new.withColumns({"miss": miss, "low": low, "high": high})
        step = F.col("lam") - F.greatest(F.lit(-4.0) - F.abs("lam"), F.least(F.lit(4.0) + F.abs("lam"), F.try_divide(F.col("miss"), F.col("slope"))))
        inside = step.isNotNull() & (F.col("low").isNull() | (step > F.col("low"))) & (F.col("high").isNull() | (step < F.col("high")))
        middle = F.when(F.col("low").isNull(), F.col("high") * 2 - 1).when(F.col("high").isNull(), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        done = F.col("still") | (F.abs("miss") <= tolerance * F.col("source_size") + 0.25)
        after = materialize(new.select("source", "source_size", "target", "mean", F.coalesce(done, F.lit(True)).alias("still"), F.when(F.coalesce(done, F.lit(True)), F.col("lam")).otherwise(F.when(inside, step).otherwise(middle)).alias("lam"), "low", "high"))
        forget(now)
        now = after
    if not now.where(~F.col("still")).isEmpty():
        raise RuntimeError("multipliers did not settle")
    return now


def round_copies(cells: DataFrame, most: int = 2, passes: int = 8, rounds: int = 20) -> DataFrame:
    """``cells(source, size, n, rate, target)`` with ``copies``: whole copies for the n documents together.

    Passes go on, ``passes`` to a job, until none would change anything; beyond ``rounds`` jobs that is an error.

    Systematic rounding down the sizes keeps each size class within one document
    of its rate; each pass then mends what the source still misses with the
    largest documents that fit. All sums run over size classes of a source, of
    which there are at most as many as there are sizes.
    """
    source = Window.partitionBy("source")
    down = source.orderBy(F.col("size").desc())
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = F.sum(F.col("n") * F.col("rate")).over(upto)
    out = cells.withColumn("e", F.floor(want + 0.5 + 1e-9))
    out = out.withColumn("copies", F.greatest(F.lit(0), F.least(F.col("n") * most, F.col("e") - F.coalesce(F.lag("e").over(down), F.lit(0)))).cast("long")).drop("e")
    for _ in range(rounds):
        before, out = out, materialize(_mended(out.drop("open"), most, passes))
        forget(before)
        if out.where("open").isEmpty():
            return holding(out.drop("open"), out)
    raise RuntimeError("copies did not settle")


def _mended(out: DataFrame, most: int, passes: int) -> DataFrame:
    """``out`` after some passes, and ``open``: whether another one would change the row."""
    source = Window.partitionBy("source")
    before = source.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for k in range(passes + 1):
        out = out.withColumn("left", F.round(F.col("target")).cast("long") - F.sum(F.col("copies") * F.col("size")).over(source))
        room = F.when((F.col("size") == 0) | (F.col("size") > F.abs("left")), F.lit(0)).when(F.col("left") > 0, F.col("n") * most - F.col("copies")).otherwise(F.col("copies"))
        out = out.withColumn("room", room.cast("long"))
        out = out.withColumn("gone", F.coalesce(F.sum(F.col("room") * F.col("size")).over(before), F.lit(0)))
        fit = F.when(F.col("size") > 0, F.floor((F.abs("left") - F.col("gone")) / F.greatest(F.col("size"), F.lit(1)))).otherwise(F.lit(0))
        move = F.greatest(F.lit(0), F.least(F.col("room"), fit)).cast("long")
        if k == passes:
            out = out.withColumn("open", F.coalesce(move > 0, F.lit(False)) & (F.col("left") != 0)).drop("left", "room", "gone")
        else:
            out = out.withColumn("copies", F.col("copies") + F.signum("left").cast("long") * move).drop("left", "room", "gone")
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, size, source, source_size, target, rate, copies``.

    Size is the number of words (null text: 0). Copies are 0 to ``most``; which
    documents of a size class get one more is settled by a hash of the id, so
    reruns agree. Null is a source of its own; documents without words have
    rate 1 and one copy or none, which changes no sum. Empty table: empty result.
    """
    spark = docs.sparkSession
    narrow = materialize(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col).cast("string")).alias("size")))
    rows = narrow.count()
    # Ranks inside a size class are taken by hashed bucket, so that a class of a third of all rows is dealt out too.
    buckets = max(64, rows // bucket_rows)
    narrow = narrow.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(5)), F.lit(buckets)))
    parts = materialize(narrow.groupBy("source", "size", "bucket").agg(F.count("*").alias("m")))
    cells = materialize(parts.groupBy("source", "size").agg(F.sum("m").alias("n")))
    sizes = cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, float(most))
    means = sizes.select(F.col("source").alias("s"), F.greatest(F.lit(1e-9), F.col("source_size") / F.col("docs")).alias("mean"))
    targets = targets.join(means, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    solved = balance(cells, targets, float(most))
    full = (F.col("source_size") > 0) & (F.col("target") >= most * F.col("source_size") * (1 - 1e-12))
    rate = F.when(full & (F.col("size") > 0), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("size") / F.col("mean"), float(most)))
    solved = solved.select(F.col("source").alias("s"), "source_size", "target", "mean", "lam")
    rated = cells.join(solved, F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "source_size", "target", rate.alias("rate"))
    rounded = round_copies(rated, most)
    # Copies of a class: the whole part for all, one more for the first by hash order of buckets and, inside, of ids.
    whole, extra = F.floor(F.col("copies") / F.col("n")), F.pmod("copies", "n")
    classes = materialize(rounded.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", whole.alias("whole"), extra.alias("extra")))
    forget(*rounded._held)
    upto = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("skip", F.coalesce(F.sum("m").over(upto), F.lit(0)))
    offsets = offsets.join(classes, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    offsets = materialize(offsets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), F.col("size").alias("z"), F.col("bucket").alias("b"), "skip", "source_size", "target", "rate", "whole", "extra"))
    keyed = narrow.withColumns({"s0": F.coalesce("source", F.lit("")), "none0": F.col("source").isNull()})
    placed = keyed.join(offsets, (F.col("s0") == F.col("s")) & (F.col("none0") == F.col("none")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")))
    order = Window.partitionBy("s0", "none0", "size", "bucket").orderBy(F.xxhash64("doc_id", "text_hash", F.lit(9)), "doc_id", "text_hash")
    copies = (F.col("whole") + F.when(F.col("skip") + F.row_number().over(order) <= F.col("extra"), 1).otherwise(0)).cast("long")
    return placed.select("doc_id", "text_hash", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` decides, all columns kept."""
    decided = mix(docs, id_col=id_col, text_col=text_col, **options)
    # Rows equal in id and text: their copies together, dealt evenly by the join on what is distinct.
    whole = decided.groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    from .common import fresh

    twin, mark, number, rows, rank = fresh(docs, "twin", "mark", "number", "rows", "rank")
    whole = materialize(whole.select(F.col("doc_id").alias(twin), F.col("text_hash").alias(mark), F.col("copies").alias(number), F.col("rows").alias(rows)))
    met = docs.join(whole, docs[id_col].eqNullSafe(whole[twin]) & (F.xxhash64(docs[text_col].cast("string")) == whole[mark]))
    times = F.col(number)
    if not whole.where(F.col(rows) > 1).isEmpty():
        at = Window.partitionBy(twin, mark).orderBy(F.lit(1))
        met = met.withColumn(rank, F.row_number().over(at))
        times = F.floor(F.col(number) / F.col(rows)) + F.when(F.col(rank) <= F.pmod(number, rows), 1).otherwise(0)
    repeated = met.withColumn(rank, F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)).cast("int")))).where(times > 0)
    return repeated.select(*docs.columns)


def op10_mixing(docs: DataFrame) -> DataFrame:
    """Contract digest: words taken, whole copies counted."""
    found = mix(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
