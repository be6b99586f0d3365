"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of text, hash of id). Splitters are found by probing:
each round counts, exactly and across all partitions, the bytes below every
candidate boundary, and moves the candidates until each splitter lies within
tolerance of its target; only then are rows exchanged, once.

Rows equal in text and id differ in the last 20 bits of their keys, which come from a
number that each row gets when the keys are written: a group of any size can be cut,
and no task holds it whole. Such rows are alike, so it does not matter which goes where.

Candidates are the interpolated key, a random row of the bracket, and the two
edges of that row's group of equal texts: so equal texts stay together unless
one boundary has to cut a group that is larger than the tolerance, and a group
of a third of all rows is cut by id. Between shard boundaries lie finer
splitters, so that no task sorts a whole shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import fresh, materialize

_TOP = 1 << 128
_TIES = (1 << 20) - 1


def _keys(hi: pa.Array, lo: pa.Array) -> np.ndarray:
    """16-byte keys whose order is that of (hi, lo) as unsigned numbers."""
    both = np.empty((len(hi), 2), dtype=">u8")
    both[:, 0], both[:, 1] = (np.asarray(x.to_numpy(zero_copy_only=False)).view(np.uint64) for x in (hi, lo))
    return both.reshape(-1).view("S16") if len(hi) else np.zeros(0, "S16")


def _packed(probes: list[int]) -> np.ndarray:
    return np.array([p.to_bytes(16, "big") for p in probes], dtype="S16")


def _below(probes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Number of probes at or below each key."""
    return np.searchsorted(probes, keys, side="right")


def histogram(keyed: DataFrame, probes: list[int], seed: int) -> list[tuple[int, int, int]]:
    """For each gap between sorted ``probes``: exact bytes, rows, and the key of a random row (-1: no row).

    ``keyed`` has hi, lo, size. Each partition sends one row per gap that it has rows of.
    """
    cuts = _packed(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_, rows = np.zeros(len(cuts) + 1, np.int64), np.zeros(len(cuts) + 1, np.int64)
        pick, rank = np.zeros(len(cuts) + 1, "S16"), np.full(len(cuts) + 1, np.iinfo(np.uint64).max, np.uint64)
        for batch in batches:
            if not len(batch):
                continue
            keys = _keys(batch.column(0), batch.column(1))
            gap, size = _below(cuts, keys), batch.column(2).to_numpy(zero_copy_only=False)
            bytes_ += np.bincount(gap, size, len(cuts) + 1).astype(np.int64)
            rows += np.bincount(gap, minlength=len(cuts) + 1)
            # Without the bits that tell equal rows apart, so that a rerun picks the same rows.
            order = ((batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(20)) ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
            by = np.lexsort((order, gap))
            first = by[np.flatnonzero(np.r_[True, gap[by][1:] != gap[by][:-1]])]
            better = first[order[first] <= rank[gap[first]]]
            pick[gap[better]], rank[gap[better]] = keys[better], order[better]
        some = np.flatnonzero(rows)
        hexed = [bytes(pick[k]).ljust(16, b"\0").hex() for k in some]
        yield pa.record_batch([pa.array(some), pa.array(bytes_[some]), pa.array(rows[some]), pa.array(hexed), pa.array((rank[some] >> np.uint64(1)).astype(np.int64))], names=["gap", "bytes", "rows", "pick", "rank"])

    counted = keyed.select("hi", "lo", "size").mapInArrow(run, "gap long, bytes long, rows long, pick string, rank long")
    got = counted.groupBy("gap").agg(F.sum("bytes"), F.sum("rows"), F.min(F.struct("rank", "pick")))
    out = [(0, 0, -1)] * (len(probes) + 1)
    for gap, size, rows, best in got.collect():
        out[gap] = (size, rows, int(best[1], 16))
    return out


def find_splitters(keyed: DataFrame, targets: list[tuple[float, float]], total: int, rows: int, max_rounds: int = 200) -> list[int]:
    """Keys such that the bytes below each come to its target, to within its tolerance or one row.

    ``targets``: ascending (bytes below, tolerance). What the driver holds grows
    with the number of splitters, never with the rows.
    """
    done: dict[int, int] = {}
    bracket = {j: (0, 0, _TOP, total, rows, -1) for j in range(len(targets))}
    for turn in range(max_rounds):
        if not bracket:
            break
        probes: set[int] = set()
        for j, (a, below, b, upto, _, pick) in bracket.items():
            share = (targets[j][0] - below) / max(1, upto - below)
            probes |= {p for p in (a, b) if p > 0}
            probes |= {p for p in (a + int((b - a) * min(1.0, max(0.0, share))), (a + b) // 2) if a < p < b}
            if pick >= 0:  # a row, its successor, and the edges of its group
                group = pick >> 64 << 64
                probes |= {p for p in (pick, pick + 1, group, group + (1 << 64)) if a < p < b}
        asked = sorted(p for p in probes if p < _TOP)
        counts, below, edges = histogram(keyed, asked, seed=turn * 0x5851F42D4C957F2D & (2**64 - 1)), 0, [0, *asked, _TOP]
        cum = np.cumsum([0, *(c[0] for c in counts)])
        for j in list(bracket):
            target, slack = targets[j]
            at = int(np.searchsorted(cum, target, side="right")) - 1
            at = max(0, min(at, len(counts) - 1))
            ends = [(abs(cum[k] - target), k) for k in (at, at + 1)]
            # An edge of a group of equal texts, or between groups, wins within tolerance.
            near = [k for d, k in ends if d <= slack]
            size, n, pick = counts[at]
            if near or n <= 1 or edges[at + 1] - edges[at] <= 1:
                k = min((edges[k] & ((1 << 64) - 1) != 0, abs(cum[k] - target), k) for k in near)[2] if near else min(ends)[1]
                done[j] = min(edges[k], _TOP - 1) if k <= len(counts) - 1 else _TOP
                del bracket[j]
            else:
                bracket[j] = (edges[at], int(cum[at]), edges[at + 1], int(cum[at + 1]), n, pick)
    if bracket:
        raise RuntimeError("splitters did not settle")
    return [done[j] for j in range(len(targets))]


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.001, keep_rows: bool = False, piece_bytes: int = 32 << 20, max_pieces: int = 16384) -> DataFrame:
    """Each row of ``docs`` with its shard and its place in it.

    Size of a row: UTF-8 bytes of its text (null: none) plus 1. Shards differ by
    ``tolerance`` of their mean, or by one row where rows are larger. Null texts count as
    empty; null ids are equal to each other; rows equal in text and id are spread like others
    where a boundary has to cut them. Columns:
    ``doc_id, size, text_crc32, shard, slot``, or with ``keep_rows`` all columns
    of ``docs`` and ``shard, slot`` (under other names where taken). Slots count
    from 0 in key order without gaps. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, hi, lo, crc, shard_c, slot_c, piece = fresh(docs, "size", "hi", "lo", "crc", "shard", "slot", "piece")
    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(_TIES))
    key_of_id = F.xxhash64(F.col(id_col)).bitwiseAND(F.lit(~_TIES)).bitwiseOR(tie)
    keys = [(F.octet_length(text) + 1).cast("long").alias(size), F.xxhash64(text).alias(hi), key_of_id.alias(lo)]
    own = docs.columns if keep_rows else ["doc_id", "size", "text_crc32"]
    if keep_rows:
        source = materialize(docs.select("*", *keys))
    else:
        size, hi, lo = "size", "hi", "lo"
        source = materialize(docs.select(F.col(id_col).alias("doc_id"), *(k.alias(x) for k, x in zip(keys, (size, hi, lo), strict=True)), F.crc32(text.cast("binary")).alias("text_crc32")))
    keyed = source.select(F.col(size).alias("size"), F.col(hi).alias("hi"), F.col(lo).alias("lo"))
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fine = max(4, min(max_pieces, math.ceil(total / piece_bytes)) // shards + 1)
    n = shards * fine
    exact, rough = tolerance * total / shards, 0.25 * total / n
    cuts = find_splitters(keyed, [(total * j / n, rough if j % fine else exact) for j in range(1, n)], total, rows) if rows else []
    cuts = list(np.maximum.accumulate(np.array(cuts, dtype=object))) if cuts else []
    # A rough splitter never passes the exact one next to it.
    for j in range(len(cuts) - 1, -1, -1):
        if (j + 1) % fine:
            bound = next((cuts[k] for k in range(j + 1, len(cuts)) if (k + 1) % fine == 0), _TOP)
            cuts[j] = min(cuts[j], bound)
    packed = _packed([min(c, _TOP - 1) for c in cuts])
    counts = [c[1] for c in histogram(keyed, [min(c, _TOP - 1) for c in cuts], 1)] if rows else [0]
    first = [sum(counts[k] for k in range(p - p % fine, p)) for p in range(len(counts))]

    places = [source.columns.index(hi), source.columns.index(lo)]
    starts = np.array(first, dtype=np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _below(packed, _keys(*(batch.column(p) for p in places))) if len(batch) else np.zeros(0, np.int64)
            more = [pa.array(at.astype(np.int64)), pa.array((at // fine).astype(np.int32)), pa.array(starts[at])]
            yield pa.record_batch([*batch.columns, *more], names=[*batch.schema.names, piece, shard_c, slot_c])

    schema = StructType([*source.schema.fields, StructField(piece, LongType()), StructField(shard_c, IntegerType()), StructField(slot_c, LongType())])
    placed = source.mapInArrow(place, schema)
    order = Window.partitionBy(piece).orderBy(F.col(hi) < 0, hi, F.col(lo) < 0, lo)
    placed = placed.withColumn(slot_c, F.col(slot_c) + F.row_number().over(order) - 1)
    names = {shard_c: "shard", slot_c: "slot"}
    taken = {c.lower() for c in own}
    names = {c: x if x not in taken else c for c, x in names.items()}
    return placed.select(*own, *(F.col(c).alias(x) for c, x in names.items()))


def op2_sharding(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Contract digest of :func:`assign_shards`, which says what nulls, empty texts, ties and repeated rows do: law ``bytes``."""
    placed = assign_shards(docs, shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
