"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within
the allowed distance must have a segment differing in at most one bit:
``max_bits // 2 + 1`` segments. Each fingerprint is indexed once for every bit
under the key *(bit, its segment with that bit as wildcard)*: segments that
differ in one bit agree under that bit's key, equal ones agree under all.
Equal keys meet in one exchange, distances are verified on all 64 bits.

Copies collapse to one fingerprint before the index, so a group of exact copies
costs one row. Inside a bucket only a spanning forest of links is made, never
all pairs; a bucket that a sample shows to be large is dealt as blocks, each two
of which meet in a task of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, materialize, partitions

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_BITS = 64
_SLICE = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned SimHash of a text; null or wordless gives 0. ASCII capitals count as small letters."""
    words = _WORDS.findall(text.lower()) if text else []
    if not words:
        return 0
    k, h64 = min(shingle, len(words)), partial(xxhash.xxh64_intdigest, seed=seed)
    n, ones = len(words) - k + 1, np.zeros(_BITS, dtype=np.int64)
    for at in range(0, n, _SLICE):
        part = words[at : at + _SLICE + k - 1]
        hashes = np.fromiter(map(h64, map(b" ".join, zip(*(part[j:] for j in range(k)), strict=False))), dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row of ``docs``, fp as a signed long with the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            got = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    m = max_bits // 2 + 1
    edges = [_BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _variant_keys(max_bits: int):
    """The index keys of column ``fp``: bit number in the high half, segment without that bit in the low."""
    keys = []
    for low, width in segments(max_bits):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(~(1 << j))).bitwiseOR(F.lit((low + j) << 32)) for j in range(width)]
    return F.array(*keys)


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected at max_bits, at most one fewer than there are members."""
    rest, a, b = fps, [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                queue += list(found)
    none = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a) if a else none), (np.concatenate(b) if b else none)


def _bucket_links(max_bits: int):
    """mapInArrow body: rows (key, blk, fp) sorted by key and blk give links (a, b)."""

    def links(keys: np.ndarray, blks: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (blks[1:] != blks[:-1])])
        sizes = np.diff(np.r_[starts, len(keys)])
        two = starts[sizes == 2]
        a, b = [fps[two]], [fps[two + 1]]
        for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            x, y = _forest(np.unique(fps[at : at + size]), max_bits)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        ok = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        return pa.record_batch([pa.array(a[ok].view(np.int64)), pa.array(b[ok].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not len(batch):
                continue
            now = [batch.column(j).to_numpy(zero_copy_only=False) for j in range(3)]
            now[2] = now[2].view(np.uint64)
            # Hold back the last bucket: it may go on in the next batch.
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            same = held and held[-1][0][-1] == now[0][0] and held[-1][1][-1] == now[1][0]
            if held and (cut or not same):
                head = [*held, [x[:cut] for x in now]] if same else held
                yield links(*(np.concatenate(x) for x in zip(*head, strict=True)))
                if not same and cut:
                    yield links(*(x[:cut] for x in now))
                held = []
            elif cut:
                yield links(*(x[:cut] for x in now))
            held.append([x[cut:] for x in now])
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def link_fingerprints(fps: DataFrame, max_bits: int = 4, block: int = 4096, sample: int = 64) -> DataFrame:
    """Distinct links ``(a, b)`` that connect the fingerprints (column ``fp``, distinct) lying within ``max_bits``.

    ``block``: members of a bucket beyond which it is dealt as blocks; ``sample``:
    one in so many fingerprints (by hash) is counted to find such buckets. Both
    change only how the work is dealt, not the links' components.
    """
    # The fingerprints are a small table, their index rows are not: dealt before they are made, or a few tasks would make them all.
    fps = fps.repartition(partitions(fps.sparkSession), "fp")
    index = fps.select("fp", F.explode(_variant_keys(max_bits)).alias("key"))
    hot = fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(sample)) == 0).select(F.explode(_variant_keys(max_bits)).alias("key")).groupBy("key").count()
    hot = materialize(hot.where(F.col("count") * sample > block).select("key", F.ceil(F.col("count") * F.lit(sample / block)).cast("int").alias("nb")))
    number = hot.count()
    if number:
        hot = F.broadcast(hot) if number <= 100_000 else hot
        own = F.pmod(F.xxhash64("fp", F.lit(11)), F.coalesce("nb", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("nb", F.lit(1)) - 1))
        index = index.join(hot, "key", "left").select("fp", "key", own.alias("own"), other.alias("other"), "nb")
        pair = F.least("own", "other").cast("long") * F.coalesce("nb", F.lit(1)) + F.greatest("own", "other")
        index = index.select("key", pair.alias("blk"), "fp")
    else:
        index = index.select("key", F.lit(0).cast("long").alias("blk"), "fp")
    dealt = index.repartition("key", "blk").sortWithinPartitions("key", "blk", "fp")
    return dealt.mapInArrow(_bucket_links(max_bits), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _marked(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, text_hash, fp)`` and, for each fingerprint, ``(fp, root, low)``; both are scratch tables."""
    marked = materialize(with_fingerprints(docs, id_col, text_col, shingle))
    reps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    nodes = connected_components(link_fingerprints(reps.select("fp"), max_bits, block))
    grouped = reps.join(nodes, reps.fp == nodes.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    return marked, grouped


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, block: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``.

    component_id is the smallest doc_id reachable over links of at most
    ``max_bits`` differing bits. Null and empty texts have fingerprint 0 and are
    linked like any other. A null doc_id takes part but is never a smallest id
    (component_id is null only if no linked row has an id). Repeated rows keep a
    row each; extra columns are ignored; an empty table gives an empty result.
    """
    marked, grouped = _marked(docs, id_col, text_col, shingle, max_bits, block)
    roots = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    found = grouped.join(roots, "root").select("fp", "component_id")
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, block: int = 4096) -> DataFrame:
    """The rows of ``docs`` of one document per component, with all columns: the one with the smallest id.

    Null ids come last; equal ids go by the text's hash; of rows equal in id and
    text one stays. Texts cross the network once, to meet the list of what stays.
    """
    return one_of_each(docs, *_marked(docs, id_col, text_col, shingle, max_bits, block), id_col, text_col)


def one_of_each(docs: DataFrame, marked: DataFrame, grouped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that stay of the components ``grouped(fp, root)`` of the rows ``marked(doc_id, text_hash, fp)``."""
    # Copies are summed, then each fingerprint sends one row: a large group of either never meets in one task.
    rows = marked.groupBy("fp", "doc_id", "text_hash").count()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "count")
    each = rows.groupBy("fp").agg(F.min(order).alias("best"))
    best = each.join(grouped.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    twin, mark, number = fresh(docs, "twin", "mark", "number")
    best = materialize(best.select(F.col("best.doc_id").alias(twin), F.col("best.text_hash").alias(mark), F.col("best.count").alias(number)))
    same = docs[id_col].eqNullSafe(best[twin]) & (F.xxhash64(docs[text_col].cast("string")) == best[mark])
    if best.where(F.col(number) > 1).isEmpty():
        return docs.join(best, same, "left_semi")
    kept = docs.join(best.select(twin, mark), same)
    return kept.dropDuplicates([twin, mark]).select(*(docs[c] for c in docs.columns))


def op8_simhash(docs: DataFrame) -> DataFrame:
    """Contract digest: fingerprints as 16 hex digits, components by smallest doc_id."""
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
