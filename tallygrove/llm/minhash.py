"""Near-duplicate documents by SimHash, and by MinHash bands what its bits can't reach, verified by the exact Jaccard similarity of word shingles.

Copies collapse first. SimHash fingerprints that lie within four bits are found by their
one-wildcard segment variants. Pairs at a similarity of 0.8 differ in about ten bits, so texts that share
a MinHash band are candidates too. Each candidate is verified on the whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize
from .fim import _slices
from .simhash import link_fingerprints, one_of_each

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 17
#: Bytes of text whose sets are held at a time; a longer text goes alone.
_BYTES = 4 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """One round of a 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """A hash for each place, of the values that ``parts`` have there, in their order."""
    out = np.full(len(parts[0]), len(parts), dtype=np.uint64)
    for x in parts:
        out = mixed((out ^ x) * _MIX)
    return out


def band_keys(hashes: np.ndarray, sizes: np.ndarray, bands: int, band: int, some: list[int] | None = None) -> np.ndarray:
    """Keys (sets, bands; of bands only ``some``) of sets that lie one behind the other in ``hashes``; none may be empty.

    Each band is made of ``band`` least values, every one in an order of its own: two
    sets agree on a band with a probability of their similarity to the power ``band``.
    """
    factors = np.random.default_rng(17).integers(1 << 63, size=(bands, band), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    some = list(range(bands)) if some is None else some
    out, ends = np.empty((len(sizes), len(some)), dtype=np.uint64), np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begin = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
        part, starts = hashes[begin : int(ends[to - 1])], (ends[at:to] - sizes[at:to] - begin).astype(np.int64)
        for column, k in enumerate(some):
            key = np.full(to - at, k, dtype=np.uint64)
            for factor in factors[k]:
                key = mixed((key ^ np.minimum.reduceat(part * factor, starts)) * _MIX)
            out[at:to, column] = key
        at = to
    return out


def word_shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of ``shingle`` words, of all its words if it has fewer; ASCII capitals count as small letters."""
    words = _WORDS.findall(text.lower()) if text else []
    k, own = min(shingle, len(words)), np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return np.unique(chained([own[j : len(words) - k + 1 + j] for j in range(k)])) if k else own


def simhash(hashes: np.ndarray) -> int:
    """Unsigned SimHash of a set of hashes: a bit is 1 if it is set in over half of them; an empty set gives 0."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``_BYTES`` of text in column ``text``: sets take several times the bytes of their texts."""
    for batch in batches:
        for at, rows in _slices(batch.column(text), _BYTES):
            yield batch.slice(at, rows)


def _signed(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, band: int) -> DataFrame:
    """``(doc_id, text_hash, fp, sim, keys)`` for every row: fp names the shingle set, sim is its SimHash, keys are its bands; an empty set has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 2):
            sets = [word_shingles(x.as_py(), shingle) for x in batch.column(2).cast(pa.binary())]
            names = np.fromiter((xxhash.xxh64_intdigest(s.tobytes()) for s in sets), dtype=np.uint64, count=len(sets))
            sims = np.fromiter(map(simhash, sets), dtype=np.uint64, count=len(sets))
            full = np.array([len(s) for s in sets], dtype=np.int64)
            keys = band_keys(np.concatenate(sets), full[full > 0], bands, band) if full.any() else np.zeros((0, bands), dtype=np.uint64)
            offsets = np.r_[0, np.cumsum((full > 0) * bands)].astype(np.int32)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names.view(np.int64)), pa.array(sims.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))], names=["doc_id", "text_hash", "fp", "sim", "keys"])

    kind, text = docs.schema[id_col].dataType.simpleString(), F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, text_hash long, fp long, sim long, keys array<long>")


def _sets(docs: DataFrame, id_col: str, text_col: str, some: DataFrame, shingle: int) -> DataFrame:
    """``(lid, h)``: the shingle sets of the texts that ``some(lid, doc_id, text_hash)`` names, one row for each lid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, 1):
            sets = [pa.array(word_shingles(x.as_py(), shingle).view(np.int64)) for x in batch.column(1).cast(pa.binary())]
            offsets = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
            flat = pa.concat_arrays(sets) if sets else pa.array([], pa.int64())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["lid", "h"])

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("own"), text.alias("text"), F.xxhash64(text).alias("mark"))
    met = texts.join(some, texts["own"].eqNullSafe(some["doc_id"]) & (texts["mark"] == some["text_hash"]))
    return met.select("lid", "text").mapInArrow(run, "lid long, h array<long>").dropDuplicates(["lid"])


def simhash_pairs(reps: DataFrame, max_bits: int) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of the sets ``reps(fp, sim)`` that connect those whose SimHashes are linked within ``max_bits``.

    Sets of one SimHash meet the least of them, which stands for them in further links.
    """
    first = materialize(reps.groupBy("sim").agg(F.min("fp").alias("a")))
    equal = reps.join(first, "sim").where("a <> fp").select("a", F.col("fp").alias("b"))
    links = link_fingerprints(first.select(F.col("sim").alias("fp")), max_bits)
    side = lambda c, t: first.select(F.col("sim").alias(c), F.col("a").alias(t))
    near = links.join(side("a", "x"), "a").join(side("b", "y"), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    out = materialize(equal.unionByName(near))
    forget(first)
    return out


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, bands: int = 20, band: int = 6, max_bits: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc_id, text_hash, fp)`` and, for each fp, ``(fp, root)``: components of links of an exact Jaccard similarity of ``least`` or more."""
    from . import line_dedup

    marked = materialize(_signed(docs, id_col, text_col, shingle, bands, band))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    reps = materialize(marked.groupBy("fp").agg(F.min(place).alias("at"), F.any_value("sim").alias("sim"), F.any_value("keys").alias("keys")))
    near = simhash_pairs(reps.select("fp", "sim"), max_bits)
    met = line_dedup.meetings(reps.select(F.col("fp").alias("lid"), F.explode("keys").alias("key")))
    members = met.select("lid").union(near.select("a")).union(near.select("b")).select(F.col("lid").alias("fp")).distinct()
    some = materialize(reps.join(members, "fp").select(F.col("fp").alias("lid"), "at.doc_id", "at.text_hash"))
    sets = materialize(_sets(docs, id_col, text_col, some, shingle))
    large = lambda lids: line_dedup.sized(sets.join(lids, "lid", "left_semi"))
    roots = line_dedup.classes(met, lambda pairs: line_dedup.verified(pairs, sets, least), large, least, near)
    forget(*met._parts, some, sets, near)
    grouped = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return marked.select("doc_id", "text_hash", "fp"), grouped


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` of one document per class of similar ones, with all columns; which one, :func:`one_of_each` says."""
    return one_of_each(docs, *similar_classes(docs, id_col, text_col, **options), id_col, text_col)
