"""Importance resampling towards a target distribution, on word-id suffix arrays.

Texts become sequences of word ids, slice by slice of each partition. Sorting the
positions by the words that follow gives a suffix array; where neighbours share
their first n words, the array has a run of the n-gram. Each run's n-gram is
hashed once, from the hash of its first n-1 words, and the bucket is
scattered back to the run's places. Run lengths give the bucket counts of the
corpus and of the target (a partial sum per partition, then one row per
bucket); places give the features of each document, whose mean gain is its
weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators import order
from .common import fresh, materialize
from .fim import _slices

#: Bytes of text that one suffix array covers; a longer text has its own.
SLICE_BYTES = 4 << 20

#: Bytes of words as they count, 0 for what parts them: A-Z become a-z, digits, a-z and all beyond ASCII stay.
_WORD = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def _large(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of texts, null as empty."""
    text = text.cast(pa.large_binary())
    if text.null_count:
        text = text.fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def word_ids(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """First word of each text (and the number of all), the id of each word, and the words by id."""
    offsets, data = _large(text)
    low = _WORD[data]
    inside = low > 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begin[at] = inside[at]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    ends = np.r_[np.flatnonzero(begin[inside]), int(inside.sum())].astype(np.int64)
    if not len(starts):
        return first, np.zeros(0, np.int64), []
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])]).dictionary_encode()
    return first, words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()


def suffix_array(first: np.ndarray, ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of the ``depth`` words that begin there, the number of leading words each shares with the one before, and the words left in its text (up to ``depth``)."""
    n = len(ids)
    last = np.repeat(first[1:], np.diff(first))
    left = np.minimum(last - np.arange(n), depth)
    ahead = [ids]
    for k in range(1, depth):
        ahead.append(np.where(left > k, np.r_[ids[k:], np.zeros(min(k, n), np.int64)][:n] + 1, 0))
    rank = ids
    for more in ahead[1:]:
        if rank is not ids:
            rank = np.unique(rank, return_inverse=True)[1]
        rank = rank * (int(more.max(initial=0)) + 1) + more
    place = np.argsort(rank, kind="stable")
    shared, same = np.zeros(n, np.int64), np.ones(max(0, n - 1), bool)
    for k in range(depth):
        own = ahead[k][place]
        same = same & (own[1:] == own[:-1]) & ((left[place][1:] > k) if k else True)
        shared[1:] += same
    return place, shared, left


@lru_cache(4096)
def _zeros(length: int) -> tuple[np.ndarray, ...]:
    """What ``length`` more bytes do to a checksum, as four tables by byte."""
    blank = bytes(length)
    base = zlib.crc32(blank)
    return tuple(np.array([zlib.crc32(blank, v << shift) ^ base for v in range(256)], np.uint32) for shift in (0, 8, 16, 24))


def _extended(crc: np.ndarray, word: np.ndarray, tails: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of the texts behind ``crc``, each followed by a blank and its word."""
    out, size = np.empty(len(crc), np.uint32), lengths[word]
    for length in np.unique(size):
        some = size == length
        c, (t0, t1, t2, t3) = crc[some], _zeros(int(length))
        out[some] = t0[c & 255] ^ t1[(c >> 8) & 255] ^ t2[(c >> 16) & 255] ^ t3[c >> 24]
    return out ^ tails[word]


def ngram_runs(first: np.ndarray, ids: np.ndarray, words: list[bytes], depth: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For n from 1 to ``depth``: the bucket of each run of n-grams, its length, and the bucket of the n-gram at each place (-1: none)."""
    if not len(ids):
        return
    place, shared, left = suffix_array(first, ids, depth)
    alone = np.array([zlib.crc32(w) for w in words], np.uint32)
    tails = np.array([zlib.crc32(b" " + w) for w in words], np.uint32)
    lengths = np.array([len(w) + 1 for w in words])
    at_place = alone[ids]
    for n in range(1, depth + 1):
        whole = left[place] >= n
        there, begins = place[whole], shared[whole] < n
        runs = np.flatnonzero(begins)
        said = there[runs]
        crc = alone[ids[said]] if n == 1 else _extended(at_place[said], ids[said + n - 1], tails, lengths)
        sizes = np.diff(np.r_[runs, len(there)])
        at_place = np.zeros(len(ids), np.uint32)
        at_place[there] = np.repeat(crc, sizes)
        bucket = np.full(len(ids), -1, np.int64)
        bucket[there] = at_place[there].astype(np.int64) % buckets
        yield crc.astype(np.int64) % buckets, sizes, bucket


def bucket_counts(docs: DataFrame, text_col: str = "text", depth: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Number of features of all texts by bucket: a row per bucket and partition travels, the driver gets one per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, rows in _slices(batch.column(0), SLICE_BYTES):
                for bucket, sizes, _ in ngram_runs(*word_ids(batch.column(0).slice(at, rows)), depth, buckets):
                    total += np.bincount(bucket, sizes, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-ratio of smoothed bucket shares, target over corpus, rounded down."""
    s_all, t_all, b = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((t + 1) * (s_all + b)) / ((s + 1) * (t_all + b)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, target: DataFrame, text_col: str = "text", depth: int = 2, buckets: int = 10_000) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features`` and ``weight`` (under other names where taken): the mean gain of the features, rounded down; 0 without features.

    Corpus and target counts cover all texts. Null texts have no words; repeated rows count as often as they occur and get equal weights.
    """
    table = gains(bucket_counts(docs, text_col, depth, buckets), bucket_counts(target, text_col, depth, buckets))
    taken = {c.lower() for c in docs.columns}
    names = [x if x not in taken else y for x, y in zip(("n_words", "n_features", "weight"), fresh(docs, "n_words", "n_features", "weight"), strict=True)]
    text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _slices(batch.column(text), SLICE_BYTES):
                part = batch.slice(at, rows)
                first, ids, words = word_ids(part.column(text))
                number, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
                for _, _, bucket in ngram_runs(first, ids, words, depth, buckets):
                    there = bucket >= 0
                    upto = lambda x: np.r_[0, np.cumsum(x)][first]
                    number += np.diff(upto(there))
                    total += np.diff(upto(np.where(there, table[bucket], 0)))
                mean = np.where(number > 0, total // np.maximum(number, 1), 0)
                yield pa.record_batch([*part.columns, pa.array(np.diff(first)), pa.array(number), pa.array(mean)], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructField(x, LongType()) for x in names)]))


def noise(ident: Column, seed: int = 7) -> Column:
    """Thousandths of a Gumbel number that the id and the seed decide; a null id counts as no digits."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """Scores of all rows and ranks of the drawn ones: ``id_col, n_features, weight, score, rank``.

    A score is the weight plus Gumbel noise, so the highest scores are a draw without replacement in
    proportion to exponential weights. Of the N rows with at least ``least_words`` words,
    floor(share * N / 100) are drawn; ties go to the smaller id, a null id comes last; among rows equal in score and
    id any may come first. Others have a null rank. An empty table gives an empty result. No task
    orders all rows.
    """
    weighed = weigh(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")), target.select(F.col(text_col).alias("text")))
    rows = materialize(weighed.select("i", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("i"), seed)).alias("score")))
    able, rest = rows.where(F.col("n_words") >= least_words), rows.where(F.col("n_words") < least_words)
    drawn = able.count() * share // 100
    placed = order.numbered(able, [-F.col("score"), F.col("i").isNull(), F.col("i")], "rank", slice_rows=2_000)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(rest.withColumn("rank", F.lit(None).cast("long"))).select(F.col("i").alias(id_col), "n_features", "weight", "score", "rank")


def op11_resampling(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract query of :func:`resample`, which says what nulls, empty texts, ties and repeated rows do; extra columns are ignored."""
    return resample(docs, benchmark)
