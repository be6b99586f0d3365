"""Exact substring deduplication by a distributed merge sort of suffixes.

A window is a string of ``length`` bytes. Bytes go that lie in a window which also
begins in a document with a smaller id. Three rounds, each over chunks of about
eight megabytes of text that a bucketed table keeps together, so that the texts
are dealt once and never shuffled:

1. Anchors. In every window the least-hashed string of ``gram`` bytes is its
   anchor; equal windows have equal anchors at equal places. Chunks send the
   hashes of their anchors, each once with its number of documents, and learn which
   occur in two documents or more. Only suffixes at those can matter.
2. Suffixes. Each chunk sorts the suffixes at its shared anchors (as far as the
   anchor's windows reach), keeps equal ones once with their least document, and sends
   them as front-coded runs: the length of the prefix shared with the suffix before, and
   the rest. Runs are merged by a loser tree whose players carry the length of the prefix
   they share with the last winner: unequal lengths decide a match alone, and equal
   ones go on from there, so no known prefix is compared again. The lengths that come out
   are those of the merged order; with the order of what stands before the anchors they
   say which windows are equal, and the least document of each goes back to the chunks.
3. Removal. Chunks mark the windows whose least document is smaller than their own.

Nothing is gathered by key: a string that a third of all documents hold travels
once a chunk, and anchors of very many documents (``hot_docs``) have their windows
dealt one by one instead of as a group.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, partitions, scratch_dir
from .fim import _slices
from .resampling import _large

#: Bytes whose hashes are held at a time, bytes of a chunk, and suffixes that are sorted at a time.
SLICE_BYTES, CHUNK_BYTES, SORT_ROWS = 1 << 18, 8 << 20, 100_000
_M = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    """``x``, changed in place, so that all its bits depend on all."""
    x ^= x >> np.uint64(32)
    x *= _M[2]
    x ^= x >> np.uint64(29)
    x *= _M[3]
    x ^= x >> np.uint64(32)
    return x


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place, read eight at a time; the last eight may overlap those before."""
    n = len(data) - gram + 1
    padded = np.r_[data, np.zeros(8, np.uint8)]
    eight = np.ndarray((len(data),), "<u8", padded, strides=(1,)).copy()
    if gram < 8:
        return _mixed((eight[:n] & np.uint64((1 << 8 * gram) - 1)) * _M[0])
    out = eight[:n] * _M[0]
    for at in sorted({*range(8, gram - 7, 8), gram - 8} - {0}):
        out ^= out >> np.uint64(32)
        out += eight[at : at + n]
        out *= _M[1]
    out ^= out >> np.uint64(32)
    return out


@dataclass
class Anchors:
    """Anchors of a chunk in text order: hash, place, first window, number of windows, row."""

    hash: np.ndarray
    place: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    row: np.ndarray


def anchors(text: pa.Array, offsets: np.ndarray, data: np.ndarray, length: int, gram: int) -> Anchors:
    """Every window of every text has one anchor: the leftmost of its least-hashed grams."""
    wide, found = length - gram + 1, []
    for at, rows in _slices(text, SLICE_BYTES):
        low, high = int(offsets[at]), int(offsets[at + rows])
        if high - low < length:
            continue
        hashes = _gram_hashes(data[low:high], gram)
        least = (hashes >> np.uint64(31) << np.uint64(31)) | np.arange(len(hashes), dtype=np.uint64)
        step = 1
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < wide:
            least = np.minimum(least[: step - wide], least[wide - step :])
        where = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
        # Windows that do not cross the end of their text.
        own = offsets[at : at + rows + 1] - low
        whole = np.maximum(np.diff(own) - length + 1, 0)
        starts = np.repeat(own[:-1] - np.r_[0, np.cumsum(whole)[:-1]], whole) + np.arange(whole.sum())
        if not len(starts):
            continue
        place = where[starts]
        begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        found.append((hashes[place[begins]], place[begins] + low, starts[begins] + low, np.diff(np.r_[begins, len(place)]), at + np.repeat(np.arange(rows), whole)[begins]))
    empty = np.zeros(0, np.int64)
    return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Anchors(empty.astype(np.uint64), *[empty] * 4)


def _key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each hash in one number; other anchors of the same key are taken as shared, which costs time only."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of lists one after the other, and the row of each."""
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks if len(c)]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks if len(c)]) if values else np.zeros(0, np.int64)
    return (np.concatenate(values) if values else np.zeros(0, np.int64)), np.repeat(np.arange(len(sizes)), sizes)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows in sorted columns."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])


def _ask(uid: int, a: Anchors, buckets: int) -> pa.Table:
    """Keys of a chunk's anchors by bucket, each once with its number of rows."""
    key = _key(a.hash, buckets)
    order = np.lexsort((a.row, key))
    pairs = key[order][_groups(key[order], a.row[order])]
    at = _groups(pairs)
    key, rows = pairs[at], np.diff(np.r_[at, len(pairs)])
    bucket = key >> 32
    cut = _groups(bucket)
    ends = np.r_[cut[1:], len(key)] if len(cut) else cut
    return pa.table({"bucket": pa.array(bucket[cut].astype(np.int32)), "uid": pa.array(np.full(len(cut), uid)), "part": _lists((key & 0xFFFFFFFF).astype(np.uint32).view(np.int32), ends, pa.int32()), "rows": _lists(rows.astype(np.int32), ends, pa.int32())})


def _answer_shared(table: pa.Table, hot_docs: int) -> pa.Table:
    """To each chunk of a bucket: its keys that occur in two rows or more, and of these the hot ones as negative numbers."""
    part, run = _flat(table.column("part"))
    rows, _ = _flat(table.column("rows"))
    order = np.argsort(part, kind="stable")
    at = _groups(part[order])
    total = np.repeat(np.add.reduceat(rows[order].astype(np.int64), at), np.diff(np.r_[at, len(order)])) if len(order) else rows
    bucket = int(table.column("bucket")[0].as_py()) if len(order) else 0
    shared = total > 1
    kept = order[shared]
    key = part[kept].view(np.uint32).astype(np.int64) | bucket << 32
    key = np.where(total[shared] > hot_docs, ~key, key)
    by = np.argsort(run[kept], kind="stable")
    run, key = run[kept][by], key[by]
    cut = _groups(run)
    uids = table.column("uid").to_numpy()
    return pa.table({"uid": pa.array(uids[run[cut]]), "keys": _lists(key, np.r_[cut[1:], len(key)] if len(cut) else cut, pa.int64())})


def _padded(view: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes, zero from ``size`` on, to ``width`` columns (a multiple of eight)."""
    out = np.zeros((len(view), width), np.uint8)
    out[:, : view.shape[1]] = view
    out[np.arange(width) >= size[:, None]] = 0
    return out


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Eight bytes at a time as numbers of the same order, first ones first."""
    return [np.ascontiguousarray(rows[:, k : k + 8]).view(">u8").reshape(-1).astype(np.uint64) for k in range(0, rows.shape[1], 8)]


def _shared_prefix(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        least = np.minimum(size[1:], size[:-1])
        out[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1]), least)
    return out


@dataclass
class Suffixes:
    """Suffixes at a chunk's shared anchors, sorted by bucket, then bytes; equal ones are one element.

    ``right`` from the anchor on, ``left`` before it, read backwards; ``element`` of each occurrence
    (``first`` window, ``row``) counts from 0; ``begin`` has the first occurrence of each element.
    """

    bucket: np.ndarray
    right: np.ndarray
    right_size: np.ndarray
    left: np.ndarray
    left_size: np.ndarray
    element: np.ndarray
    begin: np.ndarray
    first: np.ndarray
    row: np.ndarray


def suffixes(a: Anchors, data: np.ndarray, keys: np.ndarray, buckets: int, merge_buckets: int, length: int, gram: int) -> Iterator[Suffixes]:
    """Sorted, collapsed suffixes of the anchors with one of ``keys`` (complemented: hot, so that each window goes alone).

    They come in parts of whole buckets with about ``SORT_ROWS`` occurrences each, so that memory does not depend on how much is shared.
    """
    wide, own = length - gram + 1, _key(a.hash, buckets)
    calm, hot = np.isin(own, keys[keys >= 0]), np.isin(own, ~keys[keys < 0])
    place, first, windows, row, hashes = (x[calm] for x in (a.place, a.first, a.windows, a.row, a.hash))
    if hot.any():
        number = a.windows[hot]
        single = np.repeat(a.first[hot] - np.r_[0, np.cumsum(number)[:-1]], number) + np.arange(number.sum())
        view = np.lib.stride_tricks.sliding_window_view(data, length)
        odd = np.random.default_rng(1).integers(0, 1 << 63, length, np.uint64) * np.uint64(2) + np.uint64(1)
        said = np.concatenate([_mixed((view[single[k : k + 8192]] * odd).sum(axis=1, dtype=np.uint64)) for k in range(0, len(single), 8192)])
        place, first, windows = np.r_[place, single], np.r_[first, single], np.r_[windows, np.ones(len(single), np.int64)]
        row, hashes = np.r_[row, np.repeat(a.row[hot], number)], np.r_[hashes, said]
    bucket = ((hashes >> np.uint64(17)) % np.uint64(merge_buckets)).astype(np.int64)
    ahead = np.lib.stride_tricks.sliding_window_view(np.r_[data, np.zeros(length, np.uint8)], length)
    behind = np.lib.stride_tricks.sliding_window_view(np.r_[np.zeros(wide, np.uint8), data], wide)
    width = lambda n: -(-n // 8) * 8
    parts = min(merge_buckets, -(-len(bucket) // SORT_ROWS))
    part = bucket * parts // merge_buckets
    for p in range(parts):
        some = np.flatnonzero(part == p)
        at, begins, rows, own_bucket = place[some], first[some], row[some], bucket[some]
        right_size, left_size = begins + windows[some] - 1 + length - at, at - begins
        right = _padded(ahead[at], right_size, width(length))
        left = _padded(behind[at][:, ::-1], left_size, width(wide))
        columns = [own_bucket, *_words(right), right_size, *_words(left), left_size]
        order = np.lexsort((begins, *columns[::-1]))
        begin = _groups(*(c[order] for c in columns))
        element = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(order)]))
        once = order[begin]
        yield Suffixes(own_bucket[once], right[once], right_size[once], left[once], left_size[once], element, begin, begins[order], rows[order])


def _front_coded(uid: int, s: Suffixes, ids: np.ndarray) -> pa.Table:
    """A run for each bucket: prefix lengths, rests, what stands before, and the least and largest id of each element."""
    at = _groups(s.bucket)
    ends = np.r_[at[1:], len(s.bucket)] if len(at) else at
    shared = _shared_prefix(s.right, s.right_size)
    shared[at] = 0
    column = np.arange(s.right.shape[1])
    rest = s.right[(column >= shared[:, None]) & (column < s.right_size[:, None])]
    before = s.left[np.arange(s.left.shape[1]) < s.left_size[:, None]]
    binary = lambda data, sizes: pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)[ends - 1]].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))]) if len(at) else pa.array([], pa.binary())
    one = np.ones(len(shared), np.int64)
    some = ids[s.row]
    least, most = (f.reduceat(some, s.begin) if len(s.begin) else some for f in (np.minimum, np.maximum))
    return pa.table({
        "bucket": pa.array(s.bucket[at].astype(np.int32)), "uid": pa.array(np.full(len(at), uid)), "shared": binary(shared.astype(np.uint8), one), "size": binary(s.right_size.astype(np.uint8), one), "rest": binary(rest, s.right_size - shared),
        "before_size": binary(s.left_size.astype(np.uint8), one), "before": binary(before, s.left_size), "least": _lists(least, ends, pa.int64()), "most": _lists(most, ends, pa.int64()),
    })


def decoded(shared: bytes, size: bytes, rest: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, last, at = [], b"", 0
    for keep, n in zip(shared, size, strict=True):
        upto = at + n - keep
        last = last[:keep] + rest[at:upto]
        out.append(last)
        at = upto
    return out


def merge_runs(runs: list[list[bytes]], shared: list[bytes]) -> tuple[list[int], list[int]]:
    """Run of each suffix in merged order, and the length of the prefix it shares with the one before.

    A loser tree: each inner node keeps the loser of its match. ``known[k]`` is the length of the prefix
    that run k's head shares with the last winner (for losers: with the one that beat them, which is the same on the winner's
    path). The longer known prefix wins unseen; equal ones are compared from there on. A run that ended has -1.
    """
    count = 1
    while count < len(runs):
        count *= 2
    head, at, known = [b""] * count, [0] * count, [-1] * count
    for k, run in enumerate(runs):
        if run:
            head[k], known[k] = run[0], 0

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser."""
        kx, ky = known[x], known[y]
        if kx != ky:
            return (x, y) if kx > ky else (y, x)
        if kx < 0:
            return x, y
        a, b = head[x][kx:], head[y][kx:]
        if a == b:
            known[y] = kx + len(b)
            return x, y
        n = min(len(a), len(b))
        off = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
        same = kx + n - (off.bit_length() + 7) // 8
        if a < b:
            known[y] = same
            return x, y
        known[x] = same
        return y, x

    loser, winners = [0] * count, list(range(count))
    level = count
    while level > 1:
        level //= 2
        for node in range(level):
            winners[node], loser[level + node] = play(winners[2 * node], winners[2 * node + 1])
    best, order, prefix = winners[0], [], []
    while known[best] >= 0:
        order.append(best)
        prefix.append(known[best])
        at[best] += 1
        if at[best] < len(runs[best]):
            head[best], known[best] = runs[best][at[best]], shared[best][at[best]]
        else:
            known[best] = -1
        node, own = (best + count) // 2, known[best]
        while node:
            other = loser[node]
            its = known[other]
            if own < its:
                loser[node], best, own = best, other, its
            elif own == its:
                best, loser[node] = play(best, other)
                own = known[best]
            node //= 2
    return order, prefix


def _answer_least(table: pa.Table, length: int, gram: int) -> pa.Table:
    """To each run: the least ids of its elements' windows, where an element has a larger one, as stretches of equal ids."""
    runs = [decoded(*x) for x in zip(*(table.column(c).to_pylist() for c in ("shared", "size", "rest")), strict=True)]
    order, prefix = merge_runs(runs, table.column("shared").to_pylist())
    run, prefix = np.array(order, np.int64), np.array(prefix, np.int64)
    # From the merged order to the elements of the runs one after the other.
    sizes = np.array([len(x) for x in runs], np.int64)
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    by_run = np.argsort(run, kind="stable")
    source = np.empty(len(run), np.int64)
    source[by_run] = np.arange(len(run))  # runs are merged in their own order
    (least, owner), (most, _) = _flat(table.column("least")), _flat(table.column("most"))
    joined = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8)
    right_size, left_size = joined("size").astype(np.int64)[source], joined("before_size").astype(np.int64)[source]
    raw, ends = joined("before"), np.cumsum(joined("before_size").astype(np.int64))
    wide, n = length - gram + 1, len(source)
    padded = np.r_[raw, np.zeros(wide, np.uint8)]
    starts = (ends - joined("before_size"))[source]
    left = _padded(np.lib.stride_tricks.sliding_window_view(padded, wide)[starts], left_size, -(-wide // 8) * 8)
    left_order = np.lexsort((left_size, *_words(left)[::-1]))
    left_prefix = _shared_prefix(left[left_order], left_size[left_order])
    least, most = least[source], most[source]
    out: list[tuple[np.ndarray, ...]] = []
    for o in range(wide):  # windows that begin o bytes before their anchor
        some = np.flatnonzero((length - right_size <= o) & (o <= left_size))
        if not len(some):
            continue
        right_id = np.cumsum(prefix < length - o)
        left_id = np.empty(n, np.int64)
        left_id[left_order] = np.cumsum(left_prefix < o) if o else 0
        key = right_id[some] * (n + 1) + left_id[some]
        by = np.argsort(key, kind="stable")
        at = _groups(key[by])
        value = np.repeat(np.minimum.reduceat(least[some[by]], at), np.diff(np.r_[at, len(by)]))
        kept = value < most[some[by]]
        out.append((source[some[by]][kept], left_size[some[by]][kept] - o, value[kept]))
    element, window, value = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0, np.int64)] * 3
    by = np.lexsort((window, element))
    element, window, value = element[by], window[by], value[by]
    at = np.flatnonzero(np.r_[True, (element[1:] != element[:-1]) | (value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1)]) if len(element) else element
    number = np.diff(np.r_[at, len(element)])
    element, window, value = element[at], window[at], value[at]
    cut = _groups(owner[element])
    end = np.r_[cut[1:], len(element)] if len(cut) else cut
    which = owner[element[cut]]
    return pa.table({
        "uid": pa.array(table.column("uid").to_numpy()[which]), "keys": _lists(np.zeros(0, np.int64), np.zeros(len(cut)), pa.int64()), "bucket": pa.array(table.column("bucket").to_numpy()[which].astype(np.int32)),
        "element": _lists(element - base[owner[element]], end, pa.int64()), "window": _lists(window, end, pa.int64()), "number": _lists(number, end, pa.int64()), "least": _lists(value, end, pa.int64()),
    })


def _told(answers: pa.Table) -> list[np.ndarray]:
    """Element, window, number, least id and bucket of each stretch of windows."""
    (element, part), *others = (_flat(answers.column(c)) for c in ("element", "window", "number", "least"))
    return [element, *(x for x, _ in others), answers.column("bucket").to_numpy()[part] if len(part) else part]


def _doomed(s: Suffixes, told: list[np.ndarray], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of windows to remove begin and end, for the buckets of ``s``."""
    element, window, number, least, bucket = told
    own = np.isin(bucket, s.bucket[_groups(s.bucket)])
    element, window, number, least, bucket = (x[own] for x in (element, window, number, least, bucket))
    element = element + np.searchsorted(s.bucket, bucket, side="left")
    begin, end = s.begin, np.r_[s.begin[1:], len(s.element)]
    times = (end - begin)[element] if len(element) else element
    piece = np.repeat(np.arange(len(element)), times)
    occurrence = np.repeat(begin[element] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum()) if len(element) else element
    later = ids[s.row[occurrence]] > least[piece]
    piece, occurrence = piece[later], occurrence[later]
    start = s.first[occurrence] + window[piece]
    return start, start + number[piece] - 1 + length


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", hot_docs: int = 1_000_000, bucketed: bool = True) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay) and ``spans`` (the removed runs as byte ranges, end exclusive), under other names where taken.

    A byte of the UTF-8 text goes if it lies in a string of ``length`` bytes that also begins in a row with a smaller
    (integer) id. Strings are judged on the input and never cross rows. Rows of one id do not
    remove each other's bytes; null ids count as the largest number; null texts as empty; kept
    bytes may begin or end within a character. Every row and all columns stay; an empty table gives an empty result. What a task
    holds is its chunk and about 60 bytes for each byte of a text that is longer than a slice. ``bucketed`` needs a session
    catalogue that takes bucketed Parquet tables; without it chunks are dealt in each round, with equal results.
    """
    spark = docs.sparkSession
    ident, uid, key = fresh(docs, "row", "chunk", "order")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    taken = {c.lower() for c in docs.columns}
    names = [x if x not in taken else y for x, y in zip(("kept", "spans"), fresh(docs, "kept", "spans"), strict=True)]
    if not rows:
        return docs.withColumns({names[0]: F.lit(b""), names[1]: F.array().cast("array<struct<start:bigint,end:bigint>>")})
    shift = max(0, int(CHUNK_BYTES * rows / max(1, size)).bit_length() - 1)
    shift = min(shift, max(0, (rows // partitions(spark)).bit_length()))
    chunked = docs.withColumns({ident: F.monotonically_increasing_id(), key: F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))}).withColumn(uid, F.shiftright(ident, shift))
    source = _bucketed(chunked, uid, min(100_000, max(partitions(spark), size // (4 * CHUNK_BYTES)))) if bucketed else materialize(chunked)
    buckets = int(max(partitions(spark), size >> 26))
    held = [source.columns.index(c) for c in (uid, ident, key, text_col)]

    def chunk(table: pa.Table) -> tuple[int, pa.Table, np.ndarray, Anchors, np.ndarray, np.ndarray]:
        table = table.take(pa.array(np.argsort(table.column(held[1]).to_numpy(), kind="stable"))).combine_chunks()
        said = table.column(held[3])
        said = said.chunk(0) if said.num_chunks else pa.array([], said.type)
        offsets, data = _large(said)
        return table.column(held[0])[0].as_py(), table, table.column(held[2]).to_numpy(), anchors(said, offsets, data, length, gram), offsets, data

    def ask(table: pa.Table) -> pa.Table:
        number, _, _, a, _, _ = chunk(table)
        return _ask(number, a, buckets)

    asked = source.groupBy(uid).applyInArrow(ask, "bucket int, uid long, part array<int>, rows array<int>")
    shared = materialize(asked.groupBy("bucket").applyInArrow(lambda t: _answer_shared(t, hot_docs), "uid long, keys array<long>"))
    number = shared.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    merge_buckets = int(max(partitions(spark), number >> 17))

    def known(answers: pa.Table) -> np.ndarray:
        return _flat(answers.column("keys"))[0].astype(np.int64)

    def sort(left: pa.Table, right: pa.Table) -> pa.Table:
        nothing = pa.table({c: pa.array([], t) for c, t in (("bucket", pa.int32()), ("uid", pa.int64()), *((x, pa.binary()) for x in ("shared", "size", "rest", "before_size", "before")), ("least", pa.list_(pa.int64())), ("most", pa.list_(pa.int64())))})
        if not left.num_rows or not right.num_rows:
            return nothing
        number, _, ids, a, _, data = chunk(left)
        parts = [_front_coded(number, s, ids) for s in suffixes(a, data, known(right), buckets, merge_buckets, length, gram)]
        return pa.concat_tables(parts) if parts else nothing

    runs = source.groupBy(uid).cogroup(shared.groupBy("uid")).applyInArrow(sort, "bucket int, uid long, shared binary, size binary, rest binary, before_size binary, before binary, least array<long>, most array<long>")
    answers = materialize(runs.groupBy("bucket").applyInArrow(lambda t: _answer_least(t, length, gram), "uid long, keys array<long>, bucket int, element array<long>, window array<long>, number array<long>, least array<long>"))
    both = answers.unionByName(shared, allowMissingColumns=True)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        _, table, ids, a, offsets, data = chunk(left)
        gone = np.zeros(len(data), bool)
        told = right.filter(pc.is_valid(right.column("bucket")))
        if told.num_rows:
            found, stretches = _told(told), []
            for s in suffixes(a, data, known(right), buckets, merge_buckets, length, gram):
                stretches.append(_doomed(s, found, ids, length))
            edges = np.zeros(len(data) + 1, np.int32)
            for start, end in stretches:
                np.add.at(edges, start, 1)
                np.add.at(edges, end, -1)
            gone = np.cumsum(edges, dtype=np.int32)[:-1] > 0
        # Edges of removed runs, none of which crosses the end of a text.
        starts_row = np.zeros(len(data) + 1, bool)
        starts_row[offsets] = True
        before = np.r_[False, gone[:-1]] & ~starts_row[:-1] if len(data) else gone
        begin = np.flatnonzero(gone & ~before)
        after = np.r_[gone[1:], False] & ~starts_row[1:] if len(data) else gone
        end = np.flatnonzero(gone & ~after) + 1
        row = np.searchsorted(offsets, begin, side="right") - 1
        upto = np.searchsorted(begin, offsets, side="left")
        spans = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - offsets[row]), pa.array(end - offsets[row])], names=["start", "end"]))
        stays = np.r_[0, np.cumsum(~gone)][offsets].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(stays), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        out = table.drop_columns([ident, uid, key])
        return out.append_column(names[0], kept).append_column(names[1], spans)

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        return remove(left, right) if left.num_rows else empty.to_arrow()

    empty = _Empty(docs.schema, names)
    return source.groupBy(uid).cogroup(both.groupBy("uid")).applyInArrow(final, empty.schema)


class _Empty:
    """Schema of the result, and a table of it without rows."""

    def __init__(self, own, names: list[str]):
        from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

        span = StructType([StructField("start", LongType()), StructField("end", LongType())])
        self.schema = StructType([*own.fields, StructField(names[0], BinaryType()), StructField(names[1], ArrayType(span))])

    def to_arrow(self) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(self.schema).empty_table()


def _bucketed(df: DataFrame, by: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``by``: groups of ``by`` are read together without an exchange, as often as needed."""
    spark = df.sparkSession
    name = f"tallygrove_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", f"{scratch_dir(spark)}/tallygrove/{name}").saveAsTable(name)
    out = spark.table(name)
    # The plan keeps the files and their buckets; the catalogue needs no entry for them.
    spark.sql(f"DROP TABLE {name}")
    return out


def op12_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Contract digest of :func:`remove_repeats`, which says what nulls, empty texts, ties and repeated rows do; extra columns are ignored."""
    done = remove_repeats(docs.select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return done.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
