"""Suffix deduplication against brute force, and the merge against sorting."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def marks(docs, length):
    """Plain version: for each (id, bytes) which bytes go; a null id is the largest."""
    key = lambda i: (i is None, i or 0)
    least = {}
    for i, t in docs:
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            least[w] = min(least.get(w, key(i)), key(i))
    out = []
    for i, t in docs:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p : p + length]] < key(i):
                gone[p : p + length] = b"\1" * length
        out.append(gone)
    return out


def rest(t, gone):
    kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
    edges = [k for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])]
    return kept, [(k, next((e for e in range(k, len(t)) if not gone[e]), len(t))) for k in edges]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op12_suffix_dedup(spark, SF).collect()}
    assert len(got) == len(docs)
    removed = 0
    for (i, t), gone in zip(docs, marks(docs, 50), strict=True):
        kept, spans = rest(t, gone)
        removed += sum(gone)
        assert tuple(got[i]) == (i, len(t), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()), i
    assert removed > 10_000


@pytest.mark.parametrize(("length", "gram", "hot"), [(7, 3, 10_000), (7, 3, 2), (9, 8, 10_000), (8, 1, 3), (50, 20, 1), (50, 16, 10_000), (5, 5, 10_000)])
def test_small_alphabets(spark, docs_of, monkeypatch, length, gram, hot):
    """Many ties, chunks of few rows, hot anchors, nulls, repeated ids and rows, bytes that look like padding."""
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "SORT_ROWS", 40)
    rng = random.Random(length * 100 + gram + hot)
    pool = ["a", "b", "\x00", "é"] if length < 50 else ["ab", "cd ", "\x00", "é", "\n"]
    draw = lambda n: "".join(rng.choice(pool) for _ in range(n))
    shared = [draw(rng.choice([6, 30, 80])) for _ in range(6)]
    rows = []
    for k in range(90):
        text = draw(rng.choice([0, 1, 8, 20])) + rng.choice(shared)[rng.randrange(4) :] + draw(rng.choice([0, 3]))
        rows.append((rng.choice([k, k, 7, None, -k]), rng.choice([text, text, text, None, "", "\x00" * 60])))
    rows += [rows[3]] * 3 + [(1000, shared[0] * 40), (-500, "a" * 200)]
    docs = docs_of(rows, parts=5).withColumns({c: F.lit(k) for k, c in enumerate(("kept", "bucket", "uid", "_tg_row", "keys"))})
    got = suffix_dedup.remove_repeats(docs, length, gram, hot_docs=hot, bucketed=gram != 8)
    assert got.columns[: len(docs.columns)] == docs.columns
    names = got.columns[len(docs.columns) :]
    have = [(r.doc_id, (r.text or "").encode(), bytes(r[names[0]]), [tuple(s) for s in r[names[1]]]) for r in got.collect()]
    plain = [(i, (t or "").encode()) for i, t in rows]
    want = [(i, t, *rest(t, gone)) for (i, t), gone in zip(plain, marks(plain, length), strict=True)]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert suffix_dedup.remove_repeats(docs.limit(0), length, gram).count() == 0
    assert suffix_dedup.op12_suffix_dedup(docs.limit(0)).count() == 0


def test_long_text_beside_short_ones(spark, docs_of):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(3_000_000))
    got = {r.doc_id: r for r in suffix_dedup.op12_suffix_dedup(docs_of([(5, long), (1, long[1_000_000:1_000_400]), (2, "x" + long[-60:]), (9, long)])).collect()}
    assert got[5].n_removed == 460 and got[5].n_spans == 2 and got[9].n_removed == 3_000_000 and got[1].n_removed == got[2].n_removed == 0


def test_merge_is_sorting():
    rng = random.Random(2)
    for count in (1, 2, 3, 7, 16, 33):
        runs = [sorted(bytes(rng.choice(b"\x00ab") for _ in range(rng.randrange(9))) for _ in range(rng.choice([0, 1, 40]))) for _ in range(count)]
        common = lambda x, y: len(os.path.commonprefix([x, y]))
        shared = [bytes([0, *(common(x, y) for x, y in zip(r, r[1:], strict=False))][: len(r)]) for r in runs]
        for run, keep in zip(runs, shared, strict=True):
            assert suffix_dedup.decoded(keep, bytes(map(len, run)), b"".join(x[k:] for x, k in zip(run, keep, strict=True))) == run
        order, prefix = suffix_dedup.merge_runs(runs, shared)
        heads, got = [iter(r) for r in runs], []
        got = [next(heads[k]) for k in order]
        assert got == sorted(x for r in runs for x in r)
        assert prefix == [0, *(common(x, y) for x, y in zip(got, got[1:], strict=False))][: len(got)]
