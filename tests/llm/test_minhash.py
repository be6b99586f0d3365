"""Near-duplicate documents against all pairs of exact five-word similarities."""

import random

import corpus_pipeline
from tallygrove.llm import minhash, simhash


def shingle_set(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def smallest_of_components(rows):
    sets, root = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}
    near = {i: [j for j in sets if similar(sets[i], sets[j])] for i in sets}
    while True:
        now = {i: min(root[j] for j in near[i]) for i in root}
        if now == root:
            return set(root.values())
        root = now


def test_pipeline_stage_reaches_a_similarity_of_0_8(spark, docs_of):
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows = []
    for _ in range(60):
        words = prose(rng.randrange(3, 200))
        rows.append((len(rows), " ".join(words)))
        for changes in (1, 2, 6):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((len(rows), " ".join(copy)))
    base = prose(150)
    for k in range(80):  # a bucket of many
        copy = list(base)
        copy[k] = f"x{k}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows), rows[7][1].upper()), (len(rows) + 1, ""), (len(rows) + 2, None), (len(rows) + 3, "\n")]
    docs = docs_of(rows)
    want = smallest_of_components(rows)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want
    # The digest's four bits leave many of these apart.
    assert simhash.keep_one(docs).count() > len(want) + 20


def test_odd_rows(spark, odd_docs):
    got = minhash.keep_one(odd_docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (False, 4), (False, 6), (True, 0)]
    assert got[0].__fields__ == odd_docs.columns
    assert minhash.keep_one(odd_docs.limit(0)).count() == 0


def test_simhash_links_near_copies_by_itself(spark, docs_of, monkeypatch):
    """With a single band of 400 values MinHash finds next to nothing."""
    rng = random.Random(3)
    rows = []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(1000)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:500], "changed", *words[501:]]))]
    docs = docs_of(rows)
    assert minhash.keep_one(docs, bands=1, band=400).count() < 35
    assert {r.doc_id for r in minhash.keep_one(docs).collect()} == set(range(0, 60, 2))
    monkeypatch.setattr(minhash, "simhash_pairs", lambda reps, max_bits: spark.createDataFrame([], "a long, b long"))
    assert minhash.keep_one(docs, bands=1, band=400).count() > 50


def test_pairs_within_four_bits_are_still_verified(spark):
    """Links hold of the fingerprint, not yet of the sets: equal SimHashes meet their least set, near ones that one."""
    reps = spark.createDataFrame([(5, 0), (3, 0), (9, 15), (4, 15), (7, -1), (8, 31 << 20)], "fp long, sim long")
    assert sorted(map(tuple, minhash.simhash_pairs(reps, 4).collect())) == [(3, 4), (3, 5), (4, 9)]
