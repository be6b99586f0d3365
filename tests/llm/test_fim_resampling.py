"""Fill-in-middle and importance resampling against SQL and plain Python."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrove.llm import fim, queries, resampling

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def cut(i, text, seed=1):
    """Plain version: (n, form, prefix_chars, middle_chars, output)."""
    t = text or ""
    h = sha(f"{seed}:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_fim_query_is_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{SF}/documents.parquet'")
    got = queries.op13_fill_in_middle(spark, SF).toPandas()
    want = con.sql(queries.ORACLE_SQL["op13_fill_in_middle"]).df()
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and key(got) == key(want)


def test_fim_against_plain_python_and_round_trip(spark, docs_of, monkeypatch):
    rng = random.Random(4)
    texts = [None, "", "a", "<P>", "x<S>y", "a<M", "<P<S", "<", "é漢😀\x00\n" * 9, "ß<" * 40, "long " * 60_000, *("".join(rng.choice("ab<PSM> é😀\n") for _ in range(rng.randrange(60))) for _ in range(200))]
    rows = [*enumerate(texts), (None, "no id here"), (7, texts[7]), (7, "another text of one id")]
    docs = docs_of(rows).withColumns({c: F.lit(k) for k, c in enumerate(("n", "Form", "output", "c0", "_tg_text"))})
    got = fim.transform(docs)
    assert got.columns[: len(docs.columns)] == docs.columns and got.count() == len(rows)
    names = got.columns[len(docs.columns) :]
    made = got.select("doc_id", "text", *(F.col(c).alias(f"r{k}") for k, c in enumerate(names)))
    back = fim.restore(made, "r4", "r1").collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.r0, r.r1, r.r2, r.r3, r.r4) for r in back))) == sorted(map(str, ((i, t, *cut(i, t)) for i, t in rows)))
    assert all(r.restored == (r.text or "") for r in back)
    assert {r.r1 for r in back} == {"plain", "psm", "spm"}


def features(text):
    w = WORDS.findall((text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    return w + [a + b" " + b for a, b in zip(w, w[1:], strict=False)], len(w)


def scores(docs, bench):
    """Plain version: {row number: (doc_id, n_features, weight, score, rank)} of distinct ids."""
    s, t = [0] * 10_000, [0] * 10_000
    for rows, counts in ((docs, s), (bench, t)):
        for _, text in rows:
            for f in features(text)[0]:
                counts[zlib.crc32(f) % 10_000] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10_000) / ((x + 1) * (sum(t) + 10_000)))) for x, y in zip(s, t, strict=True)]
    out, able = [], []
    for i, text in docs:
        f, n = features(text)
        weight = sum(gain[zlib.crc32(x) % 10_000] for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= 20:
            able.append((-out[-1][3], i is None, i or 0, len(out) - 1))
    for k, x in enumerate(sorted(able)[: 25 * len(able) // 100]):
        out[x[3]][4] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_against_plain_python(spark):
    con = duckdb.connect()
    docs, bench = (con.sql(f"select {i}, text from '{SF}/{t}.parquet'").fetchall() for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = queries.op11_resampling(spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    assert sorted(map(tuple, got.collect()), key=str) == scores(docs, bench)


def test_resampling_on_odd_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE_BYTES", 64)
    rng = random.Random(6)
    pool = ["the", "A", "é", "ab12", "x" * 300, "漢字", "THE"]
    text = lambda n: "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for k in range(120)] + [(500, None), (501, ""), (502, " .,"), (None, text(40)), (503, text(20_000))]
    bench = [(1, text(30)), (2, None), (None, "the the"), (3, "")]
    target = spark.createDataFrame(bench, "item_id long, text string")
    wide = docs_of(docs).withColumns({c: F.lit(1) for c in ("weight", "n_words", "i", "rank")})
    assert sorted(map(tuple, resampling.op11_resampling(wide, target).collect()), key=str) == scores(docs, bench)
    assert resampling.op11_resampling(wide.limit(0), target).count() == 0
    assert resampling.op11_resampling(wide, target.limit(0)).where("weight <> 0").count() > 0
    kept = resampling.weigh(wide, target)
    assert kept.columns[: len(wide.columns)] == wide.columns and kept.count() == len(docs)
    # Rows equal in id and text are counted and placed like others.
    twice = resampling.op11_resampling(docs_of([(1, docs[-1][1])] * 8), target).collect()
    assert sorted(r["rank"] or 0 for r in twice) == [0] * 6 + [1, 2] and len({(r.weight, r.score) for r in twice}) == 1


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_runs_are_the_ngrams(depth):
    import pyarrow as pa

    rng = random.Random(depth)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "é"]) for _ in range(rng.randrange(12))) for _ in range(40)] + [None, ""]
    first, ids, words = resampling.word_ids(pa.array(texts).slice(3))
    want = [{} for _ in range(depth)]
    for t in texts[3:]:
        w = (t or "").encode().split()
        for n in range(1, depth + 1):
            for k in range(len(w) - n + 1):
                g = b" ".join(w[k : k + n])
                want[n - 1][g] = want[n - 1].get(g, 0) + 1
    for n, (bucket, sizes, there) in enumerate(resampling.ngram_runs(first, ids, words, depth, 1 << 40)):
        assert sorted(zip(bucket.tolist(), sizes.tolist(), strict=True)) == sorted((zlib.crc32(g), c) for g, c in want[n].items())
        assert (there >= 0).sum() == sizes.sum() and np.array_equal(np.unique(there[there >= 0]), np.unique(bucket))
