"""The pipeline's stages against what they promise, and queries against their SQL."""

import re

import duckdb
import pytest

import corpus_pipeline
from tallygrove.llm import queries

SF = "/root/testdata/sf0.001"


def representatives(texts):
    """Smallest ids of the components of all pairs whose five-word shingles have a Jaccard similarity of 0.8; the stage's promise."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        k = min(5, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()

    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    near = {i: [j for j in sets if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in sets}
    while (now := {i: min(root[j] for j in near[i]) for i in root}) != root:
        root = now
    return sorted(set(root.values()))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from tallygrove.llm.common import materialize, table
    from tallygrove.llm import decontam, quality_classifier

    kept = materialize(corpus_pipeline.quality(spark, docs, SF))
    model = quality_classifier.train(docs, table(spark, SF, "labels"))
    scores = quality_classifier.score(docs, model, score_name="s")
    assert kept.count() == scores.where("s >= 0.3").count() < docs.count()
    single = materialize(corpus_pipeline.near_duplicates(spark, kept, SF))
    assert sorted(r.doc_id for r in single.collect()) == representatives({r.doc_id: r.text for r in kept.collect()})
    clean = materialize(corpus_pipeline.decontaminate(spark, single, SF))
    bench = table(spark, SF, "benchmark")
    assert decontam.op3_decontaminate(clean, bench).where("contaminated").count() == 0
    untouched = {r.doc_id for r in decontam.op3_decontaminate(single, bench).where("not contaminated").collect()}
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (single, clean))
    assert all(after[i] == before[i] for i in untouched)
    mixed = corpus_pipeline.mix_sources(spark, clean, SF)
    words = lambda d: sum(len(r.text.split()) for r in d.collect())
    assert abs(words(mixed) / words(clean) - 1.5) < 0.02
    sharded = corpus_pipeline.shard(spark, materialize(mixed), SF)
    assert sharded.columns == [*docs.columns, "shard", "slot"] and sharded.count() == mixed.count()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert len(got) > 50 and set(got.shard) <= set(range(16))


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    # Whole numbers with nulls come as floats from one side, as nullable integers from the other.
    plain = lambda c: c.astype("float64").astype(str) if c.dtype.kind in "iuf" else c.astype(str)
    key = lambda d: sorted(map(tuple, d[columns].apply(plain).values.tolist()))
    assert key(got) == key(want)
