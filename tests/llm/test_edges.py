"""Every operator and stage on nulls, empties, long texts, repeated rows, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallygrove.llm import decontam, fim, line_dedup, mixing, pii, quality_classifier, quality_rules, resampling, secrets_crf, sharding, simhash, suffix_dedup, warc


def bench(spark):
    return spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (None, "a null id of ten words that no text here holds at all"), (2, None), (3, "")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (6, 1, 0), (5, 0, None)], "doc_id long, quality int, toxic int")


OPS = {
    "op1": lambda s, d: quality_classifier.op1_quality_classifier(d, labels(s)),
    "op2": lambda s, d: sharding.op2_sharding(d),
    "op3": lambda s, d: decontam.op3_decontaminate(d, bench(s)),
    "op4": lambda s, d: pii.op4_pseudonyms(d),
    "op5": lambda s, d: quality_rules.op5_quality_rules(d),
    "op6": lambda s, d: secrets_crf.op6_secrets(d),
    "op7": lambda s, d: line_dedup.op7_line_dedup(d),
    "op8": lambda s, d: simhash.op8_simhash(d),
    "op10": lambda s, d: mixing.op10_mixing(d),
    "op11": lambda s, d: resampling.op11_resampling(d, bench(s)),
    "op12": lambda s, d: suffix_dedup.op12_suffix_dedup(d),
    "op13": lambda s, d: fim.op13_fill_in_middle(d),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_per_row(spark, odd_docs, name):
    rows = OPS[name](spark, odd_docs).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in rows) == [-1, -1, 1, 1, 2, 3, 4, 5, 6, 7]
    # Neither extra columns nor the dealing of rows changes any value.
    plain = OPS[name](spark, odd_docs.select("doc_id", "text", "lang", "source", "n_chars").repartition(5))
    assert plain.columns == list(rows[0].asDict()) and sorted(map(str, rows)) == sorted(map(str, plain.collect()))
    if name not in ("op2", "op7", "op10", "op11"):  # which deal out places, lines and copies, of which equal rows have different ones
        assert len({str(r) for r in rows if r.doc_id == 1}) == 1


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, docs_of, name):
    assert OPS[name](spark, docs_of([])).count() == 0


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, tmp_path):
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd_docs, str(tmp_path))
        columns = [(f.name, f.dataType) for f in got.schema]
        own = [(f.name, f.dataType) for f in odd_docs.schema]
        assert columns[: len(own)] == own and (name == "histogram_sharding" or columns == own), name
        assert got.count() >= 1, name
        assert stage(spark, odd_docs.limit(0), str(tmp_path)).count() == 0, name


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, odd_docs):
    got = simhash.keep_one(odd_docs).toPandas()
    assert (got.doc_id == 1).sum() == 1 and (got.doc_id == 7).sum() == 0
    # Wordless texts share fingerprint 0: the smallest id of them stays.
    assert set(got.doc_id.dropna()) == {1, 2, 4, 6}


def test_pages(spark):
    long = "<p>" + "word &amp; <b>x</b> " * 60_000
    got = {r.warc_type: r for r in warc.op9_warc(spark.createDataFrame([(9, "http://l/", long)], "page_id long, url string, html string")).collect()}
    assert got["conversion"].block == ("word & x " * 60_000).strip() and got["metadata"].refers_to == got["conversion"].refers_to
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, None, None), (None, "http://b/", "")], "page_id long, url string, html string").withColumn("block", F.lit(1)).withColumn("headers", F.lit(2))
    got = warc.op9_warc(pages).toPandas()
    assert len(got) == 8 and got.block_digest.notna().all()
    plain = warc.op9_warc(pages.select("page_id", "url", "html").repartition(3)).toPandas()
    key = lambda df: sorted(map(str, df.values.tolist()))
    assert key(got) == key(plain) and got[got.page_id == 1].drop_duplicates().shape[0] == 2
    assert warc.op9_warc(pages.limit(0)).count() == 0


def test_pseudonyms_keep_clashing_columns(spark, odd_docs):
    got = pii.pseudonymize(odd_docs, "k")
    assert got.columns[: len(odd_docs.columns)] == odd_docs.columns and got.where("text is null").count() == 2
