"""Seals, kept results and logs on files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallygrove.sources import jsonl, sealed, tables


def test_a_changed_row_breaks_the_seal(spark):
    rows = [(k, f"v{k}" if k % 5 else None, k % 3) for k in range(500)]
    df = spark.createDataFrame(rows + rows[:3], "k int, v string, w int")
    seal = sealed.manifest(df, "k", ["k", "v", "w"], 8)
    assert sealed.verified(sealed.manifest(df.repartition(9, "w"), "k", ["k", "v", "w"], 8), seal, "part").count() == 8
    for other in (df.union(df.limit(1)), df.where("k <> 7"), df.withColumn("v", F.when(F.col("k") == 9, "x").otherwise(F.col("v"))), df.withColumn("v", F.coalesce("v", F.lit(""))), df.limit(0)):
        with pytest.raises(Exception, match="changed since it was sealed"):
            sealed.verified(sealed.manifest(other, "k", ["k", "v", "w"], 8), seal, "part").collect()
    swapped = df.select("k", F.when(F.col("k") < 2, F.concat("v", F.lit("1"))).otherwise(F.col("v")).alias("v"), "w")
    assert sealed.manifest(swapped, "k", ["k", "v", "w"], 1).first().digest != sealed.manifest(df, "k", ["k", "v", "w"], 1).first().digest


def test_a_changed_file_breaks_the_seal(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name, text in (("d/a.bin", b"\x00\xff"), ("d/e/b.txt", b"b"), ("d/empty", b"")):
        (tmp_path / name).write_bytes(text)
    got = sealed.file_manifest(spark, f"{tmp_path}/d")
    assert sorted(map(tuple, got.collect())) == [("a.bin", 2, hashlib.sha256(b"\x00\xff").hexdigest()), ("e/b.txt", 1, hashlib.sha256(b"b").hexdigest())]
    seal = spark.createDataFrame(got.collect(), got.schema)
    assert sealed.verified(sealed.file_manifest(spark, f"{tmp_path}/d"), seal, "file").count() == 2
    (tmp_path / "d/a.bin").write_bytes(b"\x00\xfe")
    with pytest.raises(Exception, match="changed since it was sealed: a.bin"):
        sealed.verified(sealed.file_manifest(spark, f"{tmp_path}/d"), seal, "file").collect()


def test_documents_are_written_whole(spark, tmp_path):
    path = tmp_path / "x.json"
    sealed.write_json(spark, {"a": [1, 2.5, None], "é": "ü"}, str(path))
    sealed.write_json(spark, {"b": 2}, str(path))
    assert json.loads(path.read_text()) == {"b": 2} and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]
    assert tables.json_document(spark, str(path)).first().b == 2
    with pytest.raises(ValueError):
        sealed.write_json(spark, {"a": float("nan")}, str(path))
    assert json.loads(path.read_text()) == {"b": 2}


def test_the_second_run_computes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "ccc")], "i int, t string")
    seen = spark.sparkContext.accumulator(0)

    def compute(rows):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f.assign(n=f.t.str.len().astype("int64"))

        return rows.mapInPandas(run, "i int, t string, _digest string, n long")

    run = lambda rows, who="m1": {r.i: r.n for r in sealed.kept_results(rows, F.sha2("t", 256), compute, f"{tmp_path}/c", who).collect()}
    assert run(docs.where("i < 4")) == {1: 1, 2: 2, 3: 1} and seen.value == 2
    assert run(docs) == {1: 1, 2: 2, 3: 1, 4: None, 5: 3} and seen.value == 3
    assert run(docs) == {1: 1, 2: 2, 3: 1, 4: None, 5: 3} and seen.value == 3
    with pytest.raises(ValueError, match="m1"):
        run(docs, "m2")
    assert spark.read.parquet(f"{tmp_path}/c").count() == 3


def test_torn_tails_in_split_logs(spark, tmp_path):
    logs = {"whole": "".join(f'{{"a": {k}, "s": "é\\r"}}\n' for k in range(900)), "torn": "".join(f'{{"a": {k}}}\n' for k in range(1000, 1900)) + '{"a": 77', "one": '{"a": 5', "empty": "", "feed": "\n", "blank": '\n{"a": 3}\n\n{"a"'}
    for name, text in logs.items():
        (tmp_path / f"{name}.jsonl").write_text(text, newline="")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("500", "4000", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = jsonl.read_recovered(spark, str(tmp_path), "a int, s string")
            assert sorted(r.a for r in got.collect()) == sorted([*range(900), *range(1000, 1900), 3])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all((tmp_path / f"{n}.jsonl").read_bytes() == t.encode() for n, t in logs.items())
