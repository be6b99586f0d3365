"""Text of values against Python's own."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallygrove.functions import rendering


def test_numbers_as_python_says_them(spark):
    rng = random.Random(7)
    xs = [0.0, -0.5, 1.0, 100.0, 1e11, 123456789012.0, 1e12, 9.99999999999e11, 1e-4, 0.00012345, 1e-5, -3e-7, 1 / 3, 2e300, 12345.678, 0.1 + 0.2, *(rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 16) for _ in range(300))]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", rendering.number_text(F.col("x")).alias("t")).collect()
    assert [(r.x, r.t) for r in got] == [(x, format(x, ".12g")) for x in xs]
    answers = spark.createDataFrame([(2.0, 3), (27.0, 30), (1.5, 3), (0.25, None), (None, 3)], "v double, k int").select(rendering.answer_text(F.col("v"), F.col("k")).alias("t")).collect()
    assert [r.t for r in answers] == ["B", None, None, "0.25", None]


def test_both_encodings_of_canonical_json(spark):
    values = [{"b": [1, None, True], "a": "é漢😀"}, {"z": {"y": 1, "x": "ß"}}, "plain", []]
    df = spark.createDataFrame([(k, json.dumps(v, indent=1)) for k, v in enumerate(values)], "k int, j string")
    got = df.select("k", rendering.canonical_json(F.col("j")).alias("p"), rendering.canonical_json(F.col("j"), True).alias("a")).orderBy("k").collect()
    assert [r.p for r in got] == [json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for v in values]
    assert [r.a for r in got] == [json.dumps(v, sort_keys=True, separators=(",", ":")) for v in values]


def test_names(spark):
    df = spark.createDataFrame([("a_b",), ("run_x",), ("x",), ("q_r",)], "n string")
    said = df.select(rendering.label(F.col("n"), {"x": "Ex", "a_b": "AB"}, {"run_": "Run"}).alias("t")).collect()
    assert [r.t for r in said] == ["AB", "Run / Ex", "Ex", "q r"]
    with pytest.raises(Exception, match="no label: y"):
        spark.createDataFrame([("run_y",)], "n string").select(rendering.label(F.col("n"), {"x": "Ex"}, {"run_": "Run"})).collect()
    with pytest.raises(Exception, match="unmapped: b"):
        spark.createDataFrame([("b",)], "n string").select(rendering.mapped(F.col("n"), {"a": "A"})).collect()
    safe = spark.createDataFrame([("ok-1_B",), ("",), ("a/b",), ("a\n",), (None,), ("é",)], "n string").select(rendering.safe_name(F.col("n")).alias("s")).collect()
    assert [r.s for r in safe] == [True, False, False, False, False, False]
