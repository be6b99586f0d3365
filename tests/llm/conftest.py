import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Columns whose names operators use themselves.
EXTRA = ["size", "shard", "slot", "fp", "pii", "score", "spans", "target", "copies", "_tg_stats", "_tg_score", "component_id", "hi", "lo", "key", "lid", "kept", "batch", "rank"]


def frame(spark, rows, parts=3):
    """Documents from (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs_of(spark):
    return lambda rows, parts=3: frame(spark, rows, parts)


@pytest.fixture
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 977} the of, and" for i in range(30_000))
    rows = [(1, "the cat sat on the mat and the dog of the house was there."), (1, "the cat sat on the mat and the dog of the house was there."), (2, None, None), (3, ""), (None, "the text of a row without an id, and it is here."), (4, long, None), (5, "\n \t\n"), (6, "é ü 漢字 😀 the and"), (None, None), (7, "the cat sat on the mat and the dog of the house was there.")]
    df = frame(spark, rows)
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(EXTRA)))
