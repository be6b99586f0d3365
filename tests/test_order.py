"""Places, successors and containment against plain Python."""

import random

from pyspark.sql import functions as F

from tallygrove.operators import contain, order


def test_places_of_numbers_and_texts(spark):
    rng = random.Random(3)
    numbers = [None, *(rng.choice([rng.randrange(-50, 50), rng.randrange(10**12)]) for _ in range(300))]
    texts = [None, "", "é", "日本", "a" * 50, "a" * 50 + "b", *(str(rng.randrange(10**6)) for _ in range(300))]
    for kind, values in (("long", numbers), ("string", texts)):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(5)
        got = order.numbered(df, [F.col("v"), F.col("i")], "place", slice_rows=11)
        rank = lambda x: (x[1] is not None, x[1].encode() if isinstance(x[1], str) else x[1] or 0, x[0])
        want = {i: k + 1 for k, (i, _) in enumerate(sorted(enumerate(values), key=rank))}
        assert {r.i: r.place for r in got.collect()} == want and got.columns == ["i", "v", "place"]
    assert order.numbered(df.limit(0), [F.col("v")], "place").count() == 0
    one = order.numbered(df.where("i = 3"), [F.col("v")], "place").collect()
    assert [r.place for r in one] == [1]


def test_slices_stay_even(spark):
    """Neither an outlier nor a common beginning crowds a slice: the largest is within twice the mean."""
    crowded = [("v long", [*range(4000), 10**18]), ("v string", [f"Customer#{k:09d}" for k in range(4000)]), ("v long", [k * k * k for k in range(4000)])]
    for schema, values in crowded:
        df = spark.createDataFrame([(v,) for v in values], schema)
        sizes = [r[1] for r in order._dealt(df, [F.col("v")], 250).groupBy("_bucket").count().collect()]
        assert len(sizes) >= 12 and max(sizes) <= 2 * sum(sizes) / len(sizes)
        got = order.numbered(df, [F.col("v")], "place", slice_rows=250).orderBy("place").collect()
        assert [r.v for r in got] == sorted(values) and [r.place for r in got] == list(range(1, len(values) + 1))


def test_successors_go_round_once(spark):
    keys = list(range(200))
    df = spark.createDataFrame([(k,) for k in keys], "k int")
    number = F.pmod(F.col("k") * 37, F.lit(50)).cast("long")
    want = sorted(keys, key=lambda k: (k * 37 % 50, k))
    assert {r.k: r.then for r in order.successors(df, "k", number, "then", slice_rows=9).collect()} == dict(zip(want, [*want[1:], want[0]], strict=True))


def test_containment_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["a", "bc", "d", "ef", "the", "é"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 30])))) for i in range(120)] + [(500, None), (None, "a bc d ef the a"), (7, "a bc d ef the a"), (7, "a bc d ef the a"), (501, "a\tbc  d\nef the a")]
    items = [(0, ""), (1, None), (2, "bc"), (3, "c d"), (4, "a\tbc  d\nef the"), (5, "x")]
    for i in range(60):
        text = rng.choice([t for _, t in docs if t])
        at = rng.randrange(len(text))
        items.append((10 + i, text[at : at + rng.choice([1, 6, 12, 25])]))
    left, right = spark.createDataFrame(docs, "doc int, text string"), spark.createDataFrame(items, "item int, text string")
    want = sorted(((d if d is not None else -1), i) for d, t in docs for i, s in items if t is not None and s is not None and s in t)
    for block in (3, 1000):
        got = contain.contained(left, right, "doc", "item", "text", block=block).collect()
        assert sorted((r.doc if r.doc is not None else -1, r.item) for r in got) == want
    assert contain.contained(left, right.limit(0), "doc", "item", "text").count() == 0
