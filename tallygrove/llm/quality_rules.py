"""Quality rules: a threshold table compiled into one projection, without user functions.

Base figures are counted per document from its whole text; a table of
``(name, numerator, denominator, least, most)`` turns ratios of them into one
boolean expression. All comparisons are made on integers, cross-multiplied in
thousandths, so that no rounding decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Common function words of the four languages.
STOP_WORDS = (
    "the of and to in is was that for with this are from at on an a "
    "der die das und in zu den ein eine für mit nicht von ist auf im "
    "le la les de des et en un une du que qui pour est par sur dans "
    "el los las y del que en un una por para con se no"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text if ``least <= 1000 * part / whole <= most``; without a whole the rule holds. None: no bound."""

    name: str
    part: str
    whole: str | None = None
    least: int | None = None
    most: int | None = None

    def keeps(self) -> Column:
        part, tests = F.col(self.part), []
        whole = F.col(self.whole) if self.whole else F.lit(1)
        scaled = part * 1000 if self.whole else part
        if self.least is not None:
            tests.append(scaled >= whole * self.least)
        if self.most is not None:
            tests.append(scaled <= whole * self.most)
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def sql(self) -> str:
        scaled, whole = (f"{self.part} * 1000", self.whole) if self.whole else (self.part, "1")
        tests = [f"{scaled} >= {whole} * {self.least}"] * (self.least is not None) + [f"{scaled} <= {whole} * {self.most}"] * (self.most is not None)
        return "(" + " AND ".join(tests) + ")"


#: Lengths are in words or characters, ratios in thousandths.
RULES = (
    Rule("length", "n_words", least=10, most=1_000_000),
    Rule("word_length", "word_chars", "n_words", least=2_000, most=12_000),
    Rule("symbols", "n_symbols", "word_chars", most=50),
    Rule("stop_words", "n_stop_words", "n_words", least=20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=500),
)


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base figures of every text: one narrow row per row of ``docs``, no exchange.

    ``n_repeat_words`` counts words in five-word windows found twice or more:
    windows are hashed (XXH64 over the words' XXH64); a text all of whose hashes
    differ is done at once, otherwise equal hashes are found by sorting, so the
    work is n log n in the text's length.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    worded = base.select("doc_id", "t", F.regexp_extract_all("t", F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    hashed = worded.select("doc_id", "t", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("wh"))
    last = F.size("wh") - 4
    windows = F.when(last >= 2, F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.xxhash64(*(F.get("wh", i + k) for k in range(5))))).otherwise(F.array().cast("array<bigint>"))
    hashed = hashed.select("doc_id", "t", "w", windows.alias("g"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    stop = list(dict.fromkeys(STOP_WORDS))
    counted = hashed.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        "g",
        F.size(F.array_distinct("g")).alias("n_g"),
        F.size(F.filter("w", lambda x: F.lower(F.rtrim(x, F.lit(".,"))).isin(stop))).cast("long").alias("n_stop_words"),
    )
    order = F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    twice = counted.withColumn("s", F.when(F.size("g") > F.col("n_g"), order))
    h = lambda k: F.get("s", k)["h"]
    same = F.filter(F.transform("s", lambda x, k: F.when((x["h"] == h(k - 1)) | (x["h"] == h(k + 1)), x["i"])), lambda x: x.isNotNull())
    placed = twice.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(same)))
    covered = F.aggregate(F.transform("p", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("p", k + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda n, x: n + x)
    told = F.struct(
        "n_words", "word_chars", "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_stop_words",
    )
    # One row in, one row out: a filter on the figures stays above this step, else the
    # optimizer would write the whole chain of expressions out into the filter.
    return placed.select("doc_id", F.inline(F.array(told)))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures, the base test and the verdict of every row of ``docs``.

    ``base_failed``: fewer than ten words, or more than a fifth of the words in
    repeated windows. ``kept`` is false if the base test failed or any rule
    does; ``failed_rules`` names those. Null and empty texts have figures of 0
    and fail. Repeated rows keep a row each; extra columns are ignored.
    """
    found = figures(docs, id_col, text_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    named = F.filter(F.array(*(F.when(~r.keeps(), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return found.withColumns({"base_failed": failed, "failed_rules": named}).withColumn("kept", kept)


def op5_quality_rules(docs: DataFrame) -> DataFrame:
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
