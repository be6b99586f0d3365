"""Scalar functions: pure column expressions, evaluated JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
PRICE = r"priced at:\s*\$([0-9]+(?:\.[0-9]+)?)"


def hash_int(*parts: Column | str) -> Column:
    """Seeded 32-bit hash of the parts joined by '|', the same in any engine with md5."""
    said = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("long")


def number(x: Column) -> Column:
    """Commas and outer blanks go; a finite decimal number, or null."""
    plain = F.replace(F.trim(x), F.lit(","), F.lit(""))
    value = F.when(plain.rlike(NUMBER), plain.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def state(raw: Column, value: Column, low: Column, high: Column, levels: bool = False) -> Column:
    """missing (null or blank), invalid (unparseable, out of range, or no whole level), valid. Never clips."""
    missing = raw.isNull() | (F.trim(raw) == "")
    good = value.isNotNull() & value.between(low, high)
    if levels:
        good = good & (value == F.floor(value))
    return F.when(missing, "missing").when(good, "valid").otherwise("invalid")


def price(text: Column, strict: bool = False) -> Column:
    """The price in a text. Without one: null, or an error if ``strict``."""
    found = F.regexp_extract(text, PRICE, 1)
    none = F.raise_error(F.concat(F.lit("no price in: "), text)).cast("double") if strict else F.lit(None).cast("double")
    return F.when(found == "", none).otherwise(found.try_cast("double"))


def route(key: Column, name: Column, overrides: dict[str, str], prefixes: list[tuple[str, str]], strict: bool = True) -> Column:
    """Overrides by key, then the first prefix of the name, then an error."""
    out = None
    for k, family in overrides.items():
        out = (out if out is not None else F).when(key == k, family)
    for prefix, family in prefixes:
        out = (out if out is not None else F).when(name.startswith(prefix), family)
    return out.otherwise(F.raise_error(F.concat(F.lit("unmapped: "), name)) if strict else F.lit(None))


def kind(question_type: Column, levels: Column, numeric: Column) -> Column:
    """Answer kind from the type and the number of levels; an unknown scale is an error."""
    return F.when(numeric, "bounded_numeric").when(levels == 2, "binary").when((levels > 2) & (question_type != "TE"), "ordinal").when(question_type == "TE", "unbounded_numeric").otherwise(F.raise_error(F.lit("unreviewed scale")))


def tokens(text: Column) -> Column:
    """ASCII letter and digit runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def values_list(text: Column, count: Column | int, ended: Column | None = None) -> Column:
    """Comma-separated numbers as doubles; null unless all match, the number is right and the text was ended."""
    parts = F.transform(F.split(F.trim(text), ","), lambda x: F.trim(x))
    good = F.forall(parts, lambda x: x.rlike(NUMBER)) & (F.size(parts) == count)
    if ended is not None:
        good = good & ended
    return F.when(good, F.transform(parts, lambda x: x.try_cast("double")))


def letters(code: Column) -> Column:
    """1 -> A, up to 26."""
    return F.when(code.between(1, 26), F.char(code + 64))


def options_text(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.char(i + 65), F.lit(". "), x)), "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_hash(json: Column) -> Column:
    """Digest of a JSON text with sorted keys and no blanks."""
    return F.sha2(F.to_json(F.parse_json(json)), 256)


def bin_index(x: Column, edges: Column) -> Column:
    """Number of edges at or below x."""
    return F.size(F.filter(edges, lambda e: e <= x))


def bisect(steps: Column, x: Column) -> Column:
    """Number of the ascending ``steps`` at or below ``x``, by halving."""

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        above = F.get(steps, middle) > x
        step = F.struct(F.when(above, s["low"]).otherwise(middle + 1).alias("low"), F.when(above, middle).otherwise(s["high"]).alias("high"))
        return F.when(s["low"] < s["high"], step).otherwise(s)

    start = F.struct(F.lit(0).alias("low"), F.size(steps).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, half)["low"]


def hashed_vector(terms: Column, size: int, seed: str) -> Column:
    """Counts of terms by hash: a vector of ``size`` numbers that stands in for an encoder's."""
    slots = F.transform(terms, lambda t: F.pmod(hash_int(seed, t), F.lit(size)))
    # Bound to a name of its own, or the hashes would be made again for each number.
    counts = lambda held: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(held, lambda s: s == k)).cast("double"))
    return F.transform(F.array(slots), counts)[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def quotient(a: Column, b: Column) -> Column:
    """``a / b`` of doubles as IEEE 754 has it, by zero too: infinite with both signs minded, NaN for 0 / 0; never an error."""
    infinite = F.when(b.cast("string") == "-0.0", F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(b == 0, a * infinite).otherwise(F.try_divide(a, b))


def unit(a: Column) -> Column:
    """Scaled to length one; a null vector stays null, a zero vector becomes null."""
    # The length is bound to a name, or it would be summed again for each element.
    scaled = F.transform(F.array(F.sqrt(dot(a, a))), lambda norm: F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm)))
    return scaled[0]


def parent(path: Column) -> Column:
    """A path without its last row part."""
    return F.regexp_replace(path, "/row[^/]*$", "")
