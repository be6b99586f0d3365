"""Values as text: numbers, names, and the two encodings of canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: Column) -> Column:
    """Twelve significant digits at most, without trailing zeros; an exponent below 1e-4 and from 1e12 on (C's ``%.12g``). Null stays null."""
    parts = F.split(F.format_string("%.11e", F.abs(x)), "e")
    digits, power = F.replace(parts[0], F.lit("."), F.lit("")), parts[1].cast("int")
    strip = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    above = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(12)))
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(strip(parts[0]), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    said = F.when((power < -4) | (power >= 12), exponent).when(power < 0, strip(below)).otherwise(strip(above))
    return F.when(x.isNotNull(), F.concat(F.when((x < 0) & (said != "0"), "-").otherwise(""), said))


def answer_text(value: Column, levels: Column) -> Column:
    """A letter where the answer is one of ``levels`` (1 is A), else the number."""
    return F.when(levels.isNotNull(), F.when((value >= 1) & (value <= F.least(levels, F.lit(26))) & (value == F.floor(value)), F.char((value + 64).cast("int")))).otherwise(number_text(value))


def mapped(key: Column, table: dict[str, str], what: str = "unmapped") -> Column:
    """The entry of ``key``; one that is not there is an error, never a guess."""
    entries = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(entries, key), F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(key, F.lit("null")))).cast("string"))


def label(name: Column, labels: dict[str, str], prefixes: dict[str, str]) -> Column:
    """A title for a name. A known prefix gives ``title / label`` of the rest, which must be known; other names give their label, or themselves with blanks for underscores."""
    entries = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    out = F.coalesce(F.try_element_at(entries, name), F.replace(name, F.lit("_"), F.lit(" ")))
    for prefix, title in reversed(prefixes.items()):
        rest = F.substring(name, F.lit(len(prefix) + 1), F.length(name))
        out = F.when(name.startswith(prefix), F.concat(F.lit(title + " / "), mapped(rest, labels, "no label"))).otherwise(out)
    return out


def safe_name(name: Column) -> Column:
    """Whether a name may be that of a folder: letters, digits, underscores and hyphens of ASCII, one at least."""
    return F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]+\z"), F.lit(False))


def canonical_json(json: Column, ascii_only: bool = False) -> Column:
    """A JSON text with sorted keys and no blanks; with ``ascii_only`` other characters as ``\\uXXXX``, beyond the first plane as two of them."""
    plain = F.to_json(F.parse_json(json))
    if not ascii_only:
        return plain
    pieces = F.regexp_extract_all(plain, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))

    def escaped(piece: Column) -> Column:
        units = F.lower(F.hex(F.encode(piece, "UTF-16BE")))
        return F.when(F.ascii(piece) < 128, piece).otherwise(F.regexp_replace(units, "([0-9a-f]{4})", r"\\u$1"))

    return F.array_join(F.transform(pieces, escaped), "")
