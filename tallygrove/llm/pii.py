"""Format-preserving pseudonyms by keyed Feistel networks, as column expressions.

Validated values (payment card numbers by check digit, IBANs by remainder, IPv4
addresses by octet, real dates, phone and social-security numbers by shape, mail
addresses) are permuted within their format: the halves of a value are added to
keyed hashes of each other in turn, modulo the size of their domain, which is
one-to-one. Equal values get equal pseudonyms in all documents; check digits are
made anew; separators, lengths and everything around stay. No exchange, no user
function: a text is cut at the matches, the matches are mapped, and both are
joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Most steps of a date's walk.
WALK = 128

# The shapes searched, in order of precedence at one place.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join((MAIL, IBAN, DATE, SOCIAL, PHONE, IPV4, CARD))
KINDS = ("mail", "iban", "date", "social", "phone", "ipv4", "card")


def _hash(key: str, *parts) -> Column:
    """60 keyed bits as a long."""
    said = F.concat_ws("|", F.lit(key), *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def _feistel(left: Column, right: Column, mod_left: Column, mod_right: Column, key: str, tweak: Column) -> Column:
    """Struct (l, r) of the permuted halves."""

    def turn(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        l = F.when(even, F.pmod(s["l"] + _hash(key, tweak, i, s["r"]), mod_left)).otherwise(s["l"])  # noqa: E741
        r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + _hash(key, tweak, i, s["l"]), mod_right))
        return F.struct(l.alias("l"), r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permute_digits(digits: Column, key: str, tweak: str) -> Column:
    """One-to-one on digit strings of each length from 2 to 36; others stay."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n - a)
    both = _feistel(left.cast("long"), right.cast("long"), ten(a), ten(n - a), key, F.concat(F.lit(tweak), n.cast("string")))
    joined = F.transform(F.array(both), lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), n - a, F.lit("0"))))[0]
    return F.when((n >= 2) & (n <= 36), joined).otherwise(digits)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(x: Column, digits: Column) -> Column:
    """``x`` with its digits replaced in turn by ``digits``."""
    held = F.transform(F.array(digits), lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(F.substring(x, i, F.lit(1)).rlike("[0-9]"), F.substring(d, F.length(_digits(F.substring(x, F.lit(1), i))), F.lit(1))).otherwise(F.substring(x, i, F.lit(1)))), ""))
    return held[0]


def _luhn_sum(digits: Column, odd_first: bool) -> Column:
    """Check sum from the right; ``odd_first``: the rightmost digit is doubled."""

    def one(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.pmod(i, F.lit(2)) == (0 if odd_first else 1)
        return total + F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), one)


def _mod97(text: Column) -> Column:
    """Remainder of an IBAN-like string, letters as 10 to 35."""

    def one(rest: Column, ch: Column) -> Column:
        letter = ch.rlike("[A-Z]")
        return F.when(letter, F.pmod(rest * 100 + F.ascii(ch) - 55, F.lit(97))).otherwise(F.pmod(rest * 10 + F.ascii(ch) - 48, F.lit(97)))

    return F.aggregate(F.split(text, ""), F.lit(0), lambda rest, ch: F.when(ch == "", rest).otherwise(one(rest, ch)))


def _card(x: Column, key: str) -> Column:
    d = _digits(x)
    body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    new = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - F.pmod(_luhn_sum(b, True), F.lit(10)), F.lit(10)).cast("string")))[0]
    return F.when(F.pmod(_luhn_sum(d, False), F.lit(10)) == 0, _refill(x, new))


def _iban(x: Column, key: str) -> Column:
    plain = F.replace(x, F.lit(" "), F.lit(""))
    moved = lambda p: F.concat(F.substring(p, F.lit(5), F.length(p)), F.substring(p, F.lit(1), F.lit(4)))
    account = _refill(F.substring(plain, F.lit(5), F.length(plain)), permute_digits(_digits(F.substring(plain, F.lit(5), F.length(plain))), key, "iban"))
    land = F.substring(plain, F.lit(1), F.lit(2))
    new = F.transform(F.array(account), lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(b, land, F.lit("00")))).cast("string"), 2, "0"), b))[0]
    spaced = lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(F.substring(x, i, F.lit(1)) == " ", " ").otherwise(F.substring(n, F.length(F.replace(F.substring(x, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    return F.when(_mod97(moved(plain)) == 1, F.transform(F.array(new), spaced)[0])


# The first day, and two factors of the number of days, of 0001 to 1899, 1900 to 2099, and 2100 to 9999.
_CALENDARS = (("0001-01-01", 665, 1043), ("1900-01-01", 17, 4297), ("2100-01-01", 195, 14797))


def _date(x: Column, key: str) -> Column:
    """A day moves within its calendar: 0001 to 1899, 1900 to 2099, or 2100 to 9999; the year 0000 stays.

    Days from the 13th on move among themselves, and so do those up to the 12th: the permutation is repeated until
    its day is of the same kind again. So a pseudonym is read as its date was (a month-first date that could not be
    day-first stays one), one day has one pseudonym in all forms, and different days have different ones.
    """

    def moved(day: Column) -> Column:
        out = F.lit(None).cast("date")
        for first, a, b in _CALENDARS:
            start, tweak = F.lit(first).cast("date"), F.lit("date" if a == 17 else f"date{a}")

            def step(n: Column) -> Column:
                s = _feistel(F.floor(n / b), F.pmod(n, F.lit(b)), F.lit(a), F.lit(b), key, tweak)  # noqa: B023
                return F.aggregate(F.array(s), F.lit(0).cast("long"), lambda _, s: s["l"] * F.lit(b) + s["r"])  # noqa: B023

            late = lambda n: F.dayofmonth(F.date_add(start, n.cast("int"))) > 12  # noqa: B023, E731
            n = F.datediff(day, start).cast("long")
            # A walk ends after two steps on average; one of WALK steps has a chance below 10^-28, and would show as an error.
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(n), lambda m, _: F.when(late(m) == (F.dayofmonth(day) > 12), m).otherwise(step(m)))  # noqa: B023
            settled = F.transform(F.array(walked), lambda m: F.when(late(m) == (F.dayofmonth(day) > 12), m).otherwise(F.raise_error(F.lit("a date's walk did not end")).cast("long")))[0]  # noqa: B023
            out = F.when((n >= 0) & (n < a * b), F.date_add(start, settled.cast("int"))).otherwise(out)
        return out

    mark = F.substring(x, F.lit(3), F.lit(1))
    plain = F.translate(x, "./", "--")
    own = lambda day, form: F.date_format(moved(day), form)
    iso, european, american = F.try_to_date(plain, "yyyy-MM-dd"), F.try_to_date(plain, "dd-MM-yyyy"), F.try_to_date(plain, "MM-dd-yyyy")
    iso_shape = x.rlike("^[0-9]{4}-")
    american_only = european.isNull() & american.isNotNull()
    # A day-first date stays day-first; the month-first reading serves only where the other is none.
    two = F.when(european.isNotNull(), own(european, "dd-MM-yyyy")).when(american_only, own(american, "MM-dd-yyyy"))
    return F.when(iso_shape, own(iso, "yyyy-MM-dd")).otherwise(F.replace(two, F.lit("-"), mark))


def _ipv4(x: Column, key: str) -> Column:
    part = F.transform(F.split(x, r"\."), lambda p: p.cast("int"))
    sound = F.forall(part, lambda p: p <= 255)
    s = F.transform(F.array(part), lambda p: _feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, F.lit("ipv4")))
    new = F.transform(s, lambda s: F.concat_ws(".", *(y.cast("string") for y in (F.floor(s["l"] / 256), F.pmod(s["l"], F.lit(256)), F.floor(s["r"] / 256), F.pmod(s["r"], F.lit(256))))))[0]
    return F.when(sound, new)


# International dialling codes; those not listed have three digits.
_DIAL = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _phone(x: Column, key: str) -> Column:
    """The dialling code after a plus stays; the digits alone decide, so equal numbers stay equal in any spacing."""
    d = _digits(x)
    code = F.when(x.startswith("+"), F.length(F.regexp_extract(d, f"^(?:{_DIAL})", 0))).otherwise(F.lit(0))
    new = F.concat(F.substring(d, F.lit(1), code), permute_digits(F.substring(d, code + 1, F.length(d)), key, "phone"))
    return F.when(F.length(d).between(7, 15), _refill(x, new))


def _social(x: Column, key: str) -> Column:
    """Area (not 000, 666 or 9xx), group (not 00) and serial (not 0000) are numbered without gaps, so pseudonyms are valid too."""
    d = _digits(x)
    area, rest = F.substring(d, 1, 3).cast("long"), (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
    s = _feistel(area - F.when(area > 666, 2).otherwise(1), rest, F.lit(898), F.lit(99 * 9999), key, F.lit("social"))
    part = lambda v, n: F.lpad(v.cast("string"), n, "0")
    told = lambda s: F.concat_ws("-", part(s["l"] + F.when(s["l"] >= 665, 2).otherwise(1), 3), part(F.floor(s["r"] / 9999) + 1, 2), part(F.pmod(s["r"], F.lit(9999)) + 1, 4))
    return F.when(~x.rlike("^(?:000|666|9[0-9]{2})|-00-|-0000$"), F.transform(F.array(s), told)[0])


_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _mail(x: Column, key: str) -> Column:
    """Letters and digits of the local part move within their kind, halves keyed by each other; the domain stays."""
    local = F.split(F.substring_index(x, "@", 1), "")

    def turned(ch: Column, by: Column) -> Column:
        out = ch
        for one in _SETS:
            at = F.instr(F.lit(one), ch)
            out = F.when((at > 0) & (ch != ""), F.substring(F.lit(one), (F.pmod(at - 1 + by, F.lit(len(one))) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    def turn(s: Column, i: Column) -> Column:
        shift = lambda own, other: F.transform(own, lambda ch, k: turned(ch, _hash(key, "mail", i, k, F.array_join(other, ""))))
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, shift(s["l"], s["r"])).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(shift(s["r"], s["l"])).alias("r"))

    def done(p: Column) -> Column:
        half = F.floor(F.size(p) / 2).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(F.slice(p, F.lit(1), half).alias("l"), F.slice(p, half + 1, F.size(p)).alias("r")), turn)

    new = F.transform(F.transform(F.array(local), done), lambda s: F.concat(F.array_join(s["l"], ""), F.array_join(s["r"], "")))[0]
    return F.concat(new, F.lit("@"), F.substring_index(x, "@", -1))


def _kind(x: Column) -> Column:
    """Which shape a match has; the order is that of the search."""
    whole = lambda shape: x.rlike("^(?:" + shape + ")$")
    out = F.when(F.instr(x, "@") > 0, "mail")
    for name, shape in (("iban", IBAN), ("date", DATE), ("social", SOCIAL), ("phone", PHONE), ("ipv4", IPV4)):
        out = out.when(whole(shape), name)
    return out.otherwise("card")


def _pseudonym(kind: Column, x: Column, key: str) -> Column:
    """The new value, or null for a value that does not validate."""
    return F.when(kind == "mail", _mail(x, key)).when(kind == "iban", _iban(x, key)).when(kind == "date", _date(x, key)).when(kind == "social", _social(x, key)).when(kind == "phone", _phone(x, key)).when(kind == "ipv4", _ipv4(x, key)).otherwise(_card(x, key))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and, last, ``pii``: an array of (kind, pseudonym) in text order.

    All other columns and rows stay (``pii`` gets another name where it is
    taken). Null texts stay null with a null array, texts without validated
    values stay as they are. The whole text is searched, once to cut it and once
    for the matches.
    """
    from .common import fresh

    found, new = fresh(docs, "found", "new")
    name = "pii" if "pii" not in [c.lower() for c in docs.columns] else fresh(docs, "pii")[0]
    matches = F.transform(F.regexp_extract_all(F.col(text_col), F.lit(f"({ANY})"), F.lit(1)), lambda x: F.struct(_kind(x).alias("kind"), x.alias("x")))
    mapped = F.transform(found, lambda m: F.struct(m["kind"].alias("kind"), m["x"].alias("x"), _pseudonym(m["kind"], m["x"], key).alias("y")))
    # Texts without a digit or an at sign hold nothing to find.
    some = F.col(text_col).rlike("[0-9@]")
    staged = docs.withColumn(found, F.when(some, matches)).withColumn(new, F.when(F.size(found) > 0, mapped))
    pieces = F.zip_with(F.split(text_col, ANY, -1), F.col(new), lambda p, m: F.concat(p, F.coalesce(m["y"], m["x"], F.lit(""))))
    values = F.transform(F.filter(new, lambda m: m["y"].isNotNull()), lambda m: F.struct(m["kind"].alias("kind"), m["y"].alias("pseudonym")))
    empty = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    out = {text_col: F.when(F.col(new).isNotNull(), F.array_join(pieces, "")).otherwise(F.col(text_col)), name: F.when(F.col(text_col).isNotNull(), F.coalesce(values, empty))}
    return staged.withColumns(out).drop(found, new)


def op4_pseudonyms(docs: DataFrame, key: str = "tallygrove") -> DataFrame:
    """``doc_id``, the text with pseudonyms, and the number of them of each kind, one row per row of ``docs``.

    Phone numbers count with a plus, or as three, three and four digits with hyphens or an area code in brackets; national
    numbers without such marks stay. Null texts stay null and have null counts; empty texts stay empty and count none;
    repeated rows get equal results; extra columns are ignored; an empty table gives an empty
    result. ``key`` is a parameter: a user passes a secret, the query a fixed word.
    """
    done = pseudonymize(docs.select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("pii", lambda m: m["kind"] == kind)).alias(f"n_{kind}")
    return done.select("doc_id", "text", *(count(k) for k in KINDS))
