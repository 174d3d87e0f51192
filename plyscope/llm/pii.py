"""Format-preserving pseudonyms for personal data, with Spark functions only.

Validated numbers and dates are permuted, under a key, within their own
format by a Feistel network: a card number becomes another card number of
the same length with a right check digit, a date another real date.  Equal
values get equal pseudonyms wherever they occur, so links across documents
survive, and no two values share one.

Where a format can't show every value of its domain, a value is permuted
again and again until it can (cycle walking), which keeps the map one to one.

Not covered: IPv6 addresses, IBANs, national numbers without separators,
phone numbers without an area or country code, names and addresses.

A text is cut at the matches of one pattern (``split`` and
``regexp_extract_all`` see the same matches), each match is validated and
mapped by expressions, and the parts are put together again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a cycle walk: each hits with at least two chances in five, so a walk that needs more doesn't occur.
WALKS = 64
EPOCH = "0001-01-01"
#: Days from EPOCH on in three domains, each permuted within itself: first day, high and low halves (up to 1899, 1900-01-01 to 2101-01-26, up to 9999).
DOMAINS = ((0, 745, 931), (693_595, 272, 270), (767_035, 1424, 2026))

#: Kind, pattern.  Of matches at one place the first kind counts.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])|(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9])|(?<![0-9])(?:[0-9]{4}[ -]){4}[0-9]{1,3}(?![0-9])|(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,5}\)|[ .-]?[0-9]{1,12})(?:[ .-]?[0-9]{1,8}){0,5}(?![0-9])"),
)
KINDS = tuple(k for k, _ in PATTERNS)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)


def _hash(key: str, kind: str, i: int, *of: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(i)), *of), 256)


def _chain(steps: list[Callable[[Column], Column]], start: Column) -> Column:
    """Apply steps one after another, each on a bound value.

    A one-element array and ``transform`` bind a value once, where plain
    nesting would repeat each round's input in the expression.
    """
    out = F.array(start)
    for step in steps:
        out = F.transform(out, step)
    return F.element_at(out, 1)


def _long(text: Column) -> Column:
    return text.cast("long")


def _padded(value: Column, n: int) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def permuted(high: Column, low: Column, key: str, kind: str, highs: Column, lows: Column) -> tuple[Column, Column]:
    """Permute pairs (high, low) of 0 .. highs - 1 and 0 .. lows - 1.

    A Feistel network: alternately one half is shifted by a keyed hash of
    the other, modulo its own size.
    """

    def step(i: int) -> Callable[[Column], Column]:
        def shift(v: Column) -> Column:
            by = F.conv(F.substring(_hash(key, kind, i, v[1 - i % 2].cast("string"), highs.cast("string"), lows.cast("string")), 1, 13), 16, 10).cast("long")
            return F.array(v[0], F.pmod(v[1] + by, lows)) if i % 2 else F.array(F.pmod(v[0] + by, highs), v[1])

        return shift

    out = _chain([step(i) for i in range(ROUNDS)], F.array(high.cast("long"), low.cast("long")))
    return out[0], out[1]


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    return _chain([then], value)


def luhn(digits: Column) -> Column:
    """Luhn sum modulo 10; 0 for a number with a right check digit."""

    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda a, x: a + x) % 10


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part are shifted within their class; the rest stays."""
    local, domain = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))

    def shifted(half: Column, other: Column, i: int) -> Column:
        def char(j: Column) -> Column:
            c = F.substring(half, j, F.lit(1))
            by = F.conv(F.substring(_hash(key, "email", i, F.floor((j - 1) / 12).cast("string"), domain, other), (j - 1) % 12 * 5 + 1, F.lit(5)), 16, 10).cast("int")
            move = lambda first, n: F.char(F.ascii(F.lit(first)) + (F.ascii(c) - F.ascii(F.lit(first)) + by) % n)
            return F.when(c.between("a", "z"), move("a", 26)).when(c.between("A", "Z"), move("A", 26)).when(c.between("0", "9"), move("0", 10)).otherwise(c)

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), char), "")).otherwise(half)

    def step(i: int) -> Callable[[Column], Column]:
        return lambda v: F.array(v[0], shifted(v[1], v[0], i)) if i % 2 else F.array(shifted(v[0], v[1], i), v[1])

    cut = F.floor(F.length(local) / 2).cast("int")
    halves = F.array(F.substring(local, F.lit(1), cut), F.substring(local, cut + 1, F.length(local)))
    return F.concat(F.array_join(_chain([step(i) for i in range(ROUNDS)], halves), ""), F.lit("@"), F.substring_index(m, "@", -1))


def _ip(m: Column, key: str) -> Column:
    def mapped(p: Column) -> Column:
        n = F.lit(1 << 16)
        halves = permuted(p[0] * 256 + p[1], p[2] * 256 + p[3], key, "ip", n, n)
        octets = _bound(F.array(*halves), lambda v: F.concat_ws(".", *(x.cast("string") for h in (v[0], v[1]) for x in (F.shiftright(h, 8), h.bitwiseAND(255)))))
        return F.when(F.forall(p, lambda x: x <= 255), octets)

    return _bound(F.transform(F.split(m, r"\."), _long), mapped)


def _date(m: Column, key: str) -> Column:
    """ISO dates, dates with slashes (month first, else day first) and day-first dates with points.

    A format with two digits each and one without leading zeros are apart,
    and so are dates that only a day-first reading allows, so each of these
    is permuted within itself.
    """
    parts = F.split(m, "[/.-]")
    short = (F.length(parts[0]) == 1) | (F.length(parts[1]) == 1)
    read = lambda layout: F.try_to_date(m, layout)
    month, day = (lambda d: F.month(d) < 10), (lambda d: F.dayofmonth(d) < 10)
    any_, either, late = (lambda d: F.lit(True)), (lambda d: month(d) | day(d)), (lambda d: F.dayofmonth(d) > 12)
    slashed, pointed, dashed = (F.contains(m, F.lit(x)) for x in "/.-")
    ways = (
        (dashed, "yyyy-MM-dd", any_),
        (slashed & ~short & read("MM/dd/yyyy").isNotNull(), "MM/dd/yyyy", any_),
        (slashed & ~short, "dd/MM/yyyy", late),
        (slashed & read("M/d/yyyy").isNotNull(), "M/d/yyyy", either),
        (slashed, "d/M/yyyy", lambda d: late(d) & month(d)),
        (pointed & ~short, "dd.MM.yyyy", any_),
        (pointed, "d.M.yyyy", either),
    )
    out = F.lit(None).cast("string")
    for fits, layout, shown in reversed(ways):
        out = F.when(fits, _bound(F.datediff(read(layout), F.lit(EPOCH).cast("date")), _day(key, layout, shown))).otherwise(out)
    return out


def _as_date(day: Column) -> Column:
    return F.date_add(F.lit(EPOCH).cast("date"), day.cast("int"))


def _day(key: str, layout: str, shown: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A day of a domain as another day there for which ``shown`` holds, in the layout."""

    def mapped(d: Column) -> Column:
        pick = lambda k: F.when(d < DOMAINS[1][0], F.lit(DOMAINS[0][k])).when(d < DOMAINS[2][0], F.lit(DOMAINS[1][k])).otherwise(F.lit(DOMAINS[2][k]))
        first, highs, lows = (pick(k) for k in range(3))

        def step(at: Column, i: Column) -> Column:
            once = lambda v: _bound(F.array(*permuted(F.floor((v - first) / lows), (v - first) % lows, key, "date", highs, lows)), lambda h: first + h[0] * lows + h[1])
            return F.when((i > 0) & shown(_as_date(at)), at).otherwise(once(at))

        new = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), d.cast("long"), step)
        return F.when(d >= 0, _bound(new, lambda v: F.when(shown(_as_date(v)), F.date_format(_as_date(v), layout))))

    return mapped


def _in_shape(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced by those of ``digits``, in order."""

    def char(i: Column) -> Column:
        c = F.substring(m, i, F.lit(1))
        before = F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.between("0", "9"), F.substring(digits, before, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), char), "")


def _shifted_digits(d: Column, key: str, kind: str) -> Column:
    """Digits of any number from 2 on, permuted among those of the same length."""
    low_n = F.floor(F.length(d) / 2).cast("int")
    high_n = F.length(d) - low_n
    size = lambda n: F.pow(F.lit(10), n).cast("long")
    halves = permuted(_long(F.substring(d, F.lit(1), high_n)), _long(F.substring(d, high_n + 1, low_n)), key, kind, size(high_n), size(low_n))
    return _bound(F.array(*halves), lambda v: F.concat(F.lpad(v[0].cast("string"), high_n, "0"), F.lpad(v[1].cast("string"), low_n, "0")))


def _card(m: Column, key: str) -> Column:
    """Length, separators and first digit stay; the check digit is made right again."""

    def mapped(d: Column) -> Column:
        inner = F.concat(F.substring(d, 1, 1), _shifted_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        whole = _bound(inner, lambda x: F.concat(x, ((10 - luhn(F.concat(x, F.lit("0")))) % 10).cast("string")))
        return F.when(luhn(d) == 0, _bound(whole, lambda x: _in_shape(m, x)))

    return _bound(F.regexp_replace(m, "[^0-9]", ""), mapped)


def _ssn(m: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def mapped(p: Column) -> Column:
        area = p[0] - 1 - (p[0] > 666).cast("long")
        halves = permuted(area * 99 + p[1] - 1, p[2] - 1, key, "ssn", F.lit(898 * 99), F.lit(9999))

        def shaped(v: Column) -> Column:
            a = F.floor(v[0] / 99) + 1
            return F.concat_ws("-", _padded(a + (a >= 666).cast("long"), 3), _padded(v[0] % 99 + 1, 2), _padded(v[1] + 1, 4))

        return F.when(p[0].between(1, 899) & (p[0] != 666) & (p[1] > 0) & (p[2] > 0), _bound(F.array(*halves), shaped))

    return _bound(F.transform(F.split(m, "-"), _long), mapped)


def _phone(m: Column, key: str) -> Column:
    """Numbers of ten digits by area and exchange, others with a country code by their digits; shape and country code stay."""
    shape = r"^((?:\+[0-9]{1,3}[ .-]?)?\(?)([0-9]{3})(\) ?|[ .-])([0-9]{3})([ .-])([0-9]{4})$"
    group = lambda g: F.regexp_extract(m, shape, g)

    def mapped(p: Column) -> Column:
        size = lambda x: F.when(x >= 200, F.lit(800)).otherwise(F.lit(200))
        first = lambda x: F.when(x >= 200, F.lit(200)).otherwise(F.lit(0))
        halves = permuted((p[0] - first(p[0])) * size(p[1]) + p[1] - first(p[1]), p[2], key, "phone", size(p[0]) * size(p[1]), F.lit(10_000))
        return _bound(
            F.array(*halves),
            lambda v: F.concat(group(1), _padded(F.floor(v[0] / size(p[1])) + first(p[0]), 3), group(3), _padded(v[0] % size(p[1]) + first(p[1]), 3), group(5), _padded(v[1], 4)),
        )

    # the country code ends at the first separator among the first four characters after the plus, else after two digits
    code = F.regexp_replace(F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]{2})", 1), "[^0-9]", "")

    def abroad(d: Column) -> Column:
        new = F.concat(code, _shifted_digits(F.substring(d, F.length(code) + 1, F.length(d)), key, "abroad"))
        return F.when(F.length(d).between(8, 15), _bound(new, lambda x: _in_shape(m, x)))

    return F.when(F.rlike(m, F.lit(shape)), _bound(F.array(*(_long(group(g)) for g in (2, 4, 6))), mapped)).otherwise(_bound(F.regexp_replace(m, "[^0-9]", ""), abroad))


MAPS: dict[str, Callable[[Column, str], Column]] = {"email": _email, "ip": _ip, "date": _date, "card": _card, "ssn": _ssn, "phone": _phone}


def pseudonymise(docs: DataFrame, secret: str, text: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with the personal data in its texts replaced by pseudonyms under the key ``secret``.

    Adds the column ``found``: an array of (kind, pseudonym) in the order of
    the text; a column of that name is replaced.  A match that isn't valid
    (check digit, octets, calendar, number of digits) stays as it is and
    isn't listed.  Null texts stay null with an empty array, empty ones
    empty; texts of any length are taken whole.  All rows, repeated ones
    too, and other columns stay.
    """
    if not secret:
        raise ValueError("pseudonyms need a key that isn't empty")
    body = F.col(text)
    matches = "matches"
    while matches in {c.lower() for c in [*docs.columns, found]}:
        matches += "_"

    def one(m: Column) -> Column:
        kind = F.lit(None).cast("string")
        new = F.lit(None).cast("string")
        for k, p in reversed(PATTERNS):
            fits = F.rlike(m, F.lit(f"^(?:{p})$"))
            kind, new = F.when(fits, F.lit(k)).otherwise(kind), F.when(fits, MAPS[k](m, secret)).otherwise(new)
        return F.struct(m.alias("value"), F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, m).alias("pseudonym"))

    some = F.rlike(body, F.lit("[0-9@]"))
    docs = docs.withColumn(matches, F.when(some, F.transform(F.regexp_extract_all(body, F.lit(ANY), F.lit(0)), one)))
    parts = F.split(body, ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(parts, F.col(matches), lambda a, b: F.array(a, F.coalesce(b["pseudonym"], F.lit(""))))), "")
    valid = F.transform(F.filter(matches, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym")))
    nothing = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    return docs.withColumn(text, F.when(F.size(matches) > 0, whole).otherwise(body)).withColumn(found, F.coalesce(valid, nothing)).drop(matches)
