"""Personal numbers, dates and addresses become pseudonyms of their own format, by keyed Feistel permutations.

Equal values get equal pseudonyms in every document, different values different ones, and with the key the permutation
can be undone. A number that fails its format's check is left alone. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, put

ROUNDS = 8
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Formats that are looked for, the first one that fits at a place wins (fixed values).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4} [0-9]{6} [0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,5}|\([0-9]{3}\) ?[0-9]{3}[-. ][0-9]{4}|[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: The Gregorian calendar repeats after 146,097 = 189 x 773 days; dates of such a span are permuted among themselves.
FIRST_DAY, DAY_HIGH, DAY_LOW = "1800-03-01", 189, 773


def keyed(key: str, kind: str, step: Column, value: Column, most: Column) -> Column:
    """A number below ``most`` that depends on the key, the kind, the round and the value."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(kind), step.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), most)


def permute(key: str, kind: str, high: Column, low: Column, a: Column, b: Column, undo: bool = False) -> Column:
    """Feistel rounds on (high, low) of Z_a x Z_b: each half in turn gets a keyed number of the other added to it."""
    sign = -1 if undo else 1
    rounds = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    high, low, a, b = (x.cast("bigint") for x in (high, low, a, b))

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        h = F.when(even, F.pmod(s["h"] + sign * keyed(key, kind, i, s["l"], a), a)).otherwise(s["h"])
        lo = F.when(even, s["l"]).otherwise(F.pmod(s["l"] + sign * keyed(key, kind, i, s["h"], b), b))
        return F.struct(h.alias("h"), lo.alias("l"))

    return F.aggregate(F.array(*[F.lit(i) for i in rounds]), F.struct(high.alias("h"), low.alias("l")), step)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def refill(m: Column, digits: Column) -> Column:
    """The text with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    isdigit = lambda c: (c >= "0") & (c <= "9")
    step = lambda s, c: F.struct(F.concat(s["out"], F.when(isdigit(c), F.substring(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"), (s["k"] + isdigit(c).cast("int")).alias("k"))
    return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, step)["out"]


def pad(n: Column, width: Column) -> Column:
    return F.lpad(n.cast("string"), width, F.lit("0"))


def permute_digits(key: str, kind: str, digits: Column, undo: bool) -> Column:
    """A digit string of 2 to 34 digits, permuted among the strings of its length."""

    def body(d: Column) -> Column:
        n = F.char_length(d)
        cut = F.floor(n / 2).cast("int")
        a, b = F.pow(F.lit(10.0), cut).cast("bigint"), F.pow(F.lit(10.0), n - cut).cast("bigint")
        done = permute(key, f"{kind}", F.substring(d, F.lit(1), cut).cast("bigint"), F.substring(d, cut + 1, n - cut).cast("bigint"), a, b, undo)
        return let(done, lambda s: F.concat(pad(s["h"], cut), pad(s["l"], n - cut)))

    return F.when(F.char_length(digits) < 2, digits).otherwise(let(digits, body))


def luhn_sum(digits: Column) -> Column:
    """The weighted sum whose last digit is 0 for a valid number with its check digit."""

    def weighted(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + i % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), weighted), F.lit(0), lambda s, x: s + x)


def card(key: str, m: Column, undo: bool) -> Column:
    """The first digit stays, the others are permuted, the check digit is set anew. Only numbers that pass the check."""

    def body(d: Column) -> Column:
        n = F.char_length(d)
        inner = permute_digits(key, "card", F.substring(d, F.lit(2), n - 2), undo)
        start = F.concat(F.substring(d, 1, 1), inner)
        return let(start, lambda s: F.concat(s, F.pmod(10 - luhn_sum(F.concat(s, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    digits = only_digits(m)
    return F.when(luhn_sum(digits) % 10 == 0, refill(m, let(digits, body))).otherwise(m)


def ipv4(key: str, m: Column, undo: bool) -> Column:
    parts = F.split(m, r"\.")
    p = lambda i: F.element_at(parts, i).cast("bigint")
    done = permute(key, "ipv4", p(1) * 256 + p(2), p(3) * 256 + p(4), F.lit(65536), F.lit(65536), undo)
    return let(done, lambda s: F.concat_ws(".", F.floor(s["h"] / 256), s["h"] % 256, F.floor(s["l"] / 256), s["l"] % 256))


def ssn(key: str, m: Column, undo: bool) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area, group, serial = F.substring(m, 1, 3).cast("bigint"), F.substring(m, 5, 2).cast("bigint"), F.substring(m, 8, 4).cast("bigint")
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    done = permute(key, "ssn", area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), undo)
    out = lambda s: F.concat_ws("-", pad(s["h"] + 1 + (s["h"] >= 665).cast("int"), F.lit(3)), pad(F.floor(s["l"] / 9999) + 1, F.lit(2)), pad(s["l"] % 9999 + 1, F.lit(4)))
    return F.when(valid, let(done, out)).otherwise(m)


def phone(key: str, m: Column, undo: bool) -> Column:
    """8 to 15 digits; a country code stays. Ten digits of the North American plan are permuted among the numbers with
    area and exchange codes from 200; those with a lower area code, and those with a lower exchange code, among
    themselves.
    """
    digits = only_digits(m)
    country = F.when(m.startswith("+1"), "1").otherwise(F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1))
    country = F.when(m.startswith("+") & (country == ""), F.substring(digits, 1, 2)).otherwise(country)

    def body(s: Column) -> Column:
        code, d = s["code"], s["rest"]
        area, rest, exchange = F.substring(d, 1, 3).cast("bigint"), F.substring(d, 4, 7).cast("bigint"), F.substring(d, 4, 3).cast("bigint")
        low, cut = F.when(area < 200, 0).otherwise(200), F.when((area >= 200) & (exchange >= 200), 2_000_000).otherwise(0)
        size = F.when(area < 200, 10_000_000).when(exchange < 200, 2_000_000).otherwise(8_000_000)
        done = permute(key, "phone", area - low, rest - cut, F.when(area < 200, 200).otherwise(800), size, undo)
        ten = let(done, lambda x: F.concat(pad(x["h"] + low, F.lit(3)), pad(x["l"] + cut, F.lit(7))))
        plan = ((code == "1") | (code == "")) & (F.char_length(d) == 10)
        return F.concat(code, F.when(plan, ten).otherwise(permute_digits(key, "phone", d, undo)))

    whole = F.struct(country.alias("code"), F.substring(digits, F.char_length(country) + 1, F.lit(20)).alias("rest"))
    return F.when(F.char_length(digits).between(8, 15), refill(m, let(whole, body))).otherwise(m)


def date(key: str, m: Column, undo: bool) -> Column:
    """Days from 1800-03-01 to 2200-02-28. With slashes the month comes first if such a day exists, else second; as the
    pseudonym may be a date of either reading, day-first dates with slashes can't always be told apart on the way back.
    A day or month of one digit comes back with two if its pseudonym needs two.
    """
    sep = F.regexp_extract(m, "[^0-9]", 0)
    p = F.split(m, "[^0-9]")
    q = lambda i: F.element_at(p, i)
    day = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, mo.cast("int"), d.cast("int")), "yyyy-M-d")
    year_first = F.char_length(q(1)) == 4
    month_first = (sep == "/") & day(q(3), q(1), q(2)).isNotNull()
    value = F.when(year_first, day(q(1), q(2), q(3))).when(month_first, day(q(3), q(1), q(2))).otherwise(day(q(3), q(2), q(1)))
    n = F.date_diff(value, F.lit(FIRST_DAY).cast("date"))
    done = permute(key, "date", F.floor(n / DAY_LOW), n % DAY_LOW, F.lit(DAY_HIGH), F.lit(DAY_LOW), undo)
    new = let(F.date_add(F.lit(FIRST_DAY).cast("date"), let(done, lambda s: (s["h"] * DAY_LOW + s["l"]).cast("int"))), lambda d: F.struct(F.date_format(d, "yyyy").alias("y"), F.month(d).alias("m"), F.day(d).alias("d")))
    wide = lambda x, like: pad(x, F.greatest(F.char_length(like), F.char_length(x.cast("string"))))
    out = lambda s: F.when(year_first, F.concat_ws(sep_, s["y"], wide(s["m"], q(2)), wide(s["d"], q(3)))).when(month_first, F.concat_ws(sep_, wide(s["m"], q(1)), wide(s["d"], q(2)), s["y"])).otherwise(F.concat_ws(sep_, wide(s["d"], q(1)), wide(s["m"], q(2)), s["y"]))
    sep_ = "\x1f"
    text = F.replace(let(new, out), F.lit(sep_), sep)
    return F.when(n.between(0, DAY_HIGH * DAY_LOW - 1), text).otherwise(m)


def email(key: str, m: Column, undo: bool) -> Column:
    """Letters and digits of the part before the @ are permuted within their class; the host stays."""
    local, host = F.substring_index(m, "@", 1), F.concat(F.lit("@"), F.substring_index(m, "@", -1))
    sign = -1 if undo else 1

    def shift(half: Column, other: Column, i: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            k = sign * keyed(key, "email", i, F.concat_ws("\x1e", other, j), F.lit(26 * 10))
            move = lambda base, n: F.char((base + F.pmod(F.ascii(c) - base + k, F.lit(n))).cast("bigint"))
            return F.when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).when(c.between("0", "9"), move(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(F.when(even, shift(s["h"], s["l"], i)).otherwise(s["h"]).alias("h"), F.when(even, s["l"]).otherwise(shift(s["l"], s["h"], i)).alias("l"))

    cut = F.floor(F.char_length(local) / 2).cast("int")
    rounds = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    begin = F.struct(F.substring(local, F.lit(1), cut).alias("h"), F.substring(local, cut + 1, F.lit(64)).alias("l"))
    return F.concat(let(F.aggregate(F.array(*[F.lit(i) for i in rounds]), begin, step), lambda s: F.concat(s["h"], s["l"])), host)


MAKERS = {"email": email, "ipv4": ipv4, "date": date, "ssn": ssn, "card": card, "phone": phone}


def kind_of(m: Column) -> Column:
    """Kind of a found text, by its shape."""
    out = F.when(m.contains("@"), "email").when(m.rlike(rf"^{PATTERNS['ipv4']}$"), "ipv4").when(m.rlike(f"^{PATTERNS['date']}$"), "date")
    return out.when(m.rlike(f"^{PATTERNS['ssn']}$"), "ssn").when(m.rlike(f"^{PATTERNS['card']}$"), "card").otherwise("phone")


def pseudonymise(docs: DataFrame, key: str, undo: bool = False) -> DataFrame:
    """``docs`` with values in ``text`` replaced, and ``pii_kinds``: the kind of each replaced value in order.

    A null text stays null, with no kinds; a text without digits or @ stays as it is. Values that fail their check, such
    as card numbers with a wrong check digit or days that don't exist, stay and aren't listed. A value may be its own
    pseudonym, as in any permutation; it is listed all the same. undo: from pseudonyms back to the values, with the same
    key. Equal rows stay equal. An empty table gives an empty result. A column named pii_kinds is replaced.
    """
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))

    def one(m: Column) -> Column:
        kind = kind_of(m)

        def made(k: Column) -> Column:
            new = F.lit(None).cast("string")
            for name, maker in MAKERS.items():
                new = F.when(k == name, maker(key, m, undo)).otherwise(new)
            return F.struct(m.alias("old"), new.alias("new"), k.alias("kind"), _valid(k, m).alias("ok"))

        return let(kind, made)

    values = F.transform(found, one)
    pieces = F.split(text, f"(?:{ANY})", -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.concat(F.transform(values, lambda v: v["new"]), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    candidate = text.rlike("[0-9@]") & text.rlike(f"(?:{ANY})")
    none = F.array().cast("array<string>")
    kinds = F.when(candidate, F.transform(F.filter(values, lambda v: v["ok"]), lambda v: v["kind"])).otherwise(none)
    return put(docs, {"pii_kinds": F.coalesce(kinds, none), "text": held(F.when(candidate, joined).otherwise(text))}).select(*[F.col(f"`{c}`") for c in _order(docs, "pii_kinds")])


def _valid(kind: Column, m: Column) -> Column:
    """Does the value pass its format's check?"""
    digits = only_digits(m)
    area = F.substring(digits, 1, 3).cast("bigint")
    is_ssn = area.between(1, 899) & (area != 666) & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    day = lambda f: F.try_to_date(F.regexp_replace(m, "[^0-9]", "-"), f)
    least, most = F.lit(FIRST_DAY).cast("date"), F.date_add(F.lit(FIRST_DAY).cast("date"), DAY_HIGH * DAY_LOW - 1)
    is_date = F.coalesce(day("yyyy-M-d").between(least, most), F.lit(False)) | F.coalesce(day("d-M-yyyy").between(least, most), F.lit(False)) | (m.contains("/") & F.coalesce(day("M-d-yyyy").between(least, most), F.lit(False)))
    out = F.when(kind == "card", luhn_sum(digits) % 10 == 0).when(kind == "ssn", is_ssn).when(kind == "date", is_date)
    return out.when(kind == "phone", F.char_length(digits).between(8, 15)).otherwise(True)


def _order(docs: DataFrame, last: str) -> list[str]:
    return [c for c in docs.columns if c.lower() != last] + [last]
