"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

Found values are validated, then permuted within their format, check digits
worked out anew, so a pseudonym has the value's form, and equal values have equal pseudonyms in all
documents, however they are written. DataFrame functions only, no shuffle.

A value is a list of numbers, each below its own modulus: the digits of a card
or phone number, the bytes of an IPv4 address, a day as quotient and remainder,
the letters and digits of an e-mail address's local part. The even and the odd
places are the two halves of the network: each round adds to every place of one
half, modulo that place's modulus, a pseudo-random number made of the key, the
kind, the round, the place and the whole other half. A round can be undone, so
the network is a permutation of the values of the format.

====== ======================================================================
kind   value and check
====== ======================================================================
email  local part and domain name; letters and digits of the local part change
card   13 to 19 digits, plain or in groups, with a right Luhn digit
iban   country, check digits right modulo 97; the digits of the account change
phone  ten digits in the North American shape, with or without +1
ssn    ddd-dd-dddd in the ranges that are given out
ip     four numbers up to 255
date   a day from 1800 to 2199 that exists: y-m-d, d/m/y (or m/d/y), d.m.y
====== ======================================================================
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "pumpwatch-pseudonyms"
KINDS = ("email", "card", "iban", "phone", "ssn", "ip", "date")

BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What may be a value, most specific first. Repetitions are bounded and begin at a
#: word's start, so a long run without spaces is read once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)",
    "ip": rf"(?<![\d.])(?:{BYTE}\.){{3}}{BYTE}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "phone": r"(?<![\d.-])(?:(?:\+?1[ .-]?)?\(\d{3}\)[ .-]?|\+1[ .-]?\d{3}[ .-]?|(?:1[ .-])?[2-9]\d{2}[ .-])\d{3}[ .-]?\d{4}(?![\d-])",
    "card": r"(?<!\d)\d{13,19}(?!\d)|(?<!\d)\d{4}(?: \d{4}){3}(?!\d)|(?<!\d)\d{4}(?:-\d{4}){3}(?!\d)"
            r"|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _each(text: Column, what: Callable[[Column, Column], Column]) -> Column:
    """``what(character, 0-based place)`` of every character of a non-empty text."""
    return F.transform(F.sequence(F.lit(1), F.length(text)),
                       lambda i: what(F.substr(text, i, F.lit(1)), i - 1))


def _only(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, f"[^{chars}]", "")


def permute(values: Column, moduli: Column, kind: str, key: str) -> Column:
    """Feistel network on an array of integers below ``moduli``."""
    def seeded(half: Column, moduli: Column, r: Column) -> Column:
        other = F.array_join(F.filter(half, lambda _, j: j % 2 != r % 2).cast("array<string>"), ",")
        return _let(F.concat_ws("|", F.lit(key), F.lit(kind), F.size(half).cast("string"), r.cast("string"), other),
                    lambda seed: F.transform(half, lambda v, i: F.when(i % 2 == r % 2, F.pmod(
                        v + F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")), 256), 1, 15), 16, 10)
                        .cast("long"), F.element_at(moduli, i + 1))).otherwise(v)))
    return _let(moduli, lambda m: F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values.cast("array<bigint>"), lambda half, r: seeded(half, m, r)))


def _tens(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(10).cast("long"))


def _digits(text: Column) -> Column:
    return _each(text, lambda c, _: c.cast("long"))


def _luhn_sum(digits: Column, first_doubled: bool) -> Column:
    """Sum of the digits (an array), every second one from the right doubled."""
    back = F.reverse(digits)
    odd = 0 if first_doubled else 1
    part = F.transform(back, lambda d, i: F.when(i % 2 != odd, d).otherwise(
        2 * d - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def _lay_out(layout: Column, chars: str, values: Column) -> Column:
    """``layout`` with its characters of the class ``chars`` replaced by those of ``values`` (text), in order."""
    return _let(values, lambda new: F.array_join(_each(layout, lambda c, i: F.when(c.rlike(f"[{chars}]"), F.substr(
        new, F.length(_only(F.substr(layout, F.lit(1), i + 1), chars)), F.lit(1))).otherwise(c)), ""))


def _card(m: Column, key: str) -> Column:
    digits = _only(m, "0-9")
    return _lay_out(m, "0-9", _let(_digits(F.substr(digits, F.lit(1), F.length(digits) - 1)), lambda body: _let(
        permute(body, _tens(body), "card", key), lambda new: F.concat(
            F.array_join(new.cast("array<string>"), ""), F.pmod(-_luhn_sum(new, True), F.lit(10)).cast("string")))))


def _is_card(m: Column) -> Column:
    return (_luhn_sum(_digits(_only(m, "0-9")), False) % 10 == 0) & m.rlike("[1-9]")


def _phone(m: Column, key: str) -> Column:
    digits = _only(m, "0-9")
    national = _digits(F.right(digits, F.lit(10)))
    new = _let(national, lambda d: permute(d, _tens(d), "phone", key))
    return _lay_out(m, "0-9", F.concat(F.left(digits, F.length(digits) - 10),
                                       F.array_join(new.cast("array<string>"), "")))


def _ssn(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, "-"), lambda x: x.cast("long"))
    area = F.element_at(part, 1)
    moduli = F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)])
    values = F.array(area - F.when(area > 666, 2).otherwise(1), F.element_at(part, 2) - 1, F.element_at(part, 3) - 1)

    def shown(new: Column) -> Column:
        area = F.element_at(new, 1) + 1
        return F.concat_ws("-", F.lpad((area + F.when(area >= 666, 1).otherwise(0)).cast("string"), 3, "0"),
                           F.lpad((F.element_at(new, 2) + 1).cast("string"), 2, "0"),
                           F.lpad((F.element_at(new, 3) + 1).cast("string"), 4, "0"))
    return _let(permute(values, moduli, "ssn", key), shown)


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    moduli = F.array(*[F.lit(256).cast("long")] * 4)
    return F.array_join(permute(part, moduli, "ip", key).cast("array<string>"), ".")


#: Days from 1800-01-01 to 2199-12-31, one cycle of the calendar: 146097 = 189 * 773.
FIRST_DAY, HIGH, LOW = "1800-01-01", 189, 773


def _day(m: Column) -> Column:
    """The day that a text names, null if there is none: year first, or last after day and month
    (month and day where only that is a day)."""
    part = F.split(m, "[-/.]")
    at = lambda i: F.element_at(part, i)
    made = lambda y, mo, d: F.try_to_date(F.concat_ws("-", at(y), F.lpad(at(mo), 2, "0"), F.lpad(at(d), 2, "0")), "yyyy-MM-dd")
    day = F.when(m.contains("-"), made(1, 2, 3)).otherwise(F.coalesce(made(3, 2, 1), F.when(m.contains("/"), made(3, 1, 2))))
    return _let(day, lambda d: F.when(d.between("1800-01-01", "2199-12-31"), d))


def _date(m: Column, key: str) -> Column:
    month_first = m.contains("/") & (F.split(m, "/")[1].cast("int") > 12)
    moduli = F.array(F.lit(HIGH).cast("long"), F.lit(LOW).cast("long"))

    def shown(new: Column) -> Column:
        day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.element_at(new, 1) * LOW + F.element_at(new, 2)).cast("int"))
        return F.when(m.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(
            m.contains("."), F.date_format(day, "dd.MM.yyyy")).when(
            month_first, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return _let(F.datediff(_day(m), F.lit(FIRST_DAY).cast("date")).cast("long"), lambda number: _let(
        permute(F.array(F.floor(number / LOW), number % LOW), moduli, "date", key), shown))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    least = lambda c: F.when(c >= 97, 97).when(c >= 65, 65).otherwise(48).cast("long")

    def changed(code: Column) -> Column:
        moduli = F.transform(code, lambda c: F.when(c >= 65, 26).otherwise(10).cast("long"))
        new = permute(F.transform(code, lambda c: c - least(c)), moduli, "email", key)
        return F.array_join(F.zip_with(new, code, lambda n, c: F.chr(n + least(c))), "")
    shown = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    new = F.when(F.length(shown) > 0, _let(_each(shown, lambda c, _: F.ascii(c).cast("long")), changed)).otherwise("")
    return F.concat(_let(local, lambda x: _lay_out(x, "A-Za-z0-9", new)), F.substr(m, F.length(local) + 1, F.length(m)))


def _mod97(chars: Column) -> Column:
    """An IBAN's letters (as 10 to 35) and digits as one number, modulo 97."""
    return F.aggregate(_each(chars, lambda c, _: F.when(c.rlike("[0-9]"), c.cast("long")).otherwise(F.ascii(c) - 55)),
                       F.lit(0).cast("long"),
                       lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97))


def _turned(iban: Column, check: Column) -> Column:
    return F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(2)), check)


def _is_iban(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return (_mod97(_turned(plain, F.substr(plain, F.lit(3), F.lit(2)))) == 1) & F.substr(
        plain, F.lit(5), F.length(plain)).rlike("[0-9]")


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substr(plain, F.lit(1), F.lit(2))

    def changed(account: Column) -> Column:
        digits = _digits(_only(account, "0-9"))
        return _lay_out(account, "0-9", _let(digits, lambda d: F.array_join(
            permute(d, _tens(d), "iban", key).cast("array<string>"), "")))
    return _lay_out(m, "A-Z0-9", _let(
        _let(F.substr(plain, F.lit(5), F.length(plain)), changed), lambda new: F.concat(country, F.lpad(
            (98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)))


def _kind(m: Column) -> Column:
    """The kind of a matched text, null if it isn't valid."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (F.when(m.contains("@"), "email")
            .when(whole("iban"), F.when(_is_iban(m), "iban"))
            .when(whole("date"), F.when(_day(m).isNotNull(), "date"))
            .when(whole("ip"), "ip").when(whole("ssn"), "ssn")
            .when(whole("phone"), "phone")
            .when(whole("card"), F.when(_is_card(m), "card")))


def pseudonym(m: Column, kind: Column, key: str = KEY) -> Column:
    """The pseudonym of a value of a kind (a text column), the text itself where kind is null."""
    made = {"email": _email, "card": _card, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}
    out = None
    for name in KINDS:
        out = F.when(kind == name, made[name](m, key)) if out is None else out.when(kind == name, made[name](m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", found: str = "pii") -> DataFrame:
    """``docs`` with every personal value of its ``text`` column replaced by its pseudonym.

    Adds ``found``: array of (kind, value, pseudonym) in text order, empty where
    there is none. A null text stays null. Other columns and repeated rows stay.
    Texts with no value are returned as they are, byte for byte.
    """
    body = F.col(text)
    may = body.rlike("[0-9@]") & body.rlike(ANY)
    matched = docs.withColumn(found, F.when(may, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))))
    kinds = matched.withColumn(found, F.transform(found, lambda m: F.struct(_kind(m).alias("kind"), m.alias("value"))))
    named = kinds.withColumn(found, F.transform(found, lambda x: F.struct(
        x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym"))))
    joined = F.array_join(F.zip_with(
        F.split(body, ANY, -1), F.col(found), lambda part, x: F.concat(part, F.coalesce(x["pseudonym"], F.lit("")))), "")
    done = named.withColumn(text, F.when(F.exists(found, lambda x: x["kind"].isNotNull()), joined).otherwise(body))
    return done.withColumn(found, F.coalesce(
        F.filter(found, lambda x: x["kind"].isNotNull()),
        F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")))
