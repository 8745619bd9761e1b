"""Pseudonyms: permutations within a format, links across spellings, what is left alone."""

import datetime as dt
import re

from pyspark.sql import functions as F

from pumpwatch.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban):
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def run(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(pii.pseudonymise(df, **kw).collect(), key=lambda r: r.doc_id)
    return [r.text for r in rows], [[tuple(x) for x in r.pii] for r in rows]


def test_values_keep_their_form_and_their_checks(spark):
    texts = ["card 4111 1111 1111 1111, again 4111111111111111.", "IBAN DE89 3704 0044 0532 0130 00 end",
             "call +1 (988) 555-0546%%% or 988-555-0546", "ssn 123-45-6789!", "host 64.147.79.24, port",
             "born 2000-02-29 or 29/02/2000 or 02/29/2000 or 29.02.2000", "mail Ann.Lee7@mail2.example.com now"]
    out, found = run(spark, texts)
    for before, after in zip(texts, out):
        shape = lambda s: re.sub(r"\d", "9", s)
        if "@" not in before and "host" not in before:
            assert shape(before) == shape(after) and before != after
    a, b = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[0])
    assert a.replace(" ", "") == b and luhn(b)
    assert mod97(re.search(r"DE[\d ]+\d", out[1]).group()) == 1
    p = re.findall(r"(\d{3})\D{1,2}(\d{3})-(\d{4})", out[2])
    assert p[0] == p[1]
    assert re.match(r"ssn (?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}!$", out[3])
    assert all(int(x) < 256 for x in re.search(r"[\d.]+\d", out[4]).group().split("."))
    iso, d1, d2, d3 = re.findall(r"[\d./-]{10}", out[5])
    day = dt.date.fromisoformat(iso)
    assert [dt.datetime.strptime(x, f).date() for x, f in ((d1, "%d/%m/%Y"), (d2, "%m/%d/%Y"), (d3, "%d.%m.%Y"))] == [day] * 3
    assert re.match(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@mail2\.example\.com now$", out[6])
    assert [[k for k, _, _ in x] for x in found] == [
        ["card"] * 2, ["iban"], ["phone"] * 2, ["ssn"], ["ip"], ["date"] * 4, ["email"]]


def test_what_is_no_value_stays(spark):
    texts = ["4111111111111112 and 1234567890123 and 0000000000000000", "version 1.2.3 of 1.2.3.4.5, 300.1.1.1",
             "30/02/2000 2001-02-29 0001-01-01", "000-12-3456 666-12-3456 12-34", "a@b", "plain text", "", "5-7 9.9.",
             "DE88370400440532013000"]
    out, found = run(spark, texts)
    assert out == texts and not any(found)


def test_permutations(spark):
    long = lambda *x: F.array(*[(v if hasattr(v, "cast") else F.lit(v)).cast("long") for v in x])
    n = F.col("id")
    for moduli in ((189, 773), (10, 10, 10, 10), (898, 99), (26, 10, 26)):
        size, values, rest = 1, [], n
        for m in reversed(moduli):
            values.insert(0, rest % m)
            rest = F.floor(rest / m)
            size *= m
        new = spark.range(size).select(pii.permute(long(*values), long(*moduli), "kind", "key").alias("p"))
        limits = [new.agg(F.max(F.col("p")[i]), F.min(F.col("p")[i])).first() for i in range(len(moduli))]
        assert new.distinct().count() == size and [tuple(x) for x in limits] == [(m - 1, 0) for m in moduli]


def test_key_and_order(spark):
    texts = ["b@x.org 1.1.1.1 a@x.org"]
    one, two = run(spark, texts, key="one")[0][0], run(spark, texts, key="two")[0][0]
    assert one != two and run(spark, texts, key="one")[0][0] == one


def test_odd_and_empty(spark, odd, empty):
    rows = pii.pseudonymise(odd, found="_pii").drop("_pii")
    assert rows.columns == odd.columns and rows.exceptAll(odd).count() == 0 and rows.count() == odd.count()
    assert pii.pseudonymise(empty).count() == 0
    long = "a" * 60_000 + "@" + "b." * 30_000 + " 1" * 30_000 + " 7" + "0" * 30_000 + " 10.0.0.1"
    out, found = run(spark, [long])
    assert out[0][:-12] == long[:-8][:len(out[0][:-12])] and [k for k, _, _ in found[0]] == ["ip"]
