"""Medians and pages by counts of value ranges, against sorting; newest days by footers."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pumpwatch.operators import selection as sl
from pumpwatch.operators import snapshots as sn
from pumpwatch.sources import statistics as st


@pytest.mark.parametrize("few, kind", [(10_000, "double"), (3, "double"), (3, "decimal(12,2)"), (1, "int")])
def test_medians_equal_sorting(spark, few, kind):
    r = random.Random(few)
    rows = []
    for g, n in (("odd", 61), ("even", 60), ("ties", 80), ("one", 1), (None, 40), ("nulls", 3)):
        for _ in range(n):
            v = {"ties": r.choice([5.0, 5.0, 5.0, 7.25]), "nulls": None}.get(g, round(r.gauss(0, 1e4) if kind == "double" else r.uniform(-900, 900), 2))
            rows.append((g, r.choice(["a", None]), v if kind != "int" or v is None else float(int(v))))
    rows.append(("odd", "a", None))
    df = spark.createDataFrame(rows, "g string, h string, v double").withColumn("v", F.col("v").cast(kind))
    want = {}
    for g, h, v in rows:
        want.setdefault((g, h), []).extend([] if v is None else [v])
    got = {(r.g, r.h): r.median for r in sl.medians(df, ["g", "h"], "v", few).collect()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == (pytest.approx(statistics.median(values)) if values else None), key
    assert sl.medians(df.where("g = 'no'"), ["g"], "v").count() == 0
    (every,) = sl.medians(df, [], "v", few).collect()
    assert every.median == pytest.approx(statistics.median([v for _, _, v in rows if v is not None]))


def test_medians_keep_a_bounded_state(spark):
    """With very many rows a group is narrowed before any rows are collected."""
    df = spark.range(200_000).select((F.col("id") % 2).alias("g"), (F.hash("id") % 1_000_000).cast("double").alias("v"))
    want = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert {r.g: r.median for r in sl.medians(df, ["g"], "v", few=500).collect()} == want


ORDER = [("t", True), ("i", False)]


@pytest.mark.parametrize("few", [10_000, 10, 1])
def test_rows_between_equals_sorting(spark, few):
    r = random.Random(few)
    day = dt.datetime(2024, 1, 1)
    rows = [(None if r.random() < 0.1 else day + dt.timedelta(seconds=r.choice([0, 0, 1, 5, 10**6 + r.randint(0, 50)])), i, "x")
            for i in range(300)] + [(day, None, "y")]
    df = spark.createDataFrame(rows, "t timestamp, i long, note string")
    # None is last in either direction
    want = [(t, i) for t, i, _ in sorted(rows, key=lambda x: (x[0] is None, -(x[0] or day).timestamp(), x[1] is None, x[1] or 0))]
    for first, last in ((0, 7), (40, 60), (150, 151), (280, 400), (301, 310), (0, 301)):
        got = {(x.t, x.i) for x in sl.rows_between(df, ORDER, first, last, few=few).collect()}
        assert got == set(want[first:last])


def test_far_page_sorts_few_rows(spark):
    df = spark.range(200_000).select(F.timestamp_seconds(F.xxhash64("id") % 1_000_000).alias("timestamp"), "id", F.lit("d").alias("dataset"))
    page = sn.lookahead_page(df, "d", page=3000, size=50)
    assert [c for c in page.columns] == ["timestamp", "id", "dataset", "has_next"]
    want = df.orderBy(F.col("timestamp").desc(), F.col("id").desc()).offset(2999 * 50).limit(50)
    assert sorted((r.timestamp, r.id) for r in page.collect()) == sorted((r.timestamp, r.id) for r in want.collect())
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "Offset" not in plan
    limits = [int(x.split()[1].rstrip(",")) for x in plan.splitlines() for x in [x.strip(" :+-")] if x.startswith(("GlobalLimit", "LocalLimit"))]
    assert limits and max(limits) <= 2 * sl.FEW + 51, limits
    assert sn.lookahead_page(df, "d", page=4000, size=50).select("has_next").distinct().collect()[0][0] is False
    assert sn.lookahead_page(df, "d", page=4001, size=50).count() == 0


def _find(df, n):
    def find(since):
        asked.append(since)
        rows = df if since is None else df.where(F.col("ts") >= F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz"))
        return [r[0] for r in rows.where("ts IS NOT NULL").select(F.date_trunc("day", "ts").alias("d")).distinct().orderBy(F.col("d").desc()).limit(n).collect()]
    asked = []
    return find, asked


def _day(t):
    return t.replace(hour=0, minute=0, second=0, microsecond=0)


def test_newest_days_by_footers(spark, tmp_path):
    path = str(tmp_path / "facts")
    hours = spark.range(24 * 90).select(F.col("id").alias("other"), F.expr("timestampadd(HOUR, id, timestamp_ntz'2024-01-01 00:30:00')").alias("ts"))
    rows = hours.where("other < 2000 OR other > 2100").unionAll(hours.limit(3).select("other", F.lit(None).cast("timestamp_ntz")))
    rows.repartitionByRange(9, "ts").write.parquet(path)
    df = spark.read.parquet(path)
    known = st.footer_range(spark, path, "ts")
    assert known == df.agg(F.min("ts"), F.max("ts")).first()[0:2]
    assert "PushedAggregation: [MIN(ts), MAX(ts)]" in st.footer_aggregate(spark, path, "ts")._jdf.queryExecution().executedPlan().toString()
    for n in (1, 2, 11, 400):
        find, asked = _find(df, n)
        want = _find(df, n)[0](None)
        assert st.newest_periods(find, known, _day, dt.timedelta(days=1), n) == want
        assert (asked[-1] is None) == (n == 400) and (n > 2 or len(asked) == 1)
    # a wrong guess only costs time
    for guess in ((dt.datetime(1970, 1, 1), dt.datetime(1970, 1, 2)), (known[0], dt.datetime(2100, 1, 1)), None):
        assert st.newest_periods(_find(df, 3)[0], guess, _day, dt.timedelta(days=1), 3) == _find(df, 3)[0](None)


def test_newest_days_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.range(0).select("id", F.lit(None).cast("timestamp_ntz").alias("ts")).write.parquet(path)
    assert st.footer_range(spark, path, "ts") is None


def test_only_newest_row_groups_are_read(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.range(24 * 50).select(F.expr("timestampadd(HOUR, id, timestamp_ntz'2024-01-01 00:30:00')").alias("ts")) \
        .repartitionByRange(10, "ts").write.parquet(path)
    asked = spark.read.parquet(path).where(F.col("ts") >= F.lit("2024-02-19 00:00:00").cast("timestamp_ntz"))
    assert "GreaterThanOrEqual(ts" in asked._jdf.queryExecution().executedPlan().toString()
    high = st.footer_range(spark, path, "ts")[1]
    assert high == dt.datetime(2024, 2, 19, 23, 30)


def test_pivot_median_and_shares_take_missing_attributes(spark):
    from pumpwatch.operators import pivot as pv
    rows = [(None, "x", 1.0), (None, "x", 3.0), ("a", None, 0.0), ("a", "x", 5.0), ("a", "y", None), ("b", None, 0.0)]
    df = spark.createDataFrame(rows, "r string, c string, v double")
    got = {(x.r, x.c, x.is_total_row, x.is_total_col): (x.med, x.n) for x in pv.pivot_long(df, ["r"], ["c"], "v", {"med": "median", "n": "count"}).collect()}
    assert got[None, "x", False, False] == (2.0, 2) and got[None, None, True, True] == (1.0, 6)
    assert got[None, "x", True, False] == (3.0, 3) and got["a", "y", False, False] == (None, 1) and len(got) == 12
    one = pv.pivot_long(df, [], [], "v", {"med": "median"}).collect()
    assert [(x.med, x.is_total_row, x.is_total_col) for x in one] == [(1.0, True, True)]
    shares = {(x.r, x.c, x.is_total_row, x.is_total_col): (x.of_row, x.of_col, x.of_total) for x in pv.pivot_shares(df, ["r"], ["c"], "v").collect()}
    assert shares[None, "x", False, False] == (1.0, 4 / 9, 4 / 9) and shares["a", "x", False, False] == (1.0, 5 / 9, 5 / 9)
    assert shares["b", None, False, False] == (None, None, 0.0)         # a row and a column that add up to nothing
    assert shares[None, None, True, True] == (1.0, 1.0, 1.0) and shares["a", "y", False, False] == (None, None, None)
