"""Snapshot selection traps: Max(id) per bucket, inclusive ranges, paging guards."""

import datetime as dt

from pumpwatch.operators import snapshots as sn

SCHEMA = "id long, timestamp timestamp, status string, dataset string"


def snaps(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_bucket_representative_is_max_id(spark):
    rows = [(5, dt.datetime(2024, 1, 1, 10, 59), "processed", "a"),
            (9, dt.datetime(2024, 1, 1, 10, 1), "processed", "a")]
    sel = sn.select_snapshots(snaps(spark, rows), "a", "hour")
    assert [r.id for r in sel.snapshots.collect()] == [9]


def test_range_inclusive_and_too_many(spark):
    rows = [(i, dt.datetime(2024, 1, i), "processed", "a") for i in range(1, 6)]
    sel = sn.select_snapshots(snaps(spark, rows), "a", "day", start="2024-01-02 00:00:00",
                              end="2024-01-04 00:00:00", max_snapshots=3)
    assert sorted(r.id for r in sel.snapshots.collect()) == [2, 3, 4]
    big = sn.select_snapshots(snaps(spark, rows), "a", "day", start="2024-01-01 00:00:00",
                              end="2024-01-05 00:00:00", max_snapshots=3)
    assert big.too_many and big.total == 5 and big.snapshots.count() == 0


def test_empty_selection_page_one_of_one(spark):
    sel = sn.select_snapshots(snaps(spark, []), "a", "latest", page=7)
    assert (sel.page, sel.total_pages, sel.total) == (1, 1, 0)
    assert sel.snapshots.count() == 0


def test_unknown_mode_is_latest_and_status_filter(spark):
    rows = [(1, dt.datetime(2024, 1, 1), "processed", "a"),
            (2, dt.datetime(2024, 1, 2), "error", "a")]
    sel = sn.select_snapshots(snaps(spark, rows), "a", "fortnight")
    assert sel.mode == "latest" and [r.id for r in sel.snapshots.collect()] == [1]


def test_week_starts_monday(spark):
    # 2024-01-07 is a Sunday, 2024-01-08 a Monday
    rows = [(1, dt.datetime(2024, 1, 7, 12), "processed", "a"),
            (2, dt.datetime(2024, 1, 8, 12), "processed", "a")]
    got = {r.id: r.period for r in
           sn.select_snapshots(snaps(spark, rows), "a", "week").snapshots.collect()}
    assert got[1] == dt.datetime(2024, 1, 1) and got[2] == dt.datetime(2024, 1, 8)


def test_lookahead_has_next(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "processed", "a")
            for i in range(7)]
    p1 = sn.lookahead_page(snaps(spark, rows), "a", page=1, size=5).collect()
    p2 = sn.lookahead_page(snaps(spark, rows), "a", page=2, size=5).collect()
    assert len(p1) == 5 and all(r.has_next for r in p1)
    assert len(p2) == 2 and not any(r.has_next for r in p2)


def test_keyset_page_continues_after_last_row(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2), "processed", "a")
            for i in range(9)]
    s = snaps(spark, rows)
    first = sn.keyset_page(s, size=4).collect()
    last = first[-1]
    nxt = sn.keyset_page(s, after_ts=last.timestamp, after_id=last.id, size=4).collect()
    seen = [r.id for r in first] + [r.id for r in nxt]
    assert seen == [8, 7, 6, 5, 4, 3, 2, 1]


def test_paging_facts_clamp(spark):
    rows = [(i, dt.datetime(2024, 1, 1), "processed", "a") for i in range(5)]
    reg = spark.createDataFrame([("a", 2), ("b", 2)], "name string, max_snapshots int")
    got = {r.dataset: (r.total, r.total_pages, r.page, r.offset)
           for r in sn.paging_facts(snaps(spark, rows), reg, 9).collect()}
    assert got == {"a": (5, 3, 3, 4), "b": (0, 1, 1, 0)}
