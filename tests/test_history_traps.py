"""Small in-code fixtures for the semantic traps of the V1 history operators."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from pumpwatch.operators import observations as ob

PSCHEMA = "station_id long, fuel_type string, fetched_at timestamp, price decimal(10,2)"
SSCHEMA = "id long, name string, city string, region string"


def t(day):
    return dt.datetime(2024, 1, day)


def prices(spark, rows):
    return spark.createDataFrame([(s, f, t(d), Decimal(p)) for s, f, d, p in rows], PSCHEMA)


def stations(spark, rows=None):
    rows = rows or [(1, "A", "X", "R1"), (2, "B", "Y", "R2")]
    return spark.createDataFrame(rows, SSCHEMA)


def brute_last_change(rows):
    """Reference semantics by brute force: LAG per key, newest changed row."""
    out = {}
    by_key = {}
    for s, f, d, p in rows:
        by_key.setdefault((s, f), []).append((d, Decimal(p)))
    for k, hist in by_key.items():
        hist.sort()
        changes = [(hist[i - 1], hist[i]) for i in range(1, len(hist)) if hist[i][1] != hist[i - 1][1]]
        if changes:
            out[k] = changes[-1]
    return out


def test_small_delta_hides_earlier_drop(spark):
    rows = [(1, "d", 1, "100.00"), (1, "d", 2, "90.00"), (1, "d", 3, "90.04")]
    var = ob.price_moves(prices(spark, rows), stations(spark)).collect()
    assert len(var) == 1 and var[0].delta == 0.0  # 90.04 - 90.00 rounds to 0.0
    assert ob.top_rises(ob.price_moves(prices(spark, rows), stations(spark))).count() == 0
    assert ob.top_drops(ob.price_moves(prices(spark, rows), stations(spark))).count() == 0


def test_last_change_matches_brute_force(spark):
    rows = [(1, "d", 1, "100.00"), (1, "d", 2, "90.00"), (1, "d", 3, "100.00"),
            (1, "d", 4, "100.00"), (1, "r", 1, "5.00"), (1, "r", 2, "5.00"),
            (2, "d", 1, "1.00"), (2, "d", 3, "2.00"), (2, "d", 5, "1.00"), (2, "d", 6, "1.00")]
    got = {(r.station_id, r.fuel_type): (r.prev_fetched_at, r.fetched_at, r.prev_price, r.price)
           for r in ob.price_moves(prices(spark, rows), stations(spark)).collect()}
    want = brute_last_change(rows)
    assert set(got) == set(want)
    for k, ((d0, p0), (d1, p1)) in want.items():
        assert got[k][0] == t(d0) and got[k][1] == t(d1)
        assert got[k][2] == float(round(p0, 1)) and got[k][3] == float(round(p1, 1))


def test_several_rows_of_a_key_in_a_snapshot(spark):
    # rows of one snapshot are in order of price: 1.00 | 2.00 3.00, so the move is 2.00 -> 3.00
    rows = [(1, "d", 1, "1.00"), (1, "d", 2, "3.00"), (1, "d", 2, "2.00")]
    var = ob.price_moves(prices(spark, rows), stations(spark)).collect()
    assert [(r.prev_fetched_at, r.fetched_at, r.prev_price, r.price) for r in var] == [(t(2), t(2), 2.0, 3.0)]
    # a tie column decides: 3.00 was first, 2.00 last
    tied = prices(spark, rows).withColumn("n", F.when(F.col("price") == 3, 1).otherwise(2))
    var = ob.price_moves(tied, stations(spark), tie="n").collect()
    assert [(r.prev_price, r.price, r.delta) for r in var] == [(3.0, 2.0, -1.0)]


def test_hot_key_is_dealt_over_parts(spark):
    rows = [(1, "d", d % 28 + 1, "1.00" if d % 28 < 20 else "2.00") for d in range(500)]
    var = ob.price_moves(prices(spark, rows), stations(spark)).collect()
    assert [(r.prev_fetched_at, r.fetched_at) for r in var] == [(t(20), t(21))]


def test_only_hot_keys_are_dealt_and_evenly(spark):
    counts = spark.createDataFrame([(0, 3000)] + [(i, 10) for i in range(1, 601)], "k long, _n long")
    got = {r.k: r._parts for r in ob.hot_parts(counts, ["k"]).collect()}
    assert got == {0: 86}                                   # a third of all rows: 86 of 256 parts
    assert 3000 / got[0] <= 9000 / ob.HOT_SHARES
    assert ob.hot_parts(counts.where("k < 0"), ["k"]).count() == 0


def test_a_hot_key_beside_many_gives_the_moves_of_brute_force(spark):
    import random
    r = random.Random(7)
    rows = [(1, "d", r.randint(1, 28), f"{r.randint(1, 3)}.00") for _ in range(400)]
    rows += [(2, f"f{i}", r.randint(1, 28), f"{r.randint(1, 3)}.00") for i in range(300) for _ in range(3)]
    got = {(x.station_id, x.fuel_type): (x.prev_fetched_at, x.fetched_at, x.prev_price, x.price)
           for x in ob.price_moves(prices(spark, rows), stations(spark)).collect()}
    assert got == {k: (t(a[0]), t(b[0]), float(a[1]), float(b[1])) for k, (a, b) in brute_last_change(rows).items()}


def test_gap_lag_vs_snapshot_report(spark):
    # key present at t1 and t3, absent at t2
    rows = [(1, "d", 1, "1.00"), (1, "d", 3, "2.00"), (2, "d", 1, "1.00"), (2, "d", 2, "1.00"),
            (2, "d", 3, "1.00")]
    var = ob.price_moves(prices(spark, rows), stations(spark)).collect()
    assert [(r.prev_fetched_at, r.fetched_at) for r in var] == [(t(1), t(3))]
    ch = {r.fetched_at: r.changes for r in ob.snapshot_changes(prices(spark, rows)).collect()}
    assert ch[t(3)] == 1   # insert of key 1 at t3
    assert ch[t(2)] == 1   # deletion of key 1 at t2
    assert ch[t(1)] is None


def test_orphans_dropped_by_joins_kept_by_counts(spark):
    rows = [(1, "d", 1, "1.00"), (9, "d", 1, "0.50")]
    p, s = prices(spark, rows), stations(spark)
    assert ob.latest_prices(p, s).count() == 1
    assert ob.summary(p, s).collect()[0].prices == 2


def test_duplicates_fan_out_counted(spark):
    # two rows of one key in two adjacent snapshots: 2x2 pairs, all differ
    rows = [(1, "d", 1, "1.00"), (1, "d", 1, "2.00"), (1, "d", 2, "3.00"), (1, "d", 2, "4.00")]
    ch = {r.fetched_at: r.changes for r in ob.snapshot_changes(prices(spark, rows)).collect()}
    assert ch[t(2)] == 4
    rows_eq = [(1, "d", 1, "1.00"), (1, "d", 1, "2.00"), (1, "d", 2, "1.00"), (1, "d", 2, "1.00")]
    assert ob.changed_since_previous(prices(spark, rows_eq)).collect()[0].changed == 2


def test_oldest_snapshot_null_and_eleven(spark):
    one = ob.snapshot_changes(prices(spark, [(1, "d", 1, "1.00")])).collect()
    assert len(one) == 1 and one[0].changes is None
    eleven = [(1, "d", d, "1.00") for d in range(1, 12)]
    rep = ob.snapshot_changes(prices(spark, eleven)).collect()
    assert len(rep) == 10 and all(r.changes == 0 for r in rep)


def test_blank_region_one_na_row(spark):
    st = stations(spark, [(1, "A", "X", None), (2, "B", "Y", ""), (3, "C", "Z", "X")])
    p = prices(spark, [(1, "d", 1, "1.00"), (2, "d", 1, "3.00"), (3, "d", 1, "5.00")])
    rep = {r.region: r for r in ob.region_report(p, st).collect()}
    assert set(rep) == {"N/A", "X"}
    assert rep["N/A"].stations == 2 and rep["N/A"].d == 2.0


def test_latest_with_ties_kept(spark):
    rows = [(1, "d", 2, "1.00"), (1, "d", 2, "3.00"), (1, "d", 1, "9.00")]
    assert ob.latest_rows(prices(spark, rows)).count() == 2
    avg = ob.region_fuel_avg(prices(spark, rows), stations(spark)).collect()
    assert avg[0].avg_price == 2.0
