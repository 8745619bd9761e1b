"""Counts, KPIs, registry, purge, data quality and storage attribution on tiny fixtures."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from pumpwatch.operators import archive as ar
from pumpwatch.operators import counts as ct
from pumpwatch.operators import ingest as ig
from pumpwatch.operators import quality as qu
from pumpwatch.operators import snapshots as sn

SNAPS = "id long, timestamp timestamp, status string, dataset string"
PRICES = "snapshot_id long, station_id long, fuel_id long, price decimal(10,2)"
REG = ("id long, name string, update_frequency int, data_source_url string, active boolean, "
       "run_automatically boolean, max_snapshots int")


def _snaps(spark):
    t = dt.datetime(2024, 3, 1)
    return spark.createDataFrame([(1, t, "processed", "a"), (2, t, "processed", "a"),
                                  (3, t, "processed", "b"), (4, t, "error", None)], SNAPS)


def _prices(spark):
    return spark.createDataFrame([(1, 10, 1, D("1.5")), (1, 11, 1, D("1.6")), (3, 10, 2, D("1.7"))], PRICES)


def _registry(spark, active_a=True, active_b=False):
    return spark.createDataFrame([(1, "a", 5, "", active_a, False, 100),
                                  (2, "b", 5, "", active_b, False, 100)], REG)


def test_price_counts_zero_when_none_and_totals(spark):
    counted = ct.with_price_counts(_snaps(spark), _prices(spark))
    got = {r.id: r.price_count for r in counted.collect()}
    assert got == {1: 2, 2: 0, 3: 1, 4: 0}
    tot = {r.dataset: r.price_total for r in ct.dataset_price_total(counted).collect()}
    assert tot == {"a": 2, "b": 1, None: 0}


def test_active_dataset_first_by_id_or_empty(spark):
    assert [r.name for r in ct.active_dataset(_registry(spark, True, True)).collect()] == ["a"]
    assert ct.active_dataset(_registry(spark, False, False)).count() == 0
    switched = ct.activate(_registry(spark, True, False), 2)
    assert {r.name: r.active for r in switched.collect()} == {"a": False, "b": True}


def test_home_kpis_active_and_zeros(spark):
    counted = ct.with_price_counts(_snaps(spark), _prices(spark))
    # station 12 of dataset a has no price and still counts
    stations = spark.createDataFrame([(10, "a"), (11, "b"), (12, "a")], "id long, dataset string")
    k = ct.home_kpis(_registry(spark), counted, stations).collect()[0]
    assert (k.station_count, k.snapshot_count, k.price_count) == (2, 2, 2)
    none = ct.home_kpis(_registry(spark, False, False), counted, stations).collect()[0]
    assert (none.station_count, none.snapshot_count, none.price_count) == (0, 0, 0)


def test_fuels_used_only_by_dataset(spark):
    fuels = spark.createDataFrame([(1, "diesel"), (2, "regular"), (3, "unused")], "id long, name string")
    got = [r.name for r in ct.fuels_used(_prices(spark), fuels, _snaps(spark), "a").collect()]
    assert got == ["diesel"]


def test_purge_cascades_and_keeps_others(spark):
    stations = spark.createDataFrame([(10, "a"), (11, "b"), (12, None)], "id long, dataset string")
    s2, st2, p2 = ar.purge_dataset("a", _snaps(spark), stations, _prices(spark))
    assert sorted(r.id for r in s2.collect()) == [3, 4]
    assert sorted(r.id for r in st2.collect()) == [11, 12]
    assert [(r.snapshot_id, r.station_id) for r in p2.collect()] == [(3, 10)]


def test_dq_report_null_predicate_fails(spark):
    rows = [(-70.0, 50.0, "A", []), (None, 50.0, "B", []), (-90.0, 70.0, "", None)]
    df = spark.createDataFrame(
        rows, "longitude double, latitude double, Name string, "
              "Prices array<struct<GasType:string,Price:string,IsAvailable:boolean>>")
    got = {r.rule: (r.checked, r.failed) for r in qu.dq_report(df, qu.feature_rules()).collect()}
    assert got == {"coordinates_present": (3, 1), "longitude_in_bounds": (3, 2),
                   "latitude_in_bounds": (3, 1), "name_non_empty": (3, 1),
                   "prices_present": (3, 1)}


def test_missing_timestamps_count_and_three_samples(spark):
    rows = [(i, None, "processed", "a") for i in range(5, 0, -1)] + \
           [(9, dt.datetime(2024, 1, 1), "processed", "a")]
    out = qu.missing_timestamps(spark.createDataFrame(rows, SNAPS)).collect()
    assert [r.id for r in out] == [1, 2, 3] and {r.missing_total for r in out} == {5}


def test_storage_attribution_truncates_and_zero_ratio(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "full"))
    size = sum(p.stat().st_size for p in (tmp_path / "full").glob("*.parquet"))
    tables = spark.range(1).select(F.lit("full").alias("label"), F.lit(33).alias("own_rows"), F.lit(100).alias("total_rows"),
                                   qu.stored_bytes(spark, str(tmp_path / "full")).alias("table_bytes")).unionAll(
        spark.createDataFrame([("empty", 0, 0, 50)], "label string, own_rows int, total_rows int, table_bytes long"))
    out = {r.label: r for r in qu.attribute(tables).collect()}
    f = out["full"]
    assert f.table_bytes == size and f.estimated_bytes == size * 33 // 100
    assert out["empty"].estimated_bytes == 0
    assert (out["Total"].table_bytes, out["Total"].estimated_bytes) == (size + 50, f.estimated_bytes)


def test_station_upsert_by_id_last_wins_created_at_kept(spark):
    schema = ("id long, name string, address string, city string, region string, "
              "latitude double, longitude double, created_at string")
    old = spark.createDataFrame([(1, "Old", "1 St", "X", "R", 1.0, 2.0, "2020")], schema)
    recs = spark.createDataFrame(
        [(1, "First", "1 St", "X", "R", 1.0, 2.0, "2024", 1),
         (1, "Second", "1 St", "Y", "R", 1.0, 2.0, "2024", 2),
         (2, "New", "2 St", "Z", "Q", 3.0, 4.0, "2024", 3)], schema + ", seq int")
    got = {r.id: r for r in ig.upsert_stations_by_id(old, recs, F.col("seq")).collect()}
    assert (got[1].name, got[1].city, got[1].created_at) == ("Second", "Y", "2020")
    assert (got[2].name, got[2].created_at) == ("New", "2024")


def test_record_defaults_fuel_and_time(spark):
    now = dt.datetime(2024, 5, 1, 12, 0)
    recs = spark.createDataFrame([(1, None, 1.239, None), (2, "diesel", 1.5, now)],
                                 "station_id long, fuel_type string, price double, "
                                 "fetched_at timestamp")
    out = {r.station_id: r for r in ig.records_to_prices(recs, F.lit(now)).collect()}
    assert out[1].fuel_type == "regular" and out[1].fetched_at == now
    assert str(out[1].price) == "1.24"


def test_price_extract_too_many_is_empty(spark):
    t = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]
    snaps = spark.createDataFrame([(i + 1, t[i], "processed", "a") for i in range(3)], SNAPS)
    prices = spark.createDataFrame([(1, 10, 1, D("1.0")), (2, 10, 1, D("1.1")), (3, 10, 1, D("1.2"))], PRICES)
    stations = spark.createDataFrame([(10, "S", "C", "R")], "id long, name string, city string, region string")
    fuels = spark.createDataFrame([(1, "regular")], "id long, name string")
    ok = sn.select_snapshots(snaps, "a", "day", start="2024-01-01 00:00:00",
                             end="2024-01-03 00:00:00", max_snapshots=3)
    assert sn.price_extract(ok, prices, stations, fuels, snaps).count() == 3
    over = sn.select_snapshots(snaps, "a", "day", start="2024-01-01 00:00:00",
                               end="2024-01-03 00:00:00", max_snapshots=2)
    assert over.too_many
    assert sn.price_extract(over, prices, stations, fuels, snaps).count() == 0
