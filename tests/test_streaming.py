"""Streaming ingest: gzip and plain documents mixed, one corrupt file → an
error snapshot while the others are processed (STR-02), publish-last store."""

import gzip
import json

from pyspark.sql import functions as F

from pumpwatch.sinks.store import PriceStore
from pumpwatch.streaming.ingest import start_ingest


def doc(names):
    return {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"coordinates": [-70.0, 46.0]},
         "properties": {"Name": n, "Address": "1 rue, Ville", "Region": "R",
                        "Prices": [{"GasType": "Diesel", "Price": "150.0¢", "IsAvailable": True}]}}
        for n in names]}


def test_error_isolation_and_publish(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps(doc(["S1", "S2"])))
    with gzip.open(landing / "b.json.gz", "wt") as f:
        json.dump(doc(["S2", "S3"]), f)
    (landing / "c.json").write_text('{"type": "FeatureCollection", "features": [ {oops')
    store = PriceStore(spark, str(tmp_path / "store"))
    store.write_dim("stations", spark.createDataFrame(
        [], "id long, dataset string, name string, adress string, city string, region string, "
            "longitude double, latitude double"), 0)
    store.write_dim("fuels", spark.createDataFrame([], "id long, name string"), 0)
    q = start_ingest(spark, str(landing), store, "d", str(tmp_path / "ckpt"),
                     layout="documents", available_now=True, max_files_per_trigger=2)
    q.awaitTermination()
    snaps = store.read_all("snapshots").collect()
    status = sorted(r.status for r in snaps)
    assert status == ["error", "processed", "processed"]
    assert sorted(r.price_count for r in snaps if r.status == "processed") == [2, 2]
    assert store.published_prices().count() == 4
    assert store.read_dim("stations").count() == 3       # S2 upserted, not duplicated
    assert store.read_dim("fuels").count() == 1


def test_replayed_batch_is_idempotent(spark, tmp_path):
    from pumpwatch.sources import feed as fd
    from pumpwatch.streaming.ingest import FeedBatch, with_source
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps(doc(["S1", "S2"])))
    batch = with_source(spark.read.schema(fd.FEED).option("multiLine", True).json(str(landing)), "documents")
    store = PriceStore(spark, str(tmp_path / "store"))
    store.write_dim("stations", spark.createDataFrame(
        [], "id long, dataset string, name string, adress string, city string, region string, "
            "longitude double, latitude double"), 0)
    store.write_dim("fuels", spark.createDataFrame([], "id long, name string"), 0)
    body = FeedBatch(store, "d", "documents")
    body(batch, 0)
    first = sorted(tuple(r) for r in store.published_prices().collect())
    body(batch, 0)          # the same micro-batch again, as after a failure
    assert sorted(tuple(r) for r in store.published_prices().collect()) == first
    assert store.read_all("snapshots").count() == 1
    assert store.read_dim("stations").count() == 2


def test_periodic_trigger_picks_up_later_polls(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.json").write_text(json.dumps(doc(["S1", "S2"])))
    store = PriceStore(spark, str(tmp_path / "store"))
    store.write_dim("stations", spark.createDataFrame(
        [], "id long, dataset string, name string, adress string, city string, region string, "
            "longitude double, latitude double"), 0)
    store.write_dim("fuels", spark.createDataFrame([], "id long, name string"), 0)
    q = start_ingest(spark, str(landing), store, "d", str(tmp_path / "ckpt"),
                     layout="documents", available_now=False, every_minutes=1 / 30)
    try:
        q.processAllAvailable()
        assert store.read_all("snapshots").count() == 1
        (landing / "b.json").write_text(json.dumps(doc(["S2", "S3"])))   # the next poll lands
        q.processAllAvailable()
    finally:
        q.stop()
    snaps = store.read_all("snapshots").collect()
    assert sorted(r.batch for r in snaps) == [0, 1]                    # one batch per poll
    assert sorted(r.price_count for r in snaps) == [2, 2]
    assert store.read_dim("stations").count() == 3                     # S2 kept its id
    assert store.published_prices().count() == 4


def test_read_dim_newest_and_before(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "store"))
    for v in (0, 1, 2, 10):
        store.write_dim("fuels", spark.createDataFrame([(v, f"v{v}")], "id long, name string"), v)
    assert [r.name for r in store.read_dim("fuels").collect()] == ["v10"]      # 10 > 2 numerically
    assert [r.name for r in store.read_dim("fuels", before=10).collect()] == ["v2"]
    assert [r.name for r in store.read_dim("fuels", before=1).collect()] == ["v0"]
    assert store.read_dim("fuels", before=0).count() == 0


def line(snapshot, name, region="R"):
    return json.dumps({"type": "Feature", "geometry": {"coordinates": [1.0, 2.0]},
                       "properties": {"Name": name, "Address": "5 road, Town", "Region": region,
                                      "Prices": [{"GasType": "A", "Price": "99.0", "IsAvailable": True}]},
                       "snapshot": snapshot})


def empty_store(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "store"))
    store.write_dim("stations", spark.createDataFrame(
        [], "id long, dataset string, name string, adress string, city string, region string, "
            "longitude double, latitude double"), 0)
    store.write_dim("fuels", spark.createDataFrame([], "id long, name string"), 0)
    return store


def ingest(spark, tmp_path, layout, files, per_trigger=10):
    landing = tmp_path / "landing"
    landing.mkdir()
    for name, text in files.items():
        (landing / name).write_text(text)
    store = empty_store(spark, tmp_path)
    start_ingest(spark, str(landing), store, "d", str(tmp_path / "ckpt"), layout=layout,
                 max_files_per_trigger=per_trigger).awaitTermination()
    return store


def test_corrupt_sequence_line_fails_its_poll_and_unreadable_lines_are_kept(spark, tmp_path):
    cut = line(1, "S3")[:50] + '"snapshot": 1}'        # no JSON, but its poll can be read
    store = ingest(spark, tmp_path, "sequence", {
        "a.json": "\n".join([line(1, "S1"), cut, line(2, "S2"), "{lost"])})
    assert {(r.id, r.status, r.price_count) for r in store.snapshots().collect()} == {
        (1, "error", 0), (2, "processed", 1)}
    assert [r.raw for r in store.read_all("rejects").collect()] == ["{lost"]
    assert store.published_prices().count() == 1


def test_poll_over_two_triggers_is_one_snapshot(spark, tmp_path):
    store = ingest(spark, tmp_path, "sequence", {
        "a.json": "\n".join([line(1, "S1"), line(2, "S1")]),
        "b.json": "\n".join([line(1, "S2"), line(2, "S2")[:40] + '"snapshot": 2,']), }, per_trigger=1)
    assert store.read_all("snapshots").count() == 4
    assert {(r.id, r.status, r.price_count) for r in store.snapshots().collect()} == {
        (1, "processed", 2), (2, "error", 0)}
    assert {r.snapshot_id for r in store.published_prices().collect()} == {1}


def test_document_errors_and_empty_polls(spark, tmp_path):
    wrong = doc(["S1"])
    wrong["features"][0]["geometry"]["coordinates"] = "nowhere"
    store = ingest(spark, tmp_path, "documents", {
        "a.json": json.dumps({"type": "FeatureCollection"}), "b.json": json.dumps(wrong),
        "c.json": json.dumps(doc(["S1", "S2"]))})
    by_file = {r.source_file[-6]: r.status for r in store.snapshots().join(store.sources(), "id").collect()}
    assert by_file == {"a": "processed", "b": "error", "c": "processed"}


def test_last_record_of_a_poll_wins_in_every_layout(spark, tmp_path):
    store = ingest(spark, tmp_path, "sequence", {
        "a.json": "\n".join([line(1, "S1", f"R{i}") for i in (3, 1, 2)])})
    assert [r.region for r in store.read_dim("stations").collect()] == ["R2"]


def _files(root):
    import os
    return sorted(os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet"))


def test_facts_by_date_replay_and_range(spark, tmp_path):
    import datetime as dt
    store = PriceStore(spark, str(tmp_path / "store"))
    days = [dt.datetime(2024, 1, d, 23, 59) for d in (1, 2, 3)] + [None]
    snaps = spark.createDataFrame([(i, t, "processed", "d", 2) for i, t in enumerate(days)],
                                  "id long, timestamp timestamp, status string, dataset string, price_count long")
    facts = spark.createDataFrame([(i, s, 7, 1.5) for i in range(4) for s in (1, 2)], "snapshot_id long, station_id long, fuel_id long, price double") \
        .withColumn("price", F.col("price").cast("decimal(10,2)"))
    store.append_facts(facts, snaps, 0)
    store.append("snapshots", snaps, 0)
    # a part of snapshot 2 arrived the day before, in another batch
    early = spark.createDataFrame([(2, days[1], "processed", "d", 1)], snaps.schema)
    store.append_facts(facts.where("snapshot_id = 2 AND station_id = 1"), early, 1)
    store.append("snapshots", early, 1)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    before = rows(store.published_prices())
    assert len(before) == 9
    store.append_facts(facts, snaps, 0)     # replayed: the same rows, nothing of the other batch lost
    assert rows(store.published_prices()) == before
    assert {p.split("day=")[1].split("/")[0] for p in _files(tmp_path / "store/prices")} == {
        "2024-01-01", "2024-01-02", "2024-01-03", "__HIVE_DEFAULT_PARTITION__"}
    third = store.published_prices(start="2024-01-03 00:00:00", end="2024-01-03 23:59:59")
    assert rows(third) == [x for x in before if x[0] == 2] and len(rows(third)) == 3
    plan = third._jdf.queryExecution().executedPlan().toString()
    (filters,) = [x for x in plan.split("PartitionFilters: [")[1:] if "2024-01-0" in x or "day#" in x.split("]")[0]][:1]
    assert "day#" in filters.split("]")[0], plan
    assert store.published_prices(start="2025-01-01 00:00:00").count() == 0
    assert store.read_facts(5).count() == 0


STATION = "id long, dataset string, name string, adress string, city string, region string, longitude double, latitude double"


def put(spark, store, names, version, city):
    from pumpwatch.operators.ingest import merge_stations
    rows = spark.createDataFrame([("d", n, "street", city, "R", 1.0, 2.0) for n in names],
                                 STATION.removeprefix("id long, "))
    return store.upsert_dim("stations", rows, merge_stations, version)


def test_upsert_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "store"), buckets=64)
    store.write_dim("stations", spark.createDataFrame(
        [(i, "d", f"s{i}", "street", "c0", "R", 1.0, 2.0) for i in range(1, 1001)], STATION), 0)
    names = [f"s{i}" for i in range(500, 505)] + [f"n{i}" for i in range(5)]
    out = put(spark, store, names, 1, "c1")
    assert {n for n in names} <= {r.name for r in out.collect()}
    assert 0 < len(list((tmp_path / "store/stations/v=1").glob("bucket=*"))) <= 10
    now = {r.name: r for r in store.read_dim("stations").collect()}
    assert len(now) == 1005 and sorted(r.id for r in now.values()) == list(range(1, 1006))
    assert {n for n, r in now.items() if r.city == "c1"} == set(names) and now["s500"].id == 500
    assert store.read_dim("stations", before=1).count() == 1000


def test_a_replayed_or_failed_upsert_gives_equal_ids_and_old_versions_are_not_read(spark, tmp_path):
    store = PriceStore(spark, str(tmp_path / "store"), buckets=8)
    store.write_dim("stations", spark.createDataFrame([], STATION), 0)
    for version, names in ((1, ["a", "b"]), (2, ["b", "c"]), (3, []), (5, ["d"])):
        put(spark, store, names, version, f"c{version}")
        first = sorted(tuple(r) for r in store.read_dim("stations").collect())
        put(spark, store, names, version, f"c{version}")
        assert sorted(tuple(r) for r in store.read_dim("stations").collect()) == first
    assert [(r[0], r[2], r[4]) for r in first] == [(1, "a", "c1"), (2, "b", "c2"), (3, "c", "c2"), (4, "d", "c5")]
    assert sorted(store._slots("stations").values()) == [3, 5]
    files = store.read_dim("stations").inputFiles()      # a folder a bucket, of the version that wrote it last
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == len({f.rsplit("/", 1)[0] for f in files})
    assert store.read_dim("stations", before=2).count() == 2
    # a pointer slot lost half-way through being overwritten: the other one stands
    slot = next(k for k, v in store._slots("stations").items() if v == 3)
    store._write_row([], "v long", f"{store.root}/stations/current/slot={slot}")
    assert sorted(tuple(r) for r in store.read_dim("stations").collect()) == first


def test_a_store_without_a_dimension_says_so(spark, tmp_path):
    import pytest
    store = PriceStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.read_dim("fuels")
    with pytest.raises(ValueError):
        put(spark, store, ["a"], 1, "c")


def test_moves_carried_from_batch_to_batch_equal_those_of_all_history(spark, tmp_path):
    import datetime as dt
    import random
    from pumpwatch.operators.observations import price_moves
    from pumpwatch.streaming.moves import MoveState
    r = random.Random(5)
    schema = "station_id long, fuel_type string, fetched_at timestamp, price decimal(10,2), n long"
    row = lambda day, n: (r.randint(1, 4), r.choice("ab"), dt.datetime(2024, 1, day), r.choice([1, 2, None]), n)
    made = lambda days, start: spark.createDataFrame(
        [row(r.choice(days), start + i) for i in range(25)], "a long, b string, c timestamp, d int, n long").selectExpr(
        "a AS station_id", "b AS fuel_type", "c AS fetched_at", "CAST(d AS DECIMAL(10,2)) AS price", "n")
    stations = spark.createDataFrame([(i, f"S{i}", "C", "R") for i in range(1, 5)], "id long, name string, city string, region string")
    state = MoveState(PriceStore(spark, str(tmp_path / "store"), buckets=3), tie="n")
    batches = [made([1, 2], 0), made([3], 100), made([1, 2, 3, 4], 200),    # the third has late rows
               spark.createDataFrame([], schema)]
    seen = None
    for i, batch in enumerate(batches):
        seen = batch if seen is None else seen.unionByName(batch)
        want = sorted(map(tuple, price_moves(seen.dropna(), stations, tie="n").collect()))
        for _ in range(2 if i in (0, 2) else 1):                            # replayed, as after a failure
            state(batch, i)
            assert sorted(map(tuple, state.report(stations).collect())) == want
    assert want
