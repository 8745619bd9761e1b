"""Steps whose disk or time grew faster than their input: what their plans and files must be like."""

import json
import os

from pyspark.sql import functions as F

from paths import SF_SMALL
from test_streaming import doc, empty_store, line
from pumpwatch.operators import ingest as ig
from pumpwatch.operators import pivot as pv
from pumpwatch.plans import feed_queries as fq
from pumpwatch.plans import streaming_queries as sq
from pumpwatch.sources import feed as fd
from pumpwatch.streaming.ingest import FeedBatch, with_source


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _local(path):
    return path.removeprefix("file:")


def test_error_isolation_moves_no_features(spark):
    """the features of good polls pass the few bad ids where they are."""
    line = '{"snapshot":%d,"properties":{"Name":"a","Prices":[]}}'
    batch = (spark.createDataFrame([(line % 1,), (line % 2,)], "value string")
             .select(F.from_json("value", fd.FEATURE_LINE).alias("f")).select("f.*")
             .unionByName(spark.createDataFrame([(None, None, 2, "broken")], fd.FEATURE_LINE))
             .withColumns({"source_file": F.lit("x"), "polled_at": F.lit("2026-01-01").cast("timestamp"), "_block": F.lit(0)}))
    snaps, flat, _ = FeedBatch(None, "feed", "sequence").snapshots_and_features(batch, 0)
    assert {r.id: r.status for r in snaps.collect()} == {1: "processed", 2: "error"}
    assert [r.snapshot for r in flat.collect()] == [1]
    plan = _plan(flat)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def _ingested(spark, tmp_path, monkeypatch, layout, lines):
    """The store after one batch of lines; nothing of the batch may be cached, the facts must come from staged files."""
    def cached(self, *a):
        raise AssertionError("a batch of any size is kept by the executors")
    store, seen = empty_store(spark, tmp_path), []
    append = store.append_facts
    monkeypatch.setattr(store, "append_facts", lambda prices, *a: seen.append(prices.inputFiles()) or append(prices, *a))
    (tmp_path / "in.json").write_text("\n".join(lines))
    rows = spark.read.schema(fd.FEATURE_LINE if layout == "sequence" else fd.COLLECTION).json(str(tmp_path / "in.json"))
    batch = with_source(rows, layout)
    for name in ("persist", "cache"):
        monkeypatch.setattr(type(batch), name, cached)
    FeedBatch(store, "d", layout)(batch, 0)
    (files,) = seen
    assert any("/staged/records/" in f for f in files) and not any(f.endswith(".json") for f in files)
    return store


def test_collections_are_staged_not_cached(spark, tmp_path, monkeypatch):
    """r04 F2: a batch is parsed once into files; empty polls and rejects are a row a record."""
    poll = lambda i, names: json.dumps({"snapshot": i} | doc(names))
    lines = [poll(1, ["a", "b"]), poll(2, ["a"]), poll(2, ["c"])[:-9], poll(3, []), '{"snapshot":4}', poll(None, ["d", "e"]),
             '{"snapshot":5,"features":[null]}', "{lost"]
    store = _ingested(spark, tmp_path, monkeypatch, "collections", lines)
    assert {r.id: (r.status, r.price_count) for r in store.snapshots().collect()} == {
        1: ("processed", 2), 2: ("error", 0), 3: ("processed", 0), 4: ("processed", 0), 5: ("processed", 0)}
    assert sorted(r.name for r in store.read_dim("stations").collect()) == ["", "a", "b"]
    assert sorted(str(r.raw) for r in store.read_all("rejects").collect()) == ["None", "{lost"]
    assert store.sources().count() == 5


def test_sequences_are_staged_not_cached(spark, tmp_path, monkeypatch):
    """r04 F1: a batch is parsed once into files, which the next batch overwrites."""
    lines = [line(1, "a", "R1"), line(1, "a", "R2"), line(2, "b"), line(3, "c")[:40] + '"snapshot": 3,', line(3, "c"), line(None, "d"), "{lost"]
    store = _ingested(spark, tmp_path, monkeypatch, "sequence", lines)
    assert {r.id: (r.status, r.price_count) for r in store.snapshots().collect()} == {1: ("processed", 2), 2: ("processed", 1), 3: ("error", 0)}
    assert {r.name: r.region for r in store.read_dim("stations").collect()} == {"a": "R2", "b": "R"}
    assert sorted(str(r.raw) for r in store.read_all("rejects").collect()) == ["None", "{lost"]
    (tmp_path / "in.json").write_text(line(4, "a", "R3"))
    FeedBatch(store, "d", "sequence")(with_source(spark.read.schema(fd.FEATURE_LINE).json(str(tmp_path / "in.json")), "sequence"), 1)
    assert [r.snapshot for r in spark.read.parquet(str(tmp_path / "store/staged/records")).collect()] == [4]
    assert sorted(r.snapshot_id for r in store.published_prices().collect()) == [1, 1, 2, 4]
    assert {r.name: r.region for r in store.read_dim("stations").collect()} == {"a": "R3", "b": "R"}


def test_landing_is_compressed_and_each_poll_in_one_file(spark, tmp_path):
    """JSON lines land as gzip files, as many as there are lines for."""
    rows = sq.snapshot_rows(spark, SF_SMALL)
    files = sq.land(spark, SF_SMALL, rows, str(tmp_path / "landing"), sq.with_value)
    names = [n for n in os.listdir(tmp_path / "landing") if n.startswith("part-")]
    assert names and all(n.endswith(".txt.gz") for n in names) and len(names) <= files
    landed = fd.read_feature_lines(spark, str(tmp_path / "landing"))
    assert landed.groupBy("snapshot").agg(F.count_distinct("source_file").alias("n")).where("n > 1").isEmpty()
    assert landed.count() == rows.count()
    assert sq.landing_files(spark, 1000 * sq.LANDING_LINES) == 1000


def test_documents_come_in_a_bounded_number_of_batches(spark, monkeypatch):
    """many polls are no more batches than few."""
    made = []
    work = sq.work_dir
    monkeypatch.setattr(sq, "work_dir", lambda *a: made.append(work(*a)) or made[-1])
    monkeypatch.setattr(sq, "POLL_ORDERS", 16)
    got = sq.stream_documents(spark, SF_SMALL).collect()
    polls = sum(r.polls for r in got)
    batches = [n for n in os.listdir(f"{_local(made[0])}/checkpoint/commits") if n.isdigit()]
    assert polls > 10 * sq.POLL_BATCHES and len(batches) <= sq.POLL_BATCHES
    assert {r.kind: r.status for r in got if r.kind in (3, 5)} == {3: "error", 5: "processed"}


def test_files_of_regions_shuffle_no_station(spark):
    """F8: a half of the feed is told by its stations, before anything is encoded or joined."""
    plan = _plan(fq.feature_lines(spark, SF_SMALL, F.col("region") < "E"))
    assert "get_json_object" not in plan and "SortMergeJoin" not in plan


def test_populate_joins_few_stations_where_the_prices_are(spark):
    """prices aren't shuffled to find their stations and fuels."""
    assert "SortMergeJoin" not in _plan(fq.feed_populate(spark, SF_SMALL))


def test_station_updates_take_the_latest_of_all_addresses(spark):
    """one key under several addresses, the newest record wins."""
    flat = spark.createDataFrame(
        [("a", "1 St, X", "r1", 1.0, 2.0, 1), ("a", "1 St, Y", "r2", 3.0, 4.0, 2), ("a", "1 St, X", None, 5.0, 6.0, 3), (None, None, "r", None, None, 1)],
        "Name string, Address string, Region string, longitude double, latitude double, snapshot long")
    got = {r.name: tuple(r) for r in ig.station_updates(flat, "d").select("name", "adress", "city", "region", "longitude", "latitude").collect()}
    assert got == {"a": ("a", "1 St", "X", "", 5.0, 6.0), "": ("", "", "", "r", None, None)}


def test_median_evaluates_its_input_once(spark):
    """the passes of the median read a written copy, not the joins before it."""
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(1)
            yield r
    df = spark.createDataFrame(spark.sparkContext.parallelize([("x", i) for i in range(101)], 2).mapPartitions(count), "g string, v int")
    got = {r.g: r.med for r in pv.pivot_long(df, ["g"], [], "v", {"med": "median", "n": "count"}).collect()}
    assert got == {"x": 50.0, None: 50.0} and seen.value == 101
