"""Archive export → import round trip, version check, legacy single document
read against a brute-force json.load, and id helpers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from pumpwatch.functions.keys import assign_ids
from pumpwatch.operators import archive as ar
from pumpwatch.sources import archive as src


def small_dataset(spark):
    reg = spark.createDataFrame([(1, "d1", 5, "", True, False, 100)],
                                "id long, name string, update_frequency int, data_source_url string, "
                                "active boolean, run_automatically boolean, max_snapshots int")
    stations = spark.createDataFrame(
        [(10, "A", "Alma", "R1", "1 rue", -70.0, 48.0), (11, "B", "Baie", "R2", "2 rue", -71.0, 47.0),
         (12, "C", "Cap", "R2", "3 rue", -72.0, 46.0)],
        "id long, name string, city string, region string, adress string, longitude double, "
        "latitude double")
    import datetime as dt
    snaps = spark.createDataFrame(
        [(100, dt.datetime(2026, 1, 1), "processed", "d1"), (101, dt.datetime(2026, 1, 2), "error", "d1")],
        "id long, timestamp timestamp, status string, dataset string")
    from decimal import Decimal
    prices = spark.createDataFrame(
        [(100, 10, 1, Decimal("199.90")), (100, 11, 2, Decimal("220.00")),
         (101, 10, 1, Decimal("201.00"))],
        "snapshot_id long, station_id long, fuel_id long, price decimal(10,2)")
    fuels = spark.createDataFrame([(1, "Régulier"), (2, "Diesel"), (3, "Unused")], "id long, name string")
    return reg, stations, snaps, prices, fuels


def test_round_trip(spark, tmp_path):
    reg, stations, snaps, prices, fuels = small_dataset(spark)
    root = ar.export_archive(spark, str(tmp_path / "a"), reg, stations, snaps, prices, fuels)
    assert sorted(r.name for r in src.read_section(spark, root, "fuels").collect()) == \
        ["Diesel", "Régulier"]                       # only fuels in use
    imp = ar.import_archive(spark, root, dataset_id=2, fuels=fuels,
                            next_station_id=F.lit(50), next_snapshot_id=F.lit(500))
    assert imp.stations.count() == 3                  # even the station without prices
    got = {(r.old_id, r.status, r.price_count) for r in imp.snapshots.collect()}
    assert got == {(100, "processed", 2), (101, "error", 1)}
    assert sorted(float(r.price) for r in imp.prices.collect()) == [199.9, 201.0, 220.0]
    assert min(r.id for r in imp.snapshots.collect()) == 500        # new ids
    assert {r.id for r in imp.fuels.collect()} == {1, 2, 3}          # matched by name
    ts = {r.old_id: r.timestamp for r in imp.snapshots.collect()}
    import datetime as dt
    assert ts[100] == dt.datetime(2026, 1, 1)
    d = imp.dataset.collect()[0]
    assert (d.active, d.run_automatically, d.update_frequency, d.max_snapshots) == (False, False, 5, 100)


def test_version_refused(spark, tmp_path):
    root = tmp_path / "v2"
    (root / "manifest").mkdir(parents=True)
    (root / "manifest" / "part-0.json").write_text('{"version": 2, "analysis": {}}\n')
    with pytest.raises(src.ArchiveVersionError):
        ar.import_archive(spark, str(root), dataset_id=1,
                          fuels=spark.createDataFrame([], "id long, name string"),
                          next_station_id=F.lit(1), next_snapshot_id=F.lit(1))


def test_unmapped_ids_dropped_and_status_default(spark):
    manifest = spark.createDataFrame([(1, None)], "version long, analysis struct<update_frequency:int,"
                                     "data_source_url:string,active:boolean,run_automatically:boolean,"
                                     "max_snapshots:int>")
    fuels_in = spark.createDataFrame([(1, "A")], "id long, name string")
    st_in = spark.createDataFrame([(5, "S", "C", "R", "x", 0.0, 0.0)],
                                  "id long, name string, city string, region string, adress string, "
                                  "longitude double, latitude double")
    sn_in = spark.createDataFrame([(9, "2026-01-01T00:00:00+00:00", None)],
                                  "id long, timestamp string, status string")
    pr_in = spark.createDataFrame([(5, 1, 1.5, 9), (5, 2, 2.5, 9), (6, 1, 3.5, 9), (5, 1, 4.5, 8),
                                   (6, 2, 5.5, 8), (6, 2, 5.5, 8)],
                                  "station_id long, fuel_id long, price double, snapshot_id long")
    imp = ar.import_sections(manifest, fuels_in, st_in, sn_in, pr_in, dataset_id=3,
                             fuels=spark.createDataFrame([], "id long, name string"),
                             next_station_id=F.lit(1), next_snapshot_id=F.lit(1))
    assert [float(r.price) for r in imp.prices.collect()] == [1.5]
    # each unmapped row once, also with several unknown ids; duplicates kept
    assert sorted(r.price for r in imp.dropped.collect()) == [2.5, 3.5, 4.5, 5.5, 5.5]
    assert imp.snapshots.collect()[0].status == "processed"
    d = imp.dataset.collect()[0]
    assert (d.update_frequency, d.data_source_url, d.max_snapshots) == (5, "", 100)


def test_legacy_document_reader_matches_json_load(spark, tmp_path):
    doc = {"version": 1,
           "analysis": {"update_frequency": 7, "data_source_url": "u", "active": True,
                        "run_automatically": False, "max_snapshots": 50},
           "fuels": [{"id": 1, "name": "Diesel"}],
           "stations": [{"id": 3, "name": "S", "city": "C", "region": "R", "adress": "a",
                         "longitude": -70.1, "latitude": 45.2}],
           "snapshots": [{"id": 4, "timestamp": "2026-01-01T00:00:00+00:00", "status": "processed"}],
           "prices": [{"station_id": 3, "fuel_id": 1, "price": 100 + i % 200, "snapshot_id": 4}
                      for i in range(5000)]}
    path = tmp_path / "export.json.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        json.dump(doc, f)
    secs = src.read_document_sections(spark, str(path))
    assert secs["manifest"].collect()[0].version == 1
    assert secs["stations"].collect()[0].name == "S"
    prices = src.read_price_fragments(spark, str(path))
    # the gzip document is one scan task; its fragments are parsed on every slot
    assert prices.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism > 1
    got = sorted((r.station_id, r.fuel_id, r.price, r.snapshot_id) for r in prices.collect())
    want = sorted((p["station_id"], p["fuel_id"], float(p["price"]), p["snapshot_id"])
                  for p in json.load(gzip.open(path, "rt"))["prices"])
    assert got == want


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = assign_ids(df, ["k"], start=101, partitions=7).collect()
    ids = sorted((r.k, r.id) for r in out)
    assert [i for _, i in ids] == list(range(101, 1101))


def odd_document(braces="}"):
    """Names with braces, quotes, backslashes and key names in them, nested and null entries, prices first."""
    names = ["Chez {A}", "B} C", '"stations": [{', "D\\", "\\\\}", "}}{{", 'E"}', "é}", "snapshots", "", ", {", "]}"]
    names = [n.replace("}", braces) for n in names]
    return {"note": {"deep": [{"fuels": [{"id": 77, "name": "}"}]}]},
            "prices": [{"station_id": i % 12, "fuel_id": i % 3, "price": 100.5 + i, "snapshot_id": i % 40} for i in range(300)],
            "fuels": [None, *({"id": i, "name": f"F}}{i}"} for i in range(3)), {}],
            'x}fuels': [{"id": 88, "name": "no fuel"}],
            "stations": [{"id": i, "name": n, "city": n, "more": {"a}": [{"id": 99, "city": "}"}], "b": {}},
                          "region": "R", "adress": n + n, "longitude": -70.5, "latitude": 45.0} for i, n in enumerate(names)],
            "analysis": {"update_frequency": 9, "data_source_url": "http://a/{b}", "extra": {"version": 3}, "max_snapshots": 4},
            "snapshots": [{"id": i, "timestamp": "2026-01-01T00:00:00+00:00", "status": "a}b" if i % 2 else None} for i in range(40)],
            "version": 1}


def check_sections(spark, path, doc):
    secs = src.read_document_sections(spark, path)
    for name, kind in src.DIMENSIONS.items():
        got = sorted((tuple(r) for r in secs[name].collect()), key=repr)
        want = sorted((tuple(x.get(c) for c in kind.names) for x in doc[name] if x is not None), key=repr)
        assert got == want, name
    head, = secs["manifest"].collect()
    assert head.version == doc["version"]
    assert head.analysis.asDict() == {c: doc["analysis"].get(c) for c in src.ANALYSIS.names}


@pytest.mark.parametrize("split", ["64", "997", "1000000"])
@pytest.mark.parametrize("indent", [None, 1])
def test_document_sections_whole_wherever_it_is_split(spark, tmp_path, split, indent):
    doc = odd_document()
    if split == "64":       # one split for a few fragments is slow: the strings and nests are what matters
        doc["prices"], doc["snapshots"] = doc["prices"][:5], doc["snapshots"][:8]
    path = tmp_path / "export.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    if split != "1000000":
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert (src._fragments(spark, str(path)).rdd.getNumPartitions() > 1) == (split != "1000000")
        check_sections(spark, str(path), doc)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("packed", [False, True])
def test_document_sections_of_parts(spark, tmp_path, packed):
    """Parts end at line ends, in the order of their numbers; also within an entry."""
    doc = odd_document()
    lines = json.dumps(doc, indent=1, ensure_ascii=False).splitlines(keepends=True)
    for k, i in enumerate(range(0, len(lines), 150)):
        part = "".join(lines[i:i + 150]).encode()
        (tmp_path / (f"part-{k}.json" + ".gz" * packed)).write_bytes(gzip.compress(part) if packed else part)
    assert k >= 10                       # 10 comes after 9
    check_sections(spark, str(tmp_path), doc)


def test_document_cut_short_is_refused(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps(odd_document())[:-200])
    with pytest.raises(ValueError, match="cut short"):
        src.read_document_sections(spark, str(path))


def test_document_is_written_and_read_by_many_tasks(spark, tmp_path):
    """No task writes the whole document, and the sections are rows, not arrays of one row."""
    from pumpwatch.plans.archive_queries import write_document
    reg, stations, snaps, prices, fuels = small_dataset(spark)
    many = prices.crossJoin(spark.range(3000)).drop("id").repartition(6)
    root = ar.export_archive(spark, str(tmp_path / "a"), reg, stations, snaps, many, fuels)
    for compression, ending in (("gzip", ".gz"), ("none", ".txt")):
        path = write_document(spark, root, str(tmp_path / compression), '{"active": true}', compression)
        parts = sorted((tmp_path / compression).glob(f"part-*{ending}"))
        opened = gzip.decompress if ending == ".gz" else bytes
        sizes = [len(opened(p.read_bytes())) for p in parts]
        assert max(sizes) < sum(sizes) / 3
        text = opened(b"".join(p.read_bytes() for p in parts))     # as one file
        doc = json.loads(text)
        assert len(doc["prices"]) == 9001 and doc["prices"][0] is None
        doc["fuels"] = [x for x in doc["fuels"] if x]
        check_sections(spark, path, doc)
        imp = ar.import_document(spark, path, dataset_id=2, fuels=fuels, next_station_id=F.lit(50),
                                 next_snapshot_id=F.lit(500))
        assert imp.prices.count() == 9000 and imp.dropped.count() == 0
        assert imp.dataset.collect()[0].activate
