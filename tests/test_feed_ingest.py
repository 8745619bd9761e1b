"""Feed parsing and populate, modelled on the reference's populate tests
(field mapping, price text, unavailable / null entries, idempotent upsert)."""

import json

from pyspark.sql import functions as F

from pumpwatch.operators import ingest as ig
from pumpwatch.sources import feed as fd


def entry(fuel, price, available=True):
    return {"GasType": fuel, "Price": price, "IsAvailable": available}


OFFERED = [entry("Petrol 95", "150.1¢"), entry("Gasoil", "171.3¢"), entry("Petrol 98", "162.2¢")]


def feature(name="Pump 7", address="12 Quay Road, Harbour", region="North", prices=OFFERED, coords=(10.5, 59.25)):
    f = {"type": "Feature", "properties": {"Region": region, "Name": name, "Address": address, "Prices": prices}}
    if coords is not None:
        f["geometry"] = {"type": "Point", "coordinates": list(coords)}
    return f


def write_doc(tmp_path, name, features):
    p = tmp_path / name
    p.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(p)


def flat_of(spark, tmp_path, features, name="feed.json"):
    path = write_doc(tmp_path, name, features)
    docs = fd.read_feed_documents(spark, path)
    return fd.flatten_features(
        docs.select("source_file", F.posexplode("features").alias("pos", "f"))
        .select("source_file", "pos", "f.*").withColumn("snapshot", F.lit(1)))


def test_three_prices_and_mapping(spark, tmp_path):
    flat = flat_of(spark, tmp_path, [feature()])
    rows = ig.valid_entries(ig.feed_entries(flat)).collect()
    assert len(rows) == 3
    r = rows[0]
    assert (r.name, r.street, r.city, r.region) == ("Pump 7", "12 Quay Road", "Harbour", "North")
    assert (r.longitude, r.latitude) == (10.5, 59.25)
    assert sorted(float(x.price) for x in rows) == [150.1, 162.2, 171.3]


def test_price_text_variants(spark, tmp_path):
    prices = [{"GasType": "A", "Price": "1 999.9 ¢", "IsAvailable": True},
              {"GasType": "B", "Price": "N/D", "IsAvailable": True},
              {"GasType": "C", "Price": "nan", "IsAvailable": True},
              {"GasType": "  ", "Price": "1.00", "IsAvailable": True},
              {"GasType": "E", "Price": "2.00", "IsAvailable": False},
              {"GasType": "F", "Price": 3.5, "IsAvailable": True}]
    flat = flat_of(spark, tmp_path, [feature(prices=prices)])
    kept = {r.fuel: float(r.price) for r in ig.valid_entries(ig.feed_entries(flat)).collect()}
    assert kept == {"A": 1999.9, "F": 3.5}
    rej = ig.feed_rejects(flat).collect()[0]
    assert (rej.entries, rej.unavailable, rej.bad_price, rej.blank_fuel, rej.kept) == (6, 1, 2, 1, 2)


def test_null_prices_and_missing_geometry(spark, tmp_path):
    flat = flat_of(spark, tmp_path, [feature(prices=None, coords=None),
                                     feature(name="B", coords=())])
    assert ig.feed_entries(flat).where(F.col("name") == "Pump 7").count() == 0
    coords = {r.Name: (r.longitude, r.latitude) for r in flat.collect()}
    assert coords == {"Pump 7": (None, None), "B": (None, None)}


def test_address_last_comma(spark, tmp_path):
    feats = [feature(name="n1", address="12, rue X, Ville"), feature(name="n2", address="Sans virgule"),
             feature(name="n3", address=None)]
    flat = flat_of(spark, tmp_path, feats)
    got = {r.name: (r.street, r.city) for r in ig.feed_entries(flat).collect()}
    assert got == {"n1": ("12, rue X", "Ville"), "n2": ("Sans virgule", ""), "n3": ("", "")}


def test_four_stations_twelve_prices_and_idempotent_upsert(spark, tmp_path):
    feats = [feature(name=f"S{i}", address=f"{i} rue, Ville") for i in range(4)]
    flat = flat_of(spark, tmp_path, feats)
    empty_st = spark.createDataFrame([], "id long, dataset string, name string, adress string, "
                                         "city string, region string, longitude double, "
                                         "latitude double")
    empty_fu = spark.createDataFrame([], "id long, name string")
    st, fu, prices = ig.populate(flat, "d", empty_st, empty_fu)
    assert prices.count() == 12 and st.count() == 4 and fu.count() == 3
    st_rows = st.collect()
    # the same feed again: same stations (ids kept), no new fuel
    st2, fu2, prices2 = ig.populate(flat, "d", spark.createDataFrame(st_rows, st.schema),
                                    spark.createDataFrame(fu.collect(), fu.schema))
    assert sorted(r.id for r in st2.collect()) == sorted(r.id for r in st_rows)
    assert fu2.count() == 3 and prices2.count() == 12


def test_city_not_in_key_is_overwritten(spark, tmp_path):
    existing = spark.createDataFrame(
        [(7, "d", "S", "1 rue", "Old", "R", 0.0, 0.0)],
        "id long, dataset string, name string, adress string, city string, region string, "
        "longitude double, latitude double")
    incoming = spark.createDataFrame(
        [(1, "d", "S", "1 rue", "New", "R2", 1.0, 2.0)],
        "snapshot long, dataset string, name string, adress string, city string, region string, "
        "longitude double, latitude double")
    out = ig.upsert_stations(existing, incoming, F.col("snapshot")).collect()
    assert len(out) == 1 and out[0].id == 7 and out[0].city == "New" and out[0].region == "R2"


def test_batch_readers_gzip_and_sequence(spark, tmp_path):
    import gzip
    d = tmp_path / "docs"
    d.mkdir()
    with gzip.open(d / "poll1.json.gz", "wt") as f:
        json.dump({"type": "FeatureCollection", "features": [feature(name="G")]}, f)
    (d / "poll2.json").write_text(json.dumps({"type": "FeatureCollection",
                                              "features": [feature(name="P"), feature(name="Q")]}))
    feats = fd.features_of_documents(fd.read_feed_documents(spark, str(d)))
    assert sorted(r.properties.Name for r in feats.collect()) == ["G", "P", "Q"]
    seq = tmp_path / "seq"
    seq.mkdir()
    lines = [dict(feature(name=n), snapshot=i) for i, n in enumerate(["A", "B", "C"])]
    (seq / "part-0.geojsons").write_text("\n".join(json.dumps(x) for x in lines) + "\n")
    flat = fd.flatten_features(fd.read_feature_lines(spark, str(seq)))
    got = sorted((r.snapshot, r.Name) for r in flat.collect())
    assert got == [(0, "A"), (1, "B"), (2, "C")]
    assert ig.valid_entries(ig.feed_entries(flat)).count() == 9


def test_feed_files_gzip_and_plain_equal_in_memory_parse(spark):
    import glob
    import os

    from paths import SF_SMALL
    from pumpwatch.plans import feed_queries as fq
    from pumpwatch.session import ensure_checkpoint_dir
    files = fq.feed_files_parse(spark, SF_SMALL)
    base = ensure_checkpoint_dir(spark).replace("file:", "", 1)
    roots = sorted(glob.glob(f"{base}/pumpwatch/feed-files-*"), key=os.path.getmtime)
    parts = glob.glob(f"{roots[-1]}/*/part-*")
    assert any(p.endswith(".gz") for p in parts) and any(not p.endswith(".gz") for p in parts)
    assert sorted(files.collect()) == sorted(fq.feed_parse(spark, SF_SMALL).collect())
