"""Registered archive queries: export → import round trip, fragment reader,
id remapping with drops, dataset purge (binding O, dataset '1-URGENT')."""

from __future__ import annotations

from pyspark.sql import functions as F

from pumpwatch import model
from pumpwatch.operators import archive as ar
from pumpwatch.plans.registry import query
from pumpwatch.plans.snapshot_queries import DATASET, O_CTE
from pumpwatch.session import work_dir
from pumpwatch.sources import archive as src

NEW_DATASET_ID = 6


def _export(spark, sf_dir) -> str:
    snaps = model.snapshots_o(spark, sf_dir).where(F.col("dataset") == DATASET)
    reg = model.datasets_o(spark, sf_dir).where(F.col("name") == DATASET)
    root = work_dir(spark, "archive")
    return ar.export_archive(spark, root, reg, model.stations_o(spark, sf_dir), snaps,
                             model.prices_o(spark, sf_dir), model.fuels_o(spark, sf_dir))


def _empty_fuels(spark):
    return spark.createDataFrame([], "id long, name string")


def _import(spark, sf_dir, root, fuels_filter=None):
    manifest = src.read_manifest(spark, root)
    src.check_versions(manifest)
    fuels_in = src.read_section(spark, root, "fuels")
    if fuels_filter is not None:
        fuels_in = fuels_in.where(fuels_filter)
    next_station = model.stations_o(spark, sf_dir).select(F.max("id") + 1).scalar()
    next_snapshot = model.snapshots_o(spark, sf_dir).select(F.max("id") + 1).scalar()
    return ar.import_sections(manifest, fuels_in, src.read_section(spark, root, "stations"),
                              src.read_section(spark, root, "snapshots"),
                              src.read_section(spark, root, "prices"),
                              dataset_id=NEW_DATASET_ID, fuels=_empty_fuels(spark),
                              next_station_id=next_station, next_snapshot_id=next_snapshot)


@query("archive_roundtrip", ids="OP-12 OP-13 SNK-01 SRC-03 JOIN-09 UPS-05 SCL-12 SCL-20",
       sql=O_CTE + """
SELECT s."timestamp" AS snapshot_ts, st.name AS station, fu.name AS fuel,
       CAST(px.price AS DOUBLE) AS price
FROM px JOIN snaps s ON s.id = px.snapshot_id JOIN st ON st.id = px.station_id
JOIN fu ON fu.id = px.fuel_id
WHERE s.dataset = '1-URGENT'
""")
def archive_roundtrip(spark, sf_dir):
    imp = _import(spark, sf_dir, _export(spark, sf_dir))
    st = imp.stations.select(F.col("id").alias("station_id"), F.col("name").alias("station"))
    sn = imp.snapshots.select(F.col("id").alias("snapshot_id"),
                              F.col("timestamp").alias("snapshot_ts"))
    fu = imp.fuels.select(F.col("id").alias("fuel_id"), F.col("name").alias("fuel"))
    return (imp.prices.join(sn, "snapshot_id").join(st, "station_id").join(fu, "fuel_id")
            .select("snapshot_ts", "station", "fuel", "price"))


@query("archive_roundtrip_snapshots", ids="OP-13 JOIN-08 UPS-05 UPS-06 (all statuses, new ids)",
       sql=O_CTE + """
SELECT s.id AS old_id, s."timestamp", s.status,
       CAST((SELECT count(*) FROM px WHERE px.snapshot_id = s.id) AS BIGINT) AS price_count,
       true AS new_id_above_old_max
FROM snaps s WHERE s.dataset = '1-URGENT'
""")
def archive_roundtrip_snapshots(spark, sf_dir):
    imp = _import(spark, sf_dir, _export(spark, sf_dir))
    old_max = model.snapshots_o(spark, sf_dir).select(F.max("id")).scalar()
    return imp.snapshots.select("old_id", "timestamp", "status", "price_count",
                                (F.col("id") > old_max).alias("new_id_above_old_max"))


@query("archive_stream_read", ids="SRC-04 STR-05 (price fragments, bounded memory)",
       sql=O_CTE + """
SELECT px.station_id, px.fuel_id, CAST(px.price AS DOUBLE) AS price, px.snapshot_id
FROM px JOIN snaps s ON s.id = px.snapshot_id WHERE s.dataset = '1-URGENT'
""")
def archive_stream_read(spark, sf_dir):
    root = _export(spark, sf_dir)
    return src.read_price_fragments(spark, f"{root}/prices")


@query("import_remap_drop", ids="JOIN-09 (prices with an unmapped fuel id are dropped)",
       sql=O_CTE + """
SELECT px.station_id, px.fuel_id, CAST(px.price AS DOUBLE) AS price, px.snapshot_id
FROM px JOIN snaps s ON s.id = px.snapshot_id JOIN fu ON fu.id = px.fuel_id
WHERE s.dataset = '1-URGENT' AND fu.name >= 'M'
""")
def import_remap_drop(spark, sf_dir):
    imp = _import(spark, sf_dir, _export(spark, sf_dir), fuels_filter=F.col("name") < "M")
    return imp.dropped


@query("purge_dataset", ids="OP-14 (cascade by anti join; fuels kept)", sql=O_CTE + """
SELECT px.station_id, count(*) AS prices, CAST(sum(px.price) AS DOUBLE) AS amount
FROM px WHERE px.snapshot_id NOT IN (SELECT id FROM snaps WHERE dataset = '1-URGENT')
GROUP BY px.station_id
""")
def purge_dataset(spark, sf_dir):
    _, _, prices2 = ar.purge_dataset(DATASET, model.snapshots_o(spark, sf_dir),
                                     model.stations_o(spark, sf_dir), model.prices_o(spark, sf_dir))
    return prices2.groupBy("station_id").agg(F.count(F.lit(1)).alias("prices"),
                                             F.sum("price").alias("amount"))


# stations of the dataset, as the binding owns them
_OWNED_SQL = O_CTE + """
, owned AS (
  SELECT st.*, s_nationkey % 5 AS owner FROM st JOIN supplier ON s_suppkey = id)
"""


@query("archive_roundtrip_stations", ids="SNK-01 OP-12 OP-13 (the dataset's own stations, with or without prices)",
       sql=_OWNED_SQL + "SELECT id AS old_id, name, city, region, true AS new_id_above_old_max FROM owned WHERE owner = 0")
def archive_roundtrip_stations(spark, sf_dir):
    snaps = model.snapshots_o(spark, sf_dir).where(F.col("dataset") == DATASET)
    own = model.owned_stations_o(spark, sf_dir).where(F.col("dataset") == DATASET).drop("dataset")
    root = ar.export_archive(spark, work_dir(spark, "archive-stations"),
                             model.datasets_o(spark, sf_dir).where(F.col("name") == DATASET), own, snaps,
                             model.prices_o(spark, sf_dir), model.fuels_o(spark, sf_dir))
    old_max = model.stations_o(spark, sf_dir).select(F.max("id")).scalar()
    return _import(spark, sf_dir, root).stations.select(
        "old_id", "name", "city", "region", (F.col("id") > old_max).alias("new_id_above_old_max"))


@query("purge_snapshots", ids="OP-14 (snapshots of the other datasets stay)",
       sql=O_CTE + "SELECT dataset, count(*) AS snapshots FROM snaps WHERE dataset <> '1-URGENT' GROUP BY dataset")
def purge_snapshots(spark, sf_dir):
    snaps, _, _ = ar.purge_dataset(DATASET, model.snapshots_o(spark, sf_dir),
                                   model.owned_stations_o(spark, sf_dir), model.prices_o(spark, sf_dir))
    return snaps.groupBy("dataset").agg(F.count(F.lit(1)).alias("snapshots"))


@query("purge_stations", ids="OP-14 (stations of the other datasets stay)",
       sql=_OWNED_SQL + "SELECT id, name FROM owned WHERE owner <> 0")
def purge_stations(spark, sf_dir):
    _, stations, _ = ar.purge_dataset(DATASET, model.snapshots_o(spark, sf_dir),
                                      model.owned_stations_o(spark, sf_dir), model.prices_o(spark, sf_dir))
    return stations.select("id", "name")


def write_document(spark, root: str, path: str, analysis: str, compression: str,
                   snapshot_fields=("id", "timestamp", "status")) -> str:
    """The sections of an exported archive as one JSON document, in parts.

    The parts, put together in the order of their names, are the document (and, if gzip, one gzip
    file). A union keeps the order of its inputs and each task writes one part, so no task sees
    more of the document than its part.
    """
    line = lambda text: spark.range(0, 1, 1, 1).select(F.lit(text).alias("value"))
    lines = line('{"version": 1, "analysis": ' + analysis)
    for name in ("fuels", "stations", "snapshots", "prices"):
        rows = src.read_section(spark, root, name)
        if name == "snapshots":
            rows = rows.select(*snapshot_fields)
        body = rows.select(F.concat(F.lit(", "), F.to_json(F.struct(*rows.columns))).alias("value"))
        lines = lines.unionAll(line(f', "{name}": [null')).unionAll(body).unionAll(line("]"))
    lines.unionAll(line("}")).write.mode("overwrite").option("compression", compression).text(path)
    return path


def _document(spark, sf_dir, path):
    next_station = model.stations_o(spark, sf_dir).select(F.max("id") + 1).scalar()
    next_snapshot = model.snapshots_o(spark, sf_dir).select(F.max("id") + 1).scalar()
    return ar.import_document(spark, path, dataset_id=NEW_DATASET_ID, fuels=_empty_fuels(spark),
                              next_station_id=next_station, next_snapshot_id=next_snapshot)


@query("archive_document_import", ids="SRC-03 SRC-04 STR-05 OP-13 JOIN-09 (one gzip document with all sections)",
       sql=O_CTE + """
SELECT s."timestamp" AS snapshot_ts, st.name AS station, fu.name AS fuel, CAST(px.price AS DOUBLE) AS price
FROM px JOIN snaps s ON s.id = px.snapshot_id JOIN st ON st.id = px.station_id JOIN fu ON fu.id = px.fuel_id
WHERE s.dataset = '1-URGENT'
""")
def archive_document_import(spark, sf_dir):
    root = _export(spark, sf_dir)
    path = write_document(spark, root, work_dir(spark, "document"), '{"update_frequency": 7}', "gzip")
    imp = _document(spark, sf_dir, path)
    st = imp.stations.select(F.col("id").alias("station_id"), F.col("name").alias("station"))
    sn = imp.snapshots.select(F.col("id").alias("snapshot_id"), F.col("timestamp").alias("snapshot_ts"))
    fu = imp.fuels.select(F.col("id").alias("fuel_id"), F.col("name").alias("fuel"))
    return (imp.prices.join(sn, "snapshot_id").join(st, "station_id").join(fu, "fuel_id")
            .select("snapshot_ts", "station", "fuel", "price"))


@query("import_defaults", ids="UPS-06 UPS-04 (settings and statuses that an archive lacks; its active flag)",
       sql=O_CTE + """
SELECT 5 AS update_frequency, '' AS data_source_url, 100 AS max_snapshots, false AS active,
       false AS run_automatically, true AS activate, 'processed' AS status, count(*) AS snapshots
FROM snaps WHERE dataset = '1-URGENT'
""")
def import_defaults(spark, sf_dir):
    root = _export(spark, sf_dir)
    path = write_document(spark, root, work_dir(spark, "document"), '{"active": true}', "none",
                          snapshot_fields=("id", "timestamp"))
    imp = _document(spark, sf_dir, path)
    counts = imp.snapshots.groupBy("status").agg(F.count(F.lit(1)).alias("snapshots"))
    names = [c for c in imp.dataset.columns if c != "id"]
    row = imp.dataset.select(F.struct(*names)).scalar()      # the one registry row
    return counts.withColumn("_row", row).select("status", "snapshots", "_row.*")
