"""Dataset archive export / import and dataset purge (OP-12, OP-13, OP-14,
SNK-01, JOIN-07, JOIN-09, UPS-05, UPS-06)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwatch.functions.keys import assign_ids
from pumpwatch.functions.scalars import parse_iso_timestamp
from pumpwatch.model import DEFAULT_MAX_SNAPSHOTS, DEFAULT_UPDATE_FREQUENCY, STATUS_PROCESSED
from pumpwatch.operators.counts import with_price_counts
from pumpwatch.session import ensure_checkpoint_dir
from pumpwatch.sources import archive as src

#: Fuels (id, id) that are broadcast at most; more are joined by a shuffle.
MAX_BROADCAST_FUELS = 100_000

# ISO-8601 with a numeric offset, e.g. 2026-01-01T00:00:00+00:00
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ssxxx"


def export_archive(spark: SparkSession, root: str, dataset_row: DataFrame, stations: DataFrame,
                   snapshots: DataFrame, prices: DataFrame, fuels: DataFrame) -> str:
    """OP-12: write one dataset as an archive directory.

    * manifest: version 1 + the dataset settings;
    * fuels: only those its prices use (semi join);
    * stations: those given, the dataset's own, even without prices;
    * snapshots: all of them, whatever their status (timestamp ISO-8601 UTC);
    * prices: those whose snapshot belongs to the dataset, price as a number.
    Each section is written by many tasks as gzip JSON lines.
    """
    opts = {"compression": "gzip"}
    (dataset_row.select(F.lit(src.ARCHIVE_VERSION).alias("version"),
                        F.struct("update_frequency", "data_source_url", "active",
                                 "run_automatically", "max_snapshots").alias("analysis"))
     .coalesce(1).write.mode("overwrite").json(f"{root}/manifest"))
    own = prices.join(snapshots.select(F.col("id").alias("snapshot_id")), "snapshot_id",
                      "left_semi")
    (own.select("station_id", "fuel_id", F.col("price").cast("double").alias("price"),
                "snapshot_id")
     .write.mode("overwrite").options(**opts).json(f"{root}/prices"))
    # the used fuels are read back from the written section: one pass over the facts
    used = src.read_section(spark, root, "prices").select(F.col("fuel_id").alias("id")).distinct()
    (fuels.join(used, "id", "left_semi").select("id", "name")
     .write.mode("overwrite").options(**opts).json(f"{root}/fuels"))
    (stations.select("id", "name", "city", "region", "adress",
                     F.col("longitude").cast("double").alias("longitude"),
                     F.col("latitude").cast("double").alias("latitude"))
     .write.mode("overwrite").options(**opts).json(f"{root}/stations"))
    (snapshots.select("id", F.date_format("timestamp", ISO_FORMAT).alias("timestamp"), "status")
     .write.mode("overwrite").options(**opts).json(f"{root}/snapshots"))
    return root


@dataclass
class Imported:
    dataset: DataFrame     # registry row of the new dataset, inactive until done; ``activate``: the
    #                        archive's own flag, for ``counts.activate`` once the import is complete
    fuels: DataFrame       # global fuel dimension after get-or-create
    stations: DataFrame    # new stations (new ids) with old_id
    snapshots: DataFrame   # new snapshots (new ids) with old_id and price_count
    prices: DataFrame      # new price rows
    dropped: DataFrame     # archive prices with an id that maps to nothing


def import_sections(manifest: DataFrame, fuels_in: DataFrame, stations_in: DataFrame,
                    snapshots_in: DataFrame, prices_in: DataFrame, *, dataset_id: int,
                    fuels: DataFrame, next_station_id, next_snapshot_id) -> Imported:
    """OP-13: archive sections → new dimension rows and facts.

    Every station and snapshot gets a new id (dense, after the current max,
    numbered in old-id order without a single-task window); fuels are matched
    by name (global). Prices are remapped by three equi-joins; a price whose
    station, fuel or snapshot id is unknown is dropped (and reported).
    Missing settings take the defaults; a snapshot without status is
    'processed'; the imported dataset starts inactive.
    """
    a = F.col("analysis")
    dataset = manifest.select(
        F.lit(dataset_id).cast("long").alias("id"),
        F.coalesce(a["update_frequency"], F.lit(DEFAULT_UPDATE_FREQUENCY)).alias("update_frequency"),
        F.coalesce(a["data_source_url"], F.lit("")).alias("data_source_url"),
        F.lit(False).alias("active"),
        F.lit(False).alias("run_automatically"),
        F.coalesce(a["active"], F.lit(False)).alias("activate"),
        F.coalesce(a["max_snapshots"], F.lit(DEFAULT_MAX_SNAPSHOTS)).alias("max_snapshots"))
    # fuels: get-or-create by name
    names = fuels_in.select("name").distinct()
    new_names = names.join(fuels.select("name"), "name", "left_anti")
    next_fuel = fuels.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    fuels2 = fuels.select("id", "name").unionByName(
        assign_ids(new_names, ["name"], start_col=next_fuel).select("id", "name"))
    fuel_map = fuels_in.select(F.col("id").alias("fuel_id"), "name").join(
        fuels2.select(F.col("id").alias("new_fuel_id"), "name"), "name").drop("name")
    st = (assign_ids(stations_in.withColumnRenamed("id", "old_id"), ["old_id"],
                     start_col=next_station_id)
          .withColumn("dataset_id", F.lit(dataset_id).cast("long")))
    sn = (assign_ids(snapshots_in.withColumnRenamed("id", "old_id"), ["old_id"],
                     start_col=next_snapshot_id)
          .select("id", "old_id", parse_iso_timestamp(F.col("timestamp")).alias("timestamp"),
                  F.coalesce(F.col("status"), F.lit(STATUS_PROCESSED)).alias("status"),
                  F.lit(dataset_id).cast("long").alias("dataset_id")))
    st_map = st.select(F.col("old_id").alias("station_id"), F.col("id").alias("new_station_id"))
    sn_map = sn.select(F.col("old_id").alias("snapshot_id"), F.col("id").alias("new_snapshot_id"))
    if fuel_map.count() <= MAX_BROADCAST_FUELS:
        fuel_map = F.broadcast(fuel_map)     # a handful of keys: no shuffle of the facts by fuel
    # every price is probed once, and written: mapped rows, their counts and the report of
    # dropped rows (once each, duplicates kept) all read that copy
    ensure_checkpoint_dir(prices_in.sparkSession)
    probe = (prices_in.join(fuel_map, "fuel_id", "left").join(st_map, "station_id", "left")
             .join(sn_map, "snapshot_id", "left")).checkpoint(eager=True)
    lost = (F.col("new_station_id").isNull() | F.col("new_fuel_id").isNull()
            | F.col("new_snapshot_id").isNull())
    mapped = probe.where(~lost).select(F.col("new_snapshot_id").alias("snapshot_id"),
                                       F.col("new_station_id").alias("station_id"),
                                       F.col("new_fuel_id").alias("fuel_id"),
                                       F.col("price").cast("decimal(10,2)").alias("price"))
    dropped = probe.where(lost).select(*prices_in.columns)
    counted = with_price_counts(sn, mapped)
    return Imported(dataset, fuels2, st, counted, mapped, dropped)


def import_archive(spark: SparkSession, root: str, *, dataset_id: int, fuels: DataFrame,
                   next_station_id, next_snapshot_id) -> Imported:
    """Read an archive directory (version checked first) and import it."""
    manifest = src.read_manifest(spark, root)
    src.check_versions(manifest)
    return import_sections(manifest, src.read_section(spark, root, "fuels"),
                           src.read_section(spark, root, "stations"),
                           src.read_section(spark, root, "snapshots"),
                           src.read_section(spark, root, "prices"),
                           dataset_id=dataset_id, fuels=fuels,
                           next_station_id=next_station_id, next_snapshot_id=next_snapshot_id)


def import_document(spark: SparkSession, path: str, *, dataset_id: int, fuels: DataFrame,
                    next_station_id, next_snapshot_id) -> Imported:
    """Import an archive that is one JSON document, plain or gzip."""
    part = src.read_document_sections(spark, path)
    src.check_versions(part["manifest"])
    return import_sections(part["manifest"], part["fuels"], part["stations"], part["snapshots"],
                           src.read_price_fragments(spark, path), dataset_id=dataset_id, fuels=fuels,
                           next_station_id=next_station_id, next_snapshot_id=next_snapshot_id)


def purge_dataset(dataset: str, snapshots: DataFrame, stations: DataFrame, prices: DataFrame,
                  dataset_col: str = "dataset") -> tuple[DataFrame, DataFrame, DataFrame]:
    """OP-14: remove a dataset with its snapshots, stations and prices (cascade).

    Fuels are global and kept. Prices go by an anti join with the dataset's
    snapshot ids — a rewrite of the fact table, no row-level deletes.
    """
    gone = snapshots.where(F.col(dataset_col) == F.lit(dataset)).select(
        F.col("id").alias("snapshot_id"))
    snaps2 = snapshots.where(~(F.col(dataset_col) == F.lit(dataset))
                             | F.col(dataset_col).isNull())
    if dataset_col in stations.columns:
        stations2 = stations.where(~(F.col(dataset_col) == F.lit(dataset))
                                   | F.col(dataset_col).isNull())
    else:
        stations2 = stations
    prices2 = prices.join(gone, "snapshot_id", "left_anti")
    return snaps2, stations2, prices2
