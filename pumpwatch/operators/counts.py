"""Per-snapshot counts, dataset totals, KPIs and the dataset registry
(JOIN-07, JOIN-08, AGG-01, AGG-09, AGG-10, AGG-17, FLT-10, UPS-04, TOP-07)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pumpwatch.sources.tables import dataset_extract


def with_price_counts(snapshots: DataFrame, prices: DataFrame) -> DataFrame:
    """JOIN-08 / AGG-17: snapshot dimension + price_count (0 when none).

    The correlated COUNT subquery becomes a partial aggregate of the facts
    (one row per snapshot) left-joined to the dimension.
    """
    counts = prices.groupBy(F.col("snapshot_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_cnt"))
    return (snapshots.join(counts, "id", "left")
            .withColumn("price_count", F.coalesce(F.col("_cnt"), F.lit(0)).cast("long"))
            .drop("_cnt"))


def dataset_price_total(counted_snapshots: DataFrame) -> DataFrame:
    """AGG-09: SUM(price_count) per dataset from the cached counts; NULL → 0."""
    return (counted_snapshots.groupBy("dataset")
            .agg(F.coalesce(F.sum("price_count"), F.lit(0)).cast("long").alias("price_total")))


def fuels_used(prices: DataFrame, fuels: DataFrame, snapshots: DataFrame,
               dataset: str) -> DataFrame:
    """JOIN-07 / AGG-10: distinct names of the fuels a dataset's prices use, sorted."""
    used = dataset_extract(prices, snapshots, dataset).select(F.col("fuel_id").alias("id"))
    return (fuels.join(used, "id", "left_semi").select("name").distinct().orderBy("name"))


def active_dataset(registry: DataFrame) -> DataFrame:
    """FLT-10: the first active dataset by id — zero rows when none is active."""
    return registry.where(F.col("active")).orderBy("id").limit(1)


def activate(registry: DataFrame, dataset_id: int) -> DataFrame:
    """UPS-04: activating one dataset deactivates every other one."""
    return registry.withColumn("active", F.col("id") == F.lit(dataset_id))


def active_dataset_snapshots(registry: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Snapshots of the active dataset (empty registry/none active → empty)."""
    act = active_dataset(registry).select(F.col("name").alias("dataset"))
    return snapshots.join(F.broadcast(act), "dataset", "left_semi")


def home_kpis(registry: DataFrame, counted_snapshots: DataFrame, stations: DataFrame) -> DataFrame:
    """AGG-01: stations, snapshots and prices of the active dataset (zeros when none).

    Stations are counted in their own table, with or without prices; prices by
    the cached per-snapshot counts (no pass over the facts for either).
    """
    act = active_dataset(registry).select(F.col("name").alias("dataset"))
    n_stations = stations.join(act, "dataset", "left_semi").select(F.count(F.lit(1))).scalar()
    snaps = active_dataset_snapshots(registry, counted_snapshots)
    return snaps.agg(F.count(F.lit(1)).alias("snapshot_count"),
                     F.coalesce(F.sum("price_count"), F.lit(0)).cast("long").alias("price_count")
                     ).select(F.coalesce(n_stations, F.lit(0)).alias("station_count"),
                              "snapshot_count", "price_count")


def stations_sorted(stations: DataFrame) -> DataFrame:
    """TOP-07: stations ordered by region, city, name."""
    return stations.orderBy("region", "city", "name", "id")
