"""Data model: column names, types and the two bindings to the test tables.

Fact tables
  * V1 ``prices``: station_id, fuel_type, fetched_at (timestamp), price
    DECIMAL(10,2)  — one row per observation, duplicates legal.
  * V2 ``prices``: snapshot_id, station_id, fuel_id, price DECIMAL(10,2).
Dimensions
  * ``stations`` (id, name, city, region[, adress, longitude, latitude])
  * ``snapshots`` (id, timestamp, status, dataset, price_count)
  * ``fuels`` (id, name)
  * ``datasets`` registry (id, update_frequency, data_source_url, active,
    run_automatically, max_snapshots)

Binding E (V1 model) and binding O (V2 model) map the driver's star-schema
test tables onto these shapes; both are lazy DataFrames, so every query
built on them reads the whole given tables and scales with them.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pumpwatch.sources.tables import read_table

PRICE_TYPE = T.DecimalType(10, 2)
KEY = ["station_id", "fuel_type"]

# fixed values: snapshot lifecycle states
STATUS_DOWNLOADING = "downloading"
STATUS_PROCESSING = "processing"
STATUS_PROCESSED = "processed"
STATUS_ERROR = "error"

# fixed values: dataset registry defaults (minutes, url, flags, page size)
DEFAULT_UPDATE_FREQUENCY = 5
DEFAULT_MAX_SNAPSHOTS = 100


def as_price(col: Column) -> Column:
    return col.cast(PRICE_TYPE)


def as_utc_ts(col: Column) -> Column:
    """Test parquet holds TIMESTAMP_NTZ; the session is pinned to UTC."""
    return col.cast("timestamp")


# --------------------------------------------------------------- binding E
def stations_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer ⋈ nation ⋈ region → stations(id, name, city, region).

    nation (25 rows) and region (5 rows) are fixed-size dimensions, so the
    broadcast hint is safe at any scale; customer streams through.
    """
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (cust
            .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                    F.col("n_name").alias("city"), F.col("r_name").alias("region")))


def obs_raw(spark: SparkSession, sf_dir: str, with_event_id: bool = False,
            days: list | None = None, since=None) -> DataFrame:
    """events → prices(station_id, fuel_type, fetched_at, price); has duplicates.

    ``days``: only snapshots from the first to the last of these days, as a
    half-open interval on the raw time column, which prunes row groups;
    ``since``: only rows from this time on, in the same way.
    """
    ev = read_table(spark, sf_dir, "events")
    if since is not None:
        ev = ev.where(F.col("ts") >= F.lit(since.isoformat(sep=" ")).cast(ev.schema["ts"].dataType))
    if days is not None:
        if not days:
            ev = ev.where(F.lit(False))
        else:
            raw = ev.schema["ts"].dataType
            end = max(days) + timedelta(days=1)
            ev = ev.where((F.col("ts") >= F.lit(min(days)).cast(raw)) & (F.col("ts") < F.lit(end).cast(raw)))
    cols = [F.col("user_id").alias("station_id"), F.col("event_type").alias("fuel_type"),
            F.date_trunc("day", as_utc_ts(F.col("ts"))).alias("fetched_at"),
            as_price(F.col("value")).alias("price")]
    if with_event_id:
        cols.append(F.col("event_id"))
    return ev.select(*cols)


def obs(spark: SparkSession, sf_dir: str, days: list | None = None) -> DataFrame:
    """obs_raw with one row per (station, fuel, snapshot): the latest event wins.

    A partial (map-side) aggregate: a hot key is combined before the shuffle.
    """
    return (obs_raw(spark, sf_dir, with_event_id=True, days=days)
            .groupBy("station_id", "fuel_type", "fetched_at")
            .agg(F.max_by("price", "event_id").alias("price")))


# --------------------------------------------------------------- binding O
_STATUS_OF = {"F": STATUS_PROCESSED, "O": STATUS_PROCESSING, "P": STATUS_ERROR}


def snapshots_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → snapshots(id, timestamp, status, dataset)."""
    o = read_table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", F.lit(_STATUS_OF["F"])) \
        .when(F.col("o_orderstatus") == "O", F.lit(_STATUS_OF["O"])) \
        .when(F.col("o_orderstatus") == "P", F.lit(_STATUS_OF["P"]))
    return o.select(F.col("o_orderkey").alias("id"),
                    as_utc_ts(F.col("o_orderdate")).alias("timestamp"),
                    status.alias("status"),
                    F.col("o_orderpriority").alias("dataset"))


def prices_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem → prices(snapshot_id, station_id, fuel_id, price)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("snapshot_id"),
                     F.col("l_suppkey").alias("station_id"),
                     F.col("l_partkey").alias("fuel_id"),
                     as_price(F.col("l_extendedprice")).alias("price"))


def fuels_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part → fuels(id, name): the category of a price is the part type."""
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))


def stations_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier ⋈ nation ⋈ region → stations(id, name, city, region, adress, lon, lat)."""
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    key = F.col("s_suppkey")
    return (sup
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(key.alias("id"), F.col("s_name").alias("name"),
                    F.col("n_name").alias("city"), F.col("r_name").alias("region"),
                    F.concat(key.cast("string"), F.lit(" Main St")).alias("adress"),
                    (F.lit(-80.0) + F.pmod(key, F.lit(24)).cast("double")).alias("longitude"),
                    (F.lit(44.0) + F.pmod(key, F.lit(19)).cast("double")).alias("latitude")))


# fixed values: the priorities of the test tables, here the names of the datasets
DATASET_NAMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def owned_stations_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stations_o with the dataset that each station belongs to, by its nation's number."""
    own = read_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.get(F.array(*map(F.lit, DATASET_NAMES)), F.pmod("s_nationkey", F.lit(5)).cast("int")).alias("dataset"))
    return stations_o(spark, sf_dir).join(own, "id")


def datasets_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset registry: one entry per order priority, '1-URGENT' → id 1.

    Derived with a partial aggregate over orders, so it stays a handful of
    rows whatever the scale. Dataset 1 is the active one.
    """
    o = read_table(spark, sf_dir, "orders").select("o_orderpriority")
    reg = o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").alias("_n"))
    ds_id = F.split(F.col("name"), "-").getItem(0).cast("long")
    return reg.select(
        ds_id.alias("id"), F.col("name"),
        F.lit(DEFAULT_UPDATE_FREQUENCY).alias("update_frequency"),
        F.lit("").alias("data_source_url"),
        (ds_id == F.lit(1)).alias("active"),
        F.lit(False).alias("run_automatically"),
        F.lit(DEFAULT_MAX_SNAPSHOTS).alias("max_snapshots"))
