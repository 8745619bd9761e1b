"""Feed → facts and dimension upserts (OP-11, OP-15, FLT-06, UPS-01..03, SCL-01..04).

Everything is a DataFrame transformation; the caller decides where the
results are written (``pumpwatch.sinks.store``). "Last record wins" upserts
use ``max_by(struct, order)`` — a partial aggregate, so a station that shows
up in a third of all feeds is still combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwatch.functions.keys import assign_ids
from pumpwatch.session import ensure_checkpoint_dir
from pumpwatch.functions.scalars import (address_city, address_street, clean_fuel_name,
                                         parse_price_text)
from pumpwatch.sources.tables import broadcast_few

# fixed values: defaults of a V1 record without fuel type
DEFAULT_FUEL = "regular"


def feed_entries(flat: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per price entry of every feature, parsed (not yet filtered).

    ``flat`` is the output of ``sources.feed.flatten_features``; ``keep``
    names pass-through columns (snapshot id, file, feature position …).
    """
    keep = keep or [c for c in ("snapshot", "source_file", "pos") if c in flat.columns]
    e = flat.select(*keep, F.col("Name").alias("_name"), F.col("Address").alias("_address"),
                    F.col("Region").alias("_region"), "longitude", "latitude",
                    F.explode("Prices").alias("p"))   # NULL / missing Prices → no rows
    return e.select(
        *keep,
        F.coalesce(F.col("_name"), F.lit("")).alias("name"),
        address_street(F.col("_address")).alias("street"),
        address_city(F.col("_address")).alias("city"),
        F.coalesce(F.col("_region"), F.lit("")).alias("region"),
        "longitude", "latitude",
        clean_fuel_name(F.col("p.GasType")).alias("fuel"),
        parse_price_text(F.col("p.Price")).alias("price"),
        F.coalesce(F.col("p.IsAvailable"), F.lit(False)).alias("available"))


def valid_entries(entries: DataFrame) -> DataFrame:
    """FLT-06: available, price parsed, fuel name non-empty."""
    return entries.where(F.col("available") & F.col("price").isNotNull()
                         & F.col("fuel").isNotNull()).drop("available")


def feed_rejects(flat: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of kept and rejected entries per reason (data-quality side output).

    ``by`` names columns of ``feed_entries`` (e.g. region, snapshot)."""
    by = by or []
    e = feed_entries(flat)
    avail, priced, named = F.col("available"), F.col("price").isNotNull(), F.col("fuel").isNotNull()
    return e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(~avail).alias("unavailable"),
        F.count_if(avail & ~priced).alias("bad_price"),
        F.count_if(avail & priced & ~named).alias("blank_fuel"),
        F.count_if(avail & priced & named).alias("kept"))


STATION_ATTRS = ["city", "region", "longitude", "latitude"]


def _latest(df: DataFrame, key: list[str], order: Column, cols: list[str]) -> DataFrame:
    """Per key, the values of the row with the greatest ``order``."""
    packed = df.select(*key, order.alias("_ord"), F.struct(*cols).alias("_v"))
    return (packed.groupBy(*key).agg(F.max_by("_v", "_ord").alias("_v"))
            .select(*key, "_v.*"))


def upsert_stations_by_id(existing: DataFrame, records: DataFrame, order: Column) -> DataFrame:
    """UPS-01: V1 station upsert by id; the last record of the batch wins;
    every column but ``created_at`` is overwritten (created_at keeps its first value)."""
    upd_cols = ["name", "address", "city", "region", "latitude", "longitude"]
    latest = _latest(records, ["id"], order, upd_cols + ["created_at"])
    old = existing.select("id", *[F.col(c).alias(f"_o_{c}") for c in upd_cols + ["created_at"]])
    merged = old.join(latest.withColumn("_new", F.lit(True)), "id", "full_outer")
    out = [F.col("id")]
    for c in upd_cols:
        out.append(F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c))
    out.append(F.coalesce(F.col("_o_created_at"), F.col("created_at")).alias("created_at"))
    return merged.select(*out)


def records_to_prices(records: DataFrame, now: Column) -> DataFrame:
    """OP-15: every record is one price row (no dedup); fuel defaults to
    'regular', fetched_at to the batch time."""
    return records.select(
        F.col("station_id"),
        F.coalesce(F.col("fuel_type"), F.lit(DEFAULT_FUEL)).alias("fuel_type"),
        F.col("price").cast("decimal(10,2)").alias("price"),
        F.coalesce(F.col("fetched_at"), now).alias("fetched_at"))


def upsert_stations(existing: DataFrame, incoming: DataFrame, order: Column,
                    key: tuple[str, ...] = ("dataset", "name", "adress")) -> DataFrame:
    """UPS-02: V2 station upsert by (dataset, name, street).

    City, region and coordinates are overwritten by the latest record (city
    is NOT part of the key). Existing ids are kept; new keys get ids after
    the current maximum (distributed numbering, no single-task window).
    """
    latest = _latest(incoming, list(key), order, STATION_ATTRS)
    next_id = existing.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    return merge_stations(existing, latest, next_id, key)


def merge_stations(existing: DataFrame, latest: DataFrame, next_id: int | Column,
                   key: tuple[str, ...] = ("dataset", "name", "adress")) -> DataFrame:
    """UPS-02 for one record a key: ``existing`` with ``latest`` merged in, new ids from ``next_id`` on."""
    key = list(key)
    old = existing.select("id", *key, *[F.col(c).alias(f"_o_{c}") for c in STATION_ATTRS])
    merged = old.join(latest.withColumn("_new", F.lit(True)), key, "full_outer")
    vals = [F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}")).alias(c) for c in STATION_ATTRS]
    # the "latest record per key" aggregate is the only pass over the incoming
    # (fact-sized) records: its merged, dimension-sized result is checkpointed
    # once, so numbering the new keys and emitting the kept ones reuse it
    ensure_checkpoint_dir(merged.sparkSession)
    rows = merged.select("id", *key, *vals).checkpoint(eager=True)
    kept = rows.where(F.col("id").isNotNull())
    fresh = rows.where(F.col("id").isNull()).drop("id")
    return kept.unionByName(assign_ids(fresh, key, start_col=F.lit(next_id)).select(*kept.columns))


def get_or_create_fuels(existing: DataFrame, names: DataFrame, next_id: int | None = None) -> DataFrame:
    """UPS-03: global fuel dimension; unseen names get new ids (from ``next_id`` on, else after the greatest)."""
    new = (names.select(F.col("fuel").alias("name")).distinct()
           .join(existing.select("name"), "name", "left_anti"))
    first = existing.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar() if next_id is None else F.lit(next_id)
    return existing.select("id", "name").unionByName(
        assign_ids(new, ["name"], start_col=first).select("id", "name"))


def _station_rows(flat: DataFrame, dataset: str, keep: list[str]) -> DataFrame:
    return flat.select(*keep,
                       "longitude", "latitude", F.lit(dataset).alias("dataset"),
                       F.coalesce(F.col("Name"), F.lit("")).alias("name"),
                       address_street(F.col("Address")).alias("adress"),
                       address_city(F.col("Address")).alias("city"),
                       F.coalesce(F.col("Region"), F.lit("")).alias("region"))


def _poll_order(flat: DataFrame) -> Column:
    return F.struct(F.col("snapshot"), *([F.col("pos")] if "pos" in flat.columns else []))


def station_updates(flat: DataFrame, dataset: str) -> DataFrame:
    """The latest record of each station key of one or many polls.

    Names and addresses as they are come together first, so that the parsing of
    addresses is one for each of them, not for each feature.
    """
    order = F.struct(_poll_order(flat), "Region", "longitude", "latitude")
    raw = flat.groupBy("Name", "Address").agg(F.max(order).alias("_ord"))
    rows = _station_rows(raw.select("Name", "Address", "_ord.Region", "_ord.longitude", "_ord.latitude", "_ord"), dataset, ["_ord"])
    return _latest(rows, ["dataset", "name", "adress"], F.col("_ord"), STATION_ATTRS)


def fuel_names(flat: DataFrame) -> DataFrame:
    """The fuels of the valid price entries."""
    return valid_entries(feed_entries(flat)).select(F.col("fuel").alias("name")).distinct()


def upsert_dimensions(flat: DataFrame, dataset: str, stations: DataFrame, fuels: DataFrame
                      ) -> tuple[DataFrame, DataFrame]:
    """Stations (UPS-02) and fuels (UPS-03) after one or many polls."""
    next_id = stations.select(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()
    stations2 = merge_stations(stations, station_updates(flat, dataset), next_id)
    fuels2 = get_or_create_fuels(fuels, valid_entries(feed_entries(flat)))
    return stations2, fuels2


def resolve_prices(flat: DataFrame, dataset: str, stations: DataFrame, fuels: DataFrame
                   ) -> DataFrame:
    """Valid price entries → (snapshot_id, station_id, fuel_id, price) by the
    natural keys (name, street) and fuel name; few stations and fuels are broadcast."""
    entries = valid_entries(feed_entries(flat))
    st = stations.where(F.col("dataset") == F.lit(dataset)).select(
        F.col("id").alias("station_id"), "name", F.col("adress").alias("street"))
    fu = fuels.select(F.col("id").alias("fuel_id"), F.col("name").alias("fuel"))
    return (entries.join(broadcast_few(st), ["name", "street"]).join(broadcast_few(fu), "fuel")
            .select(F.col("snapshot").alias("snapshot_id"), "station_id", "fuel_id", "price"))


def populate(flat: DataFrame, dataset: str, stations: DataFrame, fuels: DataFrame
             ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """OP-11: features of one or many polls → (stations', fuels', new prices).

    ``flat`` carries a ``snapshot`` id per feature (and optionally ``pos``,
    the feature's position in its document, for "last wins" inside a poll).
    The new price rows reference the upserted dimensions by id.
    """
    stations2, fuels2 = upsert_dimensions(flat, dataset, stations, fuels)
    return stations2, fuels2, resolve_prices(flat, dataset, stations2, fuels2)
