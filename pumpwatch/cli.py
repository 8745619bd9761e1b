"""Command-line reports over a price history.

    python -m pumpwatch --sf-dir /root/testdata/sf0.01 summary
    python -m pumpwatch --prices P --stations S latest --limit 20
    python -m pumpwatch ... regions | snapshots | variations --limit 10 | schema

``--prices`` is a parquet history (station_id, fuel_type, fetched_at, price),
``--stations`` a parquet station table (id, name, city, region);
``--sf-dir`` uses the test tables through binding E instead. Every report is
computed by the library operators on the cluster; only the bounded result
that is printed (a top-k, the last snapshots, one row per region) reaches the
driver.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pumpwatch import model
from pumpwatch.functions import scalars as sc
from pumpwatch.operators import observations as ob
from pumpwatch.operators import quality as qa
from pumpwatch.plans.present import present
from pumpwatch.session import get_session


def _load(spark, args) -> tuple[DataFrame, DataFrame]:
    if args.sf_dir:
        return model.obs_raw(spark, args.sf_dir), model.stations_e(spark, args.sf_dir)
    prices = spark.read.parquet(args.prices).select(
        "station_id", "fuel_type", F.col("fetched_at").cast("timestamp").alias("fetched_at"),
        F.col("price").cast(model.PRICE_TYPE).alias("price"))
    return prices, spark.read.parquet(args.stations)


def report_summary(prices, stations) -> list[str]:
    r = present(ob.summary(prices, stations)).first()
    span = f"{r.first_snapshot} .. {r.last_snapshot}" if r.prices else "empty"
    return [f"stations={r.stations} observations={r.prices} polls={r.snapshots}", f"period: {span}"]


def _table(names: list[str], rows: list[str]) -> list[str]:
    """Rows under a comment line with their column names; cells are divided by bars."""
    return ["# " + " | ".join(names), *rows] if rows else ["# nothing to list"]


def _cells(*cols: Column) -> Column:
    return F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def report_latest(prices, stations, limit: int) -> list[str]:
    times = ob.newest_times(prices, 1)
    newest = prices.where(F.col("fetched_at") == F.lit(times[0] if times else None).cast("timestamp"))
    top = ob.latest_prices(newest, stations, limit)
    rows = top.select(_cells(sc.cents(F.round("price", 1)), F.col("fuel_type"), F.col("name"),
                             F.col("city")).alias("l")).collect()
    return _table(["price", "fuel", "station", "city"], [r.l for r in rows])


def report_regions(prices, stations) -> list[str]:
    rep = ob.region_report(prices, stations)
    fuels = rep.columns[2:]
    rows = rep.select(_cells(F.col("region"), F.col("stations"), *[
        sc.cents(F.round(F.col(f"`{f}`"), 1)) for f in fuels]).alias("l")).collect()
    return _table(["region", "stations", *fuels], [r.l for r in rows])


def report_snapshots(prices) -> list[str]:
    rows = present(ob.snapshot_changes(prices, 10)).collect()
    return _table(["poll", "observations", "changes"], [
        f"{r.fetched_at} | {r.records} | {sc.MISSING_MARK if r.changes is None else r.changes}" for r in rows])


def report_variations(prices, stations, limit: int) -> list[str]:
    var = ob.price_moves(prices, stations)
    changed = ob.changed_since_previous(prices, ob.newest_times(prices, 2)).first().changed
    # both top-k lists in ONE plan: the moves are computed once and shared through exchange reuse
    ranked = (ob.top_rises(var, limit).withColumn("_list", F.lit(0))
              .unionByName(ob.top_drops(var, limit).withColumn("_list", F.lit(1))))
    rows = present(ranked.select(
        "_list", _cells(sc.cents(F.col("delta"), signed=True), sc.cents(F.col("prev_price")), sc.cents(F.col("price")),
                        F.col("fuel_type"), F.col("station_name"), F.col("city"), F.col("fetched_at")).alias("l"),
        "delta", "station_name", "fuel_type")).collect()
    out = [f"moved since the poll before: {changed}"]
    for i, title in enumerate(("up", "down")):
        part = sorted((r for r in rows if r._list == i),     # limit rows each at most
                      key=lambda r: (-abs(r.delta), r.station_name, r.fuel_type))
        out += ["", f"{title}:", *_table(["move", "from", "to", "fuel", "station", "city", "since"], [r.l for r in part])]
    return out


def report_schema(spark, prices, stations) -> list[str]:
    prof = qa.dataset_profile(spark, {"prices": prices, "stations": stations})
    out = []
    for r in prof.orderBy("table", "position").collect():
        if r.position == 0:
            out += ["", f"  {r.table} ({r.rows} rows)"]
        out.append(f"    {r.column:<20} {r.data_type:<14} {'NULL' if r.nullable else 'NOT NULL'}")
    return out


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="pumpwatch", description=__doc__.split("\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--sf-dir", help="test tables folder (binding E)")
    src.add_argument("--prices", help="parquet price history")
    ap.add_argument("--stations", help="parquet station table (with --prices)")
    ap.add_argument("--master", default=None)
    ap.add_argument("command", choices=["summary", "latest", "regions", "snapshots",
                                        "variations", "schema"])
    ap.add_argument("--limit", type=int, default=None)
    args = ap.parse_args(argv)
    if args.prices and not args.stations:
        ap.error("--prices needs --stations")
    spark = get_session(args.master)
    prices, stations = _load(spark, args)
    if args.command == "summary":
        lines = report_summary(prices, stations)
    elif args.command == "latest":
        lines = report_latest(prices, stations, args.limit or 20)
    elif args.command == "regions":
        lines = report_regions(prices, stations)
    elif args.command == "snapshots":
        lines = report_snapshots(prices)
    elif args.command == "variations":
        lines = report_variations(prices, stations, args.limit or 10)
    else:
        lines = report_schema(spark, prices, stations)
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
