"""Registered pivot queries (OP-09, AGG-11..14, SNK-03) over price extracts of binding O."""

from __future__ import annotations

from pyspark.sql import functions as F

from pumpwatch import model
from pumpwatch.operators import pivot as pv
from pumpwatch.operators import snapshots as sn
from pumpwatch.operators.observations import distinct_values
from pumpwatch.plans.registry import query
from pumpwatch.plans.snapshot_queries import DATASET, MAX_SNAPSHOTS, O_CTE
from pumpwatch.sources.tables import broadcast_few

RANGE = ("1996-01-01 00:00:00", "1997-12-31 00:00:00")

# records of the month buckets of two years, price kept as DECIMAL
RECS_SQL = O_CTE + f"""
, chosen AS (
  SELECT max(id) AS id FROM base
  WHERE "timestamp" BETWEEN TIMESTAMP '{RANGE[0]}' AND TIMESTAMP '{RANGE[1]}'
  GROUP BY date_trunc('month', "timestamp")),
recs AS (
  SELECT st.name AS "Station", st.city AS "City", st.region AS "Region", fu.name AS "Fuel",
         px.price AS "Price", strftime(s."timestamp", '%Y-%m-%d %H:%M') AS "Snapshot",
         px.station_id
  FROM px JOIN st ON st.id = px.station_id JOIN fu ON fu.id = px.fuel_id
  JOIN snaps s ON s.id = px.snapshot_id
  WHERE px.snapshot_id IN (SELECT id FROM chosen))
"""

# exact DECIMAL average rounded HALF_UP to 6 places, as a double (Spark's avg of
# DECIMAL(10,2) is DECIMAL(14,6)); integer arithmetic keeps it bit-identical
AVG6 = ("CAST((sum(CAST(round({v} * 100) AS BIGINT)) * 20000 + count(*)) // (2 * count(*))"
        " AS DOUBLE) / 1000000.0")


def _records(spark, sf_dir, station_id=None, mode="month"):
    snaps, prices = model.snapshots_o(spark, sf_dir), model.prices_o(spark, sf_dir)
    stations, fuels = model.stations_o(spark, sf_dir), model.fuels_o(spark, sf_dir)
    if station_id is None:
        sel = sn.select_snapshots(snaps, DATASET, mode, start=RANGE[0], end=RANGE[1],
                                  max_snapshots=MAX_SNAPSHOTS)
    else:
        sel = sn.select_snapshots(snaps, DATASET, "latest", max_snapshots=MAX_SNAPSHOTS)
    return sn.price_extract(sel, prices, stations, fuels, snaps, station_id=station_id,
                            price_as_double=False, ordered=False)


def _long_sql(rows, cols, src="recs", where=""):
    keys = ", ".join(f'"{c}"' for c in rows + cols)
    sets = []
    for s in (rows + cols, rows, cols, []):
        t = "(" + ", ".join(f'"{c}"' for c in s) + ")"
        if t not in sets:
            sets.append(t)
    tr = f'grouping("{rows[0]}") = 1' if rows else "true"
    tc = f'grouping("{cols[0]}") = 1' if cols else "true"
    return f"""
SELECT {keys}, {AVG6.format(v='"Price"')} AS value, {tr} AS is_total_row, {tc} AS is_total_col
FROM {src} {where} GROUP BY GROUPING SETS ({", ".join(sets)})
"""


@query("pivot_region_snapshot_fuel", ids="AGG-11 AGG-13 OP-09",
       sql=RECS_SQL + _long_sql(["Snapshot", "Region"], ["Fuel"]))
def pivot_region_snapshot_fuel(spark, sf_dir):
    return pv.pivot_long(_records(spark, sf_dir), ["Snapshot", "Region"], ["Fuel"])


@query("pivot_station", ids="AGG-12 AGG-13",
       sql=O_CTE.rstrip() + """
, chosen AS (SELECT id FROM base ORDER BY "timestamp" DESC, id DESC LIMIT 100),
recs AS (
  SELECT fu.name AS "Fuel", px.price AS "Price",
         strftime(s."timestamp", '%Y-%m-%d %H:%M') AS "Snapshot"
  FROM px JOIN st ON st.id = px.station_id JOIN fu ON fu.id = px.fuel_id
  JOIN snaps s ON s.id = px.snapshot_id
  WHERE px.snapshot_id IN (SELECT id FROM chosen) AND px.station_id = 3)
""" + _long_sql(["Snapshot"], ["Fuel"]))
def pivot_station(spark, sf_dir):
    return pv.pivot_long(_records(spark, sf_dir, station_id=3), ["Snapshot"], ["Fuel"])


@query("pivot_two_col_axes", ids="AGG-13 (two column axes, two row axes)",
       sql=RECS_SQL + _long_sql(["City", "Station"], ["Region", "Fuel"]))
def pivot_two_col_axes(spark, sf_dir):
    return pv.pivot_long(_records(spark, sf_dir), ["City", "Station"], ["Region", "Fuel"])


@query("pivot_no_col_axis", ids="AGG-13 (rows only, totals column)",
       sql=RECS_SQL + _long_sql(["Station", "City"], []))
def pivot_no_col_axis(spark, sf_dir):
    return pv.pivot_long(_records(spark, sf_dir), ["Station", "City"], [])


@query("pivot_filtered", ids="FLT-12 (exclude values of an attribute)",
       sql=RECS_SQL + _long_sql(["Region"], ["Fuel"],
                                where="WHERE \"Fuel\" NOT IN ('PROMO', 'SMALL')"))
def pivot_filtered(spark, sf_dir):
    return pv.pivot_long(_records(spark, sf_dir), ["Region"], ["Fuel"],
                         exclude={"Fuel": ["PROMO", "SMALL"]})


@query("pivot_aggregators", ids="AGG-14", sql=RECS_SQL + f"""
SELECT "Region", "Fuel", count(*) AS n, CAST(sum("Price") AS DOUBLE) AS total,
       {AVG6.format(v='"Price"')} AS mean,
       round(median(CAST("Price" AS DOUBLE)), 4) AS med,
       round(var_samp(CAST("Price" AS DOUBLE)), 2) AS var,
       round(stddev_samp(CAST("Price" AS DOUBLE)), 4) AS sd,
       CAST(min("Price") AS DOUBLE) AS lo, CAST(max("Price") AS DOUBLE) AS hi,
       grouping("Region") = 1 AS is_total_row, grouping("Fuel") = 1 AS is_total_col
FROM recs GROUP BY GROUPING SETS (("Region", "Fuel"), ("Region"), ("Fuel"), ())
""")
def pivot_aggregators(spark, sf_dir):
    recs = _records(spark, sf_dir).withColumn("PriceD", F.col("Price").cast("double"))
    long = pv.pivot_long(recs, ["Region"], ["Fuel"], "Price",
                         {"n": "count", "total": "sum", "mean": "avg",
                          "med": ("median", "PriceD"), "var": ("var_samp", "PriceD"),
                          "sd": ("stddev_samp", "PriceD"), "lo": "min", "hi": "max"})
    # spread statistics are double sums whose last bits depend on the order of
    # addition: report them at a precision both engines agree on
    digits = {"med": 4, "var": 2, "sd": 4}
    return long.select(*[F.round(c, digits[c]).alias(c) if c in digits else c
                         for c in long.columns])


_FUELS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _csv_sql() -> str:
    header = "\ufeff" + ",".join(f'"{h}"' for h in ("Region",) + _FUELS + ("Totals",))
    cells = ",\n  ".join(
        f"""max(CASE WHEN gf = 0 AND "Fuel" = '{f}' THEN v END) AS "{f}\"""" for f in _FUELS)
    fmt = " || ',' || ".join(
        f"""'"' || coalesce(format('{{:,.2f}}', "{f}"), '') || '"'""" for f in _FUELS + ("Totals",))
    return RECS_SQL + f"""
, cube AS (
  SELECT "Region", "Fuel", {AVG6.format(v='"Price"')} AS v,
         grouping("Region") AS gr, grouping("Fuel") AS gf
  FROM recs GROUP BY GROUPING SETS (("Region", "Fuel"), ("Region"), ("Fuel"), ())),
wide AS (
  SELECT gr, "Region",
  {cells},
  max(CASE WHEN gf = 1 THEN v END) AS "Totals"
  FROM cube GROUP BY gr, "Region")
SELECT 0 AS section, CAST(NULL AS DOUBLE) AS sort_value, '' AS sort_key, '{header}' AS line
UNION ALL
SELECT CASE WHEN gr = 1 THEN 2 ELSE 1 END, CAST(NULL AS DOUBLE), coalesce("Region", ''),
       '"' || replace(CASE WHEN gr = 1 THEN 'Totals' ELSE coalesce("Region", '') END, '"', '""')
       || '",' || {fmt}
FROM wide
"""


@query("pivot_csv_lines", ids="SNK-03 SCL-08 TOP-10", sql=_csv_sql())
def pivot_csv_lines(spark, sf_dir):
    labels = distinct_values(model.fuels_o(spark, sf_dir), "name")
    return pv.pivot_csv_lines(_records(spark, sf_dir), ["Region"], ["Fuel"], keys=[(x,) for x in labels])


@query("pivot_label_collision", ids="OP-09 SNK-03 (column tuples with one label, blank levels, a value named like the totals)",
       sql=RECS_SQL + """
, tagged AS (
  SELECT "Region", "Price",
         CASE "Fuel" WHEN 'ECONOMY' THEN 'a - b' WHEN 'LARGE' THEN 'a' WHEN 'MEDIUM' THEN '' WHEN 'PROMO' THEN NULL ELSE 'Totals' END AS one,
         CASE "Fuel" WHEN 'ECONOMY' THEN 'c' WHEN 'LARGE' THEN 'b - c' ELSE 'x' END AS two
  FROM recs)
SELECT "Region",
       count(*) FILTER (one = '' AND two = 'x') AS blank, count(*) FILTER (one = 'Totals') AS named_totals,
       count(*) FILTER (one = 'a' AND two = 'b - c') AS left_pair, count(*) FILTER (one = 'a - b' AND two = 'c') AS right_pair,
       count(*) FILTER (one IS NULL) AS missing, count(*) AS total
FROM tagged GROUP BY "Region"
""")
def pivot_label_collision(spark, sf_dir):
    fuel = F.col("Fuel")
    recs = _records(spark, sf_dir).select(
        "Region", "Price",
        F.when(fuel == "ECONOMY", "a - b").when(fuel == "LARGE", "a").when(fuel == "MEDIUM", "")
        .when(fuel == "PROMO", F.lit(None)).otherwise("Totals").alias("one"),
        F.when(fuel == "ECONOMY", "c").when(fuel == "LARGE", "b - c").otherwise("x").alias("two"))
    wide, labels = pv.pivot_table(recs, ["Region"], ["one", "two"], "Price", "count")
    assert labels == [" - x", "Totals - x", "a - b - c", "a - b - c", " - x"]
    names = ["blank", "named_totals", "left_pair", "right_pair", "missing"]
    return wide.where(~F.col("is_total_row")).select("Region", *[
        F.coalesce(f"c{i}", F.lit(0)).alias(n) for i, n in enumerate(names)], "total")


@query("pivot_by_total", ids="TOP-10 (rows in order of their total)", sql=RECS_SQL + """
SELECT "City", sum("Price")::DOUBLE AS total, sum("Price")::DOUBLE AS sort_value FROM recs GROUP BY "City"
""")
def pivot_by_total(spark, sf_dir):
    """The CSV lines with the value that orders them; a city's total is read back from its line."""
    lines = pv.pivot_csv_lines(_records(spark, sf_dir), ["City"], [], agg="sum", order_by_totals=True)
    total = F.regexp_replace(F.regexp_extract("line", r'"([^"]*)"$', 1), ",", "").cast("double")
    return lines.where("section = 1").select(
        F.col("sort_key").alias("City"), total.alias("total"), "sort_value")


@query("pivot_menu_rest", ids="AGG-14 (count_distinct, first, last)", sql=RECS_SQL + """
SELECT "Region", count(DISTINCT "Price") AS kinds, min("Price")::DOUBLE AS first, max("Price")::DOUBLE AS last,
       grouping("Region") = 1 AS is_total_row, true AS is_total_col
FROM recs GROUP BY ROLLUP ("Region")
""")
def pivot_menu_rest(spark, sf_dir):
    return pv.pivot_long(_records(spark, sf_dir), ["Region"], [], "Price",
                         {"kinds": "count_distinct", "first": "first", "last": "last"})


@query("pivot_median", ids="AGG-14 (exact median of all prices, cells and totals)", sql=O_CTE + """
SELECT st.region AS "Region", fu.name AS "Fuel", CAST(median(CAST(px.price AS DOUBLE)) AS DOUBLE) AS med, count(*) AS n,
       grouping(st.region) = 1 AS is_total_row, grouping(fu.name) = 1 AS is_total_col
FROM px JOIN st ON st.id = px.station_id JOIN fu ON fu.id = px.fuel_id
GROUP BY GROUPING SETS ((st.region, fu.name), (st.region), (fu.name), ())
""")
def pivot_median(spark, sf_dir):
    st = model.stations_o(spark, sf_dir).select("id", "region")
    fu = model.fuels_o(spark, sf_dir).select("id", "name")
    px = model.prices_o(spark, sf_dir)
    # the rows are shuffled while they are narrow
    recs = px.join(fu, px["fuel_id"] == fu["id"]).select("station_id", F.col("name").alias("Fuel"), F.col("price").alias("Price"))
    recs = recs.join(broadcast_few(st), recs["station_id"] == st["id"]).select(F.col("region").alias("Region"), "Fuel", "Price")
    return pv.pivot_long(recs, ["Region"], ["Fuel"], "Price", {"med": "median", "n": "count"})


@query("pivot_shares", ids="AGG-14 (shares of row, column and grand totals)", sql=RECS_SQL + """
, long AS (
  SELECT "Region", "Fuel", CAST(sum("Price") AS DOUBLE) AS value,
         grouping("Region") = 1 AS is_total_row, grouping("Fuel") = 1 AS is_total_col
  FROM recs GROUP BY GROUPING SETS (("Region", "Fuel"), ("Region"), ("Fuel"), ()))
SELECT l.*, l.value / r.value AS of_row, l.value / c.value AS of_col, l.value / g.value AS of_total
FROM long l
JOIN long r ON r.is_total_col AND r.is_total_row = l.is_total_row AND r."Region" IS NOT DISTINCT FROM l."Region"
JOIN long c ON c.is_total_row AND c.is_total_col = l.is_total_col AND c."Fuel" IS NOT DISTINCT FROM l."Fuel"
JOIN long g ON g.is_total_row AND g.is_total_col
""")
def pivot_shares(spark, sf_dir):
    return pv.pivot_shares(_records(spark, sf_dir), ["Region"], ["Fuel"])
