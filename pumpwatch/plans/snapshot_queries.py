"""Registered queries over the V2 snapshot model (binding O: orders + lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pumpwatch import model
from pumpwatch.operators import counts as ct
from pumpwatch.operators import snapshots as sn
from pumpwatch.operators.selection import rows_between
from pumpwatch.plans.registry import query
from pumpwatch.sources.tables import read_table

# the active dataset of binding O and the page size of its registry entry
DATASET = "1-URGENT"
MAX_SNAPSHOTS = 100

# DuckDB side of binding O, shared by the oracles below
O_CTE = """
WITH snaps AS (
  SELECT o_orderkey AS id, o_orderdate AS "timestamp",
         CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'processing'
                            WHEN 'P' THEN 'error' END AS status,
         o_orderpriority AS dataset
  FROM orders),
px AS (
  SELECT l_orderkey AS snapshot_id, l_suppkey AS station_id, l_partkey AS fuel_id,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS price
  FROM lineitem),
fu AS (SELECT p_partkey AS id, p_type AS name FROM part),
st AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS city, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
base AS (SELECT * FROM snaps WHERE status = 'processed' AND dataset = '1-URGENT')
"""


def _o(spark, sf_dir):
    return (model.snapshots_o(spark, sf_dir), model.prices_o(spark, sf_dir),
            model.stations_o(spark, sf_dir), model.fuels_o(spark, sf_dir))


def _paged(rows_sql: str, order: str, page: int, size: int) -> str:
    """Page ``page`` of ``rows_sql`` with the page number clamped to [1, pages]."""
    return f"""
, numbered AS (
  SELECT r.*, row_number() OVER (ORDER BY {order}) AS rn, count(*) OVER () AS total
  FROM ({rows_sql}) r),
clamped AS (
  SELECT *, greatest(1, least({page}, CAST(ceil(total / {size}.0) AS BIGINT))) AS pg
  FROM numbered)
SELECT id, period FROM clamped WHERE rn > (pg - 1) * {size} AND rn <= pg * {size}
"""


@query("snapshots_latest_page", ids="OP-07 latest FLT-01 FLT-02 TOP-05",
       sql=O_CTE + _paged('SELECT id, "timestamp" AS period FROM base', "period DESC, id DESC",
                          2, MAX_SNAPSHOTS))
def snapshots_latest_page(spark, sf_dir):
    snaps = model.snapshots_o(spark, sf_dir)
    return sn.select_snapshots(snaps, DATASET, "latest", page=2,
                               max_snapshots=MAX_SNAPSHOTS).snapshots


@query("snapshots_page_clamped", ids="OP-07 TOP-05 (page beyond the last)",
       sql=O_CTE + _paged('SELECT id, "timestamp" AS period FROM base', "period DESC, id DESC",
                          999, MAX_SNAPSHOTS))
def snapshots_page_clamped(spark, sf_dir):
    snaps = model.snapshots_o(spark, sf_dir)
    return sn.select_snapshots(snaps, DATASET, "latest", page=999,
                               max_snapshots=MAX_SNAPSHOTS).snapshots


@query("snapshot_paging", ids="TOP-05 SCL-10 (per dataset: total, pages, clamped page)",
       sql=O_CTE + """
, t AS (SELECT dataset, count(*) AS total FROM snaps WHERE status = 'processed' GROUP BY 1),
p AS (SELECT dataset, total, greatest(CAST(ceil(total / 100.0) AS BIGINT), 1) AS total_pages FROM t)
SELECT dataset, total, total_pages, least(greatest(12, 1), total_pages) AS page,
       (least(greatest(12, 1), total_pages) - 1) * 100 AS "offset"
FROM p
""")
def snapshot_paging(spark, sf_dir):
    return sn.paging_facts(model.snapshots_o(spark, sf_dir), model.datasets_o(spark, sf_dir), 12)


@query("snapshots_lookahead_page", ids="TOP-06 TOP-08", sql=O_CTE + """
, numbered AS (
  SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, id DESC) AS rn
  FROM snaps WHERE dataset = '1-URGENT')
SELECT id, "timestamp", status, dataset,
       (SELECT count(*) FROM numbered WHERE rn > 100 AND rn <= 151) > 50 AS has_next
FROM numbered WHERE rn > 100 AND rn <= 150
""")
def snapshots_lookahead_page(spark, sf_dir):
    return sn.lookahead_page(model.snapshots_o(spark, sf_dir), DATASET, page=3, size=50)


@query("latest_five", ids="TOP-04", sql=O_CTE + """
SELECT id, "timestamp", status, dataset FROM snaps WHERE dataset = '1-URGENT'
ORDER BY "timestamp" DESC, id DESC LIMIT 5
""")
def latest_five(spark, sf_dir):
    return sn.latest_snapshots(model.snapshots_o(spark, sf_dir), DATASET, 5)


def _events_as_snapshots(spark, sf_dir):
    """Sub-day buckets need sub-day timestamps: events as snapshots (id=event_id)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"), model.as_utc_ts(F.col("ts")).alias("timestamp"),
                     F.lit(model.STATUS_PROCESSED).alias("status"),
                     F.lit(DATASET).alias("dataset"))


_EV_CTE = """
WITH base AS (SELECT event_id AS id, ts AS "timestamp" FROM events)
"""


def _bucket_sql(cte: str, unit: str, page: int = 1, where: str = "") -> str:
    rows = (f"SELECT date_trunc('{unit}', \"timestamp\") AS period, max(id) AS id "
            f"FROM base {where} GROUP BY 1")
    return cte + _paged(rows, "period DESC", page, MAX_SNAPSHOTS)


for _unit in ("minute", "hour"):
    def _make(unit):
        def build(spark, sf_dir):
            return sn.select_snapshots(_events_as_snapshots(spark, sf_dir), DATASET, unit,
                                       page=2, max_snapshots=MAX_SNAPSHOTS).snapshots
        build.__name__ = f"snapshots_per_{unit}"
        return build
    query(f"snapshots_per_{_unit}", ids="OP-07 AGG-08 SCL-13 (events as snapshots)",
          sql=_bucket_sql(_EV_CTE, _unit, page=2))(_make(_unit))

for _unit in ("day", "week", "month", "year"):
    def _make(unit):
        def build(spark, sf_dir):
            return sn.select_snapshots(model.snapshots_o(spark, sf_dir), DATASET, unit,
                                       page=1, max_snapshots=MAX_SNAPSHOTS).snapshots
        build.__name__ = f"snapshots_per_{unit}"
        return build
    query(f"snapshots_per_{_unit}", ids="OP-07 AGG-08 SCL-13",
          sql=_bucket_sql(O_CTE, _unit))(_make(_unit))


@query("snapshots_until", ids="OP-07 until FLT-04",
       sql=_bucket_sql(O_CTE, "month", where="WHERE \"timestamp\" <= TIMESTAMP '1998-06-30 12:00:00'"))
def snapshots_until(spark, sf_dir):
    return sn.select_snapshots(model.snapshots_o(spark, sf_dir), DATASET, "month",
                               until="1998-06-30 12:00:00", max_snapshots=MAX_SNAPSHOTS).snapshots


_RANGE_SQL = """
, b AS (
  SELECT date_trunc('{unit}', "timestamp") AS period, max(id) AS id FROM base
  WHERE "timestamp" BETWEEN TIMESTAMP '{start}' AND TIMESTAMP '{end}' GROUP BY 1)
SELECT id, period FROM b WHERE (SELECT count(*) FROM b) <= 100
"""


@query("snapshots_range", ids="OP-07 range FLT-03",
       sql=O_CTE + _RANGE_SQL.format(unit="week", start="1996-01-01 00:00:00",
                                     end="1997-06-30 00:00:00"))
def snapshots_range(spark, sf_dir):
    return sn.select_snapshots(model.snapshots_o(spark, sf_dir), DATASET, "week",
                               start="1996-01-01 00:00:00", end="1997-06-30 00:00:00",
                               max_snapshots=MAX_SNAPSHOTS).snapshots


@query("snapshots_range_too_many", ids="OP-07 TOP-09",
       sql=O_CTE + _RANGE_SQL.format(unit="day", start="1995-01-01 00:00:00",
                                     end="1999-12-31 00:00:00"))
def snapshots_range_too_many(spark, sf_dir):
    return sn.select_snapshots(model.snapshots_o(spark, sf_dir), DATASET, "day",
                               start="1995-01-01 00:00:00", end="1999-12-31 00:00:00",
                               max_snapshots=MAX_SNAPSHOTS).snapshots


_STAR_SQL = """
, chosen AS ({chosen})
SELECT st.name AS "Station", st.city AS "City", st.region AS "Region", fu.name AS "Fuel",
       CAST(px.price AS DOUBLE) AS "Price", strftime(s."timestamp", '%Y-%m-%d %H:%M') AS "Snapshot"
FROM px JOIN st ON st.id = px.station_id JOIN fu ON fu.id = px.fuel_id
JOIN snaps s ON s.id = px.snapshot_id
WHERE px.snapshot_id IN (SELECT id FROM chosen) {extra}
"""


@query("price_extract", ids="OP-08 FLT-05 JOIN-06 PRJ-02 PRJ-03 TOP-07",
       sql=O_CTE + _STAR_SQL.format(chosen="""
  SELECT max(id) AS id FROM base
  WHERE "timestamp" BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'
  GROUP BY date_trunc('month', "timestamp")""", extra=""))
def price_extract(spark, sf_dir):
    snaps, prices, stations, fuels = _o(spark, sf_dir)
    sel = sn.select_snapshots(snaps, DATASET, "month", start="1997-01-01 00:00:00",
                              end="1997-12-31 00:00:00", max_snapshots=MAX_SNAPSHOTS)
    return sn.price_extract(sel, prices, stations, fuels, snaps)


@query("station_price_extract", ids="OP-08 (one station)",
       sql=O_CTE + _STAR_SQL.format(chosen="""
  SELECT id FROM base ORDER BY "timestamp" DESC, id DESC LIMIT 100""",
                                    extra="AND px.station_id = 7"))
def station_price_extract(spark, sf_dir):
    snaps, prices, stations, fuels = _o(spark, sf_dir)
    sel = sn.select_snapshots(snaps, DATASET, "latest", max_snapshots=MAX_SNAPSHOTS)
    return sn.price_extract(sel, prices, stations, fuels, snaps, station_id=7)


@query("prices_of_snapshot", ids="JOIN-06 (snapshot detail)",
       sql=O_CTE + _STAR_SQL.format(chosen="SELECT 7 AS id", extra=""))
def prices_of_snapshot(spark, sf_dir):
    snaps, prices, stations, fuels = _o(spark, sf_dir)
    return sn.prices_of_snapshot(prices, stations, fuels, snaps, 7)


@query("snapshot_price_counts", ids="JOIN-08 AGG-17", sql=O_CTE + """
SELECT s.id, s."timestamp", s.status, s.dataset,
       CAST((SELECT count(*) FROM px WHERE px.snapshot_id = s.id) AS BIGINT) AS price_count
FROM snaps s
""")
def snapshot_price_counts(spark, sf_dir):
    snaps, prices, _, _ = _o(spark, sf_dir)
    return ct.with_price_counts(snaps, prices)


@query("dataset_price_total", ids="AGG-09", sql=O_CTE + """
, counted AS (SELECT s.dataset, (SELECT count(*) FROM px WHERE px.snapshot_id = s.id) AS c FROM snaps s)
SELECT dataset, CAST(coalesce(sum(c), 0) AS BIGINT) AS price_total FROM counted GROUP BY dataset
""")
def dataset_price_total(spark, sf_dir):
    snaps, prices, _, _ = _o(spark, sf_dir)
    return ct.dataset_price_total(ct.with_price_counts(snaps, prices))


@query("fuels_used", ids="JOIN-07 AGG-10 SRC-06", sql=O_CTE + """
SELECT DISTINCT name FROM fu
WHERE id IN (SELECT fuel_id FROM px WHERE snapshot_id IN
             (SELECT id FROM snaps WHERE dataset = '1-URGENT'))
""")
def fuels_used(spark, sf_dir):
    snaps, prices, _, fuels = _o(spark, sf_dir)
    return ct.fuels_used(prices, fuels, snaps, DATASET)


@query("home_kpis", ids="AGG-01 FLT-10", sql=O_CTE + """
, act AS (SELECT s.* FROM snaps s WHERE s.dataset = '1-URGENT')
SELECT (SELECT count(*) FROM supplier WHERE s_nationkey % 5 = 0) AS station_count,
       (SELECT count(*) FROM act) AS snapshot_count,
       CAST((SELECT count(*) FROM px WHERE snapshot_id IN (SELECT id FROM act)) AS BIGINT)
         AS price_count
""")
def home_kpis(spark, sf_dir):
    snaps, prices, _, _ = _o(spark, sf_dir)
    reg = model.datasets_o(spark, sf_dir)
    return ct.home_kpis(reg, ct.with_price_counts(snaps, prices), model.owned_stations_o(spark, sf_dir))


@query("active_dataset_snapshots", ids="FLT-10 UPS-04", sql=O_CTE + """
SELECT id, "timestamp", status, dataset FROM snaps WHERE dataset = '2-HIGH'
""")
def active_dataset_snapshots(spark, sf_dir):
    reg = ct.activate(model.datasets_o(spark, sf_dir), 2)
    return ct.active_dataset_snapshots(reg, model.snapshots_o(spark, sf_dir))


@query("prices_far_page", ids="TOP-05 TOP-06 (fifty prices from the middle of all, sought by counts)", sql="""
WITH numbered AS (
  SELECT l_orderkey AS snapshot_id, l_linenumber AS line, l_shipdate AS shipped,
         CAST(CAST(l_extendedprice AS DECIMAL(10,2)) AS DOUBLE) AS price, count(*) OVER () AS total,
         row_number() OVER (ORDER BY l_shipdate DESC NULLS LAST, l_orderkey DESC NULLS LAST, l_linenumber NULLS LAST) - 1 AS rn
  FROM lineitem)
SELECT snapshot_id, line, shipped, price FROM numbered WHERE rn >= total // 2 AND rn < total // 2 + 50
""")
def prices_far_page(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"), F.col("l_linenumber").alias("line"),
        model.as_utc_ts(F.col("l_shipdate")).alias("shipped"), model.as_price(F.col("l_extendedprice")).alias("price"))
    total = rows.count()
    return rows_between(rows, [("shipped", True), ("snapshot_id", True), ("line", False)],
                        total // 2, total // 2 + 50, total)
