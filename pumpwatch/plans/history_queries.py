"""Registered queries over the V1 price history (binding E: events + customers)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwatch import model
from pumpwatch.operators import observations as ob
from pumpwatch.plans.registry import query
from pumpwatch.sources.statistics import footer_range, newest_periods
from pumpwatch.sources.tables import SCHEMAS, table_path

# DuckDB side of binding E, shared by the oracles below
E_CTE = """
WITH st AS (
  SELECT c.c_custkey AS id, c.c_name AS name, n.n_name AS city, r.r_name AS region
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey),
obs_raw AS (
  SELECT user_id AS station_id, event_type AS fuel_type,
         date_trunc('day', ts) AS fetched_at, CAST(value AS DECIMAL(10,2)) AS price, event_id
  FROM events),
obs AS (
  SELECT station_id, fuel_type, fetched_at, max_by(price, event_id) AS price
  FROM obs_raw GROUP BY station_id, fuel_type, fetched_at)
"""


def _e(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return model.obs(spark, sf_dir), model.stations_e(spark, sf_dir)


def _newest(spark: SparkSession, sf_dir: str, n: int) -> list:
    """The newest snapshot days, so that the facts are read for these days only.

    Footers tell where they are; no job reads the time column of older row groups.
    """
    day = timedelta(days=1)
    return newest_periods(lambda since: ob.newest_times(model.obs_raw(spark, sf_dir, since=since), n),
                          footer_range(spark, table_path(sf_dir, "events"), "ts", SCHEMAS["events"]),
                          lambda t: t.replace(hour=0, minute=0, second=0, microsecond=0), day, n)


@query("latest_prices", ids="OP-06 FLT-07 JOIN-01 TOP-01 SRC-05 PRJ-03", sql=E_CTE + """
SELECT s.name, s.city, s.region, p.fuel_type, CAST(p.price AS DOUBLE) AS price
FROM obs p JOIN st s ON s.id = p.station_id
WHERE p.fetched_at = (SELECT max(fetched_at) FROM obs)
ORDER BY p.price, s.name, p.fuel_type LIMIT 20
""")
def latest_prices(spark, sf_dir):
    days = _newest(spark, sf_dir, 1)
    return ob.latest_prices(model.obs(spark, sf_dir, days), model.stations_e(spark, sf_dir), 20,
                            at=F.lit(days[0] if days else None).cast("timestamp"))


@query("dataset_summary", ids="OP-01 AGG-01 AGG-02 AGG-03", sql=E_CTE + """
SELECT (SELECT count(*) FROM st) AS stations, count(*) AS prices,
       count(DISTINCT fetched_at) AS snapshots,
       min(fetched_at) AS first_snapshot, max(fetched_at) AS last_snapshot
FROM obs_raw
""")
def dataset_summary(spark, sf_dir):
    return ob.summary(model.obs_raw(spark, sf_dir), model.stations_e(spark, sf_dir))


@query("stations_per_region", ids="AGG-04", sql=E_CTE + """
SELECT region, count(*) AS stations FROM st GROUP BY region
""")
def stations_per_region(spark, sf_dir):
    return ob.stations_per_region(model.stations_e(spark, sf_dir))


# a price is current if no price of the same key is newer
_AVG_SQL = """
SELECT coalesce(nullif(s.region, ''), 'N/A') AS region, h.fuel_type,
       round(avg(h.price), 1) AS avg_price
FROM {src} h JOIN st s ON s.id = h.station_id
WHERE NOT EXISTS (SELECT 1 FROM {src} newer
                  WHERE newer.station_id = h.station_id AND newer.fuel_type = h.fuel_type
                    AND newer.fetched_at > h.fetched_at)
GROUP BY ALL
"""


@query("region_fuel_avg_latest", ids="JOIN-02 WIN-05 AGG-05",
       sql=E_CTE + _AVG_SQL.format(src="obs"))
def region_fuel_avg_latest(spark, sf_dir):
    prices, stations = _e(spark, sf_dir)
    return ob.region_fuel_avg(prices, stations)


@query("region_fuel_avg_latest_raw", ids="JOIN-02 WIN-05 AGG-05 (ties kept)",
       sql=E_CTE + _AVG_SQL.format(src="obs_raw"))
def region_fuel_avg_latest_raw(spark, sf_dir):
    return ob.region_fuel_avg(model.obs_raw(spark, sf_dir), model.stations_e(spark, sf_dir))


@query("region_report", ids="OP-05 AGG-04 AGG-05 JOIN-10", sql=E_CTE + ", averages AS (" + _AVG_SQL.format(src="obs") + """),
labelled AS (SELECT coalesce(nullif(region, ''), 'N/A') AS region FROM st)
SELECT region, (SELECT count(*) FROM labelled l WHERE l.region = r.region) AS stations,
       any_value(avg_price) FILTER (fuel_type = 'click') AS click,
       any_value(avg_price) FILTER (fuel_type = 'error') AS error,
       any_value(avg_price) FILTER (fuel_type = 'purchase') AS purchase,
       any_value(avg_price) FILTER (fuel_type = 'signup') AS signup,
       any_value(avg_price) FILTER (fuel_type = 'view') AS view
FROM (SELECT DISTINCT region FROM labelled) r LEFT JOIN averages USING (region)
GROUP BY region
""")
def region_report(spark, sf_dir):
    prices, stations = _e(spark, sf_dir)
    return ob.region_report(prices, stations)


@query("region_fuel_map", ids="SCL-18", sql=E_CTE + ", averages AS (" + _AVG_SQL.format(src="obs") + """)
SELECT region,
       map_from_entries(list(struct_pack(k := fuel_type, v := avg_price) ORDER BY fuel_type))
         AS avg_by_fuel
FROM averages GROUP BY region
""")
def region_fuel_map(spark, sf_dir):
    prices, stations = _e(spark, sf_dir)
    return ob.region_fuel_map(prices, stations)


@query("snapshot_counts", ids="AGG-06 TOP-03", sql=E_CTE + """
SELECT fetched_at, count(*) AS records FROM obs_raw GROUP BY 1 ORDER BY 1 DESC LIMIT 11
""")
def snapshot_counts(spark, sf_dir):
    return ob.snapshot_counts(model.obs_raw(spark, sf_dir), 11)


# per key and snapshot: the list of its prices; two neighbouring snapshots are
# compared list against list, a missing list being empty
_CHANGES_SQL = """
, lists AS (
  SELECT fetched_at, station_id, fuel_type, list(price) AS prices
  FROM {src} GROUP BY ALL),
numbered AS (
  SELECT fetched_at, sum(len(prices)) AS records, dense_rank() OVER (ORDER BY fetched_at DESC) AS age
  FROM lists GROUP BY fetched_at),
side AS (
  SELECT n.age, l.* FROM lists l JOIN numbered n USING (fetched_at) WHERE n.age <= 11),
compared AS (
  SELECT coalesce(a.age, b.age - 1) AS age, coalesce(len(a.prices), 0) AS n, coalesce(len(b.prices), 0) AS m,
         len(list_filter(flatten(list_transform(a.prices, lambda x: list_transform(b.prices, lambda y: x <> y))), lambda e: e))
           AS different
  FROM (SELECT * FROM side WHERE age <= 10) a
  FULL JOIN (SELECT * FROM side WHERE age >= 2) b
    ON b.age = a.age + 1 AND b.station_id = a.station_id AND b.fuel_type = a.fuel_type)
SELECT s.fetched_at, s.records::BIGINT AS records,
       CASE WHEN EXISTS (SELECT 1 FROM numbered o WHERE o.age = s.age + 1)
            THEN (SELECT coalesce(sum(CASE WHEN m = 0 THEN n WHEN n = 0 THEN m ELSE different END), 0)::BIGINT
                  FROM compared c WHERE c.age = s.age) END AS changes
FROM numbered s WHERE s.age <= 10
"""


@query("snapshot_changes", ids="OP-02 WIN-04 JOIN-03 JOIN-04 AGG-07 SCL-16",
       sql=E_CTE + _CHANGES_SQL.format(src="obs"))
def snapshot_changes(spark, sf_dir):
    return ob.snapshot_changes(model.obs(spark, sf_dir, _newest(spark, sf_dir, 11)), 10)


@query("snapshot_changes_dups", ids="OP-02 on duplicated rows (n×m fan-out counted)",
       sql=E_CTE + _CHANGES_SQL.format(src="obs_raw"))
def snapshot_changes_dups(spark, sf_dir):
    return ob.snapshot_changes(model.obs_raw(spark, sf_dir, days=_newest(spark, sf_dir, 11)), 10)


# each row against the newest earlier row of its key; the newest row that differs is the move
MOVES_SQL = """
, history AS (SELECT station_id, fuel_type, fetched_at, price, row(fetched_at, {tie}) AS place FROM {src}),
steps AS (
  SELECT a.station_id, a.fuel_type, a.place, a.fetched_at, a.price,
         arg_max(b.price, b.place) AS old, arg_max(b.fetched_at, b.place) AS old_at
  FROM history a JOIN history b ON a.station_id = b.station_id AND a.fuel_type = b.fuel_type AND b.place < a.place
  GROUP BY ALL),
moves AS (
  SELECT station_id, fuel_type, max_by(struct_pack(fetched_at, price, old, old_at), place) AS m
  FROM steps WHERE price <> old GROUP BY ALL),
report AS (
  SELECT station_id, s.name AS station_name, s.city, fuel_type,
         m.old_at AS prev_fetched_at, m.fetched_at AS fetched_at,
         round(m.old, 1)::DOUBLE AS prev_price, round(m.price, 1)::DOUBLE AS price,
         round(m.price - m.old, 1)::DOUBLE AS delta
  FROM moves JOIN st s ON s.id = station_id)
"""
_MOVES = E_CTE + MOVES_SQL.format(src="obs", tie="price")


@query("price_variations", ids="OP-03 WIN-01 WIN-02 WIN-03 PRJ-04 FLT-09 SCL-09 SCL-16",
       sql=_MOVES + "SELECT * FROM report")
def price_variations(spark, sf_dir):
    return ob.price_moves(*_e(spark, sf_dir))


@query("price_variations_raw", ids="OP-03 WIN-01 WIN-02 WIN-03 (several rows of a key in a snapshot)",
       sql=E_CTE + MOVES_SQL.format(src="obs_raw", tie="event_id") + "SELECT * FROM report")
def price_variations_raw(spark, sf_dir):
    return ob.price_moves(model.obs_raw(spark, sf_dir, with_event_id=True),
                          model.stations_e(spark, sf_dir), tie="event_id")


@query("top_rises", ids="OP-03 TOP-02", sql=_MOVES + """
SELECT * FROM report WHERE delta > 0 ORDER BY delta DESC, station_name, fuel_type LIMIT 10
""")
def top_rises(spark, sf_dir):
    return ob.top_rises(ob.price_moves(*_e(spark, sf_dir)), 10)


@query("top_drops", ids="OP-03 TOP-02", sql=_MOVES + """
SELECT * FROM report WHERE delta < 0 ORDER BY delta, station_name, fuel_type LIMIT 10
""")
def top_drops(spark, sf_dir):
    return ob.top_drops(ob.price_moves(*_e(spark, sf_dir)), 10)


# rows of the two newest days side by side, told apart by their rank
_TWO_DAYS = """
, ranked AS (SELECT *, dense_rank() OVER (ORDER BY fetched_at DESC) AS age FROM {src})
"""
_CHANGED_SQL = _TWO_DAYS + """
SELECT coalesce(sum(cast(b.price <> a.price AS BIGINT)), 0)::BIGINT AS changed
FROM ranked a, ranked b
WHERE a.age = 1 AND b.age = 2 AND a.station_id = b.station_id AND a.fuel_type = b.fuel_type
"""


@query("changed_since_previous", ids="OP-04 FLT-07 FLT-08 JOIN-05", sql=E_CTE + _CHANGED_SQL.format(src="obs"))
def changed_since_previous(spark, sf_dir):
    days = _newest(spark, sf_dir, 2)
    return ob.changed_since_previous(model.obs(spark, sf_dir, days), days)


@query("changed_since_previous_dups", ids="OP-04 on duplicated rows", sql=E_CTE + _CHANGED_SQL.format(src="obs_raw"))
def changed_since_previous_dups(spark, sf_dir):
    days = _newest(spark, sf_dir, 2)
    return ob.changed_since_previous(model.obs_raw(spark, sf_dir, days=days), days)


@query("vanished_since_previous", ids="JOIN-04", sql=E_CTE + _TWO_DAYS.format(src="obs") + """
SELECT any_value(station_id) AS station_id, any_value(fuel_type) AS fuel_type,
       any_value(fetched_at) AS fetched_at, any_value(price)::DOUBLE AS price
FROM ranked WHERE age <= 2 GROUP BY ranked.station_id, ranked.fuel_type HAVING min(age) = 2
""")
def vanished_since_previous(spark, sf_dir):
    days = _newest(spark, sf_dir, 2)
    return ob.vanished_since_previous(model.obs(spark, sf_dir, days), days)
