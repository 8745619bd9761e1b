"""Registered report, quality, sink round-trip and scalar-expression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pumpwatch import model
from pumpwatch.functions import scalars as sc
from pumpwatch.operators import counts as ct
from pumpwatch.operators import observations as ob
from pumpwatch.operators import quality as qa
from pumpwatch.operators import snapshots as sn
from pumpwatch.plans.feed_queries import FEED_CTE, parsed_features
from pumpwatch.plans.history_queries import E_CTE, MOVES_SQL
from pumpwatch.plans.registry import query
from pumpwatch.plans.snapshot_queries import DATASET, MAX_SNAPSHOTS, O_CTE
from pumpwatch.session import work_dir
from pumpwatch.sinks import writers
from pumpwatch.sources.tables import read_table, table_path


# ------------------------------------------------------------- data quality
@query("dq_report", ids="AGG-16 (feed feature rules, one pass)", sql=FEED_CTE + """
SELECT 'coordinates_present' AS rule, count(*) AS checked, 0 AS failed FROM addr
UNION ALL SELECT 'longitude_in_bounds', count(*),
  count(*) FILTER (WHERE NOT (longitude BETWEEN -80.0 AND -56.0)) FROM addr
UNION ALL SELECT 'latitude_in_bounds', count(*),
  count(*) FILTER (WHERE NOT (latitude BETWEEN 44.0 AND 63.0)) FROM addr
UNION ALL SELECT 'name_non_empty', count(*), count(*) FILTER (WHERE length(name) = 0) FROM addr
UNION ALL SELECT 'prices_present', count(*), count(*) FILTER (WHERE ln = 7) FROM addr
""")
def dq_report(spark, sf_dir):
    return qa.dq_report(parsed_features(spark, sf_dir), qa.feature_rules())


def _damaged_snapshots(spark, sf_dir):
    """Snapshots as an archive may carry them: low-priority error polls lost their time."""
    s = model.snapshots_o(spark, sf_dir)
    lost = (F.col("status") == model.STATUS_ERROR) & (F.col("dataset") == "5-LOW")
    return s.withColumn("timestamp", F.when(lost, F.lit(None)).otherwise(F.col("timestamp")))


@query("missing_timestamps", ids="FLT-11 (count + 3 samples)", sql=O_CTE + """
, missing AS (SELECT * FROM snaps WHERE status = 'error' AND dataset = '5-LOW')
SELECT id, CAST(NULL AS TIMESTAMP) AS "timestamp", status, dataset,
       (SELECT count(*) FROM missing) AS missing_total
FROM missing ORDER BY id LIMIT 3
""")
def missing_timestamps(spark, sf_dir):
    return qa.missing_timestamps(_damaged_snapshots(spark, sf_dir), 3)


# the V2 model's tables and columns in schema order (fixed values: the data model)
_PROFILE_COLUMNS = {
    "fuels": ["id", "name"],
    "prices": ["snapshot_id", "station_id", "fuel_id", "price"],
    "snapshots": ["id", "timestamp", "status", "dataset"],
    "stations": ["id", "name", "city", "region", "adress", "longitude", "latitude"],
}


def _profile_sql() -> str:
    """DuckDB evaluates the same binding expressions and reports each column's
    type with ``typeof`` (DuckDB names translated to Spark's: VARCHAR → string,
    INTEGER → int, others lower-cased) and each table's row count."""
    rows = []
    for table, cols in _PROFILE_COLUMNS.items():
        for i, c in enumerate(cols):
            rows.append(f"""SELECT '{table}' AS "table", {i} AS "position", '{c}' AS "column",
         (SELECT typeof("{c}") FROM p_{table} LIMIT 1) AS t,
         (SELECT count(*) FROM p_{table}) AS n""")
    return """
WITH p_snapshots AS (
  SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS "timestamp",
         CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'processing'
                            WHEN 'P' THEN 'error' END AS status,
         o_orderpriority AS dataset
  FROM orders),
p_prices AS (
  SELECT l_orderkey AS snapshot_id, l_suppkey AS station_id, l_partkey AS fuel_id,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS price
  FROM lineitem),
p_fuels AS (SELECT p_partkey AS id, p_type AS name FROM part),
p_stations AS (
  SELECT s_suppkey AS id, s_name AS name, n_name AS city, r_name AS region,
         CAST(s_suppkey AS VARCHAR) || ' Main St' AS adress,
         CAST(-80.0 AS DOUBLE) + CAST(s_suppkey % 24 AS DOUBLE) AS longitude,
         CAST(44.0 AS DOUBLE) + CAST(s_suppkey % 19 AS DOUBLE) AS latitude
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cols AS (
  """ + "\n  UNION ALL ".join(rows) + """)
SELECT "table", CAST("position" AS INTEGER) AS "position", "column",
       CASE lower(t) WHEN 'varchar' THEN 'string' WHEN 'integer' THEN 'int' ELSE lower(t) END
         AS data_type,
       TRUE AS nullable, CAST(n AS BIGINT) AS "rows"
FROM cols
"""


@query("dataset_profile", ids="SRC-07 (types of the same expressions in both engines, row counts)",
       sql=_profile_sql())
def dataset_profile(spark, sf_dir):
    tables = {"stations": model.stations_o(spark, sf_dir),
              "snapshots": model.snapshots_o(spark, sf_dir),
              "prices": model.prices_o(spark, sf_dir),
              "fuels": model.fuels_o(spark, sf_dir)}
    return qa.dataset_profile(spark, tables)


def _storage_rows(spark, sf_dir):
    """(label, own_rows, total_rows) of each table: one aggregate a table."""
    snaps = model.snapshots_o(spark, sf_dir)
    counted = ct.with_price_counts(snaps, model.prices_o(spark, sf_dir))
    own = F.col("dataset") == DATASET
    one = lambda df, label, mine, total: df.agg(
        F.coalesce(F.sum(mine), F.lit(0)).cast("long").alias("own_rows"),
        F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("total_rows")).select(F.lit(label).alias("label"), "own_rows", "total_rows")
    row = lambda cond: F.when(cond, 1).otherwise(0)
    both = counted.agg(F.count_if(own).alias("s_own"), F.count(F.lit(1)).alias("s_all"),
                       F.sum(F.when(own, F.col("price_count"))).alias("p_own"), F.sum("price_count").alias("p_all"))
    facts = both.selectExpr("stack(2, 'Snapshots', s_own, s_all, 'Prices', coalesce(p_own, 0L), coalesce(p_all, 0L)) "
                            "AS (label, own_rows, total_rows)")
    return (one(model.datasets_o(spark, sf_dir), "Analysis", row(F.col("name") == DATASET), F.lit(1))
            .unionByName(one(model.owned_stations_o(spark, sf_dir), "Stations", row(own), F.lit(1)))
            .unionByName(facts))


_ROWS_SQL = O_CTE + """
, counted AS (
  SELECT 'Analysis' AS label, count(DISTINCT dataset) FILTER (dataset = '1-URGENT') AS own_rows,
         count(DISTINCT dataset) AS total_rows FROM snaps
  UNION ALL SELECT 'Snapshots', count(*) FILTER (dataset = '1-URGENT'), count(*) FROM snaps
  UNION ALL SELECT 'Stations', count(*) FILTER (s_nationkey % 5 = 0), count(*) FROM supplier
  UNION ALL SELECT 'Prices', count(*) FILTER (dataset = '1-URGENT'), count(*) FROM px JOIN snaps ON id = snapshot_id)
"""


@query("storage_rows", ids="AGG-15 (own / total rows per table, ratio)", sql=_ROWS_SQL + """
SELECT label, own_rows, total_rows, own_rows / total_rows AS ratio FROM counted
""")
def storage_rows(spark, sf_dir):
    total = F.col("total_rows")
    return _storage_rows(spark, sf_dir).withColumn("ratio", F.when(
        total > 0, F.col("own_rows").cast("double") / total).otherwise(F.lit(0.0)))


@query("storage_estimate", ids="OP-10 AGG-15 (bytes × ratio, truncated parts and their total; bytes from a table column)",
       sql=_ROWS_SQL + """
, sized AS (
  SELECT label, own_rows, total_rows,
         CASE label WHEN 'Prices' THEN (SELECT sum(l_partkey) FROM lineitem) WHEN 'Snapshots' THEN (SELECT sum(o_custkey) FROM orders)
                    ELSE (SELECT sum(s_suppkey) FROM supplier) END::BIGINT AS table_bytes
  FROM counted),
parts AS (SELECT *, trunc(table_bytes::DOUBLE * (own_rows::DOUBLE / total_rows))::BIGINT AS estimated_bytes FROM sized)
SELECT * FROM parts
UNION ALL SELECT 'Total', NULL, NULL, sum(table_bytes)::BIGINT, sum(estimated_bytes)::BIGINT FROM parts
""")
def storage_estimate(spark, sf_dir):
    size = lambda table, col: read_table(spark, sf_dir, table).select(F.sum(col)).scalar()
    label = F.col("label")
    return qa.attribute(_storage_rows(spark, sf_dir).withColumn("table_bytes", F.when(
        label == "Prices", size("lineitem", "l_partkey")).when(label == "Snapshots", size("orders", "o_custkey"))
        .otherwise(size("supplier", "s_suppkey"))))


@query("storage_attribution", ids="OP-10 AGG-15 SRC-08 (rows-only: file bytes)")
def storage_attribution(spark, sf_dir):
    label = F.col("label")
    bytes_of = {"Analysis": "orders", "Snapshots": "orders", "Stations": "supplier", "Prices": "lineitem"}
    size = F.lit(0)
    for name, table in bytes_of.items():
        size = F.when(label == name, qa.stored_bytes(spark, table_path(sf_dir, table))).otherwise(size)
    return qa.attribute(_storage_rows(spark, sf_dir).withColumn("table_bytes", size))


@query("storage_sections", ids="SRC-08 OP-10 AGG-15 (bytes of the files of sections that the query writes, attributed by rows)",
       sql=_ROWS_SQL + """
, sized AS (
  SELECT label, own_rows, total_rows, (CASE label
      WHEN 'Prices' THEN (SELECT sum(strlen(concat_ws('|', snapshot_id, station_id, fuel_id, price)) + 1) FROM px)
      WHEN 'Snapshots' THEN (SELECT sum(strlen(concat_ws('|', id, status, dataset)) + 1) FROM snaps)
      WHEN 'Analysis' THEN (SELECT sum(strlen(dataset) + 1) FROM (SELECT DISTINCT dataset FROM snaps))
      ELSE (SELECT sum(strlen(concat_ws('|', s_suppkey, s_name)) + 1) FROM supplier) END)::BIGINT AS table_bytes
  FROM counted),
parts AS (SELECT *, trunc(table_bytes::DOUBLE * (own_rows::DOUBLE / total_rows))::BIGINT AS estimated_bytes FROM sized)
SELECT * FROM parts
UNION ALL SELECT 'Total', NULL, NULL, sum(table_bytes)::BIGINT, sum(estimated_bytes)::BIGINT FROM parts
""")
def storage_sections(spark, sf_dir):
    """Each table as lines of text in files of its own, whose bytes are then asked of the file system."""
    base, label, size = work_dir(spark, "sections"), F.col("label"), F.lit(0)
    sections = {"Analysis": (model.datasets_o(spark, sf_dir), ["name"]),
                "Snapshots": (model.snapshots_o(spark, sf_dir), ["id", "status", "dataset"]),
                "Stations": (model.owned_stations_o(spark, sf_dir), ["id", "name"]),
                "Prices": (model.prices_o(spark, sf_dir), ["snapshot_id", "station_id", "fuel_id", "price"])}
    for name, (table, columns) in sections.items():
        table.select(F.concat_ws("|", *columns).alias("value")).write.text(f"{base}/{name}")
        size = F.when(label == name, qa.stored_bytes(spark, f"{base}/{name}")).otherwise(size)
    return qa.attribute(_storage_rows(spark, sf_dir).withColumn("table_bytes", size))


# ------------------------------------------------------------- sinks, read back
_EXTRACT_SQL = O_CTE + """
, chosen AS (
  SELECT max(id) AS id FROM base
  WHERE "timestamp" BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-12-31 00:00:00'
  GROUP BY date_trunc('month', "timestamp"))
SELECT st.name AS "Station", st.city AS "City", st.region AS "Region", fu.name AS "Fuel",
       CAST(px.price AS DOUBLE) AS "Price", strftime(s."timestamp", '%Y-%m-%d %H:%M') AS "Snapshot"
FROM px JOIN st ON st.id = px.station_id JOIN fu ON fu.id = px.fuel_id
JOIN snaps s ON s.id = px.snapshot_id
WHERE px.snapshot_id IN (SELECT id FROM chosen)
"""

RECORD_SCHEMA = ("Station string, City string, Region string, Fuel string, Price double, "
                 "Snapshot string")


def _extract(spark, sf_dir):
    snaps, prices = model.snapshots_o(spark, sf_dir), model.prices_o(spark, sf_dir)
    stations, fuels = model.stations_o(spark, sf_dir), model.fuels_o(spark, sf_dir)
    sel = sn.select_snapshots(snaps, DATASET, "month", start="1996-01-01 00:00:00",
                              end="1997-12-31 00:00:00", max_snapshots=MAX_SNAPSHOTS)
    return sn.price_extract(sel, prices, stations, fuels, snaps, ordered=False)


@query("price_json_records", ids="SNK-02 SCL-19 (written, read back)", sql=_EXTRACT_SQL)
def price_json_records(spark, sf_dir):
    path = writers.write_json_records(_extract(spark, sf_dir), work_dir(spark, "records"))
    return spark.read.schema(RECORD_SCHEMA).json(path)


@query("price_csv_extract", ids="SNK-05 (written with header, read back)", sql=_EXTRACT_SQL)
def price_csv_extract(spark, sf_dir):
    path = writers.write_csv_extract(_extract(spark, sf_dir), work_dir(spark, "csv"))
    return spark.read.schema(RECORD_SCHEMA).option("header", True).csv(path)


# ------------------------------------------------------------- text formatting
@query("report_formatting", ids="SCL-05 SCL-06 (cheapest-prices report lines)", sql=E_CTE + """
, top AS (
  SELECT s.name, s.city, s.region, p.fuel_type, p.price FROM obs p JOIN st s ON s.id = p.station_id
  WHERE p.fetched_at = (SELECT max(fetched_at) FROM obs)
  ORDER BY p.price, s.name, p.fuel_type LIMIT 20)
SELECT rpad(left(name, 39), 40, ' ') || ' ' || rpad(left(coalesce(city, ''), 19), 20, ' ') || ' '
       || CASE WHEN length(fuel_type) >= 10 THEN fuel_type ELSE rpad(fuel_type, 10, ' ') END || ' '
       || CASE WHEN length(printf('%.1f', round(price, 1))) >= 7 THEN printf('%.1f', round(price, 1))
               ELSE lpad(printf('%.1f', round(price, 1)), 7, ' ') END || '¢' AS line
FROM top
""")
def report_formatting(spark, sf_dir):
    prices, stations = model.obs(spark, sf_dir), model.stations_e(spark, sf_dir)
    top = ob.latest_prices(prices, stations, 20)
    amount = F.format_string("%.1f", F.round("price", 1).cast("double"))
    return top.select(F.concat(sc.fit_left(F.col("name"), 40), F.lit(" "),
                               sc.fit_left(F.col("city"), 20), F.lit(" "),
                               sc.pad_left_aligned(F.col("fuel_type"), 10), F.lit(" "),
                               sc.pad_right_aligned(amount, 7), F.lit(sc.CENT)).alias("line"))


@query("variation_lines", ids="SCL-06 (signed delta, missing mark)",
       sql=E_CTE + MOVES_SQL.format(src="obs", tie="price") + """
SELECT station_name, fuel_type, format('{:.1f}¢', prev_price) AS before,
       format('{:.1f}¢', price) AS after, format('{:+.1f}¢', delta) AS delta
FROM report
""")
def variation_lines(spark, sf_dir):
    var = ob.price_moves(model.obs(spark, sf_dir), model.stations_e(spark, sf_dir))
    return var.select("station_name", "fuel_type", sc.cents(F.col("prev_price")).alias("before"),
                      sc.cents(F.col("price")).alias("after"),
                      sc.cents(F.col("delta"), signed=True).alias("delta"))


@query("station_coordinates", ids="SCL-07 TOP-07 (stations by region, city, name)", sql=O_CTE + """
SELECT id, name, city, region, printf('%.4f, %.4f', 44.0 + (id % 19), -80.0 + (id % 24)) AS coords
FROM st
""")
def station_coordinates(spark, sf_dir):
    st = ct.stations_sorted(model.stations_o(spark, sf_dir))
    return st.select("id", "name", "city", "region",
                     sc.coordinates_text(F.col("latitude"), F.col("longitude")).alias("coords"))


# ------------------------------------------------------------- dates and times
_DATE_TEXT_SQL = """
WITH t AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'not a date'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ''
              WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M')
              WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text
  FROM orders)
SELECT id, text, coalesce(try_strptime(text, '%Y-%m-%dT%H:%M'), try_strptime(text, '%Y-%m-%dT%H:%M:%S'),
                          try_strptime(text, '%Y-%m-%d')) AS parsed
FROM t
"""


@query("date_parsing", ids="SCL-11 (three formats, bad → NULL)", sql=_DATE_TEXT_SQL)
def date_parsing(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    d = model.as_utc_ts(F.col("o_orderdate"))
    text = (F.when(F.col("o_orderpriority") == "5-LOW", F.lit("not a date"))
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(""))
            .when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyy-MM-dd'T'HH:mm"))
            .when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.date_format(d, "yyyy-MM-dd")))
    t = o.select(F.col("o_orderkey").alias("id"), text.alias("text"))
    return t.select("id", "text", sc.parse_datetime(F.col("text")).alias("parsed"))


@query("iso_timestamp_parsing", ids="SCL-12 SCL-14 (ISO with offset → UTC, minute text)",
       sql="""
SELECT o_orderkey AS id,
       o_orderdate + to_hours(CAST(o_orderkey % 5 AS INTEGER)) AS parsed,
       strftime(o_orderdate + to_hours(CAST(o_orderkey % 5 AS INTEGER)), '%Y-%m-%d %H:%M') AS minute
FROM orders
""")
def iso_timestamp_parsing(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    # the same instant written in a zone west of UTC: local time - offset
    off = (F.col("o_orderkey") % 5).cast("int")
    local = F.date_format(model.as_utc_ts(F.col("o_orderdate")), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(local, F.lit("-0"), off.cast("string"), F.lit(":00"))
    parsed = sc.parse_iso_timestamp(text)
    return o.select(F.col("o_orderkey").alias("id"), parsed.alias("parsed"),
                    sc.minute_text(parsed).alias("minute"))


@query("retention_filter", ids="FLT-13 (older than now - 24 h; now = newest event)", sql="""
SELECT event_id, ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOURS AS expired FROM events
""")
def retention_filter(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", model.as_utc_ts(F.col("ts")).alias("ts"))
    now = ev.select(F.max("ts")).scalar()
    return ev.select("event_id", (F.col("ts") < now - F.expr("INTERVAL 24 HOURS")).alias("expired"))


@query("next_refresh_boundary", ids="SCL-15 (next run every 7 minutes of the hour)", sql="""
SELECT event_id,
       date_trunc('hour', ts) + to_minutes((7 * ceil(minute(ts) / 7.0))::BIGINT) AS next_run
FROM events
""")
def next_refresh_boundary(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", sc.next_boundary(model.as_utc_ts(F.col("ts")), 7).alias("next_run"))
