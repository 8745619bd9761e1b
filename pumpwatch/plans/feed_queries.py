"""Registered ingest queries: feed parsing, populate, upserts, V1 record saves.

The feed is derived from the test tables (one GeoJSON Feature per lineitem,
as a GeoJSON text sequence) and parsed back with the production reader, so
the work grows with the tables. Deterministic dirt is derived from natural
columns: unavailable entries (line 3), unparsable 'N/D' prices (return flag
R), blank fuel names (line 6), missing Prices arrays (line 7), NBSP + cent
sign price text (flag A), addresses with zero, one or two commas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pumpwatch import model
from pumpwatch.functions.keys import assign_ids
from pumpwatch.operators import ingest as ig
from pumpwatch.plans.registry import query
from pumpwatch.sources import feed as fd
from pumpwatch.session import work_dir
from pumpwatch.sinks import writers
from pumpwatch.sources.tables import broadcast_few, read_table, spread

FEED_DATASET = "feed"


def feature_rows(spark, sf_dir, stations=None):
    """lineitem ⋈ part ⋈ supplier/nation/region: what the features are made of, not yet encoded.

    Rows are shuffled while they are narrow: the stations, few, come last. A scan
    of fewer tasks than there are cores is dealt over the shuffle partitions,
    for the CPU-heavy JSON encode (measured: 2× slower without it at sf0.1); a
    larger one is parallel by itself. ``stations``: a condition on them.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    if li.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        li = spread(li)
    st = model.stations_o(spark, sf_dir)
    if stations is not None:
        st = st.where(stations)
        li = li.join(broadcast_few(st.select("id")), F.col("l_suppkey") == F.col("id"), "left_semi")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    return li.join(part, li.l_partkey == part.p_partkey).join(broadcast_few(st), li.l_suppkey == st.id)


def feature_value():
    """The Feature JSON of a row of ``feature_rows``."""
    k = F.col("l_suppkey")
    street = F.concat(k.cast("string"),
                      F.when(k % 2 == 0, F.lit(", Main St")).otherwise(F.lit(" Main St")))
    address = F.when(k % 5 == 0, street).otherwise(F.concat(street, F.lit(", "), F.col("city")))
    amount = F.format_string("%.2f", F.col("l_extendedprice"))
    price_text = (F.when(F.col("l_returnflag") == "R", F.lit("N/D"))
                  .when(F.col("l_returnflag") == "A", F.concat(amount, F.lit("\u00a0¢")))
                  .otherwise(amount))
    entry = F.struct(
        F.when(F.col("l_linenumber") == 6, F.lit("  ")).otherwise(F.col("p_type")).alias("GasType"),
        price_text.alias("Price"),
        (F.col("l_linenumber") != 3).alias("IsAvailable"))
    prices = F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.array(entry))
    return fd.feature_json(F.col("name"), address, F.col("region"), F.col("longitude"),
                           F.col("latitude"), prices, F.col("l_orderkey"))


def feature_lines(spark, sf_dir, stations=None):
    """One Feature JSON line per row of lineitem with its station and part."""
    return feature_rows(spark, sf_dir, stations).select(feature_value().alias("value"))


def parsed_features(spark, sf_dir, shared: bool = False):
    """The derived feed, parsed. When a job evaluates it more than once
    (``shared``: upserts read it in the id-numbering job and in the final
    plan; populate in three branches), the parsed features are written as parquet
    to the shared folder once instead of being re-encoded and re-parsed."""
    flat = fd.flatten_features(fd.parse_feature_text(feature_lines(spark, sf_dir)))
    if not shared:
        return flat
    path = work_dir(spark, "features")
    flat.write.mode("overwrite").parquet(path)
    return spark.read.schema(flat.schema).parquet(path)


# DuckDB: the expected outcome of parsing, written case by case
FEED_CTE = """
WITH src AS (
  SELECT l.l_orderkey AS snapshot, l.l_linenumber AS ln, l.l_returnflag AS rf,
         s.s_suppkey AS k, s.s_name AS name, n.n_name AS nation, r.r_name AS region,
         p.p_type AS fuel, CAST(l.l_extendedprice AS DECIMAL(10,2)) AS price,
         CAST(-80.0 + (s.s_suppkey % 24) AS DOUBLE) AS longitude,
         CAST(44.0 + (s.s_suppkey % 19) AS DOUBLE) AS latitude
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey),
addr AS (
  SELECT *,
    CASE WHEN k % 5 <> 0 AND k % 2 = 0 THEN CAST(k AS VARCHAR) || ', Main St'
         WHEN k % 5 <> 0 THEN CAST(k AS VARCHAR) || ' Main St'
         WHEN k % 2 = 0 THEN CAST(k AS VARCHAR)
         ELSE CAST(k AS VARCHAR) || ' Main St' END AS street,
    CASE WHEN k % 5 <> 0 THEN nation WHEN k % 2 = 0 THEN 'Main St' ELSE '' END AS city
  FROM src)
"""


_PARSED_SQL = FEED_CTE + """
SELECT snapshot, name, street, city, region, longitude, latitude, fuel,
       CAST(price AS DOUBLE) AS price
FROM addr WHERE ln NOT IN (3, 6, 7) AND rf <> 'R'
"""


def _kept_entries(flat):
    e = ig.valid_entries(ig.feed_entries(flat))
    return e.select("snapshot", "name", "street", "city", "region", "longitude", "latitude",
                    "fuel", "price")


@query("feed_parse", ids="OP-11 SRC-01 PRJ-01 FLT-06 SCL-01 SCL-02 SCL-03 SCL-17 SCL-19",
       sql=_PARSED_SQL)
def feed_parse(spark, sf_dir):
    return _kept_entries(parsed_features(spark, sf_dir))


@query("feed_files_parse", ids="SRC-01 SRC-02 (feed files, gzip and plain, one reader) "
       "PRJ-01 FLT-06 SCL-02", sql=_PARSED_SQL)
def feed_files_parse(spark, sf_dir):
    """The derived feed landed as files — polls of regions A-D gzip-compressed,
    the others plain text — and read back as ONE folder by the production
    line reader: the codec is picked per file by its suffix, and the text
    sequence splits across tasks like any other line-oriented file."""
    root = work_dir(spark, "feed-files")
    gz = F.col("region") < F.lit("E")
    feature_lines(spark, sf_dir, gz).write.mode("overwrite").option("compression", "gzip").text(f"{root}/gz")
    feature_lines(spark, sf_dir, ~gz).write.mode("overwrite").text(f"{root}/plain")
    return _kept_entries(fd.flatten_features(fd.read_feature_lines(spark, f"{root}/*")))


@query("feed_address_split", ids="SCL-01 SCL-04", sql=FEED_CTE + """
SELECT DISTINCT name, street, city FROM addr
""")
def feed_address_split(spark, sf_dir):
    from pumpwatch.functions.scalars import address_city, address_street
    f = parsed_features(spark, sf_dir)
    return f.select(F.coalesce(F.col("Name"), F.lit("")).alias("name"),
                    address_street(F.col("Address")).alias("street"),
                    address_city(F.col("Address")).alias("city")).distinct()


@query("feed_rejects", ids="FLT-06 SCL-02 SCL-03 (reject reasons per region)", sql=FEED_CTE + """
SELECT region, count(*) AS entries,
       count(*) FILTER (WHERE ln = 3) AS unavailable,
       count(*) FILTER (WHERE ln <> 3 AND rf = 'R') AS bad_price,
       count(*) FILTER (WHERE ln = 6 AND rf <> 'R') AS blank_fuel,
       count(*) FILTER (WHERE ln NOT IN (3, 6) AND rf <> 'R') AS kept
FROM addr WHERE ln <> 7 GROUP BY region
""")
def feed_rejects(spark, sf_dir):
    return ig.feed_rejects(parsed_features(spark, sf_dir), by=["region"])


def _existing_feed_stations(spark, sf_dir):
    """A station dimension as left by earlier polls: nations 0-9 under the same
    names (their ids are kept), the others under an older name (so the feed's
    stations are new ones)."""
    st = model.stations_o(spark, sf_dir)
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    k = F.col("id")
    street = F.concat(k.cast("string"),
                      F.when(k % 2 == 0, F.lit(", Main St")).otherwise(F.lit(" Main St")))
    return (st.join(sup, st.id == sup.s_suppkey)
            .select("id", F.lit(FEED_DATASET).alias("dataset"),
                    F.when(F.col("s_nationkey") < 10, F.col("name"))
                    .otherwise(F.concat(F.col("name"), F.lit(" (old)"))).alias("name"),
                    F.when(k % 5 == 0, F.when(k % 2 == 0, k.cast("string")).otherwise(street))
                    .otherwise(street).alias("adress"),
                    F.lit("OLD").alias("city"), F.lit("OLD").alias("region"),
                    F.lit(0.0).alias("longitude"), F.lit(0.0).alias("latitude")))


_UPSERT_SQL = FEED_CTE + """
, existing AS (
  SELECT s_suppkey AS id, 'feed' AS dataset,
         CASE WHEN s_nationkey < 10 THEN s_name ELSE s_name || ' (old)' END AS name,
         CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR) || ', Main St'
              WHEN s_suppkey % 5 <> 0 THEN CAST(s_suppkey AS VARCHAR) || ' Main St'
              WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey AS VARCHAR)
              ELSE CAST(s_suppkey AS VARCHAR) || ' Main St' END AS adress
  FROM supplier),
incoming AS (SELECT DISTINCT 'feed' AS dataset, name, street AS adress, city, region,
                             longitude, latitude FROM addr),
kept AS (
  SELECT e.id, e.dataset, e.name, e.adress,
         coalesce(i.city, 'OLD') AS city, coalesce(i.region, 'OLD') AS region,
         coalesce(i.longitude, CAST(0.0 AS DOUBLE)) AS longitude,
         coalesce(i.latitude, CAST(0.0 AS DOUBLE)) AS latitude
  FROM existing e LEFT JOIN incoming i
    ON i.dataset = e.dataset AND i.name = e.name AND i.adress = e.adress),
fresh AS (
  SELECT i.* FROM incoming i
  WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.dataset = i.dataset AND e.name = i.name
                    AND e.adress = i.adress))
"""


@query("station_upsert", ids="UPS-02 (ids kept, new ids after the max)", sql=_UPSERT_SQL + """
SELECT id, dataset, name, adress, city, region, longitude, latitude FROM kept
UNION ALL
SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY dataset, name, adress),
       dataset, name, adress, city, region, longitude, latitude
FROM fresh
""")
def station_upsert(spark, sf_dir):
    from pumpwatch.functions.scalars import address_city, address_street
    f = parsed_features(spark, sf_dir, shared=True)
    feats = f.select(F.lit(FEED_DATASET).alias("dataset"),
                     F.coalesce(F.col("Name"), F.lit("")).alias("name"),
                     address_street(F.col("Address")).alias("adress"),
                     address_city(F.col("Address")).alias("city"),
                     F.coalesce(F.col("Region"), F.lit("")).alias("region"),
                     "longitude", "latitude", "snapshot")
    return ig.upsert_stations(_existing_feed_stations(spark, sf_dir), feats,
                              F.col("snapshot"))


def _existing_fuels(spark, sf_dir):
    names = read_table(spark, sf_dir, "part").select(F.col("p_type").alias("name")) \
        .where(F.col("name") < "M").distinct()
    return assign_ids(names, ["name"], start=1)


@query("fuel_get_or_create", ids="UPS-03", sql=FEED_CTE + """
, existing AS (SELECT name, row_number() OVER (ORDER BY name) AS id
               FROM (SELECT DISTINCT p_type AS name FROM part WHERE p_type < 'M')),
fresh AS (SELECT DISTINCT fuel AS name FROM addr
          WHERE ln NOT IN (3, 6, 7) AND rf <> 'R' AND fuel NOT IN (SELECT name FROM existing))
SELECT id, name FROM existing
UNION ALL
SELECT (SELECT coalesce(max(id), 0) FROM existing) + row_number() OVER (ORDER BY name), name
FROM fresh
""")
def fuel_get_or_create(spark, sf_dir):
    entries = ig.valid_entries(ig.feed_entries(parsed_features(spark, sf_dir, shared=True)))
    return ig.get_or_create_fuels(_existing_fuels(spark, sf_dir), entries)


@query("feed_populate", ids="OP-11 AGG-17 (new prices per snapshot after upserts)",
       sql=FEED_CTE + """
SELECT snapshot AS snapshot_id, name, street AS adress, fuel, count(*) AS prices,
       CAST(sum(price) AS DOUBLE) AS amount
FROM addr WHERE ln NOT IN (3, 6, 7) AND rf <> 'R' GROUP BY ALL
""")
def feed_populate(spark, sf_dir):
    flat = parsed_features(spark, sf_dir, shared=True)
    stations, fuels, prices = ig.populate(flat, FEED_DATASET,
                                          _existing_feed_stations(spark, sf_dir),
                                          _existing_fuels(spark, sf_dir))
    st = broadcast_few(stations.select(F.col("id").alias("station_id"), "name", "adress"))
    fu = broadcast_few(fuels.select(F.col("id").alias("fuel_id"), F.col("name").alias("fuel")))
    return (prices.join(st, "station_id").join(fu, "fuel_id")
            .groupBy("snapshot_id", "name", "adress", "fuel")
            .agg(F.count(F.lit(1)).alias("prices"), F.sum("price").alias("amount")))


# ------------------------------------------------------------ V1 record saves
def _records(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    st = model.stations_e(spark, sf_dir)
    return ev.join(st, ev.user_id == st.id).select(
        "event_id", F.col("user_id").alias("station_id"),
        F.concat(F.col("name"), F.lit("/"), F.col("event_type")).alias("name"),
        F.lit("").alias("address"), "city", "region",
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("fuel_type"),
        F.col("value").alias("price"),
        F.when(F.col("event_type") != "view", model.as_utc_ts(F.col("ts"))).alias("fetched_at"))


_REC_CTE = """
WITH rec AS (
  SELECT e.event_id, e.user_id AS station_id, c.c_name || '/' || e.event_type AS name,
         n.n_name AS city, r.r_name AS region, e.event_type, e.value, e.ts, c.c_acctbal
  FROM events e JOIN customer c ON c.c_custkey = e.user_id
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
batch AS (SELECT max(ts) AS now FROM events)
"""


@query("record_batch_save", ids="OP-15 SNK-04 (defaults: fuel 'regular', fetched_at = batch time)",
       sql=_REC_CTE + """
SELECT station_id, CASE WHEN event_type <> 'error' THEN event_type ELSE 'regular' END AS fuel_type,
       CAST(CAST(value AS DECIMAL(10,2)) AS DOUBLE) AS price,
       CASE WHEN event_type <> 'view' THEN ts ELSE (SELECT now FROM batch) END AS fetched_at
FROM rec
""")
def record_batch_save(spark, sf_dir):
    now = read_table(spark, sf_dir, "events").select(
        model.as_utc_ts(F.max("ts"))).scalar()
    prices = ig.records_to_prices(_records(spark, sf_dir), now)
    # appended through the fact sink (date-partitioned batch folder), read back
    root = writers.append_prices(prices, work_dir(spark, "v1-prices"), batch_id=0,
                                 ts_col="fetched_at")
    return spark.read.parquet(root).select("station_id", "fuel_type", "price", "fetched_at")


@query("station_upsert_by_id", ids="UPS-01 (last record wins, created_at kept)",
       sql=_REC_CTE + """
, existing AS (
  SELECT c.c_custkey AS id, c.c_name AS name, '' AS address, n.n_name AS city, r.r_name AS region,
         TIMESTAMP '2023-12-31 00:00:00' AS created_at
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_acctbal > 0),
latest AS (
  SELECT station_id AS id, max_by(name, event_id) AS name, max_by(city, event_id) AS city,
         max_by(region, event_id) AS region
  FROM rec GROUP BY station_id)
SELECT coalesce(l.id, e.id) AS id, coalesce(l.name, e.name) AS name,
       CASE WHEN l.id IS NOT NULL THEN '' ELSE e.address END AS address,
       coalesce(l.city, e.city) AS city, coalesce(l.region, e.region) AS region,
       CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
       coalesce(e.created_at, (SELECT now FROM batch)) AS created_at
FROM existing e FULL OUTER JOIN latest l ON l.id = e.id
""")
def station_upsert_by_id(spark, sf_dir):
    cust = read_table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 0).select(
        F.col("c_custkey").alias("id"))
    existing = (model.stations_e(spark, sf_dir).join(cust, "id", "left_semi")
                .select("id", "name", F.lit("").alias("address"), "city", "region",
                        F.lit(None).cast("double").alias("latitude"),
                        F.lit(None).cast("double").alias("longitude"),
                        F.lit("2023-12-31 00:00:00").cast("timestamp").alias("created_at")))
    now = read_table(spark, sf_dir, "events").select(model.as_utc_ts(F.max("ts"))).scalar()
    recs = _records(spark, sf_dir).select(
        F.col("station_id").alias("id"), "name", "address", "city", "region", "latitude",
        "longitude", now.alias("created_at"), "event_id")
    return ig.upsert_stations_by_id(existing, recs, F.col("event_id"))
