"""Registered streaming query: the feed ingest run as Structured Streaming
with ``availableNow`` over landing files derived from the tables; its result
must equal the batch ingest (``feed_populate``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pumpwatch.plans.feed_queries import (FEED_DATASET, FEED_CTE, _existing_feed_stations,
                                          _existing_fuels, feature_rows, feature_value)
from pumpwatch import model
from pumpwatch.operators.counts import with_price_counts
from pumpwatch.operators.ingest import merge_stations
from pumpwatch.plans.history_queries import E_CTE, MOVES_SQL
from pumpwatch.plans.registry import query
from pumpwatch.session import work_dir
from pumpwatch.sources.tables import broadcast_few, read_table
from pumpwatch.sinks.store import PriceStore
from pumpwatch.streaming.ingest import start_ingest
from pumpwatch.streaming.moves import MoveState

#: Landing files at least, and lines of one of them at about.
LANDING_FILES = 8
LANDING_LINES = 500_000


def landing_files(spark, lines: int) -> int:
    """As many as shuffle partitions at least: a join by the same key then keeps the partitioning."""
    return max(LANDING_FILES, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // LANDING_LINES))


def land(spark, sf_dir, rows, path: str, line) -> int:
    """Write the lines ``line`` of ``rows`` (snapshot, ...) as gzip files; returns their number.

    Every poll lands in exactly one file (hash of its snapshot id). The rows are
    shuffled as they are and encoded after it; the more lines, the more files.
    """
    files = landing_files(spark, read_table(spark, sf_dir, "lineitem").count())
    (line(rows.repartition(files, "snapshot")).select("value")
     .write.mode("overwrite").option("compression", "gzip").text(path))
    return files


def snapshot_rows(spark, sf_dir):
    return feature_rows(spark, sf_dir).withColumnRenamed("l_orderkey", "snapshot")


def with_value(rows):
    return rows.withColumnRenamed("snapshot", "l_orderkey").select(
        F.col("l_orderkey").alias("snapshot"), feature_value().alias("value"), *[c for c in rows.columns if c.startswith("_")])


@query("stream_snapshot_ingest", ids="STR-01 STR-03 STR-04 SNK-04 (availableNow == batch)",
       sql=FEED_CTE + """
SELECT snapshot AS snapshot_id, name, street AS adress, fuel, count(*) AS prices,
       CAST(sum(price) AS DOUBLE) AS amount
FROM addr WHERE ln NOT IN (3, 6, 7) AND rf <> 'R' GROUP BY ALL
""")
def stream_snapshot_ingest(spark, sf_dir):
    base = work_dir(spark, "stream")
    landing, store = f"{base}/landing", PriceStore(spark, f"{base}/store")
    files = land(spark, sf_dir, snapshot_rows(spark, sf_dir), landing, with_value)
    store.write_dim("stations", _existing_feed_stations(spark, sf_dir), 0)
    store.write_dim("fuels", _existing_fuels(spark, sf_dir), 0)
    q = start_ingest(spark, landing, store, FEED_DATASET, f"{base}/checkpoint",
                     layout="sequence", available_now=True, max_files_per_trigger=-(-files // 2))
    q.awaitTermination()
    st = broadcast_few(store.read_dim("stations").select(F.col("id").alias("station_id"), "name", "adress"))
    fu = broadcast_few(store.read_dim("fuels").select(F.col("id").alias("fuel_id"), F.col("name").alias("fuel")))
    return (store.published_prices().join(st, "station_id").join(fu, "fuel_id")
            .groupBy("snapshot_id", "name", "adress", "fuel")
            .agg(F.count(F.lit(1)).alias("prices"), F.sum("price").alias("amount")))


def collection_lines(rows, orders):
    """One poll document per row (``{"snapshot": id, ...}`` first); every document
    of a low-priority 'P' order is cut in half (corrupt)."""
    o = orders.select(
        F.col("o_orderkey").alias("snapshot"),
        ((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P")).alias("_bad"))
    doc = F.concat(F.lit('{"snapshot":'), F.col("snapshot").cast("string"),
                   F.lit(',"type":"FeatureCollection","features":['), F.col("value"), F.lit("]}"))
    cut = F.expr("substring(_doc, 1, CAST(length(_doc) / 2 AS INT))")
    return (with_value(rows.join(o, "snapshot")).withColumn("_doc", doc)
            .select("snapshot", F.when(F.col("_bad"), cut).otherwise(F.col("_doc")).alias("value")))


@query("stream_error_isolation", ids="STR-02 STR-03 AGG-17 (corrupt poll → error snapshot, "
       "nothing of it published; the others processed)", sql=FEED_CTE + """
, o AS (SELECT o_orderkey, o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AS bad FROM orders)
SELECT a.snapshot AS id, CASE WHEN bool_or(o.bad) THEN 'error' ELSE 'processed' END AS status,
       CAST(CASE WHEN bool_or(o.bad) THEN 0
                 ELSE count(*) FILTER (WHERE ln NOT IN (3, 6, 7) AND rf <> 'R') END AS BIGINT)
         AS price_count
FROM addr a JOIN o ON o.o_orderkey = a.snapshot
GROUP BY a.snapshot
""")
def stream_error_isolation(spark, sf_dir):
    base = work_dir(spark, "stream-errors")
    landing, store = f"{base}/landing", PriceStore(spark, f"{base}/store")
    orders = read_table(spark, sf_dir, "orders")
    files = land(spark, sf_dir, snapshot_rows(spark, sf_dir), landing, lambda rows: collection_lines(rows, orders))
    store.write_dim("stations", _existing_feed_stations(spark, sf_dir), 0)
    store.write_dim("fuels", _existing_fuels(spark, sf_dir), 0)
    q = start_ingest(spark, landing, store, FEED_DATASET, f"{base}/checkpoint",
                     layout="collections", available_now=True, max_files_per_trigger=-(-files // 2))
    q.awaitTermination()
    return store.snapshots().select("id", "status", "price_count")


def _store(spark, sf_dir, base):
    store = PriceStore(spark, f"{base}/store")
    store.write_dim("stations", _existing_feed_stations(spark, sf_dir), 0)
    store.write_dim("fuels", _existing_fuels(spark, sf_dir), 0)
    return store


@query("stream_sequence_errors", ids="STR-02 STR-03 (one corrupt feature line makes its whole poll an error)",
       sql=FEED_CTE + """
, o AS (SELECT o_orderkey, o_orderpriority = '5-LOW' AND o_orderstatus = 'P' AS bad FROM orders)
SELECT snapshot AS id, CASE WHEN any_value(bad) THEN 'error' ELSE 'processed' END AS status,
       CASE WHEN any_value(bad) THEN 0 ELSE count(*) FILTER (ln NOT IN (3, 6, 7) AND rf <> 'R') END::BIGINT AS price_count
FROM addr JOIN o ON o_orderkey = snapshot GROUP BY snapshot
""")
def stream_sequence_errors(spark, sf_dir):
    """The first line of each low-priority 'P' order has a coordinate list that is no list."""
    base = work_dir(spark, "stream-sequence")
    bad = read_table(spark, sf_dir, "orders").where(
        "o_orderpriority = '5-LOW' AND o_orderstatus = 'P'").select(F.col("o_orderkey").alias("snapshot"), F.lit(True).alias("_bad"))
    broken = F.regexp_replace("value", r'"coordinates":\[[^\]]*\]', '"coordinates":"lost"')
    rows = snapshot_rows(spark, sf_dir).where(F.col("snapshot").isNotNull())

    def lines(rows):
        rows = rows.join(bad, "snapshot", "left")
        # the least name is looked for in the bad polls only
        least = F.min(F.when(F.col("_bad"), F.col("name"))).over(Window.partitionBy("snapshot"))
        return with_value(rows.withColumn("_first", F.col("name") == least)).select(
            F.when(F.col("_bad") & F.col("_first"), broken).otherwise(F.col("value")).alias("value"))
    files = land(spark, sf_dir, rows, f"{base}/landing", lines)
    store = _store(spark, sf_dir, base)
    start_ingest(spark, f"{base}/landing", store, FEED_DATASET, f"{base}/checkpoint", layout="sequence",
                 available_now=True, max_files_per_trigger=-(-3 * files // 8)).awaitTermination()
    return store.snapshots().select("id", "status", "price_count")


#: Orders whose lines make one polled document.
POLL_ORDERS = 2048
#: Micro-batches that the documents come in, of ten files each at least.
POLL_BATCHES = 4


@query("stream_documents", ids="SRC-01 SRC-02 STR-02 STR-03 (one FeatureCollection file a poll, gzip and plain, "
       "some corrupt, some without features, stations several times in a poll)", sql=FEED_CTE + f"""
, polls AS (
  SELECT snapshot // {POLL_ORDERS} AS poll, count(*) FILTER (ln NOT IN (3, 6, 7) AND rf <> 'R') AS valid
  FROM addr GROUP BY 1)
SELECT poll % 7 AS kind, if(poll % 7 = 3, 'error', 'processed') AS status, count(*) AS polls,
       sum(if(poll % 7 IN (3, 5), 0, valid))::BIGINT AS price_count
FROM polls GROUP BY ALL
""")
def stream_documents(spark, sf_dir):
    base = work_dir(spark, "stream-documents")
    poll = F.floor(F.col("snapshot") / POLL_ORDERS)
    kind = F.col("poll") % 7
    lines, polls = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot")).agg(
        F.count(F.lit(1)), F.count_distinct(poll)).first()
    # the rows of a poll come to one task as they are; they are encoded, gathered and written there
    rows = snapshot_rows(spark, sf_dir).withColumn("_poll", poll).repartition(landing_files(spark, lines), "_poll")
    docs = (with_value(rows).groupBy(F.col("_poll").alias("poll"))
            .agg(F.concat_ws(",", F.collect_list("value")).alias("features")))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("features"), F.lit("]}"))
    docs = docs.select("poll", F.when(kind == 3, F.left(whole, F.floor(F.length(whole) / 2).cast("int")))
                       .when(kind == 5, F.lit('{"type":"FeatureCollection"}')).otherwise(whole).alias("value"))
    for name, some in (("gz", F.col("poll") % 2 == 0), ("plain", F.col("poll") % 2 == 1)):
        (docs.where(some).write.mode("overwrite").partitionBy("poll")
         .option("compression", "gzip" if name == "gz" else "none").text(f"{base}/landing/{name}"))
    store = _store(spark, sf_dir, base)
    landing = f"{base}/landing"
    start_ingest(spark, landing, store, FEED_DATASET, f"{base}/checkpoint", layout="documents",
                 available_now=True, max_files_per_trigger=max(10, -(-polls // POLL_BATCHES))).awaitTermination()
    # a document's snapshot id is its file's rank; the polls' kinds come back through the store's file names
    snaps = store.snapshots()
    polls = F.regexp_extract("source_file", r"poll=(\d+)", 1).cast("long")
    return (snaps.join(store.sources(), "id").withColumn("poll", polls)
            .groupBy((F.col("poll") % 7).alias("kind"), "status")
            .agg(F.count_distinct("poll").alias("polls"), F.sum("price_count").alias("price_count")))


#: Parts that the facts of the range query are stored in.
STORED_BATCHES = 3


@query("store_range_prices", ids="SNK-04 FLT-03 STR-03 (date-partitioned facts in batches, one of them replayed, read by a range)", sql="""
SELECT o_orderkey AS snapshot_id, l_suppkey AS station_id, count(*) AS prices,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(10,2))) AS DOUBLE) AS amount
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-03-15 00:00:00' AND TIMESTAMP '1997-02-10 00:00:00'
GROUP BY ALL
""")
def store_range_prices(spark, sf_dir):
    store = PriceStore(spark, f"{work_dir(spark, 'stream-range')}/store", period="month")
    snaps, prices = model.snapshots_o(spark, sf_dir), model.prices_o(spark, sf_dir)
    for batch in [*range(STORED_BATCHES), 1]:        # the second batch comes again, as after a failure
        part = F.pmod("id", F.lit(STORED_BATCHES)) == batch
        own = snaps.where(part)
        store.append_facts(prices.where(F.pmod("snapshot_id", F.lit(STORED_BATCHES)) == batch), own, batch)
        store.append("snapshots", with_price_counts(own, store.read_facts(batch)), batch)
    return (store.published_prices("1996-03-15 00:00:00", "1997-02-10 00:00:00").groupBy("snapshot_id", "station_id")
            .agg(F.count(F.lit(1)).alias("prices"), F.sum("price").alias("amount")))


@query("store_dimension_upserts", ids="UPS-02 STR-01 STR-03 (upserts into hash buckets of a dimension, the last one replayed)", sql="""
WITH st AS (
  SELECT s_suppkey AS id, s_name AS name, s_suppkey || ' Main St' AS adress, n_name AS city, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
first AS (SELECT id, name, CASE id % 4 WHEN 0 THEN 'b1' ELSE city END AS city, region FROM st WHERE id % 2 = 0),
second AS (SELECT (SELECT max(id) FROM first) + row_number() OVER (ORDER BY name, adress) AS id, name, 'b2' AS city, region
           FROM st WHERE id % 4 = 1),
third AS (SELECT (SELECT max(id) FROM second) + row_number() OVER (ORDER BY name, adress) AS id, name, 'b2' AS city, region
          FROM st WHERE id % 4 = 3)
SELECT * FROM first UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third
""")
def store_dimension_upserts(spark, sf_dir):
    store = PriceStore(spark, f"{work_dir(spark, 'stream-dims')}/store")
    stations = model.stations_o(spark, sf_dir).withColumn("dataset", F.lit(FEED_DATASET)).select(
        "id", "dataset", "name", "adress", "city", "region", "longitude", "latitude")
    store.write_dim("stations", stations.where("id % 2 = 0"), 0)
    for version, some in ((1, (0, 1)), (2, (1, 3)), (2, (1, 3))):
        polled = stations.where((F.col("id") % 4).isin(*some)).drop("id").withColumn("city", F.lit(f"b{version}"))
        store.upsert_dim("stations", polled, merge_stations, version)
    return store.read_dim("stations").select("id", "name", "city", "region")


@query("stream_price_moves", ids="OP-03 WIN-01 WIN-02 WIN-03 STR-01 STR-03 (newest moves carried from batch to batch, "
       "late rows in the last one)", sql=E_CTE + MOVES_SQL.format(src="obs_raw", tie="event_id") + "SELECT * FROM report")
def stream_price_moves(spark, sf_dir):
    base = work_dir(spark, "stream-moves")
    raw = model.obs_raw(spark, sf_dir, with_event_id=True)
    middle = raw.agg(F.percentile_approx(F.unix_seconds("fetched_at"), 0.5)).scalar()
    late, old = F.col("event_id") % 20 == 0, F.unix_seconds("fetched_at") < middle
    state = MoveState(PriceStore(spark, f"{base}/store"), tie="event_id")
    for part in (old & ~late, ~old & ~late, late):
        raw.where(part).write.mode("append").parquet(f"{base}/landing")
        (spark.readStream.schema(raw.schema).parquet(f"{base}/landing").writeStream.foreachBatch(state)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return state.report(model.stations_e(spark, sf_dir))
