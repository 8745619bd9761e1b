"""Operators over a V1 price history (OP-01 … OP-06).

``prices`` is a DataFrame (station_id, fuel_type, fetched_at, price) —
duplicates and orphan station ids are legal. ``stations`` is
(id, name, city, region).

Scale notes
  * No window is partitioned by (station, fuel): at 100 TB one hot key may
    hold a third of the rows and a key-partitioned window would put it in
    one task. "Latest per key" and "most recent change per key" are written
    as partial aggregates + equi-joins (AQE splits skewed join partitions,
    map-side combine shrinks hot groups before the shuffle).
  * Duplicate rows of one key in adjacent snapshots are never multiplied
    out; pair counts are derived arithmetically (n·m − equal pairs).
  * Scalar steps (latest / previous snapshot time) are scalar subqueries:
    one tiny aggregate job, the value is planned in as a literal.
  * The only broadcasts hold two rows for each snapshot of a change report, up
    to MAX_BROADCAST_ROWS, or are fixed-size dimensions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pumpwatch.functions.scalars import region_label
from pumpwatch.session import ensure_checkpoint_dir

KEY = ["station_id", "fuel_type"]
TS = "fetched_at"
#: Rows of two times and a flag that are broadcast at most (about 3 MB); more are joined by a shuffle.
MAX_BROADCAST_ROWS = 100_000


# ---------------------------------------------------------------- scalars
def latest_ts(prices: DataFrame) -> Column:
    """FLT-07: MAX(fetched_at) as a scalar subquery (NULL on an empty table)."""
    return prices.select(F.max(TS)).scalar()


def previous_ts(prices: DataFrame) -> Column:
    """FLT-08: latest snapshot time strictly before the latest one."""
    return prices.where(F.col(TS) < latest_ts(prices)).select(F.max(TS)).scalar()


def newest_times(prices: DataFrame, n: int = 2) -> list:
    """The ``n`` newest snapshot times, newest first: one aggregate over the time column alone.

    Their number is the caller's, so they come to the driver, where they become
    literals that reach the scan as filters.
    """
    return [r[0] for r in prices.select(TS).where(F.col(TS).isNotNull()).groupBy(TS).agg(F.lit(1))
            .orderBy(F.col(TS).desc()).limit(n).collect()]


# ---------------------------------------------------------------- OP-01
def summary(prices: DataFrame, stations: DataFrame) -> DataFrame:
    """stations, price records, distinct snapshots, first and last snapshot."""
    n_stations = stations.select(F.count(F.lit(1))).scalar()
    return prices.agg(
        F.count(F.lit(1)).alias("prices"),
        F.count_distinct(TS).alias("snapshots"),
        F.min(TS).alias("first_snapshot"),
        F.max(TS).alias("last_snapshot"),
    ).select(n_stations.alias("stations"), "prices", "snapshots",
             "first_snapshot", "last_snapshot")


# ---------------------------------------------------------------- OP-06
def latest_prices(prices: DataFrame, stations: DataFrame, limit: int = 20,
                  at: Column | None = None) -> DataFrame:
    """Cheapest prices of the latest snapshot, all fuels mixed (TOP-01).

    ``at``: the latest snapshot's time where the caller knows it. Filter on the max, inner join to stations (orphans vanish), then a
    top-k (TakeOrderedAndProject: per-partition top-k, one small merge).
    Ties are broken by station name and fuel so the result is deterministic.
    """
    latest = prices.where(F.col(TS) == (latest_ts(prices) if at is None else at))
    st = stations.select(F.col("id").alias("station_id"), "name", "city", "region")
    return (latest.join(st, "station_id")
            .select("name", "city", "region", "fuel_type", "price")
            .orderBy(F.col("price").asc(), F.col("name").asc(), F.col("fuel_type").asc())
            .limit(limit))


# ---------------------------------------------------------------- AGG-04
def stations_per_region(stations: DataFrame) -> DataFrame:
    """GROUP BY region (NULL is its own group) ORDER BY count desc."""
    return (stations.groupBy("region").agg(F.count(F.lit(1)).alias("stations"))
            .orderBy(F.col("stations").desc(), F.col("region").asc_nulls_first()))


# ---------------------------------------------------------------- JOIN-02
def latest_rows(prices: DataFrame) -> DataFrame:
    """Rows at the latest snapshot of their own key, ties kept (JOIN-02/WIN-05).

    max(ts) per key is a partial aggregate; the semi join on (key, ts)
    spreads a hot key over its snapshots.
    """
    mx = prices.groupBy(*KEY).agg(F.max(TS).alias(TS))
    return prices.join(mx, KEY + [TS], "left_semi")


# ---------------------------------------------------------------- AGG-05
def region_fuel_avg(prices: DataFrame, stations: DataFrame) -> DataFrame:
    """ROUND(AVG(latest price), 1) per (region, fuel); orphans dropped."""
    st = stations.select(F.col("id").alias("station_id"),
                         region_label(F.col("region")).alias("region"))
    return (latest_rows(prices).join(st, "station_id")
            .groupBy("region", "fuel_type")
            .agg(F.round(F.avg("price"), 1).cast("double").alias("avg_price")))


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct values of a category column, as names of the columns of a wide report.

    They come to the driver because a plan's columns are made there; reports of
    any number of categories have a long form (``region_fuel_avg``).
    """
    return [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).collect()]


# ---------------------------------------------------------------- OP-05
def region_report(prices: DataFrame, stations: DataFrame,
                  fuels: list[str] | None = None) -> DataFrame:
    """region, station count, one average column per fuel (NULL = no data).

    NULL and '' regions share the label 'N/A' (one row; the reference prints
    two rows that share one average bucket — we normalise first).
    """
    avgs = region_fuel_avg(prices, stations)
    if fuels is None:
        # the (region, fuel) averages are small: materialise them once, then
        # read the column list and the pivot from them — no second pass over
        # the facts just to learn the fuel names
        ensure_checkpoint_dir(avgs.sparkSession)
        avgs = avgs.checkpoint(eager=True)
        fuels = distinct_values(avgs, "fuel_type")
    counts = (stations.groupBy(region_label(F.col("region")).alias("region"))
              .agg(F.count(F.lit(1)).alias("stations")))
    wide = avgs.groupBy("region").pivot("fuel_type", fuels).agg(F.first("avg_price"))
    return (counts.join(wide, "region", "left")
            .select("region", "stations", *[F.col(f"`{f}`") for f in fuels])
            .orderBy(F.col("stations").desc(), F.col("region")))


def region_fuel_map(prices: DataFrame, stations: DataFrame) -> DataFrame:
    """SCL-18: region → {fuel: avg}; one map per region (fuels per region are few)."""
    return (region_fuel_avg(prices, stations).groupBy("region")
            .agg(F.map_from_entries(F.array_sort(F.collect_list(
                F.struct("fuel_type", "avg_price")))).alias("avg_by_fuel")))


# ---------------------------------------------------------------- OP-02 core
def pair_changes(prices: DataFrame, pairs: DataFrame, n_pairs: int = 1) -> DataFrame:
    """Inserts / updates / deletions between snapshot ``t`` and ``prev_t``.

    ``pairs`` (t, prev_t) has ``n_pairs`` rows at most, and is broadcast if they
    are few (MAX_BROADCAST_ROWS). Each fact row is tagged once as
    *current* (its snapshot is a ``t``) and once as *previous* (its snapshot
    is some ``prev_t``), then counted — the n×m fan-out of duplicated keys in
    a left join is computed, not emitted:

      inserts   = n                 if the key is absent before (m = 0)
      updates   = n·m − Σ_v c_v·p_v  (pairs whose prices differ)
      deletions = m                 if the key is absent now (n = 0)
    """
    cur = pairs.select(F.col("t").alias("_s"), F.col("t"), F.lit(1).alias("_cur"))
    prv = (pairs.where(F.col("prev_t").isNotNull())
           .select(F.col("prev_t").alias("_s"), F.col("t"), F.lit(0).alias("_cur")))
    roles = cur.unionByName(prv)
    roles = F.broadcast(roles) if 2 * n_pairs <= MAX_BROADCAST_ROWS else roles
    tagged = prices.join(roles, prices[TS] == roles["_s"]).select(*KEY, "t", "price", "_cur")
    per_value = (tagged.groupBy(*KEY, "t", "price")
                 .agg(F.sum("_cur").alias("c"), F.sum(1 - F.col("_cur")).alias("p")))
    per_key = (per_value.groupBy(*KEY, "t")
               .agg(F.sum("c").alias("n"), F.sum("p").alias("m"),
                    F.sum(F.col("c") * F.col("p")).alias("eq")))
    n, m, eq = F.col("n"), F.col("m"), F.col("eq")
    return (per_key.groupBy("t").agg(
        F.sum(F.when(m == 0, n).otherwise(0)).cast("long").alias("inserts"),
        F.sum(F.when((n > 0) & (m > 0), n * m - eq).otherwise(0)).cast("long").alias("updates"),
        F.sum(F.when(n == 0, m).otherwise(0)).cast("long").alias("deletions")))


def snapshot_counts(prices: DataFrame, limit: int = 11) -> DataFrame:
    """AGG-06: records per snapshot, newest first, the last ``limit``."""
    return (prices.groupBy(TS).agg(F.count(F.lit(1)).alias("records"))
            .orderBy(F.col(TS).desc()).limit(limit))


def snapshot_changes(prices: DataFrame, last: int = 10) -> DataFrame:
    """OP-02: the ``last`` newest snapshots with record count and changes.

    The (last+1)-th snapshot only serves as comparison base; a snapshot with
    no predecessor reports NULL changes (not 0). The pairing of adjacent
    snapshots (WIN-04) runs on the ≤ last+1 row snapshot list only.
    """
    snaps = snapshot_counts(prices, last + 1)
    w = Window.orderBy(F.col(TS).desc())
    listed = snaps.select(TS, "records",
                          F.lead(TS).over(w).alias("prev_t"),
                          F.row_number().over(w).alias("_rn"))
    pairs = listed.select(F.col(TS).alias("t"), "prev_t")
    ch = pair_changes(prices, pairs, last + 1)
    out = listed.join(ch, listed[TS] == ch["t"], "left")
    changes = F.when(F.col("prev_t").isNull(), F.lit(None).cast("long")).otherwise(
        F.coalesce(F.col("inserts"), F.lit(0)) + F.coalesce(F.col("updates"), F.lit(0))
        + F.coalesce(F.col("deletions"), F.lit(0)))
    return (out.where(F.col("_rn") <= last)
            .select(listed[TS].alias(TS), "records", changes.alias("changes"))
            .orderBy(F.col(TS).desc()))


# ---------------------------------------------------------------- OP-04
def latest_pair(prices: DataFrame, times: list | None = None) -> DataFrame:
    """One row (t = latest snapshot, prev_t = the one before it or NULL).

    ``times``: the newest times where the caller knows them."""
    if times is None:
        return prices.agg(F.max(TS).alias("t")).select("t", previous_ts(prices).alias("prev_t"))
    t, prev = ([*times, None, None])[:2]
    return prices.sparkSession.createDataFrame([(t, prev)] if t else [], "t timestamp, prev_t timestamp")


def changed_since_previous(prices: DataFrame, times: list | None = None) -> DataFrame:
    """Number of (station, fuel) pairs whose price differs between the two
    newest snapshots (inner join + ``!=``, duplicates counted pairwise)."""
    ch = pair_changes(prices, latest_pair(prices, times))
    return ch.agg(F.coalesce(F.max("updates"), F.lit(0)).cast("long").alias("changed"))


def vanished_since_previous(prices: DataFrame, times: list | None = None) -> DataFrame:
    """JOIN-04: rows of the previous snapshot whose key is gone in the latest."""
    t, prev = (latest_ts(prices), previous_ts(prices)) if times is None else (
        F.lit(x).cast("timestamp") for x in ([*times, None, None])[:2])
    cur = prices.where(F.col(TS) == t).select(*KEY)
    return prices.where(F.col(TS) == prev).join(cur, KEY, "left_anti").select(*KEY, TS, "price")


# ---------------------------------------------------------------- OP-03
#: A key with more than one in so many of all rows is dealt over parts in the second pass of newest_moves.
HOT_SHARES = 256


def places(prices: DataFrame, tie: str | None = None) -> DataFrame:
    """(key, price, place) of each row; places are in order of (time, ``tie``), without ``tie`` of (time, price)."""
    place = F.struct(F.col(TS).alias("at"), F.col(tie or "price").alias("tie"))
    return prices.select(*KEY, "price", place.alias("place"))


def hot_parts(counts: DataFrame, keys: list[str], rows: str = "_n", shares: int = HOT_SHARES) -> DataFrame:
    """(keys, _parts) of the keys with over 1/``shares`` of all rows: into how many parts to deal
    their rows so that each is as large as the smallest hot key.

    ``counts``: a row a key with its number of ``rows``. Fewer than ``shares`` keys
    can be that frequent, so the result has a proven bound and may be broadcast.
    """
    total = counts.agg(F.sum(rows)).scalar()
    share = F.col(rows).cast("double") * shares / total
    return counts.where(share > 1).select(*keys, F.ceil(share).cast("int").alias("_parts"))


def newest_moves(p: DataFrame) -> DataFrame:
    """(key, origin, old, place, now) of each key's newest move, from (key, price, place).

    No window is partitioned by key. Pass 1 keeps the last place of each (key,
    price): the price at the key's last place is the current one, the last place
    of any other price is where the move began. Pass 2 finds the first row after
    that place. Pass 1 has also counted the rows of each key: those of the few hot
    keys are dealt over parts by their share, joined and aggregated part by part
    and then together; the rows of all other keys stay one part.
    """
    per_price = p.groupBy(*KEY, "price").agg(F.max("place").alias("place"), F.count(F.lit(1)).alias("_n"))
    per_key = per_price.groupBy(*KEY).agg(F.max_by("price", "place").alias("now"), F.sum("_n").alias("_n"))
    hot = F.broadcast(hot_parts(per_key, KEY))
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    origin = (per_price.drop("_n").join(per_key, KEY).where(F.col("price") != F.col("now"))
              .groupBy(*KEY).agg(F.max("place").alias("origin"), F.max_by("price", "place").alias("old"),
                                 F.max("now").alias("now")))
    dealt = origin.join(hot, KEY, "left").select(*KEY, "origin", "old", "now", F.explode(F.sequence(F.lit(0), last)).alias("_part"))
    rows = p.join(hot, KEY, "left").select(*KEY, "place", F.pmod(F.xxhash64("place"), last + 1).cast("int").alias("_part"))
    part = (rows.join(dealt, [*KEY, "_part"]).where(F.col("place") > F.col("origin"))
            .groupBy(*KEY, "_part").agg(F.min("place").alias("place"), F.max("origin").alias("origin"),
                                        F.max("old").alias("old"), F.max("now").alias("now")))
    return part.groupBy(*KEY).agg(F.max("origin").alias("origin"), F.max("old").alias("old"),
                                  F.min("place").alias("place"), F.max("now").alias("now"))


def move_report(moves: DataFrame, stations: DataFrame) -> DataFrame:
    """Moves with their stations; rounding follows SQL ROUND (HALF_UP on DECIMAL), the delta is
    taken from the unrounded prices."""
    st = stations.select(F.col("id").alias("station_id"),
                         F.col("name").alias("station_name"), "city")
    return (moves.join(st, "station_id")
            .select("station_id", "station_name", "city", "fuel_type",
                    F.col("origin.at").alias("prev_fetched_at"), F.col("place.at").alias(TS),
                    F.round("old", 1).cast("double").alias("prev_price"),
                    F.round("now", 1).cast("double").alias("price"),
                    F.round(F.col("now") - F.col("old"), 1).cast("double").alias("delta")))


def price_moves(prices: DataFrame, stations: DataFrame, tie: str | None = None) -> DataFrame:
    """Newest price move of each (station, fuel) (WIN-01..03, PRJ-04).

    The rows of a key are in order of (time, ``tie``); a move is a row whose
    price differs from that of the row before it. ``tie`` names a column that
    orders rows of one snapshot; without one they are ordered by price, so
    duplicate rows always have a defined order. No key with a move is missed.
    """
    return move_report(newest_moves(places(prices, tie)), stations)


def top_rises(moves: DataFrame, n: int = 10) -> DataFrame:
    """TOP-02: biggest rises on the rounded delta (a change rounding to 0.0 is in neither list)."""
    return (moves.where(F.col("delta") > 0)
            .orderBy(F.col("delta").desc(), F.col("station_name"), F.col("fuel_type")).limit(n))


def top_drops(moves: DataFrame, n: int = 10) -> DataFrame:
    return (moves.where(F.col("delta") < 0)
            .orderBy(F.col("delta").asc(), F.col("station_name"), F.col("fuel_type")).limit(n))
