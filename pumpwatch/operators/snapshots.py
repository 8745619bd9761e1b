"""Choosing snapshots and extracting their prices (OP-07, OP-08, TOP-04..09).

``snapshots`` is the snapshot dimension (id, timestamp, status, dataset);
``prices`` the V2 fact (snapshot_id, station_id, fuel_id, price).

Selection runs on the dimension only. The chosen ids are never collected:
the price extract is a left-semi join of the facts with the selection
DataFrame, so at scale only the (small) id set is broadcast or shuffled and
the fact scan keeps its pushed filters. The only action is a COUNT of the
bucket list, run when a later page must be clamped (as the reference does)
or when a caller reads the totals.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pumpwatch.functions.scalars import ceil_div, clamp, minute_text
from pumpwatch.model import STATUS_PROCESSED
from pumpwatch.operators.observations import MAX_BROADCAST_ROWS
from pumpwatch.operators.selection import FEW, rows_between

# fixed values: calendar bucket modes; anything else falls back to 'latest'
BUCKET_MODES = ("minute", "hour", "day", "week", "month", "year")
LIST_PAGE_SIZE = 50


@dataclass
class Selection:
    """Chosen snapshots (lazy) plus the paging facts shown next to them.

    ``total`` / ``too_many`` / ``total_pages`` are computed on first use (one
    COUNT of the bucket list); a first page needs no count at all.
    """
    snapshots: DataFrame          # id, period
    mode: str
    submode: str
    page: int
    counted: DataFrame            # the rows whose number is ``total``
    max_snapshots: int
    guarded: bool = False         # range mode: empty when over max_snapshots
    _total: int | None = None

    @property
    def total(self) -> int:
        if self._total is None:
            self._total = self.counted.count()
        return self._total

    @property
    def too_many(self) -> bool:
        return self.guarded and self.total > self.max_snapshots

    @property
    def total_pages(self) -> int:
        return 1 if self.guarded else _clamp_page(1, self.total, self.max_snapshots)[1]


def _lit_ts(value: dt.datetime | str | None):
    if value is None:
        return None
    if isinstance(value, str):
        return F.lit(value).try_cast("timestamp")
    return F.lit(value)


def _clamp_page(page: int, total: int, size: int) -> tuple[int, int]:
    pages = max(1, -(-total // size))
    return max(1, min(page, pages)), pages


def select_snapshots(snapshots: DataFrame, dataset: str | None = None, mode: str = "latest",
                     page: int = 1, until=None, start=None, end=None,
                     max_snapshots: int = 100, submode: str = "") -> Selection:
    """OP-07: snapshots to show, by page or by calendar bucket.

    * ``latest``: processed snapshots, newest first, page of ``max_snapshots``.
    * bucket modes: one representative per calendar bucket — the LARGEST ID
      in the bucket (not the latest timestamp); with ``start`` and ``end``
      every bucket in the inclusive range, or nothing plus ``too_many`` when
      there are more than ``max_snapshots``; otherwise buckets up to
      ``until`` (inclusive), paged. Submode 'until' without a date means now.
    Dates are ignored in 'latest'; only one of start/end is ignored.
    """
    base = snapshots.where(F.col("status") == F.lit(STATUS_PROCESSED))
    if dataset is not None:
        base = base.where(F.col("dataset") == F.lit(dataset))
    page = max(1, int(page))

    def paged(rows: DataFrame, order: list[str], mode_: str, submode_: str) -> Selection:
        sel = Selection(rows, mode_, submode_, 1, rows, max_snapshots)
        if page > 1:   # only a later page needs the total to be clamped
            sel.page = _clamp_page(page, sel.total, max_snapshots)[0]
        first = (sel.page - 1) * max_snapshots
        sel.snapshots = (rows.orderBy(*[F.col(c).desc() for c in order]).limit(max_snapshots) if not first else
                         rows_between(rows, [(c, True) for c in order], first, first + max_snapshots, sel.total)
                         ).select("id", "period")
        return sel

    if mode not in BUCKET_MODES:
        rows = base.select("id", F.col("timestamp").alias("period"))
        return paged(rows, ["period", "id"], "latest", "page")

    def buckets(df: DataFrame) -> DataFrame:
        return (df.groupBy(F.date_trunc(mode, F.col("timestamp")).alias("period"))
                .agg(F.max("id").alias("id")))

    if start is not None and end is not None:
        ranged = base.where(F.col("timestamp").between(_lit_ts(start), _lit_ts(end)))
        b = buckets(ranged)
        # the guard is a scalar subquery: nothing leaves the cluster
        guarded = b.where(b.select(F.count(F.lit(1))).scalar() <= F.lit(max_snapshots))
        return Selection(guarded.select("id", "period"), mode, "range", 1, b, max_snapshots,
                         guarded=True)

    if submode == "until" and until is None:
        until = dt.datetime.now(dt.timezone.utc)
    if until is not None:
        base = base.where(F.col("timestamp") <= _lit_ts(until))
    return paged(buckets(base), ["period"], mode,
                 "until" if until is not None else "page")


def paging_facts(snapshots: DataFrame, registry: DataFrame, page: int) -> DataFrame:
    """TOP-05 / SCL-10 for every dataset at once: processed snapshots, pages =
    ceil(total / max_snapshots) or 1, the requested page clamped to [1, pages]
    and its row offset. One partial aggregate, joined to the (small) registry."""
    totals = (snapshots.where(F.col("status") == F.lit(STATUS_PROCESSED))
              .groupBy(F.col("dataset").alias("name")).agg(F.count(F.lit(1)).alias("total")))
    reg = registry.select("name", "max_snapshots").join(totals, "name", "left")
    total = F.coalesce(F.col("total"), F.lit(0)).cast("long")
    pages = F.greatest(ceil_div(total, F.col("max_snapshots")), F.lit(1)).cast("long")
    pg = clamp(F.lit(page).cast("long"), F.lit(1).cast("long"), pages)
    return reg.select(F.col("name").alias("dataset"), total.alias("total"),
                      pages.alias("total_pages"), pg.alias("page"),
                      ((pg - 1) * F.col("max_snapshots")).cast("long").alias("offset"))


def latest_snapshots(snapshots: DataFrame, dataset: str | None = None, n: int = 5) -> DataFrame:
    """TOP-04: the n newest snapshots of a dataset, any status."""
    s = snapshots if dataset is None else snapshots.where(F.col("dataset") == F.lit(dataset))
    return s.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def lookahead_page(snapshots: DataFrame, dataset: str | None = None, page: int = 1,
                   size: int = LIST_PAGE_SIZE) -> DataFrame:
    """TOP-06: ``size`` rows of a page; ``has_next`` tells whether there is one more.

    The first pages need no COUNT. A page beyond the first FEW rows is sought by
    counts of value ranges. The window below runs on at most size+1 rows.
    """
    s = snapshots if dataset is None else snapshots.where(F.col("dataset") == F.lit(dataset))
    page = max(1, int(page))
    first = (page - 1) * size
    rows = rows_between(s, [("timestamp", True), ("id", True)], first, first + size + 1,
                        total=first + size + 1 if first + size < FEW else None)
    w = Window.orderBy(F.col("timestamp").desc(), F.col("id").desc())
    numbered = rows.select("*", F.row_number().over(w).alias("_rn"),
                           F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    return (numbered.where(F.col("_rn") <= size)
            .select(*[c for c in s.columns], (F.col("_n") > size).alias("has_next")))


def keyset_page(snapshots: DataFrame, after_ts=None, after_id=None,
                size: int = LIST_PAGE_SIZE) -> DataFrame:
    """Deep pages without OFFSET: rows strictly after (ts, id) in (ts desc, id desc)."""
    s = snapshots
    if after_ts is not None:
        t, i = _lit_ts(after_ts), F.lit(after_id)
        s = s.where((F.col("timestamp") < t) | ((F.col("timestamp") == t) & (F.col("id") < i)))
    return s.orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(size)


# ------------------------------------------------------------------ OP-08
def star(prices: DataFrame, stations: DataFrame, fuels: DataFrame,
         snapshots: DataFrame) -> DataFrame:
    """JOIN-06: price ⋈ station ⋈ fuel ⋈ snapshot (inner; FKs are NOT NULL).

    Dimensions join on their keys; the planner broadcasts those whose size
    estimate is under the threshold and shuffle-joins the rest (AQE may
    still switch to broadcast on measured sizes).
    """
    st = stations.select(F.col("id").alias("station_id"), F.col("name").alias("station"),
                         "city", "region")
    fu = fuels.select(F.col("id").alias("fuel_id"), F.col("name").alias("fuel"))
    sn = snapshots.select(F.col("id").alias("snapshot_id"), F.col("timestamp").alias("snapshot_ts"))
    return prices.join(st, "station_id").join(fu, "fuel_id").join(sn, "snapshot_id")


def flat_records(starred: DataFrame, price_as_double: bool = True) -> DataFrame:
    """PRJ-02: Station, City, Region, Fuel, Price (float), Snapshot ('yyyy-MM-dd HH:mm').

    ``price_as_double=False`` keeps the exact DECIMAL for aggregation (pivots).
    """
    price = F.col("price").cast("double") if price_as_double else F.col("price")
    return starred.select(F.col("station").alias("Station"), F.col("city").alias("City"),
                          F.col("region").alias("Region"), F.col("fuel").alias("Fuel"),
                          price.alias("Price"),
                          minute_text(F.col("snapshot_ts")).alias("Snapshot"))


def price_extract(selection: Selection, prices: DataFrame, stations: DataFrame,
                  fuels: DataFrame, snapshots: DataFrame, station_id: int | None = None,
                  price_as_double: bool = True, ordered: bool = True) -> DataFrame:
    """OP-08: flat price records of the chosen snapshots; too many → no rows.

    Ordered by region, city, station (one station: newest snapshot first).
    """
    facts = prices
    if station_id is not None:
        facts = facts.where(F.col("station_id") == F.lit(station_id))
    # too many buckets → the guarded selection is empty → no rows, no extra job
    ids = selection.snapshots.select(F.col("id").alias("snapshot_id"))
    ids = F.broadcast(ids) if selection.max_snapshots <= MAX_BROADCAST_ROWS else ids
    chosen = facts.join(ids, "snapshot_id", "left_semi")
    rec = flat_records(star(chosen, stations, fuels, snapshots), price_as_double)
    if not ordered:
        return rec
    if station_id is not None:
        return rec.orderBy(F.col("Snapshot").desc(), "Fuel", "Price")
    return rec.orderBy("Region", "City", "Station", "Snapshot", "Fuel", "Price")


def prices_of_snapshot(prices: DataFrame, stations: DataFrame, fuels: DataFrame,
                       snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    """Snapshot detail listing: every price of one snapshot (pushed filter)."""
    one = prices.where(F.col("snapshot_id") == F.lit(snapshot_id))
    return flat_records(star(one, stations, fuels, snapshots))
