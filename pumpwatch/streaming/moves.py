"""Newest price moves carried along a stream of prices (OP-03 from batch to batch).

The state of a key is its last place and price and its newest move. A batch is
reduced to the same, with its first row: histories that follow each other are
joined by their ends, so the newest move of both together is the batch's own, else
the step from the last price to the batch's first one if they differ, else the
state's. Only a key with rows that are not after its last place (late ones) is
worked out again, from all of its rows.

The state lies in the store in hash buckets by key, one version a batch. Batch n
starts from the version before its own and overwrites its own rows and version, so
a replay gives equal states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pumpwatch.operators import observations as ob
from pumpwatch.session import ensure_checkpoint_dir
from pumpwatch.sinks.store import PriceStore

STATE, ROWS = "moves", "observed"


def summary(rows: DataFrame) -> DataFrame:
    """(key, first, first_price, last, last_price, move) of the rows (key, price, place) of each key."""
    ends = rows.groupBy(*ob.KEY).agg(
        F.min("place").alias("first"), F.min_by("price", "place").alias("first_price"),
        F.max("place").alias("last"), F.max_by("price", "place").alias("last_price"))
    moves = ob.newest_moves(rows).select(*ob.KEY, F.struct("origin", "old", "place", "now").alias("move"))
    return ends.join(moves, ob.KEY, "left")


def follow(state: DataFrame, batch: DataFrame) -> DataFrame:
    """The states after a batch's summaries, with ``late``: whether the two overlap, so the move isn't known."""
    new = batch.select(*ob.KEY, *[F.col(c).alias(f"new_{c}") for c in ("first", "first_price", "last", "last_price", "move")])
    step = F.when(F.col("last_price") != F.col("new_first_price"), F.struct(
        F.col("last").alias("origin"), F.col("last_price").alias("old"),
        F.col("new_first").alias("place"), F.col("new_first_price").alias("now")))
    return state.join(new, ob.KEY, "full_outer").select(
        *ob.KEY, F.coalesce("new_last", "last").alias("last"), F.coalesce("new_last_price", "last_price").alias("last_price"),
        F.coalesce("new_move", step, "move").alias("move"),
        F.coalesce(F.col("new_first") <= F.col("last"), F.lit(False)).alias("late"))


class MoveState:
    """The ``foreachBatch`` body: one micro-batch of prices into the states of its keys.

    Rows without station, fuel, time or price are no observations. ``tie`` as in
    ``price_moves``; rows must have it. Two rows of one place with different
    prices have no order, as there.
    """

    def __init__(self, store: PriceStore, tie: str | None = None):
        self.store, self.tie = store, tie

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = self.store.spark
        ensure_checkpoint_dir(spark)
        found = ob.places(batch.dropna(subset=[*ob.KEY, ob.TS, "price", *([self.tie] if self.tie else [])]), self.tie)
        self.store.append(ROWS, found, batch_id)
        everything = spark.read.schema(T.StructType([*found.schema, T.StructField("batch", T.LongType())])) \
            .parquet(f"{self.store.root}/{ROWS}").where(F.col("batch") <= batch_id)
        new = summary(everything.where(F.col("batch") == batch_id).drop("batch")).checkpoint(eager=True)
        if not self.store.has_dim(STATE):
            self.store.write_dim(STATE, new.select(*ob.KEY, "last", "last_price", "move").limit(0), 0)

        def merge(state: DataFrame, incoming: DataFrame, _: int) -> DataFrame:
            after = follow(state, incoming).checkpoint(eager=True)
            late = after.where("late").select(*ob.KEY)
            known = after.where(~F.col("late")).drop("late")
            if late.isEmpty():
                return known
            again = summary(everything.drop("batch").join(late, ob.KEY, "left_semi"))
            return known.unionByName(again.select(*known.columns))

        self.store.upsert_dim(STATE, new, merge, batch_id + 1)

    def report(self, stations: DataFrame) -> DataFrame:
        """The same as ``price_moves`` of all rows so far."""
        moves = self.store.read_dim(STATE).where(F.col("move").isNotNull()).select(*ob.KEY, "move.*")
        return ob.move_report(moves, stations)
