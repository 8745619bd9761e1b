"""Newest times of a fact table from its Parquet footers.

The v2 reader answers MIN and MAX from footers, read by tasks, where no row is
touched. It does so for whole numbers only, so a time column is read as its
microseconds. What footers say is a first guess of where to look: the newest
times themselves are then read with a filter from that place on, which prunes
all older row groups, and the place moves back until enough are found.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPOCH = dt.datetime(1970, 1, 1)


#: The session with the settings below beside each session; making one takes as long as a small query.
_BESIDE: WeakKeyDictionary = WeakKeyDictionary()


def _beside(spark: SparkSession) -> SparkSession:
    own = _BESIDE.get(spark)
    if own is not None:
        return own
    own = _BESIDE[spark] = spark.newSession()
    v1 = spark.conf.get("spark.sql.sources.useV1SourceList")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in v1.split(",") if x.strip() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own


def footer_aggregate(spark: SparkSession, path: str, column: str, schema: str | None = None) -> DataFrame:
    """MIN and MAX of a time column in microseconds, answered from footers.

    Spark finds a column's statistics by its place, so ``schema`` has all columns
    of the files in their order; it is read from them if not given.
    """
    own = _beside(spark)
    known = T.StructType.fromDDL(schema) if schema else own.read.parquet(path).schema
    fields = [T.StructField(f.name, T.LongType() if f.name == column else f.dataType) for f in known.fields]
    return own.read.schema(T.StructType(fields)).parquet(path).select(
        F.min(column).alias("low"), F.max(column).alias("high"))


def footer_range(spark: SparkSession, path: str, column: str, schema: str | None = None) -> tuple[dt.datetime, dt.datetime] | None:
    """First and last time by the footers, None for an empty table or files without statistics."""
    try:
        low, high = footer_aggregate(spark, path, column, schema).first()
    except PySparkException:        # no statistics in some file
        return None
    try:
        return None if high is None else (EPOCH + dt.timedelta(microseconds=low), EPOCH + dt.timedelta(microseconds=high))
    except OverflowError:           # not a time
        return None


def newest_periods(find: Callable[[dt.datetime | None], list], known: tuple[dt.datetime, dt.datetime] | None,
                   period: Callable[[dt.datetime], dt.datetime], length: dt.timedelta, n: int) -> list:
    """The ``n`` newest periods with rows, newest first.

    ``find(since)`` reads them among the rows from ``since`` on (None: among all),
    ``period`` is the beginning of a time's period and ``length`` how long one is.
    Rows from a period's beginning on hold all newer ones, so ``n`` of them are
    the newest wherever the search began; it goes back in growing steps.
    """
    back = n
    while known:
        since = period(known[1]) - (back - 1) * length
        found = find(since)
        if len(found) >= n:
            return found
        if since <= known[0]:
            break
        back *= 4
    return find(None)
