"""A dataset store laid out as plain parquet folders (no table format needed).

    <root>/stations/v=<n>/bucket=<b>/   the buckets that version n of a dimension wrote anew
    <root>/stations/manifest/v=<n>/     one row: where each bucket of version n is, its schema, the version before
    <root>/stations/current/slot=<0,1>/ the two newest versions; fuels likewise
    <root>/prices/day=<d>/batch=<id>/   facts by their snapshot's date, then by ingest batch
    <root>/snapshots/batch=<id>/  snapshot rows, written LAST

    <root>/sources/batch=<id>/  the files of each snapshot
    <root>/rejects/batch=<id>/  records that belong to no snapshot
    <root>/staged/<name>/       rows of the batch at work, overwritten by the next one

All-or-nothing snapshots (STR-03): a batch writes its facts and dimension
versions first and publishes its snapshot rows last; readers only see facts of
snapshots all of whose rows have the status 'processed'. Replaying a batch
overwrites its own folders (of the facts: its folder under each day it has, by
dynamic partition overwrite), so a retried micro-batch never duplicates rows.
Facts of a range of snapshot times are read from the folders of their days only.

Dimension rows lie in buckets by the hash of their key. An upsert reads and
rewrites the buckets of its keys only; the manifest of the new version names the
older folders of all others, so a reader lists the folders it needs and no other
version. The pointer has two slots and the older one is overwritten, so one is
whole at any time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pumpwatch.model import STATUS_ERROR, STATUS_PROCESSED

FACTS = "snapshot_id long, station_id long, fuel_id long, price decimal(10,2)"
#: Bytes of a row group of staged rows: what a task that writes or reads them holds of them.
STAGED_BYTES = 16 * 1024 * 1024
#: The columns that a dimension's buckets are told by.
DIM_KEYS = {"stations": ("dataset", "name", "adress"), "fuels": ("name",), "moves": ("station_id", "fuel_type")}
MANIFEST = "version long, previous long, buckets int, schema string, entries array<struct<bucket int, v long, top long>>"


class PriceStore:
    def __init__(self, spark: SparkSession, root: str, period: str = "day", buckets: int = 32):
        """``period``: how long a date partition is (day, week, month, year); it is named by its first day.

        ``buckets`` of a dimension, fixed by its first version: choose them so that
        one is a file of usual size. Manifests and lists of paths are as long.
        """
        self.spark = spark
        self.root = root.rstrip("/")
        self.period = period
        self.buckets = buckets

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    # dimensions ---------------------------------------------------------
    def _slots(self, name: str) -> dict[int, int]:
        """slot → version: the two newest versions of a dimension."""
        try:
            rows = self.spark.read.schema("v long, slot int").parquet(f"{self._path(name)}/current").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        return {r.slot: r.v for r in rows}

    def _manifest(self, name: str, before: int | None = None) -> Row | None:
        """The manifest of the newest version (older than ``before`` if given).

        A batch that writes version n asks for the one before it, also on a replay:
        it is in a slot, older ones are found from manifest to manifest.
        """
        read = lambda v: None if v is None else self.spark.read.schema(MANIFEST).parquet(
            f"{self._path(name)}/manifest/v={v}").first()
        versions = self._slots(name).values()
        fitting = [v for v in versions if before is None or v < before]
        found = read(max(fitting) if fitting else min(versions, default=None))
        while found is not None and before is not None and found.version >= before:
            found = read(found.previous)
        return found

    def _bucket(self, name: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*DIM_KEYS[name]), F.lit(buckets)).cast("int").alias("bucket")

    def _read_buckets(self, name: str, manifest: Row | None, schema: T.StructType, chosen: set[int] | None = None) -> DataFrame:
        paths = [] if manifest is None else [
            f"{self._path(name)}/v={e.v}/bucket={e.bucket}" for e in manifest.entries if chosen is None or e.bucket in chosen]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write_version(self, name: str, rows: DataFrame, version: int, base: Row | None, keep: bool) -> DataFrame:
        """Write ``rows`` as version ``version``; with ``keep`` the buckets of ``base`` without such rows stay."""
        schema, buckets = rows.schema, base.buckets if base else self.buckets
        path = f"{self._path(name)}/v={version}"
        (rows.select("*", self._bucket(name, buckets)).hint("rebalance", "bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(path))
        written = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)
        top = F.max("id") if "id" in schema.names else F.lit(None).cast("long")
        tops = written.groupBy("bucket").agg(top.alias("top")).collect()     # a row a bucket
        entries = {e.bucket: (e.bucket, e.v, e.top) for e in base.entries} if keep and base else {}
        entries |= {r.bucket: (r.bucket, version, r.top) for r in tops}
        row = (version, base.version if base else None, buckets, schema.json(), sorted(entries.values()))
        self._write_row([row], MANIFEST, f"{self._path(name)}/manifest/v={version}")
        slots = self._slots(name)
        if version not in slots.values() and (len(slots) < 2 or version > min(slots.values())):
            slot = min(slots, key=slots.get) if len(slots) == 2 else 1 - min(slots, default=1)
            self._write_row([(version,)], "v long", f"{self._path(name)}/current/slot={slot}")
        return written.drop("bucket")

    def _write_row(self, rows: list[tuple], schema: str, path: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)

    def has_dim(self, name: str) -> bool:
        return bool(self._slots(name))

    def write_dim(self, name: str, df: DataFrame, version: int) -> DataFrame:
        """Write a whole dimension as a new version and return it read back (lineage cut)."""
        return self._write_version(name, df, version, self._manifest(name, before=version), keep=False)

    def upsert_dim(self, name: str, incoming: DataFrame, merge: Callable[[DataFrame, DataFrame, int], DataFrame],
                   version: int) -> DataFrame:
        """A new version with ``incoming`` (key columns and any others) merged in.

        ``merge(existing, incoming, next_id)`` gets the rows of the buckets that
        incoming keys fall into and returns what these buckets hold from now on.
        No other bucket is read or written: the next id comes from the manifest.
        Returns the rows of these buckets read back; they hold all incoming keys.
        ``incoming`` is read twice, so it should be cheap (checkpointed).
        """
        base = self._manifest(name, before=version)
        if base is None:
            raise ValueError(f"the store has no version of {name} before {version}")
        touched = {r.bucket for r in incoming.select(self._bucket(name, base.buckets)).distinct().collect()}
        existing = self._read_buckets(name, base, T.StructType.fromJson(json.loads(base.schema)), touched)
        next_id = 1 + max((e.top or 0 for e in base.entries), default=0)
        return self._write_version(name, merge(existing, incoming, next_id), version, base, keep=True)

    def read_dim(self, name: str, before: int | None = None) -> DataFrame:
        """The newest version of a dimension (older than ``before`` if given; empty if there is none).

        The version is fixed now, so a batch that writes version n never reads the
        folders it is overwriting, also on a replay.
        """
        newest = self._manifest(name)
        if newest is None:
            raise ValueError(f"the store has no {name}")
        manifest = newest if before is None or newest.version < before else self._manifest(name, before)
        return self._read_buckets(name, manifest, T.StructType.fromJson(json.loads((manifest or newest).schema)))

    # facts and snapshots -------------------------------------------------
    def append(self, name: str, df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self._path(name)}/batch={batch_id}")

    def stage(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` evaluated once into files and read back, for a batch that goes over it several times.

        Executors keep nothing of it. The next batch overwrites the files.
        """
        path = self._path(f"staged/{name}")
        df.write.mode("overwrite").option("parquet.block.size", STAGED_BYTES).parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def day_of(self, timestamp: Column) -> Column:
        """The date partition of a snapshot's time; a missing time has one of its own."""
        return F.to_date(F.date_trunc(self.period, timestamp))

    def append_facts(self, facts: DataFrame, snaps: DataFrame, batch_id: int) -> None:
        """Facts (snapshot_id, ...) of the snapshots ``snaps`` (id, timestamp) into their date partitions.

        Rows are rebalanced by day, a day of very many rows over several files.
        """
        days = snaps.select(F.col("id").alias("snapshot_id"), self.day_of(F.col("timestamp")).alias("day"))
        dated = facts.join(days, "snapshot_id").withColumn("batch", F.lit(batch_id).cast("long"))
        (dated.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "batch").parquet(self._path("prices")))

    def read_facts(self, batch_id: int | None = None) -> DataFrame:
        """Facts with their partition columns; of one batch: the listing is of its folders alone."""
        path = self._path("prices")
        reader = self.spark.read.schema(f"{FACTS}, day date, batch long").option("basePath", path)
        if batch_id is None:
            return reader.parquet(path)
        try:
            return reader.parquet(f"{path}/day=*/batch={batch_id}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{FACTS}, day date, batch long")    # a batch without facts

    def read_all(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def snapshots(self) -> DataFrame:
        """One row per snapshot, whatever the number of batches its files came in: an error
        with no prices if any part is one, else processed with all its prices."""
        bad = F.max(F.col("status") != STATUS_PROCESSED)
        return (self.read_all("snapshots").groupBy("id")
                .agg(F.max("timestamp").alias("timestamp"), F.max("dataset").alias("dataset"),
                     F.when(bad, F.lit(STATUS_ERROR)).otherwise(F.lit(STATUS_PROCESSED)).alias("status"),
                     F.when(bad, F.lit(0)).otherwise(F.sum("price_count")).cast("long").alias("price_count"))
                .select("id", "timestamp", "status", "dataset", "price_count"))

    def sources(self) -> DataFrame:
        """(id, source_file): the files that each snapshot came from."""
        return self.read_all("sources").select("id", "source_file").distinct()

    def published_prices(self, start=None, end=None) -> DataFrame:
        """Facts of processed (published) snapshots only, those from ``start`` to ``end`` inclusive.

        A snapshot that came in several batches has its rows under the day of each,
        so the first and last such day of the chosen snapshots bound the partitions
        that are read.
        """
        done = self.snapshots().where(F.col("status") == STATUS_PROCESSED)
        facts = self.read_facts()
        if start is not None or end is not None:
            for value, inside in ((start, F.col("timestamp").__ge__), (end, F.col("timestamp").__le__)):
                if value is not None:
                    done = done.where(inside(F.lit(value).cast("timestamp")))
            parts = self.read_all("snapshots").join(done.select("id"), "id", "left_semi")
            first, last = parts.agg(*[f(self.day_of(F.col("timestamp"))) for f in (F.min, F.max)]).first()
            facts = facts.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        return facts.drop("day", "batch").join(done.select(F.col("id").alias("snapshot_id")), "snapshot_id", "left_semi")
