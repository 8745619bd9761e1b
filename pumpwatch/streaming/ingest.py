"""Structured Streaming ingest of feed polls (STR-01 … STR-04).

The landing folder receives feed files; the file source picks up new files
per trigger and ``foreachBatch`` runs the batch ``populate`` on them:

* ``documents``: one FeatureCollection per file = one snapshot (gzip or plain).
* ``sequence``: GeoJSON text sequences, one Feature per line carrying its
  ``snapshot`` id; splittable, for polls too large for one task.
* ``collections``: one FeatureCollection per line, its ``snapshot`` id written
  first; a poll may span several lines.

In every layout a record that does not parse, or does not fit the schema,
makes its snapshot an ``error``, the other snapshots are processed (STR-02). A
document without ``features`` is an empty poll. A corrupt line is matched with
its snapshot by its raw text; lines whose snapshot can't be read go to the
``rejects`` table with their file, so none is lost without a trace.

Per micro-batch: records parsed and staged as files → dimension upserts written as a new version of the buckets they touch → facts appended
to ``prices/day=<d>/batch=<id>`` → snapshot rows published last (STR-03). The batch
id makes a replay overwrite its own output (idempotent). A poll whose files
arrive in several batches has a row in each; the store reads them as one
snapshot, an error if any of its parts is. The stream's checkpoint and the
store live under the shared checkpoint folder. ``trigger(availableNow=True)``
runs the same job once (STR-04); a processing-time trigger runs it every
``update_frequency`` minutes (STR-01).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pumpwatch.functions.keys import assign_ids
from pumpwatch.model import STATUS_ERROR, STATUS_PROCESSED
from pumpwatch.operators import ingest as ig
from pumpwatch.operators.counts import with_price_counts
from pumpwatch.session import ensure_checkpoint_dir
from pumpwatch.sinks.store import PriceStore
from pumpwatch.sources import feed as fd
from pumpwatch.sources.tables import broadcast_few

# snapshot ids of document polls: batch id in the high 32 bits, then the file's rank
BATCH_BITS = 32
REJECT_SCHEMA = "source_file string, raw string"


def read_landing(spark: SparkSession, landing: str, layout: str = "documents",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    schemas = {"documents": fd.FEED, "sequence": fd.FEATURE_LINE, "collections": fd.COLLECTION}
    if layout not in schemas:
        raise ValueError(f"unknown landing layout {layout!r}")
    reader = spark.readStream.option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = (reader.schema(schemas[layout]).option("multiLine", layout == "documents")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(landing))
    return with_source(rows, layout)


def with_source(rows: DataFrame, layout: str) -> DataFrame:
    """Which file a record is from, and from which split of it."""
    out = rows.select("*", F.col("_metadata.file_path").alias("source_file"),
                      F.col("_metadata.file_modification_time").alias("polled_at"),
                      F.col("_metadata.file_block_start").alias("_block"))
    if layout != "documents":
        out = out.withColumn("snapshot", F.coalesce("snapshot", fd.raw_snapshot(F.col("_corrupt_record"))))
    return out


class FeedBatch:
    """The ``foreachBatch`` body: one micro-batch of polls into the store."""

    def __init__(self, store: PriceStore, dataset: str, layout: str = "documents"):
        self.store, self.dataset, self.layout = store, dataset, layout

    def records(self, batch: DataFrame) -> DataFrame:
        """A narrow row for each feature of a batch, and one (no ``_item``) for a record without any."""
        # the place of a record in its split; a batch is a plain DataFrame, so rows can be numbered
        batch = batch.withColumn("_line", F.monotonically_increasing_id())
        known = [] if self.layout == "documents" else ["snapshot"]
        keep = [*known, "source_file", "polled_at", "_block", "_line", F.col("_corrupt_record").isNotNull().alias("_bad")]
        if known:
            keep.append(F.when(F.col("snapshot").isNull(), F.col("_corrupt_record")).alias("raw"))
        if self.layout == "sequence":
            rows = batch.select(*keep, F.lit(0).alias("_item"), "geometry", "properties")
        else:
            rows = batch.select(*keep, F.posexplode_outer("features").alias("_item", "f")).select("*", "f.geometry", "f.properties").drop("f")
        return fd.flatten_features(rows)

    def snapshots_and_features(self, batch: DataFrame, batch_id: int
                               ) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.polls(self.records(batch), batch_id)

    def polls(self, records: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Snapshots, features of the good ones and files of each, out of ``records``."""
        ensure_checkpoint_dir(records.sparkSession)
        if self.layout == "documents":
            # one snapshot per file, ranked by name: distributed numbering, any number of files
            ranks = assign_ids(records.select("source_file").distinct(), ["source_file"],
                               start=(batch_id << BATCH_BITS) + 1, id_col="snapshot")
            records = records.join(broadcast_few(ranks), "source_file")
        known = records.where(F.col("snapshot").isNotNull())
        snaps = (known.groupBy(F.col("snapshot").alias("id"))
                 .agg(F.max("polled_at").alias("timestamp"), F.max("_bad").alias("_bad"))
                 .select("id", "timestamp",
                         F.when(F.col("_bad"), F.lit(STATUS_ERROR))
                         .otherwise(F.lit(STATUS_PROCESSED)).alias("status"),
                         F.lit(self.dataset).alias("dataset")).checkpoint(eager=True))
        # the features go past the ids of the bad polls, few as a rule, and stay where they are
        bad = snaps.where(F.col("status") == STATUS_ERROR).select(F.col("id").alias("snapshot"))
        feats = known.where(F.col("_item").isNotNull())     # missing features: an empty poll
        good = feats if bad.isEmpty() else feats.join(broadcast_few(bad), "snapshot", "left_anti")
        place = [F.col(c) for c in ("source_file", "_block", "_line", "_item")]
        flat = good.select("snapshot", F.struct(*place).alias("pos"), "Name", "Address", "Region", "Prices", "longitude", "latitude")
        sources = known.select(F.col("snapshot").alias("id"), "source_file").distinct()
        return snaps, flat, sources

    def rejects(self, records: DataFrame) -> DataFrame:
        """Records whose snapshot can't be told."""
        if self.layout == "documents":
            return records.sparkSession.createDataFrame([], REJECT_SCHEMA)
        first = F.coalesce(F.col("_item"), F.lit(0)) == 0     # one row a record
        return records.where(F.col("snapshot").isNull() & first).select("source_file", "raw")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        # parsed once, and read from files by each step: cached rows that don't fit in memory come back
        # a whole block at a time, outside of Spark's account, and end the executor
        records = self.store.stage("records", self.records(batch))
        snaps, flat, sources = self.polls(records, batch_id)
        version = batch_id + 1
        # only the buckets of this batch's keys are read and rewritten; they hold all it resolves to
        stations = self.store.upsert_dim(
            "stations", ig.station_updates(flat, self.dataset).checkpoint(eager=True), ig.merge_stations, version)
        fuels = self.store.upsert_dim(
            "fuels", ig.fuel_names(flat).checkpoint(eager=True),
            lambda old, names, first: ig.get_or_create_fuels(old, names.withColumnRenamed("name", "fuel"), first), version)
        prices = ig.resolve_prices(flat, self.dataset, stations, fuels)
        self.store.append_facts(prices, snaps, batch_id)
        published = self.store.read_facts(batch_id).drop("day", "batch")
        self.store.append("sources", sources, batch_id)
        self.store.append("rejects", self.rejects(records), batch_id)
        self.store.append("snapshots", with_price_counts(snaps, published), batch_id)


def start_ingest(spark: SparkSession, landing: str, store: PriceStore, dataset: str,
                 checkpoint: str, layout: str = "documents", available_now: bool = True,
                 every_minutes: float = 5, max_files_per_trigger: int | None = None):
    stream = read_landing(spark, landing, layout, max_files_per_trigger)
    writer = (stream.writeStream.foreachBatch(FeedBatch(store, dataset, layout))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        # every ``update_frequency`` minutes (fractions allowed, at least 1 s)
        writer = writer.trigger(processingTime=f"{max(1, round(every_minutes * 60))} seconds")
    return writer.start()
