"""Session settings shared by every job.

Timestamps are interpreted in UTC (the collector stores UTC), adaptive query
execution re-plans joins/aggregations on real sizes, and skewed join
partitions are split at runtime. Scratch output (lineage cuts, derived
feeds, archives written by a job) goes under ``spark.checkpoint.dir``, the
shared folder the cluster names. Where that is unset, a local master (tests, a
laptop) uses a folder of its own, and a cluster raises an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast only below a checked size, with a shuffle join beyond it.
    # Static estimates of joined dimensions are products of their inputs
    # (no CBO statistics), which can make a fact table look like the smaller
    # side; so the static threshold only admits truly tiny inputs and the
    # real decision is AQE's, on measured shuffle sizes.
    "spark.sql.autoBroadcastJoinThreshold": str(1 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on (idempotent)."""
    for key, value in SESSION_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def get_session(master: str | None = None, app: str = "pumpwatch",
                shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with the library's settings; ``shared``: the folder that all machines share."""
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               # checkpoint files are deleted once nothing references them
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if master:
        builder = builder.master(master)
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


#: Shared folder of a local master whose session names none.
LOCAL_SHARED = "file:///tmp/pumpwatch-shared"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all machines share: ``spark.checkpoint.dir`` of the session.

    Created through Hadoop's file system, so it may be in any store Spark
    reaches. A cluster that names no folder is an error: files on one machine
    are neither seen by the others nor outlive it.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = LOCAL_SHARED
        spark.conf.set("spark.checkpoint.dir", base)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def work_dir(spark: SparkSession, name: str = "job") -> str:
    """A new path under the shared folder for one job's output; Spark's writers create it."""
    return f"{ensure_checkpoint_dir(spark)}/pumpwatch/{name}-{uuid.uuid4().hex[:12]}"
