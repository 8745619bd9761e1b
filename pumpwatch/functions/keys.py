"""Dense surrogate ids without a single-partition window.

``row_number() OVER (ORDER BY key)`` would pull every row into one task.
Instead: range-partition by the order key (balanced by sampling), sort inside
each partition, number the rows by their position (``monotonically_increasing_id``
minus ``partition_id << 33`` — no second shuffle, no window), and add the
partition's offset — the running total of the per-partition counts, a table
of one row per partition (bounded by the partition count, so broadcasting it
is safe).

Range bounds come from sampling, so two evaluations of the same plan may cut
partitions differently. The numbered rows are therefore checkpointed (to the
shared ``spark.checkpoint.dir``) before the offsets are computed: row numbers
and offsets come from one partitioning, and every later use of the ids reads
the same materialised rows (also after a lost executor).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pumpwatch.session import ensure_checkpoint_dir


def assign_ids(df: DataFrame, order_by: list[str], start: int | None = 1,
               start_col=None, id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start + position of the row in ``order_by`` order (0-based).

    ``start_col`` may be a scalar Column (e.g. a scalar subquery ``max(id)+1``)
    instead of a Python int.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{c}`") for c in order_by]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    pid = F.spark_partition_id()
    ensure_checkpoint_dir(spark)
    numbered = ranged.select(
        "*", pid.alias("_pid"),
        (F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)).alias("_rn")
    ).checkpoint(eager=True)
    counts = numbered.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_pid", (F.sum("_cnt").over(Window.orderBy("_pid")) - F.col("_cnt")).alias("_off"))
    base = start_col if start_col is not None else F.lit(start)
    return (numbered.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (base + F.col("_off") + F.col("_rn")).cast("long"))
            .drop("_pid", "_rn", "_off"))
