"""Sinks: record JSON, CSV extract, fact append (SNK-02, SNK-04, SNK-05).

All writers are partition-parallel; none funnels rows through one task
except where a single small file is the product (pivot CSV, see
``operators.pivot.write_pivot_csv``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_records(records: DataFrame, path: str) -> str:
    """SNK-02: flat records as JSON lines (the API's ``{"data": [...]}`` body,
    one record per line so it can be written and read in parallel)."""
    records.write.mode("overwrite").json(path)
    return path


def write_csv_extract(records: DataFrame, path: str) -> str:
    """SNK-05: a CSV extract with a header line, written by many tasks."""
    records.write.mode("overwrite").option("header", True).csv(path)
    return path


def append_prices(prices: DataFrame, root: str, batch_id: int | str,
                  ts_col: str | None = None) -> str:
    """SNK-04: append fact rows for one batch, no dedup.

    A batch lands in its own ``batch=<id>`` folder and overwrites it on a
    replay, so re-running a failed micro-batch never duplicates rows. When a
    time column is named the rows are also partitioned by its date, so time
    filters prune whole folders.
    """
    out = f"{root.rstrip('/')}/batch={batch_id}"
    w = prices
    if ts_col:
        w = w.withColumn("snapshot_date", F.to_date(F.col(ts_col)))
        w.write.mode("overwrite").partitionBy("snapshot_date").parquet(out)
    else:
        w.write.mode("overwrite").parquet(out)
    return out
