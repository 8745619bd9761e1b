"""SRC-05 / SRC-06: table scans and per-dataset extracts.

Parquet scans keep Catalyst's column pruning and filter pushdown: callers
select and filter on the returned DataFrame and the scan only reads what is
used (``ReadSchema`` / ``PushedFilters`` in ``explain``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


# fixed values: columns of the tables that prices are bound to; a given schema spares a look at a footer
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of an input table; each query plans its own pruned scan."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal rows evenly over ``partitions`` (the session's shuffle partitions).

    For work that is heavy per row behind an input that can't be split (a gzip
    file, one row group). It always shuffles: the caller decides by the kind of
    input, not by its size. Call it on the projected columns, after filters.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n)


#: Rows of a dimension (ids and short texts, about 150 bytes each) that are broadcast at most.
MAX_BROADCAST_ROWS = 500_000


def broadcast_few(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, so that the other side of a join stays where it is.

    AQE learns the size of a side by shuffling both, which for a fact table is a
    pass over the disk. The count reads the dimension only.
    """
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def dataset_extract(facts: DataFrame, snapshots: DataFrame, dataset: str,
                    dataset_col: str = "dataset") -> DataFrame:
    """Prices whose snapshot belongs to one dataset (SRC-06, JOIN-07).

    ``IN (subquery)`` as a left-semi join: only snapshot ids travel, the
    fact side is never widened; the planner broadcasts the id side only when
    its size estimate is under the threshold.
    """
    ids = snapshots.where(F.col(dataset_col) == F.lit(dataset)).select(
        F.col("id").alias("snapshot_id"))
    return facts.join(ids, "snapshot_id", "left_semi")
