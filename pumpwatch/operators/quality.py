"""Data quality, dataset profile and storage attribution (AGG-15, AGG-16,
FLT-11, SRC-07, SRC-08, OP-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: plausible coordinates of the feed's stations (Quebec)
LON_MIN, LON_MAX = -80.0, -56.0
LAT_MIN, LAT_MAX = 44.0, 63.0


def feature_rules() -> dict[str, Column]:
    """Rule name → predicate that must hold for a flattened feed feature."""
    lon, lat, name = F.col("longitude"), F.col("latitude"), F.col("Name")
    return {
        "coordinates_present": lon.isNotNull() & lat.isNotNull(),
        "longitude_in_bounds": lon.between(LON_MIN, LON_MAX),
        "latitude_in_bounds": lat.between(LAT_MIN, LAT_MAX),
        "name_non_empty": name.isNotNull() & (F.length(name) > 0),
        "prices_present": F.col("Prices").isNotNull(),
    }


def dq_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """AGG-16: one pass, one ``count_if`` per rule, stacked to (rule, checked, failed).

    A NULL predicate counts as a failure (the reference's ``.all()`` on NaN).
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    names = list(rules)
    for i, r in enumerate(names):
        aggs.append(F.count_if(~F.coalesce(rules[r], F.lit(False))).alias(f"_f{i}"))
    wide = df.agg(*aggs)
    stacked = ", ".join(f"'{r}', _f{i}" for i, r in enumerate(names))
    return wide.selectExpr(f"stack({len(names)}, {stacked}) as (rule, failed)", "_n as checked") \
        .select("rule", F.col("checked").cast("long"), F.col("failed").cast("long"))


def missing_timestamps(snapshots: DataFrame, samples: int = 3) -> DataFrame:
    """FLT-11: how many snapshots lack a timestamp, with up to ``samples`` examples."""
    missing = snapshots.where(F.col("timestamp").isNull())
    total = missing.select(F.count(F.lit(1))).scalar()
    return missing.orderBy("id").limit(samples).select("*", total.alias("missing_total"))


def dataset_profile(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """SRC-07: per table (name order) row count and columns with type and nullability.

    Schemas are metadata (driver-side); row counts are one aggregate per table.
    """
    parts = []
    for tname in sorted(tables):
        df = tables[tname]
        cols = [(tname, i, f.name, f.dataType.simpleString(), f.nullable)
                for i, f in enumerate(df.schema.fields)]
        meta = spark.createDataFrame(
            cols, "table string, position int, column string, data_type string, nullable boolean")
        parts.append(meta.select("*", df.select(F.count(F.lit(1))).scalar().alias("rows")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stored_bytes(spark: SparkSession, path: str) -> Column:
    """SRC-08: bytes of the files under a path (scalar subquery), from their listing alone:
    no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.coalesce(F.sum("length"), F.lit(0))).scalar()


def attribute(tables: DataFrame) -> DataFrame:
    """AGG-15 / OP-10: bytes of each table attributed to one dataset, and their total.

    ``tables``: (label, own_rows, total_rows, table_bytes), a row a table.
    estimated = floor(bytes × own / total), ratio 0 for an empty table; the
    last row is the sum of the truncated parts.
    """
    ratio = F.when(F.col("total_rows") > 0, F.col("own_rows").cast("double") / F.col("total_rows")).otherwise(F.lit(0.0))
    each = tables.select("label", F.col("own_rows").cast("long"), F.col("total_rows").cast("long"),
                         F.col("table_bytes").cast("long"),
                         F.floor(F.col("table_bytes").cast("double") * ratio).cast("long").alias("estimated_bytes"))
    none = F.lit(None).cast("long")
    total = each.agg(F.lit("Total").alias("label"), none.alias("own_rows"), none.alias("total_rows"),
                     F.sum("table_bytes").cast("long").alias("table_bytes"),
                     F.sum("estimated_bytes").cast("long").alias("estimated_bytes"))
    return each.unionByName(total)
