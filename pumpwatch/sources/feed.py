"""SRC-01 / SRC-02 / PRJ-01: the GeoJSON price feed.

A feed poll is a FeatureCollection; every feature is a station with its
coordinates and a ``Prices`` array. Three layouts are read:

* one FeatureCollection document per file (what the feed serves; gzip or
  plain — Spark picks the codec from the file suffix). Each file is one
  snapshot and one row; a bad file becomes a row with ``features`` NULL and
  the raw text in ``_corrupt_record`` (the snapshot is then an error).
* GeoJSON text sequences: one Feature per line. Splittable, so a very large
  poll is parsed by many tasks instead of one.
* poll collections: one FeatureCollection per line with its ``snapshot`` id
  written first, so a corrupt line still names its poll.

Explicit schemas — no inference pass over the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_ENTRY = T.StructType([
    T.StructField("GasType", T.StringType()),
    T.StructField("Price", T.StringType()),       # "199.9¢"; a JSON number is kept as text
    T.StructField("IsAvailable", T.BooleanType()),
])

PROPERTIES = T.StructType([
    T.StructField("Name", T.StringType()),
    T.StructField("Address", T.StringType()),
    T.StructField("Region", T.StringType()),
    T.StructField("Prices", T.ArrayType(PRICE_ENTRY)),
])

FEATURE = T.StructType([
    T.StructField("geometry", T.StructType([
        T.StructField("coordinates", T.ArrayType(T.DoubleType()))])),
    T.StructField("properties", PROPERTIES),
    # landing convention for sequences: the poll a feature belongs to
    T.StructField("snapshot", T.LongType()),
])

FEED = T.StructType([
    T.StructField("features", T.ArrayType(FEATURE)),
    T.StructField("_corrupt_record", T.StringType()),
])

# one poll document per line, its snapshot id written first (landing convention)
COLLECTION = T.StructType([
    T.StructField("snapshot", T.LongType()),
    T.StructField("features", T.ArrayType(FEATURE)),
    T.StructField("_corrupt_record", T.StringType()),
])


# one feature per line with its snapshot id; a line that doesn't fit keeps its text
FEATURE_LINE = T.StructType([*FEATURE.fields, T.StructField("_corrupt_record", T.StringType())])


def raw_snapshot(raw: Column) -> Column:
    """Snapshot id in the raw text of a record that doesn't parse, NULL if there is none."""
    return F.regexp_extract(raw, r'"snapshot"\s*:\s*(\d+)\s*[,}]', 1).try_cast("long")


def read_feed_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per feed file: (source_file, features, _corrupt_record)."""
    return (spark.read.schema(FEED).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
            .select(F.col("_metadata.file_path").alias("source_file"), "features",
                    "_corrupt_record"))


def features_of_documents(docs: DataFrame) -> DataFrame:
    """Explode the documents into features (missing ``features`` → no rows)."""
    return docs.select("source_file", F.posexplode("features").alias("pos", "f")).select(
        "source_file", "pos", "f.*")


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON text sequence: one Feature per line, read with the feature schema."""
    return (spark.read.schema(FEATURE).option("mode", "PERMISSIVE").json(path)
            .withColumn("source_file", F.col("_metadata.file_path")))


def parse_feature_text(df: DataFrame, text_col: str = "value") -> DataFrame:
    """Feature JSON held in a string column → feature struct columns."""
    return df.select("*", F.from_json(F.col(text_col), FEATURE).alias("_f")).select(
        *[c for c in df.columns if c != text_col], "_f.*")


def flatten_features(features: DataFrame) -> DataFrame:
    """PRJ-01 / SCL-17: properties splatted + longitude = coords[0], latitude = coords[1].

    Missing geometry or a short coordinates array gives NULL coordinates
    (the reference raises on an empty array — deliberate deviation).
    """
    coords = F.col("geometry.coordinates")
    keep = [c for c in features.columns if c not in ("geometry", "properties")]
    return features.select(*keep, "properties.*",
                           F.try_element_at(coords, F.lit(1)).alias("longitude"),
                           F.try_element_at(coords, F.lit(2)).alias("latitude"))


def feature_json(name: Column, address: Column, region: Column, lon: Column, lat: Column,
                 prices: Column, snapshot: Column | None = None) -> Column:
    """Encode one Feature as JSON text (SCL-19) — used by writers and fixtures."""
    fields = [F.lit("Feature").alias("type"),
              F.struct(F.lit("Point").alias("type"),
                       F.array(lon.cast("double"), lat.cast("double")).alias("coordinates")
                       ).alias("geometry"),
              F.struct(name.alias("Name"), address.alias("Address"), region.alias("Region"),
                       prices.alias("Prices")).alias("properties")]
    if snapshot is not None:
        fields.append(snapshot.alias("snapshot"))
    return F.to_json(F.struct(*fields))
