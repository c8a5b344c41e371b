"""File scans and writers for the reference's input formats.

* Wide time-series CSV: fixed metadata columns, then one column per date whose
  header is ``M/d/yy``. The header is read once (a one-row scan), the metadata
  schema is declared, and date columns are typed as double; the scan itself is
  distributed.
* Attribute CSV: every column read as text in a single-byte encoding, cleaned
  later with native expressions.
* GeoJSON boundaries: one multi-line document, exploded to one row per feature.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE_ENCODING = "ISO-8859-1"


def csv_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """Column names from the header line only (no schema inference pass)."""
    return spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path).columns


def read_wide_csv(
    spark: SparkSession,
    path: str,
    meta: T.StructType,
    value_type: T.DataType = T.DoubleType(),
) -> DataFrame:
    """Wide series file: declared metadata fields, then every date column as ``value_type``.

    Columns after the metadata must parse as ``M/d/yy`` dates; anything else is
    an error, so a shifted header fails loudly instead of silently.
    """
    names = csv_header(spark, path)
    meta_names = [f.name for f in meta.fields]
    if names[: len(meta_names)] != meta_names:
        raise ValueError(f"expected leading columns {meta_names}, found {names[: len(meta_names)]}")
    date_names = names[len(meta_names) :]
    for name in date_names:
        datetime.strptime(name, "%m/%d/%y")  # raises on anything else
    schema = T.StructType(list(meta.fields) + [T.StructField(n, value_type, True) for n in date_names])
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def date_columns(df: DataFrame, n_meta: int) -> list[str]:
    """Date-named columns of a wide frame, in file order."""
    return df.columns[n_meta:]


def read_attribute_csv(spark: SparkSession, path: str, encoding: str = ATTRIBUTE_ENCODING) -> DataFrame:
    """Attribute file with every column as text (values hold commas and ``$``)."""
    names = csv_header(spark, path, encoding)
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    return spark.read.option("header", True).option("mode", "FAILFAST").option("encoding", encoding).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """Write with a header (one file per partition) and return ``path``."""
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)
    return path


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON FeatureCollection -> ``(id, geometry_type, geometry)`` per feature."""
    raw = spark.read.option("multiLine", True).json(path)
    feats = raw.select(F.explode("features").alias("f"))
    return feats.select(
        F.col("f.id").cast("string").alias("id"),
        F.col("f.geometry.type").alias("geometry_type"),
        F.to_json(F.col("f.geometry")).alias("geometry"),
    )


def read_boundary_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from one GeoJSON feature a line (a GeoJSON text sequence): such files split,
    so many tasks read them. A collection document is one JSON value and one task."""
    field = lambda p: F.get_json_object("value", f"$.{p}")
    return spark.read.text(path).select(field("id").alias("id"), field("geometry.type").alias("geometry_type"), field("geometry").alias("geometry"))


def write_boundary_lines(boundaries: DataFrame, path: str) -> str:
    """Write ``(id, geometry)`` (GeoJSON text) as one feature a line; returns ``path``."""
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id").cast("string").alias("id")))
    feature = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"geometry":'), "geometry", F.lit("}"))
    boundaries.select(feature.alias("value")).write.text(path)
    return path


__all__ = [
    "ATTRIBUTE_ENCODING",
    "csv_header",
    "date_columns",
    "read_attribute_csv",
    "read_boundaries",
    "read_boundary_lines",
    "read_wide_csv",
    "write_boundary_lines",
    "write_csv",
]
