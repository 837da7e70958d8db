"""GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.functions.text import parse_address
from placebook.sources import json_items
from placebook.sources.rows import as_records


class NotFeatureCollection(ValueError):
    """The document has no array of features."""


def _number(path: str) -> str:
    """SQL for a coordinate: a JSON number, or 0 for anything else."""
    kind = f"schema_of_variant(variant_get(c, '{path}'))"
    return f"if({kind} rlike '^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$', try_variant_get(c, '{path}', 'double'), 0D)"


def _whole(spark: SparkSession, path: str) -> DataFrame:
    """The features of documents that are read as one row each."""
    docs = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"), F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_block"))
    arrays = docs.withColumn("_ok", F.expr("coalesce(schema_of_variant(variant_get(v, '$.features')) like 'ARRAY%', false)"))
    if not arrays.filter("not _ok").isEmpty():
        raise NotFeatureCollection(path)
    arrays.createOrReplaceTempView("_geojson")
    features = spark.sql("select _file, _block, 0L as _row, f.pos as _pos, f.value as f from _geojson, lateral variant_explode(variant_get(v, '$.features')) f")
    spark.catalog.dropTempView("_geojson")
    return features


def read(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Records of GeoJSON documents, one document a file, in the order of their features; a file of more than one split is read in splits.

    The text is the property ``address`` if that key exists, else ``name``, and must be a non-empty string.  Features
    need two coordinates; one that is no number counts as 0.
    """
    if json_items.large(spark, path):
        found, there = json_items.items(spark, path, "features")
        files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
        if not files.join(there, "_file", "left_anti").isEmpty():
            raise NotFeatureCollection(path)
        features = found.withColumnRenamed("item", "f")
    else:
        features = _whole(spark, path)
    parts = features.select(
        "_file", "_block", "_row", "_pos", F.expr("variant_get(f, '$.geometry.coordinates')").alias("c"),
        F.expr("if(variant_get(f, '$.properties.address') is not null, variant_get(f, '$.properties.address'), variant_get(f, '$.properties.name'))").alias("t"),
    )
    some = parts.filter("schema_of_variant(c) like 'ARRAY%' and variant_get(c, '$[1]') is not null and schema_of_variant(t) = 'STRING'")
    rows = some.select("_file", "_block", "_row", "_pos", F.expr("variant_get(t, '$', 'string')").alias("text"), F.expr(_number("$[0]")).alias("lon"), F.expr(_number("$[1]")).alias("lat"))
    return as_records(rows.filter("text <> ''").withColumn("address", parse_address("text")), ["_row", "_pos"], start)
