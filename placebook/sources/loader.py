"""Read a gazetteer file by its name's ending, or by a format given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placebook.sources import addresses_csv, geojson, osm, store

READERS = {"csv": addresses_csv.read, "geojson": geojson.read, "pbf": osm.read_pbf, "overpass_json": osm.read_json, "overpass_tsv": osm.read_tsv, "store": lambda spark, path, start=0: store.load(spark, path)}


def format_of(path: str) -> str:
    """Endings count in lower case only; whatever else is CSV."""
    if path.endswith((".geojson", ".json")):
        return "geojson"
    return "pbf" if path.endswith(".pbf") else "csv"


def load(spark: SparkSession, path: str, format: str | None = None, start: int = 0) -> DataFrame:
    return READERS[format or format_of(path)](spark, path, start)
