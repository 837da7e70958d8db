"""Record ids for rows read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.operators.index import dense_ids
from placebook.schema import ADDRESS, RECORDS
from placebook.sources.staging import staged

PLACE = ["_file", "_block"]


def placed(df: DataFrame) -> DataFrame:
    """Add a row's place in its files: path, start of the split, and order inside it."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())


def as_records(rows: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """(rec_id, address, lat, lon) of rows (address, lat, lon) with their place, numbered from ``start`` in file order."""
    kept = staged(rows.select(F.col("address").cast(ADDRESS).alias("address"), "lat", "lon", *PLACE, *order), "rows")
    numbered = dense_ids(kept, PLACE, order, "rec_id", start)
    return numbered.select(F.col("rec_id").cast("long").alias("rec_id"), "address", "lat", "lon")


def record_count(records: DataFrame) -> int:
    return records.count()


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """Records of another source after those of the first: ids run on."""
    return first.unionByName(second.withColumn("rec_id", F.col("rec_id") + first.count()))


def manual(spark, rows) -> DataFrame:
    """Records from Python rows (address dict or tuple, lat, lon), numbered in their order."""
    return spark.createDataFrame([(k, a, float(lat), float(lon)) for k, (a, lat, lon) in enumerate(rows)], RECORDS)
