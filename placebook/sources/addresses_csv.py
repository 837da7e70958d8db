"""Address CSV files with a header of known names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.functions.text import csv_full_text, parsed_float
from placebook.sources import csv_lines
from placebook.sources.rows import as_records, placed
from placebook.sources.staging import staged

# The header names of each field, the first one present wins.
ALIASES = {
    "lon": ("LON", "lon", "longitude", "x"),
    "lat": ("LAT", "lat", "latitude", "y"),
    "number": ("NUMBER", "number", "house_number"),
    "street": ("STREET", "street"),
    "city": ("CITY", "city"),
    "region": ("REGION", "region", "state"),
    "postcode": ("POSTCODE", "postcode", "zip"),
}
REQUIRED = ("lon", "lat")


class MissingColumn(ValueError):
    """A required column is not in the header."""


def _positions(header: list[str]) -> dict[str, int]:
    found = {field: next((header.index(a) for a in names if a in header), None) for field, names in ALIASES.items()}
    for field in REQUIRED:
        if found[field] is None:
            raise MissingColumn(ALIASES[field][0])
    return {k: v for k, v in found.items() if v is not None}


def read(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Records of a CSV file or folder. Rows whose coordinates are no numbers are left out; a row with another number of fields fails the job.

    Fields may hold line breaks, and files are read in splits all the same (see csv_lines.py). Lines end with a line feed,
    with or without a carriage return; a file of carriage returns alone is one task's.
    """
    plain = {"quote": '"', "escape": '"'}
    first = spark.read.options(**plain, multiLine=True, header=False, inferSchema=False).csv(path).first()
    header = [x or "" for x in first] if first else []
    at = _positions(header)
    names = [f"c{k}" for k in range(len(header))]
    schema = ", ".join(f"{n} string" for n in names)
    if spark.read.option("lineSep", "\n").text(path).filter(F.col("value").rlike("\r[^\r\n]")).isEmpty():
        found = staged(csv_lines.records(spark, path), "records")
        head = found.groupBy("_file").agg(F.min(F.struct("_block", "_row")).alias("h")).select("_file", "h.*", F.lit(True).alias("_head"))  # a row for each file
        found = found.join(head, ["_file", "_block", "_row"], "left").filter("_head is null")
        rows = found.withColumn("_c", F.from_csv("value", schema, {**plain, "mode": "FAILFAST"})).select("_c.*", "_file", "_block", "_row")
    else:
        table = spark.read.options(**plain, multiLine=True, header=True, mode="FAILFAST", enforceSchema=True, columnPruning=False)
        rows = placed(table.schema(schema).csv(path))
    # every column is read, so that a ragged row is noticed
    rows = rows.withColumn("_all", F.concat_ws("", *names))
    text = {field: F.nullif(F.col(f"c{k}"), F.lit("")) for field, k in at.items()}
    none = F.lit(None).cast("string")
    get = lambda f: text.get(f, none)
    address = F.struct(
        get("number").alias("house_number"), get("street").alias("street"), get("city").alias("city"), get("region").alias("state"), get("postcode").alias("postcode"),
        none.alias("country"), csv_full_text(get("number"), get("street"), get("city"), get("region")).alias("full"),
    )
    kept = rows.select(address.alias("address"), parsed_float(f"c{at['lat']}").alias("lat"), parsed_float(f"c{at['lon']}").alias("lon"), "_file", "_block", "_row", "_all")
    return as_records(kept.filter("lat is not null and lon is not null and _all is not null"), ["_row"], start)
