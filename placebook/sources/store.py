"""The stored gazetteer: snapshots of the records, a row about them, and what is made from them.

A snapshot is a folder of its own, written first.  Then a small file ``snapshot-<number>``, which names the folder, makes
it the newest one: it appears whole and never over another, so that a reader sees a whole snapshot, the one before if a
writer dies or is still at work.  Of two writers that meet, the later one takes the next number.  A reader goes on with
the folder that it has opened; ``clean`` removes older ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.schema import METADATA
from placebook.sources.staging import content, file_system, named, put_once

VERSION = 1
POINTER = "snapshot-"


class NoSnapshot(FileNotFoundError):
    """Nothing has been saved under a path."""


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots under a path, oldest first."""
    return named(spark, path, POINTER)


def folder(spark: SparkSession, path: str, number: int | None = None) -> str:
    """The folder of a snapshot, the newest by default."""
    number = number if number is not None else max(snapshots(spark, path), default=None)
    if number is None:
        raise NoSnapshot(path)
    return f"{path}/{content(spark, f'{path}/{POINTER}{number}')}"


def save(records: DataFrame, path: str, source: str, also: Callable[[str], None] | None = None) -> str:
    """Write records and metadata as the newest snapshot, and what ``also`` writes into its folder; returns the folder."""
    spark = records.sparkSession
    own = f"data-{uuid.uuid4().hex}"
    at = f"{path}/{own}"
    records.write.parquet(f"{at}/records")
    about = spark.read.parquet(f"{at}/records").agg(F.count("*").alias("record_count"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    about = about.select(F.lit(VERSION).alias("version"), "record_count", now.alias("created_at"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("coverage"))
    about.write.parquet(f"{at}/metadata")
    if also:
        also(at)
    while not put_once(spark, f"{path}/{POINTER}{max(snapshots(spark, path), default=0) + 1}", own):
        pass  # another writer has just taken the number
    return at


def load(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The records of a snapshot with the ids that they were saved with."""
    return spark.read.parquet(f"{folder(spark, path, number)}/records")


def metadata(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    return spark.read.schema(METADATA).parquet(f"{folder(spark, path, number)}/metadata")


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove all snapshots but the newest ``keep`` (one at least); returns how many. Readers of a removed one fail."""
    old = snapshots(spark, path)[: -max(1, keep)]
    fs, at = file_system(spark, path), spark._jvm.org.apache.hadoop.fs.Path
    for number in old:
        gone = folder(spark, path, number)
        fs.delete(at(f"{path}/{POINTER}{number}"), False)  # its name goes first, so that none ever names a missing folder
        fs.delete(at(gone), True)
    return len(old)
