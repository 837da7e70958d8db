"""The text index: one entry for each key that a record can be found by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebook.functions.text import normalize_for_match
from placebook.operators.ordered import with_seen

#: Ends a key in ``full_key``; sorts before every printable character, and is no white space for the normaliser.
SEPARATOR = "\x1f"
#: Prefixes whose first records are stored: their length, and how many records.
HEAD_LENGTH, HEAD_RECORDS = 3, 64


def entries(records: DataFrame) -> DataFrame:
    """(rec_id, key_ord, key, full_key, seen): full text, street, street with city, and city, as far as they are present.

    (rec_id, key_ord) is the order in which entries are inserted. Equal keys of one record all stay. ``seen`` tells which
    prefixes find an earlier entry of the record too (see ordered.py).
    """
    a = F.col("address")
    texts = F.array(a["full"], a["street"], F.when(a["street"].isNotNull() & a["city"].isNotNull(), F.concat_ws(" ", a["street"], a["city"])), a["city"])
    exploded = records.select("rec_id", F.posexplode(F.filter(texts, lambda x: x.isNotNull())).alias("key_ord", "text"))
    keyed = exploded.select("rec_id", "key_ord", normalize_for_match("text").alias("key"))
    return with_seen(keyed.withColumn("full_key", F.concat("key", F.lit(SEPARATOR), F.col("rec_id").cast("string"))))


def spread(records: DataFrame) -> DataFrame:
    """Deal records over spark.sql.shuffle.partitions tasks: making keys costs far more than moving records, and few or small files would leave it to few tasks."""
    return records.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec_id")


def write_sorted(index: DataFrame, path: str) -> None:
    """Store entries in key order, so that a prefix reads few files and row groups."""
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.repartitionByRange(parts, "full_key").sortWithinPartitions("full_key").write.mode("overwrite").parquet(path)


def heads(index: DataFrame, records: DataFrame, longest: int = HEAD_LENGTH, most: int = HEAD_RECORDS) -> DataFrame:
    """(prefix, rank, records' columns): the first ``most`` records by key of every beginning of keys of up to ``longest`` characters.

    These are the nodes near the root of the keys' trie, each with its first records, so that a short prefix, which most
    keys may begin with, reads one list. A task passes on ``most`` rows of a prefix at most.
    """
    lengths = F.explode(F.expr(f"sequence(seen + 1, least({longest}, length(key)))"))
    early = index.filter(f"seen < least({longest}, length(key))").select("rec_id", "full_key", lengths.alias("n"))
    order = Window.partitionBy("prefix").orderBy("full_key")
    first = early.select("rec_id", "full_key", F.expr("substring(full_key, 1, n)").alias("prefix")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return first.select("prefix", "rank", "rec_id").join(records, "rec_id")


def write_heads(index: DataFrame, records: DataFrame, path: str) -> None:
    """Store heads() in order of prefix, so that one prefix reads one row group."""
    found = heads(index, records)
    found.repartitionByRange("prefix").sortWithinPartitions("prefix", "rank").write.mode("overwrite").parquet(path)


def unique_index(pairs: DataFrame, key: str = "key", value: str = "value", order: str = "seq") -> DataFrame:
    """A text index of its own: for equal keys the first inserted value stays."""
    first = F.min_by(value, order).alias(value)
    return pairs.groupBy(key).agg(first)


def get(index: DataFrame, key: str | Column) -> DataFrame:
    """The entries with exactly this key."""
    return index.filter(F.col("key") == (F.lit(key) if isinstance(key, str) else key))


def get_many(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys, "key")


def prefix_search(index: DataFrame, prefix: str) -> DataFrame:
    """All entries whose key starts with ``prefix``, in byte order; the filter reaches the Parquet scan."""
    return index.filter(F.col("full_key").startswith(prefix)).orderBy("full_key")


def records_of(records: DataFrame, ids: DataFrame, column: str = "rec_id") -> DataFrame:
    """Look records up by id."""
    return ids.join(records, column)


def dense_ids(rows: DataFrame, blocks: list[str], within: list[str], name: str = "rec_id", start: int = 0) -> DataFrame:
    """Number rows from ``start`` by block, then inside a block, without sorting all rows in one partition.

    A block is a part of the input that one task can number (a file's split); only a row for each block is summed up
    in one place.  ``rows`` are read twice, so ``within`` must not change between readings.
    """
    inside = Window.partitionBy(*blocks).orderBy(*within)
    sizes = rows.groupBy(*blocks).agg(F.count("*").alias("_size"))
    before = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*blocks, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    numbered = rows.withColumn("_n", F.row_number().over(inside)).join(base, blocks)
    return numbered.withColumn(name, F.col("_base") + F.col("_n") - 1 + start).drop("_n", "_base")
