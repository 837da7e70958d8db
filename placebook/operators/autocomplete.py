"""Autocomplete: the first records by prefix, optionally brought into order of distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.operators.forward import normalized, prefix_join

#: With a bias so many times the limit are taken by prefix before distance decides.
BIAS_WINDOW = 8


def autocomplete(index: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """(qid, rank, rec_id) of (qid, q), without typo fallback."""
    return prefix_join(index, normalized(queries), max(0, limit))


def autocomplete_biased(index: DataFrame, records: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """(qid, rank, rec_id) of (qid, q, lon, lat); a query without both coordinates keeps the prefix order.

    A nearer record outside the first BIAS_WINDOW * limit is not pulled in.
    """
    limit = max(0, min(limit, (1 << 31) - 1))
    asked = normalized(queries)
    window = prefix_join(index, asked, limit * BIAS_WINDOW).withColumnRenamed("rank", "_r")
    placed = window.join(records.select("rec_id", F.col("lon").alias("_x"), F.col("lat").alias("_y")), "rec_id").join(asked.select("qid", "lon", "lat"), "qid")
    distance = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.hypot(F.col("_x") - F.col("lon"), F.col("_y") - F.col("lat")))
    order = Window.partitionBy("qid").orderBy("_d", "_r")
    return placed.withColumn("_d", distance).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("qid", "rank", "rec_id")
