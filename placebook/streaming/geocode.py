"""Queries and requests as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from placebook.operators.access import DECISION, streamed
from placebook.operators.forward import forward, with_records
from placebook.schema import RateLimit


def forward_stream(queries: DataFrame, records: DataFrame, index: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Geocode a stream of (qid, q) against a stored gazetteer; each micro-batch's hits become Parquet under its batch number, so that a repeated batch replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        with_records(forward(index, batch), records).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def limit_stream(requests: DataFrame, limit: RateLimit, path: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Decide on a stream of requests (key_id, ts, request_id), in order of time inside a micro-batch, and write the decisions under ``path``.

    States are in Spark's state store under ``checkpoint``, see access.streamed(); the file sink's log makes a repeated
    micro-batch count once. decided() reads the decisions.
    """
    rows = streamed(requests, limit, lateness)
    return rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def decided(spark: SparkSession, path: str) -> DataFrame:
    """All decisions (DECISION) that limit_stream() has written under ``path``."""
    return spark.read.schema(DECISION).parquet(path)
