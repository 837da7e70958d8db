"""API keys and rate limits over request logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from placebook.schema import TIERS, RateLimit

SECOND, DAY = 1_000_000, 86_400_000_000
BUSY, SPENT = "Rate limit exceeded (per-second)", "Daily request limit exceeded"
DECISION = "key_id string, request_id long, ts timestamp, allowed boolean, reason string, retry_after_ms long"
STATE = "tokens double, last long, used long, reset long"


def key_hash(c: Column | str) -> Column:
    """SHA-256 of a raw key as lower-case hex."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


class Limiter:
    """A token bucket and a daily counter of one key, fed in order of time (microseconds).

    A request that the bucket lets pass has used a token even if the day's limit then denies it; the day starts at the
    first request that is counted and lasts 24 hours.
    """

    def __init__(self, limit: RateLimit, state: tuple | None = None):
        self.limit = limit
        self.tokens, self.last, self.used, self.reset = state or (float(limit.per_second), None, 0, None)

    def state(self) -> tuple:
        return self.tokens, self.last, self.used, self.reset

    def check(self, now: int) -> tuple[bool, str | None, int | None]:
        rate = self.limit.per_second
        passed = (now - self.last) / SECOND if self.last is not None else 0.0
        self.tokens = min(float(rate), self.tokens + passed * rate)
        self.last = now
        if self.tokens < 1:
            return False, BUSY, 1000 // rate if rate else 0
        self.tokens -= 1
        if self.limit.per_day > 0:
            if self.reset is None or now >= self.reset:
                self.used, self.reset = 0, now + DAY
            if self.used >= self.limit.per_day:
                return False, SPENT, 0
            self.used += 1
        return True, None, None


def micros(df: DataFrame, column: str = "ts") -> Column:
    """A time as microseconds since 1970, whether it has a time zone or not."""
    if dict(df.dtypes)[column] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")
    return F.unix_micros(column)


def replay(requests: DataFrame, limit: RateLimit) -> DataFrame:
    """Decide on every request (key_id, ts, request_id) of a log as if it came at its time.

    Keys are dealt by hash and sorted by time; tasks stream over their rows and hold one key's state, so a key with any
    number of requests takes no more memory than another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, limiter = None, None
        for part in batches:
            out = []
            for k, request, ts, us in zip(*(c.to_pylist() for c in part.columns)):
                if limiter is None or k != key:
                    key, limiter = k, Limiter(limit)
                out.append((k, request, ts, *limiter.check(us)))
            yield _rows(out)

    # times travel as numbers, so that no time zone touches them
    asked = requests.select("key_id", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), micros(requests).alias("us"))
    done = asked.repartition("key_id").sortWithinPartitions("key_id", "us", "request_id").mapInArrow(run, DECISION.replace("ts timestamp", "ts long"))
    return done.withColumn("ts", F.timestamp_micros("ts"))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64())
    names = ("key_id", "request_id", "ts", "allowed", "reason", "retry_after_ms")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=list(names))


def streamed(requests: DataFrame, limit: RateLimit, lateness: str) -> DataFrame:
    """Decide on a stream of requests (key_id, ts, request_id); each key's bucket and day are kept in Spark's state store.

    A micro-batch reads and writes the states of its own keys only. A key's timer is set to when its bucket is full and
    its day is over; then its state is that of a new key and goes. Time is that of the requests: ``lateness`` (an
    interval) is how far behind the newest one a request may come; later ones are not decided on.
    """
    names = [c.split()[0] for c in DECISION.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([f[["us", "request_id", "at"]] for f in frames])
        rows = rows.sort_values(["us", "request_id"])
        tokens, last, used, reset = state.get if state.exists else (None,) * 4
        limiter = Limiter(limit, (tokens, last, used, reset) if last is not None else None)
        told = [(key[0], request, pd.Timestamp(at, unit="us", tz="UTC"), *limiter.check(us)) for us, request, at in rows.itertuples(index=False)]
        state.update(limiter.state())
        over = max(limiter.last + SECOND, limiter.reset or 0) // 1000 + 1
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        out = pd.DataFrame(told, columns=names)
        out["retry_after_ms"] = out["retry_after_ms"].astype("Int64")
        yield out

    asked = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    timed = asked.select("key_id", "ts", "request_id", F.unix_micros("ts").alias("at"), F.unix_micros("ts").alias("us"))
    return timed.groupBy("key_id").applyInPandasWithState(run, DECISION, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests by verb."""
    return requests.groupBy("verb").agg(F.count("*").alias("requests"))


def new_keys(spark: SparkSession, names: DataFrame, tier: str = "default") -> DataFrame:
    """A key for each of (name): (id, name, raw_key, key_hash, tier, revoked, created_at). raw_key is shown once; store the rest."""
    keys = names.select(F.expr("uuid()").alias("id"), "name", F.concat(F.lit("pk_"), F.replace(F.expr("uuid()"), F.lit("-"), F.lit(""))).alias("raw_key"))
    return keys.select("id", "name", "raw_key", key_hash("raw_key").alias("key_hash"), F.lit(tier).alias("tier"), F.lit(False).alias("revoked"), F.current_timestamp().alias("created_at"), F.array(F.lit("read")).alias("permissions"))


def with_limits(keys: DataFrame) -> DataFrame:
    """Add ``per_second`` and ``per_day`` of each key's tier; a tier without a name here has those of the default one."""
    limits = F.create_map(*(x for name, limit in TIERS.items() for x in (F.lit(name), F.struct(F.lit(limit.per_second).cast("long").alias("s"), F.lit(limit.per_day).cast("long").alias("d")))))
    own = F.coalesce(F.try_element_at(limits, F.coalesce("tier", F.lit("default"))), F.try_element_at(limits, F.lit("default")))
    return keys.withColumns({"per_second": own["s"], "per_day": own["d"]})


def validate(keys: DataFrame, raw: DataFrame) -> DataFrame:
    """The stored, unrevoked keys of raw keys (raw_key)."""
    return keys.filter("not revoked").join(raw.select(key_hash("raw_key").alias("key_hash")).distinct(), "key_hash", "left_semi")


def revoke(keys: DataFrame, ids: DataFrame) -> DataFrame:
    """Keys with those of (id) revoked."""
    marked = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return keys.join(marked, "id", "left").withColumn("revoked", F.col("revoked") | F.coalesce("_gone", F.lit(False))).drop("_gone")
