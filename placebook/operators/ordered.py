"""The prefix join as a merge of two sorted sides.

All keys that a text is a prefix of stand together in key order: the text is the interval from itself to the next text
that it is no prefix of.  So keys are dealt by ranges, and a text goes to the ranges that its interval touches, mostly
one.  There both come in order, each text right before its first key, and a task that reads them once finds where each
interval ends by bisection.  A key is read once, however many texts of whatever lengths meet it.

A record has several keys.  Each entry carries ``seen``, the number of leading characters that it shares with the entry
before it of the same record, and is the record's first hit for longer texts only.  So hits come out once for each
record and in order, numbered as they are found; nothing is grouped or sorted after the merge, and a limit ends an
interval after that many hits.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placebook.sources.staging import staged

#: Entries that a record has at most.
ENTRIES = 4
PARTS, DRAWN = 4, 64  # ranges for each shuffle partition, and keys that are drawn for each range to cut by
MOST_PARTS = 1 << 13
NOTHING = (1 << 31) - 1
FEW = 10_000  # ranges more than four for each text that may be read before their sizes are counted
_KEPT: dict[tuple, list[str]] = {}


def with_seen(entries: DataFrame) -> DataFrame:
    """Add ``seen``: the leading characters that an entry shares with the one before it of its record, -1 for the first."""
    before = F.lag("full_key").over(Window.partitionBy("rec_id").orderBy("full_key", "key_ord"))
    shared = "size(filter(sequence(1, least(length(_b), length(full_key))), k -> substring(_b, 1, k) = substring(full_key, 1, k)))"
    seen = F.when(F.col("_b").isNull(), -1).when(F.least(F.length("_b"), F.length("full_key")) == 0, 0).otherwise(F.expr(shared))
    return entries.withColumn("_b", before).withColumn("seen", seen.cast("int")).drop("_b")


def after(text: str) -> str | None:
    """The least text above all that start with ``text``; None if there is none."""
    for n in range(len(text) - 1, -1, -1):
        code = ord(text[n]) + 1
        if code <= 0x10FFFF:
            return text[:n] + chr(0xE000 if code == 0xD800 else code)
    return None


def texts_of(asked: DataFrame) -> DataFrame:
    """(tid, qn): each text of (qid, qn) once; tid is the least qid that asks for it."""
    return asked.groupBy("qn").agg(F.min("qid").alias("tid")).select("tid", "qn")


def bounds_of(rows: DataFrame, column: str, parts: int) -> list[str]:
    """At most ``parts`` - 1 texts that cut a column into ranges of about the same size, from about DRAWN texts for each range."""
    if parts < 2:
        return []
    share = min(1.0, parts * DRAWN / max(rows.count(), 1))
    drawn = rows.filter(F.pmod(F.xxhash64(column), F.lit(1 << 30)) < int((1 << 30) * share)).select(column).toArrow()
    keys = sorted(drawn[column].to_pylist())
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _index_bounds(index: DataFrame, parts: int) -> list[str]:
    """bounds_of() the keys of an index, kept for its next use: any bounds are right, they only tell how even the ranges are."""
    which = (index.sparkSession.sparkContext.applicationId, index.semanticHash(), parts)
    if which not in _KEPT:
        while len(_KEPT) >= 64:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[which] = bounds_of(index, "full_key", parts)
    return _KEPT[which]


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


SIDE = "part int, text string, kind int, id long, n int, wide boolean"


def _route(texts: DataFrame, bounds: list[str], enough: list[int] | None) -> DataFrame:
    """The texts (tid, qn) as SIDE rows for every range that their interval touches; ``enough``: for each range, the last one that can have wanted hits of an interval that begins there."""

    def run(batches):
        for batch in batches:
            rows = []
            for tid, text in zip(numbers(batch, "tid").tolist(), strings(batch, "qn")):
                end = after(text)
                a, b = bisect_right(bounds, text), len(bounds) if end is None else bisect_left(bounds, end)
                b = min(b, enough[a]) if enough else b
                rows += [(p, text, 0, tid, len(text), b > a) for p in range(a, b + 1)]
                if len(rows) >= 1 << 15:
                    yield _side(rows)
                    rows = []
            yield _side(rows)

    return texts.mapInArrow(run, SIDE)


def _side(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["part", "text", "kind", "id", "n", "wide"])


def _keyed(index: DataFrame, bounds: list[str], used: np.ndarray | None = None) -> DataFrame:
    """The entries as SIDE rows with their range; those of ranges that are not ``used`` are left out."""

    def run(batches):
        for batch in batches:
            part = np.array([bisect_right(bounds, t) for t in strings(batch, "full_key")], np.int32)
            if used is not None:
                on = used[part]
                batch, part = batch.filter(pa.array(on)), part[on]
            n, (key, rec_id, seen) = len(part), (batch.column(batch.schema.get_field_index(c)) for c in ("full_key", "rec_id", "seen"))
            yield pa.RecordBatch.from_arrays([pa.array(part), key, pa.array(np.ones(n, np.int32)), rec_id, seen, pa.array(np.zeros(n, bool))], ["part", "text", "kind", "id", "n", "wide"])

    return index.select("full_key", "rec_id", "seen").mapInArrow(run, SIDE)


def _merge(limit: int):
    """A task over SIDE rows in order of (part, text, kind) that gives (tid, part, seq, rec_id, wide) for each hit; ``seq`` counts from 0."""

    def hits(batch: pa.RecordBatch, part: int, a: int, b: int, state: dict) -> list:
        if state["part"] != part:
            state.update(part=part, open=[])
        kind, ids, n = (numbers(batch, c)[a:b] for c in ("kind", "id", "n"))
        wide = numbers(batch, "wide")[a:b]
        texts = strings(batch.slice(a, b - a), "text")
        at = np.flatnonzero(kind == 1)
        keys, rec_id, seen = [texts[k] for k in at.tolist()], ids[at], n[at]
        earlier = np.cumsum(kind == 1)
        asked = [(*x, 0) for x in state["open"]]
        asked += [(ids[r], texts[r], after(texts[r]), n[r], wide[r], 0, earlier[r]) for r in np.flatnonzero(kind == 0).tolist()]
        state["open"], out = [], []
        for tid, text, end, size, is_wide, sent, start in asked:
            stop = len(keys) if end is None else bisect_left(keys, end, lo=start)
            found = start + np.flatnonzero(seen[start:stop] < size)[: limit - sent]
            if len(found):
                out.append((np.full(len(found), tid), np.full(len(found), part, np.int32), np.arange(sent, sent + len(found)), rec_id[found], np.full(len(found), is_wide)))
            if stop == len(keys) and sent + len(found) < limit:
                state["open"].append((tid, text, end, size, is_wide, sent + len(found)))
        return out

    def run(batches):
        state: dict = {"part": None, "open": []}
        names = ["tid", "part", "seq", "rec_id", "wide"]
        for batch in batches:
            part = numbers(batch, "part")
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
            for a, b in zip(cuts, [*cuts[1:], len(part)]):
                out, held = [], 0
                for found in hits(batch, int(part[a]), int(a), int(b), state):
                    out.append(found)
                    held += len(found[0])
                    if held >= 1 << 17:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    return run


def hits_of(index: DataFrame, texts: DataFrame, limit: int | None = None) -> DataFrame:
    """(tid, rank, rec_id) of the records that each text of (tid, qn) is a prefix of a key of, by first key; ``rank`` from 1.

    With a limit, the first ``limit`` of each text. ``texts`` are read more than once. The result is stored.
    """
    spark = index.sparkSession
    limit = NOTHING if limit is None else max(0, min(limit, NOTHING))
    index = index if "seen" in index.columns else with_seen(index)
    if limit == 0:
        return spark.createDataFrame([], "tid long, rank long, rec_id long")
    parts = min(MOST_PARTS, PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _index_bounds(index, parts)
    routed = staged(_route(texts, bounds, None), "routed")
    if limit < NOTHING and routed.count() > 4 * texts.count() + FEW:
        # many wide intervals: ranges inside one are hits as a whole, so where it begins, these are enough
        size = np.zeros(len(bounds) + 1, np.int64)
        for row in _keyed(index, bounds).groupBy("part").count().collect():  # MOST_PARTS rows at most
            size[row["part"]] = row["count"]
        whole = np.cumsum(size)
        routed = staged(_route(texts, bounds, [int(np.searchsorted(whole, whole[p] + ENTRIES * limit)) for p in range(len(size))]), "routed")
    used = np.zeros(len(bounds) + 1, bool)
    used[[r["part"] for r in routed.select("part").distinct().collect()]] = True  # MOST_PARTS rows at most
    both = routed.unionByName(_keyed(index, bounds, used)).repartition(parts, "part").sortWithinPartitions("part", "text", "kind")
    hits = staged(both.mapInArrow(_merge(limit), "tid long, part int, seq long, rec_id long, wide boolean"), "hits")
    alone = hits.filter("not wide").select("tid", (F.col("seq") + 1).alias("rank"), "rec_id")
    wide = hits.filter("wide")
    before = Window.partitionBy("tid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = wide.groupBy("tid", "part").agg(F.count("*").alias("n")).select("tid", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    spread = wide.join(base, ["tid", "part"]).select("tid", (F.col("base") + F.col("seq") + 1).alias("rank"), "rec_id")
    return alone.unionByName(spread).filter(F.col("rank") <= limit)
