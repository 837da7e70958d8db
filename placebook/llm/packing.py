"""Best-fit packing of tokenised documents into fixed sequences by large-item matching.

Only lengths matter for packing, and there are at most ``capacity`` of them.
So tasks tokenise and count, the driver plans on the histogram of lengths
(at most ``capacity`` rows whatever the corpus size), and tasks look their
place up by the rank that a piece has among the pieces of its length:

1. a document longer than the capacity is cut into full pieces, the first
   piece taking the remainder;
2. pieces above one third of the capacity: at most two fit one sequence. From
   the longest down, each is matched with the longest one that still fits;
3. shorter pieces, from the longest down, go to the smallest gap that holds
   them, new sequences being opened only when no gap does.

The pieces' token ids are written once and wait there under a key, as placing
needs only lengths; ``sequences`` puts the ids of each sequence together.

The plan is a list of runs: ``bins`` equal sequences with the same contents.
A copy group of any size is one length and hence one count.

Defined results: a null or empty text is the end mark alone (length 1);
repeated rows are packed once each; equal lengths are told apart by a stored
rank, so that reruns of tasks agree; very long texts are tokenised whole; an
empty table gives an empty table; a doc_id of another type than a number is
null; columns that clash with the results' names are not carried.
"""

from __future__ import annotations

import base64
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.llm._store import new_path, table
from placebook.llm._words import slices

CAPACITY = 2048
RANKED = 200_000  # pieces of one length that one task ranks, about
PIECE = "piece_key long, doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long"
SEQUENCE = "sequence_id long, length long, ids binary, pieces array<struct<doc_id:long,text_hash:long,piece:int,offset:long,length:long>>"
NAMES = [c.split()[0] for c in PIECE.split(", ")]


@lru_cache(maxsize=2)
def _encoder(ranks_path: str):
    """The byte-level BPE of byte_bpe_50k.json, read from the same vocabulary as ranks: the ids are the same, and it is four times as fast."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {"<|endoftext|>": 50256}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    n = len(ids)
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenised(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(NAMES..., draw, ids) of every piece of every document's ids with the end mark 0; to be written, as keys are numbered by task.

    ``ids`` are little-endian unsigned 32-bit numbers; ``draw`` is a number below 2**20 that deals pieces of one length
    over tasks, those of repeated rows too; doc_id and text_hash (xxhash64) find the row that a piece comes from.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [*NAMES, "draw", "ids"]

    def run(batches):
        encoder = _encoder(path)
        number = TaskContext.get().partitionId() << 33
        for part in slices(batches, most_bytes=1 << 22):
            out: list[list] = [[] for _ in names]
            for key, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                ids = encoder.encode(text.as_py() or "", allowed_special="all")
                ids.append(0)
                ids = np.array(ids, dtype="<u4")
                for k, (start, length) in enumerate(_pieces_of(ids, capacity)):
                    own = ids[start : start + length]
                    crc = zlib.crc32(own)
                    draw = (number * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 44  # its own for each piece, repeated rows included
                    for column, value in zip(out, (number, key, h, k, start, length, crc, draw, own.tobytes())):
                        column.append(value)
                    number += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], names)

    number = F.col("doc_id").cast("long") if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") else F.col("doc_id").try_cast("long")
    return docs.select(number.alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"{PIECE}, draw int, ids binary")


@dataclass
class Run:
    """``bins`` equal sequences; each slot is (length, how many in a sequence, rank of its first piece, offset)."""

    bins: int
    gap: int
    slots: list[tuple[int, int, int, int]] = field(default_factory=list)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Pack ``counts`` (pieces by length) by large-item matching and best fit, a class of equal pieces at a time."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rank = np.zeros(capacity + 1, np.int64)
    runs: list[Run] = []
    by_gap: dict[int, list[Run]] = {}

    def put(run: Run, length: int, each: int) -> None:
        run.slots.append((length, each, int(rank[length]), capacity - run.gap))
        rank[length] += each * run.bins
        left[length] -= each * run.bins
        run.gap -= each * length

    def opened(bins: int) -> Run:
        runs.append(run := Run(bins, capacity))
        return run

    third = capacity // 3
    for length in range(capacity, third, -1):
        while left[length]:
            fitting = min(length, capacity - length)
            mates = np.flatnonzero(left[third + 1 : fitting + 1]) + third + 1
            mate = int(mates[-1]) if len(mates) else 0
            if not mate or (mate == length and left[length] == 1):
                mates = mates[mates < length]
                mate = int(mates[-1]) if len(mates) else 0
            if not mate:
                put(opened(int(left[length])), length, 1)
            elif mate == length:
                put(opened(int(left[length] // 2)), length, 2)
            else:
                run = opened(int(min(left[length], left[mate])))
                put(run, length, 1)
                put(run, mate, 1)
    for run in runs:
        by_gap.setdefault(run.gap, []).append(run)

    for length in range(third, 0, -1):
        while left[length]:
            gap = min((g for g in by_gap if g >= length), default=capacity)
            each = min(gap // length, int(left[length]))
            bins = int(left[length] // each)
            if gap in by_gap:
                run = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                if bins < run.bins:  # the rest of the run keeps its gap
                    rest = Run(run.bins - bins, run.gap, [(s, e, r + e * bins, o) for s, e, r, o in run.slots])
                    run.bins = bins
                    runs.append(rest)
                    by_gap.setdefault(gap, []).append(rest)
            else:
                run = opened(bins)
            put(run, length, each)
            by_gap.setdefault(run.gap, []).append(run)
    return runs


def _slots(runs: list[Run]) -> np.ndarray:
    """Rows (length, first rank, pieces a sequence, first sequence, offset), in order of length and rank."""
    rows, sequence = [], 0
    for run in runs:
        rows += [(length, first, each, sequence, offset) for length, each, first, offset in run.slots]
        sequence += run.bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces: DataFrame, histogram: dict[int, int], each: int = RANKED) -> DataFrame:
    """Add ``rank`` (from 0) among the pieces of the same length: the rank inside a part of about ``each`` pieces plus the pieces of earlier parts."""
    parts = F.create_map(*(F.lit(x) for length, n in sorted(histogram.items()) if n > each for x in (length, -(-n // each)))) if max(histogram.values(), default=0) > each else None
    many = F.lit(1) if parts is None else F.coalesce(F.try_element_at(parts, F.col("length").cast("int")), F.lit(1))
    dealt = pieces.withColumn("part", F.floor(F.col("draw").cast("long") * many / F.lit(1 << 20)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "draw", "piece_key")
    own = dealt.withColumn("_r", F.row_number().over(inside) - 1)
    return own.join(base, ["length", "part"]).withColumn("rank", F.col("_r") + F.col("base")).drop("_r", "base", "part", "draw")


def packed(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, ids_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placements as pack() returns them; (piece_key, ids) of every piece, for sequences()); the pieces are stored in ``ids_path``, a new folder by default."""
    spark = docs.sparkSession
    ids_path = ids_path or new_path(spark, "pieces")
    found = tokenised(docs, ranks_path, capacity)
    found.write.parquet(ids_path)
    written_pieces = spark.read.schema(found.schema).parquet(ids_path)
    pieces = written_pieces.drop("ids")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots = _slots(plan(histogram, capacity))
    # one sorted key for (length, rank): the slot of a piece is the last one that starts at or before it
    key = slots[:, 0].astype(np.float64) if not len(slots) else slots[:, 0]
    starts = np.searchsorted(key, np.arange(capacity + 2))

    def run(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            at = np.empty(len(length), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                lo, hi = starts[size], starts[size + 1]
                at[rows] = lo + np.searchsorted(slots[lo:hi, 1], rank[rows], side="right") - 1
            _, first, each, sequence, offset = slots[at].T
            inside = rank - first
            keep = [batch.column(batch.schema.get_field_index(c)) for c in NAMES]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence + inside // each), pa.array(offset + inside % each * length)], [*NAMES, "sequence_id", "offset"])

    placed = ranked(pieces, histogram).select(*NAMES, F.col("rank").cast("long").alias("rank"))
    return placed.mapInArrow(run, f"{PIECE}, sequence_id long, offset long").withColumn("ids_path", F.lit(ids_path)), written_pieces.select("piece_key", "ids")


def pack(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, ids_path: str | None = None) -> DataFrame:
    """(piece_key, doc_id, text_hash, piece, start, length, ids_crc32, sequence_id, offset, ids_path): one row for each piece with its sequence and the offset there.

    ``ids_path`` names the table that holds the piece's ids under its key; sequences() finds them there.
    """
    return packed(docs, ranks_path, capacity, ids_path)[0]


def sequences(placements: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(sequence_id, length, ids, pieces) of each sequence of pack(): its ids one after another and the pieces that they come from."""
    if ids is None:
        paths = [r["ids_path"] for r in placements.select("ids_path").distinct().collect()]  # one for each call of pack()
        if not paths:
            return placements.sparkSession.createDataFrame([], SEQUENCE)
        ids = placements.sparkSession.read.parquet(*paths).select("piece_key", "ids")
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "text_hash", "piece", "ids")))  # capacity ids at most
    whole = placements.join(ids, "piece_key").groupBy("sequence_id").agg(held.alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", F.expr("aggregate(p, 0L, (a, x) -> a + x.length)").alias("length"), joined.alias("ids"), F.expr("transform(p, x -> struct(x.doc_id, x.text_hash, x.piece, x.offset, x.length))").alias("pieces"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
