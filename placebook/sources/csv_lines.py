"""CSV records out of a file's lines, also where quoted fields hold line breaks.

Spark's text reader splits a file anywhere between lines, so a split may begin inside a quoted field.  What a line does
to that state is a function of two values: a line read from outside ends inside quotes or not, and so does it read from
inside.  A line's function either forgets where it began, or keeps or turns the state; so the state before any line
follows from the last line that forgets and how often it was turned since, first inside each split and then, with one
row for each split, over the splits of a file.  Lines that are records by themselves are passed on; only the lines of
longer records are brought together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.sources.rows import PLACE, placed
from placebook.sources.staging import staged

# A field is quoted if a quote is its first character; two quotes inside stand for one.
_QUOTED, _FREE = '"(?:[^"]|"")*+"[^,]*+', '[^",][^,]*+|'
_OPEN = '"(?:[^"]|"")*+$'  # a quoted field that the line does not end
_FIELDS = f"(?:(?:{_QUOTED}|{_FREE}),)*+"
#: What is left inside quotes at its end: a line that begins outside them, and one that begins inside.
FROM_OUTSIDE = f"(?s)^{_FIELDS}{_OPEN}"
FROM_INSIDE = f'(?s)^(?:(?:[^"]|"")*+$|(?:[^"]|"")*+"(?!")[^,]*+,{_FIELDS}{_OPEN})'


def _states(lines: DataFrame) -> DataFrame:
    """Add ``_state``, ``_next``: whether each line of (value, _file, _block, _row) begins and ends inside quotes."""
    a, b = (F.col("value").rlike(p).cast("int") for p in (FROM_OUTSIDE, FROM_INSIDE))
    told = lines.withColumns({"_set": F.when(a == b, a), "_turns": F.when((a == 1) & (b == 0), 1).otherwise(0), "_a": a, "_b": b})
    before = Window.partitionBy(*PLACE).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    # turns since the split began, and at the last line that forgot
    told = told.withColumn("_t", F.coalesce(F.sum("_turns").over(before), F.lit(0)))
    told = told.withColumn("_last", F.last(F.when(F.col("_set").isNotNull(), F.struct(F.col("_set").alias("s"), (F.col("_t") + F.col("_turns")).alias("t"))), ignorenulls=True).over(before))
    told = staged(told, "lines")
    fixed = lambda begin: F.when(F.col("_last").isNotNull(), (F.col("_last.s") + F.col("_t") - F.col("_last.t")) % 2).otherwise((begin + F.col("_t")) % 2)
    # a row for each split: what it makes of either state
    ends = told.groupBy(*PLACE).agg(F.max_by(F.struct("_last", "_t", "_a", "_b"), "_row").alias("e")).select(*PLACE, "e.*")
    out = lambda begin: F.when(fixed(begin) == 0, F.col("_a")).otherwise(F.col("_b"))
    ends = ends.select(*PLACE, out(F.lit(0)).alias("x"), out(F.lit(1)).alias("y"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_s": F.when(F.col("x") == F.col("y"), F.col("x")), "_turn": F.when((F.col("x") == 1) & (F.col("y") == 0), 1).otherwise(0)})
    ends = ends.withColumn("_n", F.coalesce(F.sum("_turn").over(earlier), F.lit(0)))
    ends = ends.withColumn("_l", F.last(F.when(F.col("_s").isNotNull(), F.struct(F.col("_s").alias("s"), (F.col("_n") + F.col("_turn")).alias("t"))), ignorenulls=True).over(earlier))
    begins = ends.select(*PLACE, F.when(F.col("_l").isNotNull(), (F.col("_l.s") + F.col("_n") - F.col("_l.t")) % 2).otherwise(F.col("_n") % 2).alias("_begin"))
    known = told.join(begins, PLACE).withColumn("_state", fixed(F.col("_begin")))
    return known.withColumn("_next", F.when(F.col("_state") == 0, F.col("_a")).otherwise(F.col("_b"))).select("value", *PLACE, "_row", "_state", "_next")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _block, _row) of each CSV record of a file or folder, headers included, with the place of its first line; empty lines are none."""
    lines = placed(spark.read.option("lineSep", "\n").text(path))
    states = staged(_states(lines), "states")
    alone = states.filter("_state = 0 and _next = 0")
    parts = states.filter("_state = 1 or _next = 1")
    # the first line of each longer record names it: in its split, or for lines from a split's beginning on, in the last split before that has one
    inside = Window.partitionBy(*PLACE).orderBy("_row")
    parts = parts.withColumn("_first", F.last(F.when(F.col("_state") == 0, F.col("_row")), ignorenulls=True).over(inside))
    split = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = parts.groupBy(*PLACE).agg(F.max(F.when(F.col("_state") == 0, F.col("_row"))).alias("_own"))
    carried = last.select(*PLACE, F.last(F.when(F.col("_own").isNotNull(), F.struct(F.col("_block").alias("b"), F.col("_own").alias("r"))), ignorenulls=True).over(split).alias("_before"))
    own = parts.join(carried, PLACE).withColumns({"_b": F.when(F.col("_first").isNotNull(), F.col("_block")).otherwise(F.col("_before.b")), "_r": F.coalesce("_first", "_before.r")})
    lines_of = F.array_sort(F.collect_list(F.struct("_block", "_row", "value")))  # of one record
    whole = own.groupBy("_file", F.col("_b").alias("_block"), F.col("_r").alias("_row")).agg(F.array_join(F.transform(lines_of, lambda x: x["value"]), "\n").alias("value"))
    out = alone.select("value", *PLACE, "_row").unionByName(whole.select("value", *PLACE, "_row"))
    return out.withColumn("value", F.regexp_replace("value", "\r$", "")).filter("value <> ''")

