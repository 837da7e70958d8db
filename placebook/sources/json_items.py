"""The items of one large JSON document's array, read in splits.

The document is cut at every closing brace, which Spark's text reader can do anywhere in a file.  Whether a piece begins
inside a string follows from the number of quotes before it, and how deep it begins from the braces and brackets
outside strings: both are sums, first inside a split, then over splits with one row for each.  The array is found where
its key stands at the first level; from there on an item ends wherever a piece ends at the level of the array, and
the pieces of an item are put together and parsed by themselves.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.sources.rows import PLACE, placed
from placebook.sources.staging import staged


class NotWhole(ValueError):
    """A document whose braces, brackets or strings do not end."""


def large(spark: SparkSession, path: str) -> bool:
    """Whether a file of the path has more than one split."""
    most = spark.range(1).selectExpr("1").sparkSession.conf.get("spark.sql.files.maxPartitionBytes", "128MB")
    number, unit = re.fullmatch(r"(\d+)\s*([a-zA-Z]*)", most).groups()
    size = int(number) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit.lower()[:1]]
    return not spark.read.format("binaryFile").load(path).select("length").filter(F.col("length") > size).isEmpty()


def _before(value: Column) -> Column:
    """Sum of a number of the pieces before each one in its split."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*PLACE).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _earlier(pieces: DataFrame, value: Column, name: str) -> DataFrame:
    """(_file, _block, name): the sum of a number over a file's splits before each one."""
    each = pieces.groupBy(*PLACE).agg(F.sum(value).alias("n"))
    order = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*PLACE, F.coalesce(F.sum("n").over(order), F.lit(0)).alias(name))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _block, _row, _depth, _ends, _after): a piece, the level it begins at, whether it ends at a brace outside strings, and the level after that."""
    rows = placed(spark.read.option("lineSep", "}").text(path))
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    rows = rows.withColumn("_q", F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit(""))))
    rows = staged(rows, "pieces")
    inside = rows.withColumn("_in", _before(F.col("_q"))).join(_earlier(rows, F.col("_q"), "_i"), PLACE).withColumn("_in", (F.col("_in") + F.col("_i")) % 2)
    text = F.when(F.col("_in") == 1, F.regexp_replace(plain, '^[^"]*+(?:"|$)', "")).otherwise(plain)
    text = F.regexp_replace(text, '"[^"]*+(?:"|$)', "")
    opened = F.length(F.regexp_replace(text, r"[^{\[]", "")) - F.length(F.regexp_replace(text, r"[^\]]", ""))
    rows = staged(inside.withColumns({"_ends": (F.col("_in") + F.col("_q")) % 2 == 0, "_opened": opened}).drop("_i"), "pieces")
    step = F.col("_opened") - F.col("_ends").cast("int")
    deep = rows.withColumn("_d", _before(step)).join(_earlier(rows, step, "_e"), PLACE)
    return deep.select("value", *PLACE, "_row", "_in", (F.col("_d") + F.col("_e")).alias("_depth"), "_ends", (F.col("_d") + F.col("_e") + step).alias("_after"))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s"{}\[\]:,]+', re.S)


def _begin(text: str, depth: int, key: str) -> int:
    """Where the array of a first-level key begins in a piece that starts at ``depth``: behind its bracket, or -1."""
    last = ["", ""]
    for token in _TOKEN.finditer(text):
        t = token[0]
        if t == "[" and depth == 1 and last == [f'"{key}"', ":"]:
            return token.end()
        depth += (t in "{[") - (t in "}]") if len(t) == 1 else 0
        last = [last[1], t]
    return -1


def items(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, DataFrame]:
    """((_file, _block, _row, _pos, item) of the items of each document's array at a first-level ``key``, as variants in order; (_file) of the documents that have it)."""
    pieces = staged(_pieces(spark, path), "pieces")
    # a document's last piece has a brace behind it, or is the blanks behind the document: the bytes of all pieces tell
    order = F.struct("_block", "_row")
    final = pieces.groupBy("_file").agg(F.max_by(F.struct("value", "_in", "_depth", "_after", "_ends"), order).alias("e"), F.sum(F.octet_length("value") + 1).alias("_bytes"))
    length = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"), "length")
    blank = (F.col("_bytes") == F.col("length") + 1) & F.col("e.value").rlike(r"^\s*$") & (F.col("e._depth") == 0)
    closed = (F.col("_bytes") != F.col("length") + 1) & F.col("e._ends") & (F.col("e._after") == 0)
    if not final.join(length, "_file", "left").filter(~F.coalesce(blank | closed, F.lit(False))).isEmpty():
        raise NotWhole(path)

    @F.pandas_udf("int")
    def begin(text: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([_begin(t, d, key) for t, d in zip(text, depth)])

    # only pieces that pass the first level can hold the key: those that begin there, or close an array there
    top = pieces.filter("_in = 0 and (_depth <= 1 or (_depth = 2 and value rlike '^[^\"{]*\\\\]'))").withColumn("_at", begin("value", "_depth")).filter("_at >= 0")
    begins = staged(top.groupBy("_file").agg(F.min(F.struct("_block", "_row", "_at")).alias("_b")), "begins")  # a row for each document
    there = pieces.join(begins, "_file").filter(order >= F.struct("_b._block", "_b._row"))
    first = order == F.struct("_b._block", "_b._row")
    body = there.withColumn("value", F.when(first, F.substring("value", F.col("_b._at") + 1, F.length("value"))).otherwise(F.col("value")))
    # the array is over where a piece between items closes it
    between = (F.col("_depth") == 2) & (F.col("_in") == 0) & ~first & F.col("value").rlike(r'^[^"{\[]*\]') | first & F.col("value").rlike(r'^[^"{\[]*\]')
    over = body.filter(between).groupBy("_file").agg(F.min(order).alias("_over"))
    body = body.join(over, "_file", "left").filter(F.col("_over").isNull() | (order < F.col("_over")))
    # an item is named by the piece that ends it; pieces before it in earlier splits go on to the next end
    body = body.withColumn("_end", F.when(F.col("_ends") & (F.col("_after") == 2), F.col("_row")))
    body = body.withColumn("_stop", F.first("_end", ignorenulls=True).over(Window.partitionBy(*PLACE).orderBy("_row").rowsBetween(0, Window.unboundedFollowing)))
    each = body.groupBy(*PLACE).agg(F.min("_end").alias("_own"))
    later = Window.partitionBy("_file").orderBy("_block").rowsBetween(1, Window.unboundedFollowing)
    each = each.select(*PLACE, F.first(F.when(F.col("_own").isNotNull(), F.struct(F.col("_block").alias("b"), F.col("_own").alias("r"))), ignorenulls=True).over(later).alias("_next"))
    named = body.join(each, PLACE).withColumns({"_b2": F.when(F.col("_stop").isNotNull(), F.col("_block")).otherwise(F.col("_next.b")), "_r2": F.coalesce("_stop", "_next.r")})
    whole = named.filter("_r2 is not null").groupBy("_file", F.col("_b2").alias("_block"), F.col("_r2").alias("_row"))
    parts = F.array_sort(F.collect_list(F.struct("_block", "_row", "value")))  # of one item
    text = whole.agg(F.array_join(F.transform(parts, lambda x: x["value"]), "}").alias("value"))
    fragment = F.concat(F.lit("["), F.regexp_replace("value", r"^\s*,", ""), F.lit("}]"))
    text.select("_file", "_block", "_row", F.parse_json(fragment).alias("v")).createOrReplaceTempView("_json_items")
    found = spark.sql("select _file, _block, _row, i.pos as _pos, i.value as item from _json_items, lateral variant_explode(v) i")
    spark.catalog.dropTempView("_json_items")
    return found, begins.select("_file")
