"""The engine from SQL: text functions and lookups as functions written in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.functions import text
from placebook.schema import ADDRESS

#: Name and result of each; all take one text.
FUNCTIONS = {
    "normalize_for_match": (text.normalize_for_match, "string"), "normalize_address": (text.normalize_address, "string"), "normalize_street": (text.normalize_street, "string"),
    "address_format": (text.detect_format, "string"), "address_soundex": (text.soundex, "string"), "strict_double": (text.parsed_float, "double"),
}
#: Functions whose result is a struct: the fields and the type.
STRUCTS = {"parse_address": (text.address_fields, ADDRESS), "extract_unit": (text.unit_fields, "struct<rest:string,unit:string>")}

#: Lengths of prefix that a lookup meets keys by: the longest that the text has; its rest is a condition.
RUNGS = (1, 2, 4, 8, 16)
#: Side of the cells, in degrees, that near_lookup() finds records in.
REACH = 0.05


def register(spark: SparkSession) -> list[str]:
    """Make temporary SQL functions of FUNCTIONS and STRUCTS; the body is the expression itself, which Spark inlines into a query."""
    probe = spark.range(1).select(F.lit("").alias("t"))
    body = lambda c: probe.select(c.alias("x"))._jdf.queryExecution().analyzed().expressions().head().child().sql()
    bodies = {name: (body(make("t")), kind) for name, (make, kind) in FUNCTIONS.items()}
    for name, (fields, kind) in STRUCTS.items():
        bodies[name] = f"if(t is null, null, named_struct({', '.join(f"'{field}', {body(c)}" for field, c in fields('t').items())}))", kind
    for name, (sql, kind) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {sql}")
    return sorted(bodies)


def register_lookups(records: DataFrame, entries: DataFrame, reach: float = REACH) -> list[str]:
    """Make table functions for lateral joins, over views ``records``, ``entries``, ``entry_rungs`` and ``record_cells``.

    ``prefix_lookup(q)``: (rec_id, full_key) of each record that a normalised text is a prefix of, with its first key.
    ``near_lookup(x, y)``: (rec_id, d2) of the records within ``reach`` degrees of a point, by squared distance.
    ``box_lookup(x1, y1, x2, y2)``: (rec_id) of the records in a box, edges included, corners in any order; for sides of
    at most ``reach``.
    Each is an equality on a rung or a cell, which Spark joins by hash, with the rest as a condition. A text needs at
    least one character here.
    """
    spark = records.sparkSession
    records.createOrReplaceTempView("records")
    entries.createOrReplaceTempView("entries")
    rung = f"(case {' '.join(f'when length(q) >= {n} then {n}' for n in reversed(RUNGS))} end)"
    heads = f"filter(array({', '.join(map(str, RUNGS))}), n -> length(key) >= n)"
    spark.sql(f"create or replace temporary view entry_rungs as select substring(full_key, 1, n) as head, full_key, seen, rec_id from (select *, explode({heads}) as n from entries)")
    around = "explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(i, j)))))"
    spark.sql(f"""create or replace temporary view record_cells as
        select rec_id, lon, lat, floor(lon / {reach}D) + o.i as cx, floor(lat / {reach}D) + o.j as cy from (select rec_id, lon, lat, {around} as o from records where abs(lon) < double('infinity') and abs(lat) < double('infinity'))""")
    spark.sql(f"""create or replace temporary function prefix_lookup(q string) returns table (rec_id bigint, full_key string) return
        select e.rec_id, e.full_key from entry_rungs e where e.head = substring(q, 1, {rung}) and startswith(e.full_key, q) and e.seen < length(q)""")
    spark.sql(f"""create or replace temporary function near_lookup(x double, y double) returns table (rec_id bigint, d2 double) return
        select c.rec_id, (c.lon - x) * (c.lon - x) + (c.lat - y) * (c.lat - y) from record_cells c
        where c.cx = floor(x / {reach}D) and c.cy = floor(y / {reach}D) and (c.lon - x) * (c.lon - x) + (c.lat - y) * (c.lat - y) <= {reach}D * {reach}D""")
    spark.sql(f"""create or replace temporary function box_lookup(x1 double, y1 double, x2 double, y2 double) returns table (rec_id bigint) return
        select c.rec_id from record_cells c where c.cx = floor(least(x1, x2) / {reach}D) and c.cy = floor(least(y1, y2) / {reach}D)
        and c.lon between least(x1, x2) and greatest(x1, x2) and c.lat between least(y1, y2) and greatest(y1, y2)""")
    return ["box_lookup", "near_lookup", "prefix_lookup"]
