"""Address data derived from the star-schema tables: a gazetteer of customers, queries of orders and points of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.functions.text import parse_address
from placebook.operators.index import entries, spread, write_sorted
from placebook.sources.staging import is_written, new_path, staged

_STREETS = "'Main','Oak','North Elm','Lynn','Broadway','King''s','Ross','Southeast Cedar','Lake','Castle','Avenue','Pine Tree'"
_KINDS = "'Street','Avenue','Boulevard','Drive','Road','Lane','Court','Place','Way','Circle'"
_CITIES = "'Springfield','Portland','Denver','Lakeview','West Haven','Riverton','Ann Arbor','Eastwood'"
_STATES = "'IL','OR','CO','NE','SE'"


def _gazetteer_sql(element, div, customer: str, nation: str) -> str:
    """The gazetteer in either dialect: ``element(values, index)`` and ``div(a, b)`` write what they differ in."""
    street = f"{element(_STREETS, 'CAST((c_custkey*7)%12 AS INT)+1')} || ' ' || {element(_KINDS, f'CAST(({div('c_custkey', '12')})%10 AS INT)+1')}"
    return f"""
select id, case id%5 when 0 then house||' '||street||', '||city||', '||state
  when 1 then house||' '||street||' Apt '||CAST(id%9+1 AS STRING)||', '||city||', '||state||', US'
  when 2 then house||' '||street||', '||city||', '||state||', '||zip||', US'
  when 3 then house||' '||street else street||', '||city end as raw, lat, lon
from (
  select CAST(c_custkey AS BIGINT) as id, CAST(1+(c_custkey*37)%997 AS STRING) as house, {street} as street,
    {element(_CITIES, 'CAST(c_nationkey%8 AS INT)+1')} as city, {element(_STATES, 'CAST(n_regionkey%5 AS INT)+1')} as state,
    CAST(60000+c_custkey%1000 AS STRING) as zip,
    CAST(39 AS DOUBLE)+CAST((c_custkey*13)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) as lat,
    CAST(-90 AS DOUBLE)+CAST((c_custkey*29)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) as lon
  from {customer} join {nation} on c_nationkey=n_nationkey)"""


_SPARK = _gazetteer_sql(lambda v, i: f"element_at(array({v}), {i})", lambda a, b: f"{a} DIV {b}", "{customer}", "{nation}")
GAZETTEER = _gazetteer_sql(lambda v, i: f"list_extract([{v}], {i})", lambda a, b: f"{a} // {b}", "customer", "nation")

_QUERIES = """
select CAST(o_orderkey AS BIGINT) as qid,
  case o_orderkey%6 when 0 then raw when 1 then lower(raw) when 2 then substr(raw,1,7)
    when 3 then substr(raw,1,3)||substr(raw,5) when 4 then substr(raw,1,4)||'x'||substr(raw,5) else 'zzqq flurb' end as q
from {orders} join {gaz} on id=o_custkey"""
_POINTS = """
select CAST(event_id AS BIGINT) as qid,
  CAST(-90 AS DOUBLE)+CAST((event_id*17)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) as lon,
  CAST(39 AS DOUBLE)+CAST((event_id*7)%1000 AS DOUBLE)/CAST(1000 AS DOUBLE) as lat
from {events}"""
QUERIES = _QUERIES.format(orders="orders", gaz="gaz")
POINTS = _POINTS.format(events="events")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, raw, lat, lon)."""
    return spark.sql(_SPARK, customer=_table(spark, sf_dir, "customer"), nation=_table(spark, sf_dir, "nation"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gazetteer(spark, sf_dir).select(F.col("id").alias("rec_id"), parse_address("raw").alias("address"), "lat", "lon")


_STORED: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text index as it is used: normalised and stored in key order once for each application and folder of tables, and read back."""
    where = (spark.sparkContext.applicationId, sf_dir)
    if where not in _STORED or not is_written(spark, _STORED[where]):
        path = new_path(spark, "entries")
        write_sorted(staged(entries(spread(records(spark, sf_dir))), "keyed"), path)
        _STORED[where] = path
    return spark.read.parquet(_STORED[where])


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_QUERIES, orders=_table(spark, sf_dir, "orders"), gaz=gazetteer(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_POINTS, events=_table(spark, sf_dir, "events"))


def odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t): the gazetteer's texts and variants of them that the normalisers treat specially."""
    return spark.sql(ODD.replace("from gaz", "from {gaz}"), gaz=gazetteer(spark, sf_dir))


ODD = """
select id, case id%8 when 0 then raw when 1 then '  '||upper(raw)||' ' when 2 then replace(raw, ' ', '  ') when 3 then raw||' Suite #12, Unit 4'
  when 4 then 'ne '||replace(raw, 'a', 'ross ')||'. n n.e St street' when 5 then replace(raw, ', ', ',')||',' when 6 then 'Ünit Ønorth '||replace(raw, 'a', 'ä')||' ÉAST west, 大阪 Straße' else 'Room 7 '||raw||' Way Broadway' end as t
from gaz"""
