"""The registered queries of the gazetteer engine, each with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.functions import text
from placebook.operators import access, autocomplete, batch, forward, fuzzy, spatial
from placebook.operators import index as ix
from placebook.operators.products import blocks, every, tiles
from placebook.plans import derived
from placebook.plans import oracle_text as o
from placebook.plans.derived import odd_texts
from placebook.schema import RESULT, FuzzyConfig, RateLimit
from placebook.sources.staging import staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str | None = None):
    def put(run):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return put


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@registered(o.WITH + ", " + o.match_ctes("m", "odd", "t") + " select id, x as key from m")
def normalize_for_match(spark, sf_dir):
    return odd_texts(spark, sf_dir).select("id", text.normalize_for_match("t").alias("key"))


@registered(o.WITH + f" select id, {o.address_text('t')} as key from odd")
def normalize_address(spark, sf_dir):
    return odd_texts(spark, sf_dir).select("id", text.normalize_address("t").alias("key"))


@registered(o.WITH + f" select id, {o.street_text('t')} as key from odd")
def normalize_street(spark, sf_dir):
    return odd_texts(spark, sf_dir).select("id", text.normalize_street("t").alias("key"))


@registered(o.WITH + f', p as ({o.parsed("odd", "t")}) select id, house_number, street, city, state, postcode, country, "full" from p')
def parse_address(spark, sf_dir):
    return odd_texts(spark, sf_dir).select("id", text.parse_address("t").alias("a")).select("id", "a.*")


@registered(o.WITH + f", u as (select id, {o.unit('t')} as u from odd) select id, u[1] as rest, u[2] as unit from u")
def extract_unit(spark, sf_dir):
    return odd_texts(spark, sf_dir).select("id", text.extract_unit("t").alias("u")).select("id", "u.*")


@registered(o.WITH + """, f as (select id, list_transform(string_split(trim(t), ','), lambda p: trim(p)) as parts from (
  select id, t from odd union all select id + 1000000, t || ', ' || cast(10000 + id as varchar) from odd union all select id + 2000000, t || ', 1010' from odd union all select id + 3000000, t || ', 1010 Wien' from odd))
select id, case when len(parts) >= 2 and strlen(parts[-1]) >= 4 and regexp_matches(parts[-1], '^([0-9]{5}|[0-9]{4}$)') then 'European'
  when list_bool_or(list_transform(parts, lambda p: regexp_matches(p, '[\\x{3000}-\\x{9FFF}]'))) then 'Japanese' else 'NorthAmerican' end as format from f""")
def detect_format(spark, sf_dir):
    odd = odd_texts(spark, sf_dir)
    tails = F.array(F.lit(""), F.concat(F.lit(", "), (F.col("id") + 10000).cast("string")), F.lit(", 1010"), F.lit(", 1010 Wien"))
    more = odd.select("id", "t", F.posexplode(tails).alias("k", "tail")).select((F.col("id") + F.col("k") * 1_000_000).alias("id"), F.concat("t", "tail").alias("t"))
    return more.select("id", text.detect_format("t").alias("format"))


@registered(o.WITH + " select q.qid, cast(levenshtein(q.q, g.raw) as bigint) as distance from queries q join orders on o_orderkey = q.qid join gaz g on g.id = o_custkey")
def levenshtein(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("id"))
    pairs = derived.text_queries(spark, sf_dir).join(orders, "qid").join(derived.gazetteer(spark, sf_dir), "id")
    return pairs.select("qid", F.levenshtein("q", "raw").cast("long").alias("distance"))


@registered(o.WITH + f" select id, {o.soundex_text('t')} as code from odd")
def soundex(spark, sf_dir):
    return odd_texts(spark, sf_dir).select("id", text.soundex("t").alias("code"))


@registered(o.ENTRIES + " select rec_id, key_ord, key from entries")
def index_entries(spark, sf_dir):
    return _long(derived.index(spark, sf_dir), "key_ord").select("rec_id", "key_ord", "key")


@registered(o.ENTRIES + " select qid, rec_id, key_ord from asked join entries on key = x")
def index_get(spark, sf_dir):
    return _long(forward.entries_of(derived.index(spark, sf_dir), derived.text_queries(spark, sf_dir)), "key_ord").select("qid", "rec_id", "key_ord")


@registered(o.ENTRIES + " select key, min(rec_id) as rec_id from entries group by key")
def unique_index(spark, sf_dir):
    pairs = derived.index(spark, sf_dir).select("key", F.col("rec_id").alias("value"), F.struct("rec_id", "key_ord").alias("seq"))
    return ix.unique_index(pairs).select("key", F.col("value").alias("rec_id"))


@registered(o.ENTRIES + " select rec_id, key_ord, key from entries where starts_with(full_key, 'main st')")
def prefix_search(spark, sf_dir):
    return _long(ix.prefix_search(derived.index(spark, sf_dir), "main st"), "key_ord").select("rec_id", "key_ord", "key")


@registered(o.ENTRIES + " select qid, rank, rec_id from ranked")
def forward_exact(spark, sf_dir):
    return _long(forward.forward_exact(derived.index(spark, sf_dir), derived.text_queries(spark, sf_dir)), "rank").select("qid", "rank", "rec_id")


@registered(o.ENTRIES + o.FUZZY + """ select qid, rank, rec_id, confidence, match_type, lat, lon, "full" as address from forwarded join rec on id = rec_id""")
def forward_with_fallback(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    hits = forward.forward_records(derived.index(spark, sf_dir), records, derived.text_queries(spark, sf_dir))
    return _long(hits, "rank").select("qid", "rank", "rec_id", "confidence", "match_type", "lat", "lon", F.col("address.full").alias("address"))


@registered(o.ENTRIES + o.FUZZY + " select qid, r as rank, key, rec_id, cast(d as bigint) as distance, score from best")
def fuzzy_search(spark, sf_dir):
    index = derived.index(spark, sf_dir)
    missed = forward.missed_texts(index, derived.text_queries(spark, sf_dir))
    found = fuzzy.fuzzy_entries(index, missed, 20, FuzzyConfig(2, False, 0.6))
    return _long(found, "rank", "distance").select("qid", "rank", "key", "rec_id", "distance", "score")


@registered(o.ENTRIES + f""", keys as (select distinct key, {o.soundex_text('key')} as code from entries), qs as (select qid, x as q, {o.soundex_text('x')} as code from asked), pairs as (
  select qid, key, d, code = kcode as alike, case when greatest(strlen(q), strlen(key)) = 0 then 1 else 1 - d / greatest(strlen(q), strlen(key)) end as s
  from (select qid, q, qs.code, key, keys.code as kcode, levenshtein(q, key) as d from qs join keys on abs(length(q) - length(key)) <= 2 or qs.code = keys.code)
), told as (
  select qid, key, case when d <= 2 and s >= 0.5 then d end as distance, case when d <= 2 and s >= 0.5 then s else 0.6 end as score from pairs where (d <= 2 and s >= 0.5) or alike
) select qid, row_number() over (partition by qid order by score desc, rec_id, key_ord) as rank, told.key, rec_id, cast(coalesce(distance, -1) as bigint) as distance, score
from told join entries on entries.key = told.key qualify rank <= 10""")
def fuzzy_search_phonetic(spark, sf_dir):
    asked = forward.normalized(derived.text_queries(spark, sf_dir)).select("qid", F.col("qn").alias("q"))
    return _long(fuzzy.fuzzy_entries(derived.index(spark, sf_dir), asked, 10, FuzzyConfig()), "rank", "distance").select("qid", "rank", "key", "rec_id", F.coalesce("distance", F.lit(-1)).alias("distance"), "score")


@registered(o.ENTRIES + " select qid, rank, rec_id from ranked where rank <= 5")
def autocomplete_top(spark, sf_dir):
    return _long(autocomplete.autocomplete(derived.index(spark, sf_dir), derived.text_queries(spark, sf_dir), 5), "rank").select("qid", "rank", "rec_id")


@registered(o.ENTRIES + """ select qid, row_number() over (partition by qid order by sqrt((lon + 89.5) * (lon + 89.5) + (lat - 39.5) * (lat - 39.5)), r) as rank, rec_id
from (select qid, rank as r, rec_id, lon, lat from ranked join rec on id = rec_id where rank <= 40) qualify rank <= 5""")
def autocomplete_biased(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    asked = derived.text_queries(spark, sf_dir).withColumns({"lon": F.lit(-89.5), "lat": F.lit(39.5)})
    return _long(autocomplete.autocomplete_biased(derived.index(spark, sf_dir), records, asked, 5), "rank").select("qid", "rank", "rec_id")


_BATCH = """, results as (
  select q.qid, count(f.rec_id) as n, coalesce(string_agg(cast(f.rec_id as varchar), ' ' order by f.rank), '') as ids, max(case when f.rank = 1 then f.confidence end) as first_confidence
  from queries q left join forwarded f on f.qid = q.qid and f.rank <= 3 group by q.qid
)"""


@registered(o.ENTRIES + o.FUZZY + _BATCH.replace("cast(f.rec_id as varchar)", 'rec."full"').replace("and f.rank <= 3 group", "and f.rank <= 3 left join rec on rec.id = f.rec_id group")
            + " select qid, cast(n as bigint) as n, ids as texts, case when n > 0 then 'matched' else 'nomatch' end as status from results")
def batch_results(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    found = batch.batch(records, derived.index(spark, sf_dir), derived.text_queries(spark, sf_dir), 3)
    return found.select("qid", F.size("results").cast("long").alias("n"), F.array_join("results.address.full", " ").alias("texts"), "status")


@registered(o.ENTRIES + o.FUZZY + _BATCH + """ select count(*) as total, cast(count(*) filter (n > 0) as bigint) as matched, cast(count(*) filter (n = 0) as bigint) as no_match,
  cast(0 as bigint) as errors, round(coalesce(sum(first_confidence) / nullif(count(*) filter (n > 0), 0), 0.0), 9) as avg_confidence from results""")
def batch_summary(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    # a summary asks for each query's first result only
    return batch.summary(batch.batch(records, derived.index(spark, sf_dir), derived.text_queries(spark, sf_dir), 1)).withColumn("avg_confidence", F.round("avg_confidence", 9))


@registered(o.ENTRIES + o.FUZZY + """ select q.qid, cast(case when f.rec_id is null then 0 else 1 end as bigint) as n, rec."full" as address, rec.city as city, f.match_type,
  f.rec_id is not null and rec.city is null as null_city from queries q left join forwarded f on f.qid = q.qid and f.rank = 1 left join rec on rec.id = f.rec_id""")
def batch_json(spark, sf_dir):
    """The bodies of a service's answers, with the best result of each query, read back; parts without a value are written as null."""
    found = batch.batch(derived.records(spark, sf_dir), derived.index(spark, sf_dir), derived.text_queries(spark, sf_dir), 1)
    back = batch.as_json(found).withColumn("results", F.from_json("body", f"results array<{RESULT}>")["results"])
    first = F.get("results", F.lit(0))
    return back.select("qid", F.size("results").cast("long").alias("n"), first["address"]["full"].alias("address"), first["address"]["city"].alias("city"), first["match_type"].alias("match_type"), F.contains("body", F.lit('"city":null')).alias("null_city"))


@registered(o.KNN + " select qid, rank, rec_id, d2 from knn")
def reverse_knn(spark, sf_dir):
    return _long(spatial.nearest_join(derived.records(spark, sf_dir), derived.points(spark, sf_dir), 5), "rank").select("qid", "rank", "rec_id", "d2")


@registered(o.KNN + " select qid, rank, rec_id, least(greatest(1 - sqrt(d2) * 10, 0.0), 1.0) as confidence from knn")
def reverse_confidence(spark, sf_dir):
    return _long(spatial.nearest_join(derived.records(spark, sf_dir), derived.points(spark, sf_dir), 5), "rank").select("qid", "rank", "rec_id", "confidence")


@registered(o.WITH + """ select row_number() over (order by d2, rec_id) as rank, rec_id, d2 from (
  select id as rec_id, (lon + 89.5) * (lon + 89.5) + (lat - 39.5) * (lat - 39.5) as d2 from rec) qualify rank <= 7""")
def reverse_point(spark, sf_dir):
    return _long(spatial.nearest(derived.records(spark, sf_dir), -89.5, 39.5, 7), "rank").select("rank", "rec_id", "d2")


@registered(o.WITH + " select id as rec_id, lon, lat from rec where lon between -89.75 and -89.25 and lat between 39.1 and 39.6")
def within_box(spark, sf_dir):
    return spatial.within_box(derived.records(spark, sf_dir), -89.25, 39.1, -89.75, 39.6).select("rec_id", "lon", "lat")


@registered(o.WITH + " select qid, id as rec_id from points p join rec r on r.lon between p.lon - 0.05 and p.lon + 0.05 and r.lat between p.lat - 0.02 and p.lat + 0.02")
def boxes_join(spark, sf_dir):
    boxes = derived.points(spark, sf_dir).select("qid", (F.col("lon") - 0.05).alias("lon1"), (F.col("lon") + 0.05).alias("lon2"), (F.col("lat") + 0.02).alias("lat1"), (F.col("lat") - 0.02).alias("lat2"))
    return spatial.boxes_join(derived.records(spark, sf_dir), boxes, 0.05)


@registered(o.WITH + """, parts as (select id, nullif(coalesce(house_number, ''), '') as h, nullif(coalesce(street, ''), '') as s, nullif(coalesce(city, ''), '') as c, nullif(coalesce(state, ''), '') as st,
  nullif(coalesce(postcode, ''), '') as z, nullif(coalesce(country, ''), '') as cc, street, case id % 4 when 0 then street when 1 then 'Cafe ' || cast(id as varchar) when 2 then null else '' end as name from rec)
select id, case when name is not null and name <> coalesce(street, '') then name || ', ' else '' end || concat_ws(', ', h, s, c, st, z, cc) as text from parts""")
def osm_full_text(spark, sf_dir):
    rows = derived.records(spark, sf_dir).select("rec_id", "address.*").withColumn("name", F.expr("case rec_id % 4 when 0 then street when 1 then 'Cafe ' || rec_id when 2 then null else '' end"))
    return rows.select(F.col("rec_id").alias("id"), text.osm_full_text(*map(F.col, ("house_number", "street", "city", "state", "postcode", "country", "name"))).alias("text"))


@registered(o.WITH + " select id, concat_ws(' ', nullif(house_number, ''), nullif(street, ''), nullif(city, ''), nullif(state, '')) as text from rec")
def csv_full_text(spark, sf_dir):
    return derived.records(spark, sf_dir).select(F.col("rec_id").alias("id"), text.csv_full_text(*map(F.col, ("address.house_number", "address.street", "address.city", "address.state"))).alias("text"))


_ODD_NUMBERS = """case l_orderkey % 9 when 0 then cast(l_extendedprice as {s}) when 1 then ' ' || cast(l_quantity as {s}) when 2 then cast(l_linenumber as {s}) || '.0d' when 3 then '.' || cast(l_partkey as {s})
  when 4 then cast(l_linenumber as {s}) || '.' when 5 then cast(l_linenumber as {s}) || 'e' || cast(l_linenumber as {s}) when 6 then '-' || cast(l_discount as {s}) when 7 then '' else '+' || cast(l_suppkey as {s}) end"""


@registered(f"""with t as (select l_orderkey, l_linenumber, {_ODD_NUMBERS.format(s="varchar")} as t from lineitem)
select l_orderkey, l_linenumber, case when regexp_matches(t, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(t as double) end as x from t""")
def float_parse(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("t", F.expr(_ODD_NUMBERS.format(s="string")))
    return rows.select("l_orderkey", "l_linenumber", text.parsed_float("t").alias("x"))


@registered("""select l_orderkey as way_id, count(*) as n, round(avg(cast((l_partkey * 13) % 1000 as double) / 1000), 9) as lat, round(avg(cast((l_partkey * 29) % 1000 as double) / 1000), 9) as lon
from lineitem join part on p_partkey = l_partkey group by l_orderkey""")
def way_centroid(spark, sf_dir):
    from placebook.sources.osm import centroids

    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node_id"), F.expr("cast((p_partkey * 13) % 1000 as double) / 1000").alias("lat"), F.expr("cast((p_partkey * 29) % 1000 as double) / 1000").alias("lon"))
    ways = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("way_id")).agg(F.collect_list("l_partkey").alias("refs"))
    return centroids(ways, parts).select("way_id", F.col("n").cast("long").alias("n"), F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@registered(o.ENTRIES + " select (select count(*) from rec) as records, (select count(*) from entries) as entries, (select count(distinct key) from entries) as keys")
def record_stats(spark, sf_dir):
    records = derived.records(spark, sf_dir)
    counts = ix.entries(records).agg(F.count("*").alias("entries"), F.countDistinct("key").alias("keys"))
    return records.agg(F.count("*").alias("records")).crossJoin(counts)  # one row each


@registered("select c_custkey, sha256(c_name) as key_hash from customer")
def key_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", access.key_hash("c_name").alias("key_hash"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("key_id"), "ts", F.col("event_id").alias("request_id"))


@registered("""with recursive e as (
  select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as i from events
), r as (
  select user_id, event_id, t, i, t + 86400000000 as reset, cast(1 as bigint) as used, true as allowed from e where i = 1
  union all
  select e.user_id, e.event_id, e.t, e.i, case when e.t >= r.reset then e.t + 86400000000 else r.reset end,
    case when e.t >= r.reset then 1 when r.used < 2 then r.used + 1 else r.used end, e.t >= r.reset or r.used < 2
  from r join e on e.user_id = r.user_id and e.i = r.i + 1
) select event_id as request_id, allowed from r""")
def daily_quota(spark, sf_dir):
    return access.replay(_requests(spark, sf_dir), RateLimit(1_000_000, 2)).select("request_id", "allowed")


@registered("""with recursive e as (
  select user_id, event_id, h, row_number() over (partition by user_id order by h, event_id) as i from (select user_id, event_id, epoch_us(ts) // 3600 as h from events)
), r as (
  select user_id, event_id, h, i, 0.0::double as tokens, true as allowed from e where i = 1
  union all
  select user_id, event_id, h, i, case when had >= 1 then had - 1 else had end, had >= 1
  from (select e.*, least(1.0::double, r.tokens + (e.h - r.h)::double / 1000000) as had from r join e on e.user_id = r.user_id and e.i = r.i + 1)
) select event_id as request_id, allowed, case when not allowed then 'Rate limit exceeded (per-second)' end as reason, cast(case when not allowed then 1000 end as bigint) as retry_after_ms from r""")
def token_bucket(spark, sf_dir):
    # a request a second for a request log that is sped up: an hour counts as a second
    log = _requests(spark, sf_dir)
    hours = log.withColumn("ts", F.timestamp_micros(F.floor(access.micros(log) / 3600).cast("long")))
    return access.replay(hours, RateLimit(1, 0)).select("request_id", "allowed", "reason", "retry_after_ms")


@registered("select event_type as verb, count(*) as requests from events group by event_type")
def request_counters(spark, sf_dir):
    return access.request_counters(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("verb")))


@registered(o.WITH + ' select id as rec_id, "full" as address, lat, lon from rec')
def store_roundtrip(spark, sf_dir):
    from placebook.sources import store
    from placebook.sources.staging import new_path

    path = new_path(spark, "gazetteer")
    store.save(derived.records(spark, sf_dir), path, "derived")
    return store.load(spark, path).select("rec_id", F.col("address.full").alias("address"), "lat", "lon")


@registered(o.WITH + " select cast(1 as bigint) as version, count(*) as record_count, 'derived' as source, true as no_coverage, true as is_rfc3339 from rec")
def store_metadata(spark, sf_dir):
    from placebook.sources import store
    from placebook.sources.staging import new_path

    path = new_path(spark, "gazetteer")
    store.save(derived.records(spark, sf_dir), path, "derived")
    is_time = F.col("created_at").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$")
    return store.metadata(spark, path).select(F.col("version").cast("long").alias("version"), F.col("record_count").cast("long").alias("record_count"), "source", F.col("coverage").isNull().alias("no_coverage"), is_time.alias("is_rfc3339"))


@registered(o.WITH + ' select id as rec_id, "full" as address, round(lat, 3) as lat, round(lon, 3) as lon from rec')
def ingest_csv(spark, sf_dir):
    """Writes the gazetteer as an address CSV and reads it back: texts keep their commas inside quotes."""
    from placebook.sources import addresses_csv
    from placebook.sources.staging import new_path

    path = new_path(spark, "csv")
    rows = derived.gazetteer(spark, sf_dir).select(F.col("lon").alias("LON"), F.col("lat").alias("LAT"), F.lit("").alias("NUMBER"), F.trim("raw").alias("STREET"), F.col("id").cast("string").alias("POSTCODE"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = addresses_csv.read(spark, path)
    return found.select(F.col("address.postcode").cast("long").alias("rec_id"), F.col("address.full").alias("address"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


def _documents(rows: DataFrame, head: str, path: str) -> None:
    """Write rows (id, item) as JSON documents of about 500 items each, one a file: ``head`` opens the document and its array."""
    cut = rows.withColumn("doc", F.floor(F.col("id") / 500)).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("items"))
    text = F.concat(F.lit(head), F.array_join("items.item", ",\n"), F.lit("]}"))
    cut.select("doc", text.alias("value")).write.partitionBy("doc").text(path)


_FEATURE = """case id % 9 when 0 then '{"type":"Feature"}'
  when 1 then '{"geometry":{"coordinates":[' || lon || ']},"properties":{"address":"' || raw || '"}}'
  when 2 then '{"geometry":{"coordinates":[' || lon || ',' || lat || ']},"properties":{"address":null,"name":"' || raw || '"}}'
  when 3 then '{"geometry":{"coordinates":[' || lon || ',' || lat || ']},"properties":{"name":"' || raw || '"}}'
  when 4 then '{"geometry":{"coordinates":["x",' || lat || ']},"properties":{"address":"' || raw || '"}}'
  when 5 then '{"geometry":{"coordinates":[' || lon || ',' || lat || ']},"properties":{"address":7,"name":"' || raw || '"}}'
  else '{"geometry":{"coordinates":[' || lon || ',' || lat || ']},"properties":{"address":"' || raw || '","name":"no"}}' end"""


@registered(o.WITH + """ select "full" as address, street, round(case id % 9 when 4 then 0 else lon end, 3) as lon, round(lat, 3) as lat from rec where id % 9 not in (0, 1, 2, 5)""")
def ingest_geojson(spark, sf_dir):
    """Writes the gazetteer as feature collections, with features that must be left out, and reads it back."""
    from placebook.sources import geojson
    from placebook.sources.staging import new_path

    path = new_path(spark, "geojson")
    _documents(derived.gazetteer(spark, sf_dir).select("id", F.expr(_FEATURE).alias("item")), '{"type":"FeatureCollection","features":[', path)
    return geojson.read(spark, path).select(F.col("address.full").alias("address"), "address.street", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))


@registered(o.WITH + """, t as (select *, concat_ws(', ', nullif(coalesce(house_number, ''), ''), nullif(coalesce(street, ''), ''), nullif(coalesce(city, ''), ''), nullif(coalesce(state, ''), ''), nullif(coalesce(postcode, ''), ''), nullif(coalesce(country, ''), '')) as txt from rec)
select case id % 4 when 0 then 'Cafe, ' || txt else txt end as address, round(lon, 3) as lon, round(lat, 3) as lat from t where id % 4 in (0, 1)""")
def ingest_overpass_json(spark, sf_dir):
    """Writes the gazetteer as Overpass answers: nodes, ways with a centre, elements without a position and without tags."""
    from placebook.sources import osm
    from placebook.sources.staging import new_path

    tags = F.struct(*(F.col(f"address.{field}").alias(tag) for field, tag in osm.TAGS.items()), F.expr("if(rec_id % 4 = 0, 'Cafe', null)").alias("name"))
    kind = F.col("rec_id") % 4
    place = F.when(kind == 1, F.struct("lat", "lon"))
    element = F.struct(
        F.when(kind == 1, "way").otherwise("node").alias("type"), F.when(kind != 1, F.col("lat")).alias("lat"), F.when((kind == 0) | (kind == 3), F.col("lon")).alias("lon"),
        place.alias("center"), F.when(kind != 3, tags).alias("tags"),
    )
    path = new_path(spark, "overpass")
    _documents(derived.records(spark, sf_dir).select(F.col("rec_id").alias("id"), F.to_json(element).alias("item")), '{"version":0.6,"elements":[', path)
    return osm.read_json(spark, path).select(F.col("address.full").alias("address"), F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))


@registered(o.WITH + ' select "full" as address, round(lon, 3) as lon, round(lat, 3) as lat from rec where id % 10 > 1')
def ingest_overpass_tsv(spark, sf_dir):
    """Writes the gazetteer as tab-separated answers, with rows without a number or a name, and reads it back."""
    from placebook.sources import osm
    from placebook.sources.staging import new_path

    path = new_path(spark, "tsv")
    rows = derived.records(spark, sf_dir).select(F.expr("if(rec_id % 10 = 0, 'x', string(lat))").alias("@lat"), F.col("lon").cast("string").alias("@lon"), F.expr("if(rec_id % 10 = 1, '', address.full)").alias("name"))
    rows.write.option("sep", "\t").option("header", True).csv(path)
    return osm.read_tsv(spark, path).select(F.col("address.full").alias("address"), F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))


_OBJECTS = """
select 'node' as kind, rec_id as id, lat, lon, cast(null as array<bigint>) as refs, {tags} as tags from {rec} where rec_id % 4 <> 2
union all select 'way', rec_id, null, null, array(-4 * rec_id - 1, -4 * rec_id - 2, -4 * rec_id - 1, -4 * rec_id - 3), {tags} from {rec} where rec_id % 4 = 2
union all select 'node', -4 * rec_id - n, lat + (n - 1) * 0.3D, lon + (n - 1) * 0.6D, null, cast(map() as map<string, string>) from {rec}, lateral explode(array(1, 2)) as x(n) where rec_id % 4 = 2"""


@registered(o.WITH + """, t as (select *, concat_ws(', ', nullif(coalesce(house_number, ''), ''), nullif(coalesce(street, ''), ''), nullif(coalesce(city, ''), ''), nullif(coalesce(state, ''), ''), nullif(coalesce(postcode, ''), ''), nullif(coalesce(country, ''), '')) as txt
  from rec where house_number is not null and street is not null and id % 4 <> 1)
select case id % 4 when 3 then 'Cafe, ' || txt else txt end as address, round(lon + case id % 4 when 2 then 0.2 else 0 end, 3) as lon, round(lat + case id % 4 when 2 then 0.1 else 0 end, 3) as lat from t where txt <> ''""")
def ingest_pbf(spark, sf_dir):
    """Writes the gazetteer as an OSM extract, nodes and ways with nodes that are missing, and reads it back; objects without a number or a street are left out."""
    from placebook.sources import osm, osm_pbf
    from placebook.sources.staging import new_path

    tags = ", ".join(f"'{tag}', {'if(rec_id % 4 = 1, null, address.street)' if field == 'street' else f'address.{field}'}" for field, tag in osm.TAGS.items())
    tags = f"map_filter(map({tags}, 'name', if(rec_id % 4 = 3, 'Cafe', null)), (k, v) -> v is not null)"
    path = new_path(spark, "pbf")
    osm_pbf.write(spark.sql(_OBJECTS.replace("{tags}", tags), rec=derived.records(spark, sf_dir)), path)
    return osm.read_pbf(spark, path).select(F.col("address.full").alias("address"), F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"))


@registered(o.WITH + ' select id as rec_id, "full" as address, round(lat, 3) as lat, round(lon, 3) as lon from rec where id % 5 > 1')
def ingest_csv_bad_rows(spark, sf_dir):
    """Like ingest_csv, by other header names and with coordinates that are no numbers."""
    from placebook.sources import addresses_csv
    from placebook.sources.staging import new_path

    path = new_path(spark, "csv")
    lon = F.expr("case id % 5 when 0 then 'east' when 1 then lon || 'd' else string(lon) end")
    rows = derived.gazetteer(spark, sf_dir).select(F.col("id").cast("string").alias("zip"), F.trim("raw").alias("street"), F.col("lat").alias("latitude"), lon.alias("longitude"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = addresses_csv.read(spark, path)
    return found.select(F.col("address.postcode").cast("long").alias("rec_id"), F.col("address.full").alias("address"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


@registered(o.WITH + ', r as (select id, "full" as address from rec) select id as rec_id, address from r union all select id + (select count(*) from r), address from r')
def append_records(spark, sf_dir):
    from placebook.sources.rows import appended

    records = derived.records(spark, sf_dir)
    return appended(records, records).select("rec_id", F.col("address.full").alias("address"))


_KEYS = "select c_custkey as id, c_name as raw_key, c_custkey % 5 = 0 as revoked from {customer}"


@registered("select c_custkey as id from customer where c_custkey % 5 <> 0 and c_custkey % 3 = 0")
def validate_keys(spark, sf_dir):
    """The stored keys, by hash and not revoked, of the raw keys that a third of the customers show, and of unknown ones."""
    given = spark.sql(_KEYS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    keys = given.select("id", access.key_hash("raw_key").alias("key_hash"), "revoked")
    shown = given.select(F.expr("if(id % 3 = 0, raw_key, 'no such ' || raw_key)").alias("raw_key"))
    return access.validate(keys, shown).select("id")


@registered("select c_custkey as id, c_custkey % 5 = 0 or c_custkey % 7 = 0 as revoked from customer")
def revoke_keys(spark, sf_dir):
    keys = spark.sql(_KEYS, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))
    return access.revoke(keys, keys.filter("id % 7 = 0")).select("id", "revoked")


@registered(o.ENTRIES + " select qid, rec_id from asked join entries on starts_with(full_key, x) where x <> '' group by qid, rec_id")
def sql_prefix_lookup(spark, sf_dir):
    """Forward lookup in SQL alone: a table function with a lateral join."""
    from placebook.functions import sql

    sql.register(spark)
    sql.register_lookups(derived.records(spark, sf_dir), derived.index(spark, sf_dir))
    # each text is looked up once, under the least of the queries that ask for it
    given = staged(derived.text_queries(spark, sf_dir), "asked")
    asked = staged(given.groupBy("q").agg(F.min("qid").alias("qid"), F.count("*").alias("n")), "texts")
    found = spark.sql("select a.qid, h.rec_id from (select qid, normalize_for_match(q) as qn from {asked}) a, lateral prefix_lookup(a.qn) h where a.qn <> ''", asked=asked)
    hits = found.select(F.col("qid").alias("tid"), F.row_number().over(Window.partitionBy("qid").orderBy("rec_id")).alias("nth"), "rec_id")
    members = given.join(asked.select("q", "n", F.col("qid").alias("tid")), "q")
    return every(tiles(members, "tid", "qid"), blocks(hits, "tid", "nth"), "tid", "qid").select("qid", "rec_id")


@registered(o.WITH + """ select qid, p.id as rec_id, round(d2, 9) as d2, row_number() over (partition by qid order by d2, p.id) as rank
  from (select q.qid, g.id, (g.lon - q.lon) * (g.lon - q.lon) + (g.lat - q.lat) * (g.lat - q.lat) as d2 from points q join gaz g on abs(g.lon - q.lon) <= 0.011 and abs(g.lat - q.lat) <= 0.011) p where d2 <= 0.01 * 0.01 qualify rank <= 3""")
def sql_near_lookup(spark, sf_dir):
    """Reverse lookup in SQL alone: the first three records within a hundredth of a degree."""
    from placebook.functions import sql

    # of the records at one place the first three, and each point once, under the least of the queries that ask for it
    sql.register_lookups(spatial.first_at_places(derived.records(spark, sf_dir), 3), derived.index(spark, sf_dir), 0.01)
    points = derived.points(spark, sf_dir)
    once = staged(points.groupBy("lon", "lat").agg(F.min("qid").alias("qid")), "points")
    near = spark.sql("""select qid, rec_id, round(d2, 9) as d2, cast(rank as bigint) as rank from (
        select p.qid, n.rec_id, n.d2, row_number() over (partition by p.qid order by n.d2, n.rec_id) as rank from {points} p, lateral near_lookup(p.lon, p.lat) n) where rank <= 3""", points=once)
    at = points.join(once.withColumnRenamed("qid", "tid"), ["lon", "lat"]).select("qid", "tid")
    return at.join(near.withColumnRenamed("qid", "tid"), "tid").select("qid", "rec_id", "d2", "rank")


@registered(o.WITH + f', p as ({o.parsed("odd", "t")}) select id, house_number, street, city, "full" from p')
def sql_parse_address(spark, sf_dir):
    """The parser as a SQL function."""
    from placebook.functions import sql

    sql.register(spark)
    return spark.sql("select id, a.house_number, a.street, a.city, a.full from (select id, parse_address(t) as a from {odd})", odd=odd_texts(spark, sf_dir))


@registered(o.ENTRIES + " select rec_id, key_ord, key from entries")
def index_runs(spark, sf_dir):
    """An index that is changed instead of made again: stale texts are replaced, records go and come back; what is read equals the index of all records."""
    from placebook.operators.index_runs import IndexRuns
    from placebook.sources.staging import new_path

    records = derived.records(spark, sf_dir)
    stale = records.withColumn("address", F.when(F.col("rec_id") % 3 == 0, text.parse_address(F.lit("9 Old Road, Nowhere, XX"))).otherwise(F.col("address")))
    runs = IndexRuns(spark, new_path(spark, "runs"))
    runs.create(stale)
    runs.put(records.filter("rec_id % 3 = 0"))
    runs.remove(records.filter("rec_id % 10 = 9"))
    runs.put(records.filter("rec_id % 20 = 9"))
    runs.compact()
    runs.put(records.filter("rec_id % 20 = 19"))
    return _long(runs.read(), "key_ord").select("rec_id", "key_ord", "key")


_TIER = ("default", "free", "pro", "enterprise")


@registered("""select distinct user_id as key_id, ['default', 'free', 'pro', 'enterprise'][user_id % 4 + 1] as tier, [100, 10, 100, 1000][user_id % 4 + 1]::bigint as per_second,
  [100000, 10000, 500000, 0][user_id % 4 + 1]::bigint as per_day from events""")
def tier_limits(spark, sf_dir):
    """What the tier of each user's key allows."""
    tier = F.element_at(F.array(*map(F.lit, _TIER)), (F.col("user_id") % 4 + 1).cast("int"))
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key_id"), tier.alias("tier")).distinct()
    return access.with_limits(keys).select("key_id", "tier", "per_second", "per_day")


@registered(o.WITH + """ select f, "full" as address from rec, (select unnest(['csv', 'geojson', 'txt']) as f)""")
def load_by_ending(spark, sf_dir):
    """The gazetteer written as CSV and as GeoJSON, read back by the endings of the folders' names; what has no known one is CSV."""
    from placebook.sources import loader
    from placebook.sources.staging import new_path

    raw = derived.gazetteer(spark, sf_dir)
    out = None
    for ending in ("csv", "geojson", "txt"):
        path = f"{new_path(spark, 'named')}.{ending}"
        if ending == "geojson":
            feature = F.to_json(F.struct(F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct(F.col("raw").alias("address")).alias("properties")))
            _documents(raw.select("id", feature.alias("item")), '{"features":[', path)
        else:
            raw.select(F.col("lon").alias("LON"), F.col("lat").alias("LAT"), F.col("raw").alias("STREET")).write.option("header", True).option("escape", '"').csv(path)
        read = loader.load(spark, path).select(F.lit(ending).alias("f"), F.col("address.full").alias("address"))
        out = read if out is None else out.unionByName(read)
    return out


@registered(o.WITH + ' select id as rec_id, "full" as address from rec union all select id + (select count(*) from rec), "full" from rec')
def append_sources(spark, sf_dir):
    """Records of one source after those of another: ids run on."""
    from placebook.sources import rows

    records = derived.records(spark, sf_dir)
    return rows.appended(records, records).select("rec_id", F.col("address.full").alias("address"))
