"""OpenStreetMap answers as JSON and as tab-separated text, and what objects of all OSM sources have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.functions.text import osm_full_text, parsed_float
from placebook.sources import json_items
from placebook.sources.rows import as_records, placed
from placebook.sources.staging import staged

# The tags of an address, in the order of its fields.
TAGS = {"house_number": "addr:housenumber", "street": "addr:street", "city": "addr:city", "state": "addr:state", "postcode": "addr:postcode", "country": "addr:country"}
_TAG_FIELDS = ", ".join(f"`{t}`: string" for t in (*TAGS.values(), "name"))
ELEMENTS = f"struct<elements: array<struct<type: string, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: struct<{_TAG_FIELDS}>>>, _bad: string>"


class NoElements(ValueError):
    """The document has no elements."""


class MalformedDocument(ValueError):
    """The document is no JSON, or a value has another type than it must have."""


def address_of(tag) -> tuple[Column, Column]:
    """(address struct, its text) from a function that gives a tag's Column."""
    parts = {field: tag(name) for field, name in TAGS.items()}
    text = osm_full_text(*parts.values(), tag("name"))
    return F.struct(*(c.alias(field) for field, c in parts.items()), text.alias("full")), text


def read_json(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Records of Overpass JSON, one document a file: elements with a position (their own, or a centre) and a street or a name; a file of more than one split is read in splits."""
    if json_items.large(spark, path):
        try:
            found, there = json_items.items(spark, path, "elements")
        except json_items.NotWhole as e:
            raise MalformedDocument(path) from e
        files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
        found = staged(found.select("_file", "_block", "_row", "_pos", F.to_json("item").alias("value")), "items")
        if not files.join(there, "_file", "left_anti").isEmpty() or not files.join(found, "_file", "left_anti").isEmpty():
            raise NoElements(path)
        # an item is checked and read as a document of its own
        docs = found.select(F.concat(F.lit('{"elements":['), "value", F.lit("]}")).alias("value"), "_file", "_block", F.struct("_row", "_pos").alias("_at"))
        return _elements(docs, path, start)
    docs = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_block"), F.struct(F.lit(0).cast("long").alias("_row"), F.lit(0).alias("_pos")).alias("_at"))
    return _elements(docs, path, start)


def _elements(docs: DataFrame, path: str, start: int) -> DataFrame:
    """The records of documents (value, _file, _block, _at), read typed and checked."""
    read = docs.withColumn("d", F.from_json("value", ELEMENTS.replace(": ", ":"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    # from_json turns numbers into text where text is due; a typed reader does not
    loose = F.expr("exists(coalesce(from_json(value, 'struct<elements:array<struct<tags:map<string,variant>>>>').elements, array()), e -> exists(map_entries(e.tags), t -> (t.key like 'addr:%' or t.key = 'name') and schema_of_variant(t.value) not in ('STRING', 'VOID')))")
    fault = F.when(F.col("d").isNull() | F.col("d._bad").isNotNull() | loose, "malformed").when(F.expr("coalesce(size(d.elements), 0) <= 0"), "none")
    # parsed once, for the checks and for the records
    parsed = staged(read.withColumn("_fault", fault).select("_file", "_block", "_at", "_fault", F.expr("posexplode_outer(d.elements)").alias("_row", "e")), "elements")
    faults = {r["_fault"] for r in parsed.select("_fault").distinct().collect()}  # three values at most
    if "malformed" in faults:
        raise MalformedDocument(path)
    if "none" in faults:
        raise NoElements(path)
    rows = parsed.drop("_fault")
    own = F.col("e.lat").isNotNull() & F.col("e.lon").isNotNull()
    tag = lambda name: F.col(f"e.tags.`{name}`")
    address, text = address_of(tag)
    kept = rows.select(
        "_file", "_block", "_at", "_row", F.when(own, F.col("e.lat")).otherwise(F.col("e.center.lat")).alias("lat"), F.when(own, F.col("e.lon")).otherwise(F.col("e.center.lon")).alias("lon"),
        address.alias("address"), text.alias("_t"), (tag("addr:street").isNotNull() | tag("name").isNotNull()).alias("_some"),
    )
    return as_records(kept.filter("lat is not null and lon is not null and _some and _t <> ''"), ["_at", "_row"], start)


def read_tsv(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Records of Overpass CSV: tab-separated, with @lat, @lon and name; without a position column there are none."""
    table = spark.read.option("sep", "\t").option("header", False).csv(path)
    first = table.first()
    header = [x or "" for x in first] if first else []
    names = [f"c{k}" for k in range(len(header))] or ["c0"]
    rows = placed(spark.read.option("sep", "\t").option("header", True).option("enforceSchema", True).schema(", ".join(f"{n} string" for n in names)).csv(path))
    get = lambda name: F.col(f"c{header.index(name)}") if name in header else F.lit(None).cast("string")
    none = F.lit(None).cast("string")
    address = F.struct(*(none.alias(f) for f in TAGS), get("name").alias("full"))
    kept = rows.select(address.alias("address"), parsed_float(get("@lat")).alias("lat"), parsed_float(get("@lon")).alias("lon"), "_file", "_block", "_row")
    return as_records(kept.filter("lat is not null and lon is not null and address.full <> ''"), ["_row"], start)


def centroids(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, n, lat, lon): the mean position of a way's nodes (way_id, refs), each reference counting; unknown nodes are left out."""
    refs = ways.select("way_id", F.explode("refs").alias("node_id"))
    return refs.join(nodes.select("node_id", "lat", "lon"), "node_id").groupBy("way_id").agg(F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def read_pbf(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """Records of an OSM PBF extract: nodes and ways tagged with house number and street, nodes before ways, by id."""
    from placebook.sources import osm_pbf

    # decoded once; what follows reads the columns and kinds that it needs
    objects = staged(osm_pbf.read(spark, path), "objects")
    some = objects.filter(F.map_contains_key("tags", "addr:housenumber") & F.map_contains_key("tags", "addr:street"))
    nodes = objects.filter("kind = 'node'").select(F.col("id").alias("node_id"), "lat", "lon")
    ways = some.filter("kind = 'way'")
    middle = centroids(ways.select(F.col("id").alias("way_id"), "refs"), nodes).select(F.col("way_id").alias("id"), "lat", "lon")
    placed_ways = ways.drop("lat", "lon").join(middle, "id")
    every = some.filter("kind = 'node'").select("kind", "id", "lat", "lon", "tags").unionByName(placed_ways.select("kind", "id", "lat", "lon", "tags"))
    address, text = address_of(lambda name: F.try_element_at(F.col("tags"), F.lit(name)))
    # blocks of ids stand for splits of a file: nodes, then ways
    rows = every.select(address.alias("address"), text.alias("_t"), "lat", "lon", F.col("kind").alias("_file"), F.floor(F.col("id") / 1_000_000).cast("long").alias("_block"), F.col("id").alias("_row"))
    return as_records(rows.filter("_t <> ''"), ["_row"], start)
