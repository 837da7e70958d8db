import csv
import io
import json
import random
import struct
import zlib

import pytest

from placebook.geocoder import Geocoder
from placebook.operators import forward
from placebook.operators.index import entries
from placebook.operators.index_runs import IndexRuns
from placebook.schema import RECORDS
from placebook.sources import addresses_csv, csv_lines, geojson, json_items, loader, osm, osm_pbf, rows, store
from placebook.sources.staging import put_once


def got(df):
    return [(r.address.full, r.lon, r.lat) for r in df.orderBy("rec_id").collect()]


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "a.csv", 'LON,LAT,NUMBER,STREET,CITY,REGION,POSTCODE\n-90,39,123,Main St,Springfield,IL,62701\n-90.5,39.5,,"Oak, ""Old"" Ave",Town,,\nx,1,1,A,B,C,D\n 1 ,1,1,A,B,C,D\n1.0d,1,1,A,B,C,D\n1,2,7,"two\nlines",,,\n')
    df = addresses_csv.read(spark, path)
    assert got(df) == [("123 Main St Springfield IL", -90.0, 39.0), ('Oak, "Old" Ave Town', -90.5, 39.5), ("7 two\nlines", 1.0, 2.0)]
    first = df.orderBy("rec_id").first()
    assert [r.rec_id for r in df.orderBy("rec_id").collect()] == [0, 1, 2] and (first.address.postcode, first.address.state, first.address.country) == ("62701", "IL", None)
    again = rows.appended(df, addresses_csv.read(spark, put(tmp_path, "b.csv", "zip,state,house_number,street,longitude,latitude\n1,IL,5,Elm,7,8\n")))
    assert got(again)[-1] == ("5 Elm IL", 7.0, 8.0) and again.agg({"rec_id": "max"}).first()[0] == 3


def test_csv_with_quoted_breaks_in_several_tasks(spark, tmp_path):
    """Splits begin anywhere, inside quoted fields too: all records are those that one reader of the whole file finds, in order."""
    rng = random.Random(3)
    bits = ["Main", '""', ",", "\n", '5" pipe', "\r\n", "a,b", "x" * 40, "\n\n", "'", "Ünit"]
    fields, out = [], ["LON,LAT,NUMBER,STREET,CITY,REGION,POSTCODE"]
    for k in range(400):
        street = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6))) or "s"
        plain = not any(c in street for c in '",\r\n') or (street.startswith("5") and not any(c in street for c in ",\r\n"))
        fields.append((street.replace('""', '"') if not plain else street, str(k)))
        quoted = street if plain else '"' + fields[-1][0].replace('"', '""') + '"'
        out.append(f"{k},1,,{quoted},T,,{k}")
    path = tmp_path / "a.csv"
    path.write_bytes("\n".join(out).encode())
    want = list(csv.reader(io.StringIO("\n".join(out), newline="")))[1:]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = csv_lines.records(spark, str(path))
        found = [r.value for r in lines.orderBy("_block", "_row").collect()]
        assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [next(csv.reader(io.StringIO(v, newline=""))) for v in found[1:]] == want and len(want) == 400
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        df = addresses_csv.read(spark, str(path))
        assert [(r.address.street, r.address.postcode) for r in df.orderBy("rec_id").collect()] == [(w[3], w[6]) for w in want]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got(addresses_csv.read(spark, put(tmp_path, "mac.csv", "LON,LAT,STREET\r1,2,A\r3,4,B"))) == [("A", 1.0, 2.0), ("B", 3.0, 4.0)]


def test_large_json_documents_in_several_tasks(spark, tmp_path):
    """One line of JSON with braces, brackets and quotes in its texts, objects beside the array and items that are none: splits give what one reading gives."""
    rng = random.Random(4)
    texts = ["a}b", "[{", '"', "\\\\", '\\"}', "plain", "}]", "é{}", '"features":[', "x" * 30]
    features = []
    for k in range(300):
        name = f"{k} " + "".join(rng.choice(texts) for _ in range(rng.randrange(0, 4))) + "."
        feature = {"type": "Feature", "properties": {"deep": {"a": [{"b": 1}, [2]]}, "name": name}, "geometry": {"type": "Point", "coordinates": [k, 1.5]}}
        features.append(rng.choice([feature, feature, feature, {}, 7, "text}", None, [{"x": {}}], {"geometry": None}]))
    document = {"type": "FeatureCollection", "crs": {"properties": {"name": "features", "features": [{"no": 1}]}}, "bbox": [1, 2], "features": features, "more": [{"a": {}}, {"b": []}], "end": {"z": {}}}
    path = put(tmp_path, "a.geojson", json.dumps(document, ensure_ascii=False) + rng.choice(["", "\n"]))
    want = [(f["properties"]["name"], float(f["geometry"]["coordinates"][0]), 1.5) for f in features if isinstance(f, dict) and f.get("geometry")]
    elements = [{"type": "node", "lat": 1.0, "lon": float(k), "tags": {"name": f"n{k}" + "".join(rng.choice(texts) for _ in range(3))}} for k in range(200)] + [{"type": "way", "tags": {}}]
    other = put(tmp_path, "b.json", json.dumps({"version": 0.6, "osm3s": {"t": {"elements": [1]}}, "elements": elements}, indent=1))
    assert got(geojson.read(spark, path)) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert json_items.large(spark, path) and spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 5
        assert got(geojson.read(spark, path)) == want
        assert got(osm.read_json(spark, other)) == [(e["tags"]["name"], e["lon"], 1.0) for e in elements[:-1]]
        for name, text, error in [
            ("c.geojson", '{"type": "FeatureCollection", "other": [' + '{"a": 1},' * 300 + "{}]}", geojson.NotFeatureCollection), ("d.geojson", json.dumps(document)[:-3], json_items.NotWhole),
        ]:
            with pytest.raises(error):
                geojson.read(spark, put(tmp_path, name, text))
        for name, text, error in [
            ("e.json", '{"elements": [], "other": [' + '{"a": 1},' * 300 + "{}]}", osm.NoElements), ("f.json", json.dumps({"elements": elements})[:-1], osm.MalformedDocument),
            ("g.json", json.dumps({"elements": [*elements, {"type": "node", "lat": 1, "lon": 2, "tags": {"addr:street": 7}}]}), osm.MalformedDocument),
        ]:
            with pytest.raises(error):
                osm.read_json(spark, put(tmp_path, name, text))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_errors(spark, tmp_path):
    with pytest.raises(addresses_csv.MissingColumn, match="LON"):
        addresses_csv.read(spark, put(tmp_path, "a.csv", "LAT,STREET\n1,A\n"))
    with pytest.raises(addresses_csv.MissingColumn, match="LAT"):
        addresses_csv.read(spark, put(tmp_path, "c.csv", "LON,STREET\n1,A\n"))
    with pytest.raises(Exception, match="(?i)malformed"):
        addresses_csv.read(spark, put(tmp_path, "b.csv", "LON,LAT,STREET\n1,2,A\n1,2\n")).count()


def test_geojson(spark, tmp_path):
    def feature(coordinates, properties, kind="Point"):
        return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates}, "properties": properties}

    features = [
        feature([-90.1, 39.2], {"address": "12 Main St, Town, IL"}), feature([1, 2], {"name": "Cafe"}), feature([1, 2], {"address": None, "name": "no"}), feature([1, 2], {"address": 7, "name": "no"}),
        feature([1, 2], {"address": "", "name": "no"}), feature([[1, 2], [3, 4]], {"name": "Line"}, "LineString"), feature(["7", 3], {"name": "Text"}), feature([1], {"name": "short"}), {"type": "Feature"},
    ]
    path = put(tmp_path, "a.geojson", json.dumps({"features": features}))
    df = geojson.read(spark, path)
    assert got(df) == [("12 Main St, Town, IL", -90.1, 39.2), ("Cafe", 1.0, 2.0), ("Line", 0.0, 0.0), ("Text", 0.0, 3.0)]
    assert df.orderBy("rec_id").first().address.house_number == "12"
    with pytest.raises(geojson.NotFeatureCollection):
        geojson.read(spark, put(tmp_path, "b.json", '{"type": "FeatureCollection"}'))


def test_overpass_json(spark, tmp_path):
    elements = [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"addr:housenumber": "5", "addr:street": "Main", "addr:city": "Town", "name": "Cafe"}},
        {"type": "way", "center": {"lat": 3.0, "lon": 4.0}, "tags": {"addr:street": "Elm", "name": "Elm"}},
        {"type": "node", "lat": 1.0, "lon": 2.0, "tags": {}}, {"type": "node", "lat": 1.0, "lon": 2.0}, {"type": "node", "lat": 1, "tags": {"name": "no place"}}, {"type": "node", "lat": 5, "lon": 6, "tags": {"name": "Only name"}},
    ]
    df = osm.read_json(spark, put(tmp_path, "a.json", json.dumps({"version": 1, "elements": elements})))
    assert got(df) == [("Cafe, 5, Main, Town", 2.0, 1.0), ("Elm", 4.0, 3.0), ("Only name", 6.0, 5.0)]
    with pytest.raises(osm.NoElements):
        osm.read_json(spark, put(tmp_path, "b.json", '{"elements": []}'))
    with pytest.raises(osm.MalformedDocument):
        osm.read_json(spark, put(tmp_path, "c.json", '{"elements": [{"lat": 1, "lon": 1, "tags": {"addr:street": 5}}]}'))


def test_overpass_tsv(spark, tmp_path):
    df = osm.read_tsv(spark, put(tmp_path, "a.tsv", "@lat\t@lon\tname\n1.5\t2.5\tTown Hall\nx\t1\tno\n1\t2\t\n"))
    assert got(df) == [("Town Hall", 2.5, 1.5)]
    assert osm.read_tsv(spark, put(tmp_path, "b.tsv", "lat\t@lon\tname\n1\t2\tno\n")).count() == 0


# a small encoder of the public PBF format


def varint(x):
    out = b""
    while True:
        out += bytes([x & 0x7F | (0x80 if x > 0x7F else 0)])
        x >>= 7
        if not x:
            return out


def zigzag(x):
    return x * 2 if x >= 0 else -x * 2 - 1


def field(n, value):
    return varint(n << 3) + varint(value) if isinstance(value, int) else varint(n << 3 | 2) + varint(len(value)) + value


def packed(values, signed=False):
    return b"".join(varint(zigzag(v) if signed else v) for v in values)


def deltas(values):
    return [b - a for a, b in zip([0, *values], values)]


def blob(kind, content, raw=False):
    body = field(1, content) if raw else field(2, len(content)) + field(3, zlib.compress(content))
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def block(dense=(), nodes=(), ways=(), relations=()):
    strings = [""]

    def s(x):
        if x not in strings:
            strings.append(x)
        return strings.index(x)

    tagged = lambda tags: field(2, packed([s(k) for k in tags])) + field(3, packed([s(v) for v in tags.values()]))
    group = b""
    if dense:
        pairs = []
        for _, _, _, tags in dense:
            for k, v in tags.items():
                pairs += [s(k), s(v)]
            pairs.append(0)
        columns = [[d[0] for d in dense], [round(d[1] * 1e7) for d in dense], [round(d[2] * 1e7) for d in dense]]
        group += field(2, b"".join(field(n, packed(deltas(c), True)) for n, c in zip((1, 8, 9), columns)) + field(10, packed(pairs)))
    for i, lat, lon, tags in nodes:
        group += field(1, field(1, zigzag(i)) + tagged(tags) + field(8, zigzag(round(lat * 1e7))) + field(9, zigzag(round(lon * 1e7))))
    for i, refs, tags in ways:
        group += field(3, field(1, i) + tagged(tags) + field(8, packed(deltas(refs), True)))
    for i, tags in relations:
        group += field(4, field(1, i) + tagged(tags))
    return field(1, b"".join(field(1, x.encode()) for x in strings)) + field(2, group) + field(17, 100)


def test_pbf(spark, tmp_path):
    a = lambda n, **more: {"addr:housenumber": str(n), "addr:street": "Main", **more}
    data = blob(b"OSMHeader", b"", True) + blob(b"OSMData", block(dense=[(5, 1.0, -2.0, a(5)), (1, 0.5, 0.5, {}), (2, 1.5, 2.5, {"addr:street": "only"}), (9, -10.0, 20.0, a(9, name="Cafe"))]))
    data += blob(b"OSMData", block(nodes=[(3, 3.0, 3.0, {})], ways=[(7, [1, 2, 1], a(7)), (8, [1, 404], a(8)), (6, [404], a(6)), (4, [1], {"highway": "x"})], relations=[(10, a(10))]), True)
    (tmp_path / "a.osm.pbf").write_bytes(data)
    path = str(tmp_path / "a.osm.pbf")
    df = loader.load(spark, path)
    assert [(t, round(x, 6), round(y, 6)) for t, x, y in got(df)] == [("5, Main", -2.0, 1.0), ("Cafe, 9, Main", 20.0, -10.0), ("7, Main", round((0.5 + 2.5 + 0.5) / 3, 6), round((0.5 + 1.5 + 0.5) / 3, 6)), ("8, Main", 0.5, 0.5)]
    # more tasks than blobs: each blob is read once, whichever tasks its bytes fall to
    few = osm_pbf.read(spark, path).orderBy("kind", "id").collect()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 64)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        many = osm_pbf.read(spark, path)
        assert many.rdd.getNumPartitions() > 5 and many.orderBy("kind", "id").collect() == few and len(few) == 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.id, r.tags.get("addr:street")) for r in few if r.kind == "node"] == [(1, None), (2, "only"), (3, None), (5, "Main"), (9, "Main")]
    assert [(r.id, r.refs) for r in few if r.kind == "way"] == [(4, [1]), (6, [404]), (7, [1, 2, 1]), (8, [1, 404])]


def test_pbf_written_and_read(spark, tmp_path):
    made = [("node", -(10**12), -89.9999999, 179.9999999, None, {"a": "ü 東京", "b": ""}), ("node", 5, 0.0, 0.0, None, {}), ("way", 6, None, None, [10**12, -3, 5], {"k": "v"}), ("way", 7, None, None, [], {})]
    path = str(tmp_path / "out")
    osm_pbf.write(spark.createDataFrame(made, osm_pbf.SCHEMA).repartition(3), path)
    back = osm_pbf.read(spark, path).orderBy("id").collect()
    assert [(r.kind, r.id, r.refs, r.tags) for r in back] == [(k, i, r, t) for k, i, _, _, r, t in made]
    assert all(abs(r.lat - m[2]) < 1e-9 and abs(r.lon - m[3]) < 1e-9 for r, m in zip(back[:2], made[:2])) and back[2].lat is None
    # every file is one that other readers take: a header blob, and blobs that fill it to its end
    for file in (tmp_path / "out").glob("part-*"):
        data, at, kinds = file.read_bytes(), 0, []
        while at < len(data):
            n = struct.unpack(">I", data[at : at + 4])[0]
            head = dict(osm_pbf._fields(data[at + 4 : at + 4 + n]))
            kinds.append(head[1])
            assert dict(osm_pbf._fields(data[at + 4 + n : at + 4 + n + head[3]]))[3]
            at += 4 + n + head[3]
        assert at == len(data) and kinds[0] == b"OSMHeader"
    cut = tmp_path / "cut.pbf"
    cut.write_bytes(blob(b"OSMData", block(nodes=[(3, 3.0, 3.0, {})]))[:-3])
    with pytest.raises(Exception, match="not whole"):
        osm_pbf.read(spark, str(cut)).collect()


def test_loader_and_store(spark, tmp_path):
    assert [loader.format_of(x) for x in ("a.csv", "a.geojson", "a.json", "a.pbf", "a.txt", "a.CSV", "a.GEOJSON")] == ["csv", "geojson", "geojson", "pbf", "csv", "csv", "csv"]
    address = dict(house_number="1", street="Main", city=None, state=None, postcode=None, country=None, full="1 Main")
    made = rows.manual(spark, [(address, 1.0, 2.0), (dict(address, full="2 Main"), 3, 4)])
    path = str(tmp_path / "deep" / "store")
    store.save(made, path, "test")
    back = loader.load(spark, path, "store")
    assert got(back) == [("1 Main", 2.0, 1.0), ("2 Main", 4.0, 3.0)] and back.schema["address"].dataType == made.schema["address"].dataType
    about = store.metadata(spark, path).first()
    assert (about.version, about.record_count, about.source, about.coverage) == (1, 2, "test", None) and "T" in about.created_at
    store.save(made.limit(1), path, "again")
    assert loader.load(spark, path, "store").count() == 1
    assert store.snapshots(spark, path) == [1, 2] and store.load(spark, path, 1).count() == 2


def test_snapshots_appear_whole(spark, tmp_path):
    """A writer that dies leaves the snapshot before; a reader goes on with what it opened; writers that meet both finish."""
    path = str(tmp_path / "s")
    with pytest.raises(store.NoSnapshot):
        store.load(spark, path)
    address = dict(house_number="1", street="Main", city=None, state=None, postcode=None, country=None, full="1 Main")
    made = rows.manual(spark, [(address, 1.0, 2.0), (address, 3, 4), (address, 5, 6)])
    store.save(made, path, "a")
    reader = store.load(spark, path)

    def dies(folder):
        raise RuntimeError("here")

    with pytest.raises(RuntimeError):
        store.save(made.limit(1), path, "b", dies)
    assert store.snapshots(spark, path) == [1] and store.load(spark, path).count() == 3 and store.metadata(spark, path).first().record_count == 3
    # while one writes, another finishes
    store.save(made.limit(2), path, "c", lambda folder: store.save(made.limit(1), path, "d"))
    assert store.snapshots(spark, path) == [1, 2, 3] and [store.load(spark, path, k).count() for k in (1, 2, 3)] == [3, 1, 2]
    assert store.metadata(spark, path).first().source == "c" and reader.count() == 3
    assert not put_once(spark, f"{path}/snapshot-3", "other") and store.load(spark, path).count() == 2
    assert store.clean(spark, path) == 1 and store.snapshots(spark, path) == [2, 3] and store.load(spark, path, 2).count() == 1
    geo = Geocoder.build(made, path)
    assert len(geo) == 3 and len(Geocoder.open(spark, path).forward("1 main")) == 3 and store.snapshots(spark, path) == [2, 3, 4]


def test_index_runs(spark, tmp_path):
    """Base and runs read as the index made anew, after each change, with compaction in between and with a change that comes first."""
    rng = random.Random(2)
    address = lambda text: dict(house_number=None, street=text, city=None, state=None, postcode=None, country=None, full=text)
    runs, live = IndexRuns(spark, str(tmp_path / "i")), {k: f"{k} main st" for k in range(20)}
    frame = lambda some: spark.createDataFrame([(k, address(t), 0.0, 0.0) for k, t in some.items()], RECORDS)
    with pytest.raises(FileNotFoundError):
        runs.read()
    runs.create(frame(live))
    for step in range(5):
        more = {rng.randrange(40): f"{step} oak {rng.random()}" for _ in range(6)}
        runs.put(frame(more))
        live |= more
        gone = rng.sample(sorted(live), 3)
        runs.remove(spark.createDataFrame([(k,) for k in [*gone, 999]], "rec_id long"))
        live = {k: t for k, t in live.items() if k not in gone}
        if step == 2:
            assert runs.compact() and not runs.compact()
        got, want = runs.read(), entries(frame(live))
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {r.rec_id for r in forward.prefix_join(runs.read(), spark.createDataFrame([(0, "4 oak")], "qid long, qn string")).collect()} == {k for k, t in live.items() if t.startswith("4 oak")}
    written = runs._merged

    def slow(changes):
        runs.put(frame({77: "new"}))  # while it is compacted
        return written(changes)

    runs._merged = slow
    assert not runs.compact()
    runs._merged = written
    assert runs.read().filter("rec_id = 77").count() == 2
