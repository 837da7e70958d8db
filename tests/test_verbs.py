import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placebook.geocoder import Geocoder
from placebook.operators import autocomplete, batch, forward, fuzzy, ordered, spatial
from placebook.operators import index as ix
from placebook.operators.typo_trie import KeyTrie, reaches
from placebook.plans import derived
from placebook.schema import FuzzyConfig
from tests.test_text import model_match, model_soundex


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def records(spark, sf):
    return derived.records(spark, sf).cache()


@pytest.fixture(scope="module")
def index(records):
    return ix.entries(records).cache()


@pytest.fixture(scope="module")
def model(records):
    """Entries as (key, rec_id, key_ord) from the records, by the rule."""
    out = []
    for r in records.orderBy("rec_id").collect():
        a = r.address
        texts = [a.full, a.street, f"{a.street} {a.city}" if a.street is not None and a.city is not None else None, a.city]
        out += [(model_match(x), r.rec_id, k) for k, x in enumerate(x for x in texts if x is not None)]
    return out


def prefix_hits(model, qn):
    first = {}
    for full, i in sorted((f"{k}\x1f{i}".encode(), i) for k, i, _ in model):
        if full.startswith(qn.encode()):
            first.setdefault(i, full)
    return list(first)


def fuzzy_hits(model, q, limit, config):
    found = []
    for n, (key, i, _) in enumerate(model):
        d, longest = distance(q, key), max(len(q.encode()), len(key.encode()))
        s = 1 - d / longest if longest else 1.0
        if d <= config.max_distance and s >= config.min_score:
            found.append((-s, n, i))
        elif config.phonetic_fallback and model_soundex(q) == model_soundex(key):
            found.append((-0.6, n, i))
    return [(i, -s) for s, _, i in sorted(found)[:limit]]


TEXTS = ["12 Main", "main st", "Springfield", "N", "", "spr", "ma", "m", "Portlnad", "zzqq", "12 Oak Avenu", "pine tree", "Mian Street Springfield", "lak", "King's Rd", "Denvr", "xx", "1", "ross ct", "Eastwod"]


def test_entries(index, model):
    assert sorted((r.key, r.rec_id, r.key_ord) for r in index.collect()) == sorted(model)


def test_forward_against_brute_force(spark, index, model):
    asked = spark.createDataFrame(list(enumerate(TEXTS)), "qid long, q string")
    got = {}
    for r in forward.forward(index, asked).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.rec_id, r.confidence, r.match_type))
    for qid, q in enumerate(TEXTS):
        want = [(i, 1.0, "exact") for i in prefix_hits(model, model_match(q))]
        if not want:
            seen = {}
            for i, s in fuzzy_hits(model, model_match(q), 20, FuzzyConfig(2, False, 0.6)):
                seen.setdefault(i, s)
            want = [(i, s, "fuzzy") for i, s in list(seen.items())[:5]]
        assert got.get(qid, []) == want, q
        one = [(r.rec_id, r.confidence, r.match_type) for r in forward.forward_one(index, q).orderBy("rank").collect()]
        assert one == want, q


@pytest.mark.parametrize("config", [FuzzyConfig(), FuzzyConfig(1, False, 0.0), FuzzyConfig(3, True, 0.7), FuzzyConfig(0, False, 0.5)])
def test_fuzzy_against_brute_force(spark, config):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcü1") for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9]))) for _ in range(220)]
    words += ["abc"] * 30
    model = [(w, n // 3, n % 3) for n, w in enumerate(words)]
    index = spark.createDataFrame(model, "key string, rec_id long, key_ord int")
    texts = ["", "a", "abc", "ABC", "abü", "1234", "aabbccaab", *rng.sample(words, 12)]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, q string")
    got = {}
    for r in fuzzy.fuzzy_entries(index, asked, 8, config).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.rec_id, round(r.score, 12)))
    for qid, q in enumerate(texts):
        assert got.get(qid, []) == [(i, round(s, 12)) for i, s in fuzzy_hits(model, q.lower(), 8, config)], q


def test_keys_that_share_their_ends(spark):
    """100 000 keys with one suffix: each text's automaton looks at few of them, and only matches come out."""
    rng = random.Random(6)
    keys = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) + " street springfield il" for _ in range(100_000)})
    texts = []
    for _ in range(60):
        k = rng.choice(keys)
        at = rng.randrange(len(k))
        texts += [k[:at] + k[at + 1 :], k[:at] + "q" + k[at:]]
    text, key, d, looked = KeyTrie(keys).within(texts, 2)
    assert looked < 0.02 * len(texts) * sum(map(len, keys))
    assert len(text) < 3 * len(texts)
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    asked = spark.createDataFrame(list(enumerate(texts)), "tid long, q string")
    got = sorted((r.tid, r.key, r.distance) for r in fuzzy.close_keys(frame, asked, 2, range_keys=9_000, block=40).collect())
    assert got == sorted((int(t), keys[k], int(x)) for t, k, x in zip(text, key, d))
    assert {t for t, _, x in got if x == 1} == set(range(len(texts)))


@pytest.mark.parametrize("d", [0, 1, 2, 3])
def test_automaton_against_brute_force(d):
    rng = random.Random(d)
    words = sorted({"".join(rng.choice("abü\U0001f642") for _ in range(rng.randrange(0, 9))) for _ in range(400)})
    texts = ["", *("".join(rng.choice("abü\U0001f642c") for _ in range(rng.randrange(0, 10))) for _ in range(300))]
    text, key, found, _ = KeyTrie(words).within(texts, d)
    want = {(t, k, n) for t, a in enumerate(texts) for k, b in enumerate(words) if (n := distance(a, b)) <= d}
    assert set(zip(text.tolist(), key.tolist(), found.tolist())) == want and len(text) == len(want)
    for a in texts[:60]:
        for b in words[:60]:
            if distance(a, b) <= d:
                assert all(reaches(a, b[:n], d) for n in range(len(b) + 1))


def test_lists_of_a_code_are_bounded(spark):
    """5000 entries of one code: a text meets the first of them only, and the best are exact."""
    rows = [(i, 0, f"smith {i:05d}") for i in range(5000)] + [(6000 + i, 0, "smyth") for i in range(30)]
    index = spark.createDataFrame(rows, "rec_id long, key_ord int, key string")
    texts = spark.createDataFrame([(0, "smith"), (1, "smit"), (2, "smith 00004"), (3, "nobody")], "tid long, q string")
    posted = index.withColumn("nth", F.lit(1))
    close = fuzzy.close_keys(index.select("key").distinct(), texts, 2)
    assert fuzzy.by_sound(posted, texts, close.limit(0), 10).count() == 30
    got = {}
    for r in fuzzy.fuzzy_entries(index, texts.withColumnRenamed("tid", "qid"), 10, FuzzyConfig()).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.rec_id, round(r.score, 9)))
    model = [(k, i, n) for i, n, k in rows]
    for t, q in enumerate(["smith", "smit", "smith 00004", "nobody"]):
        assert got.get(t, []) == [(i, round(s, 9)) for i, s in fuzzy_hits(model, q, 10, FuzzyConfig())]


def test_autocomplete(spark, index, records, model):
    asked = spark.createDataFrame([(k, q, -89.6, 39.4) for k, q in enumerate(TEXTS)] + [(99, "main", None, 39.0)], "qid long, q string, lon double, lat double")
    place = {r.rec_id: (r.lon, r.lat) for r in records.collect()}
    plain, biased = {}, {}
    for r in autocomplete.autocomplete(index, asked, 3).orderBy("qid", "rank").collect():
        plain.setdefault(r.qid, []).append(r.rec_id)
    for r in autocomplete.autocomplete_biased(index, records, asked, 3).orderBy("qid", "rank").collect():
        biased.setdefault(r.qid, []).append(r.rec_id)
    for qid, q in [*enumerate(TEXTS), (99, "main")]:
        hits = prefix_hits(model, model_match(q))
        assert plain.get(qid, []) == hits[:3]
        near = hits[:24] if qid == 99 else sorted(hits[:24], key=lambda i: math.hypot(place[i][0] + 89.6, place[i][1] - 39.4))
        assert biased.get(qid, []) == near[:3]
    assert autocomplete.autocomplete(index, asked, 0).count() == 0


def test_nearest(spark):
    rng = random.Random(4)
    sites = [(i, rng.choice([rng.uniform(0, 1), 0.5]), rng.choice([rng.uniform(0, 1), 0.25])) for i in range(400)] + [(1000, None, 0.0), (1001, 50.0, 50.0)]
    records = spark.createDataFrame(sites, "rec_id long, lon double, lat double")
    asked = [(q, rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2)) for q in range(40)] + [(100, 500.0, -300.0), (101, 0.5, 0.25)]
    points = spark.createDataFrame(asked, "qid long, lon double, lat double")
    for k in (1, 7, 1000):
        got = {}
        for r in spatial.nearest_join(records, points, k).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.rec_id)
        for q, x, y in asked:
            want = [i for _, i in sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in sites if a is not None)][:k]
            assert got[q] == want
    assert spatial.nearest_join(records, points, 0).count() == 0 and spatial.nearest_join(records.limit(0), points, 3).count() == 0
    top = spatial.nearest(records, 0.5, 0.25, 4).collect()
    assert top[0].d2 == 0 and top[0].confidence == 1.0 and spatial.nearest(records, 0, 0, 0).count() == 0
    assert spatial.nearest(records, 90.0, 90.0, 1).first().confidence == 0.0
    want = {(q, i) for q, x, y in asked for i, a, b in sites if a is not None and x <= a <= x + 0.3 and y - 0.2 <= b <= y}
    boxes = spark.createDataFrame([(q, x + 0.3, y - 0.2, x, y) for q, x, y in asked], "qid long, lon1 double, lat1 double, lon2 double, lat2 double")
    assert {tuple(r) for r in spatial.boxes_join(records, boxes, 0.1).collect()} == want
    assert spatial.within_box(records, 0.5, 0.25, 0.5, 0.25).count() == sum(a == 0.5 and b == 0.25 for _, a, b in sites)


def test_nearest_from_zero(spark):
    """Points at exactly 0.0 are far points like others."""
    rng = random.Random(5)
    sites = [(i, rng.uniform(10, 11), rng.uniform(10, 11)) for i in range(1000)]
    records = spark.createDataFrame(sites, "rec_id long, lon double, lat double")
    for q, x, y in [(0, 0.0, 10.5), (1, 10.5, 0.0), (2, 0.0, 0.0)]:
        got = spatial.nearest_join(records, spark.createDataFrame([(q, x, y)], "qid long, lon double, lat double"), 5).orderBy("rank").collect()
        assert [r.rec_id for r in got] == [i for _, i in sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in sites)][:5]


def test_places_that_no_distance_is_told_from(spark):
    """Points and records that are null, NaN or infinite take no part, and hide nothing."""
    nan, inf = float("nan"), float("inf")
    sites = [(i, i / 10, 5.0) for i in range(50)] + [(90, nan, 5.0), (91, inf, 5.0), (92, 1.0, -inf), (93, None, 1.0), (94, nan, nan)]
    records = spark.createDataFrame(sites, "rec_id long, lon double, lat double")
    asked = [(0, nan, 10.0), (1, nan, nan), (2, 500.0, 80.0), (3, inf, 1.0), (4, 1.0, None), (5, 2.04, 5.0), (6, -1e300, 1e300)]
    got = {}
    for r in spatial.nearest_join(records, spark.createDataFrame(asked, "qid long, lon double, lat double"), 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.rec_id)
    assert got == {2: [49, 48, 47], 5: [20, 21, 19], 6: [0, 1, 2]}
    assert [r.rec_id for r in spatial.nearest(records, 2.04, 5.0, 3).orderBy("rank").collect()] == [20, 21, 19]
    assert spatial.nearest_join(records.filter("rec_id >= 90"), spark.createDataFrame(asked, "qid long, lon double, lat double"), 3).count() == 0


def test_far_points_meet_few_records_of_a_town(spark):
    """A dense town, lonely farms and far points: each point is sent to few leaves, and all answers are exact."""
    rng = np.random.default_rng(3)
    town = np.c_[rng.normal(0, 0.01, 20_000), rng.normal(0, 0.01, 20_000)]
    farms = rng.uniform(-50, 50, (300, 2))
    place = np.r_[town, farms, np.repeat([[3.0, 3.0]], 500, axis=0)]
    far = np.r_[rng.uniform(-180, 180, (1000, 2)), rng.normal(0, 0.01, (200, 2)), [[3.0, 3.0]]]
    records = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(place)], "rec_id long, lon double, lat double")
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(far)], "qid long, lon double, lat double")
    got = {}
    for r in spatial.nearest_join(records, points, 5).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.rec_id)
    for q, (x, y) in enumerate(far):
        d2 = (place[:, 0] - x) * (place[:, 0] - x) + (place[:, 1] - y) * (place[:, 1] - y)
        assert got[q] == np.lexsort((np.arange(len(d2)), d2))[:5].tolist()
    dealt, tree = spatial._tree(spatial._sites(records, 5), 64)
    sent = spatial.near_leaves(points.selectExpr("qid", "lon as x", "lat as y"), tree, 5)
    pairs = sent.join(dealt, "leaf").count()
    assert pairs < 600 * len(far)  # of 20800 records for each point
    assert sent.groupBy("qid").count().agg({"count": "max"}).first()[0] < 64


def test_all_orders_and_events_are_queries(spark, sf):
    orders, events = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("orders", "events"))
    asked = orders.join(derived.gazetteer(spark, sf), orders.o_custkey == F.col("id")).selectExpr("o_orderkey as qid")
    assert asked.count() > 0 and sorted(r.qid for r in derived.text_queries(spark, sf).select("qid").collect()) == sorted(r.qid for r in asked.collect())
    assert sorted(r.qid for r in derived.points(spark, sf).select("qid").collect()) == sorted(r.event_id for r in events.select("event_id").collect())


def test_batch_and_geocoder(spark, records):
    geo = Geocoder.build(records)
    asked = spark.createDataFrame([(0, "Springfield"), (1, "Portlnad"), (2, "zzqq flurb"), (3, "Springfield")], "qid long, q string")
    rows = {r.qid: r for r in geo.batch_table(asked, 3).collect()}
    assert [rows[k].status for k in range(4)] == ["matched", "matched", "nomatch", "matched"] and len(rows[0].results) == 3
    told = batch.summary(geo.batch_table(asked)).first()
    assert (told.total, told.matched, told.no_match, told.errors) == (4, 3, 1, 0)
    assert abs(told.avg_confidence - (2 + rows[1].results[0].confidence) / 3) < 1e-12
    none = batch.summary(geo.batch_table(asked.limit(0))).first()
    assert (none.total, none.avg_confidence) == (0, 0.0) and batch.fraction(0, 0) == 1.0
    assert {r.status for r in geo.batch_table(asked, 0).collect()} == {"nomatch"}
    lists = geo.batch([q for _, q in [(0, "Springfield"), (1, "zzqq flurb")]])
    assert [r.asDict(recursive=True) for r in geo.hits("Springfield").collect()] == lists[0] and geo.hits("").count() == len(geo)
    assert lists[0] == geo.forward("Springfield") and lists[1] == [] and len(geo) == records.count()
    assert geo.reverse(-89.5, 39.5, 2)[0]["match_type"] == "exact" and len(geo.autocomplete("main", 2)) == 2
    body = batch.as_json(geo.batch_table(asked, 50)).filter("qid = 0").first().body
    assert '"postcode":null' in body and '"match_type":"exact"' in body


def test_short_prefixes_read_one_list(spark, records, index, model):
    geo = Geocoder.build(records)
    place = {r.rec_id: r.address.full for r in records.collect()}
    for t in ["", "1", "12", "12 ", "m", "ma", "mai", "main", "s", "zz", "N"]:
        for limit in (0, 1, 10, 64, 65):
            assert [r["address"]["full"] for r in geo.autocomplete(t, limit)] == [place[i] for i in prefix_hits(model, model_match(t))[:limit]], (t, limit)
    assert geo.heads.groupBy("prefix").count().filter("count > 64").isEmpty() and geo.heads.filter("length(prefix) > 3").isEmpty()


def test_prefix_join_reads_each_key_once(spark, index, model):
    """Texts of all lengths, nested and repeated ones and the empty one, against brute force; no product, and no copies of keys."""
    texts = ["", "1", "12", "main", "main st springfield", "nothing at all like this one here", "12 main st springfield il 6000", "m", "main", "\U0010ffff", "z", "s", "springfield", *[str(k) for k in range(40)]]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, qn string")
    for limit in (None, 1, 3, 1 << 70):
        got = {}
        for r in forward.prefix_join(index, asked, limit).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.rank, r.rec_id))
        for k, t in enumerate(texts):
            assert got.get(k, []) == list(enumerate(prefix_hits(model, t)[:limit], 1)), t
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for queries in (asked, asked.filter("qid = 0"), asked.filter("qid > 0"), asked.limit(0)):
            plan = forward.prefix_join(index, queries)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert forward.prefix_join(index, asked.limit(0)).count() == 0 and forward.prefix_join(index.limit(0), asked).count() == 0 and forward.prefix_join(index, asked, 0).count() == 0
    keyed = ordered._keyed(index, ["1", "m"])
    assert keyed.count() == index.count()
    assert {r.qid for r in forward.missed(index, asked).collect()} == {k for k, t in enumerate(texts) if not prefix_hits(model, t)}


def test_merges_over_many_batches_and_ranges(spark, monkeypatch):
    """Intervals that go on over batches and ranges keep their order and their limit."""
    rng = random.Random(8)
    rows = [(i, k, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))) for i in range(1500) for k in range(rng.choice([1, 2, 4]))]
    model = [(key, i, k) for i, k, key in rows]
    index = spark.createDataFrame(rows, "rec_id long, key_ord int, key string").selectExpr("*", "concat(key, '\\u001f', rec_id) as full_key")
    texts = ["", "a", "b", "ab", "aba", "abab", "bbbbbb", "ba", "a", "\x00"]
    asked = spark.createDataFrame(list(enumerate(texts)), "qid long, qn string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for limit, few in ((None, 0), (7, 10_000), (7, -100), (400, -100)):
            monkeypatch.setattr(ordered, "FEW", few)
            got = {}
            for r in forward.prefix_join(index, asked, limit).orderBy("qid", "rank").collect():
                got.setdefault(r.qid, []).append(r.rec_id)
            for k, t in enumerate(texts):
                assert got.get(k, []) == prefix_hits(model, t)[:limit], t
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_next_text():
    assert ordered.after("ab") == "ac" and ordered.after("a\U0010ffff") == "b" and ordered.after("") is None and ordered.after("\U0010ffff") is None and ordered.after("\ud7ff") == "\ue000"


def test_boxes_of_any_size(spark, records):
    rows = [(0, -180.0, -90.0, 180.0, 90.0), (1, -89.5, 39.5, -89.5, 39.5), (2, float("-inf"), 39.2, float("inf"), 39.3), (3, -89.3, 39.1, -89.9, 39.9), (4, 5.0, 5.0, 6.0, 6.0), (5, None, 1.0, 2.0, 3.0)]
    boxes = spark.createDataFrame(rows, "qid long, lon1 double, lat1 double, lon2 double, lat2 double")
    got = sorted((r.qid, r.rec_id) for r in spatial.boxes_join(records, boxes, 0.05).collect())
    want = [(q, r.rec_id) for q, a, b, c, d in rows[:5] for r in records.collect() if min(a, c) <= r.lon <= max(a, c) and min(b, d) <= r.lat <= max(b, d)]
    assert got == sorted(want) and len(want) > len(rows)
