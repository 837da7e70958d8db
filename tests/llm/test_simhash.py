import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from placebook.llm import simhash
from placebook.llm._xxh64 import xxh64


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1 if words else 0))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(values):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 2:
                root[find(a)] = find(b)
    return [find(a) for a in range(len(values))]


def brute(docs):
    values = [fingerprint(text) for _, text in docs]
    root = components_of(values)
    least = {}
    for (key, _), r in zip(docs, root):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return sorted(((key, f"{v:016x}", least.get(r)) for (key, _), v, r in zip(docs, values, root)), key=str)


def fixture():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    texts = []
    for n in (30, 200, 900):
        base = [word() for _ in range(n)]
        for _ in range(25):
            own = list(base)
            own[rng.randrange(n)] = word()
            texts.append(" ".join(own))
        texts += [" ".join(base)] * 3
    texts += [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A B\tC", "x " * 3000, "x\x0bx", "É Éa éa", "w" * 700 + " b c d"]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(100)]
    rng.shuffle(texts)
    return list(enumerate(texts, 1)) + [(None, texts[0]), (None, "nobody else says this"), (7, texts[3]), (7, "another text of id seven")]


def test_hashes_are_those_of_the_library():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 30_000, dtype=np.uint8)
    start = rng.integers(0, 29_000, 3000)
    end = start + np.r_[rng.integers(0, 100, 2000), rng.integers(0, 900, 1000)]
    assert xxh64(data, start, end, 42).tolist() == [xxhash.xxh64_intdigest(data[a:b].tobytes(), 42) for a, b in zip(start, end)]


def test_against_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for crowd in (64, 2, 1):  # with 1 every link comes from shared neighbours
        got = [tuple(r) for r in simhash.near_duplicates(df, crowd=crowd).collect()]
        assert sorted(got, key=str) == brute(docs)


def test_query_against_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in simhash.op13_simhash(spark, sf).collect()]
    assert sorted(got, key=str) == brute(docs)
    assert len({c for _, _, c in got}) < len(got)


def test_crowded_blocks_lose_no_link(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    values = {base}
    for _ in range(600):  # a chain of values that share most of their bits, and others near to them
        near = rng.choice(sorted(values))
        values.add(near ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(64)) * (rng.random() < 0.1))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"), crowd=8)
    assert edges.filter(F.expr("bit_count(a ^ b) > 2")).count() == 0
    found = {tuple(sorted(r)) for r in edges.collect()}
    index = {v: k for k, v in enumerate(values)}
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        root[find(index[a])] = find(index[b])
    assert len({find(k) for k in range(len(values))}) == len(set(components_of([v & (1 << 64) - 1 for v in values])))


def test_pairs_meet_in_some_block():
    masks = simhash._masks(4, 2)
    for a in range(64):
        for b in range(a):
            assert any(not (1 << a | 1 << b) & m & (1 << 64) - 1 for m in masks)


def test_edges_of_the_input(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).columns == ["doc_id", "fingerprint", "component_id"]
    assert simhash.near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([("a", None, 1, "x"), ("b", "", 2, "y"), (None, "one two three four", 3, "z")], "doc_id string, text string, fp int, component_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert [(x[0], x[2]) for x in got] == [("a", "a"), ("b", "a"), (None, None)]
