import math
import random

import numpy as np

from placebook.llm.metric_search import build, lifted, op6_metric_search, quantized, search, top_k

MOST = (1 << 63) - 1


def brute(rows, k=10, chosen=lambda i: i % 100 == 0):
    """Every query's best rows by Python's integers; equal query rows are one query."""
    held = lambda x: max(-MOST - 1, min(MOST, x))
    fine = [(i, tuple(held(math.floor(1024 * x)) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted(set(x for x in fine if chosen(x[0]))):
        scores = sorted((-max(-MOST, min(MOST, sum(x * y for x, y in zip(a, b)))), i) for i, b in fine if i != q and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def clustered(rng, n, clusters=40, noise=2):
    centre = rng.normal(size=(clusters, 16)) * 300
    return np.floor(centre[rng.integers(0, clusters, n)] + rng.normal(size=(n, 16)) * noise).astype(np.int64)


def test_tree_is_whole_and_sound():
    rng = np.random.default_rng(0)
    ints = np.concatenate([rng.normal(size=(500, 6)) * 10, np.ones((300, 6)), rng.normal(size=(3, 6)) * 1000]).astype(np.int64)
    norm = float((ints * ints).sum(axis=1).max())
    tree = build(ints, np.arange(len(ints)), norm, page=20, fanout=4)
    points = lifted(tree.ints, norm)

    def below(node):
        a, b = tree.child[node]
        return list(range(*tree.rows[node])) if b == a else [x for c in range(a, b) for x in below(c)]

    assert sorted(tree.ids[below(0)].tolist()) == list(range(len(ints))) and (tree.ints == ints[tree.ids]).all()
    for node in range(len(tree.pivot)):
        pivot = points[tree.pivot[node]]
        assert max(np.linalg.norm(points[below(node)] - pivot, axis=1)) <= tree.radius[node] + 1e-9
        for c in range(*tree.child[node]):
            assert abs(np.linalg.norm(points[tree.pivot[c]] - pivot) - tree.parent_distance[c]) < 1e-9
        rows = slice(*tree.rows[node])
        assert np.allclose(np.linalg.norm(points[rows] - pivot, axis=1), tree.row_distance[rows])
        assert rows.stop - rows.start <= 20 or tree.radius[node] == 0


def test_search_skips_most_vectors_of_clusters_and_finds_all():
    rng = np.random.default_rng(2)
    ints, ids = clustered(rng, 4000), np.arange(4000)
    norm = float((ints * ints).sum(axis=1).max())
    tree = build(ints, ids, norm)
    asked = np.arange(0, 4000, 100)
    at, found, score, computed = search(tree, ints[asked], asked, 10, norm)
    assert computed < 0.15 * len(asked) * len(ints)
    for k, q in enumerate(asked):
        want = sorted((-int(s), i) for i, s in enumerate(ints @ ints[q]) if i != q)[:10]
        assert [(-int(s), int(i)) for s, i in zip(score[at == k], found[at == k])] == want
    # scores that are known to be reached leave the same best rows
    kth = np.array([score[at == k][-1] for k in range(len(asked))])
    again = search(tree, ints[asked], asked, 10, norm, kth)
    assert all((x == y).all() for x, y in zip((at, found, score), again)) and again[3] <= computed


def test_forest_leaves_trees_out(spark):
    from placebook.llm import metric_search

    rng = np.random.default_rng(4)
    rows = [(i, (v / 1024 + 1e-9).tolist()) for i, v in enumerate(clustered(rng, 3000, 30))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = quantized(frame)
    visits = []
    own = metric_search._visited
    metric_search._visited = lambda trees, v, *rest: (visits.append((trees, v)), own(trees, v, *rest))[1]
    try:
        got = top_k(vectors, vectors.filter("vec_id % 100 = 0"), tree_rows=75, pivots=64, group=7).collect()
    finally:
        metric_search._visited = own
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)
    trees = visits[1][0].count()
    assert trees >= 20 and visits[1][1].count() < 0.3 * 30 * trees


def test_query_and_edge_rows(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op6_metric_search(spark, sf).collect()) == brute(rows)
    rng = random.Random(3)
    odd = [(i, [float(rng.randint(-3, 3)) / 2 for _ in range(3)]) for i in range(150)] + [(200 + i, [0.5, 0.5, 0.5]) for i in range(200)]
    odd += [(1000, None), (1100, []), (1200, [1.0, None, 2.0]), (1300, [float("nan"), 0.0, 0.0]), (1400, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (1500, [1.0, 2.0])]
    odd += [(100, [0.5, 0.5, 1.0])] * 3 + [(200, [0.5, 0.5, 0.5])] * 5 + [(7, [1.5, 1.5, 1.5])] * 15  # repeated queries and candidates; an id with two vectors
    frame = spark.createDataFrame(odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank")
    vectors = quantized(frame)
    for tree_rows, group in ((40, 2), (10_000, 512)):
        got = top_k(vectors, vectors.filter("vec_id % 100 = 0"), tree_rows=tree_rows, group=group, pivots=4).collect()
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(odd)
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0
    assert top_k(vectors.limit(0), vectors.filter("vec_id = 100")).count() == 0
    assert top_k(vectors.filter("vec_id = 3"), vectors.filter("vec_id = 100")).count() == 2


def test_huge_components(spark):
    rng = random.Random(5)
    odd = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(0, 300, 3)]
    odd += [(100, [1e9, -1e9, 1.0, 0.5]), (101, [1e9, 1e9, 0.0, 0.0]), (102, [-1e9, 3.0, 2.0, 1.0]), (103, [1e30, 1.0, 0.0, 0.0]), (104, [-1e30, 0.0, 0.0, 1e30])]
    vectors = quantized(spark.createDataFrame(odd, "vec_id long, embedding array<double>"))
    got = top_k(vectors, vectors.filter("vec_id % 100 = 0"), tree_rows=30, pivots=4).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(odd)
