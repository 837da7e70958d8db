import random
import re

from pyspark.sql import functions as F

from placebook.llm.near_copies import CROWD, classes_of, components, keep_one, near_copies, nodes_of, op2_near_copies, prefix_depth


def brute(docs, width=5, threshold=0.8):
    sets = []
    for key, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1 if words else 0))})
    links = [set() for _ in docs]
    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                links[a].add(b)
                links[b].add(a)
    root = list(range(len(docs)))
    for a in range(len(docs)):
        stack = [a]
        while stack:
            x = stack.pop()
            for y in links[x]:
                if root[y] > root[a]:
                    root[y] = root[a]
                    stack.append(y)
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, []).append(docs[k][0])
    return [(docs[k][0], min(groups[r]), len(links[k])) for k, r in enumerate(root)]


def variants(rng, words, n, edits):
    for _ in range(n):
        out = list(words)
        for _ in range(edits):
            out[rng.randrange(len(out))] = f"e{rng.random()}"
        yield " ".join(out)


def fixture():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = []
    for n in (6, 40, 300):
        base = [word() for _ in range(n)]
        texts += [" ".join(base)] * 3
        texts += variants(rng, base, 6, 1)
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(200)]) for _ in range(8)]
    big = [word() for _ in range(400)]
    texts += variants(rng, big, 60, 2)
    texts += ["", None, " \t\n", "one", "one", "one two", "two one", "a b c d", "a  b\nc d", "a b c d e", "x " * 5000, "x " * 4000, "x"]
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


def test_against_brute_force_with_small_blocks(spark):
    docs = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as cls", "2 as keys", "doc_id as h")
    for block, crowd in ((7, 3), (1024, 64)):
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_copies(frame, block=block, crowd=crowd, trees=48, recall=0.9999).collect())
        assert got == sorted(brute(docs))


def test_prefixes_are_longer_where_many_documents_are_alike(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, pair = [word() for _ in range(300)], [word() for _ in range(300)]
    texts = list(variants(rng, passage, 3 * CROWD, 2)) + list(variants(rng, pair, 2, 2))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = classes_of(frame, trees=18, depth=6, shallowest=4)
    nodes = nodes_of(rows.select("cls", "keys"), 18, 3, CROWD).join(rows.select("cls", "doc_id"), "cls").collect()
    levels = {k: {r.level for r in nodes if (r.doc_id >= 3 * CROWD) == k} for k in (False, True)}
    assert levels[True] == {0} and 2 in levels[False]
    assert len({(r.cls, r.tree) for r in nodes}) == len(nodes)
    members = {}
    for r in nodes:
        members.setdefault((r.tree, r.level, r.key), []).append(r)
    for (_, level, _), own in members.items():
        assert len(own) == own[0].n > 1 and (len(own) <= CROWD or level == 2)


def test_one_row_repeated_very_often(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join(base[:-1] + ["x"])
    one = spark.range(100_000).selectExpr("7L as doc_id", f"'{' '.join(base)}' as text")
    frame = one.unionByName(spark.createDataFrame([(9, near), (10, "other words " * 5)], "doc_id long, text string"))
    got = near_copies(frame).groupBy("doc_id", "class_id", "n_links").count().collect()
    assert sorted(tuple(r) for r in got) == [(7, 7, 100_000, 100_000), (9, 7, 100_000, 1), (10, 10, 0, 1)]
    assert sorted(r.doc_id for r in keep_one(frame).collect()) == [7, 10]


def test_ids_that_are_no_numbers(spark):
    frame = spark.createDataFrame([("a", "a b c d e f"), ("b", "a b c d e f"), ("3", "q r s t u v")], "doc_id string, text string")
    rows = {r.doc_id: r for r in near_copies(frame).collect()}
    assert rows["a"].class_id == rows["b"].class_id and rows["3"].class_id == 3 and rows["a"].n_links == 1
    assert keep_one(frame).count() == 2


def test_nulls_repeats_and_empty_tables(spark):
    docs = [(None, "a b c d e f g"), (None, "a b c d e f g"), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, None), (5, None), (6, "q r s t u v")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = near_copies(frame).collect()
    assert len(rows) == 7
    copies = [r for r in rows if r.n_links]
    assert len(copies) == 4 and {r.n_links for r in copies} == {3} and len({r.class_id for r in copies}) == 1
    assert keep_one(frame).count() == 4  # rows without words are groups of their own
    assert near_copies(frame.limit(0)).count() == 0
    assert keep_one(frame.limit(0)).columns == ["doc_id", "text"]


def test_ids_that_stand_for_several_texts(spark):
    """Rows with one id and unlike texts are unlike documents: none of them goes."""
    a, b, c = "a b c d e f g", "q r s t u v w", "one two three four five six"
    docs = [(5, a), (5, b), (9, a), (7, None), (7, ""), (7, None), (9, c), (5, c), (None, b), (None, "x y z x y z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("root", F.lit("a clashing name"))
    kept = sorted((tuple(r)[:2] for r in keep_one(frame).collect()), key=str)
    assert [t for _, t in kept if t].count(a) == 1 and {t for _, t in kept if t} == {a, b, c, "x y z x y z"} and len([t for _, t in kept if t]) == 4
    assert (5, a) in kept and (5, c) in kept
    assert [x for x in kept if not x[1]] == [(7, ""), (7, None), (7, None)]


def test_keep_one_keeps_one_of_each_group(spark):
    docs = fixture()
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'de' as lang")
    kept = sorted(r.doc_id for r in keep_one(frame, trees=48, recall=0.9999).collect())
    assert kept == sorted({c for _, c, _ in brute(docs)})


def test_long_chains(spark):
    edges = [(k, k + 1) for k in range(500)] + [(1000 - k, 999 - k) for k in range(200)] + [(5000, 5000)]
    got = {r.v: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(501)) and all(got[k] == 800 for k in range(800, 1001)) and len(got) == 501 + 201


def test_depth_follows_the_recall():
    assert prefix_depth(0.8, 16, 6, 0.995) == 5
    assert prefix_depth(0.8, 18, 8, 0.995) == 6
    assert prefix_depth(0.8, 16, 6, 0.99) == 6
    assert prefix_depth(0.8, 1, 6, 0.999) == 1


def test_query_recall(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {k: (c, n) for k, c, n in brute(docs)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in op2_near_copies(spark, sf).collect()}
    assert set(got) == set(want)
    assert all(got[k][1] <= want[k][1] for k in want)
    assert sum(n for _, n in got.values()) >= 0.99 * sum(n for _, n in want.values())
    assert sum(got[k][0] == want[k][0] for k in want) >= 0.99 * len(want)
