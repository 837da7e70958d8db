import heapq
import random
import re

from pyspark.sql import functions as F

from placebook.llm.mixing import BLOCK, apportioned, mix, mixed, op4_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def highest_quotients(weights, most, seats):
    won = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0 and most[k] > 0]
    heapq.heapify(heap)
    for _ in range(seats):
        if not heap:
            break
        _, k = heapq.heappop(heap)
        won[k] += 1
        if won[k] < most[k]:
            heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), k))
    return won


def shared_out(sizes, budget=1.5):
    """Targets by repeating: share by weight, hold at twice the size, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    fixed, total = {}, budget * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_apportionment_is_the_highest_quotients(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for group in range(25):
        n = rng.choice([1, 2, 7, 60])
        weights = [float(rng.choice([0, 1, rng.randint(1, 50), rng.randint(1, 100000)])) for _ in range(n)]
        q = rng.choice([0, 1, 5, n, 40 * n])
        rows += [(group, k, w, 10**9, q) for k, w in enumerate(weights)]
        for k, won in enumerate(highest_quotients(weights, [10**9] * n, q)):
            want[group, k] = won
    frame = spark.createDataFrame(rows, "g int, p int, w double, most long, q long")
    assert {(r.g, r.p): r.seats for r in apportioned(frame, ["g"], ["p"]).collect()} == want


def test_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_mixing(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    sizes, taken, target = {}, {}, {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(WORD.findall(d.text)) and 0 <= r.taken <= 2 * r.size
        sizes[d.source] = sizes.get(d.source, 0) + r.size
        taken[d.source] = taken.get(d.source, 0) + r.taken
        target[d.source] = r.target
    for s, want in shared_out(sizes).items():
        assert abs(target[s] - want) < 1e-6 * want
        assert abs(taken[s] - want) <= 2 * BLOCK
    again = {(r.doc_id, r.taken) for r in op4_mixing(spark, sf).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def fixture(spark):
    rng = random.Random(8)
    rows = [(k, " \n".join(f"w{k}_{i}" for i in range(rng.choice([1, 3, 80, 900]))), "de", rng.choice(["a", "b", "B", None, "é"]), 1, 7) for k in range(60)]
    rows += [(100, None, None, "a", 0, 7), (101, "", None, "only empty", 0, 7), (None, "x y z " * 40, None, None, 0, 7), (5, rows[5][1], "de", rows[5][3], 1, 7), (107, "one " * 20000, "de", "b", 1, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, first int")


def test_mix_holds_what_was_taken(spark):
    docs = fixture(spark)
    taken = mixed(docs.drop("first"), ["doc_id"]).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()
    out = mix(docs)
    assert out.columns == docs.columns
    held = {}
    whole = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert r.n_chars == len(r.text) and r.first == 7
        words = WORD.findall(r.text)
        held[r.doc_id] = held.get(r.doc_id, 0) + len(words)
        assert words and (len(words) < len(WORD.findall(whole[r.doc_id])) or r.text == whole[r.doc_id])
        assert set(words) <= set(WORD.findall(whole[r.doc_id]))
    assert held == {r.doc_id: r.n for r in taken if r.n}
    assert mix(docs.limit(0)).count() == 0


def test_one_row_repeated_very_often(spark):
    docs = spark.range(50_000).selectExpr("7L as doc_id", "'a b c d e f g h' as text", "'x' as source")
    out = mix(docs)
    rows = out.groupBy("text").count().collect()
    words = sum(len(r.text.split()) * r["count"] for r in rows)
    assert len(rows) < 20 and abs(words - 1.5 * 8 * 50_000) <= 2 * BLOCK
