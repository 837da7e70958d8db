import math
import re
import zlib

import numpy as np
import pyarrow as pa

from placebook.llm import toxicity
from placebook.llm._words import Texts
from placebook.llm.toxicity import BLOCK, SPAN, Index, _fitted, _high, _index, _known, _places, _starts, fit, op3_toxicity, scored, terms


def random_vectors(rng, n, vocabulary, most):
    text, term = [], []
    for i in range(n):
        own = np.sort(rng.choice(vocabulary, rng.integers(0, most), replace=False))
        text += [i] * len(own)
        term += own.tolist()
    text, term = np.array(text), np.array(term)
    return text, term, rng.integers(1, 5, len(text))


def index_of(example, term, count, idf, label):
    """An index of examples 0..n-1 as fit() lays it out."""
    order = np.lexsort((example, term))
    return Index(np.arange(len(idf)), idf, np.arange(len(label)), label, (example[order], np.bincount(term, minlength=len(idf)), count[order]))


def test_neighbours_are_those_of_brute_force():
    rng = np.random.default_rng(1)
    vocabulary, n = 40, 5 * BLOCK + 7
    example, term, count = random_vectors(rng, n, vocabulary, 6)
    idf = rng.uniform(1, 5, vocabulary)
    index = index_of(example, term, count, idf, np.zeros(n))
    weight = index.weigh(example, term, count, n)
    dense = np.zeros((n, vocabulary))
    dense[example, term] = weight
    q_text, q_term, q_count = random_vectors(rng, 200, vocabulary, 9)
    q_weight = index.weigh(q_text, q_term, q_count, 200)
    queries = np.zeros((200, vocabulary))
    queries[q_text, q_term] = q_weight
    best, sims = index.nearest(q_text, q_term, q_weight, 200, k=7)
    cosine = np.round(queries @ dense.T, 12)
    for i in range(200):
        want = sorted((-s, e) for e, s in enumerate(cosine[i]) if s > 0)[:7]
        assert best[i].tolist() == [e for _, e in want] + [-1] * (7 - len(want))
        assert np.allclose(sims[i, : len(want)], [-s for s, _ in want], atol=1e-11)
    own_best, _ = index.nearest(example, term, weight, n, own=np.arange(n))
    assert (own_best != np.arange(n)[:, None]).all()


def test_ties_go_to_the_smaller_id_of_either_label():
    n = 3 * BLOCK
    label = (np.arange(n) % 5 == 3).astype(float)
    index = index_of(np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.ones(2 * n, np.int64), np.ones(2), label)
    weight = index.weigh(np.zeros(2, np.int64), np.arange(2), np.ones(2), 1)
    best, sims = index.nearest(np.zeros(2, np.int64), np.arange(2), weight, 1)
    assert best[0].tolist() == list(range(15)) and np.allclose(sims, 1) and len(set(sims[0].tolist())) == 1


def plain_terms(text):
    """The terms of a text as bytes, with their counts."""
    out = {}
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        word = bytes(b + 32 if 65 <= b <= 90 else b for b in word)
        for _ in range(3):
            if len(word) > 1 and word[-1:] in b".,;:!?\"')":
                word = word[:-1]
        for key in [word] + [(n, word[:n]) for n in (4, 5, 6, 7, 8) if len(word) > n]:
            out[key] = out.get(key, 0) + 1
    return out


def test_query_against_brute_force(spark, sf):
    """Neighbours, scores and verdicts of the whole small table, by dictionaries and dense sums."""
    docs = [(r.doc_id, plain_terms(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    examples = sorted((k, t) for k, t in docs if k in labels and t)
    held = set().union(*(t for _, t in examples))
    df = {}
    for _, t in docs:
        for x in held.intersection(t):
            df[x] = df.get(x, 0) + 1
    idf = {x: math.log((1 + len(docs)) / (1 + df[x])) + 1 for x in held}

    def vector(t):
        v = {x: (1 + math.log(c)) * idf[x] for x, c in t.items() if x in idf}
        norm = math.sqrt(sum(y * y for y in v.values()))
        return {x: y / norm for x, y in v.items()}

    own = [(k, labels[k], vector(t)) for k, t in examples]

    def features(v, skip=None):
        sims = [(-round(sum(x * o.get(t, 0) for t, x in v.items()), 9), k, y) for k, y, o in own if k != skip]
        best = [x for x in sorted(sims)[:15] if x[0] < 0]
        weight = [(s**4, y) for s, _, y in best]
        vote = sum(w * y for w, y in weight) / sum(w for w, _ in weight) if weight else None
        near = sum(-s for s, _, _ in best) / 15
        means = [sum(-s for s, _, y in sims if y == c) / max(1, sum(y == c for _, _, y in sims)) for c in (0, 1)]
        return vote, [1, vote or 0, near, (vote or 0) * near, *means], best

    seen = [(y, features(v, k)) for k, y, v in own]
    x, y = np.array([f[1] for _, f in seen if f[0] is not None]), np.array([float(y) for y, f in seen if f[0] is not None])
    slope = _fitted(x, y, np.ones(len(y)))
    got = {r.doc_id: r for r in op3_toxicity(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        vote, f, best = features(vector(t)) if any(x in idf for x in t) else (None, None, [])
        clear = [(k, round(-s, 5)) for s, k, _ in best if -s > -best[-1][0] + 1e-5]
        assert set(k for k, _ in clear) <= {e.doc_id for e in got[k].evidence} and len(best) == len(got[k].evidence)
        assert np.allclose(sorted(-s for s, _, _ in best), sorted(e.similarity for e in got[k].evidence), atol=1e-6)
        if vote is not None:
            score = 1 / (1 + math.exp(-sum(a * b for a, b in zip(f, slope))))
            assert abs(got[k].score - score) < 5e-3 and (got[k].predicted == (score >= 0.3) or abs(score - 0.3) < 5e-3)


def test_terms_fold_case_and_closing_marks():
    one, two = (set(terms(Texts(pa.array([t])))[1].tolist()) for t in ("Scum, x", "scum... X!?"))
    assert one == two
    assert len(terms(Texts(pa.array(["", None])))[0]) == 0
    assert len(_known(Texts(pa.array(["a"])), np.zeros(0, np.int64))[0]) == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = op3_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").select("predicted", "toxic", "score").collect()
    assert len(rows) > 500 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.96 * len(rows)
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits >= 0.85 * sum(r.toxic for r in rows) and hits >= 0.85 * sum(r.predicted for r in rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(k, "you scum idiot " * 4 if k % 2 else "a fine day") for k in range(40)] + [(None, "scum"), (90, None), (91, ""), (92, "idiot " * 50_000), (92, "idiot " * 50_000)], "doc_id long, text string").selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(40)] + [(3, None, 1), (None, 1, 1)], "doc_id long, toxic int, text int")
    got = scored(docs, fit(docs, labels)).collect()
    assert len(got) == 45
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert min(by[1]) > 0.5 > max(by[2]) and by[92][0] == by[92][1] and by[90] == by[91] and max(by[90]) < 0.5
    assert scored(docs.limit(0), fit(docs, labels)).count() == 0
    assert {r.score for r in scored(docs, fit(docs, labels.limit(0))).collect()} == {0.0}



def test_cosine_is_over_all_terms_of_the_examples(spark):
    """Terms that speak for no label are in the index, examples of both labels too; rare wording and common words count."""
    texts = [f"the {'scum' if k % 2 else 'fine'} of w{k % 7}x{k} and the" for k in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (1000, "w3x3 alone"), (1001, "the of"), (1002, "fine")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    index = fit(docs, labels)
    kept = index.ids.tolist()
    held = {k: set(terms(Texts(pa.array([texts[k]])))[1].tolist()) for k in kept}
    assert set(index.label.tolist()) == {0.0, 1.0} and set(index.vocabulary.tolist()) == set().union(*held.values())
    every = dict(enumerate(texts)) | {1000: "w3x3 alone", 1001: "the of", 1002: "fine"}
    counts = {k: dict(zip(*np.unique(terms(Texts(pa.array([t])))[1], return_counts=True))) for k, t in every.items()}
    df = {t: sum(t in c for c in counts.values()) for t in set().union(*held.values())}

    def vector(k):
        v = {t: (1 + np.log(c)) * (np.log((1 + len(every)) / (1 + df[t])) + 1) for t, c in counts[k].items() if t in df}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    own = {k: vector(k) for k in kept}
    got = {r.doc_id: r.evidence for r in scored(docs, index).collect()}
    for k in (0, 1, 1001, 1002):
        asked = vector(k)
        want = sorted((-round(sum(x * v.get(t, 0) for t, x in asked.items()), 6), e) for e, v in own.items())[:15]
        assert np.allclose([e.similarity for e in got[k]], [-s for s, _ in want if s < 0], atol=3e-6)


def test_ids_that_are_no_numbers(spark):
    """Text ids are passed through; evidence names examples by the number in their id, or a hash of it."""
    rows = [(f"doc-{k}" if k % 3 else str(k), ("you vile awful thing go away " if k % 2 else "the river runs past the old mill ") * (1 + k % 4)) for k in range(60)]
    docs = spark.createDataFrame([*rows, (None, "a vile awful thing"), ("", "")], "doc_id string, text string")
    labels = spark.createDataFrame([(name, k % 2) for k, (name, _) in enumerate(rows)], "doc_id string, toxic int")
    got = {r.doc_id: r for r in scored(docs, fit(docs, labels)).collect()}
    assert set(got) == {name for name, _ in rows} | {None, ""}
    assert all(0 <= r.score <= 1 for r in got.values()) and got["doc-1"].score > 0.5 > got["doc-2"].score
    assert {e.label for e in got[None].evidence} == {1} and all(isinstance(e.doc_id, int) for e in got[None].evidence)


def test_spans_have_columns_of_their_own(monkeypatch):
    """Two kinds of examples, each with as many common terms as there are columns: none is left to the lists, and neighbours are those of brute force."""
    monkeypatch.setattr(toxicity, "COLUMNS", 20)
    rng = np.random.default_rng(2)
    n, rare = 4 * SPAN * BLOCK, 300
    own = [np.sort(np.concatenate([20 * (i // (n // 2)) + rng.choice(20, 8, replace=False), 40 + rng.choice(rare, i % 3, replace=False)])) for i in range(n)]
    example, term = np.repeat(np.arange(n), [len(t) for t in own]), np.concatenate(own)
    idf = np.concatenate([rng.uniform(1, 2, 40), rng.uniform(3, 5, rare)])
    count = rng.integers(1, 5, len(term))
    index = index_of(example, term, count, idf, np.zeros(n))
    weight = index.weigh(example, term, count, n)
    asked = example < 150
    asked |= (example >= n - 150)
    text = np.where(example < 150, example, example - n + 300)[asked]
    best, sims = index.nearest(text, term[asked], weight[asked], 300, own=np.concatenate([np.arange(150), np.arange(n - 150, n)]))
    assert index.column.shape[1] == 4 and len(index.posted) == (term >= 40).sum()
    dense = np.zeros((n, len(idf)))
    dense[example, term] = weight
    queries = np.concatenate([dense[:150], dense[-150:]])
    cosine = np.round(queries @ dense.T, 12)
    cosine[np.arange(300), np.concatenate([np.arange(150), np.arange(n - 150, n)])] = -1
    for i in range(300):
        want = np.lexsort((np.arange(n), -cosine[i]))[:15]
        assert np.allclose(sims[i], cosine[i][want], atol=1e-11)
        clear = want[cosine[i][want] > cosine[i][want[-1]] + 1e-9]
        assert set(clear.tolist()) <= set(best[i].tolist())


def test_terms_are_found_by_their_high_bits():
    rng = np.random.default_rng(3)
    ends = np.iinfo(np.int64)
    even = rng.integers(ends.min, ends.max, 3000)
    for vocabulary in (even, np.arange(-50, 50), np.array([ends.min, -1, 0, ends.max]), even[:1], even[:0]):
        vocabulary = np.unique(vocabulary.astype(np.int64))
        term = np.concatenate([rng.permutation(vocabulary), even, np.array([ends.min, ends.max, 0, 7, -1])])
        want = [{t: k for k, t in enumerate(vocabulary.tolist())}.get(t, -1) for t in term.tolist()]
        assert _places(vocabulary, _starts(vocabulary), term).tolist() == want


def test_high_places_are_distinct_and_bound_the_highest():
    score = np.random.default_rng(4).normal(size=(50, 64 * BLOCK)).astype(np.float32)
    for rows in (score, score[:, :BLOCK], np.full((2, 64 * BLOCK), -np.inf)):
        at = _high(rows, 15)
        assert at.shape == (len(rows), 15) and all(len(set(a.tolist())) == 15 for a in at)
        highest = np.sort(rows, axis=1)[:, -15:]
        assert (np.take_along_axis(rows, at, axis=1).min(axis=1) <= highest[:, 0]).all() and (np.take_along_axis(rows, at, axis=1).max(axis=1) == highest[:, -1]).all()


def test_a_process_builds_an_index_once():
    example, term = np.arange(3), np.arange(3)
    told = [(i.vocabulary, i.idf, i.ids, i.label, i.entries) for i in (index_of(example, term, np.ones(3, np.int64), np.ones(3), np.zeros(3)) for _ in range(2))]
    first = _index(told[0], stands_for=(1.0, 2.0))
    again = _index(told[0], stands_for=(3.0, 4.0), empty_score=0.5)
    assert again is first and again.stands_for == (3.0, 4.0) and again.empty_score == 0.5
    assert _index(told[1]) is not first
