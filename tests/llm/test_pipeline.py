import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from placebook.llm import quality_classifier
from placebook.llm._store import table
from placebook.llm._words import Texts
from placebook.llm.packing import CAPACITY
from tests.llm.test_mixing import BLOCK, shared_out
from tests.llm.test_near_copies import brute as groups
from tests.llm.test_packing import check_whole

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def good_by_rules(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    n, dup = len(words), len(lines) - len(set(lines))
    upper, lower = len(re.findall("[A-Z]", text or "")), len(re.findall("[a-z]", text or ""))
    return not (
        n < 20
        or 100 * len(repeated) > 30 * n
        or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 25 * n
        or 100 * sum(a == b for a, b in zip(words, words[1:])) > 30 * n
        or 100 * upper > 60 * (upper + lower)
        or (100 * dup > 60 * len(lines) and dup > 2)
        or sum(map(len, words)) > 30 * n
    )


def plain_score(network, text):
    """The network's probability, position by position."""
    raw = (text or "").encode()
    n, width = max(len(raw), 1), len(network.filters)
    padded = np.frombuffer(raw + b"\0" * (n - len(raw) + width), np.uint8)
    response = sum(network.filters[k][padded[k : k + n]] for k in range(width)) + network.offset
    segment = quality_classifier.SEGMENT
    starts = list(range(0, max(1, n - segment), segment))
    chunks = [np.maximum(response[a : a + 2 * segment].max(axis=0), 0) for a in starts]
    return 1 / (1 + np.exp(-(np.mean(chunks, axis=0) @ network.weight + network.bias)))


def test_network_scores_whole_texts(spark, sf):
    docs = [r.text for r in table(spark, sf, "documents").collect()] + ["", None, "x", "é" * 700, "ab" * 64, "ab" * 65, "a b " * 9000]
    network = quality_classifier.fit(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    got = network.score(Texts(pa.array(docs, pa.string())))
    assert np.allclose(got, [plain_score(network, t) for t in docs], atol=1e-4)


def test_classifier_edge_rows(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    network = quality_classifier.fit(docs.filter("doc_id < 0"), labels)
    assert 0 < network.constant < 1
    assert quality_classifier.fit(docs, labels.limit(0)).constant == 0.5
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2)], "doc_id long, text string, score int")
    assert quality_classifier.keep_good(odd, network).columns == odd.columns
    assert quality_classifier.scored(odd.limit(0).drop("score"), network).count() == 0


def test_training_rows_that_are_null_or_very_long(spark):
    good, bad = "a calm and clear account of the river. " * 3000, "BUY!!! $$$ now " * 8000
    docs = spark.createDataFrame([(k, good if k % 2 else bad) for k in range(24)] + [(24, None), (26, ""), (25, good[:200])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(27)], "doc_id long, quality int")
    network = quality_classifier.fit(docs, labels)
    assert network.constant is None
    score = network.score(Texts(pa.array([good, bad, good[500:2000], bad[-900:]])))
    assert score[0] > 0.8 > 0.2 > score[1] and score[2] > 0.8 > 0.2 > score[3]
    rng = np.random.default_rng(1)
    chunks = quality_classifier.drawn_chunks(good.encode(), rng)
    assert len(chunks) == quality_classifier.HELD_CHUNKS and quality_classifier.drawn_chunks(b"", rng) == [b""]
    assert b"".join(c[: quality_classifier.SEGMENT] for c in quality_classifier.drawn_chunks(good[:1280].encode(), rng)) == good[:1152].encode()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = quality_classifier.op8_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("held_out").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) >= 0.98 * len(rows)


def test_run_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents").collect()
    network = quality_classifier.fit(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    left = table(spark, sf, "documents")
    results = []
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, sf)
        results.append(left)
    kept = [d for d in docs if good_by_rules(d.text)]
    assert sorted(r.doc_id for r in results[0].collect()) == sorted(d.doc_id for d in kept)
    kept = [d for d in kept if plain_score(network, d.text) >= 0.7]
    assert sorted(r.doc_id for r in results[1].collect()) == sorted(d.doc_id for d in kept)
    first = {c for _, c, _ in groups([(d.doc_id, d.text) for d in kept])}
    kept = [d for d in kept if d.doc_id in first]
    assert sorted(r.doc_id for r in results[2].collect()) == sorted(d.doc_id for d in kept)
    whole = {d.doc_id: d for d in kept}
    mixed = results[3].collect()
    sizes, taken = {}, {}
    for d in kept:
        sizes[d.source] = sizes.get(d.source, 0) + len(WORD.findall(d.text))
    for r in mixed:
        words = WORD.findall(r.text)
        assert set(words) <= set(WORD.findall(whole[r.doc_id].text)) and r.n_chars == len(r.text) and r.lang == whole[r.doc_id].lang
        taken[r.source] = taken.get(r.source, 0) + len(words)
    for source, want in shared_out(sizes).items():
        assert abs(taken.get(source, 0) - want) <= 2 * BLOCK
    rows = results[4].collect()
    bins = check_whole(rows, [(r.doc_id, r.text) for r in mixed], CAPACITY)
    assert bins <= 1.02 * -(-sum(r.length for r in rows) // CAPACITY) + 1
    run = corpus_pipeline.run(spark, sf)
    assert run.columns == results[4].columns
    assert sorted(map(str, run.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, results[4].select("doc_id", "piece", "length", "ids_crc32").collect()))
    trained = corpus_pipeline.sequences(run).collect()
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(len(r.ids) for r in trained) == 4 * sum(len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed)
    assert {r.sequence_id: len(r.ids) // 4 for r in trained} == {r.sequence_id: r.length for r in trained} and max(r.length for r in trained) <= CAPACITY
    by_sequence = {r.sequence_id: bytes(r.ids) for r in trained}
    for r in run.collect():
        assert zlib.crc32(by_sequence[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32


def test_copies_stage_with_repeated_ids(spark, sf):
    """Documents that share an id with others are told apart by their texts."""
    docs = table(spark, sf, "documents").filter("doc_id < 60")
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(3).cast("long")).withColumn("text", F.concat(F.reverse("text"), F.lit(" "), F.col("doc_id").cast("string"))))
    rows = twice.collect()
    kept = corpus_pipeline.near_copies_stage(spark, twice, sf).collect()
    members = {}
    for (key, text), (_, c, _) in zip(enumerate(r.text for r in rows), groups(list(enumerate(r.text for r in rows)))):
        members.setdefault(c, set()).add((rows[key].doc_id, text))
    assert len(kept) == len(members) and all(len(own & {(r.doc_id, r.text) for r in kept}) == 1 for own in members.values())
