import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placebook.llm.packing import CAPACITY, op10_best_fit_packing, pack, packed, plan, ranked, sequences, tokenised


def check_whole(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for key, text in docs:
        want.setdefault(key, []).append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for key, pieces in by_doc.items():
        expected = []
        for ids in want[key]:
            first = len(ids) % capacity or capacity
            cuts = [0, *range(first, len(ids), capacity), len(ids)]
            expected += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(expected) == sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_edge_rows(spark):
    docs = [(1, None), (2, ""), (3, "one two <|endoftext|> three"), (3, "one two <|endoftext|> three"), (None, "x"), (5, "long " * 3000), (6, "ümläut 　 日本 🙂\t\n  x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length", "2 as rank")
    check_whole(pack(frame).collect(), docs, CAPACITY)
    assert pack(frame.limit(0)).count() == 0


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = spark.createDataFrame([(k, "word " * (37 * k % 3000)) for k in range(40)], "doc_id long, text string")
    placements, ids = packed(docs)
    whole = {r.sequence_id: r for r in sequences(placements, ids).collect()}
    rows = placements.collect()
    for r in rows:
        own = whole[r.sequence_id]
        assert zlib.crc32(bytes(own.ids)[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32 and len(own.ids) == 4 * own.length <= 4 * CAPACITY
    assert {r.text_hash for r in rows} == {r.h for r in docs.selectExpr("xxhash64(text) as h").collect()}
    assert sum(len(r.pieces) for r in whole.values()) == len(rows)


def test_repeated_rows_are_dealt_over_parts(spark):
    """Copies of a row, and equal texts without an id, get draws of their own."""
    frame = spark.createDataFrame([(1, "the same text")] * 1000 + [(None, "another text that repeats")] * 1000, "doc_id long, text string").repartition(8)
    rows = tokenised(frame).groupBy("length").agg(F.countDistinct("draw").alias("draws"), F.min("draw").alias("low"), F.max("draw").alias("high"), F.countDistinct(F.expr("draw div 65536")).alias("sixteenths")).collect()
    assert len(rows) == 2
    assert all(r.draws > 950 and r.low >= 0 and r.high < 1 << 20 and r.sixteenths == 16 for r in rows)


def test_ranks_of_one_length_in_many_parts(spark):
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "if(id % 5 = 0, 7L, 2048L) as length", "id as piece_key", "cast(pmod(xxhash64(id), 1048576) as int) as draw")
    rows = ranked(pieces, {7: 1000, 2048: 4000}, each=300).groupBy("length").agg({"rank": "max", "*": "count"}).collect()
    assert {(r.length, r["max(rank)"], r["count(1)"]) for r in rows} == {(7, 999, 1000), (2048, 3999, 4000)}
    assert ranked(pieces, {7: 1000, 2048: 4000}, each=300).select("length", "rank").distinct().count() == 5000


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([3, 200, 2000])):
        length = rng.choice([rng.randint(1, 60), rng.randint(1, 2048), 2048, 700, 683, 682])
        counts[length] = counts.get(length, 0) + rng.choice([1, 1, 2, 500])
    used = {}
    bins = 0
    for run in plan(counts):
        assert run.gap >= 0 and run.bins > 0
        assert sum(e for s, e, _, _ in run.slots if 3 * s > 2048) <= 2
        assert sum(s * e for s, e, _, _ in run.slots) + run.gap == 2048
        bins += run.bins
        for length, each, first, _ in run.slots:
            used.setdefault(length, []).append((first, each * run.bins))
    for length, n in counts.items():
        at = 0
        for first, m in sorted(used[length]):
            assert first == at
            at += m
        assert at == n
    total = sum(k * v for k, v in counts.items())
    half = sum(v for k, v in counts.items() if 2 * k > 2048)
    third = sum(v for k, v in counts.items() if 3 * k > 2048)
    assert bins <= 1.25 * max(-(-total // 2048), half, -(-third // 2)) + 1


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = op10_best_fit_packing(spark, sf).collect()
    bins = check_whole(rows, docs, CAPACITY)
    assert bins <= 1.01 * -(-sum(r.length for r in rows) // CAPACITY) + 1


def test_ids_are_the_tokenizers_ids():
    from placebook.llm.packing import _encoder

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = _encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(5)
    pools = ["abc XYZ 's 't 've'll", " \t\n\r\x0b\x0c\x85  　​", "0١²½Ⅷ", "éßñ日本語한글🙂́", "<|endoftext|>", "!?%$#…—"]
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>"])
        assert fast.encode(text, allowed_special="all") == tokenizer.encode(text, add_special_tokens=False).ids, json.dumps(text)
