import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from placebook.llm import phrases


def brute(docs, longest=5, least=100, first=2000, covered=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    hidden = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= covered * f[lang, w[i : i + m]]:
                    hidden.add((lang, w[i : i + m]))
    rows = []
    for (lang, w), a in cand.items():
        if (lang, w) in hidden:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        rows.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:first]
        out += [(r[0], k, *r[1:]) for k, r in enumerate(own, 1)]
    return sorted(out)


def fixture():
    rng = random.Random(4)
    words = ["über", "Ab", "ab", "c", "d", "e", "f", "gh", "ÀB", "x" * 300]
    docs = []
    for k in range(300):
        text = ""
        for _ in range(rng.randrange(0, 60)):
            text += rng.choice(["new york stock exchange", "Kind Of Blue", "a b a b a", *words]) + rng.choice([" ", " ", "  ", "\t", ", ", ". ", "\n", " ", "\x0b"])
        docs.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return docs + [("fr", None), ("fr", ""), ("fr", " .,\n "), ("xx", "la " * 500), (None, "one two " * 3)]


def test_against_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3).withColumns({"rank": F.lit(1), "phrase": F.lit("x"), "n": F.lit(2)})
    for least, covered, first in ((100, 100, 2000), (5, 100, 2000), (2, 60, 7)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, covered=covered, first=first).collect())
        assert got == brute(docs, least=least, covered=covered, first=first)
        assert got


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(phrases.ORACLE)
    got = phrases.op12_phrases(spark, sf)
    assert sorted(map(str, got.columns)) == sorted(want.columns)
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall())
    assert rows


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(1)
    stream = np.concatenate([rng.zipf(1.3, 60_000) % 5000, np.repeat(np.arange(9000, 9020), 100)]).astype(np.uint32)
    rng.shuffle(stream)
    true = np.bincount(stream)
    for least in (100, 400):
        whole = phrases.Summary(len(stream) // least + 1)
        halves = [phrases.Summary(len(stream) // least + 1) for _ in range(2)]
        for k, chunk in enumerate(np.array_split(stream, 40)):
            tags, counts = np.unique(chunk, return_counts=True)
            whole.merge(tags, counts)
            halves[k % 2].merge(tags, counts)
        halves[0].merge(halves[1].tags, halves[1].counts)
        halves[0].taken += halves[1].taken
        for s in (whole, halves[0]):
            assert s.taken < least and len(s.tags) <= s.capacity
            assert set(np.flatnonzero(true >= least)) <= set(s.tags[s.counts + s.taken >= least].tolist())
            assert (s.counts <= true[s.tags]).all()


def test_survivors_hold_all_frequent_phrases_in_small_buffers(spark):
    df = spark.createDataFrame(fixture(), "lang string, text string").repartition(5)
    words, found = phrases.candidates(df, least=20)
    parts = 2
    keys = phrases.survivors(df, range(2, 6), parts, 20, held=100)
    kept = phrases.bloom(keys, parts).value
    table = found.toArrow()
    for lang, phrase in zip(table["lang"].to_pylist(), table["phrase"].to_pylist()):
        import pyarrow as pa

        texts = phrases.lowered(phrases.Pieces(pa.array([phrase])))
        m = phrase.count(" ") + 1
        _, h = texts.phrases(range(m, m + 1), phrases._lang_hash(pa.array([lang])))[m]
        assert kept.has(h).all()
    assert words.filter("n < 1").isEmpty()


def test_counts_beyond_64_bits(spark):
    """Scores are exact where products pass 64 bits."""
    a, n, left, right = 10**12 + 7, 10**15 + 3, 10**13 + 9, 10**13 + 1
    wide = "cast({} as decimal(16, 0))".format
    got = spark.sql(f"select ({wide(a)} * {wide(n)} * cast(1000 as decimal(4, 0))) div ({wide(left)} * {wide(right)}) as s").first()[0]
    assert int(got) == 1000 * a * n // (left * right)


def test_empty_table(spark):
    got = phrases.collocations(spark.createDataFrame([], "lang string, text string"))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_counts_that_are_summed_up_and_passed_on(spark, monkeypatch):
    """Tasks that meet more than they hold sum up what they have, and pass it on in parts."""
    docs = fixture()
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    monkeypatch.setattr(phrases, "HELD", 64)
    counts = phrases._Counts()
    import pyarrow as pa

    for _ in range(40):
        counts.add(pa.array(["en", "de"]), np.array([0, 1, 1]), pa.array(["a", "b", "a"], pa.large_string()), 1)
        counts.full()
    assert sorted(map(tuple, (r.values() for b in counts.taken() for r in b.to_pylist())), key=str) == [("de", "a", 1, 40), ("de", "b", 1, 40), ("en", "a", 1, 40)]
    assert sorted(tuple(r) for r in phrases.collocations(df, least=5).collect()) == brute(docs, least=5)
