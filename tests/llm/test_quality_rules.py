import random
import re

import numpy as np
import pyarrow as pa

from placebook.llm.quality_rules import Counts, Rule, _cascade, default_rules, judge, keep_good, op7_quality_rules, rule_order
from tests.llm.test_pipeline import good_by_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = {}
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    repeated = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(8)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)]


def odd_texts():
    rng = random.Random(1)
    bits = ["a", "b", "word", "é", "日本", "🙂", " ", "\n", "\n\n", "\t", "\x0b", "\x0c", "\r", " ", "#", "%%%", "|", "A"]
    return ["", None, " \n ", "x", "a b c d e f g h " * 9, "one two " * 4, *("".join(rng.choice(bits) for _ in range(rng.choice([3, 30, 300]))) for _ in range(300))]


def test_counts_against_brute_force():
    texts = odd_texts()
    for part in (texts, texts[7:9], [None], [""]):
        counts = Counts(pa.array(part, pa.string()))
        got = np.column_stack([counts.n_words, counts.word_chars, counts.n_symbols, counts.n_dup_lines, counts.n_repeat_words]).tolist()
        assert got == [brute(t) for t in part]
    sliced = Counts(pa.array(texts, pa.string()).slice(20, 50))
    assert sliced.n_words.tolist() == [brute(t)[0] for t in texts[20:70]]


def test_any_order_gives_the_same_verdict():
    texts = pa.array(odd_texts() + ["The quick brown fox jumps over a lazy dog near some river bank while it rains on this very long day here"], pa.string())
    rules = list(default_rules())
    kept = [_cascade(Counts(texts), order) < 0 for order in (rules, rules[::-1], rules[3:] + rules[:3])]
    assert (kept[0] == kept[1]).all() and (kept[0] == kept[2]).all() and kept[0][-1]


def test_later_rules_see_only_survivors():
    shown = []

    def watching(counts):
        shown.append(len(counts.column))
        return np.zeros(len(counts.column), bool)

    _cascade(Counts(pa.array(["a", "b b", "c c c"])), [Rule("short", lambda c: c.n_words < 2), Rule("watch", watching), Rule("all", lambda c: np.ones(len(c.column), bool)), Rule("never", watching)])
    assert shown == [2]


def test_order_is_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([(k, "x " * 300) for k in range(200)], "doc_id long, text string")
    none, slow, fast = Rule("none", lambda c: c.n_words < 0), Rule("slow", lambda c: (sum(range(2_000_000)) > 0) & (c.n_words > 0)), Rule("fast", lambda c: c.n_words > 0)
    assert [r.name for r in rule_order(docs, [none, slow, fast])] == ["fast", "slow", "none"]
    assert [r.name for r in rule_order(docs.limit(0), [none, slow])] == ["none", "slow"]


def test_edge_rows(spark):
    good = "The quick brown fox jumps over a lazy dog near some river bank while it rains on this very long day here"
    rows = [(None, good), (1, good), (1, good), (2, None), (3, ""), (4, "word%d " * 9), (5, "same " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as failed_rule", "8 as n_words", "'r' as row")
    kept = keep_good(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.failed_rule, r.n_words) for r in kept.collect()) == [(0, 7, 8), (1, 7, 8), (1, 7, 8)]
    told = judge(docs, with_counts=True)
    assert told.columns.count("n_words") == 1 and told.filter("doc_id = 5").first().n_words == 100_000
    assert keep_good(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_quality_rules(spark, sf).collect():
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute(texts[r.doc_id])
        assert r.kept == good_by_rules(texts[r.doc_id]) and r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
