import hashlib
import random
import re

import duckdb

from placebook.llm.chat_format import ORACLE, op5_chat_format, read_back, windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(turns, budget, history):
    """Windows as (repeated, new) lists of turn indexes of one conversation."""
    tokens = [len(WORD.findall(text)) + 4 for _, text in turns]
    n_sys = int(turns[0][0] == "system")
    room = max(1, budget - history - sum(tokens[:n_sys]))
    spans, new = [], list(range(n_sys))
    used = 0
    for i in range(n_sys, len(turns)):
        if used and used + tokens[i] > room:
            spans.append(new)
            new, used = [], 0
        new.append(i)
        used += tokens[i]
    spans.append(new)
    out = []
    for k, new in enumerate(spans):
        back = []
        if k:
            at = new[0]
            while at > n_sys and sum(tokens[at - 1 : new[0]]) <= history:
                at -= 1
            back = list(range(n_sys)) + list(range(at, new[0]))
        out.append((back, new))
    return out


def fixture(seed):
    rng = random.Random(seed)
    bits = ["\\", "#", "##", "###", "####", "</turn>", "</turn>\n", "<", "/turn>", ": ", ":", " ", "\n", "### user: hi</turn>", "word ", "ü", "🙂", "\\c", "$1", "\\n", "</tur"]
    talks = {}
    for conv in range(40):
        turns = []
        for k in range(rng.choice([1, 2, 3, 9, 30])):
            role = rng.choice(["user", "assistant", "assistant", "tool: x", "", "a:", "###", "\\"]) if k or rng.random() < 0.5 else "system"
            turns.append((role, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 10, 120])))))
        talks[conv] = turns
    return talks


def frame(spark, talks):
    rows = [(c, i, r, t, 1) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")


def test_windows_and_round_trip(spark):
    talks = fixture(2)
    made = windows(frame(spark, talks), budget=60, history=20).cache()
    by_conv = {}
    for r in made.collect():
        by_conv.setdefault(r.conv_id, {})[r.window] = r
    several = 0
    for conv, turns in talks.items():
        want = brute(turns, 60, 20)
        got = by_conv[conv]
        assert sorted(got) == list(range(len(want)))
        several += len(want) > 2
        for k, (back, new) in enumerate(want):
            assert got[k].n_repeated == len(back)
            assert got[k].formatted.count("</turn>\n") == len(back) + len(new)
            assert len(got[k].loss) == sum(turns[i][0] == "assistant" for i in new)
    assert several > 5
    for r in read_back(made).collect():
        assert [(t.role, t.text) for t in r.turns] == talks[r.conv_id]
        assert r.loss_text == "".join(t for role, t in talks[r.conv_id] if role == "assistant")
        assert r.formatted_chars == sum(len(w.formatted) for w in by_conv[r.conv_id].values())


def test_edge_rows(spark):
    rows = [(None, 0, None, None), (1, 0, "system", "only"), (2, 0, "user", "x " * 5000), (2, 0, "user", "x " * 5000), (2, None, "assistant", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in read_back(windows(turns)).collect()}
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")]
    assert [(t.role, t.text) for t in back[1].turns] == [("system", "only")]
    assert [t.role for t in back[2].turns] == ["assistant", "user", "user"] and back[2].loss_text == "a"
    assert read_back(windows(turns.limit(0))).count() == 0


def test_query_against_brute_force_and_sql(spark, sf):
    talks = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    talks[-7] = [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]
    got = {r.conv_id: r for r in op5_chat_format(spark, sf).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        r = got[conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(ORACLE).fetchdf()
    assert sorted(map(tuple, want.to_numpy().tolist())) == sorted((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got.values())


def test_only_built_in_functions(spark, sf):
    plan = op5_chat_format(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


