import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placebook.llm import alignment


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.sides(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")))


def byte_alphabet():
    """The public byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def tokens(text, tokenizers):
    """Both sides' (id, bytes) by the libraries alone."""
    a, b = tokenizers
    alphabet = byte_alphabet()
    encoded = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(encoded.ids, encoded.tokens)]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    return left, right


def brute(docs, tokenizers):
    out, links_of, count = [], [], Counter()
    for key, text in docs:
        left, right = tokens(text, tokenizers) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or any(b"".join(x for _, x in side) != raw for side in (left, right)):
            out.append([key, 0, 0, 0, ""])
            links_of.append([])
            continue
        spans = []
        for side in (left, right):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e]
        ends = sorted({e for _, _, e in spans[0]} & {v for _, _, v in spans[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for i, s, e in side if lo <= s and e <= hi) for side in spans))
        out.append([key, len(left), len(right), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        links_of.append(links)
        count.update(links)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return sorted(((k, a, b, g, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), sha) for (k, a, b, g, sha), ls in zip(out, links_of)), key=str)


def fixture():
    rng = random.Random(9)
    parts = ["the", "naïve", "Straße", "don't", "12345", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x0A>", "日本語", "🎉🎉", "é", " ", "a\nb", "\n", "\t", "x" * 50, ".", "...", "Ωmega", "▁", "​", "it's", "\r\n"]
    docs = [(k, rng.choice([" ", "", "  "]).join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, " "), (203, "  "), (204, " lead"), (205, "trail "), (206, "\x00"), (207, "plain words"), (207, "plain words"), (None, "plain words"), (208, "ﬁ ligature ½")]
    return docs


def test_against_brute_force(spark, tokenizers):
    docs = fixture()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"pairs": F.lit("x"), "n_a": F.lit(1)})
    want = brute(docs, tokenizers)
    for slice_ in (alignment.SLICE, 100):  # in the second case many slices
        assert sorted((tuple(r) for r in alignment.align(df, slice_=slice_).collect()), key=str) == want
    assert sum(r[3] > 0 for r in want) > 60


def test_query_against_brute_force(spark, sf, tokenizers):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").filter("length(text) < 1500").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((tuple(r) for r in alignment.align(df).collect()), key=str) == brute(docs, tokenizers)
    whole = alignment.op11_alignment(spark, sf)
    assert whole.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert whole.filter("n_links <> n_a + n_b - n_groups").isEmpty()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.'as1▁")), max_size=60))
def test_words_and_whole_texts_give_the_same(aligner, tokenizers, text):
    """A text's tokens are those of its words one after another, and both ways give the same windows' sums."""
    found = aligner.document(text)
    left, right = tokens(text, tokenizers) if text else ([], [])
    raw = (" " + text).encode()
    if not text or any(b"".join(x for _, x in side) != raw for side in (left, right)):
        assert found is None
    else:
        assert found[:2] == (len(left), len(right))
        whole = alignment.Aligner(aligner.a, aligner.b)
        whole.by_words = False
        assert whole.tokens([text]) == [(tuple(i for i, _ in left), tuple(i for i, _ in right))]
        assert [str(x) for x in whole.document(text)] == [str(x) for x in found]


def test_memory_is_bounded(aligner):
    small = alignment.Aligner(aligner.a, aligner.b, known=5)
    for k in range(40):
        text = " ".join(f"word{j}" for j in range(k, k + 9))
        assert [str(x) for x in small.document(text)] == [str(x) for x in aligner.document(text)]
        assert all(len(m) <= 5 for kept in (small.words, small.windows) for m in (kept.new, kept.old))


def test_empty_table(spark):
    got = alignment.align(spark.createDataFrame([], "doc_id string, text string"))
    assert got.count() == 0 and got.columns[-1] == "groups_sha256"
