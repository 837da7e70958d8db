"""Cross-tokenizer alignment of every text, and how often token ids of both vocabularies meet in the corpus.

A is a byte-level BPE over a space and the text, B a piece BPE that puts the
space there itself.  Both give byte ranges over the same bytes.  A and B tokens
are linked where their ranges overlap; where tokens of both end at the same
byte, a group ends.

Every text is tokenised in full.  An anchor is a byte at which tokens of both
sides end and both next tokens start with a space.  Anchors split a document
into windows, a word each as a rule, and what a window's groups and links are
depends on its token ids only, so tasks look windows up by the tuple of both
sides' ids and align only those that they have not met.

Tokens of words are looked up in the same way: neither tokenizer merges across a
single space between two other characters (no piece of B holds its space mark
after another character, which is checked where the model is read; the pattern
that A splits texts by starts a new part there), so a text's tokens are those of
its words one after another.  Texts with two spaces in a row, or one at either
end, are encoded whole.

Links become counts in three steps: tasks write each document's distinct id
pairs with their numbers; pairs are summed over the corpus; tasks look the sums
up.  The table of sums is bounded by both vocabularies, not by memory, so it is
handed out in slices of ``SLICE`` pairs, each of which adds to the documents'
results; no link is shuffled.

Defined results: a null or empty text, or one whose bytes either tokenizer does
not give back, has no tokens and zeros; special tokens' strings are plain text;
repeated rows count each; texts of any length are read whole; an empty table
gives an empty table; further columns are not read; a doc_id of any type is
passed through.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from collections import Counter
from functools import lru_cache
from operator import mul

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm._store import table, written
from placebook.llm._words import slices

KNOWN = 100_000  # words, and windows, of one generation that a task remembers
SLICE = 1 << 21  # pairs of ids that are handed to tasks at once
_GAPS = re.compile("  |^ | $")


class Side:
    """One tokenizer: ids of texts that a space is put before, and each id's bytes."""

    def __init__(self, encode_all, token: list[bytes], by_words: bool):
        self.encode_all, self.token, self.by_words = encode_all, token, by_words
        self.size, self.name = [len(x) for x in token], [str(k) for k in range(len(token))]
        self.spaced = [x[:1] == b" " for x in token]


@lru_cache(maxsize=2)
def sides(ranks_path: str, model_path: str) -> tuple[Side, Side]:
    import sentencepiece
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte_bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    token = [b""] * (max(ranks.values()) + 1)
    for value, k in ranks.items():
        token[k] = value
    a = Side(lambda texts: [byte_bpe.encode_ordinary(" " + text) for text in texts], token, True)
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    token = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
    b = Side(lambda texts: model.encode(texts, num_threads=1), token, not any("▁" in p.lstrip("▁") for p in pieces))
    return a, b


#: What a window is made of: A tokens, B tokens, groups, the groups as text, and the links (A id * 65536 + B id) as 32-bit numbers.
Window = tuple[int, int, int, str, bytes]


class Memory:
    """A dictionary of two generations: what has not been asked for during a generation of ``most`` entries goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.new, self.old = {}, self.new
        self.new[key] = value


class Aligner:
    """Tokens, groups and links of texts, with memory of words and of windows."""

    def __init__(self, a: Side, b: Side, known: int = KNOWN):
        self.a, self.b = a, b
        self.by_words = a.by_words and b.by_words
        self.words, self.windows = Memory(known), Memory(known)

    def tokens(self, texts: list[str]) -> list[tuple[tuple, tuple] | None]:
        """Ids of both sides for each text, None where either side does not give the bytes back."""
        out = []
        byte_a, byte_b = self.a.token, self.b.token
        for text, a, b in zip(texts, self.a.encode_all(texts), self.b.encode_all(texts)):
            raw = b" " + text.encode()
            same = b"".join([byte_a[k] for k in a]) == raw == b"".join([byte_b[k] for k in b])
            out.append((tuple(a), tuple(b)) if same else None)
        return out

    def window(self, a: tuple, b: tuple) -> Window:
        """The window of the ids of both sides, which hold the same bytes: remembered, or aligned by one walk over both."""
        found = self.windows.get((a, b))
        if found is None:
            found = self._walk(a, b)
            self.windows.put((a, b), found)
        return found

    def _walk(self, a: tuple, b: tuple) -> Window:
        size_a, size_b, name_a, name_b = self.a.size, self.b.size, self.a.name, self.b.name
        groups, n_groups, i, j, last = "", 1, 0, 0, len(a) - 1
        x, y = a[0], b[0]
        end_a, end_b, own_a, own_b = size_a[x], size_b[y], name_a[x], name_b[y]
        links = [x << 16 | y]
        while True:
            if end_a == end_b:
                if i == last:
                    break
                groups += f"{own_a}|{own_b};"
                n_groups += 1
                i += 1
                j += 1
                x, y = a[i], b[j]
                end_a += size_a[x]
                end_b += size_b[y]
                own_a, own_b = name_a[x], name_b[y]
            elif end_a < end_b:
                i += 1
                x = a[i]
                end_a += size_a[x]
                own_a += "," + name_a[x]
            else:
                j += 1
                y = b[j]
                end_b += size_b[y]
                own_b += "," + name_b[y]
            links.append(x << 16 | y)
        return len(a), len(b), n_groups, f"{groups}{own_a}|{own_b}", array("I", links).tobytes()

    def windows_of(self, a: tuple, b: tuple) -> list[Window]:
        """The windows between anchors of a text's ids."""
        spaced_a, spaced_b, size_a, size_b = self.a.spaced, self.b.spaced, self.a.size, self.b.size
        starts, at = {}, 0  # of A tokens that begin with a space, by byte
        for i, k in enumerate(a):
            if spaced_a[k]:
                starts[at] = i
            at += size_a[k]
        out, at, a0, b0 = [], 0, 0, 0
        for j, k in enumerate(b):
            if j and spaced_b[k] and (i := starts.get(at, 0)):
                out.append(self.window(a[a0:i], b[b0:j]))
                a0, b0 = i, j
            at += size_b[k]
        return [*out, self.window(a[a0:], b[b0:])]

    def document(self, text: str | None) -> tuple | None:
        """(n_a, n_b, n_groups, sha256 of the groups, distinct pairs, times of each), None without tokens."""
        if not text:
            return None
        if self.by_words and not _GAPS.search(text):
            order = text.split(" ")  # each a window of its own, as the space before it starts tokens of both sides
            times = Counter(order)
            known = self._known(times)
            if None in known.values():
                return None
            windows, counts = list(known.values()), list(times.values())
            groups = {w: k[3] for w, k in known.items()}
            said = ";".join([groups[w] for w in order])
        else:
            ids = self.tokens([text])[0]
            if ids is None:
                return None
            windows = self.windows_of(*ids)
            counts = [1] * len(windows)
            said = ";".join([w[3] for w in windows])
        n_a, n_b, n_groups, _, links = zip(*windows)
        sums = [sum(map(mul, n, counts)) for n in (n_a, n_b, n_groups)]
        pair, back = np.unique(np.frombuffer(b"".join(links), np.uint32), return_inverse=True)
        n = np.bincount(back, np.repeat(counts, [len(x) >> 2 for x in links])).astype(np.int64)
        return *sums, hashlib.sha256(said.encode()).hexdigest(), pair.astype(np.int64), n

    def _known(self, words) -> dict[str, Window | None]:
        """The window of each word, in the order of ``words``; None where a tokenizer does not give the bytes back."""
        get = self.words.new.get
        known = {w: get(w) for w in words}
        unknown = []
        for w in [w for w, k in known.items() if k is None]:
            known[w] = k = self.words.get(w)
            if k is None:
                unknown.append(w)
        for word, ids in zip(unknown, self.tokens(unknown) if unknown else []):
            if ids:
                known[word] = found = self.window(*ids)
                self.words.put(word, found)
        return known


def aligned(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of every row; a pair is A id * 65536 + B id."""
    paths = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), model_path or public_tokenizers.path("piece_bpe_32k.model")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        aligner = Aligner(*sides(*paths))
        gc.freeze()  # nothing here is cyclic, and what is remembered would be looked through again and again
        for part in slices(batches, most_bytes=1 << 21):
            rows = [aligner.document(text.as_py()) for text in part.column(1)]
            counts = [pa.array([r[k] if r else 0 for r in rows], pa.int64()) for k in range(3)]
            ends = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(r[4]) if r else 0 for r in rows], out=ends[1:])
            flat = [np.concatenate([r[k] for r in rows if r] or [np.zeros(0, np.int64)]) for k in (4, 5)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in flat]
            links = np.add.reduceat(np.r_[flat[1], 0], ends[:-1]) * (np.diff(ends) > 0) if len(rows) else ends[:0]
            sha = pa.array([r[3] if r else "" for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(links, pa.int64()), sha, *lists], NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column."""
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair over all rows, and whether no pair of its B id has more."""

    def add(batches):
        pair, n, held = [], [], 0

        def summed():
            keys, back = np.unique(np.concatenate(pair), return_inverse=True)
            return keys, np.bincount(back, np.concatenate(n)).astype(np.int64)

        for batch in batches:
            pair.append(_flat(batch, "pairs")[0])
            n.append(_flat(batch, "times")[0])
            held += len(pair[-1])
            if held >= 1 << 22:
                keys, sums = summed()
                pair, n, held = [keys], [sums], len(keys)
                if held >= 1 << 21:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["pair", "n"])
                    pair, n, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], ["pair", "n"])

    counts = written(rows.select("pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(0xFFFF)).alias("b_id")
    most = counts.groupBy(b_id).agg(F.max("n").alias("most"))  # 65536 rows at most
    return written(counts.withColumn("b_id", b_id).join(F.broadcast(most), "b_id").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _add_slice(rows: DataFrame, known: Broadcast) -> DataFrame:
    """Add to n_best and count_sum of each row what the links of one slice of pairs give."""

    def run(batches):
        keys, count, best = known.value
        for batch in batches:
            pair, row = _flat(batch, "pairs")
            times = _flat(batch, "times")[0]
            at = np.searchsorted(keys, pair)
            at[at == len(keys)] = 0
            on = keys[at] == pair
            at, row, times = at[on], row[on], times[on]
            added = []
            for value in (best[at].astype(np.int64), count[at]):
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, row, value * times)
                added.append(total)
            columns = dict(zip(batch.schema.names, batch.columns))
            for name, more in zip(("n_best", "count_sum"), added):
                columns[name] = pa.array(columns[name].to_numpy() + more)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return rows.mapInArrow(run, rows.schema)


def align(docs: DataFrame, ranks_path: str | None = None, model_path: str | None = None, slice_: int = SLICE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark = docs.sparkSession
    rows = written(aligned(docs, ranks_path, model_path), "aligned")
    counts = pair_counts(rows)
    n = counts.count()
    n_slices = max(1, -(-n // slice_))
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for k in range(n_slices if n else 0):
        own = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(n_slices)) == k).toArrow()  # about slice_ rows
        own = own.take(np.argsort(own["pair"].to_numpy(), kind="stable"))
        known = spark.sparkContext.broadcast((own["pair"].to_numpy(), own["n"].to_numpy(), own["best"].to_numpy()))
        rows = _add_slice(rows, known)
        if k + 1 < n_slices:  # one slice at a time in a task's memory
            rows = written(rows, "summed")
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
