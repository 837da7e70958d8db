"""Collocations: frequent phrases of 2 to 5 words, scored by their weakest cut, each language on its own.

Phrases that occur ``LEAST`` times or more are found without a row, or a count,
for every phrase of the corpus:

1. Words are counted exactly.
2. Every two-word phrase is hashed.  The hash names one of many partitions and a
   32-bit tag in it.  Tasks send each partition its tags, counted as far as one
   buffer reaches, after the mass that they will send.  A partition keeps a
   Misra-Gries summary of more counters than its mass divided by ``LEAST``:
   merging adds counters and takes the first counter beyond the capacity off
   all of them, so what a tag can have lost stays below ``LEAST`` and every
   frequent phrase survives.  Tags that two phrases share only add up.
3. The same is done for longer phrases whose two-word parts have all survived, as
   a phrase is never more frequent than a part of it.
4. A second pass counts the phrases that survived by their texts, exactly.

What survives is handed to tasks as a Bloom filter of a bounded number of bits;
what it lets through by mistake is counted and dropped.

Scores are floor(1000 * a * n / (l * r)) in decimals of 38 digits, exact for
counts below 10**16.

Defined results: a null text is empty, a null language is ``und``; A-Z are
lower-cased, other letters are not; repeated rows count each; phrases of equal
score and count are in byte order; texts of any length are read whole; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.llm._store import table, written
from placebook.llm._words import BLANK, Texts, lowered, mix, slices, strings

LONGEST, LEAST, FIRST, COVERED = 5, 100, 2000, 100
HELD = 1 << 22  # hashes, or rows of counts, that a task holds before it passes them on
MASS = 1 << 26  # phrases that one partition's summary takes, about
MOST_BITS = 1 << 27  # of a Bloom filter: 16 MB

_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Pieces(Texts):
    """Texts cut into pieces at punctuation and line ends, and pieces into words."""

    @cached_property
    def solid(self) -> np.ndarray:
        return ~(BLANK[self.byte] | _STOP[self.byte])

    @cached_property
    def piece(self) -> np.ndarray:
        """A number for each word; neighbours of one piece have the same."""
        start, _, text = self.spans
        stops = np.cumsum(_STOP[self.byte])
        return stops[start] + text if len(start) else start

    def phrases(self, lengths: range, own: np.ndarray, known: Filter | None = None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """(index of the first word, hash) of the phrases of each length inside one piece.

        ``own`` has a hash for each text that its phrases are told apart by; ``known`` holds the two-word phrases that
        longer ones may consist of.
        """
        piece, h, text = self.piece, self.word_hash, self.spans[2]
        run, ok, out = h, np.ones(len(h), bool), {}
        for m in range(2, lengths.stop):
            k = len(h) - m + 1
            if k <= 0:
                break
            run = run[:k] * np.uint64(0x2545F4914F6CDD1D) + h[m - 1 :]
            ok = ok[:k] & (piece[m - 1 :] == piece[m - 2 : -1])
            if m == 2 and known is not None:
                at = np.flatnonzero(ok)
                two = np.zeros(k, bool)
                two[at] = known.has(mix(run[at] ^ own[text[at]]))
                ok = ok & two
            elif known is not None:
                ok = ok & two[m - 2 :]
            if m in lengths:
                at = np.flatnonzero(ok)
                out[m] = at, mix(run[at] ^ own[text[at]])
        return out


class Filter:
    """A Bloom filter over (partition, tag) of phrase hashes."""

    def __init__(self, words: np.ndarray, parts: int):
        self.words, self.parts = words, parts

    @staticmethod
    def key(h: np.ndarray, parts: int) -> np.ndarray:
        """Partition in the upper and tag in the lower 32 bits."""
        return ((h >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))

    @staticmethod
    def bits(key: np.ndarray, n_bits: int) -> list[np.ndarray]:
        a = mix(key)
        return [x & np.uint64(n_bits - 1) for x in (a, a >> np.uint64(32), mix(a))]

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at in self.bits(self.key(h, self.parts), 64 * len(self.words)):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def _lang_hash(langs: pa.Array) -> np.ndarray:
    """A hash of the language of each row."""
    coded = langs.dictionary_encode()
    each = np.array([xxhash.xxh64_intdigest(x, 7) for x in coded.dictionary.to_pylist()], np.uint64)
    return each[coded.indices.to_numpy()] if len(each) else np.zeros(len(langs), np.uint64)


def _merged(tags: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(tags, kind="stable")
    tags, counts = tags[order], counts[order]
    first = np.flatnonzero(np.r_[True, tags[1:] != tags[:-1]]) if len(tags) else np.zeros(0, np.int64)
    return tags[first], (np.add.reduceat(counts, first) if len(first) else counts)


class Summary:
    """A Misra-Gries summary of ``capacity`` counters; what any tag can have lost is ``taken``."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.tags, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, tags: np.ndarray, counts: np.ndarray) -> None:
        """Take further counts, or another summary's; then add its ``taken`` too."""
        tags, counts = _merged(np.concatenate([self.tags, tags]), np.concatenate([self.counts, counts]))
        if len(tags) > self.capacity:
            off = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += off
            keep = counts > off
            tags, counts = tags[keep], counts[keep] - off
        self.tags, self.counts = tags, counts


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


class _Counts:
    """Exact counts of (lang, phrase, words) that are summed up whenever they become many."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, langs: pa.Array, row: np.ndarray, phrases: pa.Array, words: int) -> None:
        """Count the phrases of a batch; ``langs`` has each row's language, ``row`` each phrase's row."""
        lang, coded = langs.dictionary_encode(), phrases.dictionary_encode()
        n = len(coded.dictionary)
        at = lang.indices.to_numpy()[row].astype(np.int64) * n + coded.indices.to_numpy()
        key, count = np.unique(at, return_counts=True)
        columns = (lang.dictionary.take(pa.array(key // n)), coded.dictionary.take(pa.array(key % n)).cast(pa.string()), pa.array(np.full(len(key), words, np.int32)), pa.array(count))
        self.tables.append(pa.table(columns, ["lang", "phrase", "words", "n"]))
        self.rows += len(key)

    def full(self) -> bool:
        if self.rows < HELD // 4:
            return False
        self.tables = [self.summed()]
        self.rows = len(self.tables[0])
        return self.rows >= HELD // 8

    def summed(self) -> pa.Table:
        held = pa.concat_tables(self.tables)
        return held.group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "words", "n"])

    def taken(self) -> list[pa.RecordBatch]:
        out = self.summed().to_batches(max_chunksize=1 << 16) if self.tables else []
        self.tables, self.rows = [], 0
        return out


COUNTS = "lang string, phrase string, words int, n long"


def _summed(rows: DataFrame, name: str, least: int = 1) -> DataFrame:
    return written(rows.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), name)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, words = 1, n) of every word."""

    def run(batches):
        held = _Counts()
        for part in slices(batches):
            texts = lowered(Pieces(part.column(1)))
            start, end, text = texts.spans
            if len(start):
                offsets = np.r_[0, np.cumsum(end - start)]
                words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(texts.byte[texts.solid]))
                held.add(part.column(0), text, words, 1)
            if held.full():
                yield from held.taken()
        yield from held.taken()

    return _summed(_rows(docs).mapInArrow(run, COUNTS), "words")


def phrase_counts(docs: DataFrame, known: Broadcast, longest: int, least: int) -> DataFrame:
    """(lang, phrase, words, n) of the phrases in the filter that occur ``least`` times or more, counted by their texts."""

    def run(batches):
        held, known_ = _Counts(), known.value
        for part in slices(batches):
            texts = lowered(Pieces(part.column(1)))
            if len(texts.spans[0]):
                data, first, last = texts.joined
                for m, (at, h) in texts.phrases(range(2, longest + 1), _lang_hash(part.column(0)), known_).items():
                    at = at[known_.has(h)] if m > 2 else at
                    if len(at):
                        held.add(part.column(0), texts.spans[2][at], strings(data, first[at], last[at + m - 1]), m)
            if held.full():
                yield from held.taken()
        yield from held.taken()

    return _summed(_rows(docs).mapInArrow(run, COUNTS), "phrases", least)


def _sent(keys: list[np.ndarray]):
    """One buffer of keys as rows (part, kind, mass, tags, counts): kind 0 tells the mass alone."""
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    part = (key >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    tags, counts = key.astype(np.uint32), count.astype(np.uint32)
    rows = []
    for a, b in zip(cuts, np.r_[cuts[1:], len(key)]):
        own = np.argsort(counts[a:b] > 1, kind="stable") + a  # those of count 1 first; their counts are not sent
        mass = int(counts[a:b].sum())
        rows.append((int(part[a]), 0, mass, None, None))
        rows.append((int(part[a]), 1, mass, tags[own].tobytes(), counts[own][counts[own] > 1].tobytes()))
    columns = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["part", "kind", "mass", "tags", "counts"])


def survivors(docs: DataFrame, lengths: range, parts: int, least: int = LEAST, known: Broadcast | None = None, held: int = HELD) -> DataFrame:
    """(key) of phrase hashes: a superset of the keys of all phrases that occur ``least`` times or more, by Misra-Gries summaries."""

    def send(batches):
        keys, n, filter_ = [], 0, known.value if known else None
        for part in slices(batches):
            texts = lowered(Pieces(part.column(1)))
            if len(texts.spans[0]):
                for _, h in texts.phrases(lengths, _lang_hash(part.column(0)), filter_).values():
                    keys.append(Filter.key(h, parts))
                    n += len(h)
            if n >= held:
                yield _sent(keys)
                keys, n = [], 0
        if n:
            yield _sent(keys)

    def summarise(batches):
        out: list[np.ndarray] = []
        part, mass, summary, waiting, n = None, 0, None, [], 0

        def merge():
            nonlocal waiting, n
            if waiting:
                summary.merge(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
            waiting, n = [], 0

        def end():
            merge()
            if summary is not None:
                may = summary.counts + summary.taken >= least
                out.append(np.int64(part << 32) | summary.tags[may].astype(np.int64))

        for batch in batches:
            for own, kind, own_mass, tags, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if own != part:
                    end()
                    part, mass, summary = own, 0, None
                if kind == 0:
                    mass += own_mass
                    continue
                if summary is None:  # all of the partition's mass has been told
                    summary = Summary(mass // least + 1)
                tag, more = np.frombuffer(tags, np.uint32), np.frombuffer(counts, np.uint32)
                waiting.append((tag, np.r_[np.ones(len(tag) - len(more), np.int64), more.astype(np.int64)]))
                n += len(tag)
                if n >= max(held // 4, summary.capacity):
                    merge()
            if sum(map(len, out)) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["key"])
                out = []
        end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out))], ["key"])

    sent = _rows(docs).mapInArrow(send, "part long, kind int, mass long, tags binary, counts binary")
    dealt = sent.repartition(min(parts, 1 << 16), "part").sortWithinPartitions("part", "kind")
    return written(dealt.mapInArrow(summarise, "key long"), "survivors")


def bloom(keys: DataFrame, parts: int, most_bits: int = MOST_BITS) -> Broadcast:
    """A broadcast filter of the keys: 16 bits or more for each up to ``most_bits`` in all, which bound what the driver and a task hold."""
    n_bits = min(max(1 << 16, 1 << (16 * max(keys.count(), 1)).bit_length()), most_bits)

    def run(batches):
        for batch in batches:
            at = np.concatenate(Filter.bits(batch.column(0).to_numpy().astype(np.uint64), n_bits))
            word, mask = (at >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(mask)], ["word", "mask"])

    found = keys.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # n_bits / 64 rows at most
    words = np.zeros(n_bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["mask"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(Filter(words, parts))


def candidates(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of every word, and of every phrase of 2 to ``longest`` words that occurs ``least`` times or more."""
    spark = docs.sparkSession
    words = word_counts(docs)
    mass = words.agg(F.sum("n")).first()[0] or 0
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // MASS))
    two = survivors(docs, range(2, 3), parts, least)
    known = bloom(two, parts)
    if longest > 2:
        known = bloom(two.union(survivors(docs, range(3, longest + 1), parts, least, known)), parts)
    return words, phrase_counts(docs, known, longest, least)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language by their weakest cut's score.

    A phrase inside a longer candidate of at least ``covered`` per cent of its occurrences is left out; as counts never
    grow with length, it is enough to look at candidates one word longer.
    """
    words, phrases = candidates(docs, longest, least)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = words.filter(F.col("n") >= least).unionByName(phrases).select("lang", "phrase", "n")
    own = phrases.select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    inner = own.filter("words > 2").select("lang", "a", F.explode(F.array(F.expr("slice(w, 1, words - 1)"), F.expr("slice(w, 2, words - 1)"))).alias("w"))
    longer = inner.select("lang", F.array_join("w", " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = own.join(longer, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {covered} * a").drop("longer")

    cuts = left.select("lang", "phrase", "a", "w", "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("head"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    wide = "cast({} as decimal(16, 0))".format
    score = F.expr(f"({wide('a')} * {wide('n')} * cast(1000 as decimal(4, 0))) div ({wide('l')} * {wide('r')})")
    scored = cuts.join(total, "lang").withColumn("score", score)
    weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = weakest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
said AS (SELECT lang, w FROM (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece) WHERE len(w) > 0),
gram AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM said, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
inside AS (SELECT lang, a, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, a, m, w, k, unnest(range(1, m - k + 2)) AS i FROM cand, (SELECT unnest(range(2, 5)) AS k) WHERE k < m)),
cover AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
own AS (SELECT c.* FROM cand c LEFT JOIN cover v USING (lang, phrase) WHERE v.longer IS NULL OR 100 * v.longer < 100 * c.a),
cut AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS h, array_to_string(w[k + 1:m], ' ') AS t FROM (SELECT *, unnest(range(1, m)) AS k FROM own)),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n,
    (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.h JOIN f y ON y.lang = c.lang AND y.phrase = c.t JOIN total g ON g.lang = c.lang),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least) WHERE rank <= 2000
"""
