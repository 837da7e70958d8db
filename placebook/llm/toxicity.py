"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are lower-cased words without closing punctuation, and word stems of
four to eight bytes.  From a bounded sample of labelled rows every term is in
the vocabulary; inverse document frequencies count all documents.  A term that
no example holds can meet nothing and has no weight.

The examples form an inverted index: for each term the examples that hold it.
Examples that are alike (one language, say) stand in the same blocks of
``BLOCK``, and ``SPAN`` blocks have columns of their own: the terms that most of
their examples hold, function words above all, in a matrix, with the largest
weight of each term in each block.  An example that holds a term which is no
column of its span is in that term's list; lists are added up.  What the lists
give and the block maxima bound what a block can score; a block that cannot beat
the k-th of some examples already scored is skipped, so the neighbours are
exact: what single precision leaves among the best is summed again in double
precision.
They vote with the fourth power of their similarity, and a logistic curve,
fitted on the examples' own leave-one-out votes at the labels' odds, turns the
vote and the mean cosine to all examples of each label into a probability.
The neighbours are evidence.

Defined results: a document without a term of the vocabulary (null and empty
texts too) has no neighbours, and its score is the share of label 1 among
labelled rows without any term (0 where there are none); equal similarities (to
12 places) go to the smaller example id, whatever its label; repeated rows get equal scores; very long texts are
read whole; without both labels to learn from every score is the share of
label 1 (0 without any label); an empty table gives an empty table; further
columns are not inputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm._labels import bounded_sample, held_out, learnable
from placebook.llm._store import table, written
from placebook.llm._words import Texts, mix, slices

EXAMPLES, NEIGHBOURS, BLOCK, SPAN = 3000, 15, 64, 8
COLUMNS, BATCH, SLACK = 768, 64, 1e-5  # terms that a span holds as columns; texts scored together; error of a sum in single precision
STEMS = (4, 5, 6, 7, 8)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?\"')")] = True


def terms(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of the terms of every text, sorted by text and term."""
    start, end, text = texts.spans
    texts.__dict__["byte"] = _FOLD[texts.byte]
    end = end.copy()
    for _ in range(3):
        end -= (end - start > 1) & _CLOSING[texts.byte[end - 1]]
    found, where = [texts.hashes(start, end)], [text]
    for n in STEMS:
        long = end - start > n
        found.append(mix(texts.hashes(start[long], start[long] + n) ^ np.uint64(n)))
        where.append(text[long])
    term, text = np.concatenate(found), np.concatenate(where)
    return text, term.view(np.int64), np.ones(len(term), np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of a sorted array, how often each occurs)."""
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _grouped(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of equal terms, sorted by text and term."""
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return text[at], term[at], np.diff(np.append(at, len(text)))


def _bucket(term: np.ndarray, bits: int) -> np.ndarray:
    """The high bits of each term, in the terms' order."""
    return ((term.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - bits)).view(np.int64)


def _starts(vocabulary: np.ndarray) -> np.ndarray:
    """Where the terms with the same high bits begin in the sorted vocabulary, for every value of about as many bits as it has terms."""
    bits = max(1, len(vocabulary).bit_length())
    out = np.zeros((1 << bits) + 1, np.int32)
    np.cumsum(np.bincount(_bucket(vocabulary, bits), minlength=1 << bits), out=out[1:])
    return out


def _places(vocabulary: np.ndarray, starts: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The index of each term in the sorted vocabulary, -1 where it has none; terms are hashes, so few have equal high bits."""
    bucket = _bucket(term, len(starts).bit_length() - 1)
    at, stop = starts[bucket], starts[bucket + 1]
    out = np.full(len(term), -1, np.int64)
    left = np.flatnonzero(at < stop)
    at, stop, term = at[left], stop[left], term[left]
    while len(left):
        hit = vocabulary[at] == term
        out[left[hit]] = at[hit]
        at += 1
        more = np.flatnonzero(~hit & (at < stop))
        left, at, stop, term = left[more], at[more], stop[more], term[more]
    return out


def _known(texts: Texts, vocabulary: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, index in the sorted vocabulary, count) of the terms that the vocabulary has, sorted."""
    text, term, _ = terms(texts)
    size = max(len(vocabulary), 1)
    at = _places(vocabulary, _starts(vocabulary) if starts is None else starts, term)
    hit = at >= 0
    key, count = _runs(np.sort(text[hit] * size + at[hit]))
    text = key // size
    return text, key - text * size, count


@dataclass
class Index:
    """Examples by term: ``entries`` are (example, entries of each term of the vocabulary, count) in order of term and example.

    ``peak`` has the largest weight of each column in each block; ``column`` the column of each term in each span, or -1.

    ``stands_for`` has the labelled rows that an example of label 0 and of label 1 stands for in the sample.
    """

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    label: np.ndarray
    entries: tuple[np.ndarray, np.ndarray, np.ndarray]
    slope: np.ndarray | None = None
    empty_score: float = 0.0
    stands_for: tuple[float, float] = (1.0, 1.0)

    def build(self) -> None:
        """Lists, columns and bounds, once; the driver that only passes the index on never makes them."""
        if hasattr(self, "first"):
            return
        example, times, count = self.entries
        size, n = len(self.vocabulary), len(self.ids)
        term = np.repeat(np.arange(size), times)
        example = example.astype(np.int64)
        weight = self.weigh(example, term, count, n)
        self.members = [float((self.label == k).sum()) for k in (0, 1)]
        self.middle = [np.bincount(term, weight * (self.label[example] == k), minlength=size) for k in (0, 1)]
        self.n_blocks = max(1, -(-n // BLOCK))
        # places: examples that share common terms, a language's above all, stand in the same blocks
        self.order = _alike_together(self._common(example, term, weight, n))
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        place = self.place.astype(np.int32)[example]
        del example
        spans = range(0, self.n_blocks * BLOCK, SPAN * BLOCK)
        self.column = np.full((size, len(spans)), -1, np.int16)
        self.columns = np.zeros((self.n_blocks * BLOCK, COLUMNS), np.float32)
        listed = np.ones(len(term), bool)
        for k, start in enumerate(spans):
            own = np.flatnonzero((place >= start) & (place < start + SPAN * BLOCK))
            held = np.bincount(term[own], minlength=size)
            common = np.flatnonzero(held >= BLOCK // 4)
            common = common[np.argsort(-held[common], kind="stable")[:COLUMNS]]
            self.column[common, k] = np.arange(len(common))
            own = own[self.column[term[own], k] >= 0]
            self.columns[place[own], self.column[term[own], k]] = weight[own]
            listed[own] = False
        wide = int(self.column.max(initial=-1)) + 1
        self.columns = self.columns[:, :wide].copy() if wide < COLUMNS else self.columns
        self.peak = self.columns.reshape(self.n_blocks, BLOCK, -1).max(axis=1)
        self.has_column = (self.column >= 0).any(axis=1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(term[listed], minlength=size))])
        # place and weight side by side, to be read at once
        posted = np.empty((int(listed.sum()), 2), np.int32)
        posted[:, 0] = place[listed]
        posted[:, 1] = weight[listed].view(np.int32)
        self.posted = posted.reshape(-1).view(np.int64)

    @cached_property
    def starts(self) -> np.ndarray:
        return _starts(self.vocabulary)

    def _common(self, example, term, weight, n: int) -> np.ndarray:
        """The examples' weights of the terms that most of them hold."""
        times = self.entries[1]
        common = np.argsort(-times.astype(np.int64), kind="stable")[:COLUMNS]
        common = common[times[common] >= max(BLOCK // 4, n // 50)]
        column = np.full(len(times), -1, np.int32)
        column[common] = np.arange(len(common))
        some = np.flatnonzero(column[term] >= 0)
        out = np.zeros((n, len(common)), np.float32)
        out[example[some], column[term[some]]] = weight[some]
        return out

    def shared(self, spark: SparkSession) -> Broadcast:
        """The index as one broadcast, bounded by EXAMPLES."""
        if not hasattr(self, "_shared"):
            self._shared = spark.sparkContext.broadcast((self.vocabulary, self.idf, self.ids, self.label, self.entries))
        return self._shared

    def weigh(self, text, term, count, n) -> np.ndarray:
        """TF-IDF weights of unit length by text."""
        weight = (1 + np.log(count, dtype=np.float64)) * self.idf[term]
        norm = np.sqrt(np.bincount(text, weight * weight, minlength=n))
        return (weight / norm[text]).astype(np.float32)

    def nearest(self, text, term, weight, n: int, own: np.ndarray | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k nearest of each of n texts, -1 and 0 where there are fewer; own: an example to leave out."""
        best = np.full((n, k), -1, np.int64)
        sims = np.zeros((n, k))
        if not len(text) or not len(self.ids):
            return best, sims
        self.build()
        first = np.searchsorted(text, np.arange(n + 1))
        for at in range(0, n, BATCH):
            stop = min(at + BATCH, n)
            part = slice(first[at], first[stop])
            self._score(text[part] - at, term[part], weight[part], None if own is None else own[at:stop], best[at:stop], sims[at:stop])
        return best, sims

    def _listed(self, row, term, weight, n: int) -> np.ndarray:
        """What the lists give each text with each place."""
        out = np.zeros((n, self.n_blocks * BLOCK))
        lo = self.first[term]
        held = self.first[term + 1] - lo
        some = held > 0
        row, weight, lo, held = row[some], weight[some].astype(np.float64), lo[some], held[some]
        bounds = np.searchsorted(row, np.arange(n + 1)).tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            if a == b:
                continue
            many = held[a:b]
            ends = np.cumsum(many)
            entry = np.repeat(lo[a:b] - (ends - many), many)
            entry += np.arange(ends[-1])
            posted = self.posted.take(entry).view(np.int32)
            value = np.repeat(weight[a:b], many)
            value *= posted[1::2].view(np.float32)
            np.add.at(out[i], posted[::2].astype(np.int64), value)
        return out

    def _asked(self, row, term, weight, n: int) -> np.ndarray:
        """The weights of each text in the columns of each span."""
        out = np.zeros((self.column.shape[1], n, self.columns.shape[1]), np.float32)
        some = np.flatnonzero(self.has_column[term])
        column = self.column[term[some]]
        at, span = np.nonzero(column >= 0)
        out[span, row[some[at]], column[at, span]] = weight[some[at]]
        return out

    def _score(self, row, term, weight, own, best, sims) -> None:
        """Fill ``best`` and ``sims`` for a few texts: the lists, then the columns of each block that may reach the k-th similarity."""
        n, size, k = len(best), len(self.columns), min(best.shape[1], len(self.columns))
        score, asked = self._listed(row, term, weight, n), self._asked(row, term, weight, n)
        if own is not None:
            score[np.arange(n), self.place[own]] = -np.inf
        few = _high(score, k)
        least = np.take_along_axis(score, few, axis=1)
        least += np.einsum("ijk,ijk->ij", self.columns[few], asked[few // (SPAN * BLOCK), np.arange(n)[:, None]])
        least = least.min(axis=1)
        reach = score.reshape(n, self.n_blocks, BLOCK).max(axis=2)
        for span, start in enumerate(range(0, self.n_blocks, SPAN)):
            reach[:, start : start + SPAN] += asked[span] @ self.peak[start : start + SPAN].T
        needed = (reach > 0) & (reach >= least[:, None] - SLACK)
        rough = np.full((n, size), -np.inf, np.float32)
        for block in np.flatnonzero(needed.any(axis=0)).tolist():
            span, some = slice(block * BLOCK, (block + 1) * BLOCK), np.flatnonzero(needed[:, block])
            rough[some, span] = score[some, span] + asked[block // SPAN][some] @ self.columns[span].T
        least = np.take_along_axis(rough, _high(rough, k), axis=1).min(axis=1)
        # sums in single precision are right to SLACK; what may be among the best is then summed in double precision
        doc, at = np.nonzero(rough >= np.maximum(least - SLACK, -1)[:, None])
        exact = score[doc, at] + np.einsum("ij,ij->i", self.columns[at], asked[at // (SPAN * BLOCK), doc], dtype=np.float64)
        # equal vectors may differ in the last bits of their sums
        exact = np.round(exact, 12)
        some = exact > 0
        doc, name, exact = doc[some], self.order[at[some]], exact[some]
        order = np.lexsort((name, -exact, doc))
        doc, name, exact = doc[order], name[order], exact[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        top = rank < k
        best[doc[top], rank[top]] = name[top]
        sims[doc[top], rank[top]] = exact[top]

    def means(self, text, term, weight, n: int, own: np.ndarray | None = None) -> np.ndarray:
        """The mean cosine of each of n texts to all examples of label 0 and of label 1; own: an example to leave out."""
        self.build()
        out = np.zeros((n, 2))
        for k in (0, 1):
            mine = (self.label[own] == k) if own is not None else np.zeros(n, bool)
            total = np.bincount(text, weight * self.middle[k][term], minlength=n) - mine
            out[:, k] = np.round(total / np.maximum(self.members[k] - mine, 1), 9)
        return out

    def vote(self, best: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """The share of label 1 among the neighbours, each counting by the fourth power of its similarity and the rows that it stands for; no neighbours: NaN."""
        if not len(self.ids):
            return np.full(len(best), np.nan)
        weight = sims.astype(np.float64) ** 4 * (best >= 0) * np.where(self.label[np.maximum(best, 0)] == 1, self.stands_for[1], self.stands_for[0])
        total = weight.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (weight * self.label[np.maximum(best, 0)]).sum(axis=1) / total

    def probability(self, best: np.ndarray, sims: np.ndarray, means: np.ndarray) -> np.ndarray:
        vote = self.vote(best, sims)
        x = _features(np.nan_to_num(vote), sims, means)
        slope = np.zeros(6) if self.slope is None else self.slope
        return np.where(np.isnan(vote), self.empty_score, 1 / (1 + np.exp(-np.clip(x @ slope, -30, 30))))


def _high(score: np.ndarray, k: int, depth: int = 16) -> np.ndarray:
    """k places of each row with high values, the highest or nearly: each is the highest of ``depth`` that stand far apart."""
    n, size = score.shape
    if size % depth or size < 4 * k * depth:
        return np.argpartition(score, size - k, axis=1)[:, size - k :]
    wide = size // depth
    apart = score.reshape(n, depth, wide)
    place = np.argpartition(apart.max(axis=1), wide - k, axis=1)[:, wide - k :]
    return np.take_along_axis(apart, place[:, None], axis=2).argmax(axis=1) * wide + place


def _alike_together(columns: np.ndarray, groups: int = 48, rounds: int = 6) -> np.ndarray:
    """An order of the rows in which rows near to each other in angle stand together; equal for equal input."""
    unit = columns / np.maximum(np.linalg.norm(columns, axis=1, keepdims=True), 1e-12)
    if len(unit) <= BLOCK or not unit.shape[1]:
        return np.arange(len(unit))
    middle = unit[np.linspace(0, len(unit) - 1, min(groups, len(unit) // BLOCK + 1)).astype(np.int64)]
    for _ in range(rounds):
        own = (unit @ middle.T).argmax(axis=1)
        for k in np.unique(own):
            mean = unit[own == k].mean(axis=0)
            middle[k] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    alike, rank, now = middle @ middle.T, np.empty(len(middle), np.int64), 0
    left = np.ones(len(middle), bool)
    for turn in range(len(middle)):
        rank[now], left[now] = turn, False
        now = int(np.where(left, alike[now], -2).argmax())
    return np.argsort(rank[own], kind="stable")


def _features(vote: np.ndarray, sims: np.ndarray, means: np.ndarray) -> np.ndarray:
    near = sims.mean(axis=1, dtype=np.float64)
    return np.column_stack([np.ones(len(vote)), vote, near, vote * near, means])


def _fitted(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The logistic slopes of features that are brought to one scale for the fit."""
    middle, scale = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
    slope = _logistic(np.column_stack([x[:, 0], (x[:, 1:] - middle) / scale]), y, w)
    slope[1:] /= scale
    slope[0] -= slope[1:] @ middle
    return slope


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, hold: float = 0.05) -> np.ndarray:
    """Weighted logistic fit by Newton steps, lightly held to zero."""
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (p - y)) + hold * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + hold * np.eye(x.shape[1])
        step = np.linalg.solve(hess, g)
        beta -= step * min(1.0, 4 / max(abs(step).max(), 1e-12))
        if abs(step).max() < 1e-9:
            break
    return beta


_at_hand: list = []  # what was broadcast, and the index that this process built of it


def _index(told: tuple, **fitted) -> Index:
    """The index of what was broadcast, built once in a process for all its tasks."""
    if not _at_hand or _at_hand[0] is not told:
        _at_hand[:] = [told, Index(*told)]
    index = _at_hand[1]
    for name, value in fitted.items():
        setattr(index, name, value)
    return index


def _counted(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all documents hold each term of the vocabulary, and how many there are; each task adds up its own.

    A task sends its counts as ranges of 8192 terms, and each range is added up in one place.
    """
    size, wide = len(vocabulary) + 1, 8192  # the last one counts rows

    def run(batches):
        total, starts = np.zeros(size, np.int64), _starts(vocabulary)
        for part in slices(batches):
            _, term, _ = _known(Texts(part.column(0)), vocabulary, starts)
            total += np.bincount(term, minlength=size)
            total[-1] += part.num_rows
        starts = range(0, size, wide)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([total[k : k + wide].astype(np.int32).tobytes() for k in starts], pa.binary())], ["start", "n"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[start] = sums.get(start, 0) + np.frombuffer(n, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([n.tobytes() for n in sums.values()], pa.binary())], ["start", "n"])

    total = np.zeros(size, np.int64)
    for r in docs.select("text").mapInArrow(run, "start long, n binary").repartition("start").mapInArrow(add, "start long, n binary").collect():  # the vocabulary once
        n = np.frombuffer(r["n"], np.int64)
        total[r["start"] : r["start"] + len(n)] = n
    return total[:-1], int(total[-1])


def _number(docs: DataFrame):
    """The id that an example is named by: doc_id if that is a whole number, else a hash of it."""
    whole = dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    return F.col("doc_id").cast("long") if whole else F.coalesce(F.col("doc_id").try_cast("long"), F.xxhash64("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", examples: int = EXAMPLES, seed: int = 7) -> Index:
    """The index over at most ``examples`` labelled rows of each label; the driver holds only these, as terms and counts."""
    known = learnable(labels, column)
    odds = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    if len(odds) < 2:
        return Index(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), nothing, empty_score=float(next(iter(odds), 0)))
    ids = bounded_sample(known, odds, examples, seed)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # 2 * examples ids at most
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = written(sample.select(_number(docs).alias("doc_id"), "label", "text"), "examples")

    def vectors(batches):
        for part in slices(batches):
            text, term, count = _grouped(*terms(Texts(part.column(2)))[:2])
            at = np.searchsorted(text, np.arange(part.num_rows + 1)).tolist()
            term, count = ([x[i:j].tobytes() for i, j in zip(at, at[1:])] for x in (term, count.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(term, pa.binary()), pa.array(count, pa.binary())], ["doc_id", "label", "term", "n"])

    def inverted(batches):
        """The examples that have terms, in order of id, and their entries in order of term, in the narrowest types and pieces of 1 MB."""
        rows = sorted((r for batch in batches for r in zip(*(batch.column(k).to_pylist() for k in range(4))) if r[2]), key=lambda r: r[0])
        found = [np.frombuffer(r[2], np.int64) for r in rows]
        term = np.concatenate(found) if rows else nothing[1]
        example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t in found])
        count = np.concatenate([np.frombuffer(r[3], np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
        order = np.lexsort((example, term))
        term, example, count = term[order], example[order], count[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else nothing[0]
        parts = {
            "ids": np.array([r[0] for r in rows], np.int64), "label": np.array([r[1] for r in rows], np.float64), "vocabulary": term[first],
            "times": np.diff(np.append(first, len(term))), "example": example, "count": count,
        }
        for name, part in parts.items():
            part = part.astype(np.min_scalar_type(part.max())) if name in ("times", "example", "count") and len(part) else part
            data = part.tobytes()
            for at in range(0, len(data), 1 << 20):
                yield pa.RecordBatch.from_pydict({"name": [name], "type": [part.dtype.str], "at": [at], "data": [data[at : at + (1 << 20)]]})

    size = {k: 0 for k in (0, 1)} | {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = float(size[1]), float(size[0])
    rows = sample.mapInArrow(vectors, "doc_id long, label int, term binary, n binary").repartition(1)  # 2 * examples rows
    told: dict[str, list] = {}
    for r in sorted(rows.mapInArrow(inverted, "name string, type string, at long, data binary").collect(), key=lambda r: r["at"]):
        told.setdefault(r["name"], [r["type"]]).append(bytes(r["data"]))
    part = {name: np.frombuffer(b"".join(data), kind) for name, (kind, *data) in told.items()}
    del told
    held, label, vocabulary = part.get("ids", nothing[0]), part.get("label", np.zeros(0)), part.get("vocabulary", nothing[0])
    df, n = _counted(docs, vocabulary)
    idf = np.log((1 + n) / (1 + df)) + 1
    index = Index(vocabulary, idf, held, label, nothing)
    share = {1: odds[1] / max(n1, 1), 0: odds[0] / max(n0, 1)}
    if len(held):
        index.entries = (part["example"], part["times"], part["count"])
    index.stands_for = (share[0], share[1])
    bare = [(size[k] - int((label == k).sum())) * share[k] for k in (0, 1)]
    index.empty_score = bare[1] / max(sum(bare), 1e-9)
    if len(held):
        shared, stands_for = index.shared(docs.sparkSession), index.stands_for

        def left_out(batches):
            ix = _index(shared.value, stands_for=stands_for)
            for batch in slices(batches):
                text, term, count = _known(Texts(batch.column(2)), ix.vocabulary, ix.starts)
                n, some = batch.num_rows, np.unique(text)
                own = np.minimum(np.searchsorted(ix.ids, batch.column(0).to_numpy()), len(ix.ids) - 1)
                weight = ix.weigh(text, term, count, n)
                best, sims = ix.nearest(text, term, weight, n, own=own)
                vote = ix.vote(best, sims)
                x = np.column_stack([ix.label[own], _features(vote, sims, ix.means(text, term, weight, n, own=own))])[some]
                yield pa.RecordBatch.from_arrays([pa.array(ix.ids[own[some]]), *(pa.array(c) for c in x.T)], ["doc_id", "y", *(f"x{k}" for k in range(6))])

        seen = sample.mapInArrow(left_out, "doc_id long, y double, " + ", ".join(f"x{k} double" for k in range(6))).collect()  # 2 * examples rows
        x = np.array(sorted(tuple(r) for r in seen), np.float64)[:, 1:]
        x = x[~np.isnan(x).any(axis=1)]
        w = np.where(x[:, 0] == 1, share[1], share[0])
        index.slope = _fitted(x[:, 1:], x[:, 0], w / w.mean()) if len(x) else np.zeros(6)
    return index


def scored(docs: DataFrame, index: Index) -> DataFrame:
    """(doc_id, score, evidence) of every document: evidence has the ids, similarities and labels of its nearest examples."""
    shared = index.shared(docs.sparkSession)
    fitted = {"slope": index.slope, "empty_score": index.empty_score, "stands_for": index.stands_for}

    def run(batches):
        ix = _index(shared.value, **fitted)
        for part in slices(batches):
            n = part.num_rows
            text, term, count = _known(Texts(part.column(1)), ix.vocabulary, ix.starts)
            weight = ix.weigh(text, term, count, n)
            best, sims = ix.nearest(text, term, weight, n)
            score = ix.probability(best, sims, ix.means(text, term, weight, n))
            some = best >= 0
            at = pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32))
            flat = best[some]
            evidence = pa.StructArray.from_arrays(
                [pa.array(ix.ids[flat]), pa.array(sims[some].astype(np.float64)), pa.array(ix.label[flat].astype(np.int32))], ["doc_id", "similarity", "label"]
            )
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.ListArray.from_arrays(at, evidence)], ["doc_id", "score", "evidence"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored(docs, index).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence")


