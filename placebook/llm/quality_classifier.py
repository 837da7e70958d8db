"""Quality classifier: a byte-level convolutional network in numpy.

The first layer slides learned filters over the bytes of a document; a filter
is a table of weights by byte for each place of its window.  The document is
covered by overlapping chunks, each filter's response is max-pooled over a
chunk, and the chunks' vectors are averaged and combined into one probability.

Training takes a bounded sample of labelled rows (``TRAIN_ROWS`` of each
label), null, empty and very long ones too, and up to ``HELD_CHUNKS`` chunks of
each, drawn from its whole length, out of which every epoch takes
``TRAIN_CHUNKS`` at random; scoring reads every byte.  The sample is balanced, and the bias is then moved to the labels'
own odds, counted over all rows that may be learned from.

Defined results: a null or empty text is one chunk of padding and gets the
score that the network gives it; repeated rows get equal scores; very long
texts are read whole, a bounded block of bytes at a time; without both labels
to learn from every score is the share of label 1 (0.5 without any label); an
empty table gives an empty table; further columns are not inputs.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.llm._labels import bounded_sample, held_out, learnable
from placebook.llm._store import table
from placebook.llm._words import Texts, slices

WIDTH, FILTERS, SEGMENT = 6, 24, 128
TRAIN_ROWS, TRAIN_CHUNKS, HELD_CHUNKS = 1500, 6, 96
LONG = 2 * SEGMENT + WIDTH - 1  # a chunk, with WIDTH - 1 more bytes for the last windows


@dataclass
class Network:
    """Filters by (place, byte, filter), their biases, and the weights of the pooled responses."""

    filters: np.ndarray
    offset: np.ndarray
    weight: np.ndarray
    bias: float
    constant: float | None = None

    def pooled(self, texts: Texts, block: int = 1 << 15) -> np.ndarray:
        """The mean over a text's chunks of each filter's maximum: rows are texts.

        A chunk is two neighbouring segments, so every segment but the first and last lies in two chunks.
        """
        width = len(self.filters)
        size = np.diff(texts.offset)
        held = np.maximum(size, 1)
        start = np.concatenate([[0], np.cumsum(held + width - 1)])
        byte = np.zeros(start[-1] + width, np.uint8)  # texts with room for a window that hangs over the end
        byte[np.arange(len(texts.byte)) + np.repeat(start[:-1] - texts.offset[:-1], size)] = texts.byte
        segments = -(-held // SEGMENT)
        first = np.concatenate([[0], np.cumsum(segments)])
        within = np.arange(first[-1]) - np.repeat(first[:-1], segments)
        begin = np.repeat(start[:-1], segments) + within * SEGMENT
        end = np.minimum(begin + SEGMENT, np.repeat(start[:-1] + held, segments))
        most = np.empty((len(begin), self.filters.shape[2]), np.float32)
        step = max(1, block // SEGMENT)
        for a in range(0, len(begin), step):
            b = min(a + step, len(begin))
            lo, hi = begin[a], end[b - 1]
            response = self.filters[0][byte[lo:hi]]
            for k in range(1, width):
                response += self.filters[k][byte[lo + k : hi + k]]
            # pairs (begin, end); without the last end the last segment runs to the end of the block
            bounds = np.column_stack([begin[a:b], end[a:b]]).ravel()[:-1] - lo
            most[a:b] = np.maximum.reduceat(response, bounds, axis=0)[::2]
        later = np.minimum(np.arange(len(begin)) + 1, np.repeat(first[1:], segments) - 1)
        chunk = np.maximum(np.maximum(most, most[later]) + self.offset, 0)
        # the last segment alone is no chunk of its own, unless the text has no other
        chunk[(within == np.repeat(segments, segments) - 1) & (np.repeat(segments, segments) > 1)] = 0
        return np.add.reduceat(chunk, first[:-1], axis=0) / np.maximum(segments - 1, 1)[:, None]

    def score(self, texts: Texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(texts.n, self.constant)
        if not texts.n:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.pooled(texts).astype(np.float64) @ self.weight + self.bias, -30, 30)))


def drawn_chunks(text: bytes, rng: np.random.Generator) -> list[bytes]:
    """All chunks of a text, or HELD_CHUNKS of them drawn from its whole length."""
    n = max(1, -(-len(text) // SEGMENT) - 1)
    at = np.arange(n) if n <= HELD_CHUNKS else np.sort(rng.choice(n, HELD_CHUNKS, replace=False))
    return [text[k * SEGMENT : k * SEGMENT + LONG] for k in at.tolist()]


def _chunks(texts: list[list[bytes]], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """TRAIN_CHUNKS random chunks of each text, and the places that each has."""
    out = np.zeros((len(texts), TRAIN_CHUNKS, LONG), np.uint8)
    held = np.zeros((len(texts), TRAIN_CHUNKS), np.int64)
    for i, chunks in enumerate(texts):
        for j, k in enumerate(rng.integers(0, len(chunks), TRAIN_CHUNKS).tolist()):
            cut = np.frombuffer(chunks[k], np.uint8)
            out[i, j, : len(cut)] = cut
            held[i, j] = min(max(len(cut), 1), 2 * SEGMENT)
    return out, held


def train(texts: list[list[bytes]], labels: np.ndarray, epochs: int = 12, least_steps: int = 500, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit by Adam on mini-batches of texts given as chunks; gradients pass a max-pool at the position that won."""
    rng = np.random.default_rng(seed)
    values = [rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, FILTERS).astype(np.float32), np.zeros(1, np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    places = 2 * SEGMENT
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // len(texts)))):
        x, held = _chunks(texts, rng)
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            filters, offset, weight, bias = values
            flat = x[rows].reshape(-1, x.shape[2])
            response = filters[0][flat[:, :places]]
            for k in range(1, WIDTH):
                response += filters[k][flat[:, k : places + k]]
            response[np.arange(places) >= held[rows].reshape(-1, 1)] = -1e9
            won = response.argmax(axis=1)
            top = np.take_along_axis(response, won[:, None, :], axis=1)[:, 0] + offset
            live = np.maximum(top, 0).reshape(len(rows), TRAIN_CHUNKS, FILTERS)
            mean = live.mean(axis=1)
            error = (1 / (1 + np.exp(-(mean @ weight + bias[0]))) - labels[rows]) / len(rows)
            back = np.repeat((error[:, None] * weight / TRAIN_CHUNKS)[:, None, :], TRAIN_CHUNKS, axis=1).reshape(-1, FILTERS) * (top > 0)
            grad = np.zeros_like(filters)
            kernel = np.broadcast_to(np.arange(FILTERS), won.shape)
            for k in range(WIDTH):
                byte = np.take_along_axis(flat, won + k, axis=1)
                grad[k] = np.bincount((byte.astype(np.int64) * FILTERS + kernel).ravel(), back.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = [grad, back.sum(axis=0), mean.T @ error + 1e-4 * weight, error.sum(keepdims=True)]
            step += 1
            for v, g, m, s in zip(values, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Network(values[0], values[1], values[2].astype(np.float64), float(values[3][0]))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", train_rows: int = TRAIN_ROWS, seed: int = 5) -> Network:
    """A network for ``column`` of ``labels``, from at most ``2 * train_rows`` documents; the driver holds these only."""
    known = learnable(labels, column)
    odds = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(odds) < 2:
        return Network(*[np.zeros(0)] * 3, 0.0, constant=next((float(k) for k in odds), 0.5))
    ids = bounded_sample(known, odds, train_rows, seed)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # 2 * train_rows ids at most
    sample = sample.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def cut(batches):
        for part in slices(batches):
            for key, label, text in zip(*(c.to_pylist() for c in part.columns)):
                rng = np.random.default_rng([zlib.crc32(str(key).encode()), seed])
                yield pa.RecordBatch.from_arrays([pa.array([key], part.column(0).type), pa.array([label], pa.int32()), pa.array([drawn_chunks((text or "").encode(), rng)], pa.list_(pa.binary()))], ["doc_id", "label", "chunks"])

    rows = sample.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, chunks array<binary>").collect()  # HELD_CHUNKS * LONG bytes a row at most
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], np.float32)
    if len(set(y)) < 2:
        return Network(*[np.zeros(0)] * 3, 0.0, constant=odds[1] / (odds[0] + odds[1]))
    network = train([[bytes(c) for c in r["chunks"]] for r in rows], y, seed=seed)
    network.bias += float(np.log(odds[1] / odds[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return network


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """Add ``score`` to every document."""
    shared = docs.sparkSession.sparkContext.broadcast(network)  # WIDTH * 256 * FILTERS numbers

    def run(batches):
        for part in slices(batches):
            score = shared.value.score(Texts(part.column(part.schema.get_field_index("text"))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], [*part.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def keep_good(docs: DataFrame, network: Network, threshold: float = 0.7) -> DataFrame:
    """The documents whose probability of good quality reaches ``threshold``, with their columns."""
    held = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return scored(held, network).filter(F.col("score") >= threshold).select("row.*")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored(docs, network).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
