"""Near-duplicates by SimHash: pigeonhole blocks, a join on blocks, and verified Hamming distances.

A document's fingerprint has the majority bits of its shingles' hashes.  Equal
fingerprints are one vertex.  Fingerprints are cut into ``BLOCKS`` blocks of
bits; two that differ in at most two bits differ in at most two blocks, so they
agree in all the others.  Each fingerprint is therefore dealt, for every choice
of the blocks that may differ, by the value of the blocks that remain, and
fingerprints which meet there are joined and their distance is verified.

Where more than ``crowd`` fingerprints meet, pairs would grow with the square of
their number.  Members of such places are dealt by one-bit neighbours instead:
two fingerprints are within two bits exactly if some value is within one bit of
both, and at most 65 fingerprints are within one bit of a value.  Each value
links what meets there to the least of them.  So no link is lost and no group
is larger than ``crowd`` or 65, whatever the corpus holds.

Defined results: a null or empty text, or one without words, has fingerprint
zero and is linked like any other; fewer words than a shingle are one shingle of
all of them; repeated rows are documents of their own in one component; a null
doc_id takes part and is returned as null, and a component of such rows only has
a null id; very long texts are read whole; an empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm._store import table, written
from placebook.llm._words import Texts, lowered, slices
from placebook.llm._xxh64 import xxh64
from placebook.llm.near_copies import components

WIDTH, SEED, DISTANCE = 3, 42, 2
BLOCKS, CROWD = 4, 64
STEP = 1 << 16  # shingles counted at once

#: a byte's eight bits in the eight bytes of a word
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") * np.uint8(1)).view("<u8").ravel()


def _shingles(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last word) of every shingle; a text of fewer words is one shingle."""
    text, n = texts.spans[2], texts.n_words
    words = np.arange(len(text))
    begins = np.cumsum(n) - n  # of each text
    last = np.minimum(words + width, (begins + n)[text]) - 1
    keep = (last - words == width - 1) | ((words == begins[text]) & (n[text] < width))
    return words[keep], last[keep]


def _majority(h: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes; ``text`` ascends."""
    count = np.bincount(text, minlength=n_texts)
    sums = np.zeros((n_texts, 64), np.int64)
    for a in range(0, len(h), STEP):
        own, of = h[a : a + STEP], text[a : a + STEP]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        # runs of at most 255 hashes of one text: their sums fit a byte for each bit
        ends = np.r_[starts[1:], len(of)]
        runs = np.concatenate([np.arange(s, e, 255) for s, e in zip(starts, ends)])
        lanes = np.add.reduceat(_LANES[own.astype("<u8").view(np.uint8).reshape(-1, 8)], runs, axis=0)
        np.add.at(sums, of[runs], lanes.view(np.uint8).reshape(-1, 64))
    bits = 2 * sums > count[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of every row's text, as a signed long."""

    def run(batches):
        for part in slices(batches):
            texts = lowered(Texts(part.column(1)))
            fp = np.zeros(part.num_rows, np.uint64)
            if len(texts.spans[0]):
                data, start, end = texts.joined
                first, last = _shingles(texts, width)
                h = np.empty(len(first), np.uint64)
                for a in range(0, len(first), STEP):
                    b = a + STEP
                    h[a:b] = xxh64(data, start[first[a:b]], end[last[a:b]], seed)
                fp = _majority(h, texts.spans[2][first], part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _masks(blocks: int, distance: int) -> list[int]:
    """Bits (as signed longs) of the blocks that agree, for every choice of ``distance`` blocks that may differ."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    bits = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(bits[k] for k in kept) for kept in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(values: DataFrame, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) of the distinct ``fp`` of ``values`` that connect whatever is within two bits; every edge is such a pair or has a common neighbour."""
    masks = _masks(blocks, DISTANCE)
    places = F.array(*(F.struct(F.lit(k).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for k, m in enumerate(masks)))
    dealt = values.select("fp", F.inline(places))
    met = dealt.groupBy("way", "block").agg(F.count("*").alias("n")).filter("n > 1")
    dealt = written(dealt.join(met, ["way", "block"]), "blocks")
    few = dealt.filter(F.col("n") <= crowd).drop("n")
    other = few.withColumnRenamed("fp", "b")
    pairs = few.join(other, ["way", "block"]).where(F.expr(f"fp < b and bit_count(fp ^ b) <= {DISTANCE}")).select(F.col("fp").alias("a"), "b")
    many = dealt.filter(F.col("n") > crowd).select("fp").distinct()
    near = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), k -> fp ^ shiftleft(1L, k)))")).alias("value"))
    groups = near.groupBy("value").agg(F.collect_list("fp").alias("fps")).filter("size(fps) > 1")  # 65 at most
    stars = groups.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the least doc_id that links reach."""
    rows = written(fingerprints(docs, width, seed), "fingerprints")
    values = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "values")
    roots = components(linked(values.select("fp"), blocks, crowd))
    rooted = values.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = written(rooted.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(told, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
