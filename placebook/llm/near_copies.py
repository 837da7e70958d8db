"""N-gram Jaccard self-join: MinHash LSH forest with exact verification.

Documents are sets of word shingles (five words; a shorter document is one
shingle of all its words).  Documents with the same set form a *class*, and
only classes are compared.

A forest of ``trees`` prefix tries holds the classes' signatures: in each tree
a class is a path of minimum hashes, and classes with a common prefix are the
members of a trie node.  Prefixes start at ``deepest`` values.  All are shortened
until a pair at the threshold shares one in some tree with at least the
probability ``recall``; that length is the longest that any class may keep.
From there each prefix is shortened further, down to ``shallowest`` values, as
long as its node has at most ``crowd`` members: where few documents are alike
the search is wider than the target asks, and common passages, which bring many
documents under one node, are told apart by longer prefixes.  A node's length
follows from its own members, so all of them share it, and each class is a
member of one node in each tree.  Every candidate pair is then verified exactly
on the shingle sets.

No pair is ever a row.  A large node's members are dealt into blocks by the size
of their sets, and tasks compare block with block, as far as sizes allow the
threshold at all, giving for each class the number of its links and, for the
groups, a spanning link.  A pair that shares nodes in several trees counts in
the first one only, and a member is sent to a tree only if it has a partner
there that no earlier tree has shown it.

Defined results: a null or empty text has no shingles, hence no links, and is
a group of its own; repeated rows are documents of their own and link to each
other; a null doc_id takes part under an id of its content and is returned as
null, a doc_id that is no number under a hash of it; very long texts are read whole; an empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.llm._groups import column, whole_groups
from placebook.llm._store import table, written
from placebook.llm._words import Texts, mix, slices

WIDTH, THRESHOLD = 5, 0.8
TREES, DEEPEST, SHALLOWEST, RECALL, CROWD = 18, 8, 4, 0.995, 32
BLOCK = 256

_SEED = np.random.default_rng(20240229).integers(1, 1 << 63, size=64 * 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_depth(threshold: float, trees: int, deepest: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall`` at least."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(texts: Texts, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, bounds of each text's part)."""
    at, h = texts.windows(width)
    text = texts.spans[2][at]
    short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < width))
    if len(short):  # one shingle of all the words
        first = np.searchsorted(texts.spans[2], short)
        whole = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            more = texts.n_words[short] > j
            whole[more] = whole[more] * np.uint64(0x9FB21C651E98DF25) + texts.word_hash[first[more] + j]
        h = np.concatenate([h, mix(whole)])
        text = np.concatenate([text, short])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(texts.n + 1))


def prefixes(h: np.ndarray, bounds: np.ndarray, trees: int, depth: int, shallowest: int = 1) -> np.ndarray:
    """Keys of the prefixes of each non-empty set, from ``shallowest`` to ``depth`` values long, tree by tree: rows are sets."""
    starts = bounds[:-1]
    keys = np.zeros((len(starts), trees, depth - shallowest + 1), np.uint64)
    for tree in range(trees):
        key = np.full(len(starts), tree + 1, np.uint64)
        for level in range(depth):
            least = np.minimum.reduceat(h * _SEED[tree * 16 + level], starts)
            key = mix(key ^ mix(least))
            if level + 1 >= shallowest:
                keys[:, tree, level + 1 - shallowest] = key
    return keys.reshape(len(starts), -1)


def _class_ids(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set, from all its shingles and their number."""
    n = (bounds[1:] - bounds[:-1]).astype(np.uint64)
    return mix(np.add.reduceat(mix(h), bounds[:-1]) ^ mix(n)).astype(np.int64)


def _sets(column_: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(indexes of texts with shingles, their hashes, their bounds)."""
    h, bounds = shingles(Texts(column_), width)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    return some, h, np.append(bounds[some], len(h))


def classes_of(docs: DataFrame, width: int = WIDTH, trees: int = TREES, depth: int = DEEPEST, shallowest: int = 1) -> DataFrame:
    """(doc_id, jid, h, cls, size, keys) of every row; the last three are null without shingles. jid and h find the row's text again."""
    per_row = trees * (depth - shallowest + 1)

    def run(batches):
        for part in slices(batches):
            some, h, bounds = _sets(part.column(3), width)
            cls, size = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            none = np.ones(part.num_rows, bool)
            none[some] = False
            lists = np.full(part.num_rows + 1, 0, np.int32)
            flat = np.zeros(0, np.int64)
            if len(some):
                cls[some] = _class_ids(h, bounds)
                size[some] = np.diff(bounds)
                first, back = np.unique(cls[some], return_index=True, return_inverse=True)[1:]
                own = np.concatenate([h[bounds[k] : bounds[k + 1]] for k in first])  # signatures once for each set in this piece
                ends = np.concatenate([[0], np.cumsum(size[some][first])])
                flat = prefixes(own, ends, trees, depth, shallowest)[back].astype(np.int64).ravel()
            lists[1:] = np.cumsum(~none) * per_row
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:3], pa.array(cls, mask=none), pa.array(size, mask=none), pa.ListArray.from_arrays(pa.array(lists), pa.array(flat))],
                ["doc_id", "jid", "h", "cls", "size", "keys"],
            )

    keyed = docs.select("doc_id", *_row_key(docs), "text")
    return keyed.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, jid long, h long, cls long, size long, keys array<long>")


def _row_key(docs: DataFrame):
    """Join keys of a row's text: its id (a hash of it where it is no number, of its content where it is null) and its content."""
    h = F.xxhash64("text")
    number = F.col("doc_id").cast("long") if dict(docs.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint") else F.col("doc_id").try_cast("long")
    return F.coalesce(number, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")), h).alias("jid"), h.alias("h")


def nodes_of(reps: DataFrame, trees: int, levels: int, crowd: int) -> DataFrame:
    """(cls, tree, level, key, n): the node of each class in each tree where that node has n > 1 members.

    ``reps`` are (cls, keys). From the shortest prefix on, a node with more than ``crowd`` members gives way to its children.
    """
    path = f"transform(sequence(0, {trees - 1}), t -> struct(t as tree, slice(keys, t * {levels} + 1, {levels}) as path))"
    left = reps.select("cls", F.expr(f"inline({path})"))
    found: list[DataFrame] = []
    for level in range(levels):
        keyed = left.withColumn("key", F.col("path")[level])
        held = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        members = written(keyed.join(held, "key").select("cls", "tree", F.lit(level).alias("level"), "key", "n", "path"), "nodes")
        last = level == levels - 1
        found.append((members if last else members.filter(F.col("n") <= crowd)).drop("path"))
        left = members.filter(F.col("n") > crowd).select("cls", "tree", "path")
        if not last and left.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _matrix(found: pa.Table, name: str) -> np.ndarray:
    lists = found.column(name).combine_chunks()
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _unseen(keys: np.ndarray, tree: int, block: np.ndarray, across: bool) -> np.ndarray:
    """Pairs (upper triangle) of a group that no earlier tree holds; across: of rows of different blocks only."""
    n = len(keys)
    pairs = np.triu(np.ones((n, n), bool), 1)
    if across:
        pairs &= block[:, None] != block[None, :]
    for t in range(tree):
        k = keys[:, t]
        pairs &= k[:, None] != k[None, :]
    return pairs


def _blocked(members: DataFrame, block: int, threshold: float) -> DataFrame:
    """Give each row to every pair (i, j) of blocks that it takes part in.

    A node of at most ``block`` members is one block. Of larger ones the members are dealt by size first: steps of
    1 / threshold, of which only neighbours can reach the threshold, and each step into blocks.
    """
    few = members.filter(F.col("n") <= block).withColumns({c: F.lit(0).cast("long") for c in ("block", "i", "j")}).drop("size")
    step = F.floor(F.log(F.col("size").cast("double")) / math.log(1 / threshold)) if threshold < 1 else F.col("size")
    many = members.filter(F.col("n") > block).withColumn("step", step.cast("long"))
    held = many.groupBy("key", "step").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    blocks = held.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("step", "blocks"))).alias("blocks"))  # a step for each power of 1 / threshold
    dealt = many.join(blocks, "key").withColumn("block", F.expr("step * 1048576 + pmod(xxhash64(cls, 3), blocks[step])"))
    reach = [f"coalesce(transform(sequence(0L, try_element_at(blocks, step + {d}) - 1), b -> (step + {d}) * 1048576 + b), array())" for d in (-1, 0, 1)]
    each = dealt.withColumn("other", F.explode(F.expr(f"concat({', '.join(reach)})"))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    return few.unionByName(each.drop("size", "step", "blocks", "other"))


GROUP = ["key", "i", "j"]


def _needed(members: DataFrame, block: int, threshold: float) -> DataFrame:
    """The rows of ``members`` in blocks, without those whose partners there have all met in an earlier tree."""

    def run(batches):
        for found, cuts in whole_groups(batches, GROUP):
            keys, tree = _matrix(found, "keys"), column(found, "tree")
            i, j, own = column(found, "i"), column(found, "j"), column(found, "block")
            keep = np.zeros(found.num_rows, bool)
            size = np.diff(cuts)
            two = cuts[:-1][(size == 2) & (i[cuts[:-1]] == j[cuts[:-1]])]
            if len(two):
                same = keys[two] == keys[two + 1]
                early = same & (np.arange(keys.shape[1])[None, :] < tree[two][:, None])
                new = ~early.any(axis=1)
                keep[two[new]] = keep[two[new] + 1] = True
            rest = (size > 2) | ((size == 2) & (i[cuts[:-1]] != j[cuts[:-1]]))
            for a, n in zip(cuts[:-1][rest], size[rest]):
                pairs = _unseen(keys[a : a + n], tree[a], own[a : a + n], i[a] != j[a])
                keep[a : a + n] = pairs.any(axis=0) | pairs.any(axis=1)
            yield from found.filter(pa.array(keep)).select(["cls", "key", "i", "j", "tree", "block"]).to_batches()

    rows = _blocked(members, block, threshold).select("cls", "key", "i", "j", F.col("tree").cast("int").alias("tree"), "block", "keys")
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, "cls long, key long, i long, j long, tree int, block long")


def _overlaps(parts: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of a bounded group, by blocks of shared shingles."""
    n = len(parts)
    rows = np.repeat(np.arange(n), [len(p) for p in parts])
    _, code, df = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = df[code] > 1
    rows, code = rows[shared], code[shared]
    code = np.unique(code, return_inverse=True)[1]
    inter = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    width = max(64, (1 << 22) // max(n, 1))
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [a, a + width])
        dense = np.zeros((n, width), np.float32)
        dense[rows[lo:hi], code[lo:hi] - a] = 1
        inter += dense @ dense.T
    return inter


def _linked(parts: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """The pairs whose exact Jaccard similarity reaches the threshold."""
    size = np.array([len(p) for p in parts], np.float64)
    pairs = pairs & (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9)
    if pairs.sum() <= 64:
        out = np.zeros_like(pairs)
        for a, b in zip(*np.nonzero(pairs)):
            both = len(np.intersect1d(parts[a], parts[b], assume_unique=True))
            out[a, b] = both >= threshold * (size[a] + size[b] - both) - 1e-9
        return out
    inter = _overlaps(parts).astype(np.float64)
    return pairs & (inter >= threshold * (size[:, None] + size[None, :] - inter) - 1e-9)


def _roots(links: np.ndarray) -> np.ndarray:
    """For each row of a bounded group the first row that links connect it with."""
    n = len(links)
    root = np.arange(n)
    both = links | links.T
    for a in range(n):
        if root[a] != a:
            continue
        front = [a]
        while front:
            x = front.pop()
            near = np.flatnonzero(both[x])
            new = near[root[near] > a]
            root[new] = a
            front.extend(new.tolist())
    return root


def links_of(docs: DataFrame, classes: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK, trees: int = TREES, levels: int = 1, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Verified links as rows (cls, links, to), the documents that a class links to as one block task counts them and a class of its group; and the classes."""
    reps = classes.filter("cls is not null").groupBy("cls").agg(
        F.min(F.struct("jid", "h", "size", "keys")).alias("rep"), F.count("*").alias("copies")
    )
    reps = written(reps.select("cls", "copies", "rep.jid", "rep.h", "rep.size", "rep.keys"), "classes")
    nodes = nodes_of(reps.select("cls", "keys"), trees, levels, crowd)
    # the key of each tree's node; where a class has no partner, one that no other class has
    own = nodes.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("m"))
    own = own.select("cls", F.expr(f"transform(sequence(0, {trees - 1}), t -> coalesce(try_element_at(m, t), xxhash64(cls, t)))").alias("keys"))
    partnered = written(reps.drop("keys").join(own, "cls"), "partnered")
    members = nodes.join(partnered.select("cls", "size", "keys"), "cls")
    needed = written(_needed(members, block, threshold), "candidates")
    tasks = needed.groupBy("cls").agg(F.collect_list(F.struct("key", "i", "j", "tree", "block")).alias("tasks"))
    wanted = partnered.join(tasks, "cls").select("cls", "copies", "jid", "h", "keys", "tasks")
    # one row for each id and text, however often it is repeated; the join finds it dealt by the same keys
    texts = docs.select(*_row_key(docs), "text").groupBy("jid", "h").agg(F.first("text").alias("text"))
    sent = texts.join(wanted.hint("merge"), ["jid", "h"]).select("cls", "copies", "keys", "tasks", "text")

    def give(batches):
        for part in slices(batches):
            some, h, bounds = _sets(part.column(4), width)
            packed = pa.array([h[bounds[k] : bounds[k + 1]].tobytes() for k in range(len(some))], pa.large_binary())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(some)) for c in part.columns[:4]), packed.cast(pa.binary())], ["cls", "copies", "keys", "tasks", "sh"])

    kinds = "cls long, copies long, keys array<long>, tasks array<struct<key:long,i:long,j:long,tree:int,block:long>>, sh binary"
    dealt = sent.mapInArrow(give, kinds).select("cls", "copies", "keys", "sh", F.inline("tasks"))

    def verify(batches):
        for found, cuts in whole_groups(batches, GROUP):
            cls, copies, tree = column(found, "cls"), column(found, "copies"), column(found, "tree")
            i, j, own = column(found, "i"), column(found, "j"), column(found, "block")
            keys, sets = _matrix(found, "keys"), found.column("sh")
            out = [[], [], []]
            for a, b in zip(cuts[:-1], cuts[1:]):
                at = np.arange(a, b)
                if len(at) < 2:
                    continue
                parts = [np.frombuffer(sets[int(x)].as_py(), np.uint64) for x in at]
                links = _linked(parts, _unseen(keys[at], tree[a], own[at], i[a] != j[a]), threshold)
                both = links | links.T
                some = np.flatnonzero(both.any(axis=1))
                root = _roots(links)
                out[0].extend(cls[at[some]].tolist())
                out[1].extend((both[some] @ copies[at]).tolist())
                out[2].extend(cls[at[root[some]]].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["cls", "links", "to"])

    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(verify, "cls long, links long, to long"), reps


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that each vertex of the undirected edges (a, b) connects with.

    Labels fall to the least neighbour's and then jump to their label's label, so the rounds grow with the
    logarithm of the longest chain; each round is written, and no edge reaches the driver.
    """
    both = written(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("near"))
        low = labels.join(near, labels.v == near.a).select("v", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        low = written(low, "labels")
        jump = low.select(F.col("v").alias("low"), F.col("low").alias("root"))
        moved = written(low.join(jump, "low").select("v", "root", (F.col("root") != F.col("was")).alias("changed")), "labels")
        labels = moved.select("v", "root")
        if moved.filter("changed").isEmpty():
            return labels


def grouped(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, shallowest: int = SHALLOWEST, recall: float = RECALL, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """(doc_id, jid, h, root, class_id, n_links) of every row.

    ``root`` names the group that links connect, by sets of shingles and not by ids, and is null without shingles.
    class_id is the least id in the group, n_links the number of other documents within the threshold.
    """
    depth = prefix_depth(threshold, trees, deepest, recall)
    shallowest = min(shallowest, depth)
    rows = written(classes_of(docs, width, trees, depth, shallowest), "rows")
    links, reps = links_of(docs, rows, width, threshold, block, trees, depth - shallowest + 1, crowd)
    links = written(links, "links")
    roots = components(links.select(F.col("cls").alias("a"), F.col("to").alias("b")))
    counts = links.groupBy("cls").agg(F.sum("links").alias("links"))
    found = (
        reps.select("cls", "copies", "jid")
        .join(counts, "cls", "left")
        .join(roots.withColumnRenamed("v", "cls"), "cls", "left")
        .filter("copies > 1 or links is not null")
        .select("cls", F.coalesce("root", "cls").alias("root"), "jid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    found = written(found, "members")
    ids = found.groupBy("root").agg(F.min("jid").alias("class_id"))
    told = found.join(ids, "root").select("cls", "root", "class_id", "n_links")
    return (
        rows.select("doc_id", "jid", "h", "cls")
        .join(told, "cls", "left")
        .select("doc_id", "jid", "h", F.coalesce("root", "cls").alias("root"), F.coalesce("class_id", "jid").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, jid, h, class_id, n_links) of every row, as grouped() has them."""
    return grouped(docs, **options).drop("root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near copies, with its columns: the one of the least id. Rows without words are groups of their own and stay, each of them."""
    found = grouped(docs, **options).filter("root is not null")
    first = found.groupBy("root").agg(F.min(F.struct("jid", "h")).alias("k")).select("k.jid", "k.h")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.filter(worded).withColumns(dict(zip(("_jid", "_h"), _row_key(docs))))
    once = keyed.groupBy("_jid", "_h").agg(F.first(F.struct(*docs.columns)).alias("row"))
    kept = once.join(first.hint("merge"), (F.col("_jid") == first.jid) & (F.col("_h") == first.h), "left_semi").select("row.*")
    return kept.unionByName(docs.filter(~worded))


def op2_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
