"""Exact top-k inner-product search by best-first descent of M-trees.

Vectors become integers, ``floor(scale * x)``.  Adding one coordinate that
gives every vector the norm of the longest turns the largest inner product
into the least Euclidean distance: with the bound ``m`` on squared norms,
distance(q, x)**2 = |q|**2 + m - 2 <q, x>.

The forest's top level is a bounded set of pivots (``PIVOTS``, far from each
other, out of a bounded sample): every vector goes to the region of its nearest
pivot, and a region with more than ``TREE_ROWS`` vectors is cut into rings of
distance to the pivot.  Each ring is one tree, built once and written as one
row of pages: a node of more than ``PAGE`` vectors chooses pivots far from each
other and gives every vector to its nearest one.  A node keeps its pivot, its
covering radius and the distance to its parent's pivot, and each leaf page the
distances of its vectors to the page's pivot.

A query first searches the tree that it lies in itself, which gives it a k-th
score, and then only the trees whose ring may hold a vector as near.  Inside a
tree the queries of one task go down together, the node with the least bound
max(0, d(q, pivot) - radius) first.  Before a distance is computed, the triangle
inequality is tried on what is stored: a child whose parent distance differs
from d(q, parent) by more than the k-th distance and its radius is left out
unseen, and so is a vector of a page.  What remains is scored in integers, so
results are exact, ties included.

Of vectors that are equal, the first k + 1 ids can be among some query's best k,
so no more go into the forest, whatever their number.

Defined results: vectors null, empty, or holding null or non-finite components
take no part, nor do rows without an id; equal scores go to the smaller id; a
query skips candidates of its own id; repeated rows count as candidates each;
equal query rows are one query, and an id with several vectors asks with each of
them, ranked from 1 each; vectors of another length than the query's are no
candidates of it; with fewer than k candidates all are returned; components
and scores beyond 64 bits are held at the largest or smallest long; an empty
table gives an empty table.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.llm._store import table, written

PAGE, FANOUT, TREE_ROWS, GROUP, PIVOTS, BINS, SLACK = 128, 16, 20_000, 2048, 256, 1024, 1e-6
LEAST = -(1 << 63)
TREE = ["dim", "region", "ring"]


def quantized(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v) with integer components, without the vectors that take no part."""
    fine = F.expr("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(f"transform(embedding, x -> floor({scale} * cast(x as double)))").alias("v"))


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if not len(a) or (a.min() >= np.iinfo(kind).min and a.max() <= np.iinfo(kind).max):
            return a.astype(kind)
    return a


def lifted(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the coordinate that brings them to one norm."""
    f = v.astype(np.float64)
    return np.column_stack([f, np.sqrt(np.maximum(0.0, norm - (f * f).sum(axis=1)))])


def _far(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - pivot) ** 2).sum(axis=1))


def spread_out(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(indexes of at most ``most`` points, each the one farthest from those before it; the index of each point's nearest one)."""
    nearest, owner, chosen = _far(points, points[0]), np.zeros(len(points), np.int64), [0]
    while len(chosen) < most and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        d = _far(points, points[chosen[-1]])
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], len(chosen) - 1
    return np.array(chosen), owner


@dataclass
class Tree:
    """An M-tree in pages: node n has pivot row ``pivot[n]``, and the nodes ``child[n]`` or the rows ``rows[n]`` below it, as ranges."""

    ints: np.ndarray
    ids: np.ndarray
    row_distance: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    parent_distance: np.ndarray
    child: np.ndarray
    rows: np.ndarray


def build(ints: np.ndarray, ids: np.ndarray, norm: float, page: int = PAGE, fanout: int = FANOUT) -> Tree:
    """An M-tree over the rows of ``ints``; copies of one vector share a page whatever their number."""
    points = lifted(ints, norm)
    nodes: list[list] = [[0, 0.0, 0.0, (0, 0), (0, 0)]]  # pivot, radius, parent distance, children, rows
    members = [np.arange(len(ints))]
    order, distance, at, n = [], [], 0, 0
    while n < len(nodes):
        node, rows = nodes[n], members[n]
        members[n] = None
        far = _far(points[rows], points[node[0]])
        node[1] = float(far.max())
        if len(rows) <= page or node[1] == 0:
            by = np.argsort(far, kind="stable")
            order.append(rows[by])
            distance.append(far[by])
            node[4] = (at, at := at + len(rows))
        else:
            chosen, owner = spread_out(points[rows], fanout)
            node[3] = (len(nodes), len(nodes) + len(chosen))
            for k, c in enumerate(rows[chosen].tolist()):
                nodes.append([c, 0.0, float(_far(points[c][None], points[node[0]])[0]), (0, 0), (0, 0)])
                members.append(rows[owner == k])
        n += 1
    order = np.concatenate(order)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    pivot, radius, parent, child, pages = (np.array(x) for x in zip(*nodes))
    return Tree(_narrow(ints[order]), ids[order], np.concatenate(distance), place[pivot], radius, parent, child, pages)


class _Best:
    """The k best (score, id) of each query, best first, ties to the smaller id, and the distance of the k-th."""

    def __init__(self, n: int, k: int, square: np.ndarray, least: np.ndarray):
        self.score, self.id = np.full((n, k), LEAST), np.full((n, k), np.iinfo(np.int64).max)
        self.square, self.least, self.given = square, least.copy(), least
        self.limit = np.full(n, np.inf)
        self._reach(np.arange(n))

    def _reach(self, who: np.ndarray) -> None:
        some = who[self.least[who] > LEAST]
        self.limit[some] = np.sqrt(np.maximum(0.0, self.square[some] - 2.0 * self.least[some]))

    def take(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Offer rows ``ids`` with ``score`` (query by row) to the queries ``who``."""
        good = (score >= self.least[who][:, None]) & (ids[None, :] != own[:, None])
        some = good.any(axis=1)
        if not some.any():
            return
        who, good, score = who[some], good[some], score[some]
        columns = np.flatnonzero(good.any(axis=0))
        good = good[:, columns]
        k = self.score.shape[1]
        s = np.concatenate([self.score[who], np.where(good, score[:, columns], LEAST)], axis=1)
        i = np.concatenate([self.id[who], np.where(good, ids[columns][None, :], np.iinfo(np.int64).max)], axis=1)
        # ~s falls where s rises, and has no overflow
        order = np.lexsort((i, ~s), axis=-1)[:, :k]
        self.score[who], self.id[who] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
        self.least[who] = np.maximum(self.given[who], self.score[who, -1])
        self._reach(who)


def search(tree: Tree, q: np.ndarray, own: np.ndarray, k: int, norm: float, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, id, score) of the k best rows for each integer query, and how many scores were computed.

    ``least`` has scores that are known to be reached; rows below them are left out.
    """
    n = len(q)
    best = _Best(n, k, (q.astype(np.float64) ** 2).sum(axis=1) + norm, np.full(n, LEAST) if least is None else least)
    # float products are exact below 2**53; beyond, Python's integers are
    peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(tree.ints.astype(np.float64)).max(initial=0))
    fast = peak * q.shape[1] < 2**53
    asked, held = q.astype(np.float64), tree.ints.astype(np.float64)
    exact_q, exact_x = (None, None) if fast else (q.astype(object), tree.ints.astype(object))
    slack = SLACK * (1 + np.sqrt(norm))
    pivots = held[tree.pivot]
    computed = 0

    def near_pivots(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, best.square[who][:, None] - 2 * (asked[who] @ pivots[nodes].T)))

    who = np.arange(n)
    near = near_pivots(who, np.array([0]))[:, 0]
    low = np.maximum(0.0, near - tree.radius[0])
    queue: list[tuple] = [(float(low.min(initial=0)), 0, 0, who, near, low)]
    turn = 0
    while queue:
        _, _, node, who, near, low = heapq.heappop(queue)
        reach = best.limit[who] * (1 + SLACK) + slack
        some = low <= reach
        if not some.any():
            continue
        who, near, reach = who[some], near[some], reach[some]
        a, b = tree.child[node]
        if b > a:
            open_ = np.abs(near[:, None] - tree.parent_distance[None, a:b]) - tree.radius[None, a:b] <= reach[:, None]
            nodes = a + np.flatnonzero(open_.any(axis=0))
            d = near_pivots(who, nodes)
            low = np.maximum(0.0, d - tree.radius[None, nodes])
            open_ = open_[:, nodes - a] & (low <= reach[:, None])
            for c, child in enumerate(nodes.tolist()):
                mine = open_[:, c]
                if mine.any():
                    turn += 1
                    heapq.heappush(queue, (float(low[mine, c].min()), turn, child, who[mine], d[mine, c], low[mine, c]))
            continue
        a, b = tree.rows[node]
        needed = np.abs(near[:, None] - tree.row_distance[None, a:b]) <= reach[:, None]
        rows, asks = a + np.flatnonzero(needed.any(axis=0)), needed.any(axis=1)
        if not len(rows):
            continue
        who = who[asks]
        computed += int(needed.sum())
        if fast:
            score = (asked[who] @ held[rows].T).astype(np.int64)
        else:
            score = np.clip(exact_q[who] @ exact_x[rows].T, LEAST + 1, -(LEAST + 1)).astype(np.int64)
        best.take(who, score, tree.ids[rows], own[who])
    at, place = np.nonzero(best.score > LEAST)
    return at, best.id[at, place], best.score[at, place], computed


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _pivots(vectors: DataFrame, sizes: dict[int, int], norm: float, tree_rows: int, most: int) -> dict[int, np.ndarray]:
    """Lifted pivots by vector length, out of the ``4 * most`` vectors of the least hashes; no length has more than it has trees."""
    total = sum(sizes.values())
    share = min(1.0, 8 * most / max(total, 1))  # about twice the sample goes into the top-k
    drawn = vectors.withColumn("_h", F.pmod(F.xxhash64("v"), F.lit(1 << 30))).filter(F.col("_h") <= int(share * (1 << 30)))
    sample: dict[int, list] = {}
    for r in drawn.orderBy("_h", "vec_id").limit(4 * most).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, rows in sample.items():
        points = lifted(np.array(rows, np.int64), norm)
        out[dim] = points[spread_out(points, min(most, -(-sizes[dim] // tree_rows)))[0]]
    return out


def _region(points: np.ndarray, pivots: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pivot, distance to it) of each point; without pivots 0 and 0."""
    if pivots is None:
        return np.zeros(len(points), np.int32), np.zeros(len(points))
    near = ((pivots * pivots).sum(axis=1) - 2 * points @ pivots.T).argmin(axis=1)
    return near.astype(np.int32), np.sqrt(((points - pivots[near]) ** 2).sum(axis=1))


def _by_dim(batch: pa.RecordBatch, dim: str):
    """(dim, rows) for the vector lengths of a batch."""
    dims = batch.column(batch.schema.get_field_index(dim)).to_numpy()
    for d in np.unique(dims):
        rows = batch.take(pa.array(np.flatnonzero(dims == d)))
        for at in range(0, rows.num_rows, 4096):
            yield int(d), rows.slice(at, 4096)


def forest(candidates: DataFrame, k: int, tree_rows: int = TREE_ROWS, pivots: int = PIVOTS) -> tuple[DataFrame, dict[int, np.ndarray], float]:
    """(trees, pivots by vector length, bound on squared norms): trees are rows (dim, region, ring, lo, hi, n, tree), built once and written."""
    own = candidates.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    first = Window.partitionBy("v").orderBy("vec_id")
    rows = own.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= k + 1)
    vectors = written(rows.select("vec_id", "v", "copies", F.size("v").alias("dim"), F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)").alias("square")), "vectors")
    facts = vectors.groupBy("dim").agg(F.sum("copies").alias("n"), F.max("square").alias("norm")).collect()  # one row for each vector length
    norm = max((r["norm"] for r in facts), default=0.0)
    found = _pivots(vectors, {r["dim"]: r["n"] for r in facts}, norm, tree_rows, pivots)
    unit = max(2 * np.sqrt(norm) / BINS, 1e-300)

    def place(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch, "dim"):
                region, dist = _region(lifted(_matrix(rows.column(1)), norm), found.get(dim))
                bins = (dist / unit).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(region), pa.array(dist), pa.array(bins)], ["vec_id", "v", "copies", "dim", "region", "dist", "bin"])

    kinds = "vec_id long, v array<long>, copies int, dim int, region int, dist double, bin int"
    placed = written(vectors.drop("square").mapInArrow(place, kinds), "placed")
    before = Window.partitionBy("dim", "region").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = placed.groupBy("dim", "region", "bin").agg(F.sum("copies").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    part = "pmod(xxhash64(v, 3), 1048576) / 1048576D"
    dealt = placed.join(bins, ["dim", "region", "bin"]).withColumn("ring", F.expr(f"cast(floor((before + n * {part}) / {tree_rows}) as int)"))

    def grow(key, rows):
        times = rows.column("copies").to_numpy()
        v, ids, dist = np.repeat(_matrix(rows.column("v")), times, axis=0), np.repeat(rows.column("vec_id").to_numpy(), times), rows.column("dist").to_numpy()
        by = np.argsort(ids, kind="stable")
        tree = build(v[by], ids[by], norm)
        dim, region, ring = (x.as_py() for x in key)
        return pa.table(
            {"dim": pa.array([dim], pa.int32()), "region": pa.array([region], pa.int32()), "ring": pa.array([ring], pa.int32()),
             "lo": [float(dist.min())], "hi": [float(dist.max())], "n": [len(ids)], "tree": pa.array([pickle.dumps(tree, 5)], pa.binary())}
        )

    trees = dealt.select(*TREE, "vec_id", "v", "copies", "dist").groupBy(*TREE).applyInArrow(grow, "dim int, region int, ring int, lo double, hi double, n long, tree binary")
    return written(trees, "trees"), found, norm


def _visited(trees: DataFrame, visits: DataFrame, k: int, norm: float, group: int) -> DataFrame:
    """(qkey, query_id, vec_id, score): what each visit (tree, qkey, query_id, q, least) finds; a tree's visits are dealt into groups of about ``group``."""
    per = visits.groupBy(*TREE).agg(F.ceil(F.count("*") / group).cast("int").alias("parts"))
    left = trees.join(per, TREE).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(*TREE, "part", "tree")
    right = visits.join(per, TREE).withColumn("part", F.expr("cast(pmod(xxhash64(qkey, 5), parts) as int)")).select(*(F.col(c).alias(f"at_{c}") for c in (*TREE, "part")), "qkey", "query_id", "q", "least")

    def run(key, held, asked):
        name = ["qkey", "query_id", "vec_id", "score"]
        if not held.num_rows or not asked.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in name})
        tree = pickle.loads(held.column("tree")[0].as_py())
        own = asked.column("query_id").to_numpy()
        at, ids, score, _ = search(tree, _matrix(asked.column("q")), own, k, norm, asked.column("least").to_numpy())
        return pa.table([asked.column("qkey").to_numpy()[at], own[at], ids, score], name)

    keys = [*TREE, "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*(f"at_{c}" for c in keys))).applyInArrow(run, "qkey long, query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, tree_rows: int = TREE_ROWS, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest integer inner products of each query; both inputs are (vec_id, v)."""
    trees, found, norm = forest(candidates, k, tree_rows, pivots)
    rings = trees.select(*TREE, "lo", "hi")
    wide = {(r["dim"], r["region"]): (r["lo"], r["hi"]) for r in rings.groupBy("dim", "region").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}  # pivots at most
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim")).distinct()
    asked = written(asked.withColumn("qkey", F.monotonically_increasing_id()), "queries")

    def home(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch, "dim"):
                q = _matrix(rows.column(1)).astype(np.float64)
                region, dist = _region(np.column_stack([q, np.zeros(len(q))]), found.get(dim))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(region), pa.array(dist)], ["query_id", "q", "dim", "qkey", "region", "d"])

    kinds = "query_id long, q array<long>, dim int, qkey long"
    gap = F.expr("greatest(0D, lo - d, d - hi)")
    homes = asked.mapInArrow(home, f"{kinds}, region int, d double").join(rings, ["dim", "region"])
    homes = homes.groupBy("qkey", "query_id", "q", "dim", "region").agg(F.min_by("ring", F.struct(gap, "ring")).alias("ring"))
    homes = written(homes, "homes")
    seeds = written(_visited(trees, homes.withColumn("least", F.lit(LEAST).cast("long")), k, norm, group), "seeds")
    reached = seeds.groupBy("qkey").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(LEAST)).cast("long").alias("least"))
    again = homes.join(reached, "qkey", "left").select("query_id", "q", "dim", "qkey", F.coalesce("least", F.lit(LEAST).cast("long")).alias("least"), F.col("region").alias("home"), F.col("ring").alias("seen"))

    def reachable(batches):
        """A row for each region that may hold a vector as near as the query's k-th."""
        for batch in batches:
            for dim, rows in _by_dim(batch, "dim"):
                q, least = _matrix(rows.column(1)).astype(np.float64), rows.column(4).to_numpy()
                squares = (q * q).sum(axis=1) + norm
                limit = np.where(least > LEAST, np.sqrt(np.maximum(0.0, squares - 2.0 * least)), np.inf) * (1 + SLACK) + SLACK * (1 + np.sqrt(norm))
                points = np.column_stack([q, np.zeros(len(q))])
                for region in sorted(r for d, r in wide if d == dim):
                    d = _far(points, found[dim][region]) if dim in found else np.zeros(len(q))
                    lo, hi = wide[dim, region]
                    some = np.flatnonzero(np.maximum(lo - d, d - hi) <= limit)
                    part = rows.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(some), region, np.int32)), pa.array(d[some]), pa.array(limit[some])],
                        ["query_id", "q", "dim", "qkey", "least", "home", "seen", "region", "d", "reach"],
                    )

    near = again.mapInArrow(reachable, f"{kinds}, least long, home int, seen int, region int, d double, reach double")
    rest = near.join(rings, ["dim", "region"]).filter(gap <= F.col("reach")).filter("region <> home or ring <> seen")
    more = _visited(trees, rest.select(*TREE, "qkey", "query_id", "q", "least"), k, norm, group)
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id")
    every = seeds.unionByName(more).withColumn("rank", F.row_number().over(order))
    return every.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), q as (
  select distinct vec_id, v from v where vec_id % 100 = 0
), s as (
  select q.vec_id as query_id, q.v as qv, c.vec_id as vec_id,
    cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v)
)
select query_id, cast(row_number() over (partition by query_id, qv order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 10
"""
