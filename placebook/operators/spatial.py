"""Reverse geocoding and box search on planar degrees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placebook.operators.products import runs_of, tiles
from placebook.operators.space_tree import SpaceTree, nearest_of
from placebook.sources.staging import staged

LEAF_SIZE = 64  # records of a leaf, about, where that needs no more leaves than LEAVES
LEAVES, SAMPLE = 1 << 16, 200_000
POINTS = 20_000  # points that meet one leaf's records in one task
SALTS = 16  # tasks that the boxes of one cell are dealt over, at most


def squared_distance(lon: Column, lat: Column, x: Column, y: Column) -> Column:
    return (lon - x) * (lon - x) + (lat - y) * (lat - y)


def confidence(d2: Column) -> Column:
    """Falls from 1 at the point to 0 at a tenth of a degree."""
    return F.least(F.greatest(1 - F.sqrt(d2) * 10, F.lit(0.0)), F.lit(1.0))


def nearest(records: DataFrame, lon: float, lat: float, k: int) -> DataFrame:
    """(rank, rec_id, d2, confidence) of the k records nearest to one point, ties to the smaller id; a top-k without a full sort."""
    d2 = squared_distance(F.col("lon"), F.col("lat"), F.lit(float(lon)), F.lit(float(lat)))
    top = records.select("rec_id", d2.alias("d2")).filter(_finite("d2")).orderBy("d2", "rec_id").limit(max(k, 0))
    return top.withColumn("rank", F.row_number().over(Window.orderBy("d2", "rec_id"))).select("rank", "rec_id", "d2", confidence(F.col("d2")).alias("confidence"))


def _finite(*names: str) -> Column:
    """Coordinates that a distance can be told from: neither null nor NaN nor infinite."""
    return F.expr(" and ".join(f"{n} is not null and not isnan({n}) and abs({n}) < double('infinity')" for n in names))


def first_at_places(records: DataFrame, k: int) -> DataFrame:
    """(rec_id, lon, lat) of records with finite places; of those at one place the first k by id, as no others can be among the k nearest to any point."""
    place = Window.partitionBy("lon", "lat").orderBy("rec_id")
    sites = records.select("rec_id", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).filter(_finite("lon", "lat"))
    return sites.withColumn("_p", F.row_number().over(place)).filter(F.col("_p") <= k).drop("_p")


def _sites(records: DataFrame, k: int) -> DataFrame:
    return staged(first_at_places(records, k), "sites")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _tree(sites: DataFrame, leaf_size: int) -> tuple[DataFrame, SpaceTree]:
    """(rec_id, lon, lat, leaf) and the tree of its leaves: cut on at most about SAMPLE places, and at most LEAVES leaves, whatever the records."""
    n = sites.count()
    depth = min(LEAVES.bit_length() - 1, max(0, math.ceil(math.log2(max(n, 1) / leaf_size))))
    drawn = sites.filter(F.pmod(F.xxhash64("rec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(n, 1)))).select("lon", "lat").toArrow()
    tree = SpaceTree.cut_on(drawn["lon"].to_numpy(), drawn["lat"].to_numpy(), depth)

    def run(batches):
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.leaf_of(_column(batch, "lon"), _column(batch, "lat"))))

    dealt = staged(sites.mapInArrow(run, "rec_id long, lon double, lat double, leaf long"), "leaves")
    box = dealt.groupBy("leaf").agg(F.count("*").alias("n"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).toArrow()  # LEAVES rows at most
    return dealt, tree.filled(*(box.column(c).to_numpy() for c in (0, 1)), np.stack([box.column(c).to_numpy() for c in range(2, 6)]))


def near_leaves(points: DataFrame, tree: SpaceTree, k: int) -> DataFrame:
    """(qid, x, y, leaf): the leaves that each point's k nearest may lie in."""
    known = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches):
        for batch in batches:
            point, leaf = known.value.near(_column(batch, "x"), _column(batch, "y"), k)
            for a in range(0, len(point), 1 << 16):
                rows = batch.take(pa.array(point[a : a + (1 << 16)]))
                yield rows.append_column("leaf", pa.array(leaf[a : a + (1 << 16)]))

    return points.mapInArrow(run, "qid long, x double, y double, leaf long")


def nearest_join(records: DataFrame, points: DataFrame, k: int, leaf_size: int = LEAF_SIZE) -> DataFrame:
    """(qid, rank, rec_id, d2, confidence) of the k records nearest to each of many points (qid, lon, lat), ties to the smaller id.

    A k-d tree with a bounded number of leaves is cut on a sample of the records, so that a dense town has many small
    leaves and empty land few. Each point is sent to the leaves that its nearest records may lie in, as told by what the
    leaves hold and their boxes, whether it lies in the town or far from everything. There it meets the leaf's records
    only; a leaf that many points are sent to is dealt over several tasks. Records and points without finite
    coordinates (null, NaN or infinite) take no part.
    """
    spark = records.sparkSession
    schema = "qid long, rank int, rec_id long, d2 double, confidence double"
    sites = _sites(records, max(k, 0))
    if k <= 0 or sites.isEmpty():
        return spark.createDataFrame([], schema)
    dealt, tree = _tree(sites, leaf_size)
    asked = points.select(F.col("qid").cast("long").alias("qid"), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")).filter(_finite("x", "y"))
    sent = staged(near_leaves(asked, tree, k), "sent")
    salts = sent.groupBy("leaf").agg(F.ceil(F.count("*") / POINTS).cast("int").alias("salts"))  # LEAVES rows at most
    held = dealt.join(F.broadcast(salts), "leaf").select("leaf", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("kind"), F.col("rec_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    there = sent.join(F.broadcast(salts), "leaf").select("leaf", F.pmod(F.xxhash64("qid", "x"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"), F.col("qid").alias("id"), "x", "y")

    def run(batches):
        own, places, ids = None, [], None  # of the leaf (and salt) that is read: its records come first
        for batch in batches:
            leaf, salt, kind, key, x, y = (_column(batch, c) for c in ("leaf", "salt", "kind", "id", "x", "y"))
            cuts = np.flatnonzero(np.r_[True, (leaf[1:] != leaf[:-1]) | (salt[1:] != salt[:-1]) | (kind[1:] != kind[:-1])])
            out = []
            for a, b in zip(cuts, np.r_[cuts[1:], len(leaf)]):
                if (leaf[a], salt[a]) != own:
                    own, places, ids = (leaf[a], salt[a]), [], None
                if kind[a] == 0:
                    places.append((x[a:b], y[a:b], key[a:b]))
                    ids = None
                    continue
                if ids is None:
                    lon, lat, ids = (np.concatenate(c) for c in zip(*places))
                row, rec_id, d2 = nearest_of(lon, lat, ids, x[a:b], y[a:b], k)
                out.append((key[a:b][row], rec_id, d2))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["qid", "rec_id", "d2"])

    met = held.unionByName(there).repartition("leaf", "salt").sortWithinPartitions("leaf", "salt", "kind", "id")
    near = met.mapInArrow(run, "qid long, rec_id long, d2 double")
    order = Window.partitionBy("qid").orderBy("d2", "rec_id")
    top = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.select("qid", "rank", "rec_id", "d2", confidence(F.col("d2")).alias("confidence"))


def within_box(records: DataFrame, lon1: float, lat1: float, lon2: float, lat2: float) -> DataFrame:
    """Records inside a box, edges included, corners in any order; the bounds reach the scan."""
    return records.filter(F.col("lon").between(min(lon1, lon2), max(lon1, lon2)) & F.col("lat").between(min(lat1, lat2), max(lat1, lat2)))


def boxes_join(records: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """(qid, rec_id) of records in each of many boxes (qid, lon1, lat1, lon2, lat2), edges included.

    Boxes meet records in grid cells of ``cell`` times a power of two, the least that is as wide as the box; so a box of
    any size lies in four cells at most. Boxes with the same sides meet the records once, with their queries in arrays;
    each hit is written out for a run of queries where it is found, and is not moved. Where there are few cells, their
    boxes are dealt over several tasks.
    """
    held = lambda c: F.least(F.greatest(c, F.lit(-1e12)), F.lit(1e12))
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    sides = boxes.select("qid", low("lon1", "lon2").alias("x1"), high("lon1", "lon2").alias("x2"), low("lat1", "lat2").alias("y1"), high("lat1", "lat2").alias("y2"))
    sides = sides.filter("x1 is not null and x2 is not null and y1 is not null and y2 is not null")
    wide = F.greatest(held(F.col("x2")) - held(F.col("x1")), held(F.col("y2")) - held(F.col("y1")), F.lit(float(cell)))
    sides = staged(sides.withColumn("level", F.ceil(F.log2(wide / cell)).cast("int")), "boxes")
    alike = ["level", "x1", "x2", "y1", "y2"]
    once = staged(sides.groupBy(*alike).agg(F.min("qid").alias("box"), F.count("*").alias("n")), "boxes")
    levels = sorted(r["level"] for r in once.select("level").distinct().collect())  # powers of two between a cell and the world
    asked = tiles(sides.join(once, alike).select("box", "qid", "n"), "box", "qid").select("box", F.posexplode(runs_of("qid")).alias("_nth", "_run"))
    at = lambda c, level: F.floor(held(c) / (F.lit(float(cell)) * F.pow(F.lit(2.0), level)))
    cells = once.withColumn("cx", F.explode(F.sequence(at(F.col("x1"), F.col("level")), at(F.col("x2"), F.col("level")))))
    cells = staged(cells.withColumn("cy", F.explode(F.sequence(at(F.col("y1"), F.col("level")), at(F.col("y2"), F.col("level"))))).drop("n"), "cells")
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = min(SALTS, -(-4 * parts // max(1, cells.select("level", "cx", "cy").distinct().count())))
    there = cells.join(asked, "box").withColumn("salt", F.pmod(F.xxhash64("box", "_nth", "_run"), F.lit(salts)))
    sites = records.select("rec_id", "lon", "lat", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("level"))
    sites = sites.withColumns({"cx": at(F.col("lon"), F.col("level")), "cy": at(F.col("lat"), F.col("level"))}).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<long>")))
    at_cell = ["level", "cx", "cy", "salt"]
    # by number, as what comes in says nothing about how much comes out
    found = there.repartition(2 * parts, *at_cell).join(sites.repartition(2 * parts, *at_cell), at_cell).filter("lon between x1 and x2 and lat between y1 and y2")
    return found.select("rec_id", F.explode("_run").alias("qid")).select("qid", "rec_id")
