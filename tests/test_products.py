import os

from pyspark.sql import functions as F

from placebook.operators import forward
from placebook.operators.products import blocks, every, tiles


def size_of(path):
    return sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))


def test_every_member_meets_every_hit(spark):
    """Groups of any size, also around the sizes of runs and arrays; what has no partner gives nothing."""
    sizes = {0: (1, 1), 1: (7, 30), 2: (8, 3), 3: (9, 5000), 4: (255, 2), 5: (263, 1), 6: (1500, 9), 7: (3, 0), 8: (0, 4)}
    members = [(g, 10_000 * g + k, n) for g, (n, _) in sizes.items() for k in range(n)]
    hits = [(g, r, 7 * r) for g, (_, m) in sizes.items() for r in range(1, m + 1)]
    found = every(tiles(spark.createDataFrame(members, "g long, who long, n long"), "g", "who", 100), blocks(spark.createDataFrame(hits, "g long, rank int, rec long"), "g", "rank", 1000), "g", "who")
    got = sorted(tuple(r) for r in found.select("who", "rank", "rec").collect())
    assert got == sorted((10_000 * g + k, r, 7 * r) for g, (n, m) in sizes.items() for k in range(n) for r in range(1, m + 1))


def test_large_results_take_little_disk(spark, tmp_path):
    """F2: 40 queries that 30 000 records each answer are 1.2 million rows, of which a file holds each hit once for a run of queries."""
    index = spark.range(30_000).selectExpr("id as rec_id", "0 as key_ord", "'main st' as key", "concat('main st\\u001f', id) as full_key", "-1 as seen")
    asked = spark.range(40).selectExpr("id * 7 as qid", "'Main Street' as q")
    forward.forward_exact(index, asked).select("qid", "rank", "rec_id").write.parquet(f"{tmp_path}/hits")
    back = spark.read.parquet(f"{tmp_path}/hits")
    order = sorted(range(30_000), key=str)
    assert back.agg(F.count("*"), F.count_distinct("qid", "rank"), F.count_distinct("rank", "rec_id"), F.count_distinct("qid")).first() == (1_200_000, 1_200_000, 30_000, 40)
    assert [r.rec_id for r in back.filter("qid = 7").orderBy("rank").collect()] == order
    assert size_of(f"{tmp_path}/hits") < back.count()


def test_boxes_that_are_alike(spark):
    """40 queries for two boxes and one for another, among 6000 records of which many share a place."""
    from placebook.operators import spatial

    records = spark.range(6000).selectExpr("id as rec_id", "id % 50 / 100D as lon", "id % 7 / 100D as lat")
    boxes = spark.range(41).selectExpr("id as qid", "case when id = 40 then 0.3D when id % 2 = 0 then 0D else 0.05D end as lon1", "0D as lat1", "case when id = 40 then 0.31D else 0.49D end as lon2", "0.1D as lat2")
    want = boxes.join(records, F.expr("lon between lon1 and lon2 and lat between lat1 and lat2")).groupBy("qid").agg(F.count("*").alias("n"), F.sum("rec_id").alias("s"), F.count_distinct("rec_id").alias("d"))
    got = spatial.boxes_join(records, boxes, 0.05).groupBy("qid").agg(F.count("*").alias("n"), F.sum("rec_id").alias("s"), F.count_distinct("rec_id").alias("d"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # all hits of one cell came out of one task
    crowd = spark.range(3000).selectExpr("id as qid", "0.01D as lon1", "0.01D as lat1", "0.04D as lon2", "0.04D as lat2")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = spatial.boxes_join(records, crowd, 0.05).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) > 3 and sum(r["count"] for r in found) == 3000 * records.filter("lon between 0.01 and 0.04 and lat between 0.01 and 0.04").count()
