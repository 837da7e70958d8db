"""Time the headline queries and print one JSON line.

The gazetteer has a record for each order (150 000 at scale 0.1), stored with
its index first; every verb then runs against the stored tables.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", scratch).config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.checkpoint.dir", f"{scratch}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from placebook.functions.text import parse_address
    from placebook.geocoder import Geocoder
    from placebook.operators import autocomplete, batch, forward, spatial
    from placebook.plans import derived
    from placebook.plans.queries import QUERIES

    seconds: dict[str, float] = {}

    def timed(name: str, run) -> object:
        began = time.perf_counter()
        out = run()
        seconds[name] = round(time.perf_counter() - began, 3)
        return out

    def count(df) -> int:
        return df.agg(F.count("*"), *(F.max(F.xxhash64(c)) for c in df.columns)).first()[0]

    orders = spark.read.parquet(f"{SF_DIR}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    people = spark.read.parquet(f"{SF_DIR}/customer.parquet").select("c_custkey", "c_nationkey").join(orders, "c_custkey").select(F.col("o_orderkey").alias("c_custkey"), "c_nationkey")
    gaz = spark.sql(derived._SPARK, customer=people, nation=spark.read.parquet(f"{SF_DIR}/nation.parquet"))
    records = gaz.select(F.col("id").alias("rec_id"), parse_address("raw").alias("address"), "lat", "lon")
    geo = timed("build_index", lambda: Geocoder.build(records))
    texts = geo.records.select(F.col("rec_id").alias("qid"), F.col("address.full").alias("q"))
    typos = texts.filter("qid % 150 = 7").select("qid", F.expr("substr(q, 1, 3) || substr(q, 5)").alias("q"))
    misses = texts.filter("qid % 150 = 8").select("qid", F.lit("zzqq flurb").alias("q"))
    points = derived.points(spark, SF_DIR)
    timed("short_prefix_query", lambda: geo.autocomplete("12", 10))
    timed("forward_query", lambda: geo.forward("42 Main Street, Springfield"))
    timed("typo_query", lambda: geo.forward("42 Mian Street, Springfield"))
    timed("reverse_query", lambda: geo.reverse(-89.5, 39.5, 5))
    timed("forward_batch_1000", lambda: count(forward.forward(geo.index, texts.filter("qid % 150 = 9"))))
    timed("typo_batch_1000", lambda: count(forward.forward(geo.index, typos)))
    timed("missing_batch_1000", lambda: count(forward.forward(geo.index, misses)))
    timed("autocomplete_batch_1000", lambda: count(autocomplete.autocomplete(geo.index, texts.filter("qid % 150 = 9"), 5)))
    timed("reverse_join_5", lambda: count(spatial.nearest_join(geo.records, points, 5)))
    timed("batch_summary", lambda: batch.summary(geo.batch_table(typos.unionByName(misses))).collect())
    for name in ("normalize_for_match", "parse_address", "forward_with_fallback", "fuzzy_search", "autocomplete_top", "daily_quota"):
        timed(name, lambda n=name: count(QUERIES[n](spark, SF_DIR)))
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale) if scale.replace(".", "").isdigit() else scale}))
    spark.stop()


if __name__ == "__main__":
    main()
