"""Batch geocoding: results, status and summary of many queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.operators.forward import looked_up, of_texts
from placebook.schema import ERROR, MATCHED, NO_MATCH, RESULT


def batch(records: DataFrame, index: DataFrame, queries: DataFrame, most_results: int | None = None) -> DataFrame:
    """(qid, q, results, status) of every query: its results in order, at most ``most_results`` (0: none match); no others are looked for."""
    asked, texts = looked_up(queries)
    result = F.struct("address", "lat", "lon", "confidence", "match_type").cast(RESULT)
    rows = of_texts(index, texts, most_results).join(records, "rec_id").select("tid", F.struct("rank", result.alias("r")).alias("h"))
    lists = rows.groupBy("tid").agg(F.array_sort(F.collect_list("h")).alias("h"))
    found = asked.join(lists, "tid", "left").withColumn("results", F.coalesce(F.col("h.r"), F.array().cast(f"array<{RESULT}>")))
    return found.select("qid", "q", "results", F.when(F.size("results") > 0, MATCHED).otherwise(NO_MATCH).alias("status"))


def summary(results: DataFrame) -> DataFrame:
    """One row (total, matched, no_match, errors, avg_confidence); the average is over the first results of matched queries."""
    first = F.get(F.col("results"), F.lit(0))["confidence"]
    matched = F.count_if(F.col("status") == MATCHED)
    return results.agg(
        F.count("*").alias("total"), matched.alias("matched"), F.count_if(F.col("status") == NO_MATCH).alias("no_match"), F.count_if(F.col("status") == ERROR).alias("errors"),
        F.when(matched > 0, F.coalesce(F.sum(first), F.lit(0.0)) / matched).otherwise(0.0).alias("avg_confidence"),
    )


def fraction(completed: int, total: int) -> float:
    """Progress of a batch; an empty one is complete."""
    return completed / total if total else 1.0


def progress(spark, group: str, total_tasks: int | None = None) -> float:
    """Progress of the Spark jobs of a job group, from the status tracker."""
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(j)) for s in info.stageIds]
    known = [s for s in stages if s]
    return fraction(sum(s.numCompletedTasks for s in known), total_tasks or sum(s.numTasks for s in known))


def as_json(results: DataFrame) -> DataFrame:
    """(qid, body): a query's results as a service returns them, null parts included."""
    return results.select("qid", F.to_json(F.struct("results"), {"ignoreNullFields": "false"}).alias("body"))
