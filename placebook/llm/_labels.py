"""Labelled rows that a classifier may learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(doc_id="doc_id"):
    """True for the quarter of ids that no model learns from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) once for each labelled id outside the held-out quarter; where an id has both labels, 1 wins."""
    rows = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out())
    return rows.groupBy("doc_id").agg(F.max(F.col(column)).cast("int").alias("label"))


def bounded_sample(rows: DataFrame, counts: dict[int, int], most_per_label: int, seed: int) -> DataFrame:
    """At most ``most_per_label`` rows of each label, of the least seeded hashes: 2 * most_per_label rows whatever the input.

    ``counts`` has the rows of each label. Only about twice the sample goes into each label's top-k.
    """

    def drawn(label: int) -> DataFrame:
        own = rows.filter(F.col("label") == label).withColumn("_h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)))
        share = min(1.0, 2 * most_per_label / max(counts.get(label, 0), 1))
        return own.filter(F.col("_h") < int(share * (1 << 30))).orderBy("_h", "doc_id").limit(most_per_label).drop("_h")

    return drawn(0).unionByName(drawn(1))
