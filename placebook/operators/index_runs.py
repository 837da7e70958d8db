"""A text index that records are added to and taken from without making it again.

The index is a sorted base and sorted runs beside it, each with the entries of the records that one change has added or
replaced, and with the ids that it has taken away.  Reading merges them: an entry counts unless a later change has taken
its record.  ``compact`` makes one base of all.  Changes are numbered by small files that appear whole and never over
one another; of two writers the later one takes the next number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placebook.operators.index import entries, spread, write_sorted
from placebook.sources.staging import content, named, put_once, staged

CHANGE = "change-"
BASE, DELTA = "base", "run"


class IndexRuns:
    """The index stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _changes(self) -> list[tuple[int, str, str]]:
        """(number, kind, folder) since the newest base, which comes first."""
        found = [(n, *content(self.spark, f"{self.path}/{CHANGE}{n}").split()[:2]) for n in named(self.spark, self.path, CHANGE)]
        last = max((k for k, (_, kind, _) in enumerate(found) if kind == BASE), default=0)
        return found[last:]

    def _commit(self, kind: str, own: str, after: int | None = None) -> bool:
        """Name a change; with ``after``, only if no other has been named since that number."""
        while True:
            last = max(named(self.spark, self.path, CHANGE), default=0)
            if after is not None and last != after:
                return False
            if put_once(self.spark, f"{self.path}/{CHANGE}{last + 1}", f"{kind} {own}"):
                return True

    def _written(self, records: DataFrame | None, gone: DataFrame | None) -> str:
        own = f"{self.path}/{uuid.uuid4().hex}"
        if records is not None:
            write_sorted(staged(entries(spread(records)), "entries"), f"{own}/entries")
        if gone is not None:
            gone.select("rec_id").distinct().write.parquet(f"{own}/gone")
        return own

    def create(self, records: DataFrame) -> None:
        """Start anew from these records."""
        self._commit(BASE, self._written(records, None))

    def put(self, records: DataFrame) -> None:
        """Add records (rec_id, address, ...), or replace those with their ids."""
        records = staged(records.select("rec_id", "address"), "added")
        self._commit(DELTA, self._written(records, records))

    def remove(self, ids: DataFrame) -> None:
        """Take the records of (rec_id) away."""
        self._commit("gone", self._written(None, ids))

    def read(self) -> DataFrame:
        """The entries of all records that are there, as entries() makes them; each entry is read once, with a join on the ids that later changes have taken."""
        changes = self._changes()
        if not changes:
            raise FileNotFoundError(self.path)
        return self._merged(changes)

    def _merged(self, changes: list[tuple[int, str, str]]) -> DataFrame:
        out, taken = None, None
        for number, kind, own in changes:
            if kind != "gone":
                rows = self.spark.read.parquet(f"{own}/entries").withColumn("_change", F.lit(number))
                out = rows if out is None else out.unionByName(rows)
            if kind != BASE:
                ids = self.spark.read.parquet(f"{own}/gone").withColumn("_by", F.lit(number))
                taken = ids if taken is None else taken.unionByName(ids)
        if taken is None:
            return out.drop("_change")
        last = taken.groupBy("rec_id").agg(F.max("_by").alias("_by"))
        return out.join(last, "rec_id", "left").filter("_by is null or _by <= _change").drop("_change", "_by")

    def compact(self) -> bool:
        """Make one base of the base and all runs; False, and nothing changes, if another change has been named meanwhile."""
        changes = self._changes()
        if len(changes) < 2:
            return False
        own = f"{self.path}/{uuid.uuid4().hex}"
        write_sorted(staged(self._merged(changes), "merged"), f"{own}/entries")
        return self._commit(BASE, own, changes[-1][0])
