"""The verbs over one stored gazetteer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.operators import autocomplete, batch, forward, spatial
from placebook.operators.index import HEAD_LENGTH, HEAD_RECORDS, entries, spread, write_heads, write_sorted
from placebook.schema import EXACT, RESULT
from placebook.sources import loader, store
from placebook.sources.staging import new_path, staged


@dataclass
class Geocoder:
    """Records and their text index, stored; every verb is a DataFrame (qid, results) or a list of results."""

    spark: SparkSession
    records: DataFrame
    index: DataFrame
    heads: DataFrame | None = None

    @staticmethod
    def build(records: DataFrame, path: str | None = None, source: str = "built") -> Geocoder:
        """Store records and index as the newest snapshot under ``path`` (a new folder by default)."""
        spark = records.sparkSession
        path = path or new_path(spark, "geocoder")

        def index(folder: str) -> None:
            kept = spark.read.parquet(f"{folder}/records")
            # written first: dealing by ranges reads its input twice
            keyed = staged(entries(spread(kept)), "entries")
            write_sorted(keyed, f"{folder}/entries")
            write_heads(keyed, kept, f"{folder}/heads")

        store.save(records, path, source, index)
        return Geocoder.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str, number: int | None = None) -> Geocoder:
        """A stored gazetteer with its index: the newest snapshot by default."""
        folder = store.folder(spark, path, number)
        return Geocoder(spark, *(spark.read.parquet(f"{folder}/{name}") for name in ("records", "entries", "heads")))

    @staticmethod
    def from_file(spark: SparkSession, path: str, format: str | None = None) -> Geocoder:
        return Geocoder.build(loader.load(spark, path, format), source=path)

    def __len__(self) -> int:
        return self.records.count()

    def _queries(self, texts: list[str]) -> DataFrame:
        return self.spark.createDataFrame(list(enumerate(texts)), "qid long, q string")

    def _results(self, hits: DataFrame) -> DataFrame:
        """(qid, rank, result) of hits (qid, rank, rec_id, confidence, match_type)."""
        return hits.join(self.records, "rec_id").select("qid", "rank", F.struct("address", "lat", "lon", "confidence", "match_type").cast(RESULT).alias("r"))

    def _listed(self, hits: DataFrame, n: int) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(n)]
        for row in self._results(hits).orderBy("qid", "rank").collect():
            out[row["qid"]].append(row["r"].asDict(recursive=True))
        return out

    def batch(self, texts: list[str]) -> list[list[dict]]:
        return self._listed(forward.forward(self.index, self._queries(texts)), len(texts))

    def batch_table(self, queries: DataFrame, most_results: int | None = None) -> DataFrame:
        return batch.batch(self.records, self.index, queries, most_results)

    def hits(self, text: str) -> DataFrame:
        """The results of one text as rows of results, in order: for texts that many records match, as each matches an empty one."""
        return self._results(forward.forward_one(self.index, text)).orderBy("rank").select("r.*")

    def forward(self, text: str) -> list[dict]:
        """The results of one text as a list; hits() gives any number of them."""
        return self._listed(forward.forward_one(self.index, text), 1)[0]

    def reverse(self, lon: float, lat: float, k: int = 5) -> list[dict]:
        near = spatial.nearest(self.records, lon, lat, k).select(F.lit(0).cast("long").alias("qid"), "rank", "rec_id", "confidence", F.lit(EXACT).alias("match_type"))
        return self._listed(near, 1)[0]

    def autocomplete(self, prefix: str, limit: int = 5, lon: float | None = None, lat: float | None = None) -> list[dict]:
        """The first records by prefix; the bias counts only if both coordinates are given."""
        if lon is None or lat is None:
            qn = forward.normalized_text(self.index, prefix)
            if self.heads is not None and len(qn) <= HEAD_LENGTH and limit <= HEAD_RECORDS:
                listed = self.heads.filter((F.col("prefix") == qn) & (F.col("rank") <= max(limit, 0)))
                result = F.struct("address", "lat", "lon", F.lit(1.0).alias("confidence"), F.lit(EXACT).alias("match_type")).cast(RESULT)
                return [r["r"].asDict(recursive=True) for r in listed.select("rank", result.alias("r")).orderBy("rank").collect()]
            top = forward.hits_of_one(self.index, qn).orderBy("full_key").limit(max(limit, 0))
            hits = top.select(F.lit(0).cast("long").alias("qid"), F.row_number().over(Window.orderBy("full_key")).alias("rank"), "rec_id")
        else:
            asked = self._queries([prefix]).withColumns({"lon": F.lit(float(lon)), "lat": F.lit(float(lat))})
            hits = autocomplete.autocomplete_biased(self.index, self.records, asked, limit)
        return self._listed(hits.withColumns({"confidence": F.lit(1.0), "match_type": F.lit(EXACT)}), 1)[0]

    def within_box(self, lon1: float, lat1: float, lon2: float, lat2: float) -> DataFrame:
        return spatial.within_box(self.records, lon1, lat1, lon2, lat2)
