"""Sharding: a size-tiered store of immutable shards under versioned manifests, with DataFrame operations only.

A store is a folder of Parquet shards and a folder of manifests.  ``append``
writes an arrival as it comes, one small shard for each task and no shuffle;
``append_all`` writes several arrivals out of one reading of a table.
``compact`` puts the live shards into tiers by size (each tier ``FANOUT`` times
the one below).  The lowest tier that holds at least ``FANOUT`` shards below the
target is merged into shards of about the target size, which land in a higher
tier, and so on upwards until no tier is due: the scan itself packs shards of
one tier into tasks of that many bytes, so again nothing is shuffled.  Tiers
wait until they hold enough, and shards at the target size are never rewritten.

A version's manifest has what it adds to and takes from the version before;
every ``BASE_EVERY`` versions the live shards are written out as a base, by a
Spark job, and a version is read as the last base and the manifests since.
Appending and compacting write their shards first, under names of their own, and
then commit the next manifest: one file, written under a unique name and renamed
to the version's name without overwriting.  Of two writers one gets the name;
the other takes the next one, an append always, a merge as long as all shards
that it replaces are still live.  A reader sees a whole version or none, and a
job that dies leaves only files that no manifest lists.  Where a file system
renames in one step (HDFS, local disks) the commit is atomic.

``vacuum`` keeps at least the two newest versions, so that readers of the one
before are not disturbed, and removes the shards that only older versions list.
Shards that no manifest lists may belong to a writer that has yet to commit;
they go only after ``grace_seconds``.

The driver holds the shards that one commit adds or takes away, and to scan a
version the names of its files, as Spark's own listing does; which tier is due
is summed up by Spark.

Defined results: rows are kept as they are, nulls, repeats and clashing names
included; columns must stay the same between arrivals; an empty arrival makes a
version without new shards; rows whose arrival number is null or beyond the
expected ones are arrivals of their own, null the last; reading an empty store
gives no rows.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.llm._store import new_path, table

TARGET_BYTES, FANOUT, GRACE_SECONDS, BASE_EVERY = 128 << 20, 4, 24 * 3600, 16
MANIFEST = "shard string, bytes long, arrival long, tier int"
CHANGES = f"{MANIFEST}, live boolean"


class ConflictError(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    """A store at ``root``, any path that the session's file systems can reach."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, codec: str = "zstd", grace_seconds: float = GRACE_SECONDS):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.fanout, self.codec, self.grace_seconds = target_bytes, fanout, codec, grace_seconds
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version (the newest by default)."""
        version = version if version is not None else max(self.versions(), default=None)
        if version is None:
            return self.spark.createDataFrame([], MANIFEST)
        base = max((v for v in self._bases() if v <= version), default=0)
        since = [v for v in self.versions() if base < v <= version]
        changes = self._changes(since)
        if base:
            whole = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._name(base, 'b')}")
            changes = changes.unionByName(whole.withColumns({"live": F.lit(True), "version": F.lit(base)}))
        last = changes.groupBy("shard").agg(F.max_by(F.struct("bytes", "arrival", "tier", "live"), "version").alias("c"))
        return last.filter("c.live").select("shard", "c.bytes", "c.arrival", "c.tier")

    def _changes(self, versions: list[int]) -> DataFrame:
        """What some versions have added and taken, with their ``version``."""
        if not versions:
            return self.spark.createDataFrame([], f"{CHANGES}, version int")
        found = self.spark.read.schema(CHANGES).parquet(*[f"{self.root}/manifests/{self._name(v)}" for v in versions])
        return found.withColumn("version", F.regexp_extract("_metadata.file_name", r"v(\d+)", 1).cast("int"))

    @staticmethod
    def _name(version: int, kind: str = "v") -> str:
        return f"{kind}{version:08d}.parquet"

    def _listing(self, kind: str) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[1:-8]) for n in names if n.startswith(kind) and n.endswith(".parquet"))

    def versions(self) -> list[int]:
        return self._listing("v")

    def _bases(self) -> list[int]:
        return self._listing("b")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, with ``_metadata`` at hand as for any file."""
        return self._scan([r["shard"] for r in self.manifest(version).select("shard").collect()])

    def _scan(self, shards: list[str]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        # without looking for partition columns in the shards' paths
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(*[f"{self.root}/shards/{s}" for s in shards])

    def _files(self, run: str) -> list[tuple[str, int]]:
        """(name, bytes) of the shards of a run's folder; only a run's first file may be empty, and it is left out then."""
        found = self._fs.listStatus(self._path("shards", run)) if self._fs.exists(self._path("shards", run)) else []
        named = sorted((f"{run}/{s.getPath().getName()}", s.getLen()) for s in found if s.getPath().getName().startswith("part-"))
        return named[1:] if named and self._scan([named[0][0]]).isEmpty() else named

    def _write(self, rows: DataFrame) -> list[tuple[str, int]]:
        """(name, bytes) of the shards that a job has written."""
        run = uuid.uuid4().hex
        rows.write.option("compression", self.codec).parquet(f"{self.root}/shards/{run}")
        return self._files(run)

    def _commit(self, rows: list[tuple], version: int) -> int:
        """Make ``rows`` (CHANGES) version ``version``, or raise ConflictError where that exists."""
        if not self._place(self.spark.createDataFrame(rows, CHANGES), self._name(version)):
            raise ConflictError(f"version {version} has been committed by another writer")
        if version - max(self._bases(), default=0) >= BASE_EVERY:
            self._write_base(version)
        return version

    def _write_base(self, version: int) -> None:
        """Write the live shards of a version out; of two writers one does."""
        self._place(self.manifest(version), self._name(version, "b"))

    def _place(self, rows: DataFrame, name: str) -> bool:
        """Write rows as one file and give it a name that nothing has yet; False if something has."""
        draft = self._path("manifests", f"draft-{uuid.uuid4().hex}")
        rows.coalesce(1).write.parquet(draft.toString())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        part = next(s.getPath() for s in self._fs.listStatus(draft) if s.getPath().getName().startswith("part-"))
        final = self._path("manifests", name)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        without = gateway.new_array(kind, 1)
        without[0] = kind.NONE  # never overwrites
        try:
            files.rename(part, final, without)
        except Exception:
            if self._fs.exists(final):
                return False
            raise
        finally:
            self._fs.delete(draft, True)
        return True

    def tier(self, size: int) -> int:
        """0 for the smallest shards; shards of a tier are within a factor of ``fanout``."""
        return max(0, math.floor(math.log(max(size, 1) / 4096, self.fanout)))

    def _listed(self, files: list[tuple[str, int]], arrival: int | None) -> list[tuple]:
        return [(name, size, arrival, self.tier(size)) for name, size in files]

    def _added(self, new: list[tuple], gone: list[tuple] = ()) -> int:
        """Commit shards that come and go, over what other writers have committed meanwhile; ConflictError where another has taken a shard that goes."""
        changes = [(*row, True) for row in new] + [(*row, False) for row in gone]
        names = [row[0] for row in gone]
        while True:
            base = max(self.versions(), default=0)
            if names and self.manifest(base).filter(F.col("shard").isin(names)).count() < len(names):
                raise ConflictError("another writer has replaced some of the shards")
            try:
                return self._commit(changes, base + 1)
            except ConflictError:
                continue

    def append(self, rows: DataFrame, arrival: int | None = 0) -> int:
        """Add an arrival as small shards and commit; returns the version."""
        return self._added(self._listed(self._write(rows.select(*self.schema.names)), arrival))

    def append_all(self, rows: DataFrame, arrival: Column, arrivals: int, compact: bool = True) -> int:
        """Add arrivals by the whole number ``arrival`` of each row: written in one job, committed one by one, each with what compaction is then due.

        ``arrivals`` of them, 0, 1, ..., are committed even if no row has their number; every other number that rows have is
        an arrival too, and null comes last.
        """
        run = uuid.uuid4().hex
        name = f"_arrival_{run}"
        rows = rows.select(*self.schema.names).withColumn(name, arrival.cast("long"))
        rows.write.option("compression", self.codec).partitionBy(name).parquet(f"{self.root}/shards/{run}")
        folders = {s.getPath().getName().partition("=")[2]: s.getPath().getName() for s in self._fs.listStatus(self._path("shards", run)) if s.isDirectory()}
        found = {int(k) if k.lstrip("-").isdigit() else None: folder for k, folder in folders.items()}
        for k in sorted({*range(arrivals), *found}, key=lambda k: (k is None, k or 0)):
            self._added(self._listed(self._files(f"{run}/{found.get(k, f'{name}={k}')}"), k))
            if compact:
                self.compact()
        return max(self.versions(), default=0)

    def compact(self) -> int:
        """Merge the lowest tier with at least ``fanout`` shards below the target and commit, until no tier is due; returns the newest version."""
        while True:
            small = self.manifest().filter(F.col("bytes") < 0.75 * self.target_bytes)
            due = small.groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= self.fanout).agg(F.min("tier")).first()[0]
            if due is None:
                return max(self.versions(), default=0)
            gone = [tuple(r) for r in small.filter(F.col("tier") == due).collect()]  # the shards of one merge
            top = max((row[2] for row in gone if row[2] is not None), default=None)
            made = self._listed(self._write(self._packed(gone)), top)
            try:
                self._added(made, gone)
            except ConflictError:
                continue  # another merge was faster; what this one wrote is not listed

    def _packed(self, rows: list[tuple]) -> DataFrame:
        """The rows of some shards in tasks of about the target size: as many tasks as whole targets, each of neighbouring shards."""
        tasks = max(1, round(sum(r[1] for r in rows) / self.target_bytes))
        return self._scan([r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]).coalesce(tasks)

    def vacuum(self, keep_versions: int = 2) -> int:
        """Delete shards that only versions before the newest ``keep_versions`` (two at least) list, and old ones that none lists; returns how many."""
        versions = self.versions()
        kept, past = versions[-max(2, keep_versions) :], versions[: -max(2, keep_versions)]
        used = {r["shard"] for v in kept for r in self.manifest(v).select("shard").collect()}
        dead = {r["shard"] for r in self._changes(past).select("shard").distinct().collect()} - used
        if past and kept[0] not in self._bases():
            self._write_base(kept[0])  # the kept versions are read from here on
        bases = [v for v in self._bases() if v < kept[0]] if kept else []
        dead |= {r["shard"] for v in bases for r in self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifests/{self._name(v, 'b')}").select("shard").collect()} - used
        # a version goes before its shards, so that none ever lists a missing one
        for v, kind in [(v, "v") for v in past] + [(v, "b") for v in bases]:
            self._fs.delete(self._path("manifests", self._name(v, kind)), False)
        folder, lost = self._path("shards"), 0
        if not self._fs.exists(folder):
            return 0
        base, old = len(self._fs.makeQualified(folder).toString()) + 1, (time.time() - self.grace_seconds) * 1000
        found = self._fs.listFiles(folder, True)
        while found.hasNext():
            file = found.next()
            name = file.getPath().toString()[base:]
            if name in dead or (name not in used and file.getModificationTime() < old):
                self._fs.delete(file.getPath(), False)
                lost += "part-" in name
        return lost


def sharded(docs: DataFrame, key: str, arrivals: int = 6, root: str | None = None, **options) -> ShardStore:
    """A store of ``docs`` as ``arrivals`` arrivals (by the hash of ``key``), compacted as they come and vacuumed."""
    spark = docs.sparkSession
    store = ShardStore(spark, root or new_path(spark, "store"), docs.schema, **options)
    store.append_all(docs, F.pmod(F.xxhash64(key), F.lit(arrivals)), arrivals)
    store.vacuum()
    return store


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest version of the store gives back: every document, with its text's length and digest."""
    store = sharded(table(spark, sf_dir, "documents"), "doc_id")
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5")
    )


ORACLE = """
select doc_id, lang, source, n_chars, cast(octet_length(encode(text)) as bigint) as n_bytes, md5(text) as text_md5 from documents
"""
