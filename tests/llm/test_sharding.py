import pytest
from pyspark.sql import functions as F

from placebook.llm import sharding
from placebook.llm.sharding import ConflictError, ShardStore, op1_sharding, sharded


@pytest.fixture()
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_arrivals_and_cascading_compaction(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), docs.schema, target_bytes=400_000, fanout=4)
    cut, rows = docs.repartition(4), docs.count()
    merges = []
    for k in range(5):
        store.append(cut.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == k), k)
        before = {r.shard: r for r in store.manifest().collect()}
        version = store.versions()[-1]
        store.compact()
        after = {r.shard: r for r in store.manifest().collect()}
        made = [r for r in after.values() if r.shard not in before]
        if made:
            merges.append((min(before[x].tier for x in before if x not in after), max(r.tier for r in made)))
        tiers = [r.tier for r in after.values() if r.bytes < 0.75 * store.target_bytes]
        assert max(map(tiers.count, tiers), default=0) < store.fanout
        assert store.read(version).count() == store.read().count()
    # merged shards have been merged again
    assert len(merges) >= 2 and all(high > low for low, high in merges) and max(high for _, high in merges) > merges[0][1]
    assert same(store.read(), docs) and store.read().count() == rows
    whole = {r.shard for r in store.manifest().collect()}
    assert store.vacuum() >= 16 and same(store.read(), docs) and len(store.versions()) == 2 and store.read(store.versions()[0]).count() == rows
    assert {r.shard for r in store.manifest().collect()} == whole


def test_one_reading_gives_all_arrivals(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), docs.schema)
    assert store.append_all(docs, F.pmod("doc_id", F.lit(3)), 4, compact=False) == 4
    for version in (1, 2, 3):
        assert same(store.read(version), docs.filter(F.pmod("doc_id", F.lit(3)) < version))
    assert same(store.read(4), docs) and store.read().columns == docs.columns


def test_writers_conflict_and_leave_the_store_whole(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), docs.schema)
    store.append(docs.limit(10))
    with pytest.raises(ConflictError):
        store._commit([], 1)
    assert store.versions() == [1] and store.read().count() == 10
    assert sorted(p.name for p in (tmp_path / "s/manifests").iterdir() if p.name[0] != ".") == ["v00000001.parquet"]


def test_vacuum_spares_a_writer_that_has_yet_to_commit(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), docs.schema)
    for _ in range(4):
        store.append(docs.limit(5).coalesce(1))
    other = ShardStore(spark, str(tmp_path / "s"), docs.schema)
    waiting = other._write(docs.limit(7))
    store.compact()
    assert store.vacuum(keep_versions=1) == 0  # the version before the merge still lists its shards
    store.append(docs.limit(1))
    assert store.vacuum() == 4  # now only the merged shards' readers are left
    assert other._added(other._listed(waiting, 9)) == store.versions()[-1]
    assert store.read().count() == 28


def test_no_arrival_is_lost(spark, tmp_path):
    """Null arrival numbers, and numbers that nobody expected, are arrivals like others."""
    rows = spark.range(100).selectExpr("id as doc_id", "if(id < 20, null, if(id < 50, 7L, if(id < 55, -3L, id % 3))) as a")
    store = ShardStore(spark, str(tmp_path / "s"), rows.schema)
    store.append_all(rows, F.col("a"), 3, compact=False)
    assert same(store.read(), rows) and len(store.versions()) == 6
    assert {r.arrival for r in store.manifest().collect()} == {0, 1, 2, 7, -3, None}
    store.compact()
    late = ShardStore(spark, str(tmp_path / "s"), rows.schema, grace_seconds=-5)
    late.vacuum()
    assert same(late.read(), rows)


def test_versions_are_read_from_bases_and_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BASE_EVERY", 3)
    rows = spark.range(8).toDF("doc_id")
    store = ShardStore(spark, str(tmp_path / "s"), rows.schema, fanout=4)
    for k in range(8):
        store.append(rows.filter(F.col("doc_id") == k).coalesce(1), k)
    assert store._bases() == [3, 6]
    for v in range(1, 9):
        assert store.read(v).count() == v
    # a manifest has what its version changes, not all that is live
    assert spark.read.parquet(str(tmp_path / "s/manifests/v00000008.parquet")).count() == 1
    store.compact()
    assert store.read().count() == 8 and store.manifest().count() < 8 and store.read(8).count() == 8
    store.vacuum()
    assert [store.read(v).count() for v in store.versions()] == [8, 8] and min(store._bases()) == store.versions()[0]


def test_writers_that_meet_all_finish(spark, tmp_path):
    """Appends and a long merge commit over each other's versions; of two merges of the same shards one is given up."""
    rows = spark.range(6).toDF("doc_id")
    store = ShardStore(spark, str(tmp_path / "s"), rows.schema, fanout=4)
    for k in range(4):
        store.append(rows.filter(F.col("doc_id") == k).coalesce(1), k)
    other = ShardStore(spark, str(tmp_path / "s"), rows.schema, fanout=100)
    write = store._write

    def slow(packed):
        made = write(packed)
        other.append(rows.filter("doc_id = 4").coalesce(1), 4)  # meanwhile
        return made

    store._write = slow
    assert store.compact() == 6 and same(store.read(), rows.filter("doc_id < 5"))
    store._write = write
    gone = [tuple(r) for r in store.manifest().collect()]
    made = store._listed(store._write(store._packed(gone)), 9)
    store._added(made, gone)
    with pytest.raises(ConflictError):
        other._added(made, gone)
    commit = other._commit

    def beaten(changes, version):
        other._commit = commit
        store.append(rows.filter("doc_id = 5").coalesce(1), 5)
        return commit(changes, version)

    other._commit = beaten
    other.append(rows.limit(0), 6)
    assert same(store.read(), rows)


def test_crash_between_writing_and_committing(spark, docs, tmp_path):
    store = ShardStore(spark, str(tmp_path / "s"), docs.schema)
    store.append(docs.limit(5))
    store._write(docs.limit(7))
    assert store.read().count() == 5 and store.vacuum() == 0
    late = ShardStore(spark, str(tmp_path / "s"), docs.schema, grace_seconds=-5)
    assert late.vacuum() >= 1 and late.read().count() == 5
    assert late.append(docs.limit(2)) == 2


def test_edge_rows(spark, tmp_path):
    rows = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "x" * 2_000_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    store = sharded(docs, "doc_id", arrivals=3, root=str(tmp_path / "a"))
    assert same(store.read(), docs)
    empty = sharded(docs.limit(0), "doc_id", arrivals=2, root=str(tmp_path / "b"))
    assert empty.versions() == [1, 2] and empty.read().count() == 0 and empty.read().columns == docs.columns


def test_query_gives_every_document_back(spark, sf, docs):
    want = docs.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))
    got = op1_sharding(spark, sf)
    assert same(got, want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
