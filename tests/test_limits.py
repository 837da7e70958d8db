import pytest
from pyspark.sql import functions as F

from placebook.operators import batch, forward
from placebook.operators import index as ix
from placebook.plans import derived, queries


@pytest.fixture(scope="module")
def records(spark, sf):
    return derived.records(spark, sf).cache()


@pytest.fixture(scope="module")
def index(records):
    return ix.entries(records).cache()


@pytest.fixture
def limits(monkeypatch):
    """The limits that hits are looked for with."""
    seen, real = [], forward.hits_of

    def hits_of(index, texts, limit=None):
        seen.append(limit)
        return real(index, texts, limit)

    monkeypatch.setattr(forward, "hits_of", hits_of)
    return seen


def test_summary_asks_for_first_results(spark, sf, limits):
    """all results of all queries were listed for a summary."""
    row = queries.QUERIES["batch_summary"](spark, sf).first()
    assert limits == [1] and row.total == row.matched + row.no_match == derived.text_queries(spark, sf).count()


@pytest.mark.parametrize("most", [3, 1, 0])
def test_batch_looks_for_no_more_than_it_returns(spark, records, index, limits, most):
    """F8, F10: all hits were looked for and joined, and then cut."""
    asked = spark.createDataFrame([(0, "Springfield"), (1, "Portlnad"), (2, "zzqq flurb"), (3, "Springfield"), (4, None), (5, "springfield")], "qid long, q string")
    rows = {r.qid: r for r in batch.batch(records, index, asked, most).collect()}
    assert limits == [max(1, most)]
    whole = {r.qid: r for r in batch.batch(records, index, asked).collect()}
    assert sorted(rows) == list(range(6)) and len(whole[0].results) > 3 and len(whole[4].results) == records.count()
    for k in rows:
        assert rows[k].q == whole[k].q and rows[k].results == whole[k].results[:most]
        assert rows[k].status == ("matched" if rows[k].results else "nomatch")


def test_records_meet_hits_of_texts(spark, records, index):
    """the records were joined to the hits of every query."""
    asked = spark.range(60).selectExpr("id as qid", "case id % 3 when 0 then 'Springfield' when 1 then 'Portlnad' else 'zzqq' end as q")
    found = forward.forward_records(index, records, asked).select("qid", "rank", "rec_id", "confidence", "match_type", "lat", F.col("address.full").alias("full"))
    want = forward.with_records(forward.forward(index, asked), records).select(*found.columns[:-1], F.col("address.full").alias("full"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    joins = [line for line in forward.forward_records(index, records, asked)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in line or "rec_id" in line and "Join" in line]
    assert "Generate" in joins[0] and any("Join" in line for line in joins[1:])  # hits are given to queries after the join
