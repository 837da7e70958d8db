"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Sources in order of code points (null last) weigh 5, 2, 1 in turn and share
``budget`` times all tokens; what a source cannot take, as its target stops at
twice its size, the others share by weight.  Documents are dealt over shards
of their source by a seeded hash, and a shard's tokens, document after
document, are cut into blocks of ``BLOCK`` tokens.

Blocks are allocated by highest quotients, weight / (2 seats + 1), first to
sources by their targets, then inside each source to its shards, which gives
every shard an integer quota.  Only quotients near the divisor compete in a
sort: with n parties and Q seats, every party surely gets the seats that it
would get at the divisor Q / (Q - n / 2), so about n seats are left to rank.
A shard takes each block quota / blocks times, and once more the blocks of
the least seeded hashes; never more than twice.

A token is a word, ``[^\\x20\\x09-\\x0D]+``.  Defined results: a null or empty
text has size 0 and is never taken; a null source is a source of its own, and
a null doc_id is dealt as one id; equal quotients go to the earlier party;
repeated rows stand in a shard one after another; very long documents may
reach over many blocks; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.llm._store import table, written
from placebook.llm._words import Texts, slices

BLOCK, SHARD, BUDGET, SEED = 64, 200_000, 1.5, 17
TASK_BLOCKS = 200_000  # blocks that one task ranks, about
WEIGHTS = (5, 2, 1)

WORDS = "coalesce(cast(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') as bigint), 0L)"
KEY = "coalesce(concat('=', source), '')"


def _hash(text: str, part: int = 0) -> str:
    """SQL for a 32-bit number from the md5 of ``text``."""
    return f"cast(conv(substr(md5({text}), {1 + 8 * part}, 8), 16, 10) as bigint)"


def targets(sizes: DataFrame, budget: float = BUDGET, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add weight and target to (source, key, source_size): one row for each source.

    A source is at its cap if, at the rate where it reaches it, all sources together stay within the budget.
    """
    turn = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("turn", F.row_number().over(turn) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.expr(f"turn % {len(weights)} + 1")).cast("bigint"))
    every = Window.partitionBy(F.lit(1))
    up = Window.partitionBy(F.lit(1)).orderBy("rate", "turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("rate", F.expr("2D * source_size / weight"))
    rows = rows.withColumns({"size_up": F.sum("source_size").over(up), "weight_up": F.sum("weight").over(up), "size_all": F.sum("source_size").over(every), "weight_all": F.sum("weight").over(every)})
    rows = rows.withColumn("full", F.expr(f"2D * size_up + rate * (weight_all - weight_up) <= {budget}D * size_all"))
    rest = {"size_full": F.sum(F.expr("if(full, source_size, 0L)")).over(every), "weight_left": F.sum(F.expr("if(full, 0L, weight)")).over(every)}
    rows = rows.withColumns(rest)
    target = f"if(full, 2D * source_size, ({budget}D * size_all - 2D * size_full) * weight / weight_left)"
    return rows.withColumn("target", F.expr(target)).select("source", "key", "source_size", "weight", "target")


def apportioned(parties: DataFrame, group: list[str], party: list[str]) -> DataFrame:
    """Add ``seats`` to rows (group, party, w, most, q): Sainte-Laguë's share of the group's q seats by weight w, at most ``most``."""
    every = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    rows = parties.withColumns({"n": F.count("*").over(every), "w_all": F.sum("w").over(every)})
    rows = rows.withColumn("share", F.expr("if(w_all > 0 and q > 0, q * (w / w_all), 0D)"))
    rows = rows.withColumn("sure", F.expr("least(most, if(2 * q > n, cast(floor(share * (1 - n / (2D * q)) + 0.5D) as bigint), 0L))"))
    rows = rows.withColumn("top", F.expr("least(most, if(q > 0, cast(floor(share * (1 + n / (2D * q)) + 0.5D) as bigint) + 1, 0L))"))
    rows = rows.withColumn("left", F.col("q") - F.sum("sure").over(every))
    seats = rows.filter("top > sure").withColumn("seat", F.explode(F.expr("sequence(sure, top - 1)"))).withColumn("quotient", F.expr("w / (2 * seat + 1)"))
    order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))).orderBy(F.desc("quotient"), *party, "seat")
    won = seats.withColumn("_r", F.row_number().over(order)).filter(F.expr("_r <= left and quotient > 0"))
    more = won.groupBy(*group, *party).agg(F.count("*").alias("more"))
    return rows.join(more, [*group, *party], "left").withColumn("seats", F.expr("sure + coalesce(more, 0L)")).drop("n", "w_all", "share", "sure", "top", "left", "more")


def laid_out(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size, shard and first token in the shard; sources with their targets). docs needs doc_id, key, source, size."""
    sizes = docs.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sizes), "sources")
    parts = sources.select("key", "source_size", "target", F.expr(f"greatest(1L, cast(ceil(source_size / {shard}D) as bigint))").alias("shards"))
    salt = f"concat('{seed}:', coalesce(cast(doc_id as string), ''))"
    dealt = docs.join(parts, "key").withColumns({"shard": F.expr(f"{_hash(salt)} % shards"), "place": F.expr(_hash(salt, 1))})
    before = Window.partitionBy("key", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0).cast("bigint"))), sources


def chosen_blocks(docs: DataFrame, sources: DataFrame, block: int = BLOCK, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """(key, shard, b, times) of every block that is taken, for documents as laid_out() gives them."""
    shards = docs.groupBy("key", "shard").agg(F.sum("size").alias("shard_size")).withColumn("blocks", F.expr(f"cast(ceil(shard_size / {block}D) as bigint)"))
    shards = written(shards, "shards")
    room = shards.groupBy("key").agg(F.expr("2 * sum(blocks)").alias("most"))
    total = F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    seats = F.floor(F.expr(f"{budget}D * total / {block}D + 0.5D")).cast("bigint").alias("q")
    parties = sources.withColumn("total", total).join(room, "key").select("key", F.col("target").alias("w"), "most", seats)
    quota = written(apportioned(parties, [], ["key"]).select("key", F.col("seats").alias("q")), "quotas")
    held = shards.join(quota, "key").select("key", "shard", "blocks", F.col("shard_size").cast("double").alias("w"), F.expr("2 * blocks").alias("most"), "q")
    own = apportioned(held, ["key"], ["shard"]).filter("seats > 0").select("key", "shard", "blocks", "seats")
    # few rows that become many: as many partitions as the blocks need, which AQE does not merge by the size before;
    # keys in another order than the join's, as Spark drops a repartition that repeats the one below it
    total_blocks = shards.agg(F.sum("blocks")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_blocks // TASK_BLOCKS))
    each = own.repartition(parts, "shard", "key").withColumn("b", F.explode(F.expr("sequence(0L, blocks - 1)")))
    salt = f"concat('{seed}|', key, '|', shard, '|', b)"
    order = Window.partitionBy("key", "shard").orderBy("r", "b")
    ranked = each.withColumn("r", F.expr(_hash(salt))).withColumn("_n", F.row_number().over(order))
    return ranked.select("key", "shard", "b", F.expr("seats div blocks + if(_n <= seats % blocks, 1, 0)").alias("times")).filter("times > 0")


def mixed(docs: DataFrame, carry: list[str], block: int = BLOCK, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """(carry..., size, source_size, target, taken, spans) of every document.

    ``spans`` has the (from_word, to_word, times) of its words that are taken, to_word exclusive.
    """
    sized = docs.withColumns({"size": F.expr(WORDS), "key": F.expr(KEY)}).select(*dict.fromkeys([*carry, "doc_id", "source", "key", "size"]))
    sized = written(sized, "sized")
    placed, sources = laid_out(sized, block, seed=seed)
    placed = written(placed.select(*dict.fromkeys([*carry, "doc_id", "key", "size", "source_size", "target", "shard", "first"])), "placed")
    blocks = chosen_blocks(placed, sources, block, budget, seed)
    cut = placed.filter("size > 0").select("key", "shard", "first", "size", F.explode(F.expr(f"sequence(first div {block}, (first + size - 1) div {block})")).alias("b"))
    # both sides grow with the tokens: never broadcast
    hit = cut.join(blocks.hint("merge"), ["key", "shard", "b"]).withColumns({"lo": F.expr(f"greatest(first, b * {block}) - first"), "hi": F.expr(f"least(first + size, (b + 1) * {block}) - first")})
    took = hit.groupBy("key", "shard", "first").agg(F.expr("sum((hi - lo) * times)").alias("taken"), F.array_sort(F.collect_list(F.struct(F.col("lo").alias("from_word"), F.col("hi").alias("to_word"), "times"))).alias("spans"))
    took = took.withColumn("some", F.lit(True))
    # where documents start at the same token, all but the last are empty
    kept = placed.withColumn("some", F.col("size") > 0)
    return kept.join(took, ["key", "shard", "first", "some"], "left").select(*carry, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"), "spans")


def mix(docs: DataFrame, block: int = BLOCK, budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """The mix itself: one row with the columns of docs for each time that words of a document are taken.

    A row's text has the words taken at least so many times, with the white space between neighbouring ones as it
    was; a document taken as a whole keeps its text. n_chars, if there is one, counts the new text.
    """
    # rows are told apart by a number of their own, except repeated ones, whose text is sent once
    keyed = docs.withColumns({"_jid": F.xxhash64(*docs.columns), "_h": F.xxhash64("text", F.lit(1))})
    spans = mixed(keyed, ["_jid", "_h"], block, budget, seed).filter("taken > 0").select("_jid", "_h", F.array("spans").alias("_spans"))
    once = keyed.groupBy("_jid", "_h").agg(F.first(F.struct(*docs.columns)).alias("row")).select("_jid", "_h", "row.*")
    found = once.join(spans.hint("merge"), ["_jid", "_h"]).select(*docs.columns, "_spans")
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for part in slices(batches):
            texts = Texts(part.column(at))
            start, end, text = texts.spans
            first = np.searchsorted(text, np.arange(texts.n + 1))
            rows, out = [], []
            for i, lists in enumerate(part.column(len(names)).to_pylist()):
                raw = texts.byte[texts.offset[i] : texts.offset[i + 1]].tobytes()
                n = first[i + 1] - first[i]
                for spans in lists:
                    for turn in range(1, max(s["times"] for s in spans) + 1):
                        runs: list[list[int]] = []
                        for s in spans:
                            if s["times"] >= turn:
                                if runs and runs[-1][1] == s["from_word"]:
                                    runs[-1][1] = s["to_word"]
                                else:
                                    runs.append([s["from_word"], s["to_word"]])
                        if runs == [[0, n]]:
                            piece = raw
                        else:
                            shift, base = texts.offset[i], first[i]
                            piece = b"\n".join(raw[start[base + a] - shift : end[base + b - 1] - shift] for a, b in runs)
                        rows.append(i)
                        out.append(piece.decode())
            columns = [c.take(pa.array(rows, pa.int64())) for c in part.columns[: len(names)]]
            columns[at] = pa.array(out, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([len(x) for x in out], pa.int64()).cast(part.column(names.index("n_chars")).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(run, T.StructType(docs.schema.fields))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs, ["doc_id"]).drop("spans")


def _apportion_sql(name: str, rows: str, group: str, party: str) -> str:
    by = f"partition by {group}" if group else ""
    using = f"{group}, {party}" if group else party
    return f"""
{name}_r as (
  select *, case when w_all > 0 and q > 0 then q * (w / w_all) else 0 end as share
  from (select *, count(*) over ({by}) as n, sum(w) over ({by}) as w_all from {rows})
), {name}_b as (
  select *, least(most, case when 2 * q > n then cast(floor(share * (1 - n / (2.0::double * q)) + 0.5) as bigint) else 0 end) as sure,
    least(most, case when q > 0 then cast(floor(share * (1 + n / (2.0::double * q)) + 0.5) as bigint) + 1 else 0 end) as top from {name}_r
), {name}_l as (
  select *, q - sum(sure) over ({by}) as remaining from {name}_b
), {name}_c as (
  select *, w / (2 * seat + 1) as quotient from (select *, unnest(range(sure, top)) as seat from {name}_l where top > sure)
), {name}_w as (
  select * from {name}_c where quotient > 0
  qualify row_number() over ({by} order by quotient desc, {party}, seat) <= remaining
), {name} as (
  select l.*, cast(sure + coalesce(more, 0) as bigint) as seats from {name}_l l left join (select {using}, count(*) as more from {name}_w group by {using}) using ({using})
)"""


def _number_sql(text: str, part: int = 0) -> str:
    return f"cast('0x' || substr(md5({text}), {1 + 8 * part}, 8) as bigint)"


_SALT = f"'{SEED}:' || coalesce(cast(doc_id as varchar), '')"

ORACLE = f"""
with d as (
  select doc_id, source, coalesce('=' || source, '') as key,
    cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents
), z as (
  select key, source, cast(sum(size) as bigint) as source_size from d group by key, source
), t1 as (
  select *, case turn % 3 when 0 then 5 when 1 then 2 else 1 end as weight
  from (select *, row_number() over (order by source is null, source) - 1 as turn from z)
), t2 as (
  select *, 2.0::double * source_size / weight as rate, sum(source_size) over () as size_all, sum(weight) over () as weight_all from t1
), t3 as (
  select *, sum(source_size) over up as size_up, sum(weight) over up as weight_up from t2
  window up as (order by rate, turn rows between unbounded preceding and current row)
), t4 as (
  select *, 2.0::double * size_up + rate * (weight_all - weight_up) <= {BUDGET}::double * size_all as is_full from t3
), t5 as (
  select *, sum(case when is_full then source_size else 0 end) over () as size_full, sum(case when is_full then 0 else weight end) over () as weight_left from t4
), s as (
  select key, source_size, size_all,
    case when is_full then 2.0::double * source_size else ({BUDGET}::double * size_all - 2.0::double * size_full) * weight / weight_left end as target,
    greatest(1, cast(ceil(source_size / {SHARD}.0::double) as bigint)) as shards from t5
), p as (
  select *, cast(coalesce(sum(size) over (partition by key, shard order by place, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as bigint) as first
  from (select d.*, source_size, target, {_number_sql(_SALT)} % shards as shard, {_number_sql(_SALT, 1)} as place from d join s using (key))
), h as (
  select key, shard, cast(sum(size) as bigint) as shard_size, cast(ceil(sum(size) / {BLOCK}.0::double) as bigint) as blocks from p group by key, shard
), q_in as (
  select s.key, target as w, most, cast(floor({BUDGET}::double * size_all / {BLOCK}.0::double + 0.5) as bigint) as q
  from s join (select key, cast(2 * sum(blocks) as bigint) as most from h group by key) using (key)
), {_apportion_sql("quota", "q_in", "", "key")}, o_in as (
  select h.key, h.shard, h.blocks, cast(h.shard_size as double) as w, 2 * h.blocks as most, quota.seats as q from h join quota using (key)
), {_apportion_sql("own", "o_in", "key", "shard")}, each_block as (
  select key, shard, blocks, seats, unnest(range(0, blocks)) as b from own where seats > 0
), picked as (
  select key, shard, b, seats // blocks + case when n <= seats % blocks then 1 else 0 end as times
  from (select *, row_number() over (partition by key, shard order by {_number_sql(f"'{SEED}|' || key || '|' || shard || '|' || b")}, b) as n from each_block)
), cut as (
  select key, shard, first, size, unnest(range(first // {BLOCK}, (first + size - 1) // {BLOCK} + 1)) as b from p where size > 0
), took as (
  select key, shard, first, sum((least(first + size, (b + 1) * {BLOCK}) - greatest(first, b * {BLOCK})) * times) as taken
  from cut join picked using (key, shard, b) group by key, shard, first
)
select p.doc_id, p.size, p.source_size, p.target, cast(coalesce(case when p.size > 0 then took.taken end, 0) as bigint) as taken
from p left join took using (key, shard, first)
"""
