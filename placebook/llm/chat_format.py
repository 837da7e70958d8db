"""Chat formatting in budgeted windows, with built-in functions only.

A turn is written ``### role: text</turn>`` and a line feed.  In roles and
texts a backslash goes before every backslash, into ``</turn>`` after its
``<`` and between the marks of ``###``, so that neither control string can
occur in them, and taking each backslash away again gives the text back.

A conversation becomes one or more windows of at most ``budget`` tokens, cut
between turns by the prefix sums of the turns' tokens: a window starts where
the turns since the last start exceed the budget less the system turn and the
history.  Every window after the first repeats the system turn and as many
earlier turns as fit ``history`` tokens.  The loss mask has the assistant texts
of a window's new turns only; repeated ones are context.

A token is a word (``[^\\x20\\x09-\\x0D]+``) of the text; a turn's marks count as
four.  A turn longer than the budget has a window of its own and is not cut.

Defined results: null texts and roles are empty; turns with the same number
follow by role, then text; repeated rows are turns of their own; rows without
conv_id are one conversation; an empty table gives an empty table; further
columns are not read.  A conversation is the unit of work: one task sees its
turns together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placebook.llm._store import table

BUDGET, HISTORY = 512, 128


def escaped(text: str) -> str:
    """SQL for the reversible escaping of ``text``."""
    backslashes = rf"replace({text}, '\\', '\\\\')"
    marks = rf"regexp_replace({backslashes}, '#(?=##)', '#\\\\')"
    return rf"replace({marks}, '</turn>', '<\\/turn>')"


def unescaped(text: str) -> str:
    """SQL that takes the escaping away."""
    return rf"regexp_replace({text}, '(?s)\\\\(.)', '$1')"


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, n_repeated, formatted, loss) of each window of (conv_id, turn, role, text).

    ``n_repeated`` turns at the window's start are repeated from earlier windows. ``loss`` has the (start, length)
    of each masked span of ``formatted`` in code points, from 0.
    """
    told = turns.select("conv_id", "turn", F.expr("coalesce(role, '')").alias("role"), F.expr("coalesce(text, '')").alias("text"))
    told = told.withColumns({
        "head": F.expr(f"concat('### ', replace({escaped('role')}, ': ', ':\\\\ '), ': ')"), "body": F.expr(escaped("text")),
        "tokens": F.expr("cast(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+') + 4 as bigint)"),
    })
    # prefix sums over the turns in order; what follows gathers each conversation's turns with them
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    summed = told.select(
        "conv_id", F.struct(
            F.row_number().over(order).alias("n"), F.sum("tokens").over(so_far).alias("p"), F.sum(F.expr("length(head) + length(body) + 8L")).over(so_far).alias("c"),
            (F.col("role") == "system").alias("system"), (F.col("role") == "assistant").alias("target"), "head", "body",
        ).alias("t"),
    )
    talks = summed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("parts"))
    steps = [
        ("p", "concat(array(0L), transform(parts, x -> x.p))"),
        ("c", "concat(array(0L), transform(parts, x -> x.c))"),
        ("n_sys", "if(parts[0].system, 1, 0)"),
        ("room", f"greatest(1L, {budget} - {history} - p[n_sys])"),
        ("starts", """aggregate(filter(sequence(0, size(parts) - 1), i -> i > n_sys), array(0),
            (a, i) -> if(i > element_at(a, -1) and p[i + 1] - p[greatest(element_at(a, -1), n_sys)] > room, array_append(a, i), a))"""),
        ("w", f"""explode(transform(starts, (a, k) -> struct(k, a, coalesce(get(starts, k + 1), size(parts)) as b,
            if(k = 0, 0, filter(sequence(n_sys, a), j -> p[a] - p[j] <= {history})[0]) as h)))"""),
    ]
    for name, sql in steps:
        talks = talks.withColumn(name, F.expr(sql))
    lead = "if(w.k > 0, n_sys, 0)"
    return talks.select(
        "conv_id",
        F.expr("cast(w.k as int)").alias("window"),
        F.expr(f"{lead} + w.a - w.h").alias("n_repeated"),
        F.expr(f"""array_join(transform(concat(slice(parts, 1, {lead}), slice(parts, w.h + 1, w.b - w.h)), x -> concat(x.head, x.body, '</turn>\\n')), '')""").alias("formatted"),
        F.expr(f"""transform(filter(sequence(w.a, w.b - 1), i -> parts[i].target),
            i -> struct(c[{lead}] + c[i] - c[w.h] + length(parts[i].head) as start, cast(length(parts[i].body) as bigint) as length))""").alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) from the windows: the turns as (role, text), each once, and the text under the mask."""
    cut = r"filter(split(formatted, '</turn>\n'), (x, i) -> i >= n_repeated and x <> '')"
    each = formatted.select(
        "conv_id", "window", F.expr("cast(length(formatted) as bigint)").alias("chars"),
        F.expr(f"""transform({cut}, x -> struct(
            {unescaped("substr(x, 5, instr(x, ': ') - 5)")} as role, {unescaped("substr(x, instr(x, ': ') + 2)")} as text))""").alias("turns"),
        F.expr(f"array_join(transform(loss, s -> {unescaped('substr(formatted, s.start + 1, s.length)')}), '')").alias("loss_text"),
    )
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.expr("flatten(w.turns)").alias("turns"), F.expr("array_join(w.loss_text, '')").alias("loss_text"), "formatted_chars")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id = 0, 'user', 'assistant')").alias("role"), F.lit(odd).alias("text")
    )
    back = read_back(windows(turns.unionByName(added)))
    return back.select(
        "conv_id", F.expr("cast(size(turns) as bigint)").alias("n_turns"),
        F.expr("sha2(array_join(transform(turns, x -> concat(x.role, '\\n', x.text, '\\n')), ''), 256)").alias("turns_sha256"),
        F.expr("cast(length(loss_text) as bigint)").alias("loss_chars"), F.expr("sha2(loss_text, 256)").alias("loss_sha256"), "formatted_chars",
    )


ORACLE = rf"""
with recursive c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), e as (
  select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as i,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 as tokens,
    length(role) + length(text)
      + length(regexp_replace(role || text, '[^\\]', '', 'g'))
      + (length(role) - length(replace(role, '</turn>', ''))) // 7 + (length(text) - length(replace(text, '</turn>', ''))) // 7
      + (length(role) - length(replace(role, ': ', ''))) // 2
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: length(x) - 2)), 0)
      + coalesce(list_sum(list_transform(regexp_extract_all(role, '#{{3,}}'), lambda x: length(x) - 2)), 0) + 14 as chars
  from c
), f as (
  select *, coalesce(sum(tokens) over before, 0) as p, count(*) over (partition by conv_id) as n,
    sum(case when i = 0 and role = 'system' then 1 else 0 end) over (partition by conv_id) as n_sys,
    sum(case when i = 0 and role = 'system' then tokens else 0 end) over (partition by conv_id) as sys_tokens,
    sum(case when i = 0 and role = 'system' then chars else 0 end) over (partition by conv_id) as sys_chars
  from e window before as (partition by conv_id order by i rows between unbounded preceding and 1 preceding)
), s as (
  select conv_id, i, cast(0 as bigint) as a, cast(0 as bigint) as k, cast(n_sys as bigint) as first_new, cast(sys_tokens as bigint) as p0 from f where i = 0
  union all
  select f.conv_id, f.i, case when cut then f.i else s.a end, case when cut then s.k + 1 else s.k end,
    case when cut then f.i else s.first_new end, case when cut then cast(f.p as bigint) else s.p0 end
  from s join (select f.*, s2.cut_at from f join (select 1 as cut_at) s2 on true) f on f.conv_id = s.conv_id and f.i = s.i + 1,
    lateral (select f.i > s.first_new and f.p + f.tokens - s.p0 > greatest(1, {BUDGET} - {HISTORY} - f.sys_tokens) as cut)
), w as (
  select conv_id, k, min(i) as a from s group by conv_id, k
), h as (
  select w.conv_id, w.k, max(f.sys_chars) as sys_chars, sum(f.chars) as hist
  from w join f g on g.conv_id = w.conv_id and g.i = w.a
    join f on f.conv_id = w.conv_id and f.i >= f.n_sys and f.i < w.a and g.p - f.p <= {HISTORY}
  where w.k > 0 group by w.conv_id, w.k
), r as (
  select w.conv_id, sum(coalesce(h.hist, 0)) + sum(case when w.k > 0 then y.sys_chars else 0 end) as chars
  from w left join h using (conv_id, k) join (select distinct conv_id, sys_chars from f) y on y.conv_id = w.conv_id group by w.conv_id
), g as (
  select conv_id, count(*) as n_turns, sum(chars) as chars,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) as loss_sha256
  from f group by conv_id
)
select g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, cast(g.chars + r.chars as bigint) as formatted_chars
from g join r using (conv_id)
"""
