"""Quality rules as a short-circuit cascade.

Each rule rejects a document from a few counts of its text.  On a sample the
cascade times every rule and counts what it rejects, and then runs the rules
by falling rejections per second: a document that one rule has rejected is
never shown to the next.  The order changes only the cost; a document is kept
exactly if no rule rejects it, so the verdict is the same under any order.

Defined results: a null or empty text has no words and is rejected as too
short; repeated rows and tied ids are judged row by row; very long texts are
read whole; further columns pass through untouched, but judge() replaces columns
that have its results' names; an empty table gives an empty table.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placebook.llm._store import table
from placebook.llm._words import Texts, mix, slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


class Counts:
    """Counts of a column of texts, each worked out when first asked for."""

    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_word_lines", "n_repeat_words", "n_echo_words", "n_upper", "n_lower")

    def __init__(self, column: pa.Array):
        self.column = column

    @cached_property
    def texts(self) -> Texts:
        return Texts(self.column)

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.texts.n_words

    @cached_property
    def word_chars(self) -> np.ndarray:
        t = self.texts
        return t.per_text(t.solid & ((t.byte & 0xC0) != 0x80))

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.texts.per_text(_SYMBOL[self.texts.byte])

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self.texts.per_text(_UPPER[self.texts.byte])

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self.texts.per_text(_LOWER[self.texts.byte])

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines that hold a word, those among them that equal an earlier line) of each text."""
        t = self.texts
        cuts = np.flatnonzero(t.byte == 10)
        # a line starts at its text's start or after a line feed of the same text
        start = np.sort(np.concatenate([t.offset[:-1], cuts + 1]))
        text = np.concatenate([np.arange(t.n), np.searchsorted(t.offset, cuts, side="right") - 1])
        text = np.sort(text)
        end = np.empty(len(start), np.int64)
        end[:-1] = start[1:]
        last = np.ones(len(start), bool)
        last[:-1] = text[1:] != text[:-1]
        end[last] = t.offset[text[last] + 1]
        end[~last] -= 1
        solid = np.zeros(len(t.byte) + 1, np.int64)
        np.cumsum(t.solid, out=solid[1:])
        held = solid[end] > solid[start]
        start, end, text = start[held], end[held], text[held]
        key = mix(t.hashes(start, end) ^ mix(text.astype(np.uint64)))
        _, first = np.unique(key, return_index=True)
        lines = np.bincount(text, minlength=t.n)
        return lines, lines - np.bincount(text[first], minlength=t.n)

    @cached_property
    def n_word_lines(self) -> np.ndarray:
        return self._lines[0]

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside 8-word windows that the text holds twice or more."""
        t, width = self.texts, 8
        at, h = t.windows(width)
        text = t.spans[2]
        key = mix(h ^ mix(text[at].astype(np.uint64)))
        order = np.argsort(key)
        key = key[order]
        twin = np.zeros(len(key), bool)
        same = key[1:] == key[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        edge = np.zeros(len(text) + 1, np.int64)
        hit = at[order[twin]]
        edge[hit] += 1  # each window starts at a word of its own
        np.add.at(edge, hit + width, -1)
        return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=t.n).astype(np.int64)

    @cached_property
    def n_echo_words(self) -> np.ndarray:
        """Words equal to the word just before."""
        t = self.texts
        h, text = t.word_hash, t.spans[2]
        echo = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        return np.bincount(text[1:][echo], minlength=t.n).astype(np.int64)

    def only(self, keep: np.ndarray) -> Counts:
        """The counts of some rows; what is already known is carried over."""
        part = Counts(self.column.filter(pa.array(keep)))
        for name in self.names:
            if name in self.__dict__:
                part.__dict__[name] = self.__dict__[name][keep]
        return part


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps Counts to a boolean for each row."""

    name: str
    rejects: Callable[[Counts], np.ndarray]


def default_rules(fewest_words: int = 20, most_repeat_percent: int = 30, symbols_per_100_words: int = 25, echo_percent: int = 30, upper_percent: int = 60, dup_line_percent: int = 60, most_mean_chars: int = 30) -> tuple[Rule, ...]:
    return (
        Rule("few_words", lambda c: c.n_words < fewest_words),
        Rule("repeated_words", lambda c: 100 * c.n_repeat_words > most_repeat_percent * c.n_words),
        Rule("symbols", lambda c: 100 * c.n_symbols > symbols_per_100_words * c.n_words),
        Rule("echoes", lambda c: 100 * c.n_echo_words > echo_percent * c.n_words),
        Rule("shouting", lambda c: 100 * c.n_upper > upper_percent * (c.n_upper + c.n_lower)),
        Rule("repeated_lines", lambda c: (100 * c.n_dup_lines > dup_line_percent * c.n_word_lines) & (c.n_dup_lines > 2)),
        Rule("long_words", lambda c: c.word_chars > most_mean_chars * c.n_words),
    )


BASE_RULES = ("few_words", "repeated_words")


def rule_order(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 400, seed: int = 11) -> list[Rule]:
    """Rules by falling rejections per second, measured on at most ``sample_rows`` documents (a fixed bound).

    Every rule is timed alone on fresh counts, so a rule pays for all that it needs.
    """
    # take() reads partitions one by one until it has enough rows
    sample = pa.array([r["text"] for r in docs.select("text").sample(fraction=0.05, seed=seed).take(sample_rows)], pa.string())
    if not len(sample):
        return list(rules)

    def worth(rule: Rule) -> float:
        began = time.perf_counter()
        rejected = int(rule.rejects(Counts(sample)).sum())
        return rejected / max(time.perf_counter() - began, 1e-9)

    return sorted(rules, key=lambda r: (-worth(r), r.name))


def _cascade(counts: Counts, rules: Sequence[Rule]) -> np.ndarray:
    """Index of the rule that rejects each row, -1 where none does; later rules see only the survivors."""
    failed = np.full(len(counts.column), -1)
    alive = np.arange(len(failed))
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        bad = rule.rejects(counts)
        failed[alive[bad]] = k
        if bad.any():
            alive, counts = alive[~bad], counts.only(~bad)
    return failed


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 400, with_counts: bool = False) -> DataFrame:
    """Add ``failed_rule`` (null where kept) to every document; with ``with_counts`` also the base counts of each."""
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") if with_counts else ()
    docs = docs.drop(*base, "failed_rule")
    ordered = rule_order(docs, rules or default_rules(), sample_rows)
    names = [r.name for r in ordered]

    def run(batches):
        for part in slices(batches):
            counts = Counts(part.column(part.schema.get_field_index("text")))
            extra = [pa.array(getattr(counts, x), pa.int64()) for x in base]
            failed = _cascade(counts, ordered)
            verdict = pa.array([None if k < 0 else names[k] for k in failed], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, *extra, verdict], [*part.schema.names, *base, "failed_rule"])

    added = [T.StructField(x, T.LongType()) for x in base] + [T.StructField("failed_rule", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def keep_good(docs: DataFrame, rules: Sequence[Rule] | None = None, sample_rows: int = 400) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    held = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return judge(held, rules, sample_rows).filter("failed_rule is null").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = 'n_words < 20 or 100 * n_repeat_words > 30 * n_words'
    return judge(docs, with_counts=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.expr(failed).alias("base_failed"), F.col("failed_rule").isNull().alias("kept"),
    )


ORACLE = """
with d as (
  select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents
), w as (
  select rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws from d
), e as (
  select rid, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) >= 8
), g as (
  select rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') as win from e
), twice as (
  select rid, i from g qualify count(*) over (partition by rid, win) >= 2
), covered as (
  select rid, count(distinct p) as n_repeat_words from (select rid, i + unnest(range(0, 8)) as p from twice) group by rid
), l as (
  select rid, unnest(string_split(t, chr(10))) as line from d
), lines as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from l where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by rid
), f as (
  select w.doc_id, cast(len(ws) as bigint) as n_words,
    cast(length(array_to_string(ws, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, coalesce(n_lines, 0) as n_lines,
    cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) as n_lower,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_echo
  from w left join covered using (rid) left join lines using (rid)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 100 * n_symbols > 25 * n_words
    or 100 * n_echo > 30 * n_words
    or 100 * n_upper > 60 * (n_upper + n_lower) or (100 * n_dup_lines > 60 * n_lines and n_dup_lines > 2)
    or word_chars > 30 * n_words) as kept
from f
"""
