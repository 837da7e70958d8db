"""The text functions in DuckDB's dialect, for the oracle only. Texts are assumed to be lower-cased alike by both engines, and their white space to be ASCII."""

from __future__ import annotations

from placebook.functions.text import DIRECTIONS, MATCH_UNITS, SUFFIXES, UNITS
from placebook.plans.derived import GAZETTEER, ODD, POINTS, QUERIES


def _word(x: str, word: str, by: str) -> str:
    """Whole-word replacement without look-behind: twice, through a placeholder that counts as a letter."""
    once = f"regexp_replace({{}}, '(^|[^0-9a-zZ]|{word}){word}($|[^0-9a-zZ])', '\\1Z\\2', 'g')"
    return f"replace({once.format(once.format(x))}, 'Z', '{by}')"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def match_ctes(name: str, source: str, column: str) -> str:
    """CTEs that end in ``name``: the source with its match key as x."""
    x = f"replace(replace(replace(lower({column}), '.', ''), ',', ' '), '#', ' ')"
    for long, short in DIRECTIONS:
        x = _word(_word(x, long, " "), short, " ")
    ctes, last = [f"{name}_0 as (select *, {x} as x from {source})"], f"{name}_0"
    alone = "regexp_matches({}, '[0-9a-z]')"
    for k, d in enumerate(MATCH_UNITS, 1):
        at = f"strpos(x, '{d}')"
        free = f"{at} > 0 and not coalesce({alone.format(f'substr(x, {at} - 1, 1)')} and {at} > 1, false) and not {alone.format(f'substr(x, {at} + {len(d)}, 1)')}"
        cut = f"substr(x, 1, {at} - 1) || ' ' || regexp_replace(substr(x, {at} + {len(d)}), '^\\s*\\S*', '')"
        ctes.append(f"{name}_{k} as (select * replace (case when {free} then {cut} else x end as x) from {last})")
        last = f"{name}_{k}"
    x = "x"
    for long, short in SUFFIXES:
        x = _word(x, long, short)
    ctes.append(f"{name} as (select * replace ({_squeezed(x)} as x) from {last})")
    return ", ".join(ctes)


def address_text(x: str) -> str:
    out = f"replace(replace(lower({x}), '.', ''), '#', ' # ')"
    for long, short in DIRECTIONS + SUFFIXES:
        out = _word(out, long, short)
    return _squeezed(out)


def street_text(x: str) -> str:
    out = f"lower({x})"
    for long, short in SUFFIXES:
        out = f"replace({out}, '{long}', '{short}')"
    return out


def parsed(source: str, text: str) -> str:
    """A select of the source with the address parts of ``text``."""
    return f"""
select *, case when n >= 3 and digits <> '' and rest <> '' then digits end as house_number,
  case when n >= 3 and digits <> '' and rest <> '' then rest else parts[1] end as street,
  parts[2] as city, parts[3] as state, case when n >= 5 then parts[4] end as postcode, case when n >= 5 then parts[5] when n = 4 then parts[4] end as country
from (select *, regexp_extract(parts[1], '^([0-9]+)', 1) as digits, trim(regexp_replace(parts[1], '^[0-9]+', '')) as rest, len(parts) as n
  from (select *, trim({text}) as "full", list_transform(string_split(trim({text}), ','), lambda p: trim(p)) as parts from {source}))"""


def unit(x: str) -> str:
    """A list [rest, unit]."""
    out = f"[{x}, null]"
    for d in reversed(UNITS):
        at = f"strpos(lower({x}), '{d}')"
        u = f"regexp_extract(regexp_replace(trim(substr({x}, {at} + {len(d)})), '^[. :]+', ''), '^([^, ]*)', 1)"
        before = f"trim(regexp_replace(trim(substr({x}, 1, {at} - 1)), ',+$', ''))"
        out = f"case when {at} > 0 and {u} <> '' then [{before}, {u}] else {out} end"
    return out


def soundex_text(x: str) -> str:
    letters = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    codes = f"translate({letters}, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    for d in "0123456":
        codes = f"regexp_replace({codes}, '{d}+', '{d}', 'g')"
    tail = f"replace(substr({codes}, 2), '0', '')"
    return f"case when {letters} = '' then '0000' else rpad(upper(substr({letters}, 1, 1)) || substr({tail}, 1, 3), 4, '0') end"


WITH = f"with recursive gaz as ({GAZETTEER}), queries as ({QUERIES}), points as ({POINTS}), odd as ({ODD}), rec as ({parsed('gaz', 'raw')})"
ENTRIES = (
    WITH
    + """, texts as (
  select id as rec_id, unnest([0, 1, 2, 3]) as slot, unnest(["full", street, street || ' ' || city, city]) as t from rec
), present as (
  select rec_id, row_number() over (partition by rec_id order by slot) - 1 as key_ord, t from texts where t is not null
), """
    + match_ctes("keyed", "present", "t")
    + ", entries as (select rec_id, key_ord, x as key, x || chr(31) || cast(rec_id as varchar) as full_key from keyed), "
    + match_ctes("asked", "queries", "q")
    + """, hits as (
  select qid, rec_id, min(full_key) as full_key from asked join entries on starts_with(full_key, x) group by qid, rec_id
), ranked as (
  select *, row_number() over (partition by qid order by full_key) as rank from hits
)"""
)
FUZZY = """, missed as (
  select qid, x as q from asked where qid not in (select qid from hits)
), pairs as (
  select qid, key, d, 1 - d / greatest(strlen(q), strlen(key)) as score
  from (select *, levenshtein(q, key) as d from (select distinct qid, q from missed) join (select distinct key from entries) on abs(length(q) - length(key)) <= 2) where d <= 2
), best as (
  select p.qid, e.rec_id, p.score, p.key, p.d, row_number() over (partition by qid order by score desc, rec_id, key_ord) as r
  from pairs p join entries e on e.key = p.key where score >= 0.6 qualify r <= 20
), fuzzy as (
  select qid, rec_id, arg_min(score, r) as confidence, row_number() over (partition by qid order by min(r)) as rank from best group by qid, rec_id qualify rank <= 5
), forwarded as (
  select qid, rank, rec_id, 1.0::double as confidence, 'exact' as match_type from ranked
  union all select qid, rank, rec_id, confidence, 'fuzzy' from fuzzy
)"""
KNN = WITH + """, near as (
  select p.qid, r.id as rec_id, (r.lon - p.lon) * (r.lon - p.lon) + (r.lat - p.lat) * (r.lat - p.lat) as d2 from points p join rec r on true
), knn as (
  select qid, row_number() over (partition by qid order by d2, rec_id) as rank, rec_id, d2 from near qualify rank <= 5
)"""
