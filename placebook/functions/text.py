"""Address text as Column expressions over built-in functions: no Python runs on the rows.

White space is Unicode White_Space (``\\p{IsWhite_Space}``), which unlike
Python's ``str.split`` leaves U+001C to U+001F alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The abbreviations that matching relies on, in their order.
SUFFIXES = (
    ("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"), ("court", "ct"),
    ("place", "pl"), ("circle", "cir"), ("terrace", "ter"), ("highway", "hwy"), ("parkway", "pkwy"), ("expressway", "expy"),
    ("freeway", "fwy"), ("trail", "trl"), ("way", "wy"), ("alley", "aly"), ("crescent", "cres"), ("square", "sq"),
)
DIRECTIONS = (("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"), ("northeast", "ne"), ("northwest", "nw"), ("southeast", "se"), ("southwest", "sw"))
UNITS = ("apt", "apartment", "unit", "suite", "ste", "floor", "fl", "room", "rm", "#", "no", "bldg", "building", "dept")
MATCH_UNITS = ("apartment", "apt", "suite", "ste", "unit", "room", "building", "bldg")

_BLANK = r"\p{IsWhite_Space}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), f"^{_BLANK}+|{_BLANK}+$", "")


def collapsed(c: Column | str) -> Column:
    """Words with one space between them."""
    return trimmed(F.regexp_replace(_col(c), f"{_BLANK}+", " "))


def replaced_word(c: Column, word: str, by: str) -> Column:
    """Replace ``word`` where it stands alone; an occurrence right after another one counts as a word start."""
    # the literal comes first, so that most places are passed over by its first letter
    return F.regexp_replace(c, f"{word}(?<=(?:^|[^0-9A-Za-z]|{word}){word})(?![0-9A-Za-z])", by)


def without_words(c: Column, words: list[str], by: str) -> Column:
    """Replace each of ``words`` where it stands alone, in one pass. No word may end with another one of them."""
    first = "".join(sorted({w[0] for w in words}))
    alone = "|".join(f"{w}(?<=(?:^|[^0-9A-Za-z]|{w}){w})" for w in words)
    return F.regexp_replace(c, f"(?=[{first}])(?:{alone})(?![0-9A-Za-z])", by)


def _where_any(c: Column, words, change) -> Column:
    """``change`` applied to texts that hold one of ``words`` anywhere; the others are passed over in one look."""
    return F.when(c.rlike("|".join(words)), change(c)).otherwise(c)


def _without_unit(c: Column, word: str) -> Column:
    """Cut the first occurrence of a designator, if it stands alone, with the token after it."""
    before = f"(?s)^(?>(.*?){word})(?<=(?:^|[^0-9A-Za-z]){word})(?![0-9A-Za-z]){_BLANK}*[^{_BLANK}]*"
    return F.regexp_replace(c, before, "$1 ")


def normalize_for_match(c: Column | str) -> Column:
    """The key that queries and records are matched by: lower case, no dots, commas, directions or units, short suffixes."""
    out = F.replace(F.replace(F.replace(F.lower(_col(c)), F.lit("."), F.lit("")), F.lit(","), F.lit(" ")), F.lit("#"), F.lit(" "))
    for pairs in (DIRECTIONS[:4], DIRECTIONS[4:]):  # the last four end with words of the first
        out = without_words(out, [word for pair in pairs for word in pair], " ")
    out = _where_any(out, MATCH_UNITS, lambda c: reduce(_without_unit, MATCH_UNITS, c))
    out = _where_any(out, [long for long, _ in SUFFIXES], lambda c: reduce(lambda x, pair: replaced_word(x, *pair), SUFFIXES, c))
    return collapsed(out)


def normalize_address(c: Column | str) -> Column:
    """A tidy form for display and storage; commas stay."""
    out = F.replace(F.replace(F.lower(_col(c)), F.lit("."), F.lit("")), F.lit("#"), F.lit(" # "))
    for long, short in DIRECTIONS + SUFFIXES:
        out = replaced_word(out, long, short)
    return collapsed(out)


def normalize_street(c: Column | str) -> Column:
    """Suffixes shortened wherever they occur, also inside words, one after another."""
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), SUFFIXES, F.lower(_col(c)))


def split_house_number(c: Column | str) -> tuple[Column, Column]:
    """(number, street): leading digits and the rest, if both are there; else (null, all)."""
    text = _col(c)
    digits = F.regexp_extract(text, "^([0-9]+)", 1)
    rest = trimmed(F.regexp_replace(text, "^[0-9]+", ""))
    some = (digits != "") & (rest != "")
    return F.when(some, digits), F.when(some, rest).otherwise(text)


def address_fields(c: Column | str) -> dict[str, Column]:
    """The fields of parse_address()."""
    full = trimmed(c)
    parts = F.split(full, ",", -1)
    n = F.size(parts)
    at = lambda k: trimmed(F.get(parts, F.lit(k)))
    number, street = split_house_number(at(0))
    return {
        "house_number": F.when(n >= 3, number),
        "street": F.when(n >= 3, street).otherwise(at(0)),
        "city": at(1),
        "state": at(2),
        "postcode": F.when(n >= 5, at(3)),
        "country": F.when(n >= 5, at(4)).when(n == 4, at(3)),
        "full": full,
    }


def _struct(c: Column | str, fields: dict[str, Column]) -> Column:
    return F.when(_col(c).isNotNull(), F.struct(*(value.alias(name) for name, value in fields.items())))


def parse_address(c: Column | str) -> Column:
    """A struct (house_number, street, city, state, postcode, country, full) from comma-separated parts.

    One part is a street; two are street and city; from three on a number is split off the first, and state, then
    country (four) or postcode and country (five and more) follow.
    """
    return _struct(c, address_fields(c))


def unit_fields(c: Column | str) -> dict[str, Column]:
    """The fields of extract_unit()."""
    text = _col(c)
    lower = F.lower(text)
    rest, unit = text, F.lit(None).cast("string")
    for word in reversed(UNITS):
        at = F.instr(lower, word)
        before = trimmed(F.regexp_replace(trimmed(F.substring(text, F.lit(1), at - 1)), ",+$", ""))
        after = F.regexp_replace(trimmed(F.substring(text, at + len(word), F.length(text))), "^[. :]+", "")
        own = trimmed(F.regexp_extract(after, "(?s)^([^, ]*)", 1))
        found = (at > 0) & (own != "")
        rest, unit = F.when(found, before).otherwise(rest), F.when(found, own).otherwise(unit)
    return {"rest": rest, "unit": unit}


def extract_unit(c: Column | str) -> Column:
    """A struct (rest, unit): the token after the first designator, in the order of UNITS, that has one.

    Designators are found inside words too.
    """
    return _struct(c, unit_fields(c))


def detect_format(c: Column | str) -> Column:
    """European if the last of several parts starts like a postcode, Japanese with CJK characters, else NorthAmerican."""
    text = trimmed(c)
    parts = F.split(text, ",", -1)
    last = trimmed(F.element_at(parts, -1))
    european = (F.size(parts) >= 2) & (F.octet_length(last) >= 4) & last.rlike("^(?:[0-9]{5}|[0-9]{4}$)")
    return F.when(text.isNull(), None).when(european, "European").when(text.rlike(r"[\x{3000}-\x{9FFF}]"), "Japanese").otherwise("NorthAmerican")


def soundex(c: Column | str) -> Column:
    """A Soundex in which every letter without a code, h and w too, ends a run of equal codes; "0000" without ASCII letters."""
    letters = F.lower(F.regexp_replace(_col(c), "[^A-Za-z]", ""))
    codes = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "01230120022455012623010202")
    tail = F.regexp_replace(F.substring(F.regexp_replace(codes, r"(.)\1+", "$1"), 2, 1_000_000_000), "0", "")
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.upper(F.substring(letters, 1, 1)), F.substring(tail, 1, 3)), 4, "0"))


def similarity(a: Column, b: Column, distance: Column) -> Column:
    """1 - distance / length of the longer text in bytes; 1 for two empty texts."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - distance / longest)


def parsed_float(c: Column | str) -> Column:
    """A double by a strict grammar: no blanks around, no type suffix; inf, infinity and nan in any case; null if it is none."""
    text = _col(c)
    number = r"(?i)^[+-]?(?:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)$"
    return F.when(text.rlike(number), text.try_cast("double"))


def osm_full_text(number: Column, street: Column, city: Column, state: Column, postcode: Column, country: Column, name: Column) -> Column:
    """The text of an OpenStreetMap object: its address parts, led by a name that is not its street."""
    parts = F.concat_ws(", ", *(F.nullif(c, F.lit("")) for c in (number, street, city, state, postcode, country)))
    named = name.isNotNull() & ~name.eqNullSafe(street)
    return F.when(parts == "", F.coalesce(name, F.lit(""))).when(named, F.concat(name, F.lit(", "), parts)).otherwise(parts)


def csv_full_text(number: Column, street: Column, city: Column, region: Column) -> Column:
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (number, street, city, region)))
