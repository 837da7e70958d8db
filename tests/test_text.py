import random

import pytest
from pyspark.sql import functions as F

from placebook.functions import text as t


def word_boundary(c):
    return not (c.isascii() and c.isalnum())


def model_replace_word(s, word, by):
    """Left to right; an occurrence right after another one counts as a word start."""
    out, i, start = "", 0, 0
    while (at := s.find(word, i)) >= 0:
        end = at + len(word)
        before = at == start or word_boundary(s[at - 1])
        after = end >= len(s) or word_boundary(s[end])
        out += s[i:at] + (by if before and after else word)
        i = start = end
    return out + s[i:]


def blank(c):
    return c.isspace() and c not in "\x1c\x1d\x1e\x1f"


def model_collapse(s):
    out, word = [], ""
    for c in s + " ":
        if blank(c):
            out += [word] if word else []
            word = ""
        else:
            word += c
    return " ".join(out)


def model_match(s):
    s = s.lower().replace(".", "").replace(",", " ").replace("#", " ")
    for long, short in t.DIRECTIONS:
        s = model_replace_word(model_replace_word(s, long, " "), short, " ")
    for d in t.MATCH_UNITS:
        at = s.find(d)
        end = at + len(d)
        if at >= 0 and (at == 0 or word_boundary(s[at - 1])) and (end >= len(s) or word_boundary(s[end])):
            rest = s[end:]
            while rest and blank(rest[0]):
                rest = rest[1:]
            while rest and not blank(rest[0]):
                rest = rest[1:]
            s = s[:at] + " " + rest
    for long, short in t.SUFFIXES:
        s = model_replace_word(s, long, short)
    return model_collapse(s)


def model_address(s):
    s = s.lower().replace(".", "").replace("#", " # ")
    for long, short in t.DIRECTIONS + t.SUFFIXES:
        s = model_replace_word(s, long, short)
    return model_collapse(s)


def model_soundex(s):
    letters = [c.lower() for c in s if c.isascii() and c.isalpha()]
    if not letters:
        return "0000"
    code = dict(zip("abcdefghijklmnopqrstuvwxyz", "01230120022455012623010202"))
    out, last = letters[0].upper(), code[letters[0]]
    for c in letters[1:]:
        if code[c] != "0" and code[c] != last:
            out += code[c]
        last = code[c]
    return (out + "000")[:4]


def odd_texts(n=1500):
    rng = random.Random(6)
    bits = [*(w for pair in t.DIRECTIONS + t.SUFFIXES for w in pair), *t.UNITS, "lynn", "ross", "king's", "123", "4b", "ü", "日本", "_", "İ", ",", ".", "#", " ", "  ", "\t", " ", "　", "x"]
    return ["", " ", "N", "apt, Springfield", *("".join(rng.choice(bits) + rng.choice(["", " ", " "]) for _ in range(rng.randint(1, 9))) for _ in range(n))]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, x) for k, x in enumerate(odd_texts())], "id long, t string").cache()


@pytest.mark.parametrize(("make", "model"), [(t.normalize_for_match, model_match), (t.normalize_address, model_address), (t.soundex, model_soundex)])
def test_against_models(odd, make, model):
    for r in odd.select("t", make("t").alias("x")).collect():
        assert r.x == model(r.t), r.t


def one(spark, make, *values):
    return [r.x for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, t string").select("id", make("t").alias("x")).orderBy("id").collect()]


def test_normalisers_by_hand(spark):
    assert one(spark, t.normalize_for_match, "N", "main s", "Main Stre", "apt, Springfield", "King's Rd", "123 North Main Street Apt 4, Springfield, IL", None) == ["", "main", "main stre", "", "king' rd", "123 main st springfield il", None]
    assert one(spark, t.normalize_street, "Broadway", "Main Street") == ["brdwy", "main st"]
    assert one(spark, t.normalize_address, "1 North Main Street, Apt #5") == ["1 n main st, apt # 5"]


def test_parse(spark):
    rows = one(spark, t.parse_address, "Main St", " Main St , Town ", "12 Main St, Town, IL", "12 Main St, Town, IL, US", "12 Main St, Town, IL, 62701, US, more", "221B Baker Street, London, UK", "12, a, b", "a,,b", "", None)
    get = lambda r: (r.house_number, r.street, r.city, r.state, r.postcode, r.country, r.full)
    assert get(rows[0]) == (None, "Main St", None, None, None, None, "Main St")
    assert get(rows[1]) == (None, "Main St", "Town", None, None, None, "Main St , Town")
    assert get(rows[2])[:6] == ("12", "Main St", "Town", "IL", None, None)
    assert get(rows[3])[:6] == ("12", "Main St", "Town", "IL", None, "US")
    assert get(rows[4])[:6] == ("12", "Main St", "Town", "IL", "62701", "US")
    assert get(rows[5])[:2] == ("221", "B Baker Street") and get(rows[6])[:2] == (None, "12")
    assert get(rows[7])[1:4] == ("a", "", "b") and get(rows[8]) == (None, "", None, None, None, None, "") and rows[9] is None


def test_units_and_formats(spark):
    units = one(spark, t.extract_unit, "123 Main St, Apt 4B, Town", "123 Main St #12", "123 North St", "1 Main Suite: 7", "plain", "Apt", None)
    assert [(u.rest, u.unit) if u else None for u in units] == [("123 Main St", "4B"), ("123 Main St", "12"), ("123", "rth"), ("1 Main", "7"), ("plain", None), ("Apt", None), None]
    assert one(spark, t.detect_format, "Weg 1, 10115 Berlin", "Weg 1, 1010", "Weg 1, 1010 Wien", "12 Main, Town, 62701", "東京都", "12 Main, Town", None) == ["European", "European", "NorthAmerican", "European", "Japanese", "NorthAmerican", None]


def test_codes_and_numbers(spark):
    assert one(spark, t.soundex, "Robert", "Rupert", "Smith", "Smyth", "123", "Ashcraft") == ["R163", "R163", "S530", "S530", "0000", "A226"]
    assert one(spark, t.parsed_float, "1.5", " 1 ", "1.0d", "1.", ".5", "1e5", "", "abc", "+2", None) == [1.5, None, None, 1.0, 0.5, 1e5, None, None, 2.0, None]
    assert one(spark, t.parsed_float, "inf", "-Infinity")[0] == float("inf") and str(one(spark, t.parsed_float, "NaN")[0]) == "nan"
    assert one(spark, lambda c: F.levenshtein(F.col(c), F.lit("kitten")), "sitting", "ikttne", "ünkitten") == [3, 4, 2]


def test_osm_text(spark):
    rows = [("1", "Main", "Town", None, "", "US", "Main"), ("1", "Main", None, None, None, None, "Cafe"), (None, None, None, None, None, None, "Cafe"), (None,) * 7, ("1", None, None, None, None, None, "")]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, a string, b string, c string, d string, e string, f string, g string").select("id", t.osm_full_text(*map(F.col, "abcdefg")).alias("x"))
    assert [r.x for r in got.orderBy("id").collect()] == ["1, Main, Town, US", "Cafe, 1, Main", "Cafe", "", ", 1"]


def test_sql_functions(spark):
    from placebook.functions.sql import register

    assert "normalize_for_match" in register(spark)
    assert spark.sql("select normalize_for_match('1 North Main Street') as a, address_soundex('Robert') as b, strict_double(' 1') as c").first() == ("1 main st", "R163", None)
    assert spark.sql("select parse_address('12 Oak St, Town, IL').house_number as a, extract_unit('1 Main St Apt 5, Town').unit as b, parse_address(null) is null as c").first()[:2] == ("12", "5")
    assert not hasattr(__import__("placebook.functions.sql", fromlist=["sql"]), "_sql")
