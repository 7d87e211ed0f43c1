import pytest
from pyspark.sql import functions as F

from ladderspark.functions import names as N
from ladderspark.functions import values as V


def column(spark, f, values):
    rows = list(enumerate(values))
    d = spark.createDataFrame(rows, "i int, v string").select("i", f(F.col("v")).alias("o"))
    return [r.o for r in d.orderBy("i").collect()]


def pairs(spark, f, values):
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(values)], "i int, a string, b string")
    return [r.o for r in d.select("i", f(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]


def test_normalize_name(spark):
    cases = {
        "tab\there": "tab here", "   ": "", "Kateřina Třičová": "katerina tricova", "Łukasz Wójcik": "lukasz wojcik",
        "Tercova, Katerina": "katerina tercova", "A, B, C": "a, b, c", "Kerek-Ful": "kerek ful", "Nova`s": "nova's",
        "word word word": "word", "hello hello world": "hello world", "Straße": "strasse", "a ab ab": "a ab",
    }
    assert column(spark, N.normalize_name, list(cases)) == list(cases.values())


def test_word_contained(spark):
    cases = [("berta", "berta z kojca coli", True), ("lis", "borealis", False), ("berta", "berta", False),
             ("ab", "ab cde", False), ("day", "daylight neverending", False), ("day", "birth day party", True)]
    assert pairs(spark, N.word_contained, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_size_compatible(spark):
    yes = ["SS", "SM", "MS", "IL", "LI"]
    no = ["SI", "SL", "MI", "ML"]
    got = pairs(spark, N.size_compatible, [tuple(p) for p in yes + no])
    assert got == [True] * len(yes) + [False] * len(no)


def test_rotations(spark):
    got = column(spark, N.name_rotations, ["smith", "john smith", "de groote andy", ""])
    assert got == [[], ["smith john"], ["andy de groote", "groote andy de"], []]


def test_call_names(spark):
    got = column(spark, N.extract_call_name, ["Daylight Neverending Force (Day)", 'Shadow of Aire "Ninja"', "Day", "Let's Rock (FCI)", "(Day)"])
    assert [(g.call_name, g.registered_name) for g in got] == [
        ("Day", "Daylight Neverending Force"), ("Ninja", "Shadow of Aire"), (None, None), (None, None), ("Day", None)]


def test_entity_names(spark):
    got = column(spark, N.parse_entity_name, ["Shepworld I'm On Fire (Brant)", 'Finrod Frances Wonderfull "Cis"', "Day", "SHEPWORLD I WANT IT ALL (cp)", "A Long Unknown Name"])
    assert [(g.call_name, g.registered_name) for g in got] == [
        ("brant", "shepworld i'm on fire"), ("cis", "finrod frances wonderfull"), ("day", ""),
        ("katniss", "shepworld i want it all"), ("", "a long unknown name")]


def test_slug_and_clean(spark):
    assert column(spark, N.slugify, ["Kateřina  Třičová!", "--a--b--", ""]) == ["katerina-tricova", "a-b", ""]
    assert column(spark, N.clean_entity_name, ["A3Ch Dagny Ballarat (cp)", "Ag Ch Bibbien", "BECKY G (None)"]) == ["Dagny Ballarat", "Bibbien", "BECKY G"]


def test_natural_key_orders_numbers(spark):
    d = spark.createDataFrame([("r_10",), ("r_2",), ("r",)], "v string")
    assert [r.v for r in d.orderBy(N.natural_key(F.col("v"))).collect()] == ["r", "r_2", "r_10"]


@pytest.mark.parametrize("org,cat,size,excluded", [
    (None, "xs", "S", False), ("AKC", '16"', "M", False), ("akc", "20 Preferred", None, True), ("USDAA", "22", "L", False),
    ("WAO", "400", "I", False), ("IFCS", "i", None, False), ("UKI", "i", "I", False), ("ABC", "S", None, False)])
def test_map_category(spark, org, cat, size, excluded):
    d = spark.createDataFrame([(org, cat)], "o string, c string").select(V.map_category(F.col("o"), F.col("c")).alias("m"))
    assert tuple(d.first().m) == (size, excluded)
