import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ladderspark.operators import identity as I
from ladderspark.operators.rounds import unique_slugs
from ladderspark.operators.scan import row_numbers, running_sums


def names(n, seed, words=("anna", "bo", "carlo", "day", "eva", "maria", "x")):
    rnd = random.Random(seed)
    return sorted({" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n)})


def test_row_numbers_and_sums_equal_a_window(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice([1.0, 2.5, 2.5, 9.0]), i) for i in range(400)]
    d = spark.createDataFrame(rows, "g string, v double, id bigint")
    order = [F.col("v").desc(), F.col("id")]
    w = Window.partitionBy("g").orderBy(*order)
    want = d.select("id", F.row_number().over(w).alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = running_sums(row_numbers(d, ["g"], order, "n"), ["g"], order, {"s": F.col("v")}).select("id", "n", "s")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_containment_equals_brute_force(spark):
    dim = [(i, n, "A" if i % 3 else "B") for i, n in enumerate(names(60, 1))]
    asked = [(1000 + i, n, c) for i, n in enumerate(names(60, 2)) for c in "AB"]
    asked = [(k * 2 + (c == "B"), n, c) for k, n, c in asked]
    d = spark.createDataFrame(dim, "id bigint, norm string, country string")
    a = spark.createDataFrame(asked, "key bigint, norm string, country string")
    got = {r.key: r.contained_id for r in I.match_containment(a, d).collect()}
    for key, n, c in asked:
        hits = [i for i, m, cc in dim if cc == c and m != n and (m in n or n in m)]
        want = hits[0] if len(hits) == 1 and len(n) >= 10 and " " in n else None
        assert got[key] == want, (n, c)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6)))
    dim = list(enumerate(sorted({word() for _ in range(25)})))
    asked = list(enumerate(sorted({word() for _ in range(25)})))
    d = spark.createDataFrame([(i, n, "A") for i, n in dim], "id bigint, norm string, country string")
    a = spark.createDataFrame([(i, n, "A") for i, n in asked], "key bigint, norm string, country string")
    got = {r.key: r.edit_id for r in I.match_edit_distance(a, d).collect()}
    for key, n in asked:
        hits = [i for i, m in dim if m != n and distance(n, m) <= 2]
        assert got[key] == (hits[0] if len(hits) == 1 else None), n


def test_cascade_stages(spark):
    dim = spark.createDataFrame(
        [(1, "Ann Smith", "ann smith", "GBR"), (2, "Adrian Bajo Alonso", "adrian bajo alonso", "ESP"), (3, "Bo Li", "bo li", "CHN")],
        "id bigint, name string, norm string, country string")
    alias = spark.createDataFrame([("annie", 1)], "alias_name string, canonical_id bigint")
    rows = [("Annie", "USA"), ("Smith, Ann", "GBR"), ("Bo Li", "USA"), ("Adrian Bajo", "ESP"), ("New One", "CZE"), ("new  one", "CZE"), ("Martin", "CZE")]
    d = spark.createDataFrame([(r, c, i) for i, (r, c) in enumerate(rows)], "raw string, country string, _seq bigint")
    got = {r.raw: (r.stage, r.handler_id) for r in I.resolve_handlers(d, dim, alias).collect()}
    assert got == {"Annie": ("alias", 1), "Smith, Ann": ("exact", 1), "Bo Li": ("name", 3), "Adrian Bajo": ("containment", 2),
                   "New One": ("new", 4), "new  one": ("new", 4), "Martin": ("new", 5)}


def test_variants_of_one_handler(spark):
    rows = [("h", "day", None), ("h", "daylight neverending force", "daylight neverending force"), ("h", "crocodile", None),
            ("h", "a3ch big crocodile yabalute", "a3ch big crocodile yabalute"), ("h", "gold of hill one", "gold of hill one"),
            ("h", "x gold of hill two three", "x gold of hill two three"), ("g", "daylight other", None)]
    d = spark.createDataFrame(rows, "handler string, dog string, reg string")
    got = {(r.handler, r.dog): r.target for r in I.merge_variants(d).collect()}
    assert got == {("h", "daylight neverending force"): "day", ("h", "a3ch big crocodile yabalute"): "crocodile",
                   ("h", "x gold of hill two three"): "gold of hill one"}


def test_chains_reach_their_end(spark):
    d = spark.createDataFrame([("h", str(i), str(i + 1)) for i in range(20)], "handler string, dog string, target string")
    assert {r.target for r in I.resolve_chains(d).collect()} == {"20"}


def test_slugs_are_unique(spark):
    d = spark.createDataFrame([("ann", 1), ("ann", 2), ("bo", 3), ("ann-2", 4), ("ann", 5)], "base string, k bigint")
    old = spark.createDataFrame([("bo",), ("bo-2",)], "slug string")
    got = {r.k: r.slug for r in unique_slugs(d, "base", "k", old).collect()}
    assert got[1] == "ann" and got[3] == "bo-3" and len(set(got.values()) | {"bo", "bo-2"}) == 7
