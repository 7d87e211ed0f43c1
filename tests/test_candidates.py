"""Candidate joins against all pairs, and records cut inside the row."""

import random

import pytest

from ladderspark.functions import parsing as P
from ladderspark.operators import identity as I
from ladderspark.sources import pages as H


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_finds_what_all_pairs_find(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab c") for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 14])))

    def changed(w):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abx") + w[i:], w[:i] + "y" + w[i + 1:]])
        return w

    dim = [(i, "".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 6, 11, 30]))), "X") for i in range(40)] + [(100 + i, word(), "Y") for i in range(8)]
    asked = [(i, changed(rng.choice(dim)[1]), rng.choice("XY")) for i in range(150)]
    got = I.match_edit_distance(spark.createDataFrame(asked, "key bigint, norm string, country string"), spark.createDataFrame(dim, "id bigint, norm string, country string"))
    want = {}
    for k, n, c in asked:
        near = [i for i, other, cc in dim if cc == c and other != n and edits(n, other) <= 2]
        want[k] = near[0] if len(near) == 1 else None
    assert {r.key: r.edit_id for r in got.collect()} == want and len(set(want.values())) > 5


def test_text_records_stay_in_their_rows(spark):
    rows = [("a", "x\n1º\n p \n\nq\n2º\nr"), ("a", "9º\nz"), ("b", None), ("c", ""), ("d", "no start\nat all"), (None, "3º"), ("e", "1º\n" + "\n".join(f"l{i}" for i in range(12)) + "\n2º\n3º\nm")]
    d = H.text_block_records(spark.createDataFrame(rows, "k string, t string"), "k", "t", "^\\d+º$")
    assert "Exchange" not in d._jdf.queryExecution().executedPlan().toString()
    got = [tuple(x for x in r if x is not None) for r in d.collect()]
    assert sorted(got, key=str) == sorted([
        ("a", 1, "1º", "p", "q"), ("a", 2, "2º", "r"), ("a", 1, "9º", "z"), (1, "3º"),
        ("e", 1, "1º", *[f"l{i}" for i in range(7)]), ("e", 2, "2º"), ("e", 3, "3º", "m")], key=str)


@pytest.mark.parametrize("known", [["Collie", "Border Collie", "Mudi", "Border"], ["a"], []])
def test_dictionary_suffixes(spark, known):
    rows = [(0, "Rex Border Collie"), (1, "Collie"), (2, "Rex Collie"), (3, "Mudi Collie"), (4, "Border Collie Rex"), (5, "nothing"), (6, ""), (7, None), (8, "Rex Border Collie"), (9, "Rexa")]
    d = spark.createDataFrame(rows, "k int, t string")
    words = spark.createDataFrame([(w, i) for i, w in enumerate(known)] + [("", 99), (None, 98)], "value string, place int")
    got = {r.k: (r.rest, r.suffix) for r in P.cut_known_suffix_of(d, "t", words).collect()}
    assert got[7] == (None, None)
    for k, t in rows:
        if t is None:
            continue
        start = [w for w in known if t.startswith(w)]
        end = [w for w in sorted(known, key=len, reverse=True) if t.endswith(w)]
        assert got[k] == (("", start[0]) if start else (t[:len(t) - len(end[0])].strip(), end[0]) if end else (t, ""))


def test_index_finds_what_the_scan_finds(spark):
    import datetime

    from pyspark.sql import functions as F

    from ladderspark.operators import search as S
    from ladderspark.storage import new_path

    rng = random.Random(9)
    board = spark.createDataFrame([(i, f"Jan {rng.choice(['Novák', 'Nova', 'Banana'])} {i % 7}", f"rex {i % 5}", "CZ", 1000.0 + i) for i in range(60)], "team_id bigint, handler string, dog string, country string, rating double")
    board = board.withColumns({"handler_norm": F.lower("handler"), "dog_norm": F.lower("dog")})
    comps = spark.createDataFrame([(i, f"Banana Cup {i}", datetime.date(2024, 1, 1 + i)) for i in range(12)], "comp_id bigint, name string, date date")
    path = new_path(spark, "index")
    S.write_index(board, comps, path)
    for query in ("anana", "an", "rex 3", "CUP 1", "", "a", "nováa", "zzz", "a b"):
        assert S.search_index(spark, path, query).collect() == S.search(board, comps, query).collect(), query
    plan = S.search_index(spark, path, "anana")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_people_of_one_name_are_no_candidates_of_each_other(spark):
    tag = lambda i: "".join("abcdefghij"[int(d)] for d in f"{i * 79190123 % 10**8:08d}")
    rows = [(i, f"katerina tricova {tag(i)}", "cz") for i in range(300)]
    names, others = spark.createDataFrame(rows, "key bigint, norm string, country string"), spark.createDataFrame(rows, "id bigint, other string, country string")
    assert 300 <= I.edit_candidates(names, others).count() < 3000  # all that share a first name: 90,000
