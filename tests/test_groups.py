"""Names and entities of small groups are walked through at once; large groups and names of other scripts go by rounds."""

import random

import pytest
from test_first_come import one_by_one_entities, one_by_one_handlers

from ladderspark.operators import first_come as C


def entities(spark, rows, dim, owned, alias):
    got, _, aliases = C.resolve_entities(
        spark.createDataFrame(rows, "handler_id bigint, raw string, size string, _seq bigint"), spark.createDataFrame(dim, "id bigint, call_norm string, reg_norm string, size string"),
        spark.createDataFrame(owned, "handler_id bigint, id bigint"), spark.createDataFrame(alias, "alias_name string, canonical_id bigint"))
    got = sorted(got.collect(), key=lambda r: r._seq)
    want, made = one_by_one_entities([tuple(r)[:8] for r in got], dim, owned, alias)
    assert {(r.handler_id, r.raw, r.size): (r.stage, r.id) for r in got} == want
    assert {r.alias_name: r.canonical_id for r in aliases.collect()} == made
    return want


@pytest.fixture
def rounds(monkeypatch):
    """Rows of each round."""
    seen, decide = [], C._decide_entities
    monkeypatch.setattr(C, "_decide_entities", lambda rows, *rest: seen.append(rows.count()) or decide(rows, *rest))
    return seen


def some(rng, families, n):
    calls, kennels = ["Rex", "Day", "Lis", "Golden Star"], ["z Kojca", "of the hill", "neverending"]

    def raw(f):
        c, k = rng.choice(calls), rng.choice(kennels)
        return rng.choice([f"{c} {f}", f"{c} {f} {k}", f"{c} {f} {k} ({rng.choice(calls)} {f})", f'{k} {f} "{c} {f}"'])

    return [(rng.randrange(2) + 2 * f, raw("abcdefgh"[f] * 3), rng.choice("SMIL"), i * 2) for i in range(n) for f in [rng.randrange(families)]]


def test_small_groups_take_no_rounds(spark, rounds):
    rows = some(random.Random(3), 6, 150)
    want = entities(spark, rows, [(0, "rex aaa", "rex aaa of the hill", "L"), (3, "day bbb", "", "S"), (5, "", "golden star", "M")], [(0, 0), (2, 3), (9, 5)], [("lis ccc neverending", 5), ("sunny", 3)])
    assert {s for s, _ in want.values()} == {"own alias", "own exact", "own fuzzy", "global", "new"}
    assert rounds == []


def test_a_large_group_and_other_scripts_go_by_rounds(spark, rounds, monkeypatch):
    monkeypatch.setattr(C, "SMALL", 30)
    rng = random.Random(5)
    rows = [r for r in some(rng, 4, 80) if r[0] > 3 or r[3] < 40] + [(100 + i % 2, n, "L", 500 + i) for i, n in enumerate(["Жук z Kojca", "Жук", "Жук", "Rex жук z"])]
    rows += [(200 + i, "Rex", "L", 600 + i) for i in range(40)]
    entities(spark, rows, [(0, "rex aaa", "rex aaa of the hill", "L"), (7, "rex", "", "L")], [(0, 0), (201, 7)], [("rex", 7)])
    assert rounds and 40 < rounds[0] < len({r[:3] for r in rows})


def test_a_long_line_of_groups_is_left_to_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "_ROUNDS", 2)
    rows = [(i // 2, f"Name {'abcdefghijkl'[(i + 1) // 2]} z Kojca", "L", i) for i in range(24 - 1)] + [(50, "Alone", "S", 90)]
    entities(spark, rows, [], [], [])


@pytest.mark.parametrize("small", [500, 12])
def test_names_of_small_groups_take_no_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(C, "SMALL", small)
    rounds, decide = [], C._decide_handlers
    monkeypatch.setattr(C, "_decide_handlers", lambda rows, *rest: rounds.append(rows.count()) or decide(rows, *rest))
    rng = random.Random(7)
    words = ["john", "mary", "adrian", "smith", "alonso", "li"]

    def name(f):
        some = rng.sample(words, rng.choice([1, 1, 2, 3]))
        some.insert(rng.randrange(len(some) + 1), f"{'abcdefgh'[f] * 3}czak")
        return " ".join(some)

    rows = [(name(f), rng.choice(["GB", "CZ", "ES"]), i * 3) for i in range(150) for f in [min(rng.randrange(10), 7)]]
    dim = [(i * 2, n, rng.choice(["GB", "CZ"])) for i, n in enumerate(sorted({name(i % 8) for i in range(12)}))]
    alias = [("nick", 4), (rows[0][0], 2)]
    want, made = one_by_one_handlers(rows, dim, alias)
    got, _, aliases = C.resolve_handlers(
        spark.createDataFrame(rows, "raw string, country string, _seq bigint"), spark.createDataFrame(dim, "id bigint, norm string, country string"), spark.createDataFrame(alias, "alias_name string, canonical_id bigint"))
    assert {(r.raw, r.country): (r.stage, r.handler_id) for r in got.collect()} == want
    assert {r.alias_name: r.canonical_id for r in aliases.collect()} == made
    assert {s for s, _ in want.values()} >= {"alias", "name", "containment", "new"}
    assert len(rounds) == 1 if small == 500 else len(rounds) > 1 and 0 < rounds[0] < rounds[-1]
