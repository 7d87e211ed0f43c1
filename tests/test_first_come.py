"""The cascades against one row after the other in plain Python."""

import random
import re

import pytest

from ladderspark.operators import first_come as C


def rotations(name):
    p = name.split(" ")
    if len(p) < 2:
        return []
    return list(dict.fromkeys([" ".join([p[-1], *p[:-1]]), " ".join([*p[1:], p[0]])]))


def one_by_one_handlers(rows, dim, alias):
    dim, alias, out, created = [list(d) for d in dim], dict(alias), {}, {}
    top = max([d[0] for d in dim], default=-1)
    for raw, country, seq in rows:
        if (raw, country) in out:
            continue
        norm = raw
        exact = [d[0] for d in dim if d[1] == norm and d[2] == country]
        same = [d[0] for d in dim if d[1] == norm]
        inside = [d[0] for d in dim if d[2] == country and d[1] != norm and d[1] and (norm in d[1] or d[1] in norm)]
        two = " " in norm
        if norm in alias:
            out[raw, country] = ("alias", alias[norm])
        elif exact:
            out[raw, country] = ("exact", min(exact))
        elif two and len(same) == 1:
            out[raw, country] = ("name", same[0])
        elif two and len(norm) >= 10 and len(inside) == 1:
            out[raw, country] = ("containment", inside[0])
            alias[norm] = created[norm] = inside[0]
        else:
            top += 1
            dim.append([top, norm, country])
            out[raw, country] = ("new", top)
            for r in rotations(norm):
                if r not in alias:
                    alias[r] = created[r] = top
    return out, created


@pytest.mark.parametrize("seed", [0, 1])
def test_handlers_match_what_earlier_rows_created(spark, seed):
    rng = random.Random(seed)
    first, last = ["john", "mary", "adrian", "li", "klementyna"], ["smith", "bajo", "alonso", "wu", "nowakowska"]
    name = lambda: " ".join(rng.sample(first, rng.choice([0, 1, 1, 2])) + rng.sample(last, rng.choice([1, 1, 2, 2])))
    rows = [(name(), rng.choice(["GB", "CZ", "ES"]), i * 3) for i in range(260)]
    dim = [(i * 2, n, rng.choice(["GB", "CZ", "ES"])) for i, n in enumerate(sorted({name() for _ in range(14)}))]
    alias = [("nick", 4), (rows[0][0], 2), ("smith john", 6)]
    want, made = one_by_one_handlers(rows, dim, alias)
    got, new, aliases = C.resolve_handlers(
        spark.createDataFrame(rows, "raw string, country string, _seq bigint").repartition(5), spark.createDataFrame(dim, "id bigint, norm string, country string"),
        spark.createDataFrame(alias, "alias_name string, canonical_id bigint"))
    assert {(r.raw, r.country): (r.stage, r.handler_id) for r in got.collect()} == want
    assert {r.alias_name: r.canonical_id for r in aliases.collect()} == made
    assert sorted(r.id for r in new.collect()) == sorted(i for s, i in want.values() if s == "new")
    assert {s for s, _ in want.values()} == {"alias", "exact", "name", "containment", "new"}


def contained(a, b):
    short, long = sorted((a, b), key=len)
    return a != b and len(short) >= 3 and re.search(rf"(?<!\w){re.escape(short)}(?!\w)", long) is not None


def one_by_one_entities(rows, dim, owned, alias):
    """rows: (handler_id, raw, size, seq, clean, full, call, reg) in their order."""
    dim, alias, out, created = [list(d) for d in dim], dict(alias), {}, {}
    mine = {}
    for h, i in owned:
        mine.setdefault(h, set()).add(i)
    top = max([d[0] for d in dim], default=-1)
    near = lambda a, b: a == b or {a, b} in ({"S", "M"}, {"I", "L"})
    for h, raw, size, seq, clean, full, call, reg in rows:
        tries = [n for n in (call, full, reg) if n is not None]
        own = mine.setdefault(h, set())
        aliased = [alias[n] for n in tries if n in alias]
        named = [d[0] for n in tries for d in dim if d[3] == size and n and n in (d[1], d[2])]
        by_id = {d[0]: d for d in dim}
        fuzzy = [i for i in own if i in by_id and near(size, by_id[i][3]) and any(
            len(n) >= 3 and d and (n == d or contained(n, d)) for n in tries for d in by_id[i][1:3])]
        specific = len(full) > 10 or len(reg or "") > 10
        write = True
        if [i for i in aliased if i in own]:
            stage, to, write = "own alias", [i for i in aliased if i in own][0], False
        elif [i for i in named if i in own]:
            stage, to = "own exact", [i for i in named if i in own][0]
        elif len(fuzzy) == 1:
            stage, to = "own fuzzy", fuzzy[0]
        elif (aliased or named) and specific:
            stage, to = "global", (aliased or named)[0]
        else:
            top += 1
            stage, to = "new", top
            long = call is None and len(clean.split(" ")) >= 3
            dim.append([top, "" if long else call or full, full if long else reg or (full if call else ""), size])
        if write:
            canon = next(d[1] for d in dim if d[0] == to)
            for n in {full, call, reg} - {None, canon}:
                if n.strip() and n not in alias:
                    alias[n] = created[n] = to
        own.add(to)
        out[h, raw, size] = (stage, to)
    return out, created


@pytest.mark.parametrize("seed", [0, 1])
def test_entities_match_what_earlier_rows_created(spark, seed):
    rng = random.Random(seed)
    calls, kennels = ["Rex", "Day", "Berta", "Lis", "Golden Star"], ["z Kojca Coli", "of the hill", "von Borealis", "neverending"]

    def raw():
        c, k = rng.choice(calls), rng.choice(kennels)
        return rng.choice([c, c, f"{c} {k}", f"{rng.choice(calls)} {k} ({c})", f'{c} {k} "{rng.choice(calls)}"', k])

    rows = [(rng.randrange(9), raw(), rng.choice("SMIL"), i * 2) for i in range(240)]
    dim = [(0, "rex", "rex of the hill", "L"), (3, "day", "", "S"), (5, "", "berta z kojca coli", "M"), (9, "lis", "", "I")]
    owned, alias = [(0, 0), (1, 3), (1, 5), (2, 9)], [("golden star of the hill", 0), ("sunny", 3)]
    got, new, aliases = C.resolve_entities(
        spark.createDataFrame(rows, "handler_id bigint, raw string, size string, _seq bigint").repartition(5), spark.createDataFrame(dim, "id bigint, call_norm string, reg_norm string, size string"),
        spark.createDataFrame(owned, "handler_id bigint, id bigint"), spark.createDataFrame(alias, "alias_name string, canonical_id bigint"))
    got = got.collect()
    want, made = one_by_one_entities(sorted([tuple(r)[:8] for r in got], key=lambda r: r[3]), dim, owned, alias)
    assert {(r.handler_id, r.raw, r.size): (r.stage, r.id) for r in got} == want
    assert {r.alias_name: r.canonical_id for r in aliases.collect()} == made
    assert sorted(r.id for r in new.collect()) == sorted(i for s, i in want.values() if s == "new")
    assert {s for s, _ in want.values()} >= {"own alias", "own exact", "own fuzzy", "new"}


def test_nothing_to_resolve(spark):
    none = spark.createDataFrame([], "raw string, country string, _seq bigint")
    dim, alias = spark.createDataFrame([], "id bigint, norm string, country string"), spark.createDataFrame([], "alias_name string, canonical_id bigint")
    assert [d.count() for d in C.resolve_handlers(none, dim, alias)] == [0, 0, 0]
    one = spark.createDataFrame([(None, None, 4)], "raw string, country string, _seq bigint")
    got, new, aliases = C.resolve_handlers(one, dim, alias)
    assert [(r.raw, r.stage, r.handler_id) for r in got.collect()] == [("", "new", 0)] and new.count() == 1 and aliases.count() == 0
