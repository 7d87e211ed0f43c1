"""Variants of one handler, against a walk through the sorted names."""

import random

from ladderspark.operators import identity as I
from ladderspark.operators.takers import first_takers


def walk(rows):
    """Row after row, in the order of (words, name)."""
    out = {}
    for handler in sorted({r[0] for r in rows}):
        names = sorted({r[1] for r in rows if r[0] == handler}, key=lambda d: (len(d.split(" ")), d))
        regs = {d: [r[2].split(" ") for r in rows if r[:2] == (handler, d) and r[2]] for d in names}
        to = {}
        for at, s in enumerate(names):
            for d in names[at + 1:]:
                if s and len(s.split(" ")) <= 2 and len(s.split(" ")) < len(d.split(" ")) and d.split(" ")[0].startswith(s.split(" ")[0]):
                    to.setdefault(d, s)

        def alike(a, b):
            return any(len(x[:3]) == 3 and x[:3] in [y[i:i + 3] for i in range(3)] or len(y[:3]) == 3 and y[:3] in [x[i:i + 3] for i in range(3)] for x in regs[a] for y in regs[b])

        for at, s in enumerate(names):
            for d in names[at + 1:]:
                if s not in to and d not in to and alike(s, d):
                    to[d] = s
        for s in names:
            for d in names:
                if s and " " not in s and s != d and s not in to and d not in to and any(s in r for r in regs[d]):
                    to[d] = s
        for d in to:
            end = to[d]
            while end in to:
                end = to[end]
            out[handler, d] = end
    return out


def merged(spark, rows):
    return {(r.handler, r.dog): r.target for r in I.merge_variants(spark.createDataFrame(rows, "handler string, dog string, reg string")).collect()}


def test_who_was_taken_takes_nobody(spark):
    """b's registered names touch a's and c's; a and c share nothing, so c stays by itself, and d, which only touches c, goes to c."""
    rows = [("h", "a", "one two three"), ("h", "b", "one two three"), ("h", "b", "four five six"), ("h", "c", "four five six"), ("h", "c", "seven eight nine"), ("h", "d", "seven eight nine")]
    assert merged(spark, rows) == walk(rows) == {("h", "b"): "a", ("h", "d"): "c"}


def test_variants_equal_a_walk(spark):
    draw = random.Random(5)
    words = ["a", "b", "c", "d", "ab", "bc"]
    rows = []
    for handler in ("hot",) * 60 + tuple("hijklmno") * 12:
        dog = " ".join(draw.choices(words, k=draw.choice([1, 1, 2, 3, 4]))) if draw.random() < 0.97 else ""
        rows.append((handler, dog, draw.choice([None, "", " ".join(draw.choices(words, k=draw.randint(1, 6)))])))
    rows += rows[:10] + [(None, "a", "a b c"), ("h", None, "a b c")]
    whole = [r for r in rows if None not in r[:2]]
    assert merged(spark, rows) == walk(whole)
    assert merged(spark, [(h, d, r) for h, d, r in whole if d and " " not in d]) == walk([r for r in whole if r[1] and " " not in r[1]])


def test_long_chains_and_empty_tables(spark):
    """0 takes 1, so 2 is free and takes 3: every other name acts, however long the chain."""
    offers = spark.createDataFrame([("h", i, i) for i in range(9)], "handler string, key long, o long")
    asks = spark.createDataFrame([("h", i - 1, i) for i in range(1, 9)], "handler string, key long, o long")
    assert sorted((r.o, r.taker) for r in first_takers(offers, asks).collect()) == [(1, 0), (3, 2), (5, 4), (7, 6)]
    assert first_takers(offers.limit(0), asks).count() == first_takers(offers, asks.limit(0)).count() == 0
    assert merged(spark, []) == {}
