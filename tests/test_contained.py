"""Containment: what goes over the network does not grow with the length of the names times their parts, and the sample decides nothing."""

import random

import pytest

from ladderspark.operators import identity as I


def data_size(node):
    """Bytes that all exchanges of an executed plan gave."""
    inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
    below = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("dataSize").value() if node.nodeName() == "Exchange" else 0
    return own + sum(data_size(b) for b in below)


def test_parts_of_a_name_travel_without_the_name(spark):
    names = spark.range(300).selectExpr("id", "concat('anna ', repeat(sha2(string(id), 256), 3)) AS norm", "'N1' AS country")
    out = I.match_containment(names.selectExpr("id AS key", "concat(norm, 'x') AS norm", "country"), names).filter("contained_id = key")
    assert len(out.collect()) == 300
    assert data_size(out._jdf.queryExecution().executedPlan()) < 3 << 20


@pytest.mark.parametrize("few", [0, 10_000])
def test_pairs_equal_brute_force_whatever_the_sample(spark, monkeypatch, few):
    monkeypatch.setattr(I, "_SAMPLE", 5)
    monkeypatch.setattr(I, "_FEW", few)
    rng = random.Random(2)
    words = ["a", "ab", "anna", "li", "anna lena", "lena", "nowakowska", "owak", "b c", "smith", "кузнец"]
    some = lambda n, at: [(at + i, " ".join(rng.sample(words, rng.choice([1, 2, 3]))), rng.choice(["CZ", "GB"])) for i in range(n)]
    asked, names = some(80, 0), [*some(60, 500), (700, "", "CZ")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, norm string, country string")
    for own in (False, True):
        got = sorted(map(tuple, I.containment_pairs(frame(asked, "key"), frame(names, "id"), own=own).select("key", "id").collect()))
        want = sorted((a[0], d[0]) for a in asked if len(a[1]) >= 10 and " " in a[1] for d in [*names, *(asked if own else [])]
                      if d[2] == a[2] and d[1] and d[1] != a[1] and (a[1] in d[1] or d[1] in a[1]))
        assert got == want and len(want) > 100
