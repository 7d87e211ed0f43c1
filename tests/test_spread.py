"""Joins of tables that grow: not through the driver, and no pairs of everybody who uses one name."""

import pytest

from ladderspark.operators import identity as I
from ladderspark.operators.scan import _parts, _with_starts
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan()


def joined_rows(node):
    """Rows that each join of an executed plan gave."""
    inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
    below = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
    return own + [n for b in below for n in joined_rows(b)]


@pytest.mark.parametrize("step", ["alias", "exact", "name", "containment", "backfill"])
def test_name_tables_are_not_broadcast(spark, step):
    dim = spark.range(50).selectExpr("id", "concat('anna lena ', id) AS norm", "'N1' AS country", "concat('Anna, ', id) AS name")
    asked = dim.selectExpr("id AS key", "norm", "country")
    done = spark.range(50).selectExpr("id AS handler_id", "'exact' AS stage", "'N1' AS country", "'Anna' AS raw", "id AS _seq")
    out = {"alias": lambda: I.resolve_alias(asked, dim.selectExpr("norm AS alias_name", "id AS canonical_id")), "exact": lambda: I.match_exact(asked, dim),
           "name": lambda: I.match_name_only(asked, dim), "containment": lambda: I.match_containment(asked, dim), "backfill": lambda: I.backfill_handlers(dim, done)}[step]()
    assert "BroadcastExchange" not in plan(out).toString()
    assert out.count() == 50


def test_starts_are_no_more_than_ranges(spark):
    parts = _parts(spark.range(5000).selectExpr("id % 1000 AS g", "id AS v"), ["g"], [F.col("v")])
    placed = _with_starts(parts, ["g"], {"n": F.count(F.lit(1))})
    went_on = placed.filter("_s_n > 0").select("g", "_range").distinct().count()
    assert placed.count() == 5000 and went_on < parts.select("_range").distinct().count()


def test_a_name_that_everybody_uses_lists_no_pairs(spark):
    n = 1000
    dim = spark.range(n).selectExpr("id", "'day' AS call_norm", "'' AS reg_norm", "'L' AS size")
    owned = spark.range(n).selectExpr("id AS handler_id", "id")
    rows = spark.range(n + 5).selectExpr("id AS handler_id", "'Day' AS raw", "'L' AS size", "id AS _seq")
    alias = spark.range(n).selectExpr("'day' AS alias_name", "id AS canonical_id")
    out = I.resolve_entities(rows, dim, owned, alias)
    got = {r.handler_id: (r.stage, r.id) for r in out.collect()}
    assert got == {k: ("own alias", k) if k < n else ("new", None) for k in range(n + 5)}
    assert max(joined_rows(plan(out))) <= 4 * n
