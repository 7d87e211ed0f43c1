"""Steps whose work grew too fast or was done several times: joins, replay batches, flatteners, small files of slow rows."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ladderspark.catalog import fixtures, sources
from ladderspark.config import RatingConfig
from ladderspark.functions.names import SPACE, strip
from ladderspark.operators import rating as R
from ladderspark.operators import stats as S
from ladderspark.plans import contests
from ladderspark.sources import nested as J
from ladderspark.storage import materialize

SF = "/root/testdata/sf0.001"


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_not_sorted_to_meet_their_orders(spark):
    plan = executed(contests._monthly(spark, SF))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_amounts_round_as_decimals_do(spark):
    values = [0.0, 0.00005, -0.00005, 1.00015, 1.00025, 2.00005, 81234.56785, 123456.78905, 99999.99995, 1e9 + 0.00005, 12345678901.23455, 1e13, -7.12345, 3.1, None]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    got = d.select(contests._ten_thousandths(F.col("v")).alias("a"), (F.col("v").cast("decimal(18,4)") * 10000).cast("bigint").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and got[1].a == 1


def test_a_batch_begins_with_the_states_it_was_sent():
    cfg = RatingConfig()
    rows = pd.DataFrame({"run_seq": [1, 1, 2, 2], "team_id": [7, 8, 8, 9], "model_rank": [1, 2, 1, 2], "weight": 1.0, "extra_var": 0.0, "next_batch": [None, None, None, 3]})
    sent = pd.DataFrame({"team_id": [9, 8], "mu": [30.0, 20.0], "sigma": [4.0, 5.0]})
    out = R._fold(cfg, None)(rows, sent).set_index(["run_seq", "team_id"])
    assert (out.prev_mu[1, 7], out.prev_sigma[1, 7]) == (cfg.mu0, cfg.sigma0)
    assert (out.prev_mu[1, 8], out.prev_sigma[1, 8]) == (20.0, 5.0) and (out.prev_mu[2, 9], out.prev_sigma[2, 9]) == (30.0, 4.0)
    assert out.prev_mu[2, 8] == out.mu[1, 8] and list(out.leaves) == [False, False, False, True]


def test_totals_of_a_handler_are_sent_and_never_the_teams(spark):
    board = spark.range(3000).selectExpr(
        "id AS team_id", "concat('H', id % 3) AS handler", "'C' AS country", "'D' AS dog", "'L' AS size_group", "1.0D AS rating", "double(id) AS peak_rating", "true AS is_active")
    out = S.handler_profile(materialize(board, "profiles"))
    assert "LeftOuter, BuildRight" in executed(out) and "BuildLeft" not in executed(out)
    got = out.select("handler", "handler_teams", "handler_peak").distinct().collect()
    assert sorted(map(tuple, got)) == [("H0", 1000, 2997.0), ("H1", 1000, 2998.0), ("H2", 1000, 2999.0)] and out.count() == 3000


@pytest.mark.parametrize("query, field", [("flatten_results_json", "sijoitus"), ("flatten_keyed_json", "placement")])
def test_documents_are_dealt_once_and_a_rank_is_parsed_once(spark, monkeypatch, query, field):
    seen = []
    flatten = getattr(J, query)
    monkeypatch.setattr(J, query, lambda docs: seen.append(docs) or flatten(docs))
    out = getattr(sources, query)(spark, SF)
    assert executed(seen[0]).count("Exchange ") == 1
    parsed = flatten(seen[0].selectExpr("l_orderkey", "json")).select("rank", "eliminated")
    assert optimized(parsed).count(f".{field}") <= 2  # the number, and whether it is one
    assert out.count() > 0


def test_strip_takes_all_white_space_from_the_ends_alone(spark):
    white = " \t\n\x0b\f\r\u0085         　"
    values = ["", white, f"{white}a{white}b{white}", "a \n", "​a​", "᠎a", "ž ", None]
    d = spark.createDataFrame([(v,) for v in values], "v string")
    got = d.select(strip(F.col("v")).alias("a"), F.regexp_replace("v", f"^[{SPACE}]+|[{SPACE}]+$", "").alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert "regexp_replace" not in optimized(d.select(strip(F.col("v"))))


def test_names_of_a_small_file_are_dealt_over_all_tasks(spark):
    for sql in ("SELECT c_custkey FROM {customer}", "SELECT p_partkey FROM {part}", "SELECT doc_id FROM {documents}"):
        d = fixtures.frame(spark, SF, sql)
        assert d.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
