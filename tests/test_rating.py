import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig, activate, active_config, seed_config
from ladderspark.operators import board as B
from ladderspark.operators import rating as R
from ladderspark.plans.recalculate import recalculate, team_states

CFG = RatingConfig()


def brute(mu, sigma, rank, beta=25 / 6, kappa=1e-4):
    """Double-loop form of the model, straight from the published formulas."""
    n = len(mu)
    c = math.sqrt(sum(s * s + beta * beta for s in sigma))
    e = [math.exp(m / c) for m in mu]
    behind = [sum(e[j] for j in range(n) if rank[j] >= rank[i]) for i in range(n)]
    ties = [sum(1 for j in range(n) if rank[j] == rank[i]) for i in range(n)]
    out = []
    for i in range(n):
        omega = delta = 0.0
        for q in range(n):
            if rank[q] <= rank[i]:
                p = e[i] / behind[q]
                omega += ((1 if q == i else 0) - p) / ties[q]
                delta += p * (1 - p) / ties[q]
        omega *= sigma[i] ** 2 / c
        delta *= sigma[i] ** 3 / c**3
        out.append((mu[i] + omega, sigma[i] * math.sqrt(max(1 - delta, kappa))))
    return out


def field(spark, rows):
    return spark.createDataFrame(rows, "pool string, run_id bigint, run_seq bigint, team_id bigint, date date, rank bigint, "
                                 "eliminated boolean, model_rank bigint, weight double, extra_var double")


def random_field(runs=7, teams=12, seed=1):
    rnd, rows = random.Random(seed), []
    import datetime
    for pool in ("a", "b"):
        for run in range(1, runs + 1):
            for t in rnd.sample(range(teams), 8):
                rank = rnd.choice([1, 2, 2, 3, 4, 5, None])
                rows.append((pool, run, run, t, datetime.date(2024, 1, run), rank, False, rank, rnd.choice([1.0, 1.2]), rnd.choice([0.0, 0.5])))
    return rows


def test_update_equals_double_loop(spark):
    ranks = [1, 2, 3, 4, 4, 2, 1, 8]
    mus = [25.0 + i for i in range(8)]
    sigmas = [8.3 - 0.3 * i for i in range(8)]
    d = spark.createDataFrame([(1, i, ranks[i], mus[i], sigmas[i], 1.0) for i in range(8)],
                              "run_id int, team_id int, rank_in bigint, mu double, sigma double, weight double")
    got = {r.team_id: (r.new_mu, r.new_sigma) for r in R.pl_update(d, ["run_id"], CFG).collect()}
    for i, (m, s) in enumerate(brute(mus, sigmas, ranks)):
        assert got[i][0] == pytest.approx(m, abs=1e-9)
        assert got[i][1] == pytest.approx(max(1.5, s * 0.99), abs=1e-9)


def test_published_values():
    omega, shrink = R._plackett_luce(np.full(5, 25.0), np.full(5, 25 / 3), np.array([1, 2, 3, 4, 4]), 25 / 6, 1e-4)
    assert 25 + omega == pytest.approx([27.666667, 26.833333, 25.722222, 22.388889, 22.388889], abs=1e-6)
    assert 25 / 3 + shrink == pytest.approx([8.290557, 8.240146, 8.179997, 8.111796, 8.111796], abs=1e-6)


def test_rank_ranges(spark):
    """The sums over ranks do not depend on how the ranks are cut into ranges."""
    rows = [(1, i, 1 + i // 2, 25.0 + i % 3, 8.0, 1.0) for i in range(60)]
    d = spark.createDataFrame(rows, "run_id int, team_id int, rank_in bigint, mu double, sigma double, weight double")
    whole = sorted(map(tuple, R.pl_update(d, ["run_id"], CFG).select("team_id", "new_mu", "new_sigma").collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cut = sorted(map(tuple, R.pl_update(d, ["run_id"], CFG).select("team_id", "new_mu", "new_sigma").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert np.allclose(whole, cut, atol=1e-9)


def sequential(rows, sigma_max=None):
    """Run after run, in plain Python."""
    state, out = {}, []
    for pool, seq in sorted({(r[0], r[2]) for r in rows}):
        runs = [r for r in rows if (r[0], r[2]) == (pool, seq)]
        for r in runs:
            m, s = state.get((pool, r[3]), (CFG.mu0, CFG.sigma0))
            state[pool, r[3]] = (m, min(sigma_max, math.sqrt(s * s + r[9])) if sigma_max and r[9] > 0 else s)
        before = {r[3]: state[pool, r[3]] for r in runs}
        ranked = [r for r in runs if r[7] is not None]
        after = brute([before[r[3]][0] for r in ranked], [before[r[3]][1] for r in ranked], [r[7] for r in ranked])
        for r, (m, s) in zip(ranked, after):
            mu, sigma = before[r[3]]
            state[pool, r[3]] = (mu + r[8] * (m - mu), max(CFG.sigma_min, (sigma + r[8] * (s - sigma)) * CFG.sigma_decay))
        out += [(pool, r[1], r[3], *before[r[3]], *state[pool, r[3]]) for r in runs]
    return sorted(out)


def meeting_rows(days=6, pools=("hot", "b"), seed=3):
    """Several runs a day; some share teams, some are at other places. The pool "hot" has most of the entries."""
    import datetime

    rnd, rows = random.Random(seed), []
    for pool in pools:
        seq, teams = 0, 60 if pool == "hot" else 12
        for day in range(days):
            for place in range(4 if pool == "hot" else 1):
                here = range(place * teams // 4, (place + 2) * teams // 4) if pool == "hot" else range(teams)
                for _ in range(rnd.choice([1, 2, 3])):
                    seq += 1
                    for t in rnd.sample(here, min(len(here), 10)):
                        rank = rnd.choice([1, 2, 3, 4, None])
                        rows.append((pool, 1000 + seq, seq, t, datetime.date(2024, 1, 1 + day * 3), rank, False, rank, rnd.choice([1.0, 1.2]), rnd.choice([0.0, 0.5])))
    return rows


@pytest.mark.parametrize("rows,cap,entries", [
    (random_field(), None, 100_000), (random_field(), 8.333, 20), (random_field(), None, 0), (meeting_rows(), 8.333, 100_000), (meeting_rows(), None, 60), (meeting_rows(3), 8.4, 0),
])
def test_replay_by_levels_equals_run_after_run(spark, rows, cap, entries):
    got = R.replay(field(spark, rows), CFG, sigma_max=cap, batch_entries=entries).select("pool", "run_id", "team_id", "prev_mu", "prev_sigma", "mu", "sigma").collect()
    got, want = sorted(map(tuple, got)), sequential(rows, cap)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], atol=1e-9)


def test_levels_of_the_run_graph(spark):
    rows = meeting_rows()
    got = {(r.pool, r.run_id): r.level for r in R.run_levels(field(spark, rows)).collect()}
    last, longest = {}, {}
    for pool, seq, day in sorted({(r[0], r[2], r[4]) for r in rows}):
        teams = [r[3] for r in rows if (r[0], r[2]) == (pool, seq)]
        longest[pool, 1000 + seq] = (day, max([longest[last[pool, t]][1] + 1 for t in teams if (pool, t) in last and longest[last[pool, t]][0] == day], default=0))
        for t in teams:
            last[pool, t] = (pool, 1000 + seq)
    order = {x: i + 1 for i, x in enumerate(sorted(set(longest.values())))}
    assert got == {run: order[x] for run, x in longest.items()}
    assert len(order) < len(longest)


def test_batches_are_as_large_as_one_pool_may_be(spark):
    levels = spark.createDataFrame([(p, lv, 40) for p in "abc" for lv in range(1, 5)] + [("a", 5, 200)], "pool string, level int, entries bigint")
    plan, batches, pools, largest = R._batches(spark, levels, "pool", 80)
    assert sorted(map(tuple, plan.collect())) == [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]  # a batch has 240 entries, 80 of each pool
    assert (batches, pools, largest) == ([(0, False), (1, False), (2, True)], 3, 240)


def test_replay_writes_few_files_and_keeps_states_in_its_history(spark, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr("ladderspark.storage.shared_dir", lambda spark: str(tmp_path))
    done = R.replay(field(spark, meeting_rows()), CFG, batch_entries=60)
    files = [f"{d}/{f}" for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    batched = [f for f in files if "/batched-" in f]
    assert batched and len(batched) <= 4 * len({os.path.dirname(f) for f in batched})
    assert not [f for f in files if "/states-" in f]  # the history is what later batches read
    assert done.count() == len(meeting_rows())


def test_replay_of_nothing_and_of_wrong_order(spark):
    rows = random_field()
    assert R.replay(field(spark, rows).limit(0), CFG).count() == 0
    with pytest.raises(ValueError):
        R.replay(field(spark, [(*r[:2], 100 - r[2], *r[3:]) for r in rows]), CFG)


def test_display_values(spark):
    rows = [(25.0, 25 / 3, 10, 0), (25.0, 25 / 3, 10, 5), (25.0, 25 / 3, 10, 8), (25.0, 25 / 3, 20, 5), (25.0, 25 / 3, 0, 0)]
    d = spark.createDataFrame(rows, "mu double, sigma double, run_count int, top3_run_count int")
    got = d.select(R.base_rating(CFG).alias("b"), R.quality_factor(CFG).alias("q")).collect()
    assert got[0].b == pytest.approx(1666.67, abs=0.01)
    assert [g.q for g in got] == pytest.approx([0.85, 1.05, 1.05, 0.95, 0.85])


def test_tiers_of_hundred_teams(spark):
    d = spark.range(100).select(F.col("id").alias("team_id"), F.lit("L").alias("size_group"), (1000.0 + F.col("id")).alias("rating"), F.lit(True).alias("is_active"))
    got = {r.tier: r["count"] for r in B.tier_by_position(d, CFG).groupBy("tier").count().collect()}
    assert got == {"Elite": 2, "Champion": 8, "Expert": 20, "Competitor": 70}


def test_zscore(spark):
    d = spark.createDataFrame([(i, "L" if i < 20 else "S", 1000.0 + i * i, 900.0, 0 if i == 5 else 3) for i in range(21)],
                              "team_id int, size_group string, rating double, prev_rating double, run_count int")
    got = {r.team_id: r for r in B.zscore_normalize(d, CFG).collect()}
    big = [got[i].rating for i in range(20) if i != 5]
    assert np.mean(big) == pytest.approx(1500) and np.std(big) == pytest.approx(150)
    assert got[5].rating == 1025.0 and got[20].rating == 1500.0


def results(spark, rows):
    return spark.createDataFrame(rows, "pool string, run_id bigint, date string, team_id bigint, rank int, eliminated boolean, tier int, _seq bigint").withColumn("date", F.to_date("date"))


def test_small_field_is_skipped_and_copies_count_once(spark):
    rows = [("L", 1, "2024-01-01", t, t + 1, False, 2, t) for t in range(5)] + [("L", 1, "2024-01-01", 0, 9, False, 2, 99)]
    rows += [("L", 2, "2024-01-02", t, t + 1 if t < 5 else None, t >= 5, 1, t) for t in range(7)]
    f = R.rated_field(results(spark, rows), CFG).collect()
    assert {r.run_id for r in f} == {2}
    assert {r.team_id: r.model_rank for r in f if r.eliminated} == {5: 6, 6: 6}
    assert {r.weight for r in f} == {1.2}


def test_empty_input_resets_teams(spark):
    teams = spark.createDataFrame([(1, "L"), (2, "L")], "team_id bigint, size_group string")
    board, snaps = recalculate(results(spark, []), teams, CFG)
    assert [(r.mu, r.run_count, r.is_active, r.tier) for r in board.collect()] == [(25.0, 0, False, None)] * 2
    assert snaps.count() == 0


def test_recalculated_counts_and_peak(spark):
    rows = [("L", d, f"2024-01-{d:02d}", t, t + 1, False, 2, t) for d in range(1, 7) for t in range(8)]
    teams = spark.createDataFrame([(t, "L") for t in range(9)], "team_id bigint, size_group string")
    old = spark.createDataFrame([(0, 5000.0), (7, 10.0)], "team_id bigint, peak_rating double")
    board, snaps = recalculate(results(spark, rows), teams, CFG, old=old)
    got = {r.team_id: r for r in board.collect()}
    assert got[0].run_count == 6 and got[0].top3_run_count == 6 and got[7].top3_run_count == 0
    assert got[0].rating > got[1].rating > got[7].rating and got[0].peak_rating == 5000.0 and got[7].peak_rating == got[7].rating
    assert got[8].run_count == 0 and not got[8].is_active
    assert snaps.count() == 48


def test_configuration(spark):
    seeded = seed_config(spark, None)
    assert seed_config(spark, seeded).count() == 1
    new = RatingConfig(sigma_decay=0.95).as_frame(spark, 2)
    row = active_config(activate(seeded, new)).first()
    assert RatingConfig.from_row(row).sigma_decay == 0.95
