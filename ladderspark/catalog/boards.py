"""Rating, leaderboard and statistics queries over the contest view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderspark.catalog.base import STATES, field_sql, query, renamed, replay_sql, with_board, with_results
from ladderspark.config import RatingConfig, activate, active_config, seed_config
from ladderspark.operators import board as B
from ladderspark.operators import rating as R
from ladderspark.operators import stats as S
from ladderspark.operators.scan import first_rows, last_rows
from ladderspark.plans import contests
from ladderspark.plans.contests import results, table, teams
from ladderspark.plans.recalculate import prev_state, recalculate, team_states
from ladderspark.storage import materialize, new_path, stored

CFG = RatingConfig()


def _recalculated(spark, sf):
    made = {}

    def build(part):
        if not made:
            made["board"], made["snaps"] = recalculate(results(spark, sf), teams(spark, sf).drop("pool"), CFG)
        return made[part]

    b = stored(spark, sf, "board", lambda: build("board"))
    s = stored(spark, sf, "snaps", lambda: build("snaps"))
    return b, s


def team_board(spark, sf):
    return _recalculated(spark, sf)[0]


def snapshots(spark, sf):
    return _recalculated(spark, sf)[1]


def full_history(spark, sf):
    field = R.rated_field(R.starts(results(spark, sf)), CFG)
    return stored(spark, sf, "full_history", lambda: R.replay(field, CFG))


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def r6s(*cols, src=""):
    return ", ".join(f"round({src}{c}, 6) AS {c}" for c in cols)


# -------------------------------------------------------------- filters, dedup, model field

@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER
  (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 8 + l_linenumber, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_first(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return first_rows(d, ["l_suppkey", "l_partkey"], F.struct(F.col("l_orderkey") * 8 + F.col("l_linenumber"), "l_quantity"))


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER
  (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey * 8 + l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_last(spark, sf):
    d = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return last_rows(d, ["l_suppkey", "l_partkey"], F.struct(F.col("l_orderkey") * 8 + F.col("l_linenumber"), "l_quantity"))


@query(with_results("SELECT run_id, team_id, date FROM results WHERE date >= (SELECT MAX(date) FROM results) - 730"))
def live_window(spark, sf):
    return R.live_window(results(spark, sf), 730).select("run_id", "team_id", "date")


@query(with_results("""SELECT run_id, team_id FROM (SELECT *, COUNT(*) OVER (PARTITION BY run_id) AS n FROM results)
  WHERE n >= 6"""))
def min_field(spark, sf):
    return R.min_field(results(spark, sf), ["run_id"], 6).select("run_id", "team_id")


def _rank_sql(mode):
    return with_results("SELECT run_id, team_id, model_rank, weight, run_seq FROM field", field_sql("results", mode=mode))


def _field_cols(df):
    return df.select("run_id", "team_id", "model_rank", "weight", F.col("run_seq").cast("bigint").alias("run_seq"))


@query(_rank_sql("source"))
def rank_list_source(spark, sf):
    return _field_cols(R.rated_field(results(spark, sf), CFG))


@query(_rank_sql("dense_order"))
def rank_list_dense_order(spark, sf):
    return _field_cols(R.rated_field(results(spark, sf), CFG, rank_mode="dense_order"))


# -------------------------------------------------------------- rating model

@query(with_results("""SELECT run_id, team_id, round(mu + weight * (sigma * sigma / c * (1.0::DOUBLE / a - e * z1)), 6) AS new_mu,
    round(greatest(1.5, (sigma + weight * (sigma * sqrt(greatest(1 - pow(sigma / c, 3) * (e * z1 - e * e * z2), 0.0001)) - sigma)) * 0.99), 6) AS new_sigma
  FROM c4""", field_sql("results"), """c0 AS (SELECT *, 25.0::DOUBLE + team_id % 7 AS mu, 8.333::DOUBLE - (team_id % 5) * 0.5::DOUBLE AS sigma FROM field),
  c1 AS (SELECT *, sqrt(SUM(sigma * sigma + (25.0::DOUBLE / 6) * (25.0::DOUBLE / 6)) OVER (PARTITION BY run_id)) AS c FROM c0),
  c2 AS (SELECT *, exp(mu / c) AS e FROM c1),
  c3 AS (SELECT *, SUM(e) OVER (PARTITION BY run_id ORDER BY model_rank DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
    COUNT(*) OVER (PARTITION BY run_id, model_rank) AS a FROM c2),
  c4 AS (SELECT *, SUM(1 / (s * a)) OVER w AS z1, SUM(1 / (s * s * a)) OVER w AS z2 FROM c3
    WINDOW w AS (PARTITION BY run_id ORDER BY model_rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""))
def rating_update(spark, sf):
    d = R.rated_field(results(spark, sf), CFG).withColumnRenamed("model_rank", "rank_in")
    d = d.withColumn("mu", 25.0 + F.col("team_id") % 7).withColumn("sigma", 8.333 - F.col("team_id") % 5 * 0.5)
    return R.pl_update(d, ["run_id"], CFG).select("run_id", "team_id", *r6("new_mu", "new_sigma"))


def _hist_sql(select, *parts, min_ranked=2, mode="source", eliminated="last"):
    field = field_sql("results", min_ranked=min_ranked, mode=mode, eliminated=eliminated)
    return with_results(select, field, replay_sql(), *parts)


HIST_COLS = "run_id, team_id, " + r6s("prev_mu", "prev_sigma", "mu", "sigma")


@query(_hist_sql(f"SELECT {HIST_COLS} FROM hist"))
def replay(spark, sf):
    return full_history(spark, sf).select("run_id", "team_id", *r6("prev_mu", "prev_sigma", "mu", "sigma"))


@query(_hist_sql(f"SELECT team_id, run_count, finished_run_count, top3_run_count, top10_run_count, last_date, {r6s('mu', 'sigma')} FROM states", STATES))
def team_states_full(spark, sf):
    d = team_states(full_history(spark, sf), ["team_id"])
    return d.select("team_id", "run_count", "finished_run_count", "top3_run_count", "top10_run_count", "last_date", *r6("mu", "sigma"))


@query(_hist_sql(f"SELECT team_id, {r6s('prev_mu', 'prev_sigma')} FROM states", STATES))
def previous_state(spark, sf):
    return prev_state(full_history(spark, sf), ["team_id"]).select("team_id", *r6("prev_mu", "prev_sigma"))


@query(_hist_sql(f"SELECT {HIST_COLS} FROM hist", eliminated="ignore", min_ranked=6))
def replay_ignoring_eliminated(spark, sf):
    field = R.rated_field(R.starts(results(spark, sf)), CFG, eliminated="ignore", min_ranked=6)
    return R.replay(field, CFG).select("run_id", "team_id", *r6("prev_mu", "prev_sigma", "mu", "sigma"))


@query(_hist_sql(f"SELECT {HIST_COLS} FROM hist", eliminated="downweight", mode="dense_order", min_ranked=6))
def replay_downweighting_eliminated(spark, sf):
    field = R.rated_field(R.starts(results(spark, sf)), CFG, eliminated="downweight", rank_mode="dense_order", min_ranked=6)
    return R.replay(field, CFG).select("run_id", "team_id", *r6("prev_mu", "prev_sigma", "mu", "sigma"))


# Fixed values of the inactivity variant are tau and the cap; the data's gaps need a small one to show.
IDLE_TAU, IDLE_CAP = 1.0, 8.333

IDLE = f"""idle0 AS (SELECT *, lag(date) OVER (PARTITION BY pool, team_id ORDER BY run_seq) AS prev_date FROM field),
  days AS (SELECT DISTINCT pool, date AS day FROM results),
  gaps AS (SELECT i.pool, i.run_id, i.team_id, SUM((d.day - i.prev_date) / 30.0::DOUBLE) AS months
    FROM idle0 i JOIN days d ON d.pool = i.pool AND d.day > i.prev_date + 30 AND d.day <= i.date GROUP BY ALL),
  idle AS (SELECT i.*, {IDLE_TAU * IDLE_TAU} * coalesce(months, 0) AS extra_var
    FROM idle0 i LEFT JOIN gaps g ON g.run_id = i.run_id AND g.team_id = i.team_id)"""
IDLE_REPLAY = replay_sql(field="idle", idle="coalesce(g.extra_var, 0)", sigma_max=IDLE_CAP)


TRAIL = """trail AS (SELECT s.team_id, SUM((d.day - s.last_date) / 30.0::DOUBLE) AS months FROM states s JOIN team t USING (team_id)
    JOIN days d ON d.pool = t.pool AND d.day > s.last_date + 30 GROUP BY ALL)"""


@query(with_results(f"""SELECT team_id, run_count, round(mu, 6) AS mu,
    round(CASE WHEN months > 0 THEN least({IDLE_CAP}, sqrt(sigma * sigma + {IDLE_TAU * IDLE_TAU} * months)) ELSE sigma END, 6) AS sigma
  FROM states LEFT JOIN trail USING (team_id)""", field_sql("results", mode="dense_order", min_ranked=6), IDLE, IDLE_REPLAY, STATES, TRAIL))
def replay_with_inactivity(spark, sf):
    r = R.starts(results(spark, sf))
    field = R.rated_field(r, CFG, rank_mode="dense_order", min_ranked=6, inactivity=(IDLE_TAU, IDLE_CAP))
    states = team_states(R.replay(field, CFG, sigma_max=IDLE_CAP), ["team_id", "pool"])
    return R.idle_after_last(states, r, "pool", IDLE_TAU, IDLE_CAP).select("team_id", "run_count", *r6("mu", "sigma"))


def form_board(spark, sf):
    r = R.live_window(R.starts(results(spark, sf)), 365)
    field = R.rated_field(r, CFG, rank_mode="dense_order", min_ranked=6)
    states = team_states(R.replay(field, CFG), ["team_id", "pool"], "model_rank")
    d = states.withColumn("rating", R.base_rating(CFG)).withColumnRenamed("pool", "size_group")
    d = d.withColumn("is_active", F.col("run_count") >= 3).withColumn("is_provisional", F.col("sigma") >= 7.8)
    return B.tier_by_threshold(materialize(d, "form"), CFG)


FORM = f"""form_src AS (SELECT * FROM results WHERE date >= (SELECT MAX(date) FROM results) - 365),
  {field_sql("form_src", mode="dense_order", min_ranked=6)}, {replay_sql()}, {STATES},
  f0 AS (SELECT s.*, t.size_group, 1000 + 40 * (mu - sigma) AS rating, run_count >= 3 AS is_active, sigma >= 7.8 AS is_provisional
    FROM states s JOIN team t USING (team_id)),
  f1 AS (SELECT *, row_number() OVER (PARTITION BY size_group ORDER BY rating, team_id) - 1 AS i,
    COUNT(*) OVER (PARTITION BY size_group) AS n FROM f0 WHERE is_active),
  cuts AS (SELECT size_group, MAX(rating) FILTER (i = CAST(floor((n - 1) * 0.98::DOUBLE) AS BIGINT)) AS e,
    MAX(rating) FILTER (i = CAST(floor((n - 1) * 0.9::DOUBLE) AS BIGINT)) AS c,
    MAX(rating) FILTER (i = CAST(floor((n - 1) * 0.7::DOUBLE) AS BIGINT)) AS x FROM f1 GROUP BY size_group),
  form AS (SELECT f0.*, CASE WHEN rating >= e THEN 'Elite' WHEN rating >= c THEN 'Champion' WHEN rating >= x THEN 'Expert'
    ELSE 'Competitor' END AS tier FROM f0 LEFT JOIN cuts USING (size_group))"""


@query(with_results(f"SELECT team_id, size_group, run_count, tier, is_active, {r6s('rating')} FROM form", FORM))
def form_board_recent(spark, sf):
    return form_board(spark, sf).select("team_id", "size_group", "run_count", "tier", "is_active", *r6("rating"))


@query(with_board(f"SELECT team_id, {r6s('quality')}, {r6s('raw_rating')}, {r6s('raw_prev')} FROM rated"))
def display_rating(spark, sf):
    d = R.display_rating(team_board(spark, sf).drop("quality", "rating", "prev_rating"), CFG)
    return d.select("team_id", *r6("quality"), F.round("rating", 6).alias("raw_rating"), F.round("prev_rating", 6).alias("raw_prev"))


@query(with_board("SELECT team_id, is_active, is_provisional FROM flagged"))
def activity_flags(spark, sf):
    return R.flags(team_board(spark, sf).drop("is_active", "is_provisional"), CFG).select("team_id", "is_active", "is_provisional")


BOARD_COLS = ["mu", "sigma", "prev_mu", "prev_sigma", "rating", "prev_rating", "peak_rating"]
BOARD_KEYS = ["team_id", "size_group", "country", "run_count", "finished_run_count", "top3_run_count", "is_active", "is_provisional", "tier"]


@query(with_board(f"SELECT {', '.join(BOARD_KEYS)}, {r6s(*BOARD_COLS)} FROM board"))
def recalculated_teams(spark, sf):
    return team_board(spark, sf).select(*BOARD_KEYS, *r6(*BOARD_COLS))


@query(with_board(f"SELECT team_id, run_id, date, {r6s('mu', 'sigma', 'rating')} FROM snaps"))
def recalculated_snapshots(spark, sf):
    return snapshots(spark, sf).select("team_id", "run_id", "date", *r6("mu", "sigma", "rating"))


@query(with_board("""SELECT team_id, run_seq, date, round(rating - sigma, 6) AS low, round(rating + sigma, 6) AS high,
  round(rating, 6) AS rating, round(MAX(rating) OVER (PARTITION BY team_id ORDER BY run_seq ROWS UNBOUNDED PRECEDING), 6) AS peak_so_far,
  row_number() OVER (PARTITION BY team_id ORDER BY rating DESC, run_seq) = 1 AS is_peak FROM snaps"""))
def rating_history(spark, sf):
    d = R.rating_history(snapshots(spark, sf), F.lit(True))
    return d.select("team_id", F.col("run_seq").cast("bigint").alias("run_seq"), "date", "is_peak", *r6("rating", "low", "high", "peak_so_far"))


def raw_board(spark, sf):
    """Team table with raw ratings: input of the normalization, tier and rank operators."""
    d = team_board(spark, sf).drop("rating", "prev_rating", "tier")
    return R.display_rating(d, CFG)


@query(with_board(f"SELECT team_id, {r6s('rating', 'prev_rating')} FROM normal"))
def zscore_normalize(spark, sf):
    return B.zscore_normalize(raw_board(spark, sf), CFG).select("team_id", *r6("rating", "prev_rating"))


@query(with_board("""SELECT team_id, round(CASE WHEN run_count = 0 OR q.sd IS NULL THEN raw_rating
    ELSE 1500 + 150 * (raw_rating - q.m) / q.sd END, 6) AS rating
  FROM rated LEFT JOIN (SELECT size_group, AVG(raw_rating) AS m, stddev_pop(raw_rating) AS sd FROM rated WHERE run_count >= 5 GROUP BY 1) q
  USING (size_group)"""))
def zscore_normalize_qualified(spark, sf):
    d = B.zscore_normalize(raw_board(spark, sf), CFG, qualify=F.col("run_count") >= 5)
    return d.select("team_id", *r6("rating"))


@query(with_board("SELECT team_id, size_group, tier FROM board"))
def tier_by_position(spark, sf):
    d = team_board(spark, sf).drop("tier")
    return B.tier_by_position(d, CFG).select("team_id", "size_group", "tier")


@query(with_board("""SELECT team_id, CASE WHEN rating >= e THEN 'Elite' WHEN rating >= c THEN 'Champion' WHEN rating >= x THEN 'Expert'
    ELSE 'Competitor' END AS tier FROM flagged LEFT JOIN (
  SELECT size_group, MAX(rating) FILTER (i = CAST(floor((n - 1) * 0.98::DOUBLE) AS BIGINT)) AS e,
    MAX(rating) FILTER (i = CAST(floor((n - 1) * 0.9::DOUBLE) AS BIGINT)) AS c,
    MAX(rating) FILTER (i = CAST(floor((n - 1) * 0.7::DOUBLE) AS BIGINT)) AS x
  FROM (SELECT size_group, rating, row_number() OVER (PARTITION BY size_group ORDER BY rating, team_id) - 1 AS i,
    COUNT(*) OVER (PARTITION BY size_group) AS n FROM flagged WHERE is_active) GROUP BY size_group) USING (size_group)"""))
def tier_by_threshold(spark, sf):
    return B.tier_by_threshold(team_board(spark, sf).drop("tier"), CFG).select("team_id", "tier")


RANKED = """ranked AS (SELECT *, row_number() OVER (PARTITION BY size_group ORDER BY rating DESC, team_id) AS rank,
    CASE WHEN prev_rating > 0 THEN row_number() OVER (PARTITION BY size_group, prev_rating > 0 ORDER BY prev_rating DESC, team_id) END AS prev_rank
  FROM board WHERE is_active)"""


@query(with_board("SELECT team_id, size_group, rank, prev_rank FROM ranked", RANKED))
def global_ranks(spark, sf):
    return B.global_ranks(team_board(spark, sf)).select("team_id", "size_group", "rank", "prev_rank")


@query(with_board("""SELECT team_id, CASE WHEN prev_rank IS NULL THEN 'NEW' WHEN prev_rank > rank THEN 'up ' || (prev_rank - rank)
  WHEN prev_rank < rank THEN 'down ' || (rank - prev_rank) ELSE 'same' END AS trend FROM ranked""", RANKED))
def rank_trend(spark, sf):
    return B.trend(B.global_ranks(team_board(spark, sf))).select("team_id", "trend")


@query(with_board("""SELECT team_id, round(CASE WHEN is_active THEN greatest(rating, 1500) ELSE 1500 END, 6) AS peak_rating FROM board"""))
def peak_rating(spark, sf):
    b = team_board(spark, sf)
    old = b.select("team_id", F.lit(1500.0).alias("peak_rating"))
    return B.peak_rating(b.drop("peak_rating"), old).select("team_id", *r6("peak_rating"))


@query(with_board("""SELECT team_id, round(rating, 6) AS rating FROM board WHERE is_active AND size_group = 'EUROPE'
  AND (contains(handler_norm, '7') OR contains(dog_norm, '7'))"""))
def filter_rankings(spark, sf):
    return B.filter_rankings(team_board(spark, sf), size="EUROPE", search="7").select("team_id", *r6("rating"))


@query(with_board("""SELECT team_id, round(rating, 6) AS rating FROM board WHERE is_active ORDER BY board.rating DESC, team_id LIMIT 20 OFFSET 20"""))
def rankings_page(spark, sf):
    d = B.rankings_page(B.filter_rankings(team_board(spark, sf)), page=2, page_size=20)
    return d.select("team_id", *r6("rating"))


@query(with_board(f"""SELECT team_id, size_group, place FROM (SELECT *, row_number() OVER (PARTITION BY size_group ORDER BY rating DESC, team_id) AS place
  FROM board WHERE is_active) WHERE place <= 3"""))
def top_k_per_group(spark, sf):
    return B.top_k_per_group(team_board(spark, sf).filter("is_active"), 3).select("team_id", "size_group", "place")


COMPS = """comps AS (SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS comp_id,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders),
  competition AS (SELECT comp_id, date, last_day(date) AS end_date, 'Cup ' || comp_id AS name, 'cup-' || comp_id AS slug,
    CAST(CASE WHEN month(date) % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS tier, 'NATION_' || (month(date) * 2 % 25) AS country FROM comps)"""


@query(f"WITH {COMPS} SELECT comp_id, name, date FROM competition ORDER BY date DESC, comp_id DESC LIMIT 5")
def recent_competitions(spark, sf):
    return B.recent(contests.competitions(spark, sf), 5).select("comp_id", "name", "date")


@query(f"WITH {COMPS} SELECT comp_id, slug, tier, country FROM competition WHERE year(date) = 1997 AND tier = 1 AND contains(name, '19970')")
def filter_competitions(spark, sf):
    d = S.filter_competitions(contests.competitions(spark, sf), year=1997, tier=1, search="19970")
    return d.select("comp_id", "slug", "tier", "country")


@query(f"WITH {COMPS} SELECT comp_id, slug, date FROM competition ORDER BY date DESC, comp_id LIMIT 20 OFFSET 20")
def competitions_page(spark, sf):
    return S.competitions_page(contests.competitions(spark, sf), 2).select("comp_id", "slug", "date")


@query(with_results("""SELECT run_id, comp_name, date, rank, eliminated FROM results WHERE team_id = 7
  ORDER BY date DESC, run_id LIMIT 20 OFFSET 20"""))
def team_results_page(spark, sf):
    d = S.team_results_page(results(spark, sf), 7, 2)
    return d.select("run_id", "comp_name", "date", "rank", "eliminated")


@query(with_board("""SELECT team_id, handler, tier, is_active, round(rating, 6) AS rating, round(avg_rank, 6) AS avg_rank,
  round(CASE WHEN run_count > 0 THEN finished_run_count * 100.0::DOUBLE / run_count ELSE 0 END, 6) AS finished_pct,
  round(CASE WHEN run_count > 0 THEN top3_run_count * 100.0::DOUBLE / run_count ELSE 0 END, 6) AS top3_pct
  FROM board LEFT JOIN (SELECT team_id, AVG(rank) FILTER (NOT eliminated) AS avg_rank FROM results GROUP BY 1) USING (team_id)"""))
def team_detail(spark, sf):
    d = S.team_detail(team_board(spark, sf), results(spark, sf))
    return d.select("team_id", "handler", "tier", "is_active", *r6("rating", "avg_rank", "finished_pct", "top3_pct"))


@query(with_board("SELECT DISTINCT size_group, country FROM board WHERE country <> ''"))
def board_countries(spark, sf):
    return B.board_countries(team_board(spark, sf))


@query(with_board("""SELECT team_id, round(b.rating, 6) AS rating_a, round(f.rating, 6) AS rating_b, round(f.rating - b.rating, 6) AS rating_delta,
    coalesce(b.run_count, 0) AS runs_a, coalesce(f.run_count, 0) AS runs_b,
    coalesce(b.tier, 'Competitor') AS tier_a, coalesce(f.tier, 'Competitor') AS tier_b,
    coalesce(b.is_provisional, false) AS prov_a, coalesce(f.is_provisional, false) AS prov_b,
    coalesce(b.run_count >= 5 AND recent_a, false) AS eligible_a, coalesce(f.run_count >= 3, false) AS eligible_b
  FROM (SELECT * FROM board LEFT JOIN act USING (team_id) WHERE run_count > 0) b FULL JOIN form f USING (team_id)""",
  """act AS (SELECT team_id, COUNT(*) FILTER (date >= (SELECT MAX(date) FROM results) - 365) >= 3 AS recent_a FROM results GROUP BY 1)""",
  renamed(FORM, "form_")))
def compare_boards(spark, sf):
    r = results(spark, sf)
    act = S.activity(r, 365, 3).select("team_id", F.col("is_recent").alias("active_recent"))
    a = team_board(spark, sf).filter("run_count > 0").join(act, "team_id", "left")
    d = B.compare_boards(a, form_board(spark, sf), 5, 3)
    return d.select(*[c for c in d.columns if not c.startswith("rating")], *r6("rating_a", "rating_b", "rating_delta"))


@query("SELECT CAST(2 AS BIGINT) AS config_id, true AS is_active, 0.95::DOUBLE AS sigma_decay, CAST(COUNT(*) AS BIGINT) AS orders FROM orders")
def configuration(spark, sf):
    seeded = seed_config(spark, None)
    new = RatingConfig(sigma_decay=0.95).as_frame(spark, config_id=2)
    chosen = active_config(activate(seed_config(spark, seeded), new)).select("config_id", "is_active", "sigma_decay")
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("orders")).join(chosen, F.lit(True))


# -------------------------------------------------------------- statistics

@query(with_results("""SELECT team_id, COUNT(*) AS runs, COUNT(*) FILTER (NOT eliminated) AS finished_runs,
  COUNT(*) FILTER (rank <= 3) AS top3_runs, COUNT(*) FILTER (rank <= 10) AS top10_runs,
  round(COUNT(*) FILTER (NOT eliminated) * 100.0::DOUBLE / COUNT(*), 6) AS finished_pct,
  round(COUNT(*) FILTER (rank <= 3) * 100.0::DOUBLE / COUNT(*), 6) AS top3_pct,
  round(COUNT(*) FILTER (rank <= 10) * 100.0::DOUBLE / COUNT(*), 6) AS top10_pct FROM results GROUP BY team_id"""))
def team_stats(spark, sf):
    d = S.team_stats(results(spark, sf))
    return d.select("team_id", "runs", "finished_runs", "top3_runs", "top10_runs", *r6("finished_pct", "top3_pct", "top10_pct"))


@query(with_results("SELECT team_id, round(AVG(rank) FILTER (NOT eliminated), 6) AS avg_rank FROM results GROUP BY team_id"))
def average_rank(spark, sf):
    return S.avg_rank(results(spark, sf)).select("team_id", *r6("avg_rank"))


@query(with_results("SELECT comp_id, COUNT(DISTINCT team_id) AS participants FROM results GROUP BY comp_id"))
def participants(spark, sf):
    return S.participants(results(spark, sf))


@query(with_board("""SELECT comp_id, runs, entries, round(finished_pct, 6) AS finished_pct, round(avg_rating, 6) AS avg_rating, by_size FROM
  (SELECT comp_id, COUNT(DISTINCT run_id) AS runs, COUNT(*) AS entries, COUNT(*) FILTER (NOT eliminated) * 100.0::DOUBLE / COUNT(*) AS finished_pct
   FROM results GROUP BY 1) JOIN
  (SELECT comp_id, SUM(r) / SUM(n) AS avg_rating, string_agg(size_group || '=' || n, ',' ORDER BY size_group) AS by_size FROM
    (SELECT comp_id, size_group, SUM(rating) AS r, COUNT(*) AS n FROM (SELECT DISTINCT comp_id, team_id FROM results) JOIN board USING (team_id) GROUP BY ALL)
   GROUP BY 1) USING (comp_id)"""))
def competition_stats(spark, sf):
    d = S.competition_stats(results(spark, sf), team_board(spark, sf))
    text = F.transform(F.map_entries("teams_by_size"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return d.select("comp_id", "runs", "entries", *r6("finished_pct", "avg_rating"), F.array_join(text, ",").alias("by_size"))


@query(with_board("""SELECT (SELECT COUNT(*) FROM board WHERE is_active) AS qualified_teams,
  (SELECT COUNT(DISTINCT comp_id) FROM results) AS competitions, (SELECT COUNT(DISTINCT run_id) FROM results) AS runs"""))
def global_summary(spark, sf):
    return S.summary(team_board(spark, sf), results(spark, sf))


@query(with_board("""SELECT size_group, tier, COUNT(*) AS teams, COUNT(*) FILTER (is_provisional) AS provisional
  FROM board WHERE is_active GROUP BY ALL"""))
def tier_distribution(spark, sf):
    return S.tier_distribution(team_board(spark, sf))


@query(with_results("SELECT team_id, arg_max(comp_name, run_id) AS last_comp, MAX(date) AS last_date FROM results GROUP BY 1"))
def last_competition(spark, sf):
    return S.last_competition(results(spark, sf))


@query(with_results("""SELECT team_id, COUNT(*) FILTER (date >= m - 365) AS recent_runs, COUNT(*) FILTER (date >= m - 365) >= 3 AS is_recent
  FROM results, (SELECT MAX(date) AS m FROM results) GROUP BY team_id"""))
def recent_activity(spark, sf):
    return S.activity(results(spark, sf))


@query(with_results("""SELECT pool, discipline, COUNT(*) AS rows, COUNT(*) FILTER (eliminated) AS eliminated,
  COUNT(*) FILTER (rank IS NULL AND NOT eliminated) AS unranked FROM results GROUP BY ROLLUP (pool, discipline)"""))
def qa_report(spark, sf):
    return S.qa_report(results(spark, sf), "pool", "discipline")


@query(with_board("""SELECT country, round(score, 6) AS score, teams, elite, champion, expert, competitor, best_team,
    round(best_rating, 6) AS best_rating, teams < 10 AS is_provisional, row_number() OVER (ORDER BY score DESC, country) AS rank FROM (
  SELECT country, AVG(rating) FILTER (p <= 10) AS score, COUNT(*) AS teams, COUNT(*) FILTER (tier = 'Elite') AS elite,
    COUNT(*) FILTER (tier = 'Champion') AS champion, COUNT(*) FILTER (tier = 'Expert') AS expert, COUNT(*) FILTER (tier = 'Competitor') AS competitor,
    MAX(team_id) FILTER (p = 1) AS best_team, MAX(rating) AS best_rating
  FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY rating DESC, team_id) AS p FROM board
    WHERE is_active AND NOT is_provisional AND country <> '') GROUP BY country) WHERE teams >= 3"""))
def country_ranking(spark, sf):
    d = S.country_ranking(team_board(spark, sf), CFG)
    return d.select(*[c for c in d.columns if c not in ("score", "best_rating")], *r6("score", "best_rating"))


@query(with_board("""SELECT country, size_group, COUNT(*) AS teams FROM board
  WHERE is_active AND NOT is_provisional AND country <> '' GROUP BY ALL"""))
def country_size_counts(spark, sf):
    return S.country_size_counts(team_board(spark, sf))


@query(with_board("""SELECT team_id, region, row_number() OVER (PARTITION BY region ORDER BY rating DESC, team_id) AS region_rank
  FROM board JOIN (SELECT n_name AS country, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS region FROM nation)
  USING (country) WHERE is_active"""))
def regional_ranks(spark, sf):
    odd = F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd")
    regions = table(spark, sf, "nation").select(F.col("n_name").alias("country"), odd.alias("region"))
    return S.regional_ranks(team_board(spark, sf), regions).select("team_id", "region", "region_rank")


@query(with_results("""SELECT a.team_id AS team_a, b.team_id AS team_b, COUNT(*) AS shared_runs,
    COUNT(*) FILTER (coalesce(a.rank, 99999999) < coalesce(b.rank, 99999999)) AS wins_a,
    COUNT(*) FILTER (coalesce(b.rank, 99999999) < coalesce(a.rank, 99999999)) AS wins_b,
    COUNT(*) FILTER (coalesce(b.rank, 99999999) = coalesce(a.rank, 99999999)) AS draws
  FROM (SELECT team_id AS tb, MIN(team_id) OVER (PARTITION BY pool) AS ta FROM team) p
  JOIN results a ON a.team_id = ta JOIN results b ON b.team_id = tb AND b.run_id = a.run_id WHERE ta <> tb GROUP BY ALL"""))
def head_to_head(spark, sf):
    t = teams(spark, sf).select("pool", F.col("team_id").alias("team_b"))
    pairs = t.join(t.groupBy("pool").agg(F.min("team_b").alias("team_a")), "pool").filter("team_a <> team_b").select("team_a", "team_b")
    return S.head_to_head(results(spark, sf), pairs)


@query(with_results("""SELECT team_id, CASE WHEN team_id % 10 = 0 THEN 'S' ELSE arg_max(discipline, run_id) END AS size_group FROM results GROUP BY team_id"""))
def effective_size(spark, sf):
    r = results(spark, sf).withColumn("size", F.col("discipline"))
    overrides = teams(spark, sf).filter("team_id % 10 = 0").select("team_id", F.lit("S").alias("size_override"))
    return S.effective_size(r, overrides)


@query(with_board("""SELECT country AS handler, COUNT(*) OVER (PARTITION BY country) AS handler_teams,
  round(MAX(peak_rating) OVER (PARTITION BY country), 6) AS handler_peak, team_id, round(peak_rating, 6) AS peak_rating, is_active FROM board"""))
def handler_profile(spark, sf):
    b = team_board(spark, sf).withColumn("handler", F.col("country"))
    return S.handler_profile(b).select("handler", "handler_teams", "team_id", "is_active", *r6("handler_peak", "peak_rating"))


@query(with_results("""SELECT comp_id, run_id, pool, discipline, judge, COUNT(*) AS results, COUNT(*) FILTER (eliminated) AS eliminated
  FROM results GROUP BY ALL"""))
def run_summaries(spark, sf):
    return S.run_summaries(results(spark, sf))


@query(with_results("""SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY coalesce(rank, 99999999), team_id) AS line,
  team_id, rank, eliminated FROM results"""))
def run_results(spark, sf):
    return S.run_results(results(spark, sf)).select("run_id", "line", "team_id", "rank", "eliminated")


@query(with_results("SELECT run_id, team_id, name, c.date, c.tier FROM results r JOIN competition c USING (comp_id) WHERE c.tier = 1", COMPS))
def attach_competition(spark, sf):
    reg = contests.competitions(spark, sf).filter("tier = 1").select("comp_id", "name", "date", "tier")
    return S.attach_competition(results(spark, sf).select("run_id", "team_id", "comp_id"), reg).drop("comp_id")


@query(with_results("SELECT run_id, t.team_id, t.handler, t.country, slug, discipline, rank FROM results r JOIN competition USING (comp_id) JOIN team t USING (team_id)", COMPS))
def result_star(spark, sf):
    r = results(spark, sf)
    runs = r.select("run_id", "comp_id", "discipline").distinct()
    comps = contests.competitions(spark, sf).select("comp_id", "slug")
    t = teams(spark, sf).select("team_id", "handler", "country")
    return S.star(r.select("run_id", "team_id", "rank"), runs, comps, t).select("run_id", "team_id", "handler", "country", "slug", "discipline", "rank")


@query(with_results("SELECT comp_id, COUNT(*) AS rows, 'unknown competition ' || comp_id || ', rows skipped' AS warning FROM results WHERE comp_id NOT IN (SELECT comp_id FROM competition WHERE tier = 1) GROUP BY 1", COMPS))
def unknown_competitions(spark, sf):
    return S.known_only(results(spark, sf), contests.competitions(spark, sf).filter("tier = 1"))[1]


def _search_sql(q):
    return with_board(f"""SELECT type, display, subtitle FROM (
    SELECT 1 AS s, handler_norm AS o, 'handler' AS type, handler AS display, country AS subtitle FROM (SELECT DISTINCT handler, handler_norm, country FROM board WHERE contains(handler_norm, '{q}') ORDER BY handler_norm, handler LIMIT 10)
    UNION ALL SELECT 2, dog_norm, 'team', handler || ' & ' || dog, printf('%.0f', rating) FROM (SELECT * FROM board WHERE contains(dog_norm, '{q}') ORDER BY dog_norm, team_id LIMIT 10)
    UNION ALL SELECT 3, CAST(9999999 - comp_id AS VARCHAR), 'competition', name, CAST(date AS VARCHAR) FROM (SELECT * FROM competition WHERE contains(lower(name), '{q}') ORDER BY date DESC, comp_id LIMIT 10))
  ORDER BY s, o, display LIMIT 10""", COMPS)


@query(_search_sql("19"))
def search(spark, sf):
    from ladderspark.operators.search import search as find

    return find(team_board(spark, sf), contests.competitions(spark, sf), "19")


@query(_search_sql("0001"))
def indexed_search(spark, sf):
    from ladderspark.operators.search import search_index, write_index

    path = new_path(spark, "search-index")
    write_index(team_board(spark, sf), contests.competitions(spark, sf), path)
    return search_index(spark, path, " 0001")
