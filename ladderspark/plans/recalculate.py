"""Full rating recalculation: results in, team table and snapshots out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig
from ladderspark.operators import board
from ladderspark.operators.rating import base_rating, display_rating, flags, live_window, quality_factor, rated_field, replay, starts
from ladderspark.operators.scan import spread
from ladderspark.storage import materialize


def team_states(history: DataFrame, by: list[str], rank: str = "rank") -> DataFrame:
    """Last state, previous state (W15) and run counts per team from the replay history."""
    rated = F.col("model_rank").isNotNull()
    done = rated & ~F.col("eliminated")
    last = F.when(rated, F.col("run_seq"))
    return history.groupBy(*by).agg(
        F.max_by("mu", last).alias("mu"),
        F.max_by("sigma", last).alias("sigma"),
        F.max_by("prev_mu", last).alias("prev_mu"),
        F.max_by("prev_sigma", last).alias("prev_sigma"),
        F.count_if(rated).alias("run_count"),
        F.count_if(done).alias("finished_run_count"),
        F.count_if(done & (F.col(rank) <= 3)).alias("top3_run_count"),
        F.count_if(done & (F.col(rank) <= 10)).alias("top10_run_count"),
        F.max(F.when(rated, F.col("date"))).alias("last_date"),
    )


def prev_state(history: DataFrame, by: list[str]) -> DataFrame:
    """State of each team before its last update."""
    return team_states(history, by).select(*by, "prev_mu", "prev_sigma")


def start_state(teams: DataFrame, cfg: RatingConfig) -> DataFrame:
    """Teams reset to the initial state."""
    zero = F.lit(0).cast("bigint")
    return teams.select(
        "*",
        F.lit(cfg.mu0).alias("mu"), F.lit(cfg.sigma0).alias("sigma"),
        F.lit(cfg.mu0).alias("prev_mu"), F.lit(cfg.sigma0).alias("prev_sigma"),
        zero.alias("run_count"), zero.alias("finished_run_count"),
        zero.alias("top3_run_count"), zero.alias("top10_run_count"),
        F.lit(None).cast("date").alias("last_date"),
    )


def recalculate(
    results: DataFrame,
    teams: DataFrame,
    cfg: RatingConfig,
    *,
    pool: str = "pool",
    rank_mode: str = "source",
    eliminated: str = "last",
    old: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``teams`` has ``team_id`` and ``size_group``; every team comes out, rated or reset.

    Ratings are per team; with several pools a team takes part in the pool of its size group.
    """
    field = rated_field(live_window(starts(results, pool), cfg.live_window_days), cfg, pool=pool,
                        rank_mode=rank_mode, eliminated=eliminated)
    history = replay(field, cfg, pool=pool)
    history = materialize(history, "replayed")
    rank = "rank" if rank_mode == "source" else "model_rank"
    states = team_states(history, ["team_id"], rank)
    fresh = start_state(teams, cfg)
    carried = [c for c in states.columns if c != "team_id"]
    joined = teams.join(spread(states.select("team_id", *[F.col(c).alias(f"_{c}") for c in carried])), "team_id", "left")
    merged = fresh_or(joined, cfg, carried)
    raw = display_rating(merged.select(fresh.columns), cfg)
    snaps = history.join(
        spread(raw.select("team_id", "size_group", "run_count", "top3_run_count")), "team_id"
    ).withColumn("rating", base_rating(cfg) * quality_factor(cfg))
    normal, snaps = board.zscore_normalize(raw, cfg, snapshots=snaps)
    flagged = board.peak_rating(flags(normal, cfg), old)
    tiered = board.tier_by_position(materialize(flagged, "flagged"), cfg)
    return tiered, snaps.drop("run_count", "top3_run_count")


def fresh_or(joined: DataFrame, cfg: RatingConfig, carried: list[str]) -> DataFrame:
    """Replayed values where a team was rated, initial values elsewhere."""
    start = {"mu": cfg.mu0, "prev_mu": cfg.mu0, "sigma": cfg.sigma0, "prev_sigma": cfg.sigma0}
    out = joined
    for c in carried:
        default = F.lit(start[c]) if c in start else (F.lit(None).cast("date") if c == "last_date" else F.lit(0).cast("bigint"))
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), default)).drop(f"_{c}")
    return out
