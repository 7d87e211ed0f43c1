"""Leaderboard operators over the team table: normalization, tiers, ranks, trends, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig
from ladderspark.operators.scan import row_numbers, spread, top_rows, with_group

TIERS = ("Elite", "Champion", "Expert", "Competitor")


def size_group(df: DataFrame) -> DataFrame:
    """Effective size: override, else own size, else L."""
    return df.withColumn("size_group", F.coalesce("size_override", "size", F.lit("L")))


def _score_params(teams: DataFrame, group: str, qualify: Column) -> DataFrame:
    return teams.filter(qualify).groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("rating").alias("_mean"), F.stddev_pop("rating").alias("_std")
    )


def zscore_normalize(
    teams: DataFrame,
    cfg: RatingConfig,
    group: str = "size_group",
    *,
    qualify: Column | None = None,
    snapshots: DataFrame | None = None,
):
    """Map ratings of each group to a common mean and spread.

    ``qualify`` picks the teams that give mean and spread (default: teams with a run). Groups with
    fewer than two teams or no spread get the target mean. Teams without runs stay untouched.
    """
    params = _score_params(teams, group, F.col("run_count") > 0 if qualify is None else qualify)
    flat = (F.col("_n") < 2) | (F.col("_std") < 1e-6)

    def scaled(col: str) -> Column:
        z = (F.col(col) - F.col("_mean")) / F.col("_std")
        return F.when(flat, F.lit(cfg.norm_mean)).otherwise(cfg.norm_mean + cfg.norm_std * z)

    d = teams.join(params, group, "left")
    keep = F.col("run_count") > 0
    for col in ("rating", "prev_rating"):
        d = d.withColumn(f"_{col}", F.when(keep & F.col("_n").isNotNull(), scaled(col)).otherwise(F.col(col)))
    d = d.withColumn("rating", F.col("_rating")).withColumn("prev_rating", F.col("_prev_rating"))
    d = d.drop("_n", "_mean", "_std", "_rating", "_prev_rating").select(teams.columns)
    if snapshots is None:
        return d
    s = snapshots.join(params, group, "left").withColumn("rating", scaled("rating")).select(snapshots.columns)
    return d, s


def tier_by_position(df: DataFrame, cfg: RatingConfig, group: str = "size_group") -> DataFrame:
    """Tier by position/count among active teams of a group (W10); inactive teams get null."""
    active = row_numbers(df.filter("is_active"), [group], [F.col("rating").desc(), F.col("team_id")], "_pos")
    active = with_group(active, [group], _n=F.count(F.lit(1)))
    share = (F.col("_pos") / F.col("_n"))
    tier = (
        F.when(share <= cfg.elite_top, TIERS[0])
        .when(share <= cfg.champion_top, TIERS[1])
        .when(share <= cfg.expert_top, TIERS[2])
        .otherwise(TIERS[3])
    )
    rest = df.filter("not is_active").withColumn("tier", F.lit(None).cast("string"))
    return active.withColumn("tier", tier).drop("_pos", "_n").unionByName(rest)


def tier_by_threshold(df: DataFrame, cfg: RatingConfig, group: str = "size_group") -> DataFrame:
    """Tier by the value at index int((n-1)*p) of the ascending active ratings.

    Thresholds come from the active teams, labels go to all teams; a group without active teams
    has no reachable threshold.
    """
    active = row_numbers(df.filter("is_active"), [group], [F.col("rating"), F.col("team_id")], "_pos")
    active = with_group(active, [group], _n=F.count(F.lit(1)))

    def cut(top: float) -> Column:
        at = F.floor((F.col("_n") - 1) * F.lit(1.0 - top)) + 1
        return F.max(F.when(F.col("_pos") == at, F.col("rating")))

    cuts = active.groupBy(group).agg(
        cut(cfg.elite_top).alias("elite_min"),
        cut(cfg.champion_top).alias("champion_min"),
        cut(cfg.expert_top).alias("expert_min"),
    )
    tier = (
        F.when(F.col("rating") >= F.col("elite_min"), TIERS[0])
        .when(F.col("rating") >= F.col("champion_min"), TIERS[1])
        .when(F.col("rating") >= F.col("expert_min"), TIERS[2])
        .otherwise(TIERS[3])
    )
    return df.join(cuts, group, "left").withColumn("tier", tier)


def global_ranks(df: DataFrame, group: str = "size_group") -> DataFrame:
    """Rank and previous rank of active teams per group, independent of any later filter."""
    by_now = [F.col("rating").desc(), F.col("team_id")]
    d = row_numbers(df.filter("is_active"), [group], by_now, "rank")
    had = d.withColumn("_had", F.coalesce(F.col("prev_rating") > 0, F.lit(False)))
    by_prev = [F.col("prev_rating").desc(), F.col("team_id")]
    before = row_numbers(had, [group, "_had"], by_prev, "_p")
    return before.withColumn("prev_rank", F.when(F.col("_had"), F.col("_p"))).drop("_p", "_had")


def trend(df: DataFrame) -> DataFrame:
    """Rank movement: NEW, up n, down n or same."""
    gain = F.col("prev_rank") - F.col("rank")
    label = (
        F.when(F.col("prev_rank").isNull(), F.lit("NEW"))
        .when(gain > 0, F.concat(F.lit("up "), gain.cast("string")))
        .when(gain < 0, F.concat(F.lit("down "), (-gain).cast("string")))
        .otherwise(F.lit("same"))
    )
    return df.withColumn("trend", label)


def peak_rating(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Highest rating an active team ever had; carried over from the previous team table."""
    if old is None:
        had = df.withColumn("_peak", F.lit(0.0))
    else:
        had = df.join(spread(old.select("team_id", F.col("peak_rating").alias("_peak"))), "team_id", "left")
    kept = F.coalesce("_peak", F.lit(0.0))
    return had.withColumn("peak_rating", F.when(F.col("is_active"), F.greatest(kept, "rating")).otherwise(kept)).drop("_peak")


def filter_rankings(
    df: DataFrame, *, size: str | None = None, country: str | None = None, search: str | None = None
) -> DataFrame:
    """Leaderboard predicates."""
    d = df.filter("is_active")
    if size is not None:
        d = d.filter(F.col("size_group") == size)
    if country:
        d = d.filter(F.col("country") == country)
    if search:
        text = search.lower()
        d = d.filter(F.col("handler_norm").contains(text) | F.col("dog_norm").contains(text))
    return d


def rankings_page(df: DataFrame, page: int = 1, page_size: int = 50) -> DataFrame:
    """One leaderboard page, best rating first (O1)."""
    return df.orderBy(F.col("rating").desc(), "team_id").offset((page - 1) * page_size).limit(page_size)


def top_k_per_group(df: DataFrame, k: int, group: str = "size_group") -> DataFrame:
    """Best ``k`` rows per group."""
    return top_rows(df, [group], [F.col("rating").desc(), F.col("team_id")], k, "place")


def recent(df: DataFrame, n: int, date: str = "date", key: str = "comp_id") -> DataFrame:
    """The ``n`` latest rows."""
    return df.orderBy(F.col(date).desc(), F.col(key).desc()).limit(n)


def compare_boards(a: DataFrame, b: DataFrame, min_a: int, min_b: int) -> DataFrame:
    """Full outer comparison of two leaderboards."""
    left = a.select("team_id", F.col("rating").alias("rating_a"), F.col("run_count").alias("runs_a"),
                    F.col("tier").alias("tier_a"), F.col("is_provisional").alias("prov_a"),
                    F.col("active_recent").alias("recent_a"))
    right = b.select("team_id", F.col("rating").alias("rating_b"), F.col("run_count").alias("runs_b"),
                     F.col("tier").alias("tier_b"), F.col("is_provisional").alias("prov_b"))
    d = left.join(spread(right), "team_id", "full")
    no = F.lit(False)
    return d.select(
        "team_id", "rating_a", "rating_b",
        (F.col("rating_b") - F.col("rating_a")).alias("rating_delta"),
        F.coalesce("runs_a", F.lit(0)).cast("bigint").alias("runs_a"),
        F.coalesce("runs_b", F.lit(0)).cast("bigint").alias("runs_b"),
        F.coalesce("tier_a", F.lit(TIERS[3])).alias("tier_a"),
        F.coalesce("tier_b", F.lit(TIERS[3])).alias("tier_b"),
        F.coalesce("prov_a", no).alias("prov_a"),
        F.coalesce("prov_b", no).alias("prov_b"),
        F.coalesce((F.col("runs_a") >= min_a) & F.col("recent_a"), no).alias("eligible_a"),
        F.coalesce(F.col("runs_b") >= min_b, no).alias("eligible_b"),
    )


def board_countries(df: DataFrame) -> DataFrame:
    """Distinct non-empty countries per board."""
    return df.filter("country <> ''").select("size_group", "country").distinct()
