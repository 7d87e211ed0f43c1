"""Aggregations over results and the team table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig
from ladderspark.operators.scan import row_numbers, spread, top_rows


def team_stats(results: DataFrame, by: Sequence[str] = ("team_id",)) -> DataFrame:
    """Runs, finishes, podiums and their shares per team (A1)."""
    done = (~F.col("eliminated")) & F.col("rank").isNotNull()
    d = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(~F.col("eliminated")).alias("finished_runs"),
        F.count_if(done & (F.col("rank") <= 3)).alias("top3_runs"),
        F.count_if(done & (F.col("rank") <= 10)).alias("top10_runs"),
    )
    for c in ("finished", "top3", "top10"):
        d = d.withColumn(f"{c}_pct", F.col(f"{c}_runs") * 100.0 / F.col("runs"))
    return d


def avg_rank(results: DataFrame, by: Sequence[str] = ("team_id",)) -> DataFrame:
    """Average rank over finished runs, null without one (A2)."""
    return results.groupBy(*by).agg(F.avg(F.when(~F.col("eliminated"), F.col("rank"))).alias("avg_rank"))


def participants(results: DataFrame) -> DataFrame:
    """Distinct teams per competition (A3)."""
    return results.groupBy("comp_id").agg(F.count_distinct("team_id").alias("participants"))


def competition_stats(results: DataFrame, ratings: DataFrame) -> DataFrame:
    """Per competition: teams per size, runs, entries, finish share, average final rating (A4)."""
    runs = results.groupBy("comp_id").agg(
        F.count_distinct("run_id").alias("runs"),
        F.count(F.lit(1)).alias("entries"),
        (F.count_if(~F.col("eliminated")) * 100.0 / F.count(F.lit(1))).alias("finished_pct"),
    )
    teams = results.select("comp_id", "team_id").distinct().join(
        spread(ratings.select("team_id", "size_group", "rating")), "team_id"
    )
    per_size = teams.groupBy("comp_id", "size_group").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("rating").alias("_r")
    )
    sizes = per_size.groupBy("comp_id").agg(
        (F.sum("_r") / F.sum("_n")).alias("avg_rating"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("size_group", "_n")))).alias("teams_by_size"),
    )
    return runs.join(sizes, "comp_id", "left")


def summary(board: DataFrame, results: DataFrame) -> DataFrame:
    """Qualified teams, competitions and runs as one row (A5)."""
    zero = F.lit(0).cast("bigint")
    teams = board.filter("is_active").agg(F.count(F.lit(1)).alias("teams")).select("teams", zero.alias("comps"), zero.alias("runs"))
    rest = results.agg(F.count_distinct("comp_id").alias("comps"), F.count_distinct("run_id").alias("runs"))
    both = teams.unionByName(rest.select(zero.alias("teams"), "comps", "runs"))
    return both.agg(F.max("teams").alias("qualified_teams"), F.max("comps").alias("competitions"), F.max("runs").alias("runs"))


def tier_distribution(board: DataFrame, by: Sequence[str] = ("size_group",)) -> DataFrame:
    """Active teams and provisional teams per tier."""
    return board.filter("is_active").groupBy(*by, "tier").agg(
        F.count(F.lit(1)).alias("teams"), F.count_if("is_provisional").alias("provisional")
    )


def diacritics_score(c: Column) -> Column:
    """Number of non-ASCII characters."""
    return F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def mode_by(df: DataFrame, key: Sequence[str], value: str, seq: str = "_seq") -> DataFrame:
    """Most frequent non-empty value per key; ties go to more non-ASCII letters, then first seen."""
    v = F.trim(F.col(value))
    counts = df.filter(v != "").groupBy(*key, v.alias(value)).agg(
        F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_first")
    )
    best = F.struct((-F.col("_n")).alias("n"), (-diacritics_score(F.col(value))).alias("d"), F.col("_first").alias("f"))
    return counts.groupBy(*key).agg(F.min_by(value, best).alias(value))


def last_competition(results: DataFrame) -> DataFrame:
    """Name of the latest competition per team; the later row wins ties."""
    return results.groupBy("team_id").agg(
        F.max_by("comp_name", F.struct("date", "run_id", "_seq")).alias("last_comp"), F.max("date").alias("last_date")
    )


def activity(results: DataFrame, days: int = 365, least: int = 3) -> DataFrame:
    """Runs in the last ``days`` before the latest date, and the activity flag (A10)."""
    latest = results.agg(F.max("date")).first()[0]
    recent = F.count_if(F.col("date") >= F.date_sub(F.lit(latest), days))
    return results.groupBy("team_id").agg(recent.alias("recent_runs")).withColumn(
        "is_recent", F.col("recent_runs") >= least
    )


def qa_report(df: DataFrame, file: str, round_key: str) -> DataFrame:
    """Rows, eliminations and distinct teams per file and round with file and grand totals."""
    return df.rollup(file, round_key).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("eliminated").alias("eliminated"),
        F.count_if(F.col("rank").isNull() & ~F.col("eliminated")).alias("unranked"),
    )


def country_ranking(board: DataFrame, cfg: RatingConfig) -> DataFrame:
    """Country score: mean of the best N active, non-provisional teams."""
    ok = board.filter("is_active and not is_provisional and country <> ''")
    top = top_rows(ok, ["country"], [F.col("rating").desc(), F.col("team_id")], cfg.country_top_n, "_place")
    best = top.groupBy("country").agg(
        F.avg("rating").alias("score"), F.max(F.when(F.col("_place") == 1, F.col("team_id"))).alias("best_team"))
    d = ok.groupBy("country").agg(
        F.count(F.lit(1)).alias("teams"),
        *[F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("Elite", "Champion", "Expert", "Competitor")],
        F.max("rating").alias("best_rating"),
    ).join(best, "country")
    d = d.filter(F.col("teams") >= cfg.min_country_teams)
    d = d.withColumn("is_provisional", F.col("teams") < cfg.country_top_n)
    return row_numbers(d, [], [F.col("score").desc(), F.col("country")], "rank")


def country_size_counts(board: DataFrame) -> DataFrame:
    """Qualified teams per country and size (part of A12)."""
    ok = board.filter("is_active and not is_provisional and country <> ''")
    return ok.groupBy("country", "size_group").agg(F.count(F.lit(1)).alias("teams"))


def regional_ranks(board: DataFrame, regions: DataFrame) -> DataFrame:
    """Ranks inside a region instead of a size group (A21); ``regions`` maps country to region."""
    d = board.filter("is_active").join(regions, "country")
    return row_numbers(d, ["region"], [F.col("rating").desc(), F.col("team_id")], "region_rank")


def head_to_head(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shared runs of given team pairs and who was placed better.

    An eliminated team places behind every finisher; two eliminated teams draw.
    """
    place = F.when(F.col("eliminated"), F.lit(2**31)).otherwise(F.col("rank"))
    seen = results.select("run_id", "team_id", place.alias("place"))
    a = seen.select("run_id", F.col("team_id").alias("team_a"), F.col("place").alias("place_a"))
    b = seen.select("run_id", F.col("team_id").alias("team_b"), F.col("place").alias("place_b"))
    shared = pairs.join(a, "team_a").join(b, ["team_b", "run_id"])
    return shared.groupBy("team_a", "team_b").agg(
        F.count(F.lit(1)).alias("shared_runs"),
        F.count_if(F.col("place_a") < F.col("place_b")).alias("wins_a"),
        F.count_if(F.col("place_b") < F.col("place_a")).alias("wins_b"),
        F.count_if(F.col("place_b") == F.col("place_a")).alias("draws"),
    )


def effective_size(results: DataFrame, overrides: DataFrame) -> DataFrame:
    """Size from the latest run unless overridden (W18); ``overrides`` has team_id, size_override."""
    latest = results.groupBy("team_id").agg(F.max_by("size", F.struct("date", "_seq")).alias("_size"))
    return latest.join(overrides, "team_id", "left").select(
        "team_id", F.coalesce("size_override", "_size", F.lit("L")).alias("size_group")
    )


def handler_profile(board: DataFrame) -> DataFrame:
    """Every team of a handler with its peak, next to the handler's totals (part of A19)."""
    totals = board.groupBy("handler").agg(
        F.count(F.lit(1)).alias("handler_teams"), F.max("peak_rating").alias("handler_peak")
    )
    # A left join, because only its right side can be sent to every task: the totals, never the teams.
    return board.filter("handler is not null").join(totals, "handler", "left").select(
        "handler", "country", "handler_teams", "handler_peak",
        "team_id", "dog", "size_group", "rating", "peak_rating", "is_active",
    )


def run_summaries(results: DataFrame) -> DataFrame:
    """Runs of each competition with result counts (part of A19)."""
    return results.groupBy("comp_id", "run_id", "pool", "discipline", "judge").agg(
        F.count(F.lit(1)).alias("results"), F.count_if("eliminated").alias("eliminated")
    )


def run_results(results: DataFrame) -> DataFrame:
    """Result table of each run with its place in print order: finishers by rank, then the eliminated."""
    return row_numbers(results, ["run_id"], [F.col("rank").asc_nulls_last(), F.col("team_id")], "line").select(
        "run_id", "line", "team_id", "handler", "dog", "rank", "eliminated", "total_faults", "time"
    )


def star(results: DataFrame, runs: DataFrame, comps: DataFrame, teams: DataFrame) -> DataFrame:
    """Results with run, competition and team attributes."""
    return results.join(runs, "run_id").join(comps, "comp_id").join(spread(teams), "team_id")


def attach_competition(results: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry name, date and tier for each result; unknown competitions drop out."""
    return results.join(registry, "comp_id")


def known_only(results: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of known competitions, and a warning per unknown one."""
    known = results.join(registry.select("comp_id"), "comp_id", "left_semi")
    unknown = results.join(registry.select("comp_id"), "comp_id", "left_anti").groupBy("comp_id").agg(
        F.count(F.lit(1)).alias("rows")
    )
    text = F.concat(F.lit("unknown competition "), F.col("comp_id").cast("string"), F.lit(", rows skipped"))
    return known, unknown.withColumn("warning", text)


def team_detail(board: DataFrame, results: DataFrame) -> DataFrame:
    """Team record with shares and average rank."""
    share = lambda c: F.when(F.col("run_count") > 0, F.col(c) * 100.0 / F.col("run_count")).otherwise(0.0)
    return board.join(spread(avg_rank(results)), "team_id", "left").select(
        "team_id", "handler", "country", "dog", "size_group", "rating", "sigma", "prev_rating", "peak_rating",
        "run_count", "finished_run_count", "top3_run_count", "is_active", "is_provisional", "tier",
        share("finished_run_count").alias("finished_pct"), share("top3_run_count").alias("top3_pct"), "avg_rank",
    )


def filter_competitions(comps: DataFrame, *, year=None, tier=None, country=None, search=None) -> DataFrame:
    """Competition predicates."""
    d = comps
    if year is not None:
        d = d.filter(F.year("date") == year)
    if tier is not None:
        d = d.filter(F.col("tier") == tier)
    if country:
        d = d.filter(F.col("country") == country)
    if search:
        d = d.filter(F.col("name").contains(search))
    return d


def competitions_page(comps: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """Competition page, latest first (O2)."""
    return comps.orderBy(F.col("date").desc(), "comp_id").offset((page - 1) * page_size).limit(page_size)


def team_results_page(results: DataFrame, team_id, page: int = 1, page_size: int = 20) -> DataFrame:
    """Result page of one team, latest first, then run (O3)."""
    d = results.filter(F.col("team_id") == team_id)
    return d.orderBy(F.col("date").desc(), "run_id").offset((page - 1) * page_size).limit(page_size)
