"""Plackett-Luce rating: one update (R1, R2), ordered replay (R3, R7-R10), display values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig
from ladderspark.operators.scan import first_rows, row_numbers, spread, sums_back_and_forth, with_group
from ladderspark.storage import materialize, matching, new_path



# ---------------------------------------------------------------- one update


def pl_update(df: DataFrame, run: Sequence[str], cfg: RatingConfig) -> DataFrame:
    """Update every run of ``df`` at once; a team may occur in one run only.

    Needs columns ``team_id, rank_in, mu, sigma, weight`` and the run keys; adds ``new_mu`` and
    ``new_sigma`` (with decay and floor). Sums over ranks run on one row per (run, rank), in
    ranges of ranks, so a run with a huge field is spread over many tasks.
    """
    run = list(run)
    sig2 = F.col("sigma") * F.col("sigma")
    d = with_group(df, run, _c2=F.sum(sig2 + F.lit(cfg.beta**2)))
    d = d.withColumn("_c", F.sqrt("_c2")).withColumn("_e", F.exp(F.col("mu") / F.col("_c")))
    ties = d.groupBy(*run, "rank_in").agg(F.sum("_e").alias("_E"), F.count(F.lit(1)).alias("_a"))
    ties = sums_back_and_forth(
        ties, run, "rank_in", {"_S": F.col("_E")}, {"_z1": 1 / F.col("_S"), "_z2": 1 / (F.col("_S") * F.col("_S"))}
    )
    d = d.join(ties.select(*run, "rank_in", "_a", "_z1", "_z2"), [*run, "rank_in"])
    e, z1, z2, c = F.col("_e"), F.col("_z1"), F.col("_z2"), F.col("_c")
    omega = sig2 / c * (1 / F.col("_a") - e * z1)
    delta = F.pow(F.col("sigma") / c, 3) * (e * z1 - e * e * z2)
    shrunk = F.col("sigma") * F.sqrt(F.greatest(1 - delta, F.lit(cfg.kappa)))
    raw_sigma = F.col("sigma") + F.col("weight") * (shrunk - F.col("sigma"))
    return (
        d.withColumn("new_mu", F.col("mu") + F.col("weight") * omega)
        .withColumn("new_sigma", F.greatest(F.lit(cfg.sigma_min), raw_sigma * cfg.sigma_decay))
        .drop("_c2", "_c", "_e", "_a", "_z1", "_z2")
    )


# ------------------------------------------------------------ model field


def _finisher() -> Column:
    return (~F.col("eliminated")) & F.col("rank").isNotNull()


def _model_rank(d: DataFrame, run: Sequence[str], mode: str) -> DataFrame:
    """Model rank of rows that carry the number of finishers of their run as ``_ranked``."""
    finisher = _finisher()
    last = F.when(F.col("eliminated"), F.col("_ranked") + 1)
    if mode == "source":
        return d.withColumn("model_rank", F.when(finisher, F.col("rank").cast("bigint")).otherwise(last))
    if mode != "dense_order":
        raise ValueError(mode)
    split = d.withColumn("_fin", finisher.cast("int"))
    at = F.coalesce(F.col("rank"), F.lit(0)).cast("bigint")
    numbered = row_numbers(split, [*run, "_fin"], [at, F.col("_seq")], "_rn")
    ranked = F.when(F.col("_fin") == 1, F.col("_rn").cast("bigint")).otherwise(last)
    return numbered.withColumn("model_rank", ranked).drop("_fin", "_rn")


def rank_list(df: DataFrame, run: Sequence[str], mode: str = "source") -> DataFrame:
    """Rank per entrant for the model (W4): finishers by rank, eliminated tied at finishers + 1.

    ``mode="source"`` keeps the source rank with its ties, ``"dense_order"`` numbers the finishers
    1..n by (rank, _seq). Entrants with neither a rank nor an elimination get null.
    """
    return _model_rank(with_group(df, run, _ranked=F.count_if(_finisher())), run, mode).drop("_ranked")


def min_field(df: DataFrame, run: Sequence[str], n: int) -> DataFrame:
    """Keep runs with at least ``n`` entrants."""
    return with_group(df, run, _field=F.count(F.lit(1))).filter(F.col("_field") >= n).drop("_field")


def live_window(df: DataFrame, days: int, date: str = "date") -> DataFrame:
    """Rows dated within ``days`` before the latest date (F8).

    The latest date is read first, so that the cutoff reaches the scan as a literal.
    """
    latest = df.agg(F.max(date)).first()[0]
    if latest is None:
        return df.limit(0)
    return df.filter(F.col(date) >= F.date_sub(F.lit(latest), days))


def starts(results: DataFrame, pool: str = "pool", run: str = "run_id") -> DataFrame:
    """The columns of results that the replay reads. ``rated_field`` stores and aggregates whole rows, so what nobody reads is left out before."""
    return results.select(pool, run, "team_id", "date", "rank", "eliminated", "tier", "_seq")


def rated_field(
    results: DataFrame,
    cfg: RatingConfig,
    *,
    pool: str = "pool",
    run: str = "run_id",
    rank_mode: str = "source",
    eliminated: str = "last",
    min_ranked: int | None = None,
    inactivity: tuple[float, float] | None = None,
) -> DataFrame:
    """Results as the model sees them: one row per (run, team), with model rank, weight and order.

    ``eliminated`` is ``"last"``, ``"ignore"`` (R9) or ``"downweight"`` (R10). ``inactivity`` is
    ``(tau, sigma_max)`` and adds the variance collected while a team did not start (R7).
    """
    keys = [pool, run]
    # Stored, because the run totals, their numbering and the result all read it.
    entries = materialize(first_rows(results, [*keys, "team_id"], F.col("_seq")), "unique")
    finisher = _finisher()
    # One aggregate per run answers all questions about its field.
    runs = entries.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_field"),
        F.count_if(finisher).alias("_ranked"),
        F.count_if("eliminated").alias("_out"),
        F.min("date").alias("_d"),
    )
    rankable = F.col("_ranked") if eliminated == "ignore" else F.col("_ranked") + F.col("_out")
    least = cfg.min_ranked if min_ranked is None else min_ranked
    runs = runs.filter((F.col("_field") >= cfg.min_field) & (rankable >= least))
    days = F.datediff("_d", F.lit("1970-01-01"))
    runs = row_numbers(runs, [pool], [F.col("_d"), F.col(run)], "run_seq").drop("_d")
    d = entries.join(runs, keys)
    if eliminated == "ignore":
        d = d.filter(finisher)
    weight = F.when(F.col("tier") == 1, F.lit(cfg.major_event_weight)).otherwise(F.lit(1.0))
    if eliminated == "downweight":
        # Fixed values of the down-weighted variant: base 0.35, floor 0.10.
        share = F.greatest(F.lit(0.10), F.lit(0.35) * (1.0 - F.col("_out") / F.col("_field")))
        weight = F.when(F.col("eliminated"), share).otherwise(F.lit(1.0))
    ranked = _model_rank(d.withColumn("weight", weight), keys, rank_mode).drop("_field", "_ranked", "_out")
    if inactivity is None:
        return ranked.withColumn("extra_var", F.lit(0.0))
    return _with_idle_variance(ranked, results, pool, inactivity[0])


def _idle_calendar(results: DataFrame, pool: str) -> DataFrame:
    """One row per pool and calendar day: number of contest dates so far and sum of their day numbers."""
    day = F.datediff("date", F.lit("1970-01-01"))
    dates = results.select(pool, day.alias("day")).distinct()
    span = dates.groupBy(pool).agg(F.min("day").alias("_lo"), F.max("day").alias("_hi"))
    every = span.select(pool, F.explode(F.sequence("_lo", "_hi")).alias("day"))
    marked = every.join(dates.withColumn("_hit", F.lit(1)), [pool, "day"], "left")
    upto = Window.partitionBy(pool).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.coalesce(F.col("_hit"), F.lit(0))
    return marked.select(
        pool, "day", F.sum(hit).over(upto).alias("_n"), F.sum(hit * F.col("day")).over(upto).alias("_sum")
    )


def _idle_months(df: DataFrame, calendar: DataFrame, pool: str, last: str, now: str) -> DataFrame:
    """Sum of gap/30 over the contest dates in (last + 30, now]; every such date inflates once."""
    low = calendar.select(pool, (F.col("day") - 30).alias(last), F.col("_n").alias("_n0"), F.col("_sum").alias("_s0"))
    high = calendar.select(pool, F.col("day").alias(now), F.col("_n").alias("_n1"), F.col("_sum").alias("_s1"))
    d = df.join(low, [pool, last], "left").join(high, [pool, now], "left")
    gaps = (F.col("_s1") - F.col("_s0")) - (F.col("_n1") - F.col("_n0")) * F.col(last)
    return d.withColumn("idle_months", F.greatest(F.coalesce(gaps / 30.0, F.lit(0.0)), F.lit(0.0))).drop(
        "_n0", "_s0", "_n1", "_s1"
    )


def _with_idle_variance(ranked: DataFrame, results: DataFrame, pool: str, tau: float) -> DataFrame:
    calendar = _idle_calendar(results, pool)
    career = Window.partitionBy(pool, "team_id").orderBy("run_seq")
    d = ranked.withColumn("_now", F.datediff("date", F.lit("1970-01-01")))
    d = d.withColumn("_last", F.lag("_now").over(career))
    d = _idle_months(d, calendar, pool, "_last", "_now")
    return d.withColumn("extra_var", F.lit(tau * tau) * F.col("idle_months")).drop("_now", "_last", "idle_months")


def idle_after_last(teams: DataFrame, results: DataFrame, pool: str, tau: float, sigma_max: float) -> DataFrame:
    """Inflate sigma for the contests held after a team's last start."""
    calendar = _idle_calendar(results, pool)
    ends = calendar.groupBy(pool).agg(F.max("day").alias("_now"))
    d = teams.withColumn("_last", F.datediff("last_date", F.lit("1970-01-01"))).join(ends, pool)
    d = _idle_months(d, calendar, pool, "_last", "_now")
    grown = F.sqrt(F.col("sigma") * F.col("sigma") + F.lit(tau * tau) * F.col("idle_months"))
    capped = F.when(F.col("idle_months") > 0, F.least(F.lit(sigma_max), grown)).otherwise(F.col("sigma"))
    return d.withColumn("sigma", capped).drop("_last", "_now", "idle_months")


# ---------------------------------------------------------------- replay

_FIELD = ["run_seq", "run_id", "team_id", "date", "rank", "eliminated", "model_rank", "weight", "extra_var"]
_STATE = ["prev_mu", "prev_sigma", "mu", "sigma"]


def _plackett_luce(mu, sigma, rank, beta, kappa):
    var = sigma * sigma
    c = np.sqrt(np.sum(var + beta * beta))
    e = np.exp(mu / c)
    _, at, size = np.unique(rank, return_inverse=True, return_counts=True)
    behind = np.cumsum(np.bincount(at, weights=e)[::-1])[::-1]
    z1 = np.cumsum(1.0 / behind)[at]
    z2 = np.cumsum(1.0 / behind**2)[at]
    omega = var / c * (1.0 / size[at] - e * z1)
    delta = (sigma / c) ** 3 * (e * z1 - e * e * z2)
    return omega, sigma * np.sqrt(np.maximum(1.0 - delta, kappa)) - sigma


def _fold(cfg: RatingConfig, sigma_max: float | None):
    """Runs of one pool inside one batch, one after the other; teams without a state begin with the first one."""
    def fold(pdf: pd.DataFrame, states: pd.DataFrame | None = None) -> pd.DataFrame:
        pdf = pdf.sort_values(["run_seq", "team_id"], kind="stable").reset_index(drop=True)
        code, teams = pd.factorize(pdf["team_id"])
        mu, sigma = np.full(len(teams), float(cfg.mu0)), np.full(len(teams), float(cfg.sigma0))
        if states is not None:
            at = pd.Index(teams).get_indexer(states["team_id"])
            mu[at[at >= 0]], sigma[at[at >= 0]] = states["mu"].to_numpy()[at >= 0], states["sigma"].to_numpy()[at >= 0]
        rank = pdf["model_rank"].to_numpy(dtype="float64", na_value=np.nan)
        weight = pdf["weight"].to_numpy()
        extra = pdf["extra_var"].to_numpy()
        out = np.empty((4, len(pdf)))
        starts = np.flatnonzero(np.r_[True, np.diff(pdf["run_seq"].to_numpy()) != 0])
        for lo, hi in zip(starts, np.r_[starts[1:], len(pdf)]):
            who = code[lo:hi]
            idle = extra[lo:hi] > 0
            if sigma_max is not None and idle.any():
                t = who[idle]
                sigma[t] = np.minimum(sigma_max, np.sqrt(sigma[t] ** 2 + extra[lo:hi][idle]))
            out[0, lo:hi], out[1, lo:hi] = mu[who], sigma[who]
            ranked = ~np.isnan(rank[lo:hi])
            t, w = who[ranked], weight[lo:hi][ranked]
            up, shrink = _plackett_luce(mu[t], sigma[t], rank[lo:hi][ranked], cfg.beta, cfg.kappa)
            mu[t] = mu[t] + w * up
            sigma[t] = np.maximum(cfg.sigma_min, (sigma[t] + w * shrink) * cfg.sigma_decay)
            out[2, lo:hi], out[3, lo:hi] = mu[who], sigma[who]
        for i, name in enumerate(_STATE):
            pdf[name] = out[i]
        pdf["leaves"] = pdf["next_batch"].notna() & ~pdf["team_id"].duplicated(keep="last")
        return pdf

    return fold


def _with_states(now: DataFrame, states: DataFrame | None, pool: str, cfg: RatingConfig) -> DataFrame:
    """Entries with the state of their team, the first one where it has none."""
    if states is None:
        return now.withColumns({"mu": F.lit(float(cfg.mu0)), "sigma": F.lit(float(cfg.sigma0))})
    states = states.withColumnsRenamed({"mu": "_mu", "sigma": "_sigma"})
    now = now.join(spread(states), [pool, "team_id"], "left")
    return now.select("*", F.coalesce("_mu", F.lit(cfg.mu0)).alias("mu"), F.coalesce("_sigma", F.lit(cfg.sigma0)).alias("sigma")).drop("_mu", "_sigma")


def _update_level(now: DataFrame, pool: str, cfg: RatingConfig, sigma_max: float | None) -> DataFrame:
    """All runs of one level at once: no team starts twice, so the order among them doesn't matter."""
    if sigma_max is not None:
        grown = F.least(F.lit(sigma_max), F.sqrt(F.col("sigma") * F.col("sigma") + F.col("extra_var")))
        now = now.withColumn("sigma", F.when(F.col("extra_var") > 0, grown).otherwise(F.col("sigma")))
    moved = pl_update(now.filter("model_rank is not null").withColumnRenamed("model_rank", "rank_in"), [pool, "run_id"], cfg)
    kept = now.filter("model_rank is null").select("*", F.col("mu").alias("new_mu"), F.col("sigma").alias("new_sigma"))
    step = moved.withColumnRenamed("rank_in", "model_rank").unionByName(kept)
    step = step.withColumnsRenamed({"mu": "prev_mu", "sigma": "prev_sigma"}).withColumnsRenamed({"new_mu": "mu", "new_sigma": "sigma"})
    return step.withColumn("leaves", F.col("next_batch").isNotNull())


def _with_next(entries: DataFrame, pool: str) -> DataFrame:
    """Entries with the run that their team starts in next."""
    return entries.withColumn("next_run", F.lead("run_id").over(Window.partitionBy(pool, "team_id").orderBy("run_seq")))


def run_levels(entries: DataFrame, pool: str = "pool") -> DataFrame:
    """Level of every run: pool, run_id, level, entries (rows of the run); stored.

    A run is one level after the runs of the same day that a team of it came from, and all runs of a day are after those of earlier days. So no team
    starts twice in a level, and runs of all pools and places share one. There are as many levels as days, times the most runs that depend on each
    other within a day: the graph has an edge from each team's run to its next one, and longest paths are only followed inside a day.
    """
    if "next_run" not in entries.columns:
        entries = _with_next(entries, pool)
    runs = entries.groupBy(pool, "run_id").agg(F.min("date").alias("day"), F.count(F.lit(1)).alias("entries"))
    day = F.coalesce(F.datediff("day", F.lit("1970-01-01")), F.lit(-(1 << 30)))
    runs = materialize(runs.withColumn("day", day), "runs")
    steps = entries.filter("next_run is not null").select(pool, F.col("next_run").alias("run_id"), F.col("run_id").alias("before")).distinct()
    steps = steps.join(runs.select(pool, "run_id", "day"), [pool, "run_id"]).join(
        runs.select(pool, F.col("run_id").alias("before"), F.col("day").alias("day_before")), [pool, "before"])
    steps = materialize(steps, "run-steps")
    if not steps.filter("day < day_before").isEmpty():
        raise ValueError("run_seq is not in the order of the dates")
    edges = steps.filter("day = day_before").select(pool, "run_id", "before")
    depth = runs.withColumn("depth", F.lit(0))
    busy = not edges.isEmpty()
    while busy:
        ahead = edges.join(depth.select(pool, F.col("run_id").alias("before"), (F.col("depth") + 1).alias("least")), [pool, "before"])
        ahead = ahead.groupBy(pool, "run_id").agg(F.max("least").alias("least"))
        moved = materialize(depth.join(ahead, [pool, "run_id"], "left").select(
            pool, "run_id", "day", "entries", F.greatest("depth", F.coalesce("least", F.lit(0))).alias("depth"),
            F.coalesce(F.col("least") > F.col("depth"), F.lit(False)).alias("moved")), "depths")
        busy = not moved.filter("moved").isEmpty()
        depth = moved.drop("moved")
    # One row per level, so this window is as long as the calendar.
    levels = depth.groupBy("day", "depth").count().select("day", "depth", F.row_number().over(Window.orderBy("day", "depth")).alias("level"))
    return materialize(depth.join(levels, ["day", "depth"]).select(pool, "run_id", "level", "entries"), "levels")


def _batches(spark, levels: DataFrame, pool: str, most: int) -> tuple[DataFrame, list[tuple[int, bool]], int, int]:
    """Levels in order, as many together as give no pool more than ``most`` entries; a level with a larger pool stands alone. Returns (level, batch), of each
    batch its number and whether it is such a level, the most pools of a level and the most entries of a batch. The driver sees one row per level."""
    per_pool = levels.groupBy("level", pool).agg(F.sum("entries").alias("n"))
    seen = per_pool.groupBy("level").agg(F.max("n"), F.sum("n"), F.count(F.lit(1))).collect()
    rows, made, held, sizes = [], [], 0, []
    for level, n, total, _ in sorted(seen):
        if not made or held + n > most:
            made.append((len(made), n > most))
            sizes.append(0)
            held = 0
        held += n
        sizes[-1] += total
        rows.append((level, made[-1][0]))
    return spark.createDataFrame(rows, "level int, batch int"), made, max((r[3] for r in seen), default=1), max(sizes, default=0)


_SLICE = 250_000  # entries of a batch that one task writes


def replay(
    entries: DataFrame,
    cfg: RatingConfig,
    *,
    pool: str = "pool",
    sigma_max: float | None = None,
    batch_entries: int = 100_000,
) -> DataFrame:
    """Sequential replay over ordered runs (R3): one row per entrant with the state before and after.

    Runs that share no team need no order, so the replay goes by levels of the run graph (``run_levels``), over all pools at once. A level is one
    distributed update of all its runs (``pl_update``), however many entries a pool or a run has. Levels too small for a job of their own are taken together, up to
    ``batch_entries`` entries of one pool, and folded run by run inside each pool: no group ever gets more than that, and more pools are more groups. Both give the
    same values. A batch reads its own rows and the states that earlier batches addressed to it, and writes its history in folders by the next batch each team
    starts in, which are those states: one job a batch. States meet the rows of their pool in its task, or are joined by sorting for a level of its own; they are never
    sent through the driver. ``run_seq`` orders the runs of a pool and must follow their dates.
    """
    spark = entries.sparkSession
    entries = materialize(_with_next(entries.select(pool, *_FIELD), pool), "entries")
    levels = run_levels(entries, pool)
    plan, batches, pools, largest = _batches(spark, levels, pool, batch_entries)
    # Stored, so that the planner knows that it is small: rows from the driver have no size, and all entries would be broadcast instead.
    placed = materialize(levels.join(plan, "level").select(pool, "run_id", "batch"), "placed")
    # A team leaves a batch with its last row there, whose next run is in a later batch.
    after = placed.select(pool, F.col("run_id").alias("next_run"), F.col("batch").alias("next_batch"))
    numbered = entries.join(placed, [pool, "run_id"]).join(after, [pool, "next_run"], "left").drop("next_run")
    # Few files: a folder has one per slice, not one per task.
    numbered = numbered.repartition("batch", F.pmod(F.hash(pool, "team_id"), F.lit(4 + largest // _SLICE)))
    numbered = materialize(numbered, "batched", ["batch"])
    history = new_path(spark, "history")
    columns = [pool, *_FIELD, *_STATE]
    width = min(2 * pools, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = numbered.select(pool, *_FIELD, *[F.lit(0.0).alias(c) for c in _STATE], F.lit(True).alias("leaves")).schema
    for number, alone in batches:
        now = numbered.filter(F.col("batch") == number).drop("batch")
        sent = matching(spark, f"{history}/batch=*/to={number}")
        states = spark.read.schema(written).parquet(*sent).filter("leaves").select(pool, "team_id", "mu", "sigma") if sent else None
        if alone:
            done = _update_level(_with_states(now, states, pool, cfg), pool, cfg, sigma_max)
        else:
            # Dates go through pandas as day numbers. A number of parts that is given keeps small pools apart.
            now = now.withColumn("date", F.unix_date("date")).repartition(width, pool)
            schema = now.select(pool, *_FIELD, "next_batch", *[F.lit(0.0).alias(c) for c in _STATE], F.lit(True).alias("leaves")).schema
            fold, names = _fold(cfg, sigma_max), schema.fieldNames()
            if states is None:
                done = now.groupBy(pool).applyInPandas(lambda pdf: fold(pdf)[names], schema)
            else:
                met = now.groupBy(pool).cogroup(states.repartition(width, pool).groupBy(pool))
                done = met.applyInPandas(lambda pdf, held: fold(pdf, held)[names], schema)
            done = done.withColumn("date", F.date_from_unix_date("date"))
        done.select(*columns, "leaves", F.col("next_batch").alias("to")).write.partitionBy("to").parquet(f"{history}/batch={number}")
    if not batches:
        return entries.select("*", *[F.lit(0.0).alias(c) for c in _STATE])
    return spark.read.schema(written).parquet(history).select(*columns)


# ---------------------------------------------------------------- display values


def base_rating(cfg: RatingConfig, mu: str = "mu", sigma: str = "sigma") -> Column:
    return F.lit(cfg.display_base) + cfg.display_scale * (F.col(mu) - cfg.sigma_multiplier * F.col(sigma))


def quality_factor(cfg: RatingConfig, runs: str = "run_count", top3: str = "top3_run_count") -> Column:
    """Podium boost: share of top-3 runs against the target, clamped to 0..1."""
    share = F.when(F.col(runs) > 0, F.col(top3) / F.col(runs)).otherwise(0.0)
    clamped = F.least(F.greatest(share / cfg.podium_target, F.lit(0.0)), F.lit(1.0))
    return cfg.podium_base + cfg.podium_range * clamped


def display_rating(df: DataFrame, cfg: RatingConfig) -> DataFrame:
    """Raw display rating and its previous value."""
    return (
        df.withColumn("quality", quality_factor(cfg))
        .withColumn("rating", base_rating(cfg) * F.col("quality"))
        .withColumn("prev_rating", base_rating(cfg, "prev_mu", "prev_sigma") * F.col("quality"))
    )


def flags(df: DataFrame, cfg: RatingConfig) -> DataFrame:
    """Active and provisional flags."""
    return df.withColumn("is_active", F.col("run_count") >= cfg.min_runs).withColumn(
        "is_provisional", F.col("sigma") >= cfg.provisional_sigma
    )


def rating_history(snapshots: DataFrame, team: Column) -> DataFrame:
    """Rating curve of the selected teams with a sigma band, running peak and peak mark."""
    chosen = snapshots.filter(team)
    career = Window.partitionBy("team_id").orderBy("run_seq").rowsBetween(Window.unboundedPreceding, 0)
    top = chosen.groupBy("team_id").agg(
        F.min_by("run_seq", F.struct(-F.col("rating"), F.col("run_seq"))).alias("_peak")
    )
    return chosen.join(top, "team_id").select(
        "team_id", "run_seq", "date", "rating",
        (F.col("rating") - F.col("sigma")).alias("low"),
        (F.col("rating") + F.col("sigma")).alias("high"),
        F.max("rating").over(career).alias("peak_so_far"),
        (F.col("run_seq") == F.col("_peak")).alias("is_peak"),
    )
