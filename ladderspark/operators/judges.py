"""Judge statistics over all results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.operators.scan import running_sums

# Weights and full-score levels of the toughness components.
WEIGHTS = {"elimination_rate": 0.35, "faulted_rate": 0.25, "avg_faults": 0.20, "time_fault_rate": 0.20}
FULL_SCORE = {"elimination_rate": 0.40, "faulted_rate": 0.80, "avg_faults": 12.0, "time_fault_rate": 0.50}
MIN_RUNS = 10
MIN_SIGNATURE_FIELD = 20


def judge_components(results: DataFrame) -> DataFrame:
    """Elimination rate, faulted rate, average faults and time-fault rate per judge."""
    done = ~F.col("eliminated")
    finishers = F.count_if(done)
    share = lambda n: F.when(finishers > 0, n / finishers)
    return results.filter("judge is not null").groupBy("judge").agg(
        F.count_distinct("run_id").alias("runs"),
        (F.count_if(F.col("eliminated")) / F.count(F.lit(1))).alias("elimination_rate"),
        (1 - share(F.count_if(done & (F.col("total_faults") == 0)))).alias("faulted_rate"),
        share(F.sum(F.when(done, F.col("total_faults")))).alias("avg_faults"),
        share(F.count_if(done & (F.col("time_faults") > 0))).alias("time_fault_rate"),
    )


def toughness(components: DataFrame, least: int = MIN_RUNS) -> DataFrame:
    """Weighted score from 0 to 10, null below ``least`` runs."""
    def part(name: str) -> Column:
        level = F.least(F.greatest(F.coalesce(F.col(name), F.lit(0.0)) / FULL_SCORE[name], F.lit(0.0)), F.lit(1.0))
        return level * (10 * WEIGHTS[name])

    score = sum((part(n) for n in WEIGHTS), F.lit(0.0))
    return components.withColumn("toughness", F.when(F.col("runs") >= least, score))


def toughness_percentile(df: DataFrame) -> DataFrame:
    """Share of scored judges with at most the own score.

    Judges are counted per score, the counts are summed from the lowest score up.
    """
    scored = df.filter("toughness is not null")
    per = scored.groupBy("toughness").agg(F.count(F.lit(1)).alias("_n"))
    per = running_sums(per, [], [F.col("toughness")], {"_upto": F.col("_n")})
    total = scored.count()
    share = per.select("toughness", (F.col("_upto") / total).alias("percentile"))
    return df.join(share, "toughness", "left")


def judge_profile(results: DataFrame) -> DataFrame:
    """Volume, dates, field size, tier-1 share, countries and most judged competition."""
    r = results.filter("judge is not null")
    runs = r.groupBy("judge", "run_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("tier").alias("tier"), F.min("comp_id").alias("comp_id"))
    volume = runs.groupBy("judge").agg(
        F.count(F.lit(1)).alias("total_runs"), F.avg("n").alias("avg_participants"),
        (F.count_if(F.col("tier") == 1) / F.count(F.lit(1))).alias("tier1_share"))
    people = r.groupBy("judge").agg(
        F.count_distinct("team_id").alias("teams"), F.count_distinct("comp_id").alias("competitions"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    most = runs.groupBy("judge", "comp_id").agg(F.count(F.lit(1)).alias("n")).groupBy("judge").agg(
        F.max_by("comp_id", F.struct("n", (-F.col("comp_id")).alias("c"))).alias("most_judged_competition"))
    return volume.join(people, "judge").join(most, "judge").join(_countries(r), "judge", "left")


def _countries(r: DataFrame) -> DataFrame:
    """Comma list of the countries judged in; there are at most as many as country codes."""
    pairs = r.filter("comp_country is not null").select("judge", "comp_country").distinct()
    return pairs.groupBy("judge").agg(F.array_join(F.array_sort(F.collect_list("comp_country")), ",").alias("countries"))


def judge_distributions(results: DataFrame) -> DataFrame:
    """Runs per size and discipline, and finishers per fault bucket in percent, as labelled rows.

    Buckets: clean 0, low up to 5, medium up to 10, high above.
    """
    r = results.filter("judge is not null")
    runs = r.groupBy("judge", "run_id").agg(F.min("pool").alias("size"), F.min("discipline").alias("discipline"))
    f = F.col("total_faults")
    bucket = F.when(f == 0, "clean").when(f <= 5, "low").when(f <= 10, "medium").otherwise("high")
    done = r.filter(~F.col("eliminated")).groupBy("judge", bucket.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = done.groupBy("judge").agg(F.sum("n").alias("_all"))
    faults = done.join(totals, "judge").select("judge", F.lit("faults").alias("kind"), "label", (F.col("n") * 100.0 / F.col("_all")).alias("value"))

    def by(col: str) -> DataFrame:
        n = runs.groupBy("judge", F.col(col).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        return n.select("judge", F.lit(col).alias("kind"), "label", "value")

    return by("size").unionByName(by("discipline")).unionByName(faults)


def as_map(distributions: DataFrame) -> DataFrame:
    """One map column per judge and kind; the labels are a small fixed set."""
    return distributions.groupBy("judge", "kind").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "value")))).alias("distribution"))


def judge_course_design(results: DataFrame) -> DataFrame:
    """Average of median time over standard time, and average spread of speed per run.

    The median is taken from counts per time, summed from the fastest up, so a run is not
    collected in one place.
    """
    done = results.filter("judge is not null and not eliminated")
    sct = done.groupBy("judge", "run_id").agg(F.min("sct").alias("sct"), F.stddev_samp("speed").alias("spread"))
    timed = done.filter("time is not null").groupBy("run_id", "time").agg(F.count(F.lit(1)).alias("_n"))
    timed = running_sums(timed, ["run_id"], [F.col("time")], {"_upto": F.col("_n")})
    sizes = timed.groupBy("run_id").agg(F.max("_upto").alias("_all"))
    t = timed.join(sizes, "run_id")
    at = lambda k: F.min(F.when(F.col("_upto") >= k, F.col("time")))
    median = t.groupBy("run_id").agg(
        ((at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2).alias("median_time"))
    d = sct.join(median, "run_id", "left")
    return d.groupBy("judge").agg(
        F.avg(F.when(F.col("sct") > 0, F.col("median_time") / F.col("sct"))).alias("sct_tightness"),
        F.avg("spread").alias("speed_spread"))


def signature_runs(results: DataFrame, least: int = MIN_SIGNATURE_FIELD) -> DataFrame:
    """Run with the highest elimination rate and with the highest clean rate per judge."""
    done = ~F.col("eliminated")
    runs = results.filter("judge is not null").groupBy("judge", "run_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("eliminated")) / F.count(F.lit(1))).alias("out"),
        (F.count_if(done & (F.col("total_faults") == 0)) / F.nullif(F.count_if(done), F.lit(0))).alias("clean"),
    ).filter(F.col("n") >= least)
    low = (-F.col("run_id")).alias("r")
    return runs.groupBy("judge").agg(
        F.max_by("run_id", F.struct("out", low)).alias("toughest_run"),
        F.max_by("run_id", F.when(F.col("clean").isNotNull(), F.struct("clean", low))).alias("cleanest_run"))


def judges_page(df: DataFrame, sort: str = "toughness", page: int = 1, page_size: int = 20) -> DataFrame:
    """Judge page with missing scores last."""
    return df.orderBy(F.col(sort).desc_nulls_last(), "judge").offset((page - 1) * page_size).limit(page_size)
