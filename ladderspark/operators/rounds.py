"""Order-dependent row operators of single files: best copies, placements, sequences, keys, slugs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.functions.names import strip
from ladderspark.operators.scan import first_rows, row_numbers, running_sums, spread, with_group


def dedup_best(df: DataFrame, keys: Sequence[str] = ("round_key", "handler", "dog")) -> DataFrame:
    """Best copy per key (W2): with a result first, then lowest rank, else the first row.

    Among copies without a result the rank does not count.
    """
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    result = filled("total_faults") & filled("time")
    rank = F.when(result, strip(F.col("rank")).try_cast("int"))
    order = F.struct(F.when(result, 0).otherwise(1), rank.isNull(), F.coalesce(rank, F.lit(0)), F.col("_seq"))
    return first_rows(df, list(keys), order)


def derive_rank(df: DataFrame, run: Sequence[str], penalty: str, time: str) -> DataFrame:
    """Placement by (penalty, time), missing last; eliminated rows get none."""
    done = df.filter(~F.col("eliminated"))
    by = [F.col(c).cast("double").asc_nulls_last() for c in (penalty, time)]
    done = row_numbers(done, run, [*by, F.col("_seq")], "rank")
    out = df.filter(F.col("eliminated")).withColumn("rank", F.lit(None).cast("bigint"))
    return done.withColumn("rank", F.col("rank").cast("bigint")).unionByName(out)


def fill_running_rank(df: DataFrame, run: Sequence[str]) -> DataFrame:
    """A missing rank is the last known one plus the position in the gap (W6); eliminated rows have none.

    A known rank r at finisher position p gives r - p to the following gap, so the fill is a
    running "last value". It is carried as a running sum of differences, which needs no group sort
    beyond one block.
    """
    done = row_numbers(df.filter(~F.col("eliminated")), run, [F.col("_seq")], "_pos")
    known = F.col("rank").isNotNull()
    anchors = row_numbers(done.filter(known), run, [F.col("_seq")], "_k").select(
        *run, "_k", (F.col("rank") - F.col("_pos")).alias("_shift")
    )
    counted = running_sums(done, run, [F.col("_seq")], {"_k": known.cast("bigint")})
    filled = counted.join(anchors, [*run, "_k"], "left").withColumn(
        "rank", (F.col("_pos") + F.coalesce("_shift", F.lit(0))).cast("bigint")
    ).drop("_pos", "_k", "_shift")
    out = df.filter(F.col("eliminated")).withColumn("rank", F.lit(None).cast("bigint"))
    return filled.select(*df.columns).unionByName(out.select(*df.columns))


def assign_sequence(runs: DataFrame, by: Sequence[str] = ("discipline", "size"), order: str = "run_order") -> DataFrame:
    """Number runs per (discipline, size) in run order."""
    return row_numbers(runs, list(by), [F.col(order)], "seq")


def split_round_keys(df: DataFrame, file: str = "file") -> DataFrame:
    """One key with several (judge, sct, mct) signatures becomes numbered keys by first appearance.

    A trailing number of the key is replaced.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sig = F.concat_ws("|", blank("judge"), blank("sct"), blank("mct"))
    d = df.withColumn("_sig", sig)
    runs = d.groupBy(file, "round_key", "_sig").agg(F.min("_seq").alias("_first"))
    runs = row_numbers(runs, [file, "round_key"], [F.col("_first")], "_no")
    runs = with_group(runs, [file, "round_key"], _runs=F.count(F.lit(1)))
    base = F.regexp_replace("round_key", r"^(.+)_(\d+)$", "$1")
    new = F.when(F.col("_runs") > 1, F.concat(base, F.lit("_"), F.col("_no").cast("string"))).otherwise(F.col("round_key"))
    runs = runs.select(file, "round_key", "_sig", new.alias("_new"))
    return d.join(runs, [file, "round_key", "_sig"]).withColumn("round_key", F.col("_new")).select(df.columns)


def unique_slugs(df: DataFrame, base: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """Unique slugs in creation order (W9): a row gets the first free one of its base, base-2, base-3, ...

    Taken are existing slugs and numbered bases of other rows. Before the i-th taken number t there are t - i free ones, so the
    n-th row gets n plus the taken numbers with t - i < n: a running count over both in one order.
    """
    d = row_numbers(df, [base], [F.col(order)], "_n")
    used = df.select(F.col(base).alias("slug")).distinct()
    old = used.limit(0) if existing is None else existing.select("slug").distinct()
    number = F.regexp_extract("slug", r"-(\d+)$", 1).try_cast("bigint")
    stem = F.regexp_replace("slug", r"-\d+$", "")
    numbered = old.unionByName(used).filter(number >= 2).select(stem.alias(base), number.alias("_v"))
    whole = old.select(F.col("slug").alias(base), F.lit(1).cast("bigint").alias("_v"))
    taken = row_numbers(whole.unionByName(numbered).distinct(), [base], [F.col("_v")], "_i")
    marks = taken.select(base, (F.col("_v") - F.col("_i")).alias("_n"), F.lit(1).cast("bigint").alias("_taken"))
    asks = d.select(base, "_n", F.lit(0).cast("bigint").alias("_taken")).distinct()
    both = running_sums(marks.unionByName(asks), [base], [F.col("_n"), F.col("_taken")], {"_before": F.col("_taken")})
    no = both.filter("_taken = 0").select(base, "_n", (F.col("_n") + F.col("_before")).alias("_no"))
    slug = F.when(F.col("_no") == 1, F.col(base)).otherwise(F.concat(base, F.lit("-"), F.col("_no").cast("string")))
    return d.join(spread(no), [base, "_n"]).withColumn("slug", slug).drop("_n", "_no")
