"""Ranks and running sums that do not put a whole group into one task.

A window over a group sorts the group in one task. Here the rows are range-partitioned by group and order first, with sampled
splitters, so a part is bounded for any distribution. Counts or sums per (group, part) are few and are added up; the
sort only ever sees one part of one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderspark.storage import materialize


def spread(df: DataFrame) -> DataFrame:
    """A side that grows with the input: joins sort and merge it instead of sending it through the driver.

    Sizes of files and shuffles are compressed. A table of names below the broadcast threshold by them is many times larger as rows, and several such tables
    of one plan are built in the driver at once.
    """
    return df.hint("merge")


_PART = 8 << 20  # bytes of compressed input whose rows one task sorts


def parts_for(spark: SparkSession, size: int) -> int:
    """Parts for a shuffle of an input of ``size`` bytes. The number set for the session stays as it is while inputs grow, and a task's sort grows with them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _PART))


def with_group(df: DataFrame, by: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates. The aggregate combines map-side, the join may broadcast it."""
    stats = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(stats, list(by))


def _parts(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """df with _range, the number of its range of (by, order). Stored, so that every reader sees the same ranges."""
    return materialize(df.repartitionByRange(*[F.col(b) for b in by], *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _with_starts(parts: DataFrame, by: Sequence[str], sums: dict[str, Column], backwards: bool = False) -> DataFrame:
    """Attach to every row the sums over the parts of its group that come before (after, if backwards); null keys are a group.

    Only the first group of a range can go on from another one, so there are fewer starts than ranges, however many groups there are.
    """
    totals = parts.groupBy(*by, "_range").agg(*[c.alias(f"_t_{n}") for n, c in sums.items()])
    ranges = F.col("_range").desc() if backwards else F.col("_range")
    before = Window.partitionBy(*by).orderBy(ranges).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(b).alias(f"_k_{b}") for b in by], F.col("_range").alias("_q"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_s_{n}") for n in sums], F.count(F.lit(1)).over(before).alias("_earlier"))
    starts = starts.filter("_earlier > 0").drop("_earlier")
    on = parts["_range"] == starts["_q"]
    for b in by:
        on = on & parts[b].eqNullSafe(starts[f"_k_{b}"])
    placed = parts.join(starts, on, "left").drop("_q", *[f"_k_{b}" for b in by])
    return placed.withColumns({f"_s_{n}": F.coalesce(f"_s_{n}", F.lit(0)) for n in sums})


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """row_number() over (partition by ``by`` order by ``order``)."""
    parts = _parts(df, by, order)
    local = Window.partitionBy(*by, "_range").orderBy(*order)
    placed = _with_starts(parts, by, {"n": F.count(F.lit(1))})
    return placed.withColumn(name, F.col("_s_n") + F.row_number().over(local)).drop("_range", "_s_n")


def _sums_over(parts: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column], backwards: bool = False) -> DataFrame:
    """Running sums over stored ranges; keeps _range for further sums. Backwards, ``order`` is the reverse of the order of the ranges."""
    parts = parts.select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()])
    local = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _with_starts(parts, by, {n: F.sum(f"_v_{n}") for n in sums}, backwards)
    for n in sums:
        out = out.withColumn(n, F.col(f"_s_{n}") + F.sum(f"_v_{n}").over(local))
    return out.drop(*[f"_v_{n}" for n in sums], *[f"_s_{n}" for n in sums])


def running_sums(df: DataFrame, by: Sequence[str], order: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """sum() over (partition by ``by`` order by ``order`` rows unbounded preceding)."""
    return _sums_over(_parts(df, by, order), by, order, sums).drop("_range")


def sums_back_and_forth(df: DataFrame, by: Sequence[str], order: str, back: dict[str, Column], forth: dict[str, Column]) -> DataFrame:
    """Sums from the end of the group to the row, then sums of expressions over these from its start to the row, on one stored range table.

    ``order`` is unique within a group.
    """
    parts = _sums_over(_parts(df, by, [F.col(order)]), by, [F.col(order).desc()], back, True)
    return _sums_over(parts, by, [F.col(order)], forth).drop("_range")


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group with their place: every task keeps k rows of a group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, place.cast("bigint")).filter(F.col(name) <= k)


def first_rows(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the lowest ``order`` per key, as an aggregate (copies of one key combine map-side)."""
    return _edge_rows(df, keys, order, F.min_by)


def last_rows(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    return _edge_rows(df, keys, order, F.max_by)


def _edge_rows(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)
