"""Contest view over the star-schema tables: suppliers compete once per month within their region.

It gives the operators their input shapes: results, runs, competitions and teams.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ladderspark.operators.scan import parts_for, running_sums, spread
from ladderspark.storage import input_bytes, materialize, stored

JUDGES = ["Jiří Novák", "Anna-Lena Groß", "Łukasz Wójcik", "Søren Ødegård", "Ms Guest", "María José Peña", "Tom O'Neil"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ten_thousandths(amount: Column) -> Column:
    """An amount with four decimals as a whole number: sums of those are updated in place, which those of wide decimals are not.

    It rounds as a decimal does. Only near the middle of two numbers, or where doubles have few decimals left, that takes the slow way through the decimal itself.
    """
    scaled = amount * 10000
    clear = (F.abs(scaled - F.rint(scaled)) < 0.49) & (F.abs(scaled) < 1e11)
    return F.when(clear, F.rint(scaled).cast("bigint")).otherwise((amount.cast("decimal(18,4)") * 10000).cast("bigint"))


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", _ten_thousandths(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
    )
    order = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.trunc("o_orderdate", "month").alias("date")
    )
    # Lines meet the orders of a part of bounded size, whose orders are hashed: the lines need no sort.
    parts = parts_for(spark, sum(input_bytes(spark, f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders")))
    line, order = line.repartition(parts, "l_orderkey"), order.repartition(parts, "l_orderkey")
    return line.join(order.hint("shuffle_hash"), "l_orderkey").groupBy(F.col("l_suppkey").alias("team_id"), "date").agg(
        (F.sum("amount").cast("decimal(20,0)") * F.lit(Decimal("0.0001"))).cast("decimal(28,4)").alias("score"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
    )


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Team dimension: handler = supplier, country = nation, size = region."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    r = table(spark, sf_dir, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return s.join(n, "s_nationkey").join(r, "n_regionkey").select(
        F.col("s_suppkey").alias("team_id"),
        F.col("s_name").alias("handler"),
        F.concat(F.lit("Dog "), F.col("s_suppkey").cast("string")).alias("dog"),
        F.col("n_name").alias("country"),
        F.col("r_name").alias("size_group"),
        F.col("r_name").alias("pool"),
        F.col("n_regionkey").cast("bigint").alias("pool_id"),
        F.lower("s_name").alias("handler_norm"),
        F.lower(F.concat(F.lit("Dog "), F.col("s_suppkey").cast("string"))).alias("dog_norm"),
    )


def _build_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _monthly(spark, sf_dir).join(
        spread(teams(spark, sf_dir).select("team_id", "handler", "dog", "country", "pool", "pool_id")), "team_id"
    )
    comp = (F.year("date") * 100 + F.month("date")).cast("bigint")
    d = d.select(
        "*",
        comp.alias("comp_id"),
        (comp * 10 + F.col("pool_id")).alias("run_id"),
        (F.col("returned") * 10 >= F.col("lines") * 6).alias("eliminated"),
        F.floor(F.col("score") / 20000).cast("bigint").alias("coarse"),
    )
    # Read again for the ranks: stored, so that the big join of lines and orders runs once.
    d = materialize(d, "entered")
    # rank() per run over the coarse score: counts per score level, summed from the best level down
    levels = d.filter("not eliminated").groupBy("run_id", "coarse").agg(F.count(F.lit(1)).alias("_k"))
    best = [F.col("coarse").desc()]
    levels = running_sums(levels, ["run_id"], best, {"_upto": F.col("_k")})
    levels = levels.select("run_id", "coarse", (F.col("_upto") - F.col("_k") + 1).alias("_place"))
    d = d.join(levels, ["run_id", "coarse"], "left")
    done = ~F.col("eliminated")
    faults = F.col("lines") % 3
    refusals = F.col("returned") % 3
    late = F.when(F.col("qty") % 3 == 0, (F.col("qty") % 7) / 4.0).otherwise(0.0)
    time = 30 + (F.col("qty") % 97) / 4.0
    length = (150 + F.col("comp_id") % 7 * 5).cast("double")
    month = F.year("date") * 12 + F.month("date")
    judge = F.element_at(F.array(*[F.lit(j) for j in JUDGES]), (month % 7 + 1).cast("int"))
    return d.select(
        "run_id", "comp_id", "date", "pool", "team_id", "handler", "dog", "country", "eliminated",
        F.concat(F.lit("Cup "), F.col("comp_id").cast("string")).alias("comp_name"),
        F.when(done, F.col("_place")).cast("bigint").alias("rank"),
        F.when(F.month("date") % 3 == 0, 1).otherwise(2).cast("bigint").alias("tier"),
        F.element_at(F.array(F.lit("Agility"), F.lit("Jumping"), F.lit("Final")),
                     (F.month("date") % 3 + 1).cast("int")).alias("discipline"),
        F.when((F.col("pool_id") == 4) & (F.year("date") == 1995), F.lit("Guest Judge")).otherwise(judge).alias("judge"),
        F.when(done, faults).alias("faults"),
        F.when(done, refusals).alias("refusals"),
        F.when(done, late).alias("time_faults"),
        F.when(done, faults * 5 + refusals * 5 + late).alias("total_faults"),
        F.when(done, time).alias("time"),
        F.when(done, F.round(length / time, 2)).alias("speed"),
        F.lit(45.0).alias("sct"),
        F.lit(70.0).alias("mct"),
        length.alias("course_length"),
        F.col("team_id").alias("_seq"),
        F.col("score").cast("double").alias("score"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (run, team), stored once per application."""
    return stored(spark, sf_dir, "results", lambda: _build_results(spark, sf_dir))


def competitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of competitions, one per month with an order."""
    d = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("date")).distinct()
    comp = (F.year("date") * 100 + F.month("date")).cast("bigint")
    return d.select(
        comp.alias("comp_id"), "date",
        F.last_day("date").alias("end_date"),
        F.concat(F.lit("Cup "), comp.cast("string")).alias("name"),
        F.concat(F.lit("cup-"), comp.cast("string")).alias("slug"),
        F.when(F.month("date") % 3 == 0, 1).otherwise(2).cast("bigint").alias("tier"),
        F.concat(F.lit("NATION_"), (F.month("date") * 2 % 25).cast("string")).alias("country"),
    )
