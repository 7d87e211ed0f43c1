"""Mixing sources to target weights by hash thresholds: histograms of hash buckets, refined only where a budget ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladderspark.llm.common import free_name, query, table, whole_text
from ladderspark.storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


def word_count(col: str = "text") -> Column:
    return F.regexp_count(whole_text(col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources by code point, null last, take the weights in turn. Together they get `share` of all words by weight; a target stops
    at `cap` times its source and the excess goes to the others by weight. With the sources ordered by cap/weight, the level
    per unit of weight is the largest of (what is left) / (weight that is left) over all cuts between full and open sources.
    The table has one row per source, already summed, so these windows are small.
    """
    table_of = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    s = sizes.withColumn("w", F.element_at(table_of, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("budget", F.sum("source_size").over(every) * share).withColumn("all_w", F.sum("w").over(every))
    full = F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0))
    spent_w = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    s = s.withColumn("level", (F.col("budget") - full) / (F.col("all_w") - spent_w))
    s = s.withColumn("level", F.max("level").over(every))
    return s.select("source", "source_size", F.least(F.col("source_size") * cap, F.col("level") * F.col("w")).alias("target"))


def source_plan(narrow: DataFrame, weights=(3, 1, 2), share: float = 1.5, cap: float = 2.0, bits: int = 10, levels: int = 4) -> DataFrame:
    """(source, size, hash) -> per source: source_size, target, whole (copies of every document), cut: documents with
    hash below cut are taken once more.

    Level by level a histogram of `bits` more hash bits is summed for the one bucket in which the budget of a source ends, so a source
    of any size needs 2^bits sums per level and no sort of documents. The last bucket is taken if that comes nearer.
    """
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, share, cap)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    plan = materialize(plan, "mix-plan")
    for level in range(1, levels + 1):
        shift = HASH_BITS - bits * level
        own = plan.select(F.col("source").alias("s"), "prefix", "rest")
        hist = (
            narrow.join(own, narrow["source"].eqNullSafe(own["s"]) & (F.shiftright("hash", shift + bits) == F.col("prefix")))
            .groupBy(F.col("s"), "rest", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("mass"))
        )
        upto = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = (
            hist.withColumn("upto", F.sum("mass").over(upto)).where(F.col("upto") > F.col("rest"))
            .groupBy("s").agg(F.min(F.struct("bucket", "upto", "mass", "rest")).alias("e"))
            .select("s", F.col("e.bucket").alias("bucket"), (F.col("e.rest") - F.col("e.upto") + F.col("e.mass")).alias("left_over"), F.col("e.mass").alias("mass"))
        )
        p = plan.join(ends, plan["source"].eqNullSafe(ends["s"]), "left")
        nearer = (F.col("left_over") * 2 > F.col("mass")) if level == levels else F.lit(False)
        # A source without such a bucket has no words: nothing is left to place, its prefix grows by zeros.
        plan = p.select(
            "source", "source_size", "target", "whole", F.coalesce("left_over", "rest").alias("rest"),
            (F.coalesce("bucket", F.shiftleft("prefix", bits)) + F.coalesce(nearer.cast("long"), F.lit(0))).alias("prefix"),
        )
    return materialize(plan.select("source", "source_size", "target", "whole", F.shiftleft("prefix", HASH_BITS - bits * levels).alias("cut")), "mix-plan")


def hash_of(doc_id: str = "doc_id") -> Column:
    return F.xxhash64(F.col(doc_id)).bitwiseAND((1 << HASH_BITS) - 1)


def mix(docs: DataFrame, **plan_args) -> DataFrame:
    """One row per row of docs (doc_id, text, source): doc_id, source, size, source_size, target, taken.

    taken is size times the copies the mix takes (0, 1 or 2). Null and empty texts have size 0 and take 0. Rows with
    equal doc_id have one hash and are taken alike; a null doc_id hashes like any value. An empty table gives an empty result; other columns are ignored.
    """
    narrow = materialize(docs.select("doc_id", "source", word_count().alias("size"), hash_of().alias("hash")), "mix-sizes")
    plan = source_plan(narrow, **plan_args)
    own = plan.withColumnRenamed("source", "s")
    times = F.col("whole") + (F.col("hash") < F.col("cut")).cast("long")
    return narrow.join(own, narrow["source"].eqNullSafe(own["s"])).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_rows(docs: DataFrame, **plan_args) -> DataFrame:
    """The rows of docs the mix takes, all columns, as often as it takes them."""
    narrow = materialize(docs.select("source", word_count().alias("size"), hash_of().alias("hash")), "mix-sizes")
    plan = source_plan(narrow, **plan_args)
    s, whole, cut, times = (free_name(docs, f"mix_{x}") for x in ("source", "whole", "cut", "times"))
    own = plan.select(F.col("source").alias(s), F.col("whole").alias(whole), F.col("cut").alias(cut))
    n = (F.col(whole) + (hash_of() < F.col(cut)).cast("long")).cast("int")
    return docs.join(own, docs["source"].eqNullSafe(own[s])).withColumn(times, F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)


@query("op8_mixing")
def op8_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")
