"""Names that take others in order, decided for all at once.

Going through a sorted list, every name that nobody before it took takes all names that share a key with it. Such a walk is sequential only on paper: whether a
name acts depends on the smaller names it shares a key with, so all names whose smaller neighbours are settled can be settled together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladderspark.storage import materialize


def first_takers(offers: DataFrame, asks: DataFrame, by: str = "handler") -> DataFrame:
    """Who takes whom inside ``by``: ``by, o, taker``, one row per taken name; same result as the walk in the order of ``o``.

    ``offers`` and ``asks`` have ``by, key, o``. A name that acts takes those that ask for a key it offers; the smallest such name has it. A name acts unless a
    smaller one that acts took it. A name that asks for a key of its own must be asked back by whoever else offers that key (else leave the row out).
    Null keys meet nothing; repeated rows change nothing.

    Each round reads one minimum per key (of names still possible, and of names known to act) and settles every name that waits for none; neighbours are never
    listed, so a key of a million names costs a million rows. The number of rounds is the longest chain of names that wait for each other, each settles at
    least the smallest open name of every group, and only open names ask again.
    """
    asks = materialize(asks.select(by, "key", "o").distinct(), "asks")
    offered = materialize(offers.select(by, "key", "o").distinct(), "offers")
    # a name that no smaller one can take acts from the start
    near = offered.groupBy(by, "key").agg(F.min("o").alias("near"))
    waits = materialize(asks.join(near, [by, "key"]).filter("near < o").select(by, "o").distinct()
                        .join(offered.select(by, "o").distinct(), [by, "o"], "left_semi"), "open")
    live = materialize(offered.join(waits.withColumn("w", F.lit(True)), [by, "o"], "left").select(by, "key", "o", F.col("w").isNull().alias("acts")), "offers")
    open_ = materialize(asks.join(waits, [by, "o"], "left_semi"), "asks")
    while not open_.isEmpty():
        keys = live.groupBy(by, "key").agg(F.min("o").alias("near"), F.min(F.when(F.col("acts"), F.col("o"))).alias("act"))
        seen = open_.join(keys, [by, "key"], "left").groupBy(by, "o").agg(F.min("near").alias("near"), F.min("act").alias("act"))
        state = materialize(seen.select(by, "o", F.when(F.col("act") < F.col("o"), "taken").when(F.col("near") < F.col("o"), "open").otherwise("acts").alias("state")), "state")
        live = materialize(live.join(state, [by, "o"], "left").filter("state is null or state <> 'taken'")
                           .select(by, "key", "o", (F.col("acts") | (F.coalesce("state", F.lit("")) == "acts")).alias("acts")), "offers")
        open_ = materialize(open_.join(state.filter("state = 'open'"), [by, "o"], "left_semi"), "asks")
    act = live.groupBy(by, "key").agg(F.min("o").alias("taker"))
    return asks.join(act, [by, "key"]).groupBy(by, "o").agg(F.min("taker").alias("taker")).filter("taker <> o")
