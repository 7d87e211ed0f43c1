"""Search over handlers, teams and competitions (O5): a scan, and a stored index of letter groups for tables that are searched often."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST = 2  # letters of a query
BUCKETS = 256  # folders of the index; a query of n letters reads n - 2 of them at most


def entries(board: DataFrame, comps: DataFrame) -> DataFrame:
    """What can be found: source, text (searched), at and tie (order within the source), type, display, subtitle."""
    none = F.lit(None).cast("bigint")
    people = board.select("handler", "handler_norm", "country").distinct().select(
        F.lit(1).alias("source"), F.col("handler_norm").alias("text"), F.col("handler_norm").alias("at"), none.alias("tie"), F.lit("handler").alias("type"),
        F.col("handler").alias("display"), F.col("country").alias("subtitle"))
    teams = board.select(
        F.lit(2).alias("source"), F.col("dog_norm").alias("text"), F.col("dog_norm").alias("at"), F.col("team_id").cast("bigint").alias("tie"), F.lit("team").alias("type"),
        F.concat("handler", F.lit(" & "), "dog").alias("display"), F.format_string("%.0f", F.col("rating")).alias("subtitle"))
    latest_first = F.date_format(F.date_add(F.lit("2100-01-01").cast("date"), -F.datediff("date", F.lit("1970-01-01"))), "yyyy-MM-dd")
    events = comps.select(
        F.lit(3).alias("source"), F.lower("name").alias("text"), latest_first.alias("at"), F.col("comp_id").cast("bigint").alias("tie"), F.lit("competition").alias("type"),
        F.col("name").alias("display"), F.date_format("date", "yyyy-MM-dd").alias("subtitle"))
    return people.unionByName(teams).unionByName(events)


def _best(found: DataFrame, limit: int) -> DataFrame:
    """``limit`` hits per source, handlers before teams before competitions, then ``limit`` overall."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("at", "tie", "display"))
    hits = found.withColumn("_p", place).filter(F.col("_p") <= limit)
    return hits.orderBy("source", "at", "display").limit(limit).select("type", "display", "subtitle")


def search(board: DataFrame, comps: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Up to ``limit`` hits by reading everything.

    Queries below two letters find nothing. ``limit`` is the size of the hit list shown to a user.
    """
    text = query.strip().lower()
    if len(text) < LEAST:
        board, comps = board.limit(0), comps.limit(0)
    return _best(entries(board, comps).filter(F.contains("text", F.lit(text))), limit)


def _groups(text: Column) -> Column:
    """The distinct groups of two and three letters of a text."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(
        F.array().cast("array<string>"))
    return F.array_distinct(F.concat(of(2), of(3)))


def write_index(board: DataFrame, comps: DataFrame, path: str) -> None:
    """Store the entries once for each of their letter groups, in folders by a checksum of the group and in the order of the groups there.

    A row carries what a hit shows, so a search needs no other table.
    """
    grams = entries(board, comps).select("*", F.explode(_groups(F.col("text"))).alias("gram"))
    grams = grams.withColumn("bucket", (F.crc32(F.col("gram").cast("binary")) % BUCKETS).cast("int"))
    # A group that very many entries have is spread over tasks by the entry.
    (grams.repartitionByRange("bucket", "gram", "at", "display").sortWithinPartitions("bucket", "gram", "source", "at")
     .write.partitionBy("bucket").parquet(path))


def search_index(spark: SparkSession, path: str, query: str, limit: int = 10) -> DataFrame:
    """The same hits as ``search``, from the folders of the query's letter groups alone.

    An entry must have all groups of three letters of the query (the query itself, if it has two); the text decides.
    """
    text = query.strip().lower()
    grams = sorted({text[i:i + 3] for i in range(max(len(text) - 2, 1))})
    index = spark.read.parquet(path)
    if len(text) < LEAST:
        return _best(index.drop("gram", "bucket").limit(0), limit)
    read = index.filter(F.col("bucket").isin(sorted({zlib.crc32(g.encode()) % BUCKETS for g in grams})) & F.col("gram").isin(grams) & F.contains("text", F.lit(text)))
    columns = ["source", "text", "at", "tie", "type", "display", "subtitle"]
    whole = read.groupBy(*columns).agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == len(grams))
    return _best(whole.select(*columns), limit)
