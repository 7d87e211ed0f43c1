"""Result files in CSV: reading, format detection, writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladderspark.config import RatingConfig
from ladderspark.functions.names import strip
from ladderspark.operators.scan import row_numbers, running_sums
from ladderspark.schema import CANONICAL, HEADER_SYNONYMS, LEADERBOARD
from ladderspark.storage import materialize

QUOTED = {"escape": '"'}  # a quote inside a quoted field is doubled


def format_of(names: Column) -> Column:
    """Source format by the array of header names."""
    have = lambda *wanted: F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), names)) == 0
    return (
        F.when(F.slice(names, 1, 4) == F.array(*[F.lit(c) for c in CANONICAL[:4]]), "target")
        .when(have("competition_id", "run_id", "run_description"), "kacr")
        .when(have("bid", "run_description", "size_class"), "agigames")
        .otherwise("unknown")
    )


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), _seq (place in the order of files and lines), block (number of the part of the file that one task read), value; stored.

    Lines are numbered inside the block that one task reads; the counts of blocks and files are added up.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_pos"), "value")
    raw = materialize(raw, "lines")
    sizes = raw.groupBy("file", "_at").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    files = running_sums(sizes.groupBy("file").agg(F.sum("_n").alias("_all")), [], [F.col("file")], {"_upto": F.col("_all")})
    files = files.select("file", (F.col("_upto") - F.col("_all")).alias("_first"))
    starts = sizes.select("file", "_at", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).join(files, "file")
    inside = F.row_number().over(Window.partitionBy("file", "_at").orderBy("_pos"))
    lines = raw.join(starts, ["file", "_at"]).withColumn("line", F.col("_before") + inside)
    return materialize(lines.select("file", "line", (F.col("_first") + F.col("line")).alias("_seq"), F.col("_at").alias("block"), "value"), "numbered")


# A line as a step of the quote automaton. Outside of quotes a field that begins with a quote opens them; inside, doubled quotes stand for one, a single quote ends them, and what
# follows it up to the comma is plain.
_QUOTED = r"[^\"]*+(?:\"\"[^\"]*+)*+"
_AFTER = r"(?:[^\",][^,]*+)?+"
_OPENS = rf"(?:(?:\"{_QUOTED}\"{_AFTER}|{_AFTER}),)*+\"{_QUOTED}"
OPENS = f"^{_OPENS}$"  # begins outside of quotes and ends inside
STAYS_OPEN = rf"^{_QUOTED}(?:\"{_AFTER},{_OPENS})?+$"  # begins and ends inside


def records(lines: DataFrame) -> DataFrame:
    """Numbered lines -> records: lines that end inside quotes and those after them are one, joined by line feeds; ``line`` and ``_seq`` are those of its first line.

    Whether a line begins inside quotes depends on all lines before it. But a line is one of four steps on two states: it leads to one state from both, or keeps them, or exchanges them. So
    the state is where the last line of the first kind led, exchanged as often as lines of the last kind came since. Blocks of a file are composed the
    same way, so every block is scanned by itself and nobody reads a file in one go. Only the lines of records that have several are shuffled. Quotes that are never closed take the rest of their file.
    """
    d = lines.withColumn("_out", F.regexp_like("value", F.lit(OPENS)).cast("int")).withColumn("_in", F.regexp_like("value", F.lit(STAYS_OPEN)).cast("int"))
    swap, fixed = ((F.col("_out") == 1) & (F.col("_in") == 0)).cast("int"), F.col("_out") == F.col("_in")
    inside = Window.partitionBy("file", "block").orderBy("line")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # What a block does up to a line: the last fixed state, if any, with the exchanges before it, and all exchanges.
    d = d.withColumn("_swaps", F.sum(swap).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_fixed", F.when(fixed, F.struct((F.col("_out") + F.col("_swaps")).alias("v"))))
    d = d.withColumns({"_f": F.last("_fixed", True).over(before), "_s": F.coalesce(F.max("_swaps").over(before), F.lit(0))})
    blocks = d.groupBy("file", "block").agg(F.max_by("_fixed", F.when(F.col("_fixed").isNotNull(), F.col("line"))).alias("f"), F.max("_swaps").alias("s"))
    order = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("all", F.sum("s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = blocks.withColumn("g", F.when(F.col("f").isNotNull(), F.col("f.v") + F.col("all") - F.col("s")))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_g": F.coalesce(F.last("g", True).over(earlier), F.lit(0)), "_a": F.coalesce(F.max("all").over(earlier), F.lit(0))})
    d = d.join(blocks.select("file", "block", ((F.col("_g") + F.col("_a")) % 2).alias("_start")), ["file", "block"])
    state = F.when(F.col("_f").isNotNull(), (F.col("_f.v") + F.col("_s")) % 2).otherwise((F.col("_start") + F.col("_s")) % 2)
    d = d.withColumn("_begins", state == 0).withColumn("_ends", F.when(state == 0, F.col("_out")).otherwise(F.col("_in")) == 0)
    columns = ["file", "line", "_seq", "value"]
    if d.filter("not (_begins and _ends)").isEmpty():
        return lines.select(*columns)
    d = d.withColumn("_first", F.max(F.when(F.col("_begins"), F.struct("line", "_seq"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    d = materialize(d.select(*columns, "block", "_begins", "_ends", "_first"), "record-lines")
    heads = d.groupBy("file", "block").agg(F.max("_first").alias("_own"))
    heads = heads.select("file", "block", F.last("_own", True).over(earlier).alias("_carried"))
    many = d.filter("not (_begins and _ends)").join(heads, ["file", "block"]).withColumn("h", F.coalesce("_first", "_carried"))
    many = many.groupBy("file", "h.line", "h._seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("line").alias("at"), "value"))), lambda x: x["value"]), "\n").alias("value"))
    return d.filter("_begins and _ends").select(*columns).unionByName(many.select(*columns))


def headers(lines: DataFrame) -> DataFrame:
    """file, names: the first line of every file, lower-cased and trimmed."""
    first = lines.filter("line = 1").withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    return first.select("file", F.transform(_fields(first), lambda n: F.lower(F.coalesce(strip(n), F.lit("")))).alias("names"))


def _fields(lines: DataFrame) -> Column:
    """The fields of a record; as many as the widest header of all files can have."""
    width = lines.filter("line = 1").agg(F.coalesce(F.max(F.length(F.regexp_replace("value", "[^,]", ""))), F.lit(0))).first()[0] + 1
    parsed = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"quote": '"', **QUOTED})
    return F.array(*[parsed[f"c{i}"] for i in range(width)])


def detect_formats(spark: SparkSession, path: str) -> DataFrame:
    """file, format of every file of a path."""
    return headers(records(numbered_lines(spark, path))).select("file", format_of(F.filter("names", lambda n: n != "")).alias("format"))


def read_results_csv(spark: SparkSession, path: str, columns: list[str] = CANONICAL) -> DataFrame:
    """All result files of a path as trimmed strings.

    The first line of a file is its header, whatever it holds; files may differ in header case, order, synonyms and optional columns.
    Adds ``file``, ``source`` (directory name), ``line`` in the file (the header is line 1) and ``_seq``, the order of files and lines;
    blank rows are skipped. A quoted field may go over line ends, which become line feeds; its row has the number of its first line.
    """
    lines = records(numbered_lines(spark, path))
    names = F.transform("names", lambda n: F.coalesce(*[F.when(n == old, F.lit(new)) for old, new in HEADER_SYNONYMS.items()], n))
    heads = headers(lines).withColumn("names", names)
    places = lambda c: F.filter(F.transform("names", lambda n, i: F.when(n == c, i)), lambda i: i.isNotNull())
    heads = heads.select("file", *[places(c).alias(f"_at_{c}") for c in columns])
    rows = lines.filter("line > 1").select("file", "line", "_seq", _fields(lines).alias("_f")).join(heads, "file")
    value = lambda c: F.get(F.filter(F.transform(f"_at_{c}", lambda i: F.nullif(strip(F.get("_f", i)), F.lit(""))), lambda v: v.isNotNull()), F.lit(0))
    d = rows.select(*[value(c).alias(c) for c in columns], "file", F.element_at(F.split("file", "/"), -2).alias("source"), "line", "_seq")
    return d.filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull())


def write_canonical(df: DataFrame, path: str) -> None:
    """Canonical files, one directory per competition, rows in print order.

    Rows are range-partitioned by (competition, round), so a big competition spreads over tasks.
    """
    rank = F.col("rank").try_cast("int").asc_nulls_last()
    order = [F.col("competition"), F.col("round_key"), F.col("eliminated") == "True", rank, F.col("_seq")]
    (df.repartitionByRange(*order).sortWithinPartitions(*order)
     .select(*CANONICAL, F.col("competition").alias("comp_dir"))
     .write.mode("overwrite").partitionBy("comp_dir").options(header=True, **QUOTED).csv(path))


def leaderboard_rows(board: DataFrame, cfg: RatingConfig, size: str = "size_group") -> DataFrame:
    """Eligible teams per size with place and the file's rounding."""
    ok = board.filter(F.col("run_count") >= cfg.min_runs)
    placed = row_numbers(ok, [size], [F.col("rating").desc(), F.col("team_id")], "rank")
    pct = lambda c: F.round(F.col(c) * 100.0 / F.col("run_count"), 1)
    return placed.select(
        "rank", "handler", F.col("dog").alias("call_name"), F.lit("").alias("registered_name"), F.col(size).alias("size"), "country",
        F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"), F.round("rating", 1).alias("rating"),
        F.coalesce("tier", F.lit("Competitor")).alias("tier"), F.col("is_provisional").alias("provisional"),
        F.col("run_count").alias("num_runs"), pct("finished_run_count").alias("finished_pct"), pct("top3_run_count").alias("top3_pct"),
        F.col("last_comp").alias("last_competition"),
    ).select(*LEADERBOARD)


def write_leaderboard(board: DataFrame, cfg: RatingConfig, path: str) -> None:
    """Leaderboard CSV files, one directory per size, best first."""
    rows = leaderboard_rows(board, cfg).withColumn("size_dir", F.col("size"))
    (rows.repartitionByRange("size_dir", "rank").sortWithinPartitions("size_dir", "rank")
     .write.mode("overwrite").partitionBy("size_dir").options(header=True, **QUOTED).csv(path))
