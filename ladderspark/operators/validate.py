"""Validation, repair and exclusion of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.functions.names import strip
from ladderspark.operators.scan import spread

# Allowed labels, markers of an elimination and of junk rows.
DISCIPLINES = ["Agility", "Jumping", "Final"]
SIZES = ["Small", "Medium", "Intermediate", "Large"]
MARKERS = ["DIS", "DISQ", "DQ", "DNF", "DNS", "NP"]
RANK_TOKENS = ["DIS", "DSQ", "NFC", "RET", "WD"]
NOTE_CODES = ["HYL", "DIS", "EL", "ELIM", "ABS", "DNS", "POIS", "KESK"]
MEASURES = ["rank", "faults", "refusals", "time_faults", "total_faults", "time", "speed"]
REQUIRED = ["round_key", "handler", "dog", "discipline", "size"]


def _empty(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit("")) == ""


def _row(text: Column) -> Column:
    return F.concat(F.lit("Row "), F.col("line").cast("string"), F.lit(": "), text)


def validate_results(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check import rows with string columns and a ``file, line`` position (F1).

    Returns the rows and one message per fault. Copies of a (round, handler, dog) key after the
    first are errors; the first line per key is found by an aggregate, not by sorting the key.
    """
    messages = [F.when(_empty(c), _row(F.lit(f"{c} is required."))) for c in REQUIRED]
    allowed = F.lower(strip(F.col("discipline"))).isin([d.lower() for d in DISCIPLINES])
    messages.append(F.when(~_empty("discipline") & ~allowed,
                           _row(F.concat(F.lit("discipline '"), F.col("discipline"), F.lit("' is invalid.")))))
    key = F.lower(F.concat_ws("|", "round_key", "handler", "dog"))
    complete = ~_empty("round_key") & ~_empty("handler") & ~_empty("dog")
    keyed = df.withColumn("_key", F.when(complete, key))
    first = keyed.filter("_key is not null").groupBy("file", "_key").agg(
        F.min("line").alias("_first"), F.count(F.lit(1)).alias("_copies")
    ).filter("_copies > 1").drop("_copies")
    joined = keyed.join(spread(first), ["file", "_key"], "left")
    twice = F.col("_first") < F.col("line")
    messages.append(F.when(twice, _row(F.concat(
        F.lit("duplicate "), F.col("handler"), F.lit("+"), F.col("dog"), F.lit(" in round '"), F.col("round_key"), F.lit("'.")))))
    errors = joined.select("file", "line", F.explode(F.array_compact(F.array(*messages))).alias("message"))
    return df, errors


def repair_rank(df: DataFrame) -> DataFrame:
    """A row without a valid rank that is not eliminated becomes eliminated, with a warning (F2)."""
    out = F.lower(strip(F.col("eliminated"))) == "true"
    rank = strip(F.col("rank")).try_cast("int")
    broken = ~F.coalesce(out, F.lit(False)) & ~F.coalesce(rank > 0, F.lit(False))
    warning = _row(F.lit("empty/invalid rank with eliminated=false - treating as eliminated."))
    return df.withColumn("warning", F.when(broken, warning)).withColumn(
        "eliminated", F.when(broken, F.lit("true")).otherwise(F.col("eliminated"))
    )


def accept_or_reject(df: DataFrame, errors: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of files without any error and with a new competition slug."""
    rejected = errors.select("file").distinct()
    return df.join(spread(rejected), "file", "left_anti").join(spread(known.select("slug")), "slug", "left_anti")


def validate_canonical(df: DataFrame) -> DataFrame:
    """One row per issue of canonical rows."""
    def bad(name: str, condition: Column) -> Column:
        text = F.concat(F.lit(f"invalid {name} '"), F.col(name), F.lit("'"))
        return F.when(~_empty(name) & condition, text)

    flag = ["True", "False"]
    out = F.col("eliminated") == "True"
    issues = [
        bad("size", ~F.col("size").isin(SIZES)),
        bad("discipline", ~F.col("discipline").isin(DISCIPLINES)),
        bad("country", ~F.regexp_like("country", F.lit("^[A-Z]{3}$"))),
        F.when(~F.coalesce(F.col("eliminated").isin(flag), F.lit(False)), F.lit("invalid eliminated")),
        F.when(~F.coalesce(F.col("is_team_round").isin(flag), F.lit(False)), F.lit("invalid is_team_round")),
        *[F.when(out & ~_empty(m), F.concat(F.lit(f"eliminated row has non-empty {m}="), F.col(m))) for m in MEASURES],
    ]
    return df.select("file", "line", F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def has_marker(columns: list[str] = MEASURES) -> Column:
    """A measure holds an elimination marker."""
    values = F.array(*[F.upper(strip(F.coalesce(F.col(c), F.lit("")))) for c in columns])
    return F.arrays_overlap(values, F.array(*[F.lit(m) for m in MARKERS]))


def detect_eliminated(df: DataFrame, *, penalty: str | None = None, note: str | None = None) -> DataFrame:
    """Elimination from markers, missing rank and time, rank tokens, penalties and notes."""
    rank = F.upper(strip(F.coalesce(F.col("rank"), F.lit(""))))
    number = rank.try_cast("int")
    out = (F.col("eliminated") == "True") | has_marker() | (_empty("rank") & _empty("time"))
    out = out | rank.isin(RANK_TOKENS) | F.coalesce(number >= 900, F.lit(False))
    if penalty:
        out = out | F.coalesce(F.col(penalty).try_cast("double") >= 100, F.lit(False))
    if note:
        text = F.upper(strip(F.coalesce(F.col(note), F.lit(""))))
        placed = F.coalesce(number > 0, F.lit(False))
        out = out | text.isin(NOTE_CODES) | (~placed & (text != ""))
    return df.withColumn("eliminated", F.when(F.coalesce(out, F.lit(False)), "True").otherwise("False"))


def clear_eliminated(df: DataFrame, columns: list[str] = MEASURES) -> DataFrame:
    """Null measures of eliminated rows."""
    keep = F.col("eliminated") != "True"
    return df.select(*[F.when(keep, F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


# Round types that are no contests, and markers of rows that are no results.
TEST_ROUNDS = ["test 1", "test 2", "test 3", "test", "warm up", "warmup"]


def exclusion_rules() -> dict[str, Column]:
    """Named row exclusions (F7); each is a predicate over the columns it needs."""
    no = F.lit(False)
    handler = F.col("handler")
    return {
        "test_round": F.lower(strip(F.col("discipline"))).isin(TEST_ROUNDS),
        "junk_row": handler.startswith("[") | F.contains(handler, F.lit("Coursewalking")) | F.contains(handler, F.lit("Prohlídka")),
        "hidden_person": F.coalesce(F.col("hidden") == 1, no),
        "unranked_round": ~F.coalesce(F.lower(strip(F.col("status"))).isin("ranked", "50"), no),
        "team_aggregate": (F.lower(F.col("is_team_round")) == "true") & ~F.col("discipline").isin(DISCIPLINES),
        "absent": F.coalesce(F.upper(strip(F.col("rank"))) == "ABS", no),
    }


def exclude_rows(df: DataFrame, rules: list[str]) -> DataFrame:
    """Rows that no rule excludes; a null predicate does not exclude."""
    known = exclusion_rules()
    for name in rules:
        df = df.filter(~F.coalesce(known[name], F.lit(False)))
    return df
