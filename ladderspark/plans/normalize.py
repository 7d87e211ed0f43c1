"""Source-specific mapping to the canonical row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.functions import parsing as P
from ladderspark.functions import values as V
from ladderspark.functions.names import lookup, strip
from ladderspark.operators.rounds import split_round_keys
from ladderspark.operators.validate import clear_eliminated, exclude_rows, has_marker
from ladderspark.schema import CANONICAL


def _flag(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def _described(df: DataFrame, source: str) -> DataFrame:
    d = df.withColumn("_d", P.parse_description(F.col("run_description"), source)).filter("_d is not null")
    return d.select("*", "_d.discipline", "_d.size_raw", "_d.is_team").drop("_d")


def _team_key() -> Column:
    key = P.round_key(F.col("is_team"), F.col("discipline"), F.col("size"))
    return F.when(F.col("is_team"), F.concat(key, F.lit("_ind"))).otherwise(key)


def _finish(d: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    named = [F.col(c).cast("string").alias(c) if c in d.columns else none.alias(c) for c in CANONICAL]
    return split_round_keys(clear_eliminated(d.select("file", "_seq", *named)))


def normalize_source(df: DataFrame, fmt: str) -> DataFrame:
    """Canonical rows of a source in one of the known formats; needs ``file`` and ``_seq``."""
    if fmt == "kacr":
        d = _described(df, "numbered").withColumn("size", P.size_from_code(F.col("size_raw")))
        d = d.withColumn("eliminated", _flag(F.coalesce(strip(F.col("status")) == "DIS", F.lit(False))))
        d = d.select(
            "file", "_seq", "competition", "size", "discipline", _flag(F.col("is_team")).alias("is_team_round"), "rank",
            F.col("prukaz").alias("start_no"), "handler", "dog", F.col("chb").alias("faults"), F.col("odm").alias("refusals"),
            F.col("tb_time").alias("time_faults"), F.col("tb_total").alias("total_faults"), "time", "speed", "eliminated", "judge",
            F.col("standard_time").alias("sct"), F.col("max_time").alias("mct"), "course_length", _team_key().alias("round_key"))
        return _finish(d)
    if fmt == "agigames":
        d = _described(exclude_rows(df, ["junk_row"]), "sponsored")
        known = lookup(V.SIZES, F.col("size_raw"))
        letter = F.nullif(F.regexp_extract(strip(F.col("size_class")), "^(XS|S|M|I|L)", 1), F.lit(""))
        size = F.coalesce(F.when(known != F.col("size_raw"), known), lookup(V.SIZES, letter), P.size_from_code(F.col("size_raw")))
        out = F.coalesce(strip(F.col("status")).isin("DIS", "-"), F.lit(False))
        late = V.derive_time_faults(V.parse_float(F.col("tb_total")), V.parse_float(F.col("chb")), V.parse_float(F.col("odm")))
        d = d.withColumn("size", size).withColumn("eliminated", _flag(out))
        d = d.select(
            "file", "_seq", "competition", "size", "discipline", _flag(F.col("is_team")).alias("is_team_round"), "rank",
            F.col("start_num").alias("start_no"), "handler", "dog", V.country_iso3(F.col("country")).alias("country"), F.col("chb").alias("faults"),
            F.col("odm").alias("refusals"), F.regexp_replace(late.cast("string"), r"\.0$", "").alias("time_faults"), F.col("tb_total").alias("total_faults"),
            "time", "speed", "eliminated", "judge", F.col("standard_time").alias("sct"), F.col("max_time").alias("mct"), "course_length",
            _team_key().alias("round_key"))
        return _finish(d)
    if fmt != "target":
        raise ValueError(f"unknown format {fmt}")
    empty = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) == ""
    out = V.canon_eliminated(F.col("eliminated")) | (empty("rank") & empty("time")) | has_marker()
    team = V.canon_bool(F.col("is_team_round"))
    d = df.withColumn("_key", P.normalize_round_key(F.col("round_key"), F.col("size"), F.col("discipline"), team))
    d = d.withColumn("eliminated", _flag(out)).withColumn("is_team_round", _flag(team)).withColumn("round_key", F.col("_key"))
    d = d.withColumn("size", V.canon_size(F.col("size"))).withColumn("discipline", V.canon_discipline(F.col("discipline")))
    return _finish(d.withColumn("country", V.country_iso3(F.col("country"))))
