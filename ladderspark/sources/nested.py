"""Result JSON with nested lists and maps (S3-S5), wide tables and list texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderspark.functions.names import lookup, strip
from ladderspark.functions.values import parse_float, parse_int
from ladderspark.operators.validate import NOTE_CODES

# Field names and types of the class-result JSON, and of the two-level run JSON.
CLASS_SCHEMA = """STRUCT<tuomari: STRING, ihanneaika: STRING, enimmaisaika: STRING, pituus: STRING, tulokset: ARRAY<STRUCT<
  numero: STRING, ohjaaja: STRING, virallinenNimi: STRING, kutsumanimi: STRING, rotunimi: STRING, ratavirhe: STRING, kieltovirheita: STRING,
  aikavirhe: STRING, tulos: STRING, suoritusaika: STRING, nopeus: STRING, sijoitus: STRING, muuta: STRING>>>"""
RUNS_SCHEMA = """STRUCT<runs: ARRAY<STRUCT<id: BIGINT, name: STRING, run_type: STRING, judge: STRING, starting_lists: ARRAY<STRUCT<
  id: BIGINT, name: STRING, standard_time: DOUBLE, max_time: DOUBLE, course_length: DOUBLE, records: ARRAY<STRUCT<
  dis: BOOLEAN, not_running: BOOLEAN, ended: BOOLEAN, rank: INT, time: DOUBLE, starting_number: STRING, handler: STRING, dog: STRING,
  country: STRING, faults: DOUBLE, refusal: DOUBLE, penalty_points: DOUBLE>>>>>>>"""
KEYED_SCHEMA = """MAP<STRING, MAP<STRING, STRUCT<placement: STRING, dnf: BOOLEAN, dns: BOOLEAN, tri: STRING, handlerName: STRING, dogName: STRING,
  faults: STRING, halts: STRING, timeFault: STRING, sum: STRING, time: STRING>>>"""
KEYED_SIZES = {"XS": "Small", "S": "Small", "M": "Medium", "L": "Intermediate", "XL": "Large"}
ROUND_LETTERS = {"A": "1", "B": "2", "C": "3", "D": "4", "E": "5"}


def flatten_results_json(df: DataFrame, json: str = "json", schema: str = CLASS_SCHEMA) -> DataFrame:
    """One row per result of a class document (S3). A rank of zero is none; a note without a rank eliminates."""
    keep = [c for c in df.columns if c != json]
    d = df.select(*keep, F.from_json(json, schema).alias("_doc"))
    d = d.select(*keep, "_doc", F.posexplode("_doc.tulokset").alias("pos", "_r"))
    r = lambda f: F.col(f"_r.{f}")
    # Columns of their own, because each is used several times below and would be parsed as often.
    d = d.withColumns({"_place": parse_int(r("sijoitus")), "_note": F.upper(strip(F.coalesce(r("muuta"), F.lit(""))))})
    rank, note = F.when(F.col("_place") > 0, F.col("_place")), F.col("_note")
    out = note.isin(NOTE_CODES) | (rank.isNull() & (note != ""))
    return d.select(
        *keep, "pos", F.when(~out, rank).alias("rank"), strip(r("numero")).alias("start_no"), strip(r("ohjaaja")).alias("handler"),
        strip(F.coalesce(F.nullif(r("virallinenNimi"), F.lit("")), r("kutsumanimi"))).alias("dog"), strip(r("rotunimi")).alias("breed"),
        parse_float(r("ratavirhe")).alias("faults"), parse_float(r("kieltovirheita")).alias("refusals"),
        parse_float(r("aikavirhe")).alias("time_faults"), parse_float(r("tulos")).alias("total_faults"),
        parse_float(r("suoritusaika")).alias("time"), parse_float(r("nopeus")).alias("speed"), out.alias("eliminated"),
        strip(F.col("_doc.tuomari")).alias("judge"), parse_float(F.col("_doc.ihanneaika")).alias("sct"),
        parse_float(F.col("_doc.enimmaisaika")).alias("mct"), parse_float(F.col("_doc.pituus")).alias("course_length"),
    )


def flatten_runs_json(df: DataFrame, json: str = "json", schema: str = RUNS_SCHEMA) -> DataFrame:
    """One row per record of a document with runs and starting lists, both in id order.

    ``list_no`` numbers the starting lists of a document in that order, for W7.
    """
    keep = [c for c in df.columns if c != json]
    d = df.select(*keep, F.from_json(json, schema).alias("_doc"))
    by_id = lambda arr: F.array_sort(F.coalesce(arr, F.array()), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    lists = F.flatten(F.transform(by_id(F.col("_doc.runs")), lambda run: F.transform(
        by_id(run["starting_lists"]), lambda s: F.struct(run["name"].alias("run_name"), run["run_type"].alias("run_type"), run["judge"].alias("judge"), s.alias("s")))))
    d = d.select(*keep, F.posexplode(lists).alias("list_no", "_l"))
    d = d.select(*keep, "list_no", "_l", F.posexplode("_l.s.records").alias("pos", "_r"))
    r = lambda f: F.col(f"_r.{f}")
    no = F.lit(False)
    dis, absent, ended = F.coalesce(r("dis"), no), F.coalesce(r("not_running"), no), F.coalesce(r("ended"), no)
    rank = F.when(~dis & ~absent & ended & (r("rank") > 0), r("rank"))
    length = F.col("_l.s.course_length")
    return d.select(
        *keep, "list_no", "pos", strip(F.col("_l.run_name")).alias("run_name"), strip(F.col("_l.judge")).alias("judge"),
        F.col("_l.s.name").alias("size"), rank.alias("rank"), rank.isNull().alias("eliminated"), r("starting_number").alias("start_no"),
        strip(r("handler")).alias("handler"), strip(r("dog")).alias("dog"), r("country").alias("country"), r("faults").alias("faults"),
        r("refusal").alias("refusals"), r("penalty_points").alias("total_faults"), r("time").alias("time"),
        F.round(F.nullif(length, F.lit(0.0)) / F.nullif(r("time"), F.lit(0.0)), 2).alias("speed"),
        F.col("_l.s.standard_time").alias("sct"), F.col("_l.s.max_time").alias("mct"), length.alias("course_length"),
    )


def parse_class_key(key: Column) -> Column:
    """Struct of discipline, size and round_key of a key such as A-KL1-B-S-x-y; null if it is none."""
    p = F.split(key, "-")
    at = lambda i: F.get(p, F.lit(i))
    discipline = F.when(at(0) == "FA", "Final").when(at(0) == "H", "Jumping").otherwise("Agility")
    size = lookup(KEYED_SIZES, at(3))
    grade = F.when(at(1) != "X", F.lower(at(1)))
    number = lookup(ROUND_LETTERS, at(2), at(2))
    base = F.concat_ws("_", F.lit("ind"), F.lower(discipline), F.lower(size))
    full = F.when(discipline == "Final", base).otherwise(F.concat_ws("_", base, grade, number))
    return F.when((F.size(p) >= 6) & size.isNotNull(), F.struct(discipline.alias("discipline"), size.alias("size"), full.alias("round_key")))


def flatten_keyed_json(df: DataFrame, json: str = "json", schema: str = KEYED_SCHEMA) -> DataFrame:
    """One row per run of a document keyed by class (S5). A placement of 900 or more eliminates."""
    keep = [c for c in df.columns if c != json]
    d = df.select(*keep, F.explode(F.from_json(json, schema)).alias("class_key", "_runs"))
    d = d.withColumn("_k", parse_class_key(F.col("class_key"))).filter("_k is not null")
    d = d.select(*keep, "class_key", "_k", F.explode("_runs").alias("entry_key", "_r"))
    r = lambda f: F.col(f"_r.{f}")
    # A column of its own, because it is used several times below and would be parsed as often.
    d = d.withColumn("_place", parse_int(r("placement")))
    place, no = F.col("_place"), F.lit(False)
    out = F.coalesce(r("dnf"), no) | F.coalesce(r("dns"), no) | F.coalesce(place >= 900, no)
    return d.select(
        *keep, "class_key", "entry_key", "_k.discipline", "_k.size", "_k.round_key", F.when(~out, place).alias("rank"), out.alias("eliminated"),
        parse_int(r("tri")).alias("start_no"), strip(r("handlerName")).alias("handler"), strip(r("dogName")).alias("dog"),
        parse_float(r("faults")).alias("faults"), parse_float(r("halts")).alias("refusals"), parse_float(r("timeFault")).alias("time_faults"),
        parse_float(r("sum")).alias("total_faults"), parse_float(r("time")).alias("time"),
    )


def unpivot_runs(df: DataFrame, ids: list[str], runs: dict[str, tuple[str, str]]) -> DataFrame:
    """A combined table into one row per run (O7); ``runs`` maps a label to its (time, penalty) columns."""
    parts = [F.struct(F.lit(k).alias("run"), F.col(t).alias("time"), F.col(p).alias("penalty")) for k, (t, p) in runs.items()]
    d = df.select(*ids, F.explode(F.array(*parts)).alias("_x")).select(*ids, "_x.*")
    out = F.coalesce(F.col("penalty") >= 100, F.lit(False)) | F.col("time").isNull()
    return d.withColumn("eliminated", out)


ENTRY = r"([^,]+?\s*\([A-Z]{2}\d+\)(?:\s*\([^)]*\))?)"
ENTRY_PARTS = r"^(.+?)\s+&\s+(.+?)\s+\(([A-Z]{2})(\d+)\)(?:\s+\(([^)]*)\))?$"


def explode_entries(df: DataFrame, col: str) -> DataFrame:
    """List text "A & B (CC123) (R, 5), C & D (CC4)" into one row per entry."""
    keep = [c for c in df.columns if c != col]
    d = df.select(*keep, F.posexplode(F.regexp_extract_all(col, F.lit(ENTRY), F.lit(1))).alias("pos", "_e"))
    text = F.trim(F.regexp_replace(F.trim(F.col("_e")), ",+$", ""))
    part = lambda i: F.regexp_extract(text, ENTRY_PARTS, i)
    return d.filter(F.regexp_like(text, F.lit(ENTRY_PARTS))).select(
        *keep, "pos", F.trim(part(1)).alias("handler"), F.trim(part(2)).alias("dog"), part(3).alias("country2"),
        part(4).cast("bigint").alias("start_no"), part(5).alias("fault_info"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """One canonical frame from several sources; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
