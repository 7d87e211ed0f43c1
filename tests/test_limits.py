"""Inputs beyond former limits: long numbers and tokens, unknown headers, quoted fields, mutual and chained links."""

import os

import pytest
from pyspark.sql import functions as F

from ladderspark.functions import names as N
from ladderspark.functions import parsing as P
from ladderspark.operators import identity as I
from ladderspark.operators.rounds import unique_slugs
from ladderspark.operators.scan import row_numbers, running_sums
from ladderspark.plans.importing import import_log
from ladderspark.sources import csv_files as C


def test_long_digit_runs_keep_their_order(spark):
    labels = ["a_" + "1" * 25, "a_" + "1" * 20, "a_" + "1" * 24 + "2", "a_2", "a_10"]
    d = spark.createDataFrame([(x,) for x in labels], "label string")
    got = [r.label for r in d.orderBy(N.natural_key(F.col("label"))).collect()]
    assert got == ["a_2", "a_10", "a_" + "1" * 20, "a_" + "1" * 25, "a_" + "1" * 24 + "2"]


def test_long_fault_token(spark):
    token = "T" + "0" * 2000 + "7.5"
    d = spark.createDataFrame([("R, 5, " + token,)], "t string").select(P.parse_fault_tokens(F.col("t")).alias("f")).first().f
    assert (d.faults, d.refusals, d.time_faults) == (1, 1, 7.5)


@pytest.mark.parametrize("block", ["128m", "256"])
def test_csv_reader(spark, tmp_path, block):
    os.makedirs(tmp_path / "cup")
    (tmp_path / "cup" / "a.csv").write_text('﻿Round_Key,Handler,DOG,rank\nr1,"Smith, Jo","Shadow of Aire ""Ninja""", 1\n\nr1,handler,Rex,2\n' + "".join(f"r{i},h{i},d{i},{i}\n" for i in range(40)))
    (tmp_path / "cup" / "b.csv").write_text("Round,Name,dog_call_name\nx,y,Fido\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = C.read_results_csv(spark, str(tmp_path / "cup")).orderBy("_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert [(r.handler, r.dog, r["rank"], r.line) for r in rows[:2]] == [("Smith, Jo", 'Shadow of Aire "Ninja"', "1", 2), ("handler", "Rex", "2", 4)]
    assert [r.line for r in rows[2:42]] == list(range(5, 45)) and [r.handler for r in rows[2:42]] == [f"h{i}" for i in range(40)]
    assert (rows[42].dog, rows[42].handler, rows[42].line, rows[42].source) == ("Fido", None, 2, "cup")
    assert [r._seq for r in rows] == sorted({r._seq for r in rows})


def test_mutual_and_one_sided_variants(spark):
    rows = [("h", "abc", "zed of house one"), ("h", "zed", None), ("g", "abc", "zed of one two"), ("g", "zed", "abc of three four")]
    got = {tuple(r) for r in I.merge_variants(spark.createDataFrame(rows, "handler string, dog string, reg string")).collect()}
    assert got == {("h", "abc", "zed"), ("g", "zed", "abc")}


def test_chained_merges_and_cycles(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "id long, name string")
    teams = spark.createDataFrame([(10, 1), (20, 2), (30, 3), (40, 4)], "team_id long, entity_id long")
    alias = spark.createDataFrame([("x", 1, "Import")], "alias_name string, canonical_id long, source string")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "source_id long, target_id long")
    rest, moved, aliases = I.merge_entities(dim, teams, alias, pairs, "entity_id")
    assert sorted(r.id for r in rest.collect()) == [3, 4]
    assert dict(moved.collect()) == {10: 3, 20: 3, 30: 3, 40: 4}
    assert {tuple(r) for r in aliases.collect()} == {("x", 3, "Import"), ("a", 3, "Manual"), ("b", 3, "Manual")}
    with pytest.raises(ValueError):
        I.merge_entities(dim, teams, alias, spark.createDataFrame([(1, 2), (2, 1)], "source_id long, target_id long"), "entity_id")


def test_slugs_take_the_first_free_number(spark):
    new = spark.createDataFrame([(i, "s") for i in range(4)] + [(9, "t")], "k long, base string")
    old = spark.createDataFrame([("s",), ("s-3",), ("s-4",)], "slug string")
    got = {r.k: r.slug for r in unique_slugs(new, "base", "k", old).collect()}
    assert got == {0: "s-2", 1: "s-5", 2: "s-6", 3: "s-7", 9: "t"}


def test_log_counts_every_message(spark):
    rows = spark.createDataFrame([("f",)] * 3 + [("g",)], "file string")
    errors = spark.createDataFrame([("f", i, f"m{i}") for i in range(30)], "file string, line int, message string")
    counts = spark.createDataFrame([("g", 2)], "file string, teams int")
    got = {r.file: r for r in import_log(rows, errors, errors.limit(0), counts).collect()}
    assert (got["f"].errors_count, got["f"].status, got["g"].status, got["g"].teams) == (30, "Rejected", "Success", 2)


def test_ranks_over_many_ranges(spark):
    d = spark.range(20_000).select((F.col("id") % 3).alias("g"), F.pmod(F.hash("id"), 50).alias("v"), "id").withColumn("g", F.when(F.col("g") > 0, F.col("g")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = row_numbers(d, ["g"], [F.col("v").desc(), F.col("id")], "place")
        summed = running_sums(ranked, ["g"], [F.col("place")], {"total": F.col("v")})
        rows = summed.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == 20_000
    for g in (None, 1, 2):
        own = sorted((r for r in rows if r.g == g), key=lambda r: (-r.v, r.id))
        total = 0
        for i, r in enumerate(own):
            total += r.v
            assert (r.place, r.total) == (i + 1, total)
