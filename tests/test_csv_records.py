"""Records over several lines against Python's csv, for blocks of any size."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ladderspark.sources import csv_files as C

CASES = [
    'a,b\n1,"two\nlines"\n3,4\n', 'a,b\n"x ""y""\n\nz",2\n5,6\n', 'a,b\n1,5" tall\n2,"q"x"y\n3,4\n', 'a,b\n"""\n""",1\n"",2\n', 'a,b\n1,"never\nclosed\n,2', '"a\nb",c\n1,2\n', 'a\n"\n\n"\n"""",\n',
    'a,b\n1,""\n2,"""\n"\n3,"a"",\n"\n4,5\n',
]


def parsed(text):
    """(number of the first line, fields) of every record."""
    lines, out = io.StringIO(text, newline=""), []
    reader = csv.reader(lines, lineterminator="\n")
    at = 1
    for row in reader:
        out.append((at, row))
        at = reader.line_num + 1
    return out


@pytest.mark.parametrize("block,more", [("128m", 25), ("16", 3)])
def test_records_are_those_of_the_csv_module(spark, tmp_path, block, more):
    rng = random.Random(11)
    cases = CASES + ["h,k\n" + "".join(rng.choice(['"', '"', '""', ",", "\n", "a", "b,", '"\n']) for _ in range(60)) + "\n" for _ in range(more)]
    for i, text in enumerate(cases):
        (tmp_path / f"{i:03}.csv").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = C.records(C.numbered_lines(spark, str(tmp_path))).withColumn("file", F.element_at(F.split("file", "/"), -1)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for i, text in enumerate(cases):
        mine = sorted((r.line, r.value) for r in got if r.file == f"{i:03}.csv")
        want = parsed(text)
        assert [line for line, _ in mine] == [line for line, _ in want], text
        # A record by itself reads the same; one whose quotes are never closed differs by its end only.
        assert [next(csv.reader(io.StringIO(v, newline="")), []) if '"' in v or v else [] for _, v in mine][:-1] == [r for _, r in want][:-1], text


def test_fields_over_lines(spark, tmp_path):
    (tmp_path / "cup").mkdir()
    (tmp_path / "cup" / "a.csv").write_text('round_key,handler,dog,rank\nr1,"Smith,\nJo","Shadow\nof ""Aire""",1\nr2,Eva,Rex,2\n\nr3,"Jan\n",Day,3\n')
    got = [(r.line, r.round_key, r.handler, r.dog, r["rank"]) for r in C.read_results_csv(spark, str(tmp_path / "cup")).orderBy("_seq").collect()]
    assert got == [(2, "r1", "Smith,\nJo", 'Shadow\nof "Aire"', "1"), (5, "r2", "Eva", "Rex", "2"), (7, "r3", "Jan", "Day", "3")]
