"""Tables that are replaced together."""

import threading

import pytest
from pyspark.sql import functions as F

from ladderspark import storage as S


def numbers(spark, n, mark):
    return spark.range(n).select(F.col("id"), F.lit(mark).alias("mark"))


def test_tables_change_together(spark):
    root = S.new_path(spark, "tables")
    assert S.read_tables(spark, root) == {} and S.version(spark, root) == 0
    assert S.commit_tables(spark, root, {"a": numbers(spark, 3, 1), "b": numbers(spark, 4, 1)}) == 1
    old = S.read_tables(spark, root)
    # A table may be made of the one it replaces; what is not named stays.
    assert S.commit_tables(spark, root, {"a": old["a"].filter("id > 0").withColumn("mark", F.lit(2))}) == 2
    new = S.read_tables(spark, root)
    assert (new["a"].count(), new["b"].count()) == (2, 4) and {r.mark for r in new["a"].collect()} == {2}
    assert old["a"].count() == 3  # who has read the old commit keeps it
    S.commit_tables(spark, root, {"a": numbers(spark, 1, 3)})
    S.drop_old(spark, root, keep=1)
    assert {n: d.count() for n, d in S.read_tables(spark, root).items()} == {"a": 1, "b": 4}
    assert len(S.matching(spark, f"{root}/data/*")) == 2 and S.version(spark, root) == 3


def test_a_commit_without_its_last_line_does_not_count(spark):
    root = S.new_path(spark, "tables")
    S.commit_tables(spark, root, {"a": numbers(spark, 3, 1)})
    fs, path = S._fs(spark, f"{root}/_commits/000000000002.commit")
    fs.create(path, False).close()
    assert S.version(spark, root) == 1 and S.read_tables(spark, root)["a"].count() == 3
    assert S.commit_tables(spark, root, {"a": numbers(spark, 5, 1)}) == 3  # goes past the broken one
    assert S.read_tables(spark, root)["a"].count() == 5


def test_lost_races_change_nothing(spark):
    root = S.new_path(spark, "tables")
    S.commit_tables(spark, root, {"a": numbers(spark, 3, 1)})
    at = S.version(spark, root)
    S.commit_tables(spark, root, {"a": numbers(spark, 4, 2)})
    with pytest.raises(FileExistsError):
        S.commit_tables(spark, root, {"a": numbers(spark, 5, 3)}, based_on=at)
    assert S.read_tables(spark, root)["a"].count() == 4


def test_readers_never_see_a_mix(spark):
    root = S.new_path(spark, "tables")
    S.commit_tables(spark, root, {"a": numbers(spark, 10, 0), "b": numbers(spark, 10, 0)})
    seen, wrong, stop = set(), [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                t = S.read_tables(spark, root)
                marks = {tuple(sorted({r.mark for r in t[n].collect()})) for n in "ab"}
                seen.update(marks)
                if len(marks) != 1:
                    wrong.append(marks)
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 9):
        S.commit_tables(spark, root, {"a": numbers(spark, 10 + i, i), "b": numbers(spark, 20 + i, i)})
    stop.set()
    reader.join()
    assert not wrong and len(seen) > 1
    assert S.overwrite_table(numbers(spark, 2, 9), root).count() == 2
