"""A second import of the same files adds nothing and looks up nobody."""

from ladderspark.catalog import imports
from ladderspark.operators import first_come as FC
from ladderspark.plans.importing import TABLES, import_files
from ladderspark.storage import commit_tables, new_path, read_tables

SF = "/root/testdata/sf0.001"


def test_files_that_are_all_rejected_look_up_nobody(spark, monkeypatch):
    root = new_path(spark, "tables")
    commit_tables(spark, root, imports.before(spark, SF))
    first = import_files(spark, root, *imports.given(spark, SF), imports.CFG)
    rows = lambda d: sorted(map(str, d.collect()))
    was, types = {n: rows(first.tables[n]) for n in TABLES}, {n: first.tables[n].dtypes for n in TABLES}
    columns = first.log.dtypes
    monkeypatch.setattr(FC, "resolve_handlers", None)
    monkeypatch.setattr(FC, "resolve_entities", None)
    again = import_files(spark, root, *imports.given(spark, SF), imports.CFG)
    now = read_tables(spark, root)
    assert {n: rows(now[n]) for n in TABLES} == was and {n: now[n].dtypes for n in TABLES} == types
    assert again.log.dtypes == columns and {r.status for r in again.log.collect()} == {"Rejected"}
    assert {r.kind for r in again.messages.select("kind").distinct().collect()} == {"error"}
    assert sum(r.new_teams + r.handlers + r.warnings_count for r in again.log.collect()) == 0
