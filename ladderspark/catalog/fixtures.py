"""Inputs in the shape of raw contest data, derived from the tables by SQL that both engines read."""

from __future__ import annotations

import re

from ladderspark.operators.scan import parts_for, spread
from ladderspark.plans.contests import table
from ladderspark.storage import input_bytes

FIXED = {"nation", "region"}
NAMED = {"customer": "c_custkey", "part": "p_partkey", "documents": "doc_id"}
SPLIT = 128 << 20  # bytes that may be one part of a scan


def frame(spark, sf, sql: str):
    """Run shared SQL on Spark; ``{name}`` stands for a table. All but the lists of nations and regions grow with the data."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf, n) if n in FIXED else spread(dealt(spark, sf, n)) for n in names})


def dealt(spark, sf, name: str):
    """A table, its rows dealt over all tasks if its files are small: names are slow to work on, and a million of them fit into a file that one task reads."""
    d = table(spark, sf, name)
    size = input_bytes(spark, f"{sf}/{name}.parquet") if name in NAMED else None
    # A number of parts that is given stays; others are put together again by their bytes.
    return d.repartition(parts_for(spark, size), NAMED[name]) if size is not None and size <= SPLIT else d


def text(sql: str) -> str:
    """The same SQL for DuckDB, as a parenthesized table."""
    return "(" + re.sub(r"\{(\w+)\}", r"\1", sql) + ")"


PEOPLE = """SELECT c_custkey AS k, c_nationkey AS nk,
  CASE c_custkey % 8 WHEN 0 THEN 'Kateřina' WHEN 1 THEN 'Łukasz' WHEN 2 THEN 'Søren' WHEN 3 THEN 'Anna-Lena' WHEN 4 THEN 'José'
    WHEN 5 THEN 'Zoë' WHEN 6 THEN 'John' ELSE 'Đorđe' END AS first,
  CASE CAST(floor(c_custkey / 8) AS BIGINT) % 7 WHEN 0 THEN 'Třičová' WHEN 1 THEN 'Wójcik' WHEN 2 THEN 'Ødegård' WHEN 3 THEN 'Groß'
    WHEN 4 THEN 'Nova`s' WHEN 5 THEN 'Smith' ELSE 'De Groote' END AS last,
  translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij') AS tag
  FROM {customer}"""

RAW_NAMES = f"""SELECT k, CASE k % 9
    WHEN 0 THEN first || ' ' || last || ' ' || tag
    WHEN 1 THEN last || ' ' || tag || ', ' || first
    WHEN 2 THEN lower(first) || ' ' || lower(last) || ' ' || tag
    WHEN 3 THEN '  ' || first || '   ' || last || chr(9) || tag || ' '
    WHEN 4 THEN last || ', ' || first || ', ' || tag
    WHEN 5 THEN first || '-' || last || '-' || tag
    WHEN 6 THEN first || ' ' || first || ' ' || first || ' ' || last || ' ' || tag || ' ' || tag
    WHEN 7 THEN tag
    ELSE '   ' END AS raw FROM ({PEOPLE})
  UNION ALL SELECT -1 - doc_id AS k, text AS raw FROM {{documents}}"""

ENTITIES = """SELECT p_partkey AS k, CASE p_partkey % 16
    WHEN 0 THEN p_name
    WHEN 1 THEN 'A3Ch ' || p_name || ' of ' || p_brand || ' (Day)'
    WHEN 2 THEN p_name || ' z ' || p_type || ' "Ninja"'
    WHEN 3 THEN 'Ag. Ch. ' || p_name || ' (cp)'
    WHEN 4 THEN p_name || ' (FCI registration)'
    WHEN 5 THEN 'Finrod Frances'
    WHEN 6 THEN 'A3Ch Libby Granting Pleasure'
    WHEN 7 THEN p_name || ' (x)'
    WHEN 8 THEN 'MACH2 ' || p_name || '   von   ' || p_type || ' (Cis)'
    WHEN 9 THEN 'GCh (None)'
    WHEN 10 THEN p_name || ' “' || p_type || '”'
    WHEN 11 THEN 'NNL Sayonara (Sayonara)'
    WHEN 12 THEN p_name || ' von der ' || lower(p_type) || ' (Black Swan)'
    WHEN 13 THEN p_name || ' Pšeník Třetí ' || p_type
    WHEN 14 THEN p_name || ' "cp"'
    ELSE p_name || ' (FCI 123)' END AS raw
  FROM {part}"""


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def squeeze_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g'))"


def accents_sql(x: str) -> str:
    return f"strip_accents(translate(replace({x}, 'ß', 'ss'), 'ŁłĐđØøĦħŦŧ', 'LlDdOoHhTt'))"


def swap_sql(x: str) -> str:
    return (f"CASE WHEN len(string_split({x}, ',')) = 2 THEN {squeeze_ends(f'split_part({x}, chr(44), 2)')} || ' ' || "
            f"{squeeze_ends(f'split_part({x}, chr(44), 1)')} ELSE {x} END")


def squeeze_ends(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def norm_sql(x: str) -> str:
    quotes = f"""translate({x}, '“”‘’-`', '""'''' ''')"""
    words = f"string_split({squeeze_sql(f'lower({accents_sql(swap_sql(quotes))})')}, ' ')"
    return (f"array_to_string([z[1] for z in list_zip({words}, list_prepend(NULL, {words}), true) "
            f"if z[1] IS DISTINCT FROM z[2]], ' ')")


def slug_sql(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(replace({norm_sql(x)}, ' ', '-'), '[^a-z0-9-]', '', 'g'), '-{{2,}}', '-', 'g'), '-')")
