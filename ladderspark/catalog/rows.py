"""Validation, repair, exclusion and order-dependent row operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderspark.catalog.base import query
from ladderspark.catalog.fixtures import frame, text
from ladderspark.operators import rounds as Q
from ladderspark.operators import validate as V

c = F.col

# One row per (order, line number): a unique, dense key for the order-dependent operators.
LINES = """SELECT l_orderkey, l_linenumber, MIN(l_partkey) AS l_partkey, MIN(l_suppkey) AS l_suppkey, MIN(l_quantity) AS l_quantity,
  MIN(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

IMPORT = f"""SELECT l_orderkey AS ok, l_linenumber, 'f' || CAST(l_suppkey AS STRING) AS file, 's' || CAST(l_suppkey AS STRING) AS slug, l_orderkey * 8 + l_linenumber AS line,
  CASE WHEN l_partkey % 41 = 0 THEN ' ' ELSE 'r' || CAST(l_partkey % 9 AS STRING) END AS round_key, CASE WHEN l_orderkey % 997 = 3 THEN NULL ELSE 'H' || CAST(l_orderkey % 50 AS STRING) END AS handler,
  CASE WHEN l_linenumber = 1 THEN 'rex' ELSE 'Rex' END AS dog, CASE l_partkey % 30 WHEN 0 THEN 'Snooker' WHEN 1 THEN '' WHEN 2 THEN 'jumping' ELSE 'Agility' END AS discipline,
  CASE WHEN l_partkey % 100 = 7 THEN '' ELSE 'S' END AS size, CASE l_quantity WHEN 1 THEN '' WHEN 2 THEN 'x' WHEN 3 THEN '0' WHEN 4 THEN '-2' ELSE CAST(l_linenumber AS STRING) END AS rank,
  CASE WHEN l_returnflag = 'R' THEN 'True' WHEN l_returnflag = 'A' THEN ' true ' ELSE 'false' END AS eliminated FROM ({LINES})"""
_e = lambda x: f"coalesce(trim({x}), '') = ''"
ERRORS = f"""i AS (SELECT *, CASE WHEN {_e('round_key')} OR {_e('handler')} OR {_e('dog')} THEN NULL ELSE row_number() OVER (PARTITION BY file, lower(round_key), lower(handler), lower(dog) ORDER BY line) END AS nth FROM {text(IMPORT)}),
  errors AS (SELECT file, line, 'Row ' || line || ': ' || m AS message FROM i, unnest([CASE WHEN {_e('round_key')} THEN 'round_key is required.' END, CASE WHEN {_e('handler')} THEN 'handler is required.' END,
    CASE WHEN {_e('dog')} THEN 'dog is required.' END, CASE WHEN {_e('discipline')} THEN 'discipline is required.' END, CASE WHEN {_e('size')} THEN 'size is required.' END,
    CASE WHEN NOT {_e('discipline')} AND lower(discipline) NOT IN ('agility', 'jumping', 'final') THEN 'discipline ''' || discipline || ''' is invalid.' END,
    CASE WHEN nth > 1 THEN 'duplicate ' || handler || '+' || dog || ' in round ''' || round_key || '''.' END]) AS u(m) WHERE m IS NOT NULL)"""


@query(f"WITH {ERRORS} SELECT * FROM errors")
def validate_results(spark, sf):
    return V.validate_results(frame(spark, sf, IMPORT))[1]


@query(f"""SELECT line, CASE WHEN bad THEN 'true' ELSE eliminated END AS eliminated, CASE WHEN bad THEN 'Row ' || line || ': empty/invalid rank with eliminated=false - treating as eliminated.' END AS warning
  FROM (SELECT *, lower(trim(eliminated)) <> 'true' AND coalesce(try_cast(trim(rank) AS INTEGER), 0) <= 0 AS bad FROM {text(IMPORT)})""")
def repair_rank(spark, sf):
    return V.repair_rank(frame(spark, sf, IMPORT)).select("line", "eliminated", "warning")


# Small files, so that some have no fault of any kind.
BY_ORDER = IMPORT.replace("'f' || CAST(l_suppkey AS STRING) AS file", "'f' || CAST(l_orderkey AS STRING) AS file")


@query(f"""WITH {ERRORS.replace(text(IMPORT), text(BY_ORDER))} SELECT file, line FROM i WHERE file NOT IN (SELECT file FROM errors) AND slug NOT IN (SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal < 1000)""")
def accept_or_reject(spark, sf):
    d = frame(spark, sf, BY_ORDER)
    errors = V.validate_results(d)[1]
    known = frame(spark, sf, "SELECT 's' || CAST(s_suppkey AS STRING) AS slug FROM {supplier} WHERE s_acctbal < 1000")
    return V.accept_or_reject(d, errors, known).select("file", "line")


CANON = f"""SELECT l_orderkey * 8 + l_linenumber AS line, l_orderkey * 8 + l_linenumber AS _seq, 'f' || CAST(l_suppkey AS STRING) AS file, 'ind_agility_' || CAST(l_partkey % 4 AS STRING) || CASE WHEN l_partkey % 3 = 0 THEN '_7' ELSE '' END AS round_key,
  'H' || CAST(l_orderkey % 60 AS STRING) AS handler, 'Rex' AS dog, CASE l_partkey % 9 WHEN 0 THEN 'Huge' WHEN 1 THEN '' ELSE 'Small' END AS size, CASE l_partkey % 8 WHEN 0 THEN 'Snooker' ELSE 'Agility' END AS discipline,
  CASE l_partkey % 7 WHEN 0 THEN 'cze' WHEN 1 THEN NULL ELSE 'CZE' END AS country, CASE l_orderkey % 11 WHEN 0 THEN 'yes' WHEN 1 THEN 'True' WHEN 2 THEN 'True' ELSE 'False' END AS eliminated, CASE l_orderkey % 13 WHEN 0 THEN NULL ELSE 'True' END AS is_team_round,
  CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN 'DSQ' WHEN 3 THEN '999' ELSE CAST(l_linenumber AS STRING) END AS rank, CASE WHEN l_orderkey % 5 = 0 THEN 'dis' ELSE '0' END AS faults, '' AS refusals, NULL AS time_faults,
  CASE WHEN l_quantity > 45 THEN '' ELSE CAST(l_partkey % 20 AS STRING) END AS total_faults, CASE WHEN l_partkey % 6 = 0 THEN '' ELSE CAST(30 + l_partkey % 50 AS STRING) END AS time, '' AS speed,
  CASE WHEN l_quantity > 48 THEN '100' ELSE '5' END AS penalty, CASE l_quantity WHEN 1 THEN ' hyl' WHEN 2 THEN 'x' ELSE '' END AS note, 'J' || CAST(l_partkey % 3 AS STRING) AS judge, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE '45' END AS sct, '60' AS mct,
  CASE WHEN l_orderkey % 17 = 0 THEN 1 ELSE 0 END AS hidden, CASE WHEN l_orderkey % 19 = 0 THEN 'draft' ELSE '50' END AS status FROM ({LINES})"""
MEAS = ["rank", "faults", "refusals", "time_faults", "total_faults", "time", "speed"]


@query(f"""SELECT file, line, issue FROM {text(CANON)}, unnest([CASE WHEN size <> '' AND size NOT IN ('Small', 'Medium', 'Intermediate', 'Large') THEN 'invalid size ''' || size || '''' END,
  CASE WHEN discipline NOT IN ('Agility', 'Jumping', 'Final') THEN 'invalid discipline ''' || discipline || '''' END, CASE WHEN NOT regexp_matches(country, '^[A-Z]{{3}}$') THEN 'invalid country ''' || country || '''' END,
  CASE WHEN eliminated NOT IN ('True', 'False') THEN 'invalid eliminated' END, CASE WHEN coalesce(is_team_round, '') NOT IN ('True', 'False') THEN 'invalid is_team_round' END,
  {', '.join(f"CASE WHEN eliminated = 'True' AND coalesce({m}, '') <> '' THEN 'eliminated row has non-empty {m}=' || {m} END" for m in MEAS)}]) AS u(issue) WHERE issue IS NOT NULL""")
def validate_canonical(spark, sf):
    return V.validate_canonical(frame(spark, sf, CANON))


OUT = """coalesce(eliminated = 'True' OR upper(coalesce(faults, '')) IN ('DIS', 'DISQ', 'DQ', 'DNF', 'DNS', 'NP') OR (rank = '' AND time = '') OR rank IN ('DIS', 'DSQ', 'NFC', 'RET', 'WD') OR try_cast(rank AS INTEGER) >= 900
  OR CAST(penalty AS DOUBLE) >= 100 OR upper(trim(note)) IN ('HYL') OR (NOT coalesce(try_cast(rank AS INTEGER) > 0, false) AND trim(note) <> ''), false)"""


@query(f"SELECT line, CASE WHEN {OUT} THEN 'True' ELSE 'False' END AS eliminated FROM {text(CANON)}")
def detect_eliminated(spark, sf):
    return V.detect_eliminated(frame(spark, sf, CANON), penalty="penalty", note="note").select("line", "eliminated")


@query(f"SELECT line, CASE WHEN eliminated <> 'True' THEN rank END AS rank, CASE WHEN eliminated <> 'True' THEN time END AS time, dog FROM {text(CANON)}")
def clear_eliminated(spark, sf):
    return V.clear_eliminated(frame(spark, sf, CANON)).select("line", "rank", "time", "dog")


@query(f"SELECT line FROM {text(CANON)} WHERE hidden <> 1 AND status IN ('ranked', '50') AND NOT (coalesce(lower(is_team_round), '') = 'true' AND discipline NOT IN ('Agility', 'Jumping', 'Final'))")
def exclude_rows(spark, sf):
    rules = ["hidden_person", "unranked_round", "team_aggregate", "junk_row", "test_round", "absent"]
    return V.exclude_rows(frame(spark, sf, CANON), rules).select("line")


@query(f"""SELECT line FROM (SELECT line, row_number() OVER (PARTITION BY file, round_key, handler, dog ORDER BY res DESC, CASE WHEN res THEN coalesce(try_cast(rank AS INTEGER), 999999) ELSE 0 END, _seq) AS rn
  FROM (SELECT *, total_faults <> '' AND time <> '' AS res FROM {text(CANON)})) WHERE rn = 1""")
def dedup_best(spark, sf):
    keys = ["file", "round_key", "handler", "dog"]
    # The operator keeps whole rows in one struct, from which Spark takes nothing out.
    d = frame(spark, sf, CANON).select(*keys, "total_faults", "time", "rank", "_seq", "line")
    return Q.dedup_best(d, keys).select("line")


RUNS = f"SELECT l_suppkey AS run_id, l_orderkey * 8 + l_linenumber AS _seq, l_returnflag = 'R' AS eliminated, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_partkey % 100 END AS pen, l_quantity AS sec, CAST(NULL AS BIGINT) AS x FROM ({LINES})"


@query(f"SELECT _seq, CASE WHEN NOT eliminated THEN row_number() OVER (PARTITION BY run_id, eliminated ORDER BY coalesce(pen, 999), sec, _seq) END AS rank FROM {text(RUNS)}")
def derive_rank(spark, sf):
    return Q.derive_rank(frame(spark, sf, RUNS), ["run_id"], "pen", "sec").select("_seq", "rank")


GAPS = f"SELECT l_suppkey AS run_id, l_orderkey * 8 + l_linenumber AS _seq, l_returnflag = 'R' AS eliminated, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 50 + 1 ELSE NULL END AS rank FROM ({LINES})"


@query(f"""SELECT _seq, CASE WHEN eliminated THEN NULL ELSE coalesce(rank, coalesce(last_value(rank IGNORE NULLS) OVER w, 0) + gap) END AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id, eliminated, grp ORDER BY _seq) - CASE WHEN grp > 0 THEN 1 ELSE 0 END AS gap
  FROM (SELECT *, COUNT(rank) OVER (PARTITION BY run_id, eliminated ORDER BY _seq) AS grp FROM {text(GAPS)})) WINDOW w AS (PARTITION BY run_id, eliminated ORDER BY _seq)""")
def fill_running_rank(spark, sf):
    return Q.fill_running_rank(frame(spark, sf, GAPS), ["run_id"]).select("_seq", "rank")


SEQ = "SELECT o_orderkey AS run_order, o_orderpriority AS discipline, o_orderstatus AS size FROM {orders}"


@query(f"SELECT run_order, row_number() OVER (PARTITION BY discipline, size ORDER BY run_order) AS seq FROM {text(SEQ)}")
def assign_sequence(spark, sf):
    return Q.assign_sequence(frame(spark, sf, SEQ)).select("run_order", "seq")


@query(f"""WITH s AS (SELECT *, judge || '|' || coalesce(sct, '') || '|' || mct AS sig FROM {text(CANON)}), r AS (SELECT file, round_key, sig, row_number() OVER (PARTITION BY file, round_key ORDER BY MIN(_seq)) AS no,
    COUNT(*) OVER (PARTITION BY file, round_key) AS n FROM s GROUP BY file, round_key, sig)
  SELECT line, CASE WHEN n > 1 THEN regexp_replace(round_key, '^(.+)_(\\d+)$', '\\1') || '_' || no ELSE round_key END AS round_key FROM s JOIN r USING (file, round_key, sig)""")
def split_round_keys(spark, sf):
    return Q.split_round_keys(frame(spark, sf, CANON)).select("line", "round_key")


SLUGS = "SELECT o_orderkey AS k, lower(o_orderpriority) || '-x' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 50 = 0 THEN '-2' ELSE '' END AS base FROM {orders}"
OLD = "SELECT lower(o_orderpriority) || '-x' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN '-2' ELSE '-3' END AS slug FROM {orders} WHERE o_orderstatus = 'P'"


@query(f"""WITH n AS (SELECT k, base, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM {text(SLUGS)}), o AS (SELECT DISTINCT slug FROM {text(OLD)}),
  t AS (SELECT slug AS base, 1 AS v FROM o UNION ALL SELECT regexp_replace(slug, '-\\d+$', ''), CAST(regexp_extract(slug, '-(\\d+)$', 1) AS BIGINT) FROM (SELECT slug FROM o UNION SELECT base FROM n) WHERE regexp_matches(slug, '-([2-9]|\\d\\d+)$')),
  g AS (SELECT base, list(DISTINCT v) AS taken FROM t GROUP BY 1),
  f AS (SELECT k, base, [x for x in range(1, n + coalesce(len(taken), 0) + 1) if NOT coalesce(list_contains(taken, x), false)][n] AS no FROM n LEFT JOIN g USING (base))
  SELECT k, CASE WHEN no = 1 THEN base ELSE base || '-' || no END AS slug FROM f""")
def unique_slugs(spark, sf):
    return Q.unique_slugs(frame(spark, sf, SLUGS), "base", "k", frame(spark, sf, OLD)).select("k", "slug")
