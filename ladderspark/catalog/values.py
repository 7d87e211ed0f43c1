"""Value maps and small text grammars over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderspark.catalog.base import query
from ladderspark.catalog.fixtures import case_map, frame, q, text
from ladderspark.functions import parsing as T
from ladderspark.functions import values as V
from ladderspark.plans.contests import table

c = F.col

CATS = """SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'akc' WHEN 1 THEN 'USDAA' WHEN 2 THEN 'WAO' WHEN 3 THEN 'UKI' WHEN 4 THEN ' IFCS '
    WHEN 5 THEN 'XYZ' WHEN 6 THEN '' ELSE NULL END AS org,
  CASE p_size % 12 WHEN 0 THEN 'S' WHEN 1 THEN ' large ' WHEN 2 THEN 'i' WHEN 3 THEN '12"' WHEN 4 THEN '16' WHEN 5 THEN '"20"' WHEN 6 THEN '24" Preferred'
    WHEN 7 THEN '400' WHEN 8 THEN '600' WHEN 9 THEN 'XS' WHEN 10 THEN '22' ELSE 'M' END AS cat FROM {part}"""


def _cat_sql():
    per_org = []
    for org, cats in V.CATEGORIES.items():
        key = "regexp_replace(t, '^\"+|\"+$', '', 'g')" if org in ("AKC", "USDAA") else ("t" if org == "WAO" else "upper(t)")
        per_org.append(f"WHEN o = '{org}' THEN {case_map(key, cats)}")
    return f"CASE WHEN excluded THEN NULL {' '.join(per_org)} END"


@query(f"""SELECT k, {_cat_sql()} AS mapped, excluded FROM (SELECT *, o = 'AKC' AND contains(lower(t), 'preferred') AS excluded FROM
  (SELECT k, CASE WHEN trim(coalesce(org, '')) = '' THEN 'FCI' ELSE upper(trim(org)) END AS o, trim(cat) AS t FROM {text(CATS)}))""")
def map_category(spark, sf):
    return frame(spark, sf, CATS).select("k", V.map_category(c("org"), c("cat")).alias("s")).select("k", "s.*")


LABELS = """SELECT l_orderkey * 8 + l_linenumber AS k,
  CASE l_orderkey % 7 WHEN 0 THEN 'S' WHEN 1 THEN ' xs+s ' WHEN 2 THEN 'Inter' WHEN 3 THEN 'LARGE' WHEN 4 THEN 'XS & S' WHEN 5 THEN 'M' ELSE 'medium' END AS size,
  CASE l_partkey % 6 WHEN 0 THEN 'A3' WHEN 1 THEN 'JUMPING' WHEN 2 THEN 'Final Team Relay' WHEN 3 THEN 'Snooker' WHEN 4 THEN ' agility' ELSE 'Warm Up' END AS disc,
  CASE l_suppkey % 7 WHEN 0 THEN 'True' WHEN 1 THEN 'yes' WHEN 2 THEN 'DIS' WHEN 3 THEN 'no' WHEN 4 THEN NULL WHEN 5 THEN '-' ELSE ' 1 ' END AS flag FROM {lineitem}"""


@query(f"""SELECT size, disc, flag_bool, flag_out, COUNT(*) AS n FROM (SELECT {case_map('trim(size)', V.SIZES, 'trim(size)')} AS size,
    {case_map('trim(disc)', V.DISCIPLINES, 'trim(disc)')} AS disc, coalesce(trim(flag) IN ('True', 'true', '1', 'yes'), false) AS flag_bool,
    coalesce(trim(flag) IN ('True', 'true', '1', 'yes', 'DIS', 'DISQ', '-', 'DNS', 'DNF', 'NP'), false) AS flag_out FROM {text(LABELS)}) GROUP BY ALL""")
def canonical_values(spark, sf):
    d = frame(spark, sf, LABELS)
    return d.groupBy(V.canon_size(c("size")).alias("size"), V.canon_discipline(c("disc")).alias("disc"),
                     V.canon_bool(c("flag")).alias("flag_bool"), V.canon_eliminated(c("flag")).alias("flag_out")).agg(F.count(F.lit(1)).alias("n"))


COUNTRIES = """SELECT c_custkey AS k, CASE c_custkey % 14 WHEN 0 THEN 'CZE' WHEN 1 THEN 'cz' WHEN 2 THEN ' czech republic ' WHEN 3 THEN 'Francie' WHEN 4 THEN 'XX'
    WHEN 5 THEN 'Narnia' WHEN 6 THEN '' WHEN 7 THEN 'SPAIN' WHEN 8 THEN 'EU' WHEN 9 THEN 'usa' WHEN 10 THEN 'uy' WHEN 11 THEN 'South Korea' WHEN 12 THEN 'Au' ELSE 'abc' END AS raw FROM {customer}"""


@query(f"""SELECT k, CASE WHEN regexp_matches(t, '^[A-Z]{{3}}$') THEN t ELSE coalesce(CASE WHEN regexp_matches(t, '^[A-Za-z]{{2}}$') THEN {case_map('upper(t)', V.ISO2)} END,
  {case_map('lower(t)', V.COUNTRY_NAMES)}, t) END AS iso3 FROM (SELECT k, trim(raw) AS t FROM {text(COUNTRIES)})""")
def country_iso3(spark, sf):
    return frame(spark, sf, COUNTRIES).select("k", V.country_iso3(c("raw")).alias("iso3"))


FREE = """SELECT c_custkey AS k, CASE c_custkey % 16 WHEN 0 THEN 'Team Austria' WHEN 1 THEN 'LU - Flying Dogs' WHEN 2 THEN 'Luxemburg' WHEN 3 THEN 'GB Green'
    WHEN 4 THEN 'ger' WHEN 5 THEN 'U.K.' WHEN 6 THEN 'the united states of america team' WHEN 7 THEN 'SLO blue' WHEN 8 THEN 'Great north macedonia fans'
    WHEN 9 THEN 'nowhere' WHEN 10 THEN '' WHEN 11 THEN 'XYZ' WHEN 12 THEN 'Finlandia' WHEN 13 THEN 'South Africa - Two' WHEN 14 THEN 'team  poland'
    ELSE 'CZE red' END AS raw FROM {customer}"""


def _free_sql():
    lower = {k.lower(): v for k, v in V.TEXT_COUNTRIES.items()}
    inside = " ".join(f"WHEN regexp_matches(lower(t), {q(chr(92) + 'b' + n.lower() + chr(92) + 'b')}) THEN '{V.TEXT_COUNTRIES[n]}'"
                      for n in sorted(V.TEXT_COUNTRIES, key=len, reverse=True))
    codes = ", ".join(f"'{v}'" for v in sorted(set(V.TEXT_COUNTRIES.values())))
    return f"""CASE WHEN t = '' THEN '' WHEN {case_map('lower(t)', lower)} IS NOT NULL THEN {case_map('lower(t)', lower)}
      WHEN regexp_matches(code, '^[A-Z]{{2}}$') THEN {case_map('code', V.TEXT_ISO2, "''")}
      WHEN regexp_matches(code, '^[A-Z]{{3}}$') THEN {case_map('code', V.TEXT_CODE_ALIASES, 'code')}
      WHEN length(f) = 2 AND {case_map('f', V.TEXT_ISO2)} IS NOT NULL THEN {case_map('f', V.TEXT_ISO2)}
      WHEN length(f) = 3 AND {case_map('f', V.TEXT_CODE_ALIASES, 'f')} IN ({codes}) THEN {case_map('f', V.TEXT_CODE_ALIASES, 'f')}
      {inside} ELSE '' END"""


@query(f"""SELECT k, {_free_sql()} AS iso3 FROM (SELECT k, t, replace(upper(t), '.', '') AS code, upper(regexp_extract(t, '[A-Za-z]+')) AS f FROM
  (SELECT k, {case_map('t', V.TEXT_NAME_ALIASES, 't')} AS t FROM (SELECT k, trim(regexp_replace(trim(split_part(trim(raw), ' - ', 1)), '(?i)^team\\s+', '')) AS t FROM {text(FREE)})))""")
def country_from_text(spark, sf):
    return frame(spark, sf, FREE).select("k", V.country_from_text(c("raw")).alias("iso3"))


CHIPS = """SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN '203' WHEN 1 THEN '040' WHEN 2 THEN '999' WHEN 3 THEN '12' ELSE '703' END ||
    CASE WHEN o_orderkey % 5 = 3 THEN '' ELSE CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN ' Ita' ELSE '' END END AS chip,
  CASE o_orderkey % 4 WHEN 0 THEN 'aut' WHEN 1 THEN 'NOR-' WHEN 2 THEN '' ELSE 'x' END || CAST(o_custkey AS STRING) AS lic FROM {orders}"""
LIC = {"AUT": "AUT", "GER": "DEU"}


@query(f"""SELECT k, CASE WHEN length(chip) < 3 THEN '' ELSE {case_map('chip[1:3]', V.CHIP_COUNTRIES, "upper(regexp_extract(chip, '[^ ] +([A-Za-z]{3})$', 1))")} END AS by_chip,
  CASE WHEN regexp_matches(upper(lic), '^[A-Z]{{3}}') THEN {case_map('upper(lic)[1:3]', LIC, "''")} WHEN regexp_matches(lic, '^\\d+$') THEN 'CHE' ELSE '' END AS by_licence FROM {text(CHIPS)}""")
def country_from_prefix(spark, sf):
    return frame(spark, sf, CHIPS).select("k", V.country_from_chip(c("chip")).alias("by_chip"), V.country_from_licence(c("lic"), LIC).alias("by_licence"))


FLAG_SRC = """SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN 'CZE' WHEN 1 THEN 'gb' WHEN 2 THEN 'XXX' WHEN 3 THEN '' WHEN 4 THEN 'usa' WHEN 5 THEN NULL ELSE 'Norway' END AS code FROM {customer}"""


@query(f"""SELECT k, flag, CASE WHEN length(flag) = 2 AND flag <> code THEN translate(flag, '{V.FLAG_LETTERS}', '{V.LETTERS}') ELSE '' END AS iso2 FROM (
  SELECT k, code, CASE WHEN coalesce(code, '') = '' THEN '' WHEN length(code) = 3 THEN coalesce(translate({case_map('upper(code)', V.FLAGS)}, '{V.LETTERS}', '{V.FLAG_LETTERS}'), code)
    WHEN length(code) = 2 THEN translate(upper(code), '{V.LETTERS}', '{V.FLAG_LETTERS}') ELSE code END AS flag FROM {text(FLAG_SRC)})""")
def country_flags(spark, sf):
    d = frame(spark, sf, FLAG_SRC).select("k", V.iso3_to_flag(c("code")).alias("flag"))
    return d.withColumn("iso2", V.flag_to_iso2(c("flag")))


NUMS = """SELECT event_id AS k, CASE event_id % 9 WHEN 0 THEN '12,5' WHEN 1 THEN ' 7.0 ' WHEN 2 THEN '' WHEN 3 THEN 'abc' WHEN 4 THEN '-3' WHEN 5 THEN '1e2' WHEN 6 THEN '.5'
    WHEN 7 THEN CAST(user_id AS STRING) || ',25' ELSE NULL END AS raw FROM {events}"""


@query(f"""SELECT k, v AS num, CAST(trunc(v) AS BIGINT) AS whole FROM (SELECT k, try_cast(replace(trim(raw), ',', '.') AS DOUBLE) AS v FROM {text(NUMS)})""")
def parse_numbers(spark, sf):
    return frame(spark, sf, NUMS).select("k", V.parse_float(c("raw")).alias("num"), V.parse_int(c("raw")).alias("whole"))


@query("""SELECT l_orderkey * 8 + l_linenumber AS k, round(ln(l_extendedprice) * 20 / nullif(l_quantity, 1), 2) AS speed,
  greatest(round(l_quantity - l_linenumber * 5 - (l_orderkey % 2) * 5, 2), 0) AS late FROM lineitem""")
def derived_measures(spark, sf):
    d = table(spark, sf, "lineitem")
    return d.select((c("l_orderkey") * 8 + c("l_linenumber")).alias("k"),
                    V.derive_speed(F.ln("l_extendedprice") * 20, F.nullif(c("l_quantity"), F.lit(1.0))).alias("speed"),
                    V.derive_time_faults(c("l_quantity"), c("l_linenumber"), c("l_orderkey") % 2).alias("late"))


RANGES = "SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST((o_orderkey % 4) * 15 AS INT) END AS b FROM {orders}"
_d = lambda x: f"(strftime({x}, '%b ') || day({x}))"
_y = lambda x: f"({_d(x)} || ', ' || year({x}))"


@query(f"""SELECT k, CASE WHEN b IS NULL OR a = b THEN {_y('a')} WHEN year(a) = year(b) AND month(a) = month(b) THEN {_d('a')} || '–' || day(b) || ', ' || year(a)
    WHEN year(a) = year(b) THEN {_d('a')} || '–' || {_d('b')} || ', ' || year(a) ELSE {_y('a')} || '–' || {_y('b')} END AS long_label,
  CASE WHEN b IS NULL OR a = b THEN {_y('a')} WHEN year(a) = year(b) AND month(a) = month(b) THEN {_d('a')} || '-' || day(b) || ', ' || year(a)
    ELSE {_d('a')} || ' - ' || {_y('b')} END AS short_label FROM {text(RANGES)}""")
def date_range_labels(spark, sf):
    d = frame(spark, sf, RANGES)
    return d.select("k", V.format_date_range(c("a"), c("b")).alias("long_label"), V.format_date_range(c("a"), c("b"), long=False).alias("short_label"))


EVENTS = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'European Open ' WHEN 1 THEN 'The AWC ' WHEN 2 THEN 'World Championship of ' ELSE 'Cup ' END || p_name AS name FROM {part}"


@query(f"SELECT k, contains(lower(name), 'european open') OR contains(lower(name), 'awc') OR contains(lower(name), 'world championship') OR contains(lower(name), 'wao') AS major FROM {text(EVENTS)}")
def major_events(spark, sf):
    return frame(spark, sf, EVENTS).select("k", V.is_major(c("name")).alias("major"))


# -------------------------------------------------------------- small text grammars

TOKENS = """SELECT l_orderkey * 8 + l_linenumber AS k, CASE l_orderkey % 6 WHEN 0 THEN 'R, 5, T' || CAST(l_quantity AS STRING) WHEN 1 THEN 'C | 5 | C | R' WHEN 2 THEN NULL
    WHEN 3 THEN '5,5 , R,R,R' WHEN 4 THEN 'T0.806, Tx' ELSE '10, 5, r, 2.5' END AS raw FROM {lineitem}"""
_parts = "[trim(p) for p in string_split(raw, CASE WHEN contains(raw, '|') THEN '|' ELSE ',' END)]"


@query(f"""SELECT k, CAST(len([x for x in p if x = '5']) AS BIGINT) AS faults, CAST(len([x for x in p if x = 'R']) AS BIGINT) AS refusals,
  CASE WHEN contains(raw, '|') THEN 0.0 ELSE coalesce(list_last([try_cast(x[2:] AS DOUBLE) for x in p if x[1] = 'T' AND try_cast(x[2:] AS DOUBLE) IS NOT NULL]), 0.0) END AS time_faults
  FROM (SELECT k, raw, {_parts} AS p FROM (SELECT k, coalesce(raw, '') AS raw FROM {text(TOKENS)}))""")
def fault_tokens(spark, sf):
    return frame(spark, sf, TOKENS).select("k", T.parse_fault_tokens(c("raw")).alias("s")).select("k", "s.*")


@query(f"""SELECT k, coalesce(list_sum([try_cast(x AS DOUBLE) for x in p if x[1] <> 'T' AND try_cast(x AS DOUBLE) IS NOT NULL]), 0.0) AS faults,
  CAST(len([x for x in p if x = 'R']) AS BIGINT) AS refusals, try_cast(list_last([x for x in p if x[1] = 'T'])[2:] AS DOUBLE) AS time_faults
  FROM (SELECT k, [upper(trim(x)) for x in string_split(coalesce(raw, ''), ',')] AS p FROM {text(TOKENS)})""")
def summed_fault_tokens(spark, sf):
    return frame(spark, sf, TOKENS).select("k", T.sum_fault_tokens(c("raw")).alias("s")).select("k", "s.*")


TRIPLES = "SELECT l_orderkey * 8 + l_linenumber AS k, CASE l_orderkey % 3 WHEN 0 THEN CAST(l_linenumber AS STRING) || '-' || CAST(l_orderkey % 4 AS STRING) || '-0' WHEN 1 THEN 'DIS' ELSE ' 1-2-3 ' END AS raw FROM {lineitem}"


@query(f"""SELECT k, CAST(nullif(regexp_extract(t, '^(\\d+)-(\\d+)-(\\d+)$', 1), '') AS BIGINT) AS faults, CAST(nullif(regexp_extract(t, '^(\\d+)-(\\d+)-(\\d+)$', 2), '') AS BIGINT) AS refusals
  FROM (SELECT k, trim(raw) AS t FROM {text(TRIPLES)})""")
def fault_triples(spark, sf):
    return frame(spark, sf, TRIPLES).select("k", T.parse_triple(c("raw")).alias("s")).select("k", "s.*")


SPECS = """SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'SCT: ' || CAST(o_custkey % 60 AS STRING) || ' secs, MCT: 68.5 secs, ' || CAST(150 + o_orderkey % 80 AS STRING) || 'm, 2 not run'
    WHEN 1 THEN 'MCT:70 secs' ELSE '' END AS raw,
  'Ring ' || CAST(o_orderkey % 4 AS STRING) || ' • Team-Jumping • Large' || chr(10) || 'Judge: ' || o_orderpriority || ' Novák' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'SCT: 41.5 s MCT: 60 s' ELSE '' END
    || ' Length: ' || CAST(o_custkey % 200 AS STRING) || ' m # Participants: ' || CAST(o_orderkey % 99 AS STRING) AS meta FROM {orders}"""
_n = lambda col, p: f"try_cast(nullif(regexp_extract({col}, '{p}', 1), '') AS DOUBLE)"


@query(f"""SELECT k, {_n('raw', 'SCT:\\s*([\\d.]+)')} AS sct, {_n('raw', 'MCT:\\s*([\\d.]+)')} AS mct, {_n('raw', '(\\d+)m\\b')} AS course_length,
  CAST(regexp_extract(meta, 'Ring\\s+(\\d+)', 1) AS BIGINT) AS ring, 'Team-Jumping' AS discipline, 'Large' AS size,
  trim(split_part(split_part(meta, 'Judge: ', 2), chr(10), 1)) AS judge, {_n('meta', 'SCT:\\s*([\\d.]+)\\s*s')} AS meta_sct, {_n('meta', 'MCT:\\s*([\\d.]+)\\s*s')} AS meta_mct,
  {_n('meta', 'Length:\\s*([\\d.]+)\\s*m')} AS meta_length, CAST(regexp_extract(meta, 'Participants:\\s*(\\d+)', 1) AS BIGINT) AS participants FROM {text(SPECS)}""")
def course_data(spark, sf):
    d = frame(spark, sf, SPECS).select("k", T.parse_course_spec(c("raw")).alias("s"), T.parse_labelled_meta(c("meta")).alias("m"))
    return d.select("k", "s.*", "m.ring", "m.discipline", "m.size", "m.judge", c("m.sct").alias("meta_sct"), c("m.mct").alias("meta_mct"),
                    c("m.course_length").alias("meta_length"), "m.participants")


DESCR = """SELECT l_orderkey * 8 + l_linenumber AS k, CASE l_orderkey % 10 WHEN 0 THEN 'Agility ' || CAST(l_linenumber AS STRING) || ' XS & S' WHEN 1 THEN 'GRAND FINAL L' WHEN 2 THEN 'Warm up 3 L'
    WHEN 3 THEN 'jumping Team IA1 & IA2' WHEN 4 THEN 'Final Team Relay XSA1 & SA1' WHEN 5 THEN 'Soft final Inter' WHEN 6 THEN 'Agility Individual LA3 by Kennel by Co' WHEN 7 THEN 'Snooker'
    WHEN 8 THEN '"Final Individual M" by X' ELSE 'Jumping ' || CAST(l_linenumber AS STRING) || ' Team M' END AS raw FROM {lineitem}"""
_cap = lambda x: f"upper({x}[1]) || lower({x}[2:])"


@query(f"""SELECT k, CASE WHEN warm THEN NULL WHEN g <> '' OR f <> '' THEN 'Final' WHEN ks <> '' THEN {_cap("kd")} WHEN ns <> '' THEN {_cap("nd")} END AS discipline,
  CASE WHEN warm THEN NULL WHEN g <> '' THEN g WHEN f <> '' THEN f WHEN ks <> '' THEN ks WHEN ns <> '' THEN ns END AS size_raw,
  CASE WHEN warm THEN NULL WHEN g <> '' OR f <> '' THEN team WHEN ks <> '' THEN lower(kt) = 'team' WHEN ns <> '' THEN team END AS is_team,
  CASE WHEN warm OR g <> '' OR f <> '' OR ks <> '' OR ns = '' THEN NULL ELSE CAST(nn AS BIGINT) END AS number
  FROM (SELECT k, starts_with(lower(d), 'warm up') AS warm, contains(lower(d), 'team') AS team,
    regexp_extract(d, '(?i)^(?:GRAND|SOFT)\\s+FINAL\\s+(.+)', 1) AS g, regexp_extract(d, '(?i)^Final\\s+(?:Individual|Team(?:\\s+Relay)?)\\s+(.+)', 1) AS f,
    regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(Individual|Team)\\s+(.+)', 1) AS kd, regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(Individual|Team)\\s+(.+)', 2) AS kt,
    regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(Individual|Team)\\s+(.+)', 3) AS ks, regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(\\d+)\\s+(.+)', 1) AS nd,
    regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(\\d+)\\s+(.+)', 2) AS nn, regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(\\d+)\\s+(.+)', 3) AS ns
  FROM (SELECT k, trim(raw) AS d FROM {text(DESCR)}))""")
def run_descriptions(spark, sf):
    return frame(spark, sf, DESCR).select("k", T.parse_description(c("raw")).alias("s")).select("k", "s.*")


@query(f"""SELECT k, CASE WHEN f <> '' THEN 'Final' WHEN ks <> '' THEN {_cap("kd")} END AS discipline, CASE WHEN f <> '' THEN f WHEN ks <> '' THEN ks END AS size_raw,
  CASE WHEN f <> '' OR ks <> '' THEN team END AS is_team
  FROM (SELECT k, contains(lower(d), 'team') AS team, regexp_extract(d, '(?i)^Final\\s+(?:Individual|Team(?:\\s+Relay)?)\\s+(.+)', 1) AS f,
    regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(?:Individual|Team)\\s+(.+)', 1) AS kd, regexp_extract(d, '(?i)^(Agility|Jumping)\\s+(?:Individual|Team)\\s+(.+)', 2) AS ks
  FROM (SELECT k, trim(trim(regexp_replace(trim(raw), '\\s+by\\s+.+$', '')), '"') AS d FROM {text(DESCR)}))""")
def sponsored_descriptions(spark, sf):
    d = frame(spark, sf, DESCR).select("k", T.parse_description(c("raw"), "sponsored").alias("s"))
    return d.select("k", "s.discipline", "s.size_raw", "s.is_team")


CODES = """SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 0 THEN 'IA1 & IA2' WHEN 1 THEN 'LA3' WHEN 2 THEN 'XSA1 & XSA2 & SA1' WHEN 3 THEN 'XS & S' WHEN 4 THEN 'M open' WHEN 5 THEN 'XSmall'
    WHEN 6 THEN 'Huge' WHEN 7 THEN ' S ' ELSE 'medium' END AS raw FROM {orders}"""


@query(f"""SELECT k, CASE WHEN {case_map('t', V.SIZES)} IS NOT NULL THEN {case_map('t', V.SIZES)} WHEN l <> '' THEN {case_map('l', V.SIZES)} WHEN starts_with(t, 'XS') THEN 'Small' ELSE t END AS size
  FROM (SELECT k, trim(raw) AS t, regexp_extract(trim(raw), '^(XS|I|L|M|S)(?:A\\d|$|\\s)', 1) AS l FROM {text(CODES)})""")
def size_codes(spark, sf):
    return frame(spark, sf, CODES).select("k", T.size_from_code(c("raw")).alias("size"))


ROUNDS = """SELECT o_orderkey AS k, o_orderkey % 2 = 0 AS team, CASE o_orderkey % 3 WHEN 0 THEN 'In' WHEN 1 THEN 'L' ELSE 'Xs+S' END AS size, CASE o_orderkey % 2 WHEN 0 THEN 'A2' ELSE 'JUMPING' END AS disc,
  CASE o_orderkey % 10 WHEN 0 THEN 'ind_agility_in_2' WHEN 1 THEN 'team_agility_l_ind' WHEN 2 THEN 'fri_a1_in' WHEN 3 THEN '20240612_55_S-3!' WHEN 4 THEN 'sat_jumping_open_2_l' WHEN 5 THEN 'ring_jump_x'
    WHEN 6 THEN 'plain' WHEN 7 THEN 'r_12_x' WHEN 8 THEN 'ind_jumping_l_kl1_3' ELSE 'a_0_b_4' END AS raw FROM {orders}"""
_base = f"CASE WHEN {{t}} THEN 'team' ELSE 'ind' END || '_' || lower({case_map('disc', V.DISCIPLINES, 'disc')}) || '_' || lower({case_map('size', V.SIZES, 'size')})"


@query(f"""SELECT k, {_base.format(t='team')} AS base, CASE WHEN p[1] IN ('ind', 'team') THEN {_base.format(t="p[1] = 'team'")} || CASE WHEN len(p) > 3 THEN '_' || array_to_string(p[4:], '_') ELSE '' END
  WHEN len(p) < 3 THEN raw
  WHEN regexp_matches(p[1], '^\\d{{8}}$') AND regexp_matches(p[2], '^-?\\d+$') THEN {_base.format(t='team')} || '_' || p[1] || '_' || p[2] || '_' || regexp_replace(lower(p[3]), '[^a-z0-9]+', '', 'g')
  WHEN p[1] IN ('fri', 'sat') THEN {_base.format(t='team')} || '_' || array_to_string([x for x in [regexp_replace(lower(y), '[^a-z0-9]+', '', 'g') for y in p] if x <> ''], '_')
  ELSE {_base.format(t='team')} || coalesce('_' || nullif(CAST(CAST(([x for x in p[2:] if regexp_matches(x, '^\\d+$')])[1] AS BIGINT) AS VARCHAR), '0'), '') END AS key
  FROM (SELECT *, string_split(raw, '_') AS p FROM {text(ROUNDS)})""")
def round_keys(spark, sf):
    d = frame(spark, sf, ROUNDS)
    return d.select("k", T.round_key(c("team"), V.canon_discipline(c("disc")), V.canon_size(c("size"))).alias("base"),
                    T.normalize_round_key(c("raw"), c("size"), c("disc"), c("team")).alias("key"))


SUFFIX = """SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 0 THEN p_name || ' Border Collie' WHEN 1 THEN 'Poodle' WHEN 2 THEN p_name || ' Miniature American Shepherd' WHEN 3 THEN p_name
    WHEN 4 THEN 'Mudi ' || p_name ELSE p_name || ' Cocker Spaniel (English)' END AS raw FROM {part}"""


def _suffix_sql():
    start = " ".join(f"WHEN starts_with(raw, {q(b)}) THEN {q(b)}" for b in T.BREEDS)
    end = " ".join(f"WHEN ends_with(raw, {q(b)}) THEN {q(b)}" for b in sorted(T.BREEDS, key=len, reverse=True))
    return f"CASE {start} END AS s, CASE {end} END AS e"


@query(f"""SELECT k, CASE WHEN s IS NOT NULL THEN '' WHEN e IS NOT NULL THEN trim(raw[1:length(raw) - length(e)]) ELSE raw END AS rest, coalesce(s, e, '') AS suffix,
  {case_map("coalesce(s, e, '')", T.BREED_FIXES, "coalesce(s, e, '')")} AS fixed FROM (SELECT *, {_suffix_sql()} FROM {text(SUFFIX)})""")
def known_suffixes(spark, sf):
    d = frame(spark, sf, SUFFIX).select("k", T.cut_known_suffix(c("raw")).alias("s")).select("k", "s.*")
    return d.withColumn("fixed", T.fix_truncated(c("suffix")))


LAID = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'Rex ' || p_type WHEN 1 THEN p_type || ' Rex' WHEN 2 THEN 'Day of ' || p_name ELSE 'Day ' || lower(p_type) END AS raw FROM {part}"
WORDS = "SELECT p_type AS value, MIN(p_partkey) AS place FROM {part} GROUP BY p_type UNION ALL SELECT DISTINCT split_part(p_name, ' ', 2), 1000000 FROM {part} WHERE p_partkey % 2 = 0"


@query(f"""WITH w AS (SELECT value, MIN(place) AS place FROM {text(WORDS)} WHERE value <> '' GROUP BY 1), l AS (SELECT * FROM {text(LAID)}),
  s AS (SELECT k, arg_min(value, (place, value)) AS v FROM l JOIN w ON starts_with(raw, value) GROUP BY 1), e AS (SELECT k, arg_max(value, length(value)) AS v FROM l JOIN w ON ends_with(raw, value) GROUP BY 1)
  SELECT k, CASE WHEN s.v IS NOT NULL THEN '' WHEN e.v IS NOT NULL THEN trim(raw[1:length(raw) - length(e.v)]) ELSE raw END AS rest, coalesce(s.v, e.v, '') AS suffix FROM l LEFT JOIN s USING (k) LEFT JOIN e USING (k)""")
def dictionary_suffixes(spark, sf):
    return T.cut_known_suffix_of(frame(spark, sf, LAID), "raw", frame(spark, sf, WORDS)).select("k", "rest", "suffix")
