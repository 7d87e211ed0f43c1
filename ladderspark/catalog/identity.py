"""Identity resolution over names derived from customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderspark.catalog.base import query
from ladderspark.catalog.fixtures import PEOPLE, frame, norm_sql, squeeze_sql, text
from ladderspark.catalog.names import IGNORED, entity_sql, parsed_entities, sorted_sql
from ladderspark.config import RatingConfig
from ladderspark.functions import names as N
from ladderspark.operators import identity as I
from ladderspark.operators.scan import spread

c = F.col

DIM = f"SELECT k AS id, CASE WHEN k % 20 = 0 THEN tag ELSE first || ' ' || last || ' ' || tag END AS name, 'N' || CAST(nk AS STRING) AS country FROM ({PEOPLE})"
ALIAS = f"""SELECT tag || ' ' || first || ' ' || last AS name, k AS canonical_id FROM ({PEOPLE}) WHERE k % 2 = 0
  UNION ALL SELECT 'nick ' || tag AS name, k AS canonical_id FROM ({PEOPLE}) WHERE k % 3 = 0"""
ASKED = f"""SELECT o_orderkey AS _seq, CASE o_orderkey % 10 WHEN 0 THEN first || ' ' || last || ' ' || tag WHEN 1 THEN last || ' ' || tag || ', ' || first
    WHEN 2 THEN first || ' ' || last || ' ' || tag WHEN 3 THEN tag || ' ' || first || ' ' || last WHEN 4 THEN first || ' ' || last
    WHEN 5 THEN first || ' ' || last || ' ' || tag || ' junior' WHEN 6 THEN 'nick ' || tag WHEN 7 THEN tag || 'x' WHEN 8 THEN last || ' ' || tag
    ELSE 'Unknown Person ' || CAST(o_orderkey % 40 AS STRING) END AS raw,
  CASE WHEN o_orderkey % 10 = 2 THEN 'N99' ELSE 'N' || CAST(nk AS STRING) END AS country FROM {{orders}} JOIN ({PEOPLE}) ON k = o_custkey"""

DIM_SQL = f"dim AS (SELECT id, name, country, {norm_sql('name')} AS norm FROM {text(DIM)})"
ALIAS_SQL = f"alias AS (SELECT {norm_sql('name')} AS alias_name, MIN(canonical_id) AS canonical_id FROM {text(ALIAS)} GROUP BY 1)"
ASKED_SQL = f"""asked AS (SELECT raw, country, MIN(_seq) AS _seq, {norm_sql('raw')} AS norm FROM {text(ASKED)} GROUP BY raw, country)"""
CASCADE = f"""{DIM_SQL}, {ALIAS_SQL}, {ASKED_SQL},
  contained AS (SELECT a._seq, COUNT(*) AS n, MIN(d.id) AS cid FROM asked a JOIN dim d ON d.country = a.country AND d.norm <> a.norm AND d.norm <> ''
    AND (contains(d.norm, a.norm) OR contains(a.norm, d.norm)) WHERE length(a.norm) >= 10 AND contains(a.norm, ' ') GROUP BY 1),
  found AS (SELECT a.*, al.canonical_id AS aid, e.id AS eid, o.oid, CASE WHEN ct.n = 1 THEN ct.cid END AS cid FROM asked a
    LEFT JOIN alias al ON al.alias_name = a.norm LEFT JOIN dim e ON e.norm = a.norm AND e.country = a.country
    LEFT JOIN (SELECT norm, MIN(id) AS oid FROM dim GROUP BY 1 HAVING COUNT(*) = 1) o ON o.norm = a.norm AND contains(a.norm, ' ')
    LEFT JOIN contained ct ON ct._seq = a._seq),
  staged AS (SELECT *, CASE WHEN aid IS NOT NULL THEN 'alias' WHEN eid IS NOT NULL THEN 'exact' WHEN oid IS NOT NULL THEN 'name' WHEN cid IS NOT NULL THEN 'containment' ELSE 'new' END AS stage FROM found),
  fresh AS (SELECT norm, country, row_number() OVER (ORDER BY MIN(_seq)) + (SELECT MAX(id) FROM dim) AS nid FROM staged WHERE stage = 'new' GROUP BY norm, country),
  resolved AS (SELECT s.*, CASE WHEN stage = 'new' THEN nid ELSE coalesce(aid, eid, oid, cid) END AS handler_id FROM staged s LEFT JOIN fresh f ON f.norm = s.norm AND f.country = s.country)"""


def dim(spark, sf):
    return frame(spark, sf, DIM).withColumn("norm", N.normalize_name(c("name")))


def alias(spark, sf):
    d = frame(spark, sf, ALIAS).select(N.normalize_name(c("name")).alias("alias_name"), "canonical_id")
    return d.groupBy("alias_name").agg(F.min("canonical_id").alias("canonical_id"))


def asked(spark, sf):
    d = frame(spark, sf, ASKED).groupBy("raw", "country").agg(F.min("_seq").alias("_seq"))
    return d.select(N.normalize_name(c("raw")).alias("norm"), "country", "_seq", "raw", c("_seq").alias("key"))


def resolved(spark, sf):
    return I.resolve_handlers(frame(spark, sf, ASKED), dim(spark, sf), alias(spark, sf))


@query(f"WITH {CASCADE} SELECT _seq, aid AS alias_id FROM found")
def resolve_alias(spark, sf):
    return I.resolve_alias(asked(spark, sf), alias(spark, sf)).select("_seq", "alias_id")


@query(f"WITH {CASCADE} SELECT _seq, eid AS exact_id FROM found")
def match_exact(spark, sf):
    return I.match_exact(asked(spark, sf), dim(spark, sf)).select("_seq", "exact_id")


@query(f"WITH {CASCADE} SELECT _seq, oid AS name_id FROM found")
def match_name_only(spark, sf):
    return I.match_name_only(asked(spark, sf), dim(spark, sf)).select("_seq", "name_id")


@query(f"WITH {CASCADE} SELECT _seq, cid AS contained_id FROM found")
def match_containment(spark, sf):
    return I.match_containment(asked(spark, sf), dim(spark, sf)).select("_seq", "contained_id")


@query(f"WITH {CASCADE} SELECT raw, country, norm, stage, handler_id FROM resolved")
def resolve_handlers(spark, sf):
    return resolved(spark, sf).select("raw", "country", "norm", "stage", "handler_id")


@query(f"""WITH {CASCADE} SELECT handler_id AS id, {squeeze_sql("CASE WHEN len(string_split(raw, ',')) = 2 THEN split_part(raw, ',', 2) || ' ' || split_part(raw, ',', 1) ELSE raw END")} AS name, norm, country
  FROM (SELECT *, row_number() OVER (PARTITION BY handler_id ORDER BY _seq) AS rn FROM resolved WHERE stage = 'new') WHERE rn = 1""")
def new_handlers(spark, sf):
    return I.new_handlers(resolved(spark, sf))


@query(f"""WITH {CASCADE}, old AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'X' || id || ', Y' ELSE name END AS name, norm, CASE WHEN id % 5 = 0 THEN '' ELSE country END AS country FROM dim),
  seen AS (SELECT handler_id AS id, arg_min(country, _seq) FILTER (country <> '') AS sc, bool_or(NOT contains(raw, ',')) AS plain FROM resolved WHERE stage <> 'new' GROUP BY 1)
  SELECT id, norm, CASE WHEN plain AND contains(name, ',') THEN trim(split_part(name, ',', 2)) || ' ' || trim(split_part(name, ',', 1)) ELSE name END AS name,
    CASE WHEN country = '' THEN coalesce(sc, country) ELSE country END AS country FROM old LEFT JOIN seen USING (id)""")
def backfill_handlers(spark, sf):
    old = dim(spark, sf).select(
        "id", F.when(c("id") % 4 == 0, F.concat(F.lit("X"), c("id").cast("string"), F.lit(", Y"))).otherwise(c("name")).alias("name"),
        "norm", F.when(c("id") % 5 == 0, "").otherwise(c("country")).alias("country"))
    return I.backfill_handlers(old, resolved(spark, sf))


@query(f"""WITH {DIM_SQL}, {ALIAS_SQL}, rot AS (SELECT id, unnest(CASE WHEN n = 2 THEN [p[2] || ' ' || p[1]] WHEN n > 2 THEN
    [array_to_string(list_prepend(p[n], p[1:n-1]), ' '), array_to_string(list_append(p[2:n], p[1]), ' ')] ELSE [] END) AS alias_name
    FROM (SELECT id, string_split(norm, ' ') AS p, len(string_split(norm, ' ')) AS n FROM dim))
  SELECT alias_name, MIN(id) AS canonical_id, 'Import' AS source FROM rot WHERE alias_name NOT IN (SELECT alias_name FROM alias) GROUP BY 1""")
def derive_aliases(spark, sf):
    return I.derive_aliases(dim(spark, sf), alias(spark, sf))


@query(f"""WITH {ALIAS_SQL}, rows AS (SELECT 'nick ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS alias_name, c_custkey AS canonical_id FROM customer)
  SELECT 'taken' AS what, COUNT(*) AS n FROM rows WHERE alias_name IN (SELECT alias_name FROM alias)
  UNION ALL SELECT 'table', (SELECT COUNT(*) FROM alias) + (SELECT COUNT(*) FROM rows WHERE alias_name NOT IN (SELECT alias_name FROM alias))""")
def add_alias(spark, sf):
    rows = frame(spark, sf, f"SELECT 'nick ' || tag AS alias_name, k AS canonical_id FROM ({PEOPLE})")
    full, refused = I.add_alias(alias(spark, sf).withColumn("source", F.lit("Import")), rows)
    count = lambda d, w: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n")
    return count(refused, "taken").unionByName(count(full, "table"))


TYPO = f"""SELECT k AS key, CASE k % 4 WHEN 0 THEN first || ' ' || last || ' q' || tag WHEN 1 THEN replace(first, 'o', '0') || ' ' || last || ' ' || tag WHEN 2 THEN first || last || tag
    ELSE first || ' ' || last || ' ' || tag || 'xyz' END AS name, 'N' || CAST(nk AS STRING) AS country FROM ({PEOPLE})"""


@query(f"""WITH {DIM_SQL}, t AS (SELECT key, country, {norm_sql('name')} AS norm FROM {text(TYPO)}),
  hits AS (SELECT t.key, COUNT(*) AS n, MIN(d.id) AS id FROM t JOIN dim d ON d.country = t.country AND d.norm <> t.norm AND levenshtein(d.norm, t.norm) <= 2 GROUP BY 1)
  SELECT t.key, CASE WHEN n = 1 THEN id END AS edit_id FROM t LEFT JOIN hits USING (key)""")
def match_edit_distance(spark, sf):
    d = frame(spark, sf, TYPO).withColumn("norm", N.normalize_name(c("name")))
    return I.match_edit_distance(d, dim(spark, sf)).select("key", "edit_id")


# -------------------------------------------------------------- entities of a handler

ENT0 = "SELECT p_partkey AS id, CAST(floor(p_partkey * 3 / 4) AS BIGINT) AS handler_id, p_name, p_type, p_size, translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij') AS tag FROM {part}"
ENT = f"""SELECT id, handler_id, CASE WHEN id % 5 = 0 THEN 'Day' ELSE split_part(p_name, ' ', 2) || ' ' || tag END AS call_name,
  CASE WHEN id % 2 = 0 THEN p_name || ' von ' || tag || ' ' || lower(p_type) ELSE '' END AS registered_name,
  CASE p_size % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'I' ELSE 'L' END AS size FROM ({ENT0})"""
EALIAS = f"SELECT 'ali ' || tag AS alias_name, id AS canonical_id FROM ({ENT0}) WHERE id % 4 = 0"
EROWS = f"""SELECT o_orderkey AS _seq, o_custkey AS handler_id, CASE o_orderkey % 8 WHEN 0 THEN call_name WHEN 1 THEN 'A3Ch ' || registered_name || ' (' || call_name || ')' WHEN 2 THEN registered_name || ' (cp)'
    WHEN 3 THEN 'ali ' || translate(CAST(id AS STRING), '0123456789', 'abcdefghij') WHEN 4 THEN call_name || ' of the hill' WHEN 5 THEN 'Someone ' || CAST(o_orderkey % 30 AS STRING)
    WHEN 6 THEN split_part(call_name, ' ', 2) || 'q' ELSE registered_name || ' "Ninja"' END AS raw,
  CASE WHEN o_orderkey % 7 = 0 THEN CASE size WHEN 'S' THEN 'M' WHEN 'M' THEN 'S' WHEN 'I' THEN 'L' ELSE 'I' END ELSE size END AS size
  FROM {{orders}} JOIN ({ENT}) ON id = CASE WHEN o_orderkey % 3 = 0 THEN o_custkey + 7 ELSE CAST(ceil(o_custkey * 4 / 3) AS BIGINT) END"""
EDIM_SQL = f"edim AS (SELECT id, handler_id, size, {norm_sql('call_name')} AS call_norm, {norm_sql('registered_name')} AS reg_norm FROM {text(ENT)})"
_xq = f"length(qc) >= 2 AND lower(qc) NOT IN {IGNORED}"
_xp = f"length(pc) >= 2 AND lower(pc) NOT IN {IGNORED} AND NOT starts_with(lower(pc), 'fci')"
EROWS_SQL = f"""e0 AS (SELECT handler_id, raw, size, MIN(_seq) AS _seq, {entity_sql('raw')} AS clean FROM {text(EROWS)} GROUP BY handler_id, raw, size),
  e1 AS (SELECT *, trim(regexp_extract(clean, '"([^"]+)"\\s*$', 1)) AS qc, nullif(trim(rtrim(trim(regexp_replace(clean, '"[^"]+"\\s*$', '')), '"')), '') AS qr,
    trim(regexp_extract(clean, '\\(([^()]+)\\)\\s*$', 1)) AS pc, nullif(trim(regexp_replace(clean, '\\([^()]+\\)\\s*$', '')), '') AS pr FROM e0),
  e2 AS (SELECT handler_id, raw, size, _seq, clean, CASE WHEN {_xq} THEN qc WHEN {_xp} THEN pc END AS cn, CASE WHEN {_xq} THEN qr WHEN {_xp} THEN pr END AS rn FROM e1),
  e3 AS (SELECT handler_id, raw, size, _seq, clean, {norm_sql('clean')} AS fulln, CASE WHEN cn IS NOT NULL THEN {norm_sql('cn')} END AS calln, CASE WHEN rn IS NOT NULL THEN {norm_sql('rn')} END AS regn FROM e2),
  v AS (SELECT handler_id, size, _seq, 1 AS no, calln AS name FROM e3 WHERE calln IS NOT NULL UNION ALL SELECT handler_id, size, _seq, 2, fulln FROM e3
    UNION ALL SELECT handler_id, size, _seq, 3, regn FROM e3 WHERE regn IS NOT NULL),
  ha AS (SELECT v._seq, d.handler_id = v.handler_id AS own, struct_pack(no := v.no, id := d.id) AS o, d.id FROM v JOIN {text(EALIAS)} a ON a.alias_name = v.name JOIN edim d ON d.id = a.canonical_id),
  hn AS (SELECT v._seq, d.handler_id = v.handler_id AS own, struct_pack(no := v.no, id := d.id) AS o, d.id FROM v JOIN edim d ON d.size = v.size AND v.name <> '' AND v.name IN (d.call_norm, d.reg_norm)),
  hf AS (SELECT _seq, MIN(id) AS id FROM (SELECT DISTINCT v._seq, d.id FROM v JOIN (SELECT id, handler_id, size, unnest([call_norm, reg_norm]) AS nm FROM edim) d ON d.handler_id = v.handler_id AND d.nm <> '' AND length(v.name) >= 3
      AND (d.size = v.size OR d.size || v.size IN ('SM', 'MS', 'IL', 'LI'))
      AND (d.nm = v.name OR (least(length(d.nm), length(v.name)) >= 3 AND (regexp_matches(d.nm, '(^|[^\\pL\\pN_])' || regexp_escape(v.name) || '($|[^\\pL\\pN_])') OR regexp_matches(v.name, '(^|[^\\pL\\pN_])' || regexp_escape(d.nm) || '($|[^\\pL\\pN_])')))))
    GROUP BY 1 HAVING COUNT(*) = 1),
  er AS (SELECT e3.*, (SELECT arg_min(id, o) FROM ha WHERE ha._seq = e3._seq AND own) AS oa, (SELECT arg_min(id, o) FROM hn WHERE hn._seq = e3._seq AND own) AS oe, hf.id AS fz,
    CASE WHEN length(fulln) > 10 OR length(coalesce(regn, '')) > 10 THEN coalesce((SELECT arg_min(id, o) FROM ha WHERE ha._seq = e3._seq), (SELECT arg_min(id, o) FROM hn WHERE hn._seq = e3._seq)) END AS gl
    FROM e3 LEFT JOIN hf ON hf._seq = e3._seq)"""


def edim(spark, sf):
    return frame(spark, sf, ENT).select("id", "handler_id", "size", N.normalize_name(c("call_name")).alias("call_norm"), N.normalize_name(c("registered_name")).alias("reg_norm"))


def eresolved(spark, sf):
    d = edim(spark, sf)
    return I.resolve_entities(frame(spark, sf, EROWS), d.drop("handler_id"), d.select("handler_id", "id"), frame(spark, sf, EALIAS))


@query(f"""WITH {EDIM_SQL}, {EROWS_SQL} SELECT handler_id, raw, size, CASE WHEN oa IS NOT NULL THEN 'own alias' WHEN oe IS NOT NULL THEN 'own exact' WHEN fz IS NOT NULL THEN 'own fuzzy'
  WHEN gl IS NOT NULL THEN 'global' ELSE 'new' END AS stage, coalesce(oa, oe, fz, gl) AS id FROM er""")
def resolve_entities(spark, sf):
    return eresolved(spark, sf).select("handler_id", "raw", "size", "stage", "id")


@query(f"""WITH {EDIM_SQL}, {EROWS_SQL}, n AS (SELECT *, calln IS NULL AND len(string_split(clean, ' ')) >= 3 AS long FROM er WHERE coalesce(oa, oe, fz, gl) IS NULL),
  m AS (SELECT *, CASE WHEN long THEN '' ELSE coalesce(calln, fulln) END AS cn, CASE WHEN long THEN fulln ELSE coalesce(regn, CASE WHEN calln IS NOT NULL THEN fulln END, '') END AS rn FROM n)
  SELECT row_number() OVER (ORDER BY MIN(_seq)) + (SELECT MAX(id) FROM edim) AS id, handler_id, cn AS call_norm, arg_min(rn, _seq) AS reg_norm, size FROM m GROUP BY handler_id, cn, size, CASE WHEN cn = '' THEN rn ELSE '' END""")
def new_entities(spark, sf):
    top = edim(spark, sf).agg(F.max("id")).first()[0]
    return I.new_entities(eresolved(spark, sf), top)[1]


@query(f"""WITH {EDIM_SQL}, {EROWS_SQL}, m AS (SELECT coalesce(oa, oe, fz, gl) AS id, fulln, calln, regn FROM er),
  v2 AS (SELECT m.id, call_norm, unnest([fulln, calln, regn]) AS variant FROM m JOIN edim USING (id))
  SELECT lower(variant) AS alias_name, MIN(id) AS canonical_id, 'CallName' AS type, 'Import' AS source FROM v2 WHERE variant IS NOT NULL AND trim(variant) <> '' AND variant <> call_norm
    AND lower(variant) NOT IN (SELECT alias_name FROM {text(EALIAS)}) GROUP BY 1""")
def derive_entity_aliases(spark, sf):
    d = eresolved(spark, sf).filter("id is not null").join(spread(edim(spark, sf).select("id", c("call_norm").alias("canonical"))), "id")
    v = d.select("id", "canonical", F.explode(F.array("full", "call", "reg")).alias("variant")).filter("variant is not null")
    return I.derive_entity_aliases(v, frame(spark, sf, EALIAS).withColumn("type", F.lit("CallName")))


BACK = f"""SELECT o_orderkey AS _seq, id, CASE o_orderkey % 4 WHEN 0 THEN call_name WHEN 1 THEN registered_name WHEN 2 THEN split_part(call_name, ' ', 1) ELSE call_name || ' of old hill' END AS name,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Breed ' || CAST(o_orderkey % 9 AS STRING) ELSE NULL END AS breed FROM {{orders}} JOIN ({ENT}) ON id = o_custkey"""


@query(f"""WITH d AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE call_name END AS call_name, nullif(registered_name, '') AS registered_name, CAST(NULL AS VARCHAR) AS breed, size FROM {text(ENT)}),
  i AS (SELECT * FROM {text(BACK)}), s AS (SELECT id, arg_min(name, (length(name), _seq)) AS sh, arg_min(name, (-length(name), _seq)) AS lo FROM i WHERE name <> '' GROUP BY 1),
  b AS (SELECT id, arg_min(breed, _seq) AS br FROM i WHERE breed IS NOT NULL GROUP BY 1),
  k AS (SELECT d.*, br, [x for x in [call_name, registered_name, sh, lo] if x IS NOT NULL AND x <> ''] AS nm FROM d LEFT JOIN s USING (id) LEFT JOIN b USING (id)),
  p AS (SELECT *, nm[list_position([length(x) for x in nm], list_min([length(x) for x in nm]))] AS shortest, nm[list_position([length(x) for x in nm], list_max([length(x) for x in nm]))] AS longest FROM k),
  r AS (SELECT *, coalesce(length(longest) > length(shortest), false) AS spread, CASE WHEN registered_name IS NULL AND length(longest) > length(shortest) THEN longest ELSE registered_name END AS nreg FROM p)
  SELECT id, CASE WHEN spread AND length(shortest) >= 2 AND ((call_name = '' AND shortest <> coalesce(nreg, '')) OR (call_name <> '' AND length(shortest) < length(call_name))) THEN shortest ELSE call_name END AS call_name,
    nreg AS registered_name, coalesce(breed, br) AS breed, size FROM r""")
def backfill_entities(spark, sf):
    d = frame(spark, sf, ENT).select("id", F.when(c("id") % 3 == 0, "").otherwise(c("call_name")).alias("call_name"),
                                     F.nullif(c("registered_name"), F.lit("")).alias("registered_name"), F.lit(None).cast("string").alias("breed"), "size")
    return I.backfill_entities(d, frame(spark, sf, BACK))


TEAMS = "SELECT p_partkey AS team_id, CAST(floor(p_partkey * 3 / 4) AS BIGINT) AS handler_id, p_partkey AS entity_id FROM {part}"


@query("""SELECT handler_id, entity_id, row_number() OVER (ORDER BY handler_id, entity_id) + (SELECT MAX(p_partkey) FROM part) AS team_id, 25.0::DOUBLE AS mu, 8.333::DOUBLE AS sigma FROM
  (SELECT DISTINCT o_custkey AS handler_id, o_custkey + o_orderkey % 7 AS entity_id FROM orders
    WHERE o_custkey <> floor((o_custkey + o_orderkey % 7) * 3 / 4))
  UNION ALL SELECT CAST(floor(p_partkey * 3 / 4) AS BIGINT), p_partkey, p_partkey, 25.0, 8.333 FROM part""")
def resolve_teams(spark, sf):
    t = frame(spark, sf, TEAMS).select("team_id", "handler_id", "entity_id", F.lit(25.0).alias("mu"), F.lit(8.333).alias("sigma"))
    pairs = frame(spark, sf, "SELECT o_custkey AS handler_id, o_custkey + o_orderkey % 7 AS entity_id FROM {orders}")
    return I.resolve_teams(pairs, t, RatingConfig())


# -------------------------------------------------------------- variants, recovery, merge

VARIANTS = """SELECT 'h' || CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) AS handler,
  CASE p_partkey % 7 WHEN 0 THEN substr(split_part(p_name, ' ', 1), 1, 3) WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name WHEN 3 THEN p_name || ' of ' || lower(p_type)
    WHEN 4 THEN 'a3ch ' || p_name || ' of ' || lower(p_type) WHEN 5 THEN 'x ' || p_name || ' von y' ELSE 'rex ' || split_part(p_name, ' ', 1) END AS dog,
  CASE p_partkey % 4 WHEN 0 THEN p_name || ' of ' || lower(p_type) || ' kennel' WHEN 1 THEN 'a3ch ' || p_name || ' of gold' WHEN 2 THEN NULL ELSE 'the ' || p_name || ' von z' END AS reg FROM {part}"""


@query(f"""WITH RECURSIVE vr AS (SELECT DISTINCT handler, dog, reg, len(string_split(dog, ' ')) AS n, string_split(dog, ' ')[1] AS fw FROM {text(VARIANTS)}),
  dg AS (SELECT DISTINCT handler, dog, n, fw FROM vr), rg AS (SELECT DISTINCT handler, dog, n, reg, string_split(reg, ' ') AS w FROM vr WHERE reg IS NOT NULL),
  s1 AS (SELECT l.handler, l.dog, MIN((s.n, s.dog)) AS t FROM dg l JOIN dg s ON s.handler = l.handler AND s.n <= 2 AND s.dog <> '' AND s.n < l.n AND starts_with(l.fw, s.fw) GROUP BY ALL),
  r2 AS (SELECT * FROM rg WHERE (handler, dog) NOT IN (SELECT (handler, dog) FROM s1)),
  n2 AS (SELECT *, row_number() OVER (PARTITION BY handler ORDER BY n, dog) AS i FROM (SELECT DISTINCT handler, dog, n FROM r2)),
  e2 AS (SELECT DISTINCT b.handler, nb.i, na.i AS j FROM r2 b JOIN r2 a ON a.handler = b.handler AND (a.n, a.dog) < (b.n, b.dog) AND (
      (len(a.w[1:3]) = 3 AND a.w[1:3] IN (b.w[1:3], b.w[2:4], b.w[3:5])) OR (len(b.w[1:3]) = 3 AND b.w[1:3] IN (a.w[2:4], a.w[3:5])))
    JOIN n2 nb ON nb.handler = b.handler AND nb.dog = b.dog JOIN n2 na ON na.handler = a.handler AND na.dog = a.dog),
  p2 AS (SELECT handler, i, list(j) AS js FROM e2 GROUP BY ALL),
  a2 AS (SELECT DISTINCT handler, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS acts FROM n2 UNION ALL
    SELECT a2.handler, n2.i, CASE WHEN list_has_any(acts, coalesce(js, CAST([] AS BIGINT[]))) THEN acts ELSE list_append(acts, n2.i) END
    FROM a2 JOIN n2 ON n2.handler = a2.handler AND n2.i = a2.i + 1 LEFT JOIN p2 ON p2.handler = n2.handler AND p2.i = n2.i),
  k2 AS (SELECT handler, unnest(arg_max(acts, i)) AS j FROM a2 GROUP BY handler),
  s2 AS (SELECT e2.handler, b.dog, MIN((a.n, a.dog)) AS t FROM e2 JOIN k2 USING (handler, j) JOIN n2 a ON a.handler = e2.handler AND a.i = e2.j
    JOIN n2 b ON b.handler = e2.handler AND b.i = e2.i GROUP BY ALL),
  d2 AS (SELECT handler, dog, t[2] AS target FROM s1 UNION ALL SELECT handler, dog, t[2] FROM s2),
  n3 AS (SELECT handler, dog, row_number() OVER (PARTITION BY handler ORDER BY dog) AS i FROM dg WHERE n = 1 AND dog <> '' AND (handler, dog) NOT IN (SELECT (handler, dog) FROM d2)),
  e3 AS (SELECT DISTINCT b.handler, b.dog, a.i AS j, a.dog AS taker FROM rg b JOIN n3 a ON a.handler = b.handler AND list_contains(b.w, a.dog) AND a.dog <> b.dog
    WHERE (b.handler, b.dog) NOT IN (SELECT (handler, dog) FROM d2)),
  p3 AS (SELECT n3.handler, n3.i, list(e3.j) AS js FROM n3 JOIN e3 ON e3.handler = n3.handler AND e3.dog = n3.dog AND e3.j < n3.i GROUP BY ALL),
  a3 AS (SELECT DISTINCT handler, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS acts FROM n3 UNION ALL
    SELECT a3.handler, n3.i, CASE WHEN list_has_any(acts, coalesce(js, CAST([] AS BIGINT[]))) THEN acts ELSE list_append(acts, n3.i) END
    FROM a3 JOIN n3 ON n3.handler = a3.handler AND n3.i = a3.i + 1 LEFT JOIN p3 ON p3.handler = n3.handler AND p3.i = n3.i),
  k3 AS (SELECT handler, unnest(arg_max(acts, i)) AS j FROM a3 GROUP BY handler),
  links AS (SELECT * FROM d2 UNION ALL SELECT handler, dog, MIN(taker) FROM e3 JOIN k3 USING (handler, j) GROUP BY ALL),
  walk AS (SELECT handler, dog, target FROM links UNION ALL SELECT w.handler, w.dog, l.target FROM walk w JOIN links l ON l.handler = w.handler AND l.dog = w.target)
  SELECT handler, dog, target FROM walk w WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.handler = w.handler AND l.dog = w.target)""")
def merge_variants(spark, sf):
    return I.merge_variants(frame(spark, sf, VARIANTS))


LOST = f"""SELECT o_orderkey AS _seq, o_orderpriority AS file, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE 'H' || CAST(o_custkey AS STRING) END AS handler_id,
  CASE o_orderkey % 5 WHEN 0 THEN first || ' ' || last || ' ' || tag WHEN 1 THEN first || ' ' || tag WHEN 2 THEN first || ' ' || last || ' ' || tag || ' dog name' WHEN 3 THEN '' ELSE first || '  ' || tag END AS handler,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'rex ' || CAST(o_custkey % 3 AS STRING) END AS dog, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS start_no
  FROM {{orders}} JOIN ({PEOPLE}) ON k = o_custkey"""


@query(f"""WITH l AS (SELECT * FROM {text(LOST)}), m AS (SELECT file, handler_id, arg_min(trim(handler), (len(string_split({squeeze_sql('handler')}, ' ')), _seq)) AS mapped FROM l
    WHERE handler_id <> '' AND trim(handler) <> '' AND dog <> '' GROUP BY ALL)
  SELECT _seq, file, handler_id, coalesce(mapped, trim(handler)) AS handler, dog, start_no FROM l LEFT JOIN m USING (file, handler_id)""")
def recover_by_id(spark, sf):
    return I.recover_by_id(frame(spark, sf, LOST))


@query(f"""WITH l AS (SELECT * FROM {text(LOST)}), t AS (SELECT *, {sorted_sql('handler')} || '|||' || dog AS key FROM l WHERE handler_id <> '' AND trim(handler) <> '' AND dog <> '' AND start_no <> ''),
  m AS (SELECT file, start_no, arg_max(handler, _seq) AS mh, arg_max(dog, _seq) AS md FROM t GROUP BY ALL HAVING COUNT(DISTINCT key) = 1)
  SELECT _seq, file, handler_id, start_no, CASE WHEN (trim(handler) = '' OR dog = '') AND mh IS NOT NULL THEN mh ELSE handler END AS handler,
    CASE WHEN (trim(handler) = '' OR dog = '') AND mh IS NOT NULL THEN md ELSE dog END AS dog FROM l LEFT JOIN m USING (file, start_no)""")
def recover_by_start_no(spark, sf):
    return I.recover_by_start_no(frame(spark, sf, LOST))


MERGE = "SELECT p_partkey AS source_id, p_partkey - 1 AS target_id FROM {part} WHERE p_partkey % 10 = 5"


def _merged(spark, sf):
    d = frame(spark, sf, ENT).select("id", c("call_name").alias("name"), "size")
    a = frame(spark, sf, EALIAS).withColumn("source", F.lit("Import"))
    return I.merge_entities(d, frame(spark, sf, TEAMS), a, frame(spark, sf, MERGE), "entity_id", same_size=True)


MERGED_SQL = f"""ok AS (SELECT m.* FROM {text(MERGE)} m JOIN {text(ENT)} a ON a.id = source_id JOIN {text(ENT)} b ON b.id = target_id WHERE a.size = b.size)"""


@query(f"""WITH {MERGED_SQL} SELECT team_id, handler_id, coalesce(target_id, entity_id) AS entity_id FROM {text(TEAMS)} LEFT JOIN ok ON source_id = entity_id""")
def merged_teams(spark, sf):
    return _merged(spark, sf)[1]


@query(f"""WITH {MERGED_SQL} SELECT alias_name, coalesce(target_id, canonical_id) AS canonical_id, 'Import' AS source FROM {text(EALIAS)} LEFT JOIN ok ON source_id = canonical_id
  UNION ALL SELECT call_name, target_id, 'Manual' FROM ok JOIN {text(ENT)} ON id = source_id""")
def merged_aliases(spark, sf):
    return _merged(spark, sf)[2]


@query(f"WITH {MERGED_SQL} SELECT id, call_name AS name, size FROM {text(ENT)} WHERE id NOT IN (SELECT source_id FROM ok)")
def merged_entities(spark, sf):
    return _merged(spark, sf)[0]


RES = "SELECT l_suppkey AS run_id, l_partkey AS team_id, l_orderkey * 8 + l_linenumber AS _seq FROM {lineitem}"


@query(f"""WITH t AS (SELECT p_partkey AS team_id, CAST(floor(p_partkey / 2) AS BIGINT) AS keep0 FROM part), m AS (SELECT team_id, MIN(team_id) OVER (PARTITION BY keep0) AS keep FROM t)
  SELECT run_id, keep AS team_id, MIN(_seq) AS _seq FROM {text(RES)} JOIN m USING (team_id) GROUP BY ALL""")
def collapsed_results(spark, sf):
    t = frame(spark, sf, "SELECT p_partkey AS team_id, CAST(floor(p_partkey / 2) AS BIGINT) AS handler_id, 1 AS entity_id FROM {part}")
    return I.collapse_teams(t, frame(spark, sf, RES))[1]


@query("""SELECT 'comps' AS what, COUNT(DISTINCT date_trunc('month', o_orderdate)) - 1 AS n FROM orders
  UNION ALL SELECT 'runs', COUNT(DISTINCT o_orderdate) FROM orders WHERE NOT (year(o_orderdate) = 1996 AND month(o_orderdate) = 5)
  UNION ALL SELECT 'results', COUNT(*) FROM orders WHERE NOT (year(o_orderdate) = 1996 AND month(o_orderdate) = 5)""")
def delete_competition(spark, sf):
    o = frame(spark, sf, "SELECT o_orderkey, o_orderdate, year(o_orderdate) * 100 + month(o_orderdate) AS comp_id FROM {orders}")
    comps = o.select("comp_id", F.concat(F.lit("cup-"), c("comp_id").cast("string")).alias("slug")).distinct()
    runs = o.select("comp_id", c("o_orderdate").alias("run_id")).distinct()
    a, b, r = I.delete_competition("cup-199605", comps, runs, o.select(c("o_orderdate").alias("run_id"), "o_orderkey"))
    count = lambda d, w: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("what"), "n")
    return count(a, "comps").unionByName(count(b, "runs")).unionByName(count(r, "results"))


@query(f"SELECT t.handler_id, t.entity_id, call_name, size FROM {text(TEAMS)} t JOIN {text(ENT)} e ON e.id = t.entity_id")
def entities_of_handler(spark, sf):
    return I.entities_of_handler(frame(spark, sf, TEAMS), frame(spark, sf, ENT).select("id", "call_name", "size"))


@query(f"SELECT t.handler_id, t.entity_id, name, country FROM {text(TEAMS)} t JOIN {text(DIM)} d ON d.id = t.handler_id")
def handlers_of_entity(spark, sf):
    return I.handlers_of_entity(frame(spark, sf, TEAMS), frame(spark, sf, DIM))


@query(f"SELECT e.id, e.call_name AS name, a.alias_name FROM {text(ENT)} e JOIN {text(EALIAS)} a ON a.canonical_id = e.id")
def aliases_of_entity(spark, sf):
    return I.aliases_of(frame(spark, sf, ENT).select("id", c("call_name").alias("name")), frame(spark, sf, EALIAS))


@query(f"SELECT id, name, CASE WHEN id % 2 = 0 THEN 'Z' || id ELSE country END AS country FROM {text(DIM)}")
def update_country(spark, sf):
    d = frame(spark, sf, DIM)
    return I.update_country(d, d.filter("id % 2 = 0").select("id", F.concat(F.lit("Z"), c("id").cast("string")).alias("new_country")))


JRUNS = f"SELECT o_orderkey AS _seq, CASE o_orderkey % 6 WHEN 4 THEN 'Nick ' || tag WHEN 5 THEN tag || ' ' || first || ' ' || last WHEN 0 THEN first || ' ' || last || ' ' || tag WHEN 1 THEN last || ' ' || tag || ', ' || first WHEN 2 THEN 'Judge ' || first || ' ' || last || ' ' || tag ELSE NULL END AS judge FROM {{orders}} JOIN ({PEOPLE}) ON k = o_custkey"


@query(f"""WITH j AS (SELECT judge, MIN(_seq) AS _seq, {norm_sql('judge')} AS norm FROM {text(JRUNS)} WHERE judge IS NOT NULL GROUP BY judge), {DIM_SQL}, {ALIAS_SQL},
  jd AS (SELECT id, norm, COUNT(*) OVER (PARTITION BY norm) AS same FROM dim),
  ct AS (SELECT j._seq, COUNT(*) AS n, MIN(d.id) AS cid FROM j JOIN jd d ON d.norm <> j.norm AND (contains(d.norm, j.norm) OR contains(j.norm, d.norm)) WHERE length(j.norm) >= 10 AND contains(j.norm, ' ') GROUP BY 1),
  st AS (SELECT j.*, al.canonical_id AS aid, e.id AS eid, CASE WHEN ct.n = 1 THEN cid END AS cid FROM j LEFT JOIN alias al ON al.alias_name = j.norm LEFT JOIN jd e ON e.norm = j.norm LEFT JOIN ct ON ct._seq = j._seq),
  fr AS (SELECT norm, row_number() OVER (ORDER BY MIN(_seq)) + (SELECT MAX(id) FROM jd) AS nid FROM st WHERE aid IS NULL AND eid IS NULL AND cid IS NULL GROUP BY norm)
  SELECT judge, norm, CASE WHEN aid IS NOT NULL THEN 'alias' WHEN eid IS NOT NULL THEN 'exact' WHEN cid IS NOT NULL THEN 'containment' ELSE 'new' END AS stage, coalesce(aid, eid, cid, nid) AS judge_id FROM st LEFT JOIN fr USING (norm)""")
def resolve_judges(spark, sf):
    d = dim(spark, sf).select("id", "norm")
    return I.resolve_judges(frame(spark, sf, JRUNS), d, alias(spark, sf))


PROF = f"""SELECT o_orderkey AS _seq, o_custkey * 10 + o_orderkey % 2 AS team, o_custkey AS handler_key, CASE o_orderkey % 6 WHEN 0 THEN first || ' ' || tag WHEN 1 THEN last || ', ' || first WHEN 2 THEN lower(first) || ' ' || tag
    ELSE first || ' ' || last END AS handler, CASE o_orderkey % 5 WHEN 0 THEN 'Rex' WHEN 1 THEN 'Gold of the hill (Rex)' WHEN 2 THEN 'Gold of the high hill "Day"' WHEN 3 THEN 'Day' ELSE 'Silver of the Dale' END AS raw,
  CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 2 = 1 AND o_custkey % 4 = 0 THEN '' ELSE 'N' || CAST(o_orderkey % 5 AS STRING) END AS country FROM {{orders}} JOIN ({PEOPLE}) ON k = o_custkey"""
_sc = "length(regexp_replace(v, '[\\x00-\\x7F]', '', 'g'))"


def _mode(col, out):
    return f"""{out} AS (SELECT team, arg_min(v, (-n, -{_sc}, f)) AS {out} FROM (SELECT team, trim({col}) AS v, COUNT(*) AS n, MIN(_seq) AS f FROM p WHERE trim({col}) <> '' GROUP BY ALL) GROUP BY team)"""


@query(f"""WITH p AS (SELECT * FROM {parsed_entities(text(PROF))}), {_mode('handler', 'mh')}, {_mode('call_name', 'mc')}, {_mode('country', 'mk')},
  cm AS (SELECT team, arg_min(trim(handler), (-length(regexp_replace(handler, '[\\x00-\\x7F]', '', 'g')), _seq)) AS cm FROM p WHERE contains(handler, ',') GROUP BY 1),
  rg AS (SELECT team, arg_min(registered_name, (-length(registered_name), _seq)) AS rg FROM p WHERE registered_name <> '' GROUP BY 1),
  t AS (SELECT team, MIN(handler_key) AS hk, MAX(_seq) AS l FROM p GROUP BY 1),
  f AS (SELECT hk, arg_max(mk, l) AS fill FROM t JOIN mk USING (team) GROUP BY 1)
  SELECT team, coalesce(trim(split_part(cm, ',', 2)) || ' ' || trim(split_part(cm, ',', 1)), mh) AS handler_display, coalesce(mc, '') AS call_name, coalesce(rg, '') AS registered_name,
    CASE WHEN coalesce(rg, '') <> '' AND coalesce(mc, '') <> '' THEN rg || ' (' || upper(mc[1]) || mc[2:] || ')' WHEN coalesce(rg, '') <> '' THEN rg ELSE upper(mc[1]) || mc[2:] END AS entity_display,
    coalesce(mk, fill, '') AS country
  FROM t LEFT JOIN mh USING (team) LEFT JOIN mc USING (team) LEFT JOIN mk USING (team) LEFT JOIN cm USING (team) LEFT JOIN rg USING (team) LEFT JOIN f USING (hk)""")
def team_profiles(spark, sf):
    return I.team_profiles(frame(spark, sf, PROF).withColumnRenamed("raw", "dog"))


@query(f"""SELECT handler_key, arg_min(v, (-n, -{_sc}, f)) AS handler FROM (SELECT handler_key, trim(handler) AS v, COUNT(*) AS n, MIN(_seq) AS f FROM {text(PROF)} WHERE trim(handler) <> '' GROUP BY ALL) GROUP BY 1""")
def most_frequent_value(spark, sf):
    from ladderspark.operators.stats import mode_by

    return mode_by(frame(spark, sf, PROF), ["handler_key"], "handler")
