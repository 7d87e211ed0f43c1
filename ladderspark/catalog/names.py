"""Name functions over customers, parts and whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderspark.catalog.base import query
from ladderspark.catalog.fixtures import (
    ENTITIES, PEOPLE, RAW_NAMES, accents_sql, case_map, frame, norm_sql, q, slug_sql, squeeze_ends, squeeze_sql, swap_sql, text,
)
from ladderspark.functions import names as N
from ladderspark.operators.scan import row_numbers
from ladderspark.plans.contests import table

TITLE = r"(?i)^(A3Ch|Ag\.?\s*Ch\.?|AGCh|MACH\d*|PACH\d*|GCh|C\.A\.C\.T)\s+"
TAG = r"(?i)\s*\((cp|FCI|FCI registration|AKC|KC|UKC|CKC|None)\)\s*$"
IGNORED = "('fci', 'fci registration', 'akc', 'kc', 'ukc', 'ckc', 'cp', 'none')"


def _named(spark, sf, f, src=RAW_NAMES, out="name"):
    d = frame(spark, sf, src)
    return d.select("k", F.md5(f(F.col("raw"))).alias(out))


@query(f"SELECT k, md5({norm_sql('raw')}) AS name FROM {text(RAW_NAMES)}")
def normalize_name(spark, sf):
    return _named(spark, sf, N.normalize_name)


@query(f"SELECT k, md5(CASE WHEN {squeeze_sql('raw')} = '' THEN raw ELSE {squeeze_sql(swap_sql(squeeze_ends('raw')))} END) AS name FROM {text(RAW_NAMES)}")
def clean_display_name(spark, sf):
    return _named(spark, sf, N.clean_display_name)


def sorted_sql(x):
    t = squeeze_sql(f"regexp_replace(lower({accents_sql(x)}), '^([^,]*),', '\\1 ')")
    key = f"array_to_string(list_sort(string_split({t}, ' ')), ' ')"
    return f"CASE {key} WHEN 'katka tercova' THEN 'katerina tercova' WHEN 'adrian alonso bajo' THEN 'adrian bajo' ELSE {key} END"


@query(f"SELECT k, md5({sorted_sql('raw')}) AS name FROM {text(RAW_NAMES)}")
def sorted_token_key(spark, sf):
    return _named(spark, sf, N.sorted_token_key)


def keep(x, stripped):
    return f"CASE WHEN length({stripped}) > 0 THEN {stripped} ELSE {squeeze_ends(x)} END"


def title_sql(x):
    return keep(x, f"regexp_replace({squeeze_ends(x)}, '{TITLE}', '')")


def tag_sql(x):
    return keep(x, f"regexp_replace({squeeze_ends(x)}, '{TAG}', '')")


def entity_sql(x):
    return squeeze_sql(tag_sql(title_sql(x)))


@query(f"SELECT k, {title_sql('raw')} AS without_title, {tag_sql('raw')} AS without_tag, {entity_sql('raw')} AS cleaned FROM {text(ENTITIES)}")
def clean_entity_name(spark, sf):
    d, c = frame(spark, sf, ENTITIES), F.col("raw")
    return d.select("k", N.strip_titles(c).alias("without_title"), N.strip_suffixes(c).alias("without_tag"),
                    N.clean_entity_name(c).alias("cleaned"))


CALLS = f"""SELECT k, raw, squeezed,
    trim(regexp_extract(squeezed, '"([^"]+)"\\s*$', 1)) AS qc,
    nullif(trim(rtrim(trim(regexp_replace(squeezed, '"[^"]+"\\s*$', '')), '"')), '') AS qr,
    trim(regexp_extract(squeezed, '\\(([^()]+)\\)\\s*$', 1)) AS pc,
    nullif(trim(regexp_replace(squeezed, '\\([^()]+\\)\\s*$', '')), '') AS pr
  FROM (SELECT k, raw, {squeeze_ends('raw')} AS squeezed FROM {text(ENTITIES)})"""
CALL_OK = f"length(qc) >= 2 AND lower(qc) NOT IN {IGNORED}"
PAREN_OK = f"length(pc) >= 2 AND lower(pc) NOT IN {IGNORED} AND NOT starts_with(lower(pc), 'fci')"


@query(f"""SELECT k, CASE WHEN {CALL_OK} THEN qc WHEN {PAREN_OK} THEN pc END AS call_name,
  CASE WHEN {CALL_OK} THEN qr WHEN {PAREN_OK} THEN pr END AS registered_name FROM ({CALLS})""")
def extract_call_name(spark, sf):
    return frame(spark, sf, ENTITIES).select("k", N.extract_call_name(F.col("raw")).alias("s")).select("k", "s.*")


def parsed_entities(src: str, raw: str = "raw") -> str:
    """DuckDB subquery with call_name and registered_name of the batch-job rules."""
    reg = lambda x: f"(SELECT {case_map('v', N.REGISTERED_ALIASES, 'v')} FROM (SELECT {squeeze_sql(f'lower({x})')} AS v))"
    words = lambda x: f"len(string_split({x}, ' '))"
    alias = lambda x: case_map(x, N.CALL_ALIASES, x)
    return f"""(SELECT * EXCLUDE (t, pc, pr, t1, qc, qr, t2, r0, r1, r2, hp, hq),
      CASE WHEN hp THEN {alias('pc')} WHEN hq THEN {alias('qc')} WHEN {words('r2')} <= 2 THEN r2
        ELSE {case_map('r2', N.REGISTERED_TO_CALL, "''")} END AS call_name,
      CASE WHEN hp THEN CASE WHEN {words('r0')} > 2 THEN r0 ELSE '' END WHEN hq THEN CASE WHEN {words('r1')} > 2 THEN r1 ELSE '' END
        WHEN {words('r2')} <= 2 THEN '' ELSE r2 END AS registered_name
    FROM (SELECT *, {reg('pr')} AS r0, {reg('qr')} AS r1, {alias(reg('t2'))} AS r2,
        regexp_matches(t, '\\([^)]+\\)\\s*$') AND pc <> 'cp' AS hp, regexp_matches(t1, '"[^"]+"\\s*$') AND qc <> 'cp' AS hq
      FROM (SELECT *, CASE WHEN qc = 'cp' THEN qr ELSE t1 END AS t2 FROM
        (SELECT *, lower(trim(regexp_extract(t1, '"([^"]+)"\\s*$', 1))) AS qc, trim(regexp_replace(t1, '"[^"]+"\\s*$', '')) AS qr FROM
          (SELECT *, CASE WHEN pc = 'cp' THEN pr ELSE t END AS t1 FROM
            (SELECT *, lower(trim(regexp_extract(t, '\\(([^)]+)\\)\\s*$', 1))) AS pc, trim(regexp_replace(t, '\\([^)]+\\)\\s*$', '')) AS pr FROM
              (SELECT *, translate({squeeze_ends(accents_sql(raw))}, '“”‘’', '""''''') AS t FROM {src})))))))"""


@query(f"SELECT k, call_name, registered_name FROM {parsed_entities(text(ENTITIES))}")
def parse_entity_name(spark, sf):
    return frame(spark, sf, ENTITIES).select("k", N.parse_entity_name(F.col("raw")).alias("s")).select("k", "s.*")


PAIRS = f"""SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN first || ' ' || last || ' ' || tag WHEN 1 THEN last || ' ' || tag || ', ' || first
    ELSE tag || ' ' || first || ' ' || last END AS handler, p_name || CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' of the ring (Day)'
    WHEN 2 THEN ' von und zu' ELSE ' "Rex"' END AS raw
  FROM {{orders}} JOIN ({PEOPLE}) ON k = o_custkey JOIN {{part}} ON p_partkey = o_custkey"""


@query(f"""SELECT k, {sorted_sql('handler')} || '|||' || CASE WHEN call_name <> '' THEN call_name ELSE registered_name END AS team
  FROM {parsed_entities(text(PAIRS))}""")
def identity_key(spark, sf):
    return frame(spark, sf, PAIRS).select("k", N.identity_key(F.col("handler"), F.col("raw")).alias("team"))


BLOBS = f"""SELECT k, CASE k % 5 WHEN 0 THEN first || ' ' || last || ' (Day) (Rex!)' WHEN 1 THEN first || ' (' || last || ' two'
    WHEN 2 THEN first || ' (one two three four)' WHEN 3 THEN first || ' ' || last ELSE first || ' (' || first || ' O’Neil)  ' END AS raw FROM ({PEOPLE})"""


@query(f"""SELECT k, CASE WHEN len(string_split(t, ' ')) <= 3 THEN t ELSE '' END AS call_name FROM (SELECT k,
    {squeeze_sql("regexp_replace(CASE WHEN len(g) > 0 THEN g[-1] ELSE tail END, '[^\\pL\\pN_\\s''’-]', '', 'g')")} AS t
  FROM (SELECT k, regexp_extract_all(raw, '\\(([^)]+)\\)', 1) AS g, regexp_extract(raw, '\\(([^()]*)\\s*$', 1) AS tail FROM {text(BLOBS)}))""")
def call_name_from_blob(spark, sf):
    return frame(spark, sf, BLOBS).select("k", N.call_name_from_blob(F.col("raw")).alias("call_name"))


@query(f"SELECT k, md5({slug_sql('raw')}) AS name FROM {text(RAW_NAMES)}")
def slugify(spark, sf):
    return _named(spark, sf, N.slugify)


ROT = f"SELECT k, CASE k % 4 WHEN 0 THEN first WHEN 1 THEN first || ' ' || tag WHEN 2 THEN first || ' ' || last || ' ' || tag ELSE '' END AS name FROM ({PEOPLE})"


@query(f"""SELECT k, rotation FROM (SELECT k, unnest(CASE WHEN n < 2 THEN [] WHEN n = 2 THEN [p[2] || ' ' || p[1]] ELSE
    [array_to_string(list_prepend(p[n], p[1:n-1]), ' '), array_to_string(list_append(p[2:n], p[1]), ' ')] END) AS rotation
  FROM (SELECT k, p, len(p) AS n FROM (SELECT k, [w for w in string_split(name, ' ') if w <> ''] AS p FROM {text(ROT)})))""")
def name_rotations(spark, sf):
    return frame(spark, sf, ROT).select("k", F.explode(N.name_rotations(F.col("name"))).alias("rotation"))


CONTAIN = """SELECT a.p_partkey AS k, CASE a.p_partkey % 5 WHEN 0 THEN a.p_name WHEN 1 THEN substr(a.p_name, 2, 4) WHEN 2 THEN split_part(a.p_name, ' ', 1)
    WHEN 3 THEN 'ab' ELSE split_part(a.p_name, ' ', 2) END AS x, a.p_name || ' (' || b.p_name || ') ab' AS y
  FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1"""


@query(f"""SELECT k, lower(x) <> lower(y) AND length(x) >= 3 AND regexp_matches(lower(y), '(^|[^\\pL\\pN_])' || lower(x) || '($|[^\\pL\\pN_])') AS hit FROM {text(CONTAIN)}""")
def word_contained(spark, sf):
    return frame(spark, sf, CONTAIN).select("k", N.word_contained(F.col("x"), F.col("y")).alias("hit"))


SIZE_PAIRS = """SELECT l_orderkey * 8 + l_linenumber AS k, CASE l_orderkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'I' ELSE 'L' END AS a,
  CASE l_partkey % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'M' WHEN 2 THEN 'I' ELSE 'L' END AS b FROM {lineitem}"""


@query(f"SELECT a, b, (a = b OR a || b IN ('SM', 'MS', 'IL', 'LI')) AS ok, COUNT(*) AS n FROM {text(SIZE_PAIRS)} GROUP BY ALL")
def size_compatible(spark, sf):
    d = frame(spark, sf, SIZE_PAIRS)
    return d.groupBy("a", "b", N.size_compatible(F.col("a"), F.col("b")).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


OVERLAP = """SELECT p_partkey AS k, p_name || ' of gold ' || p_type AS x, CASE p_partkey % 6 WHEN 0 THEN p_name || ' of silver' WHEN 1 THEN 'a3ch ' || p_name || ' of x'
    WHEN 2 THEN 'a b ' || p_name || ' of' WHEN 3 THEN 'a b c ' || p_name || ' of' WHEN 4 THEN split_part(p_name, ' ', 2) || ' of gold' ELSE p_name END AS y FROM {part}"""


def _overlap_sql(x, y):
    hits = [f"({x}[{i + 1}:{i + 3}] = {y}[1:3] AND len({y}[1:3]) = 3)" for i in range(3)]
    hits += [f"({x}[1:3] = {y}[{i + 1}:{i + 3}] AND len({x}[1:3]) = 3)" for i in (1, 2)]
    return " OR ".join(hits)


@query(f"SELECT k, ({_overlap_sql('a', 'b')}) AS hit FROM (SELECT k, string_split(x, ' ') AS a, string_split(y, ' ') AS b FROM {text(OVERLAP)})")
def prefix_overlap(spark, sf):
    return frame(spark, sf, OVERLAP).select("k", N.prefix_overlap(F.col("x"), F.col("y")).alias("hit"))


SPLIT = f"SELECT k, CASE k % 3 WHEN 0 THEN first || ' & ' || tag WHEN 1 THEN first || ' & ' || tag || ' & ' || last ELSE ' ' || first || ' ' END AS raw FROM ({PEOPLE})"


@query(f"""SELECT k, CASE WHEN i > 0 THEN trim(substr(t, 1, i - 1)) ELSE t END AS handler, CASE WHEN i > 0 THEN trim(substr(t, i + 3)) ELSE '' END AS entity
  FROM (SELECT k, trim(raw) AS t, strpos(trim(raw), ' & ') AS i FROM {text(SPLIT)})""")
def split_pair(spark, sf):
    return frame(spark, sf, SPLIT).select("k", N.split_pair(F.col("raw")).alias("s")).select("k", "s.*")


KEYS = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'ind_agility_' END || CAST(o_orderkey % 120 AS STRING) || '_large_' || CAST(o_custkey % 15 AS STRING) AS label FROM {orders}"
NATURAL = """array_to_string([CASE WHEN regexp_matches(x, '^\\d') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END
  for x in CASE WHEN regexp_matches(label, '^\\d') THEN list_prepend('', regexp_extract_all(label, '\\d+|\\D+')) ELSE regexp_extract_all(label, '\\d+|\\D+') END], chr(1))"""


@query(f"SELECT label, dense_rank() OVER (ORDER BY {NATURAL}) AS pos FROM {text(KEYS)} GROUP BY label")
def natural_order(spark, sf):
    keys = frame(spark, sf, KEYS).select("label").distinct().withColumn("_key", N.natural_key(F.col("label")))
    places = row_numbers(keys.select("_key").distinct(), [], [F.col("_key")], "pos")
    return keys.join(places, "_key").select("label", F.col("pos").cast("bigint").alias("pos"))


@query("""SELECT o_orderpriority AS label, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END AS pos, COUNT(*) AS n
  FROM orders GROUP BY ALL""")
def label_order(spark, sf):
    pos = N.label_order(F.col("label"), ["1-URGENT", "5-LOW", "2-HIGH"]).cast("int")
    d = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "label")
    return d.groupBy("label", pos.alias("pos")).agg(F.count(F.lit(1)).alias("n"))


SHOW = f"""SELECT k, first, last, CASE WHEN k % 3 = 0 THEN '' ELSE tag END AS call_name, CASE WHEN k % 4 = 0 THEN '' ELSE first || ' of ' || last END AS reg FROM ({PEOPLE})"""


@query(f"""SELECT k, CASE WHEN reg <> '' AND call_name <> '' THEN reg || ' (' || call_name || ')' WHEN reg <> '' THEN reg ELSE call_name END AS entity,
  first || ' & ' || call_name AS pair, upper(array_to_string([w[1] for w in string_split(first || ' ' || last, ' ') if w <> ''], '')) AS initials FROM {text(SHOW)}""")
def display_strings(spark, sf):
    c = F.col
    return frame(spark, sf, SHOW).select(
        "k", N.entity_display(c("call_name"), c("reg")).alias("entity"), N.pair_display(c("first"), c("call_name")).alias("pair"),
        N.initials(F.concat(c("first"), F.lit(" "), c("last"))).alias("initials"))


@query(f"""SELECT k, CAST(length(regexp_replace(raw, '[\\x00-\\x7F]', '', 'g')) AS INTEGER) AS score FROM {text(RAW_NAMES)}""")
def diacritics_score(spark, sf):
    return frame(spark, sf, RAW_NAMES).select("k", N.diacritics_score(F.col("raw")).alias("score"))


@query(f"SELECT p_partkey AS k, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') AS shown FROM part")
def display_case(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), N.display_case(F.col("p_name")).alias("shown"))
