"""Readers, writers, flatteners, source mapping and import over data derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderspark.catalog.base import query, with_board
from ladderspark.catalog.fixtures import PEOPLE, case_map, frame, norm_sql, squeeze_ends, text
from ladderspark.config import RatingConfig
from ladderspark.functions import values as V
from ladderspark.functions.names import normalize_name
from ladderspark.operators import stats as S
from ladderspark.operators.scan import parts_for, spread
from ladderspark.plans.contests import results, table
from ladderspark.plans.normalize import normalize_source
from ladderspark.schema import CANONICAL, LEADERBOARD, strings
from ladderspark.sources import csv_files as C
from ladderspark.sources import nested as J
from ladderspark.sources import pages as H
from ladderspark.storage import input_bytes, new_path, overwrite_table

c = F.col
CFG = RatingConfig()

# -------------------------------------------------------------- files

FILES = f"""SELECT o_orderkey AS k, o_orderpriority AS grp, 'ind_agility_' || CAST(o_custkey % 5 AS STRING) AS round_key, first || ', ' || last AS handler, ' Rex ' AS dog, 'N' || CAST(nk AS STRING) AS country,
  CAST(o_orderkey % 30 AS STRING) AS rank, CASE WHEN o_orderkey % 6 = 0 THEN 'True' ELSE 'False' END AS eliminated FROM {{orders}} JOIN ({PEOPLE}) ON k = o_custkey"""


@query(f"SELECT round_key, handler, trim(dog) AS dog, country, rank, CASE WHEN grp = '1-URGENT' THEN NULL ELSE eliminated END AS eliminated, CASE WHEN grp = '1-URGENT' THEN 'a' ELSE 'b' END AS source FROM {text(FILES)}")
def read_results_csv(spark, sf):
    d = frame(spark, sf, FILES)
    root = new_path(spark, "csv")
    urgent = d.filter("grp = '1-URGENT'").select(c("handler").alias("Handler_Name"), "country", c("dog").alias("DOG"), "rank", c("round_key").alias("Round_Key"))
    urgent.write.option("header", True).csv(f"{root}/a")
    d.filter("grp <> '1-URGENT'").select("round_key", "handler", "dog", "country", "rank", "eliminated").write.option("header", True).csv(f"{root}/b")
    got = C.read_results_csv(spark, f"{root}/*/*.csv")
    return got.select("round_key", "handler", "dog", "country", "rank", "eliminated", "source")


@query("""SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'target' WHEN '2-HIGH' THEN 'kacr' WHEN '3-MEDIUM' THEN 'agigames' ELSE 'unknown' END AS fmt, COUNT(*) AS n FROM orders GROUP BY 1""")
def detect_format(spark, sf):
    """Orders are written to files with the headers of the formats; the lines of each file count for its format."""
    heads = {"1-URGENT": CANONICAL[:5], "2-HIGH": ["competition_id", "Run_ID", "run_description"], "3-MEDIUM": ["size_class", "bid", "RUN_DESCRIPTION"]}
    root, orders = new_path(spark, "formats"), table(spark, sf, "orders")
    for label in (*heads, None):
        some = orders.filter(c("o_orderpriority") == label if label else ~c("o_orderpriority").isin(*heads))
        names = heads.get(label, ["Round", "Name", "Pet"])
        some.select(*[F.concat(F.lit(n + " "), c("o_orderkey").cast("string")).alias(n) for n in names]).write.option("header", True).csv(f"{root}/{(label or 'other')[:1]}")
    lines = C.numbered_lines(spark, f"{root}/*/*.csv")
    fmt = C.headers(lines).select("file", C.format_of(c("names")).alias("fmt"))
    return lines.filter("line > 1").join(fmt, "file").groupBy("fmt").agg(F.count(F.lit(1)).alias("n"))


def _board(spark, sf):
    from ladderspark.catalog.boards import team_board

    return team_board(spark, sf).join(spread(S.last_competition(results(spark, sf)).select("team_id", "last_comp")), "team_id", "left")


@query(with_board("""SELECT row_number() OVER (PARTITION BY size_group ORDER BY rating DESC, team_id) AS rank, handler, size_group AS size, country, tier, run_count AS num_runs, last_comp AS last_competition,
    round(mu, 4) AS mu, round(sigma, 4) AS sigma, round(rating, 1) AS rating, round(finished_run_count * 100.0::DOUBLE / run_count, 1) AS finished_pct, round(top3_run_count * 100.0::DOUBLE / run_count, 1) AS top3_pct
  FROM board JOIN (SELECT team_id, arg_max(comp_name, run_id) AS last_comp FROM results GROUP BY 1) USING (team_id) WHERE run_count >= 5"""))
def write_leaderboard(spark, sf):
    path = new_path(spark, "leaderboard")
    C.write_leaderboard(_board(spark, sf), CFG, path)
    d = spark.read.schema(strings(LEADERBOARD)).option("header", True).csv(path)
    return d.select(c("rank").cast("bigint").alias("rank"), "handler", "size", "country", "tier", c("num_runs").cast("bigint").alias("num_runs"), "last_competition",
                    *[c(n).cast("double").alias(n) for n in ("mu", "sigma", "rating", "finished_pct", "top3_pct")])


CANON = f"""SELECT k AS _seq, 'f' || grp AS file, 'Cup ' || grp AS competition, round_key, CASE k % 4 WHEN 0 THEN 'S' WHEN 1 THEN 'Inter' WHEN 2 THEN 'large' ELSE 'XS' END AS size, CASE k % 3 WHEN 0 THEN 'A1' WHEN 1 THEN 'JUMPING' ELSE 'Final' END AS discipline,
  CASE WHEN k % 2 = 0 THEN 'true' ELSE 'no' END AS is_team_round, CASE WHEN k % 7 = 0 THEN '' ELSE rank END AS rank, '' AS start_no, handler, dog, '' AS breed, CASE k % 3 WHEN 0 THEN 'cz' WHEN 1 THEN 'Norway' ELSE 'AUT' END AS country,
  CASE WHEN k % 11 = 0 THEN 'dnf' ELSE '0' END AS faults, '0' AS refusals, '' AS time_faults, '0' AS total_faults, CASE WHEN k % 14 = 0 THEN '' ELSE '33.3' END AS time, '' AS speed, eliminated,
  'J' || CAST(k % 2 AS STRING) AS judge, '45' AS sct, '60' AS mct, '180' AS course_length FROM ({FILES})"""


def _target_sql(src):
    out = "(eliminated = 'True' OR (rank = '' AND time = '') OR upper(faults) = 'DNF')"
    return f"""n0 AS (SELECT *, {out} AS o, {case_map('size', V.SIZES, 'size')} AS sz, {case_map('discipline', V.DISCIPLINES, 'discipline')} AS di FROM {src}),
      n1 AS (SELECT *, 'ind_' || lower(di) || '_' || lower(sz) AS rk, judge || '|45|60' AS sig FROM n0),
      n2 AS (SELECT *, COUNT(*) OVER (PARTITION BY file, rk) AS c FROM n1),
      n3 AS (SELECT file, rk, sig, row_number() OVER (PARTITION BY file, rk ORDER BY MIN(_seq)) AS no, COUNT(*) OVER (PARTITION BY file, rk) AS n FROM n2 GROUP BY file, rk, sig),
      n4 AS (SELECT n2.*, CASE WHEN n > 1 THEN rk || '_' || no ELSE rk END AS key FROM n2 JOIN n3 USING (file, rk, sig))"""


@query(f"""WITH {_target_sql(text(CANON))} SELECT _seq, key AS round_key, sz AS size, di AS discipline, CASE WHEN is_team_round = 'true' THEN 'True' ELSE 'False' END AS is_team_round, CASE WHEN NOT o THEN rank END AS rank,
  CASE WHEN NOT o THEN time END AS time, CASE WHEN o THEN 'True' ELSE 'False' END AS eliminated, CASE country WHEN 'cz' THEN 'CZE' WHEN 'Norway' THEN 'NOR' ELSE country END AS country FROM n4""")
def normalized_sources(spark, sf):
    d = normalize_source(frame(spark, sf, CANON), "target")
    return d.select("_seq", "round_key", "size", "discipline", "is_team_round", "rank", "time", "eliminated", "country")


KACR = f"""SELECT k AS _seq, 'f' || grp AS file, 'Cup' AS competition, CASE k % 5 WHEN 0 THEN 'Agility ' || CAST(k % 3 AS STRING) || ' IA1 & IA2' WHEN 1 THEN 'GRAND FINAL L' WHEN 2 THEN 'Warm up L' WHEN 3 THEN 'Jumping Team XS & S' ELSE 'Training' END AS run_description,
  CASE WHEN k % 6 = 0 THEN 'DIS' ELSE '' END AS status, rank, CAST(k % 900 AS STRING) AS prukaz, handler, dog, '1' AS chb, '0' AS odm, '0.5' AS tb_time, '5.5' AS tb_total, '30.1' AS time, '4.5' AS speed, 'J' || CAST(k % 3 AS STRING) AS judge,
  '40' AS standard_time, '60' AS max_time, '170' AS course_length FROM ({FILES})"""
_split = """n3 AS (SELECT file, rk, judge, row_number() OVER (PARTITION BY file, rk ORDER BY MIN(_seq)) AS no, COUNT(*) OVER (PARTITION BY file, rk) AS n FROM n1 GROUP BY file, rk, judge),
  n4 AS (SELECT n1.*, CASE WHEN n > 1 THEN rk || '_' || no ELSE rk END AS key FROM n1 JOIN n3 USING (file, rk, judge))"""


@query(f"""WITH n1 AS (SELECT *, CASE _seq % 5 WHEN 0 THEN 'ind_agility_intermediate' WHEN 1 THEN 'ind_final_large' ELSE 'team_jumping_small_ind' END AS rk FROM {text(KACR)} WHERE _seq % 5 IN (0, 1, 3)), {_split}
  SELECT _seq, key AS round_key, CASE WHEN status = 'DIS' THEN NULL ELSE rank END AS rank, CASE WHEN status = 'DIS' THEN NULL ELSE '0.5' END AS time_faults, CASE WHEN status = 'DIS' THEN 'True' ELSE 'False' END AS eliminated, prukaz AS start_no FROM n4""")
def normalized_numbered_source(spark, sf):
    d = normalize_source(frame(spark, sf, KACR), "kacr")
    return d.select("_seq", "round_key", "rank", "time_faults", "eliminated", "start_no")


GAMES = f"""SELECT k AS _seq, 'f' || grp AS file, 'Cup' AS competition, CASE k % 5 WHEN 0 THEN 'Agility Individual M by Kennel' WHEN 1 THEN 'Final Team Relay L' WHEN 2 THEN 'Jumping Team XX' WHEN 3 THEN 'Other' ELSE 'Jumping Individual Open' END AS run_description,
  CASE k % 2 WHEN 0 THEN 'I A3' ELSE 'S' END AS size_class, CASE WHEN k % 6 = 0 THEN '-' ELSE '' END AS status, rank, CAST(k % 900 AS STRING) AS start_num, CASE WHEN k % 13 = 0 THEN '[walk]' ELSE handler END AS handler, dog, 'cz' AS country,
  CAST(k % 3 AS STRING) AS chb, '1' AS odm, CASE WHEN k % 9 = 0 THEN '' ELSE CAST(k % 3 * 5 + k % 8 AS STRING) || '.25' END AS tb_total, '30.1' AS time, '4.5' AS speed, 'J' || CAST(k % 3 AS STRING) AS judge,
  '40' AS standard_time, '60' AS max_time, '170' AS course_length FROM ({FILES})"""


@query(f"""WITH n1 AS (SELECT *, CASE _seq % 5 WHEN 0 THEN 'Medium' WHEN 1 THEN 'Large' ELSE CASE WHEN _seq % 2 = 0 THEN 'Intermediate' ELSE 'Small' END END AS sz,
    CASE _seq % 5 WHEN 0 THEN 'ind_agility_medium' WHEN 1 THEN 'team_final_large_ind' WHEN 2 THEN CASE WHEN _seq % 2 = 0 THEN 'team_jumping_intermediate_ind' ELSE 'team_jumping_small_ind' END
    ELSE CASE WHEN _seq % 2 = 0 THEN 'ind_jumping_intermediate' ELSE 'ind_jumping_small' END END AS rk FROM {text(GAMES)} WHERE _seq % 5 <> 3 AND _seq % 13 <> 0), {_split}
  SELECT _seq, key AS round_key, sz AS size, CASE WHEN status = '-' OR tb_total = '' THEN NULL ELSE CAST(greatest(round(try_cast(tb_total AS DOUBLE) - CAST(chb AS INTEGER) * 5 - 5, 2), 0) AS DOUBLE) END AS late, 'CZE' AS country FROM n4""")
def normalized_sponsored_source(spark, sf):
    d = normalize_source(frame(spark, sf, GAMES), "agigames")
    return d.select("_seq", "round_key", "size", c("time_faults").cast("double").alias("late"), "country")


@query(f"SELECT _seq, competition, round_key, trim(handler) AS handler, nullif(rank, '') AS rank FROM {text(CANON)}")
def write_canonical(spark, sf):
    path = new_path(spark, "canonical")
    C.write_canonical(frame(spark, sf, CANON).withColumn("mct", c("_seq").cast("string")), path)
    d = spark.read.option("header", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return d.select(c("mct").cast("bigint").alias("_seq"), "competition", "round_key", "handler", "rank")


@query("SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def overwrite_table_query(spark, sf):
    d = table(spark, sf, "lineitem").select("l_returnflag", "l_quantity")
    path = new_path(spark, "replaced")
    first = overwrite_table(d, path)
    return overwrite_table(first.filter("l_returnflag <> 'R'"), path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT round_key, handler, dog, country, rank, NULL AS breed FROM {text(FILES)} UNION ALL SELECT NULL, c_name, NULL, NULL, NULL, c_mktsegment FROM customer")
def union_sources(spark, sf):
    a = frame(spark, sf, FILES).select("round_key", "handler", "dog", "country", "rank")
    b = table(spark, sf, "customer").select(c("c_name").alias("handler"), c("c_mktsegment").alias("breed"))
    return J.union_sources(a, b)


# -------------------------------------------------------------- nested JSON, wide tables, list texts

def _by_order(spark, sf, line):
    """Lines dealt by order, in parts of a bounded size whose number stays: work on JSON is slow for its bytes."""
    return line.repartition(parts_for(spark, input_bytes(spark, f"{sf}/lineitem.parquet")), "l_orderkey")


REC = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_returnflag FROM {lineitem}"""


@query("""SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS start_no, 'H' || l_suppkey AS handler, CASE WHEN l_linenumber % 2 = 0 THEN 'Reg' ELSE 'Call' END AS dog, l_quantity AS faults, l_discount AS time_faults,
  l_returnflag = 'R' OR (l_linenumber = 7 AND l_returnflag = 'A') AS eliminated, CASE WHEN l_returnflag <> 'R' AND l_linenumber < 7 THEN CAST(l_linenumber AS BIGINT) END AS rank, 40.5::DOUBLE AS sct FROM lineitem""")
def flatten_results_json(spark, sf):
    d = table(spark, sf, "lineitem")
    s = lambda x: x.cast("string")
    # A rank of zero means none; "R" lines carry a note code, "A" lines a note without code.
    note = F.when(c("l_returnflag") == "R", "hyl").when((c("l_returnflag") == "A") & (c("l_linenumber") == 7), "x").otherwise("")
    r = F.struct(s(c("l_partkey")).alias("numero"), F.concat(F.lit(" H"), s(c("l_suppkey"))).alias("ohjaaja"), F.when(c("l_linenumber") % 2 == 0, "Reg").otherwise("").alias("virallinenNimi"),
                 F.lit("Call").alias("kutsumanimi"), F.lit("").alias("rotunimi"), s(c("l_quantity")).alias("ratavirhe"), F.lit("0").alias("kieltovirheita"), F.replace(s(c("l_discount")), F.lit("."), F.lit(",")).alias("aikavirhe"),
                 F.lit("").alias("tulos"), F.lit("31,5").alias("suoritusaika"), F.lit("4,1").alias("nopeus"), s(F.when(c("l_linenumber") == 7, 0).otherwise(c("l_linenumber"))).alias("sijoitus"), note.alias("muuta"))
    # Dealt by document first: the short lines are sent, not the lists made of them.
    docs = _by_order(spark, sf, d).groupBy("l_orderkey").agg(F.to_json(F.struct(F.lit("Judge").alias("tuomari"), F.lit("40,5").alias("ihanneaika"), F.lit("60").alias("enimmaisaika"), F.lit("180").alias("pituus"), F.collect_list(r).alias("tulokset"))).alias("json"))
    out = J.flatten_results_json(docs)
    return out.select("l_orderkey", "start_no", "handler", "dog", "faults", "time_faults", "eliminated", "rank", "sct")


@query("""SELECT l_orderkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, l_linenumber) - 1 AS list_no, 'Run ' || l_linenumber % 2 AS run_name, 'L' || l_linenumber AS size, CAST(l_partkey AS VARCHAR) AS start_no,
  CASE WHEN l_returnflag = 'N' THEN CAST(l_linenumber AS INTEGER) END AS rank, l_returnflag <> 'N' AS eliminated, l_quantity AS faults FROM lineitem""")
def flatten_runs_json(spark, sf):
    d = table(spark, sf, "lineitem")
    rec = F.struct((c("l_returnflag") == "R").alias("dis"), F.lit(False).alias("not_running"), (c("l_returnflag") != "A").alias("ended"), c("l_linenumber").alias("rank"), (c("l_quantity") + 30).alias("time"),
                   c("l_partkey").cast("string").alias("starting_number"), F.lit("h").alias("handler"), F.lit("d").alias("dog"), F.lit("CZ").alias("country"), c("l_quantity").alias("faults"), F.lit(0.0).alias("refusal"), F.lit(5.0).alias("penalty_points"))
    lists = d.groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(rec).alias("records"))
    sl = F.struct(c("l_linenumber").cast("bigint").alias("id"), F.concat(F.lit("L"), c("l_linenumber").cast("string")).alias("name"), F.lit(45.0).alias("standard_time"), F.lit(60.0).alias("max_time"), F.lit(180.0).alias("course_length"), "records")
    runs = lists.groupBy("l_orderkey", (c("l_linenumber") % 2).alias("run")).agg(F.collect_list(sl).alias("starting_lists"))
    run = F.struct(c("run").cast("bigint").alias("id"), F.concat(F.lit("Run "), c("run").cast("string")).alias("name"), F.lit("a").alias("run_type"), F.lit("J").alias("judge"), "starting_lists")
    docs = runs.groupBy("l_orderkey").agg(F.to_json(F.struct(F.collect_list(run).alias("runs"))).alias("json"))
    return J.flatten_runs_json(docs).select("l_orderkey", c("list_no").cast("bigint").alias("list_no"), "run_name", "size", "start_no", "rank", "eliminated", "faults")


KEYED = "CASE l_linenumber WHEN 1 THEN 'A-KL1-B-S-x-y' WHEN 2 THEN 'H-KL3-Q-XL-x-y' WHEN 3 THEN 'FA-X-A-L-x-y' WHEN 4 THEN 'bad-key' WHEN 5 THEN 'A-KL1-A-ZZ-x-y' WHEN 6 THEN 'A-X-C-M-x-y' ELSE 'H-KL2-A-XS-x-y' END"


@query(f"""SELECT l_orderkey, key AS class_key, entry_key, CASE key[1] WHEN 'H' THEN 'Jumping' WHEN 'F' THEN 'Final' ELSE 'Agility' END AS discipline,
  CASE l_linenumber WHEN 1 THEN 'ind_agility_small_kl1_2' WHEN 2 THEN 'ind_jumping_large_kl3_Q' WHEN 3 THEN 'ind_final_intermediate' WHEN 6 THEN 'ind_agility_medium_3' ELSE 'ind_jumping_small_kl2_1' END AS round_key,
  CASE WHEN NOT o THEN place END AS rank, o AS eliminated, q AS faults
  FROM (SELECT l_orderkey, l_linenumber, {KEYED} AS key, CAST(l_partkey * 100000 + l_suppkey AS VARCHAR) AS entry_key, MIN(CASE WHEN l_quantity > 45 THEN 999 ELSE CAST(l_quantity AS BIGINT) END) AS place, bool_or(l_returnflag = 'R' OR l_quantity > 45) AS o, MIN(l_quantity) AS q
    FROM lineitem GROUP BY ALL) WHERE l_linenumber NOT IN (4, 5)""")
def flatten_keyed_json(spark, sf):
    d = _by_order(spark, sf, table(spark, sf, "lineitem")).withColumn("k1", F.expr(KEYED)).withColumn("k2", (c("l_partkey") * 100000 + c("l_suppkey")).cast("string"))
    # Dealt by document once, which does for all three groupings.
    d = d.groupBy("l_orderkey", "k1", "k2").agg(F.min(F.when(c("l_quantity") > 45, 999).otherwise(c("l_quantity").cast("bigint"))).alias("place"), F.max(c("l_returnflag") == "R").alias("dnf"), F.min("l_quantity").alias("q"),
                                                F.max(c("l_quantity") > 45).alias("dns"))
    run = F.struct(c("place").cast("string").alias("placement"), "dnf", "dns", F.lit("7").alias("tri"), F.lit("h").alias("handlerName"), F.lit("d").alias("dogName"), c("q").cast("string").alias("faults"),
                   F.lit("0").alias("halts"), F.lit("0").alias("timeFault"), F.lit("5").alias("sum"), F.lit("30,1").alias("time"))
    inner = d.groupBy("l_orderkey", "k1").agg(F.map_from_entries(F.collect_list(F.struct("k2", run.alias("r")))).alias("runs"))
    docs = inner.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k1", "runs")))).alias("json"))
    return J.flatten_keyed_json(docs).select("l_orderkey", "class_key", "entry_key", "discipline", "round_key", "rank", "eliminated", "faults")


@query("""SELECT l_orderkey, l_linenumber, run, time, penalty, penalty >= 100 OR time IS NULL AS eliminated FROM (
  SELECT l_orderkey, l_linenumber, 'Agility' AS run, l_quantity AS time, l_discount * 1500 AS penalty FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'Jumping', CASE WHEN l_returnflag <> 'R' THEN l_tax END, l_quantity FROM lineitem)""")
def unpivot_runs(spark, sf):
    d = table(spark, sf, "lineitem").withColumn("pa", c("l_discount") * 1500).withColumn("tj", F.when(c("l_returnflag") != "R", c("l_tax")))
    return J.unpivot_runs(d, ["l_orderkey", "l_linenumber"], {"Agility": ("l_quantity", "pa"), "Jumping": ("tj", "l_quantity")})


@query("""SELECT o_orderkey, pos - 1 AS pos, h AS handler, 'Rex' AS dog, 'CZ' AS country2, o_custkey * 10 + pos AS start_no, CASE WHEN pos = 2 THEN 'R, 5' ELSE '' END AS fault_info FROM orders, unnest(['Jan Novák', 'Eva', 'Petr']) WITH ORDINALITY AS u(h, pos)
  WHERE pos <= o_orderkey % 4""")
def explode_entries(spark, sf):
    item = lambda i, h, info: F.concat(F.lit(f"{h} & Rex (CZ"), (c("o_custkey") * 10 + i).cast("string"), F.lit(")" + info))
    parts = F.array(item(1, "Jan Novák", ""), item(2, "Eva", " (R, 5)"), item(3, "Petr", ""))
    n = (c("o_orderkey") % 4).cast("int")
    d = table(spark, sf, "orders").select("o_orderkey", F.array_join(F.slice(parts, F.lit(1), n), ", ").alias("t"))
    return J.explode_entries(d, "t").select("o_orderkey", c("pos").cast("bigint").alias("pos"), "handler", "dog", "country2", "start_no", "fault_info")


# -------------------------------------------------------------- pages and text blocks

SECTION, TITLE, ROW, CELL = "<(?:article|section|nav|main)[^>]*>", "<(?:h1|h2)[^>]*>(.*?)</(?:h1|h2)>", "<p[^>]*>(.*?)</p>", "([^,]+)"


@query(f"""SELECT page_id, CAST(s AS INTEGER) AS section_no, title, CAST(r AS INTEGER) AS row_no, array_to_string(list_transform(regexp_extract_all(rows[r + 1], '{CELL}', 1), lambda x: {squeeze_ends("regexp_replace(x, '<[^>]+>', '', 'g')")}), '|') AS cells FROM
  (SELECT page_id, s, title, rows, unnest(range(len(rows))) AS r FROM (SELECT page_id, s, {squeeze_ends(f"regexp_replace(regexp_extract(p, '(?s){TITLE}', 1), '<[^>]+>', '', 'g')")} AS title, regexp_extract_all(p, '(?s){ROW}', 1) AS rows FROM
    (SELECT page_id, s, parts[s + 2] AS p FROM (SELECT page_id, parts, unnest(range(len(parts) - 1)) AS s FROM (SELECT page_id, string_split_regex(html, '{SECTION}') AS parts FROM pages))) WHERE regexp_matches(p, '(?s){TITLE}')))""")
def extract_html_rows(spark, sf):
    d = H.extract_html_rows(table(spark, sf, "pages").select("page_id", "html"), "html", section=SECTION, title=TITLE, row=ROW, cell=CELL)
    return d.select("page_id", "section_no", "title", "row_no", F.array_join("cells", "|").alias("cells"))


@query(f"""WITH l AS (SELECT doc_id, pos, line, regexp_matches(line, '^[A-M]') AS nw FROM (SELECT doc_id, pos, {squeeze_ends('x')} AS line FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(x, pos)) WHERE line <> ''),
  g AS (SELECT *, SUM(CASE WHEN nw THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS rec FROM l), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, rec ORDER BY pos) - 1 AS i FROM g WHERE rec > 0)
  SELECT doc_id, CAST(rec AS BIGINT) AS record_no, md5(string_agg(i || ':' || line, chr(10) ORDER BY i)) AS record FROM k WHERE i <= 7 GROUP BY ALL""")
def text_block_records(spark, sf):
    d = H.text_block_records(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", "^[A-M]")
    names = ["start"] + [f"f{i}" for i in range(1, 8)]
    body = F.array_join(F.array_compact(F.array(*[F.when(c(n).isNotNull(), F.concat(F.lit(f"{i}:"), c(n))) for i, n in enumerate(names)])), "\n")
    return d.select("doc_id", "record_no", F.md5(body).alias("record"))


@query("""SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 50 + 1 AS INTEGER) END AS rank, o_custkey AS start_no, 'Austria' AS country, 'Lisa ' || o_custkey AS handler, 'Taco' AS dog,
  CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey % 60 AS DOUBLE) END AS time, CASE WHEN o_orderkey % 5 > 0 THEN 5.5::DOUBLE END AS total_faults, CASE WHEN o_orderkey % 5 > 0 THEN 6.12::DOUBLE END AS speed, o_orderkey % 5 = 0 AS eliminated FROM orders""")
def typed_text_records(spark, sf):
    s = lambda x: x.cast("string")
    out = c("o_orderkey") % 5 == 0
    body = F.concat(F.lit("Results\n[12]\n"), F.when(out, "-").otherwise(F.concat(s(c("o_orderkey") % 50 + 1), F.lit("º"))), F.lit("\n\n D"), s(c("o_custkey")), F.lit(" / Austria\nLisa "), s(c("o_custkey")), F.lit("\nTaco\n"),
                    F.when(out, "DISQ (R)").otherwise(F.concat(s(c("o_custkey") % 60), F.lit(".00 s"))), F.lit("\n5.50 TP\n6.12 m/s\nEXC_0\n"))
    d = H.text_block_records(table(spark, sf, "orders").select(c("o_orderkey").alias("k"), body.alias("text")), "k", "text", "^(\\d+º|-)$")
    return H.typed_record(d).drop("record_no")
