"""Registry of queries and the SQL they are compared with."""

from __future__ import annotations

import re

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under its own name, with optional DuckDB SQL."""

    def add(fn):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# Common table expressions of the contest view, in DuckDB's dialect.
RESULTS = """
monthly AS (
  SELECT l_suppkey AS team_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
    SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS score, COUNT(*) AS lines,
    SUM(CAST(l_quantity AS BIGINT)) AS qty,
    CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
team AS (
  SELECT s_suppkey AS team_id, s_name AS handler, 'Dog ' || s_suppkey AS dog, n_name AS country,
    r_name AS size_group, r_name AS pool, CAST(n_regionkey AS BIGINT) AS pool_id,
    lower(s_name) AS handler_norm, lower('Dog ' || s_suppkey) AS dog_norm
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
entered AS (
  SELECT m.*, handler, dog, country, pool, pool_id, CAST(year(date) * 100 + month(date) AS BIGINT) AS comp_id,
    returned * 10 >= lines * 6 AS eliminated, CAST(floor(score / 20000) AS BIGINT) AS coarse
  FROM monthly m JOIN team USING (team_id)),
results AS (
  SELECT comp_id * 10 + pool_id AS run_id, comp_id, date, pool, team_id, handler, dog, country, eliminated,
    'Cup ' || comp_id AS comp_name,
    CASE WHEN NOT eliminated THEN rank() OVER (PARTITION BY comp_id, pool_id, eliminated ORDER BY coarse DESC) END AS rank,
    CAST(CASE WHEN month(date) % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS tier,
    CASE month(date) % 3 WHEN 0 THEN 'Agility' WHEN 1 THEN 'Jumping' ELSE 'Final' END AS discipline,
    CASE WHEN pool_id = 4 AND year(date) = 1995 THEN 'Guest Judge' ELSE
      ['Jiří Novák', 'Anna-Lena Groß', 'Łukasz Wójcik', 'Søren Ødegård', 'Ms Guest', 'María José Peña', 'Tom O''Neil']
      [(year(date) * 12 + month(date)) % 7 + 1] END AS judge,
    CASE WHEN NOT eliminated THEN lines % 3 END AS faults,
    CASE WHEN NOT eliminated THEN returned % 3 END AS refusals,
    CASE WHEN NOT eliminated THEN late END AS time_faults,
    CASE WHEN NOT eliminated THEN lines % 3 * 5 + returned % 3 * 5 + late END AS total_faults,
    CASE WHEN NOT eliminated THEN secs END AS time,
    CASE WHEN NOT eliminated THEN round(course / secs, 2) END AS speed,
    45.0::DOUBLE AS sct, 70.0::DOUBLE AS mct, course AS course_length, team_id AS _seq, CAST(score AS DOUBLE) AS score
  FROM (SELECT *, CASE WHEN qty % 3 = 0 THEN (qty % 7)::DOUBLE / 4 ELSE 0.0::DOUBLE END AS late,
      30 + (qty % 97)::DOUBLE / 4 AS secs, (150 + comp_id % 7 * 5)::DOUBLE AS course FROM entered))
"""


def ctes(*parts: str) -> str:
    return ",\n".join(p.strip() for p in parts)


def with_results(body: str, *parts: str) -> str:
    return f"WITH RECURSIVE {ctes(RESULTS, *parts)}\n{body}"


def renamed(sql: str, prefix: str) -> str:
    """A copy of replay expressions under other names, for a second replay in one statement."""
    return re.sub(r"\b(field0|field1|field|st|hist|states)\b", lambda m: prefix + m.group(1), sql)


def field_sql(source: str, *, min_ranked: int = 2, mode: str = "source", eliminated: str = "last") -> str:
    """Model field of ``source`` as CTE ``field`` (columns of results plus model_rank, weight, run_seq)."""
    keep = "WHERE NOT eliminated AND rank IS NOT NULL" if eliminated == "ignore" else ""
    order = "rank" if mode == "source" else "row_number() OVER (PARTITION BY run_id, eliminated ORDER BY rank, _seq)"
    weight = (
        "CASE WHEN eliminated THEN greatest(0.10, 0.35 * (1 - outs::DOUBLE / n)) ELSE 1.0 END"
        if eliminated == "downweight"
        else "CASE WHEN tier = 1 THEN 1.2 ELSE 1.0 END"
    )
    return f"""
field0 AS (SELECT *, COUNT(*) OVER (PARTITION BY run_id) AS n FROM {source}),
field1 AS (SELECT *, SUM(CASE WHEN eliminated THEN 0 ELSE 1 END) OVER (PARTITION BY run_id) AS fin,
    SUM(CASE WHEN eliminated THEN 1 ELSE 0 END) OVER (PARTITION BY run_id) AS outs,
    COUNT(*) OVER (PARTITION BY run_id) AS rankable
  FROM (SELECT * FROM field0 WHERE n >= 6) {keep}),
field AS (SELECT *, CAST(CASE WHEN eliminated THEN fin + 1 ELSE {order} END AS BIGINT) AS model_rank,
    CAST({weight} AS DOUBLE) AS weight, dense_rank() OVER (PARTITION BY pool ORDER BY date, run_id) AS run_seq
  FROM field1 WHERE rankable >= {min_ranked})"""


def replay_sql(*, field: str = "field", idle: str | None = None, sigma_max: float | None = None) -> str:
    """Replay of CTE ``field`` run by run as recursive CTE ``st``; ``hist`` has one row per entrant."""
    extra = idle or "0.0::DOUBLE"
    grown = "s.sigma"
    if sigma_max is not None:
        grown = f"CASE WHEN {extra} > 0 THEN least({sigma_max}, sqrt(s.sigma * s.sigma + {extra})) ELSE s.sigma END"
    return f"""
st AS (
  SELECT CAST(0 AS BIGINT) AS step, pool, team_id, 25.0::DOUBLE AS mu, 8.333::DOUBLE AS sigma,
    25.0::DOUBLE AS pmu, 8.333::DOUBLE AS psigma
  FROM (SELECT DISTINCT pool, team_id FROM {field})
  UNION ALL
  SELECT * FROM (
    WITH cur AS (
      SELECT s.step + 1 AS step, s.pool, s.team_id, s.mu, CASE WHEN g.team_id IS NULL THEN s.sigma ELSE {grown} END AS sigma,
        g.model_rank AS rk, g.weight AS w
      FROM st s LEFT JOIN {field} g ON g.pool = s.pool AND g.team_id = s.team_id AND g.run_seq = s.step + 1
      WHERE s.step < (SELECT max(run_seq) FROM {field})),
    c1 AS (SELECT *, sqrt(SUM(sigma * sigma + (25.0::DOUBLE / 6) * (25.0::DOUBLE / 6)) OVER (PARTITION BY pool)) AS c
      FROM cur WHERE rk IS NOT NULL),
    c2 AS (SELECT *, exp(mu / c) AS e FROM c1),
    c3 AS (SELECT *, SUM(e) OVER (PARTITION BY pool ORDER BY rk DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
        COUNT(*) OVER (PARTITION BY pool, rk) AS a FROM c2),
    c4 AS (SELECT *, SUM(1 / (s * a)) OVER (PARTITION BY pool ORDER BY rk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z1,
        SUM(1 / (s * s * a)) OVER (PARTITION BY pool ORDER BY rk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS z2
      FROM c3),
    c5 AS (SELECT pool, team_id, mu + w * (sigma * sigma / c * (1.0::DOUBLE / a - e * z1)) AS nmu,
        greatest(1.5, (sigma + w * (sigma * sqrt(greatest(1 - pow(sigma / c, 3) * (e * z1 - e * e * z2), 0.0001)) - sigma)) * 0.99) AS ns
      FROM c4)
    SELECT cur.step, cur.pool, cur.team_id, coalesce(nmu, cur.mu), coalesce(ns, cur.sigma), cur.mu, cur.sigma
    FROM cur LEFT JOIN c5 ON cur.pool = c5.pool AND cur.team_id = c5.team_id)),
hist AS (SELECT f.*, st.mu, st.sigma, st.pmu AS prev_mu, st.psigma AS prev_sigma
  FROM {field} f JOIN st ON st.pool = f.pool AND st.team_id = f.team_id AND st.step = f.run_seq)"""


STATES = """
states AS (SELECT team_id, arg_max(mu, run_seq) AS mu, arg_max(sigma, run_seq) AS sigma,
    arg_max(prev_mu, run_seq) AS prev_mu, arg_max(prev_sigma, run_seq) AS prev_sigma, COUNT(*) AS run_count,
    COUNT(*) FILTER (NOT eliminated) AS finished_run_count,
    COUNT(*) FILTER (NOT eliminated AND rank <= 3) AS top3_run_count,
    COUNT(*) FILTER (NOT eliminated AND rank <= 10) AS top10_run_count, MAX(date) AS last_date
  FROM hist GROUP BY team_id)"""

# The stored team table: live window, replay per region, display rating, z-score, flags, tiers.
BOARD = f"""
{RESULTS},
recent AS (SELECT * FROM results WHERE date >= (SELECT MAX(date) FROM results) - 730),
{field_sql("recent")},
{replay_sql()},
{STATES},
raw AS (SELECT t.*, coalesce(mu, 25.0) AS mu, coalesce(sigma, 8.333) AS sigma, coalesce(prev_mu, 25.0) AS prev_mu,
    coalesce(prev_sigma, 8.333) AS prev_sigma, coalesce(run_count, 0) AS run_count,
    coalesce(finished_run_count, 0) AS finished_run_count, coalesce(top3_run_count, 0) AS top3_run_count,
    coalesce(top10_run_count, 0) AS top10_run_count, last_date,
    0.85 + 0.20 * least(greatest(CASE WHEN run_count > 0 THEN top3_run_count::DOUBLE / run_count ELSE 0 END / 0.5, 0), 1) AS quality
  FROM team t LEFT JOIN states USING (team_id)),
rated AS (SELECT *, (1000 + 40 * (mu - sigma)) * quality AS raw_rating,
    (1000 + 40 * (prev_mu - prev_sigma)) * quality AS raw_prev FROM raw),
params AS (SELECT size_group, COUNT(*) AS n, AVG(raw_rating) AS m, stddev_pop(raw_rating) AS sd
  FROM rated WHERE run_count > 0 GROUP BY size_group),
normal AS (SELECT rated.*, CASE WHEN run_count = 0 THEN raw_rating WHEN n < 2 OR sd < 1e-6 THEN 1500
      ELSE 1500 + 150 * (raw_rating - m) / sd END AS rating,
    CASE WHEN run_count = 0 THEN raw_prev WHEN n < 2 OR sd < 1e-6 THEN 1500
      ELSE 1500 + 150 * (raw_prev - m) / sd END AS prev_rating
  FROM rated LEFT JOIN params USING (size_group)),
flagged AS (SELECT *, run_count >= 5 AS is_active, sigma >= 7.8 AS is_provisional FROM normal),
board AS (SELECT *, CASE WHEN NOT is_active THEN NULL WHEN share <= 0.02 THEN 'Elite' WHEN share <= 0.10 THEN 'Champion'
      WHEN share <= 0.30 THEN 'Expert' ELSE 'Competitor' END AS tier,
    CASE WHEN is_active THEN greatest(rating, 0) ELSE 0 END AS peak_rating
  FROM (SELECT *, row_number() OVER (PARTITION BY size_group, is_active ORDER BY rating DESC, team_id)::DOUBLE
      / COUNT(*) OVER (PARTITION BY size_group, is_active) AS share FROM flagged)),
snaps AS (SELECT h.*, size_group, CASE WHEN params.n < 2 OR sd < 1e-6 THEN 1500 ELSE
      1500 + 150 * ((1000 + 40 * (h.mu - h.sigma)) * quality - m) / sd END AS rating
  FROM hist h JOIN raw USING (team_id) JOIN params USING (size_group))"""


def with_board(body: str, *parts: str) -> str:
    return f"WITH RECURSIVE {ctes(BOARD, *parts)}\n{body}"
