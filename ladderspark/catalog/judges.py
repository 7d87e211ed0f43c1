"""Judge statistics over the contest view."""

from __future__ import annotations

from pyspark.sql import functions as F

from ladderspark.catalog.base import query, with_results
from ladderspark.operators import judges as J
from ladderspark.plans.contests import results

COMP = """CASE WHEN NOT eliminated THEN total_faults END"""
COMPONENTS = """components AS (SELECT judge, COUNT(DISTINCT run_id) AS runs, AVG(CASE WHEN eliminated THEN 1.0 ELSE 0 END)::DOUBLE AS elimination_rate,
    1 - COUNT(*) FILTER (total_faults = 0)::DOUBLE / COUNT(*) FILTER (NOT eliminated) AS faulted_rate, AVG(total_faults) AS avg_faults,
    COUNT(*) FILTER (time_faults > 0)::DOUBLE / COUNT(*) FILTER (NOT eliminated) AS time_fault_rate FROM results GROUP BY judge)"""
SCORED = f"""{COMPONENTS}, scored AS (SELECT *, CASE WHEN runs >= 60 THEN 3.5 * least(elimination_rate / 0.4, 1) + 2.5 * least(faulted_rate / 0.8, 1) + 2 * least(avg_faults / 12, 1)
    + 2 * least(time_fault_rate / 0.5, 1) END::DOUBLE AS toughness FROM components)"""
RATES = ["elimination_rate", "faulted_rate", "avg_faults", "time_fault_rate"]
r6 = lambda *cols: [F.round(x, 6).alias(x) for x in cols]
r6s = lambda *cols: ", ".join(f"round({x}, 6) AS {x}" for x in cols)


def judged(spark, sf):
    return results(spark, sf).withColumn("comp_country", F.concat(F.lit("C"), (F.col("comp_id") % 5).cast("string")))


@query(with_results(f"SELECT judge, runs, {r6s(*RATES)} FROM components", COMPONENTS))
def judge_components(spark, sf):
    return J.judge_components(judged(spark, sf)).select("judge", "runs", *r6(*RATES))


@query(with_results(f"SELECT judge, {r6s('toughness')} FROM scored", SCORED))
def judge_toughness(spark, sf):
    return J.toughness(J.judge_components(judged(spark, sf)), least=60).select("judge", *r6("toughness"))


@query(with_results("""SELECT judge, round(CASE WHEN toughness IS NOT NULL THEN
  (SELECT COUNT(*) FROM scored b WHERE b.toughness <= a.toughness)::DOUBLE / (SELECT COUNT(toughness) FROM scored) END, 6) AS percentile FROM scored a""", SCORED))
def toughness_percentile(spark, sf):
    d = J.toughness(J.judge_components(judged(spark, sf)), least=60)
    return J.toughness_percentile(d).select("judge", *r6("percentile"))


@query(with_results("""SELECT judge, COUNT(*) AS total_runs, round(AVG(n), 6) AS avg_participants, round(AVG(CASE WHEN tier = 1 THEN 1.0 ELSE 0 END), 6) AS tier1_share,
    any_value(teams) AS teams, any_value(comps) AS competitions, any_value(fd) AS first_date, any_value(ld) AS last_date, any_value(mj) AS most_judged_competition, any_value(cs) AS countries FROM
  (SELECT judge, run_id, COUNT(*) AS n, MIN(tier) AS tier FROM results GROUP BY ALL) JOIN
  (SELECT judge, COUNT(DISTINCT team_id) AS teams, COUNT(DISTINCT comp_id) AS comps, MIN(date) AS fd, MAX(date) AS ld, string_agg(DISTINCT 'C' || comp_id % 5, ',' ORDER BY 'C' || comp_id % 5) AS cs FROM results GROUP BY 1) USING (judge) JOIN
  (SELECT judge, arg_max(comp_id, (n, -comp_id)) AS mj FROM (SELECT judge, comp_id, COUNT(DISTINCT run_id) AS n FROM results GROUP BY ALL) GROUP BY 1) USING (judge) GROUP BY judge"""))
def judge_profile(spark, sf):
    d = J.judge_profile(judged(spark, sf))
    return d.select(*[x for x in d.columns if x not in ("avg_participants", "tier1_share")], *r6("avg_participants", "tier1_share"))


@query(with_results("""SELECT judge, 'size' AS kind, pool AS label, COUNT(DISTINCT run_id)::DOUBLE AS value FROM results GROUP BY ALL
  UNION ALL SELECT judge, 'discipline', discipline, COUNT(DISTINCT run_id) FROM results GROUP BY ALL
  UNION ALL SELECT judge, 'faults', label, round(n * 100.0 / SUM(n) OVER (PARTITION BY judge), 6) FROM (SELECT judge, CASE WHEN total_faults = 0 THEN 'clean' WHEN total_faults <= 5 THEN 'low'
    WHEN total_faults <= 10 THEN 'medium' ELSE 'high' END AS label, COUNT(*)::DOUBLE AS n FROM results WHERE NOT eliminated GROUP BY ALL)"""))
def judge_distributions(spark, sf):
    d = J.judge_distributions(judged(spark, sf))
    return d.select("judge", "kind", "label", *r6("value"))


@query(with_results("""SELECT judge, round(AVG(m / 45), 6) AS sct_tightness, round(AVG(sp), 6) AS speed_spread FROM
  (SELECT judge, run_id, median(time) AS m, stddev_samp(speed) AS sp FROM results WHERE NOT eliminated GROUP BY ALL) GROUP BY judge"""))
def judge_course_design(spark, sf):
    return J.judge_course_design(judged(spark, sf)).select("judge", *r6("sct_tightness", "speed_spread"))


@query(with_results("""SELECT judge, arg_max(run_id, (o, -run_id)) AS toughest_run, arg_max(run_id, (c, -run_id)) FILTER (c IS NOT NULL) AS cleanest_run FROM
  (SELECT judge, run_id, COUNT(*) FILTER (eliminated)::DOUBLE / COUNT(*) AS o, COUNT(*) FILTER (total_faults = 0)::DOUBLE / nullif(COUNT(*) FILTER (NOT eliminated), 0) AS c
   FROM results GROUP BY ALL HAVING COUNT(*) >= 20) GROUP BY judge"""))
def signature_runs(spark, sf):
    return J.signature_runs(judged(spark, sf))


@query(with_results(f"SELECT judge, runs, {r6s('toughness')} FROM scored ORDER BY scored.toughness DESC NULLS LAST, judge LIMIT 5", SCORED))
def judges_page(spark, sf):
    d = J.toughness(J.judge_components(judged(spark, sf)), least=60)
    return J.judges_page(d, page_size=5).select("judge", "runs", *r6("toughness"))
