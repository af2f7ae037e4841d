"""Differential and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempaudit.operators import compare, curves, holds, stats, usage
from tempaudit.operators.recipes import measure
from tempaudit.plans.common import HYST, S, THR, WIN, expr, query, r, samples, sql_islands, sql_latch, table, timeline

# the corpus: an order is a dataset; its status is the outcome, its price decides what was expected
OUT = "CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAIL' ELSE 'INDETERMINATE' END"
EXP = ("CASE WHEN o_totalprice < 250000 THEN " + OUT + " WHEN o_totalprice < 350000 THEN 'PASS' WHEN o_totalprice < 450000 THEN 'FAIL' "
       "ELSE 'ERROR' END")
CORPUS = f"""c AS (SELECT o_orderkey AS k, substr(o_orderpriority, 3) AS industry, {EXP} AS expected,
  CASE WHEN o_orderkey % 17 = 0 THEN 'ERROR' ELSE {OUT} END AS actual, o_totalprice AS t FROM orders)"""


def corpus(spark, sf):
    o = table(spark, sf, "orders")
    registry = o.select(F.col("o_orderkey").alias("k"), F.expr("substr(o_orderpriority, 3)").alias("industry"), F.expr(EXP).alias("expected"),
                        F.col("o_totalprice").alias("t"))
    outcomes = o.filter("o_orderkey % 17 <> 0").select(F.col("o_orderkey").alias("k"), F.expr(OUT).alias("actual"))
    return compare.match_outcomes(registry, outcomes, "k")


@query("j02_expected_vs_actual", f"WITH {CORPUS} SELECT k, expected, actual FROM c WHERE expected <> actual")
def j02(spark, sf):
    return corpus(spark, sf).filter("mismatch").select("k", "expected", "actual")


@query("g25_confusion_2x2", f"""WITH {CORPUS}, m AS (SELECT industry, count(*) FILTER (WHERE expected = 'PASS' AND actual = 'PASS') AS tp,
  count(*) FILTER (WHERE expected <> 'PASS' AND actual = 'PASS') AS fp, count(*) FILTER (WHERE expected <> 'PASS' AND actual <> 'PASS') AS tn,
  count(*) FILTER (WHERE expected = 'PASS' AND actual <> 'PASS') AS fn FROM c GROUP BY industry)
SELECT industry, tp, fp, tn, fn, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0) * 100, 0), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0) * 100, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0) * 100, 0), 6) AS recall FROM m""")
def g25(spark, sf):
    m = compare.confusion_2x2(corpus(spark, sf), "industry")
    return m.select("industry", "tp", "fp", "tn", "fn", r("accuracy"), r("precision"), r("recall"))


@query("g26_confusion_4x4", f"""WITH {CORPUS}, cl(x) AS (VALUES ('PASS'), ('FAIL'), ('ERROR'), ('INDETERMINATE')),
n AS (SELECT expected, actual, count(*) AS n FROM c GROUP BY ALL), a AS (SELECT count(*) FILTER (WHERE expected = actual) / count(*) AS acc FROM c)
SELECT e.x AS expected, b.x AS actual, coalesce(n.n, 0) AS n, round(acc, 6) AS accuracy FROM cl e CROSS JOIN cl b CROSS JOIN a
LEFT JOIN n ON n.expected = e.x AND n.actual = b.x""")
def g26(spark, sf):
    return compare.confusion_4x4(spark, corpus(spark, sf)).select("expected", "actual", "n", r("accuracy"))


@query("g27_timing_stats", f"""WITH {CORPUS}, o AS (SELECT industry, t, row_number() OVER (PARTITION BY industry ORDER BY t) AS rn,
  count(*) OVER (PARTITION BY industry) AS n FROM c)
SELECT industry, round(avg(t), 4) AS mean_value, max(t) AS max_value, min(t) AS min_value,
  max(t) FILTER (WHERE rn = floor(n / 2) + 1) AS median_value FROM o GROUP BY industry""")
def g27(spark, sf):
    return compare.timing_stats(corpus(spark, sf), "industry", "t").select("industry", r("mean_value", 4), "max_value", "min_value", "median_value")


@query("g28_differential_summary", f"""WITH {CORPUS} SELECT coalesce(industry, 'ALL') AS industry, count(*) AS total, count(*) FILTER (WHERE actual <> 'ERROR') AS success,
  count(*) FILTER (WHERE actual = 'ERROR') AS errors, count(*) FILTER (WHERE expected = actual) AS within FROM c GROUP BY ROLLUP (industry)""")
def g28(spark, sf):
    c = corpus(spark, sf).select("industry", F.col("actual").alias("outcome"), (~F.col("mismatch")).alias("within_tolerance"))
    return compare.differential_summary(c).withColumn("industry", F.coalesce("industry", F.lit("ALL")))


@query("g29_match_summary", f"""WITH {CORPUS} SELECT count(*) AS total, count(*) FILTER (WHERE actual = 'PASS') AS passes,
  count(*) FILTER (WHERE actual = 'FAIL') AS fails, count(*) FILTER (WHERE expected = actual) AS matches,
  round(count(*) FILTER (WHERE expected = actual) / count(*) * 100, 1) AS match_rate FROM c""")
def g29(spark, sf):
    return compare.match_summary(corpus(spark, sf))


@query("g44_status_counts", f"""WITH {CORPUS} SELECT count(*) AS total, count(*) FILTER (WHERE actual = 'PASS') AS pass, count(*) FILTER (WHERE actual = 'FAIL') AS fail,
  count(*) FILTER (WHERE actual = 'ERROR') AS error, count(*) FILTER (WHERE actual = 'INDETERMINATE') AS indeterminate FROM c""")
def g44(spark, sf):
    return compare.status_counts(corpus(spark, sf), "actual")


@query("s04_slowest_cases", f"WITH {CORPUS} SELECT k, t FROM c ORDER BY t DESC, k LIMIT 5")
def s04(spark, sf):
    return corpus(spark, sf).select("k", "t").orderBy(F.col("t").desc(), "k").limit(5)


@query("v17_disagreement_reason", f"""WITH {CORPUS} SELECT k, CASE WHEN expected = 'PASS' AND actual = 'FAIL' THEN 'failed a case that should pass'
  WHEN expected = 'FAIL' AND actual = 'PASS' THEN 'passed a case that should fail'
  WHEN expected IN ('ERROR','INDETERMINATE') AND actual IN ('PASS','FAIL') THEN 'definitive ' || actual || ' for an uncertain case'
  WHEN expected IN ('PASS','FAIL') AND actual IN ('ERROR','INDETERMINATE') THEN 'uncertain ' || actual || ' for a definitive case'
  ELSE 'expected ' || expected || ', got ' || actual END AS reason FROM c WHERE expected <> actual""")
def v17(spark, sf):
    return corpus(spark, sf).select("k", compare.disagreement(F.col("expected"), F.col("actual")).alias("reason")).filter("reason is not null")


@query("v14_status_consistency", f"""WITH {CORPUS}, p AS (SELECT k, actual AS st, t < 400000 AS ok FROM c)
SELECT k, CASE WHEN st = 'PASS' AND NOT ok THEN 'FAIL' WHEN st = 'FAIL' AND ok THEN 'PASS' ELSE st END AS status FROM p""")
def v14(spark, sf):
    from tempaudit.functions.scalars import consistent_status

    return corpus(spark, sf).select("k", consistent_status(F.col("actual"), F.col("t") < 400000).alias("status"))


@query("b19_registry_filter", f"""WITH {CORPUS} SELECT k, industry, expected AS expected_outcome, CASE WHEN k % 3 = 0 THEN 'realworld' ELSE 'synthetic' END AS dataset_type
FROM c WHERE industry IN ('URGENT', 'HIGH') AND expected IN ('PASS', 'ERROR') AND k % 3 = 0""")
def b19(spark, sf):
    reg = corpus(spark, sf).select("k", "industry", F.col("expected").alias("expected_outcome"), F.concat(
        F.when(F.col("k") % 3 == 0, "realworld/").otherwise("examples/"), F.col("k"), F.lit(".csv")).alias("csv_path"))
    return usage.registry_filter(reg, ["URGENT", "HIGH"], ["PASS", "ERROR"], "realworld").drop("csv_path")


@query("b20_risk_filter", f"""WITH {CORPUS} SELECT k, industry, actual AS status, CASE WHEN actual = 'INDETERMINATE' THEN 'undecided' ELSE 'pass_on_fallback' END AS risk
FROM c WHERE actual = 'INDETERMINATE' OR (actual = 'PASS' AND industry IN ('URGENT', 'HIGH') AND k % 4 = 0)""")
def b20(spark, sf):
    d = corpus(spark, sf).select("k", "industry", F.col("actual").alias("status"), (F.col("k") % 4 == 0).alias("fallback_used"))
    return usage.risky(d, ("URGENT", "HIGH")).drop("fallback_used")


# -- engine against independent calculation --------------------------------------------------------


HOLD, RAMP = "hold_time_s", "ramp_rate_C_per_min"


def sides(spark, sf):
    """Hold time and largest ramp of every run by engine and independently, from one pass."""
    recipe = compare.hold_and_ramp(expr(THR), expr(HYST))
    c = recipe.measured
    industry = F.when(F.col("run_id") % 2 == 0, "powder").otherwise("autoclave").alias("industry")
    return measure(timeline(spark, sf), {"": recipe}).select(
        "run_id", industry, c("engine_hold").alias("e_hold"), c("engine_ramp").alias("e_ramp"), c("other_hold").alias("i_hold"),
        F.when(F.col("run_id") % 10 < 8, c("other_ramp")).alias("i_ramp"),
        F.when(c("engine_hold") >= 86400, "PASS").otherwise("FAIL").alias("status"))


def differences(spark, sf, *key):
    pairs = {HOLD: (F.col("e_hold"), F.col("i_hold")), RAMP: (F.col("e_ramp"), F.col("i_ramp"))}
    both = compare.paired_metrics(sides(spark, sf), pairs, ("run_id", "industry", *key))
    return compare.judged_pairs(both, compare.tolerance_table(spark), key=("run_id", "industry", *key))


def _sql_hold(state: str, name: str) -> str:
    body = sql_islands(state).replace("st AS", f"st_{name} AS").replace("FROM st)", f"FROM st_{name})").replace("ch AS", f"ch_{name} AS").replace(
        "FROM ch)", f"FROM ch_{name})").replace("isl_rows AS", f"ir_{name} AS").replace("FROM isl_rows", f"FROM ir_{name}").replace("isl AS", f"isl_{name} AS")
    return body + f", h_{name} AS (SELECT run_id, coalesce(max(duration_s) FILTER (WHERE state), 0) AS h FROM isl_{name} GROUP BY run_id)"


SQL_SIDES = f"""{_sql_hold(sql_latch(), 'e')}, {_sql_hold(f'value >= {THR} - {HYST}', 'i')},
rm AS (SELECT run_id, max(coalesce(b, 0)) AS b, coalesce(max(c), 0) AS c FROM (SELECT run_id,
  (value - lag(value) OVER {WIN}) / ((us - lag(us) OVER {WIN}) / 1e6) * 60 AS b,
  (lead(value) OVER {WIN} - lag(value) OVER {WIN}) / ((lead(us) OVER {WIN} - lag(us) OVER {WIN}) / 1e6) * 60 AS c FROM s) GROUP BY run_id),
sd AS (SELECT run_id, 'hold_time_s' AS metric, h_e.h AS e, h_i.h AS i, 1.0 AS tol FROM h_e JOIN h_i USING (run_id)
  UNION ALL SELECT run_id, 'ramp_rate_C_per_min', b, CASE WHEN run_id % 10 < 8 THEN c END, CASE WHEN run_id % 2 = 0 THEN 0.05 END FROM rm),
df AS (SELECT *, CASE WHEN e IS NULL OR i IS NULL THEN false WHEN e = 0 AND i = 0 THEN true WHEN tol IS NOT NULL THEN abs(e - i) <= tol
  ELSE abs(e - i) / greatest(abs(e), abs(i)) <= 0.05 END AS ok FROM sd)"""


@query("j03_metric_differences", f"""WITH {S}, {SQL_SIDES} SELECT run_id, metric, round(e, 6)::DOUBLE AS engine, round(i, 6)::DOUBLE AS independent, ok AS within_tolerance,
  CASE WHEN e IS NULL OR i IS NULL THEN 'N/A' WHEN e = 0 AND i = 0 THEN 'exact' WHEN tol IS NOT NULL THEN 'absolute' ELSE 'relative' END AS tolerance_type FROM df""")
def j03(spark, sf):
    return differences(spark, sf).select("run_id", "metric", r("engine"), r("independent"), "within_tolerance", "tolerance_type")


@query("v12_shadow_comparison", f"""WITH {S}, {SQL_SIDES}, sh AS (SELECT run_id, count(*) FILTER (WHERE e IS NOT NULL AND i IS NOT NULL) AS compared,
  count(*) FILTER (WHERE e IS NOT NULL AND i IS NOT NULL AND NOT ok) AS violations,
  coalesce(string_agg(CASE WHEN e IS NOT NULL AND i IS NOT NULL AND NOT ok THEN metric END, ',' ORDER BY metric), '') AS reason FROM df GROUP BY run_id)
SELECT run_id, compared, violations, reason, CASE WHEN compared = 0 THEN 'INDEPENDENT_ERROR' WHEN violations > 0 THEN 'TOLERANCE_VIOLATION' ELSE 'AGREEMENT' END AS shadow_status,
  CASE WHEN violations > 0 THEN 'INDETERMINATE' WHEN h_e.h >= 86400 THEN 'PASS' ELSE 'FAIL' END AS final_status FROM sh JOIN h_e USING (run_id)""")
def v12(spark, sf):
    shadow = compare.shadow_status(differences(spark, sf, "status"), ("run_id", "industry", "status"))
    final = compare.final_status(F.col("status"), F.col("shadow_status"))
    return shadow.withColumn("final_status", final).drop("industry", "status")


REPLAY = """old AS (SELECT o_orderkey AS run_id, o_orderstatus AS status, o_totalprice AS hold_s,
  CASE WHEN o_orderkey % 2 = 0 THEN ['hold_met'] ELSE ['hold_short', 'too_late'] END AS codes FROM orders),
nu AS (SELECT run_id, CASE WHEN run_id % 19 = 0 THEN 'X' ELSE status END AS status, hold_s + (run_id % 5) * 0.04 AS hold_s,
  CASE WHEN run_id % 7 = 0 THEN ['hold_met'] ELSE codes END AS codes FROM old)"""


@query("v13_replay_check", f"""WITH {REPLAY}, d AS (SELECT old.run_id, concat_ws(';', CASE WHEN old.status <> nu.status THEN 'status mismatch' END,
  CASE WHEN abs(old.hold_s - nu.hold_s) > 0.1 THEN 'hold_s difference' END,
  CASE WHEN old.run_id % 2 = 1 AND old.run_id % 7 = 0 THEN 'missing reasons hold_short,too_late' END,
  CASE WHEN old.run_id % 2 = 1 AND old.run_id % 7 = 0 THEN 'extra reasons hold_met' END) AS discrepancies FROM old JOIN nu USING (run_id))
SELECT run_id, discrepancies, discrepancies = '' AS matches FROM d""")
def v13(spark, sf):
    k = F.col("run_id")
    old = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("hold_s"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("hold_met"))).otherwise(F.array(F.lit("hold_short"), F.lit("too_late"))).alias("codes"))
    new = old.select("run_id", F.when(k % 19 == 0, "X").otherwise(F.col("status")).alias("status"), (F.col("hold_s") + (k % 5) * 0.04).alias("hold_s"),
                     F.when(k % 7 == 0, F.array(F.lit("hold_met"))).otherwise(F.col("codes")).alias("codes"))
    out = compare.replay_check(old, new, ["status"], ["hold_s"])
    return out.select("run_id", F.array_join("discrepancies", ";").alias("discrepancies"), "matches")


@query("s07_reason_difference", f"""WITH {REPLAY} SELECT old.run_id, array_to_string(list_sort(list_filter(old.codes, lambda x: NOT list_contains(nu.codes, x))), ',') AS lost,
  array_to_string(list_sort(list_filter(nu.codes, lambda x: NOT list_contains(old.codes, x))), ',') AS added FROM old JOIN nu USING (run_id)""")
def s07(spark, sf):
    k = F.col("o_orderkey")
    base = F.when(k % 2 == 0, F.array(F.lit("hold_met"))).otherwise(F.array(F.lit("hold_short"), F.lit("too_late")))
    pairs = table(spark, sf, "orders").select(k.alias("run_id"), base.alias("a"), F.when(k % 7 == 0, F.array(F.lit("hold_met"))).otherwise(base).alias("b"))
    diff = lambda x, y: F.array_join(F.array_sort(F.array_except(x, y)), ",")
    return pairs.select("run_id", diff("a", "b").alias("lost"), diff("b", "a").alias("added"))


@query("v15_entry_audit", f"""WITH {S}, d AS (SELECT *, (us - lag(us) OVER {WIN}) / 1e6 AS dt FROM s),
a AS (SELECT run_id, ['PASS','FAIL','ERROR','PASS'][run_id % 4 + 1] AS expected, count(*) FILTER (WHERE dt < 60) AS duplicates,
  count(*) FILTER (WHERE value IS NULL) AS missing, max(dt) <= 200000 AS quality_ok, max(value) >= 240 AS feasible FROM d GROUP BY run_id)
SELECT run_id, w AS warnings, CASE WHEN w = '' THEN 'passed' ELSE 'warning' END AS audit FROM (SELECT run_id, concat_ws(',',
  CASE WHEN expected = 'ERROR' AND duplicates = 0 AND missing = 0 AND quality_ok THEN 'error_expected_but_clean' END,
  CASE WHEN expected <> 'ERROR' AND (duplicates > 0 OR NOT quality_ok) THEN 'quality_issues' END,
  CASE WHEN expected = 'PASS' AND NOT feasible THEN 'independent_says_fail' END, CASE WHEN expected = 'FAIL' AND feasible THEN 'independent_says_pass' END) AS w FROM a)""")
def v15(spark, sf):
    tl = curves.with_step(timeline(spark, sf))
    a = tl.per_run(
        F.count_if(F.col("dt") < 60).alias("duplicates"), F.count_if(F.col("value").isNull()).alias("missing"),
        (F.max("dt") <= 200_000).alias("quality_ok"), (F.max("value") >= 240).alias("feasible"))
    expected = F.element_at(F.array(*map(F.lit, ("PASS", "FAIL", "ERROR", "PASS"))), (F.col("run_id") % 4 + 1).cast("int"))
    return compare.entry_audit(a.withColumn("expected", expected)).select("run_id", F.array_join("warnings", ",").alias("warnings"), "audit")


@query("v16_metric_audit", f"""WITH {S}, {_sql_hold(sql_latch(), 'e')}, m AS (SELECT run_id, max(value) AS mx, avg(value) AS f0 FROM s GROUP BY run_id),
x AS (SELECT run_id, CASE WHEN run_id % 3 > 0 THEN abs(f0 - 50) / 50 <= 0.15 END AS a, abs(h - floor(h / 700) * 700) <= 300 AS b, abs(mx - floor(mx / 5) * 5) <= 2 AS c FROM m JOIN h_e USING (run_id))
SELECT run_id, (CASE WHEN a IS NULL THEN 2 ELSE 3 END)::BIGINT AS checked, coalesce(a, true) AND b AND c AS metrics_ok FROM x""")
def v16(spark, sf):
    tl = timeline(spark, sf)
    got = holds.latched_hold(tl, expr(THR), expr(HYST)).join(tl.per_run(F.max("value").alias("max_temp"), F.avg("value").alias("f0")), "run_id")
    both = got.withColumns({"expected_f0": F.when(F.col("run_id") % 3 > 0, 50.0), "expected_hold_s": F.floor(F.col("hold_s") / 700) * 700, "expected_max": F.floor(F.col("max_temp") / 5) * 5})
    return compare.metric_audit(both).select("run_id", F.col("checked").cast("long"), "metrics_ok")


@query("v18_golden_compare", """WITH d AS (SELECT o_orderkey AS run_id, substr(sha256('{"points":' || (o_orderkey % 1000) || ',"status":"' || o_orderstatus || '"}'), 1, 16) AS digest FROM orders)
SELECT run_id, digest, CASE WHEN run_id % 29 = 0 THEN 'NEW' WHEN run_id % 23 = 0 THEN 'CHANGED' ELSE 'MATCH' END AS state FROM d""")
def v18(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 1000).alias("points"))
    digest = compare.decision_digest(d, ["status", "points"])
    golden = d.filter("run_id % 29 <> 0").select("run_id", F.when(F.col("run_id") % 23 == 0, "stale").otherwise(digest).alias("digest"))
    return compare.golden_check(d, golden, ["status", "points"]).select("run_id", "digest", "state")


@query("g45_truth_by_counts", f"""WITH {S} SELECT run_id, count(*) FILTER (WHERE value >= {THR}) * 600.0 / 60 AS hold_min,
  CASE WHEN count(*) FILTER (WHERE value >= {THR}) * 10.0 >= 400 THEN 'PASS' ELSE 'FAIL' END AS powder,
  CASE WHEN count(*) FILTER (WHERE value >= 60 AND k >= 20) * 10.0 >= 150 THEN 'PASS' ELSE 'FAIL' END AS autoclave,
  CASE WHEN count(*) FILTER (WHERE value BETWEEN 2 AND 150) / count(*) * 100 >= 95 THEN 'PASS' ELSE 'FAIL' END AS coldchain FROM s GROUP BY run_id""")
def g45(spark, sf):
    t = stats.truth_by_counts(samples(spark, sf), expr(THR), 600.0)
    return t


@query("g45_truth_by_positions", f"""WITH {S}, n AS (SELECT *, row_number() OVER {WIN} AS pos FROM s),
a AS (SELECT run_id, min(pos) FILTER (WHERE value <= 60) AS p0, min(pos) FILTER (WHERE value <= 20) AS p1, min(pos) FILTER (WHERE value <= 5) AS p2,
  count(*) FILTER (WHERE pos <= 40 AND value BETWEEN 2 AND 250 AND k >= 4) / count(*) FILTER (WHERE pos <= 40) * 100 AS lp FROM n GROUP BY run_id)
SELECT run_id, CASE WHEN coalesce((p1 - p0) * 36000 / 3600.0 <= 40, false) AND coalesce((p2 - p1) * 36000 / 3600.0 <= 80, false) THEN 'PASS' ELSE 'FAIL' END AS cooling,
  round(lp, 6) AS leading_pct, CASE WHEN lp >= 95 THEN 'PASS' ELSE 'FAIL' END AS concrete FROM a""")
def g45p(spark, sf):
    t = stats.truth_by_positions(timeline(spark, sf, "k"), (60.0, 20.0, 5.0), (40.0, 80.0), 36_000.0, 2.0, 250.0, 40, min_humidity=4.0)
    return t.withColumn("leading_pct", F.round("leading_pct", 6))


@query("s01_sorted_samples", f"WITH {S} SELECT run_id, seq, row_number() OVER {WIN} AS pos FROM s")
def s01(spark, sf):
    return holds.numbered(timeline(spark, sf)).rows().select("run_id", "seq", "pos")
