"""Differential checks and corpus summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempaudit.functions.scalars import join_reasons, tolerance_check
from tempaudit.operators.holds import _true, as_col
from tempaudit.operators.recipes import Recipe, Round, after, longest_stretch, stretch_rounds, together
from tempaudit.operators.stats import order_statistic
from tempaudit.operators.timeline import following, last_seen, prev, seconds
from tempaudit.session import small_table

CLASSES = ("PASS", "FAIL", "ERROR", "INDETERMINATE")

# fixed values: absolute tolerance by industry and metric
TOLERANCES = (
    ("powder", "hold_time_s", 1.0), ("powder", "ramp_rate_C_per_min", 0.05), ("powder", "time_to_threshold_s", 1.0),
    ("autoclave", "fo_value", 0.1), ("autoclave", "hold_time_s", 1.0),
    ("sterile", "phase_times_s", 60.0),
    ("haccp", "phase1_time_s", 30.0), ("haccp", "phase2_time_s", 30.0),
    ("concrete", "percent_in_spec_24h", 1.0), ("concrete", "temperature_time_hours", 0.1),
    ("coldchain", "overall_compliance_pct", 0.5), ("coldchain", "excursion_duration_s", 1.0),
)


def tolerance_table(spark: SparkSession) -> DataFrame:
    return small_table(spark, list(TOLERANCES), "industry string, metric string, tolerance double")


def unpivot_metrics(df: DataFrame, metrics: list[str], keep=("run_id", "industry"), name="engine") -> DataFrame:
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return df.selectExpr(*keep, f"stack({len(metrics)}, {pairs}) AS (metric, {name})")


def metric_differences(engine: DataFrame, independent: DataFrame, tolerances: DataFrame, default_relative=0.05,
                       exact_below=None, key=("run_id", "industry")) -> DataFrame:
    """Engine and independent metrics side by side; a metric one side lacks is not within tolerance."""
    return judged_pairs(engine.join(independent, [*key, "metric"], "full_outer"), tolerances, default_relative, exact_below, key)


def judged_pairs(both: DataFrame, tolerances: DataFrame, default_relative=0.05, exact_below=None, key=("run_id", "industry")) -> DataFrame:
    """Rows of ``metric``, ``engine``, ``independent`` judged by the tolerance of their industry and metric."""
    judged = both.join(F.broadcast(tolerances), ["industry", "metric"], "left")
    check = tolerance_check(F.col("engine"), F.col("independent"), F.col("tolerance"), default_relative, exact_below)
    return judged.withColumn("_c", check).select(
        *key, "metric", "engine", "independent", "tolerance", "_c.difference", "_c.relative_error", "_c.within_tolerance",
        "_c.tolerance_type")


def hold_and_ramp(threshold, hysteresis, value="value", p="_hr_") -> Recipe:
    """Hold time and largest ramp twice, in one pass: by the engine's way (latch, backward differences) as ``engine_hold`` and
    ``engine_ramp``, and independently (band, central differences) as ``other_hold`` and ``other_ramp``."""
    v, on = F.col(value), as_col(threshold)
    off = on - as_col(hysteresis)
    before, around = seconds(F.col("us"), F.col(f"{p}pu")), seconds(F.col(f"{p}nu"), F.col(f"{p}pu"))
    start = Round({f"{p}seen": last_seen(F.when(v >= on, True).when(v < off, False)), f"{p}pv": prev(value), f"{p}pu": prev("us"),
                   f"{p}nv": following(value), f"{p}nu": following("us")})
    latched = after(start, stretch_rounds(_true(F.col(f"{p}seen")), p, "latch_"))
    rounds = together(latched, stretch_rounds(_true(v >= off), p, "band_"))
    backward = F.when(F.col(f"{p}pu").isNull(), 0.0).when(before > 0, (v - F.col(f"{p}pv")) / before * 60)
    central = F.when(around > 0, (F.col(f"{p}nv") - F.col(f"{p}pv")) / around * 60)
    return Recipe(p, rounds, {
        "engine_hold": longest_stretch(p, "latch_"), "engine_ramp": F.max(backward), "other_hold": longest_stretch(p, "band_"),
        "other_ramp": F.coalesce(F.max(central), F.lit(0.0))})


def paired_metrics(df: DataFrame, pairs: dict[str, tuple[Column, Column]], keep=("run_id", "industry")) -> DataFrame:
    """One row per metric from runs that hold both sides."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), a.cast("double").alias("engine"), b.cast("double").alias("independent"))
                     for m, (a, b) in pairs.items()])
    return df.select(*keep, F.explode(rows).alias("_m")).select(*keep, "_m.*")


def shadow_status(differences: DataFrame, key=("run_id", "industry")) -> DataFrame:
    """One row per run: AGREEMENT, TOLERANCE_VIOLATION or, with nothing to compare, INDEPENDENT_ERROR.

    The reason lists the violating metrics; a run has a fixed handful of them.  Columns of the run may go along in ``key``.
    """
    comparable = F.col("engine").isNotNull() & F.col("independent").isNotNull()
    bad = comparable & ~F.col("within_tolerance")
    return differences.groupBy(*key).agg(
        F.count_if(comparable).alias("compared"), F.count_if(bad).alias("violations"),
        F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("metric")))), ",").alias("reason"),
    ).withColumn("shadow_status", F.when(F.col("compared") == 0, "INDEPENDENT_ERROR").when(
        F.col("violations") > 0, "TOLERANCE_VIOLATION").otherwise("AGREEMENT"))


def final_status(status: Column, shadow: Column) -> Column:
    """A verdict whose shadow comparison violates a tolerance is undecided."""
    return F.when(shadow == "TOLERANCE_VIOLATION", F.lit("INDETERMINATE")).otherwise(status)


def downgrade(verdicts: DataFrame, shadow: DataFrame, key="run_id") -> DataFrame:
    """``final_status`` of verdicts that are kept apart from their shadow comparison."""
    joined = verdicts.join(shadow.select(key, "shadow_status"), key, "left")
    return joined.withColumn("final_status", final_status(F.col("status"), F.col("shadow_status")))


def replay_check(original: DataFrame, again: DataFrame, exact: list[str], close: list[str], tolerance=0.1, key="run_id") -> DataFrame:
    """Recomputed decisions against stored ones: exact fields, close fields, reasons both ways."""
    a, b = original.alias("a"), again.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"))
    parts = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"{c} mismatch")) for c in exact]
    parts += [F.when(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tolerance, F.lit(f"{c} difference")) for c in close]
    lost, extra = F.array_except("a.codes", "b.codes"), F.array_except("b.codes", "a.codes")
    parts += [F.when(F.size(lost) > 0, F.concat(F.lit("missing reasons "), F.array_join(F.array_sort(lost), ","))),
              F.when(F.size(extra) > 0, F.concat(F.lit("extra reasons "), F.array_join(F.array_sort(extra), ",")))]
    return joined.select(F.col(f"a.{key}").alias(key), join_reasons(*parts).alias("discrepancies")).withColumn(
        "matches", F.size("discrepancies") == 0)


def decision_digest(df: DataFrame, columns: list[str]) -> Column:
    """16 hex digits over the decision as JSON with sorted field names."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256), 1, 16)


def golden_check(decisions: DataFrame, golden: DataFrame, columns: list[str], key="run_id") -> DataFrame:
    fresh = decisions.select(key, decision_digest(decisions, columns).alias("digest"))
    return fresh.join(golden.select(key, F.col("digest").alias("golden")), key, "left").withColumn(
        "state", F.when(F.col("golden").isNull(), "NEW").when(F.col("golden") == F.col("digest"), "MATCH").otherwise("CHANGED"))


def match_outcomes(registry: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """Expected against actual; a dataset without an outcome counts as ERROR."""
    return registry.join(outcomes, key, "left").withColumn("actual", F.coalesce("actual", F.lit("ERROR"))).withColumn(
        "mismatch", F.col("expected") != F.col("actual"))


def confusion_2x2(df: DataFrame, by: str) -> DataFrame:
    """Counts and rates per group; every class but PASS is negative; 0 where a rate has no cases."""
    e, a = F.col("expected") == "PASS", F.col("actual") == "PASS"
    c = df.groupBy(by).agg(F.count_if(e & a).alias("tp"), F.count_if(~e & a).alias("fp"),
                           F.count_if(~e & ~a).alias("tn"), F.count_if(e & ~a).alias("fn"))
    rate = lambda num, den: F.coalesce(num / F.nullif(den, F.lit(0)) * 100, F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"accuracy": rate(tp + tn, tp + fp + tn + fn), "precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn)})


def confusion_4x4(spark: SparkSession, df: DataFrame) -> DataFrame:
    """All sixteen cells, zero ones too, each with the overall accuracy as a fraction."""
    counts = df.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("_n"))
    cells = small_table(spark, [(e, a) for e in CLASSES for a in CLASSES], "expected string, actual string")
    filled = cells.join(counts, ["expected", "actual"], "left")
    every = Window.partitionBy(F.lit(1))  # sixteen rows
    hit = F.sum(F.when(F.col("expected") == F.col("actual"), F.col("_n"))).over(every)
    return filled.select(
        "expected", "actual", F.coalesce("_n", F.lit(0).cast("long")).alias("n"),
        F.coalesce(hit / F.nullif(F.sum("_n").over(every), F.lit(0)), F.lit(0.0)).alias("accuracy"))


def timing_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, extremes and the element n/2 of the sorted times."""
    middle = order_statistic(df, value, F.floor(F.col("_n") / 2), "median_value", [by])
    return df.groupBy(by).agg(F.avg(value).alias("mean_value"), F.max(value).alias("max_value"), F.min(value).alias("min_value")).join(middle, by)


def differential_summary(df: DataFrame, by="industry") -> DataFrame:
    """Totals overall (null group) and by industry in one grouping-sets pass."""
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome") != "ERROR").alias("success"),
        F.count_if(F.col("outcome") == "ERROR").alias("errors"),
        F.count_if(F.coalesce("within_tolerance", F.lit(False))).alias("within"))


def match_summary(df: DataFrame) -> DataFrame:
    e, a = F.col("expected"), F.col("actual")
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(a == "PASS").alias("passes"), F.count_if(a == "FAIL").alias("fails"),
        F.count_if(e == a).alias("matches"), F.round(F.coalesce(F.count_if(e == a) / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, F.lit(0.0)), 1).alias("match_rate"))


def status_counts(df: DataFrame, status="status") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == c).alias(c.lower()) for c in CLASSES])


def entry_audit(df: DataFrame) -> DataFrame:
    """Registry entry: expected outcome against data quality and independent feasibility.

    Columns ``expected``, ``duplicates``, ``missing``, ``quality_ok``, ``feasible``.
    """
    e = F.col("expected")
    clean = (F.col("duplicates") == 0) & (F.col("missing") == 0) & F.col("quality_ok")
    dirty = (F.col("duplicates") > 0) | ~F.col("quality_ok")
    definite = e.isin("PASS", "FAIL")
    warnings = join_reasons(
        F.when((e == "ERROR") & clean, F.lit("error_expected_but_clean")),
        F.when(definite & dirty, F.lit("quality_issues")),
        F.when((e == "PASS") & ~F.col("feasible"), F.lit("independent_says_fail")),
        F.when((e == "FAIL") & F.col("feasible"), F.lit("independent_says_pass")))
    return df.withColumn("warnings", warnings).withColumn(
        "audit", F.when(F.size("warnings") > 0, "warning").otherwise("passed"))


def metric_audit(df: DataFrame) -> DataFrame:
    """Expected metrics against computed ones; a missing side leaves the check open (null)."""
    return df.withColumns({
        "f0_ok": F.abs(F.col("f0") - F.col("expected_f0")) / F.col("expected_f0") <= 0.15,
        "hold_ok": F.abs(F.col("hold_s") - F.col("expected_hold_s")) <= 300,
        "max_ok": F.abs(F.col("max_temp") - F.col("expected_max")) <= 2.0,
    }).withColumn("checked", sum((F.col(c).isNotNull().cast("int") for c in ("f0_ok", "hold_ok", "max_ok")), F.lit(0))).withColumn(
        "metrics_ok", F.coalesce("f0_ok", F.lit(True)) & F.coalesce("hold_ok", F.lit(True)) & F.coalesce("max_ok", F.lit(True)))


def disagreement(expected: Column, actual: Column) -> Column:
    vague, firm = ("ERROR", "INDETERMINATE"), ("PASS", "FAIL")
    return (
        F.when(expected == actual, None)
        .when((expected == "PASS") & (actual == "FAIL"), "failed a case that should pass")
        .when((expected == "FAIL") & (actual == "PASS"), "passed a case that should fail")
        .when(expected.isin(*vague) & actual.isin(*firm), F.concat(F.lit("definitive "), actual, F.lit(" for an uncertain case")))
        .when(expected.isin(*firm) & actual.isin(*vague), F.concat(F.lit("uncertain "), actual, F.lit(" for a definitive case")))
        .otherwise(F.concat(F.lit("expected "), expected, F.lit(", got "), actual)))
