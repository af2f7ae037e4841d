"""From parsed readings to clean samples: the normalisation chain with its report (V0, U4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.functions.units import celsius_samples
from tempaudit.operators import curves
from tempaudit.operators.holds import as_col
from tempaudit.operators.timeline import Timeline, join_runs, keyed_join


def normalize(readings: DataFrame, max_period_s=300.0, allowed_gaps_s=60.0, step_s: int | None = 30, within_s=0.1,
              heuristic=False, units: DataFrame | None = None, industry: Column | None = None,
              duplicates_are_errors: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean samples of the runs that pass, and one report row per run.

    Long form: ``run_id, us, seq, sensor, value``.  Order and near-duplicates are judged per
    sensor; units per name; the quality gate per run.  A run with issues keeps its report and
    leaves no samples.  Concrete with a 300 s gap limit is exempt from the gap issue.
    """
    celsius = celsius_samples(readings, heuristic=heuristic, units=units)
    line = Timeline.open(celsius, key=["run_id", "sensor"])
    stepped = curves.with_step(line)
    near = F.col("dt").isNotNull() & (F.col("dt") <= within_s)
    kept = stepped.where(~near)
    before = stepped.rows().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("rows_in"), F.count_if(near).alias("near_duplicates"), F.count_if("converted").alias("converted_rows"))
    exempt = (industry == "concrete") & (as_col(allowed_gaps_s) == 300.0) if industry is not None else None
    per_sensor = curves.step_quality(kept.dropping("dt"), max_period_s, allowed_gaps_s, exempt)
    quality = per_sensor.groupBy("run_id").agg(
        F.sum("samples").alias("rows_kept"), F.max("max_step_s").alias("max_step_s"), F.sum("gaps").alias("gaps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("issues")))).alias("issues"))
    report = join_runs(before, quality)
    hard = (F.col("near_duplicates") > 0) & (duplicates_are_errors if duplicates_are_errors is not None else F.lit(False))
    issues = F.when(hard, F.array_append("issues", F.lit("duplicate_samples"))).otherwise(F.col("issues"))
    report = report.withColumn("issues", issues).withColumn(
        "status", F.when(F.size("issues") > 0, "ERROR").otherwise("OK")).withColumn(
        "trace", F.array_compact(F.array(
            F.lit("timestamps_utc"), F.lit("sorted"), F.when(F.col("near_duplicates") > 0, F.lit("near_duplicates_dropped")),
            F.when(F.col("converted_rows") > 0, F.lit("fahrenheit_converted")), F.lit("quality_checked"))))
    good = keyed_join(kept.rows(), report.filter("status = 'OK'").select("run_id"), "run_id", ["us", "seq"], "left_semi", readings)
    clean = good.select("run_id", "us", "seq", "sensor", "value")
    if step_s:
        resampled = curves.resample(kept.again(clean), step_s)
        done = resampled.select("run_id", "sensor").distinct()
        rest = keyed_join(clean, done, ["run_id", "sensor"], ["us", "seq"], "left_anti", readings)
        out = resampled.select("run_id", F.col("bucket_us").alias("us"), F.col("bucket_us").alias("seq"), "sensor", "value")
        clean = rest.unionByName(out)
    return clean, report
