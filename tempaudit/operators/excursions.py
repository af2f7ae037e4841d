"""Excursions outside a band and their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.operators.holds import _true, as_col, island_rows, mask
from tempaudit.operators.timeline import Timeline, following, join_runs, prev, seconds


def deviation(value: Column, lo, hi) -> Column:
    """Distance outside the band, 0 inside."""
    return F.greatest(value - as_col(hi), as_col(lo) - value, F.lit(0.0))


def severity(dev: Column) -> Column:
    """Class of a deviation; null up to 2 degrees."""
    return F.when(dev > 10, "critical").when(dev > 5, "high").when(dev > 2, "medium")


def outside(lo, hi, value="value") -> Column:
    return _true((F.col(value) < as_col(lo)) | (F.col(value) > as_col(hi)))


def excursion_islands(tl: Timeline, lo, hi, alarm_s=1800.0, value="value") -> DataFrame:
    """Stretches outside the band, ending at their last outside sample."""
    found = island_rows(mask(tl, outside(lo, hi, value)), "state",
                        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                        F.max(as_col(lo)).alias("_lo"), F.max(as_col(hi)).alias("_hi"))
    return found.filter("state").select(
        *tl.key, "island", "start_us", "end_us", "duration_s", "min_value", "max_value",
        (F.col("duration_s") >= alarm_s).alias("is_alarm"),
        (F.col("min_value") < F.col("_lo")).alias("below_range"), (F.col("max_value") > F.col("_hi")).alias("above_range"))


def excursion_totals(tl: Timeline, lo, hi, alarm_s=1800.0, value="value", reference_tail=False) -> DataFrame:
    """Totals per run.  ``reference_tail`` leaves an excursion open at the end of the data out of
    the maximum, the below/above times and the extremes."""
    events = excursion_islands(tl, lo, hi, alarm_s, value)
    bad = F.count_if(outside(lo, hi, value))
    base = tl.per_run(F.count(F.lit(1)).alias("samples"), bad.alias("samples_outside"), F.max("us").alias("_last"))
    counted, whole = events, F.lit(True)
    if reference_tail:
        counted, whole = tl.again(events, order=["island"]).join_run(base.select(*tl.key, "_last")).rows(), F.col("end_us") < F.col("_last")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("duration_s"))), F.lit(0.0))
    sums = counted.groupBy(*tl.key).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_alarm").alias("alarm_events"),
        total(F.lit(True)).alias("total_s"), F.coalesce(F.max(F.when(whole, F.col("duration_s"))), F.lit(0.0)).alias("max_s"),
        total(F.col("is_alarm")).alias("alarm_s"), total(whole & F.col("below_range")).alias("below_s"),
        total(whole & F.col("above_range")).alias("above_s"),
        F.min(F.when(whole & F.col("below_range"), F.col("min_value"))).alias("lowest"),
        F.max(F.when(whole & F.col("above_range"), F.col("max_value"))).alias("highest"))
    merged = join_runs(base.drop("_last"), sums, key=tl.key)
    return merged.fillna(0, ["events", "alarm_events"]).fillna(
        0.0, ["total_s", "max_s", "alarm_s", "below_s", "above_s"]
    ).withColumn("compliance_pct", (F.col("samples") - F.col("samples_outside")) / F.col("samples") * 100)


def band_features(tl: Timeline, lo, hi, alarm_s=1800.0, value="value") -> DataFrame:
    """What the storage rules need of a run, in one ordered pass: samples, excursions, time in range, span and extremes."""
    inside = F.col(value).between(as_col(lo), as_col(hi))
    line = tl.scan(_pu=prev("us")).with_columns(
        _in=F.when(inside, F.coalesce(seconds(F.col("us"), F.col("_pu")), F.lit(0.0))).otherwise(0.0)).dropping("_pu")
    islands = island_rows(mask(line, outside(lo, hi, value)), "state", F.sum("_in").alias("_in"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    out, spent = F.col("state"), F.col("duration_s")
    alarm = out & (spent >= alarm_s)
    none = F.lit(0).cast("long")
    return islands.groupBy(*tl.key).agg(
        F.sum("samples").alias("samples"), F.coalesce(F.sum(F.when(out, F.col("samples"))), none).alias("samples_outside"),
        F.count_if(out).alias("events"), F.count_if(alarm).alias("alarm_events"), F.coalesce(F.max(F.when(out, spent)), F.lit(0.0)).alias("max_s"),
        F.coalesce(F.sum(F.when(alarm, spent)), F.lit(0.0)).alias("alarm_s"), F.sum("_in").alias("in_range_s"),
        seconds(F.max("end_us"), F.min("start_us")).alias("duration_s"), F.min("_min").alias("min_temp"), F.max("_max").alias("max_temp"),
    ).withColumn("compliance_pct", (F.col("samples") - F.col("samples_outside")) / F.col("samples") * 100)


def closed_excursions(tl: Timeline, lo, hi, min_duration_s=0.0, value="value") -> DataFrame:
    """Excursions ending at the first sample back inside (or the end of data).

    ``severity`` follows the latest sample beyond 2 degrees, the first sample not counted;
    ``severity_worst`` is the worst of all samples.
    """
    dev = deviation(F.col(value), lo, hi)
    line = mask(tl, outside(lo, hi, value), "_out").with_columns(_dev=dev).scan(
        _next_us=following("us"), _was_out=prev(F.col("_out")))
    line = line.with_columns(
        _class=F.when(F.col("_out") & F.coalesce(F.col("_was_out"), F.lit(False)), severity(F.col("_dev"))))
    rows = line.islands("_out").rows().filter("_out")
    rank = F.struct("us", "seq")
    # highest class: compare through a number, name it afterwards
    level = F.when(F.col("_dev") > 10, 3).when(F.col("_dev") > 5, 2).when(F.col("_dev") > 2, 1).otherwise(0)
    events = rows.groupBy(*tl.key, "island").agg(
        F.min("us").alias("start_us"), F.max_by(F.coalesce("_next_us", "us"), rank).alias("end_us"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.coalesce(F.max_by("_class", F.when(F.col("_class").isNotNull(), rank)), F.lit("low")).alias("severity"),
        F.max(level).alias("_worst"))
    return events.select(
        *tl.key, "start_us", "end_us", seconds(F.col("end_us"), F.col("start_us")).alias("duration_s"),
        "min_value", "max_value", "severity",
        F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("_worst") + 1).alias("severity_worst"),
    ).filter(F.col("duration_s") >= min_duration_s)


def time_compliance(tl: Timeline, lo, hi, value="value") -> DataFrame:
    """Share of the run's duration spent inside the band, by closed excursions."""
    spent = closed_excursions(tl, lo, hi, 0.0, value).groupBy(*tl.key).agg(
        F.count(F.lit(1)).alias("excursions"), F.sum("duration_s").alias("excursion_s"))
    whole = tl.per_run(seconds(F.max("us"), F.min("us")).alias("duration_s"))
    joined = join_runs(whole, spent, key=tl.key).fillna(0, ["excursions"]).fillna(0.0, ["excursion_s"])
    return joined.withColumn("compliance_pct", F.when(
        F.col("duration_s") > 0, (F.col("duration_s") - F.col("excursion_s")) / F.col("duration_s") * 100).otherwise(0.0))


def time_in_range(tl: Timeline, lo, hi, value="value") -> DataFrame:
    """Sum of the steps that end at a sample inside the band."""
    stepped = tl.scan(_pu=prev("us"))
    inside = F.col(value).between(as_col(lo), as_col(hi))
    step = F.coalesce(seconds(F.col("us"), F.col("_pu")), F.lit(0.0))
    return stepped.with_columns(_in=F.when(inside, step).otherwise(0.0)).per_run(F.sum("_in").alias("in_range_s"))
