"""Combining and selecting sensors in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempaudit.operators.holds import as_col
from tempaudit.operators.timeline import Timeline, join_runs, keyed_join


def combine(df: DataFrame, mode="min", key=("run_id", "us"), value="value", threshold=None, require_at_least=None) -> DataFrame:
    """One reading per instant.  ``min``/``mean`` skip missing values; ``majority`` gives a boolean."""
    valid = F.count(value)
    if mode == "min":
        out = F.min(value)
    elif mode == "mean":
        out = F.avg(value)
    elif mode == "median":
        # exact median of three or more readings, else the mean; ranked when an instant is huge
        middle = Timeline.open(df, key, [value]).quantile(value, 0.5, "_median")
        few = df.groupBy(*key).agg(F.avg(value).alias("_mean"), valid.alias("n_valid"))
        return join_runs(few, middle, key=key).select(
            *key, F.when(F.col("n_valid") >= 3, F.col("_median")).otherwise(F.col("_mean")).alias("combined"), "n_valid")
    elif mode == "majority":
        above = F.count_if(F.col(value) >= as_col(threshold))
        out = above >= require_at_least if require_at_least else above > valid / 2
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.groupBy(*key).agg(out.alias("combined"), valid.alias("n_valid"))


def too_few_valid(combined: DataFrame, k: int, key=("run_id",)) -> DataFrame:
    """Instants with fewer than ``k`` valid sensors, counted per run."""
    return combined.groupBy(*key).agg(F.count_if(F.col("n_valid") < k).alias("bad_samples")).withColumn(
        "error", F.when(F.col("bad_samples") > 0, F.format_string("%d samples below %d valid sensors", "bad_samples", F.lit(k))))


def combine_positions(df: DataFrame, arrays: str, key: str, method="average") -> DataFrame:
    """Combine lists of readings aligned by position."""
    agg = {"average": F.avg, "min": F.min, "max": F.max}[method]
    return df.select(key, F.posexplode(arrays).alias("pos", "reading")).groupBy(key, "pos").agg(agg("reading").alias("combined"))


def live_sensors(df: DataFrame, key=("run_id",), value="value") -> DataFrame:
    """Valid readings per sensor; a sensor without any is dead."""
    return df.groupBy(*key, "sensor").agg(F.count(value).alias("n_valid"))


def drop_dead_sensors(df: DataFrame, key=("run_id",), value="value") -> DataFrame:
    dead = live_sensors(df, key, value).filter("n_valid = 0")
    return keyed_join(df, dead.select(*key, "sensor"), [*key, "sensor"], ["us", value], "left_anti")


def dead_sensor_report(df: DataFrame, key=("run_id",), value="value") -> DataFrame:
    live = F.col("n_valid") > 0
    return live_sensors(df, key, value).groupBy(*key).agg(
        F.count_if(live).alias("live"), F.count_if(~live).alias("dead"),
    ).withColumn("status", F.when(F.col("live") == 0, "ERROR").when(F.col("dead") > 0, "WARNING").otherwise("OK"))


def select_with_fallback(df: DataFrame, wanted: DataFrame, key=("run_id",)) -> DataFrame:
    """Keep the listed sensors that exist; where none does keep all and set ``fallback_used``."""
    flags = lambda rows, here, listed: rows.select(*key, "sensor", F.lit(here).alias("_here"), F.lit(listed).alias("_listed"))
    known = flags(df, True, False).unionByName(flags(wanted, False, True)).groupBy(*key, "sensor").agg(
        F.bool_or("_here").alias("_here"), F.bool_or("_listed").alias("_listed"))
    run = Window.partitionBy(*key)
    judged = known.withColumns({"_any": F.bool_or("_listed").over(run), "_hit": F.bool_or(F.col("_listed") & F.col("_here")).over(run)})
    fallback = F.col("_any") & ~F.col("_hit")
    chosen = judged.filter(F.col("_here") & (F.col("_listed") | ~F.col("_hit"))).select(*key, "sensor", fallback.alias("fallback_used"))
    return keyed_join(df, chosen, [*key, "sensor"], ["us", "value"])


def selection_issues(df: DataFrame, wanted: DataFrame, require_at_least: int, key=("run_id",)) -> DataFrame:
    """Strict selection: none of the listed sensors present is an error, too few an issue."""
    sensors = df.select(*key, "sensor").distinct()
    found = wanted.join(sensors.withColumn("_have", F.lit(1)), [*key, "sensor"], "left").groupBy(*key).agg(
        F.count("_have").alias("found"))
    return found.withColumn("issues", F.array_compact(F.array(
        F.when(F.col("found") == 0, F.lit("none of the listed sensors found")),
        F.when((F.col("found") > 0) & (F.col("found") < require_at_least), F.lit("fewer sensors than required")))))


def required_signals(df: DataFrame, required, key=("run_id",)) -> DataFrame:
    """Missing signals per run; any missing one makes the run INDETERMINATE."""
    available = df.groupBy(*key, "sensor").agg(F.lit(1).alias("_one")).groupBy(*key).agg(
        F.array_sort(F.collect_list("sensor")).alias("available"))
    missing = F.array_sort(F.array_except(required, F.col("available")))
    return available.withColumn("missing", missing).withColumn(
        "status", F.when(F.size("missing") > 0, "INDETERMINATE").otherwise("OK"))
