"""Hold operators: latches, islands, longest and cumulative holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.operators.timeline import Timeline, join_runs, last_seen, position, prev, run_max, run_sum, seconds


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _true(cond: Column) -> Column:
    """A missing reading satisfies no condition."""
    return F.coalesce(cond, F.lit(False))


def latch(tl: Timeline, on, hysteresis, value="value", name="state") -> Timeline:
    """On at ``value >= on``, off at ``value < on - hysteresis``, otherwise unchanged."""
    v, on, off = F.col(value), as_col(on), as_col(on) - as_col(hysteresis)
    decided = F.when(v >= on, True).when(v < off, False)
    return tl.scan(**{name: last_seen(decided)}).with_columns(**{name: _true(F.col(name))})


def mask(tl: Timeline, cond: Column, name="state") -> Timeline:
    return tl.with_columns(**{name: _true(cond)})


def island_rows(tl: Timeline, state="state", *extra: Column) -> DataFrame:
    """One row per maximal stretch of equal state; merges partial aggregates, whatever its length."""
    done = tl.islands(state)
    return done.rows().groupBy(*tl.key, "island", state).agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("samples"), *extra
    ).withColumn("duration_s", seconds(F.col("end_us"), F.col("start_us")))


def longest(islands: DataFrame, state="state", key=("run_id",), prefix="hold") -> DataFrame:
    """Longest true stretch per run; of equal ones the first; 0 and nulls where there is none."""
    held = F.col(state) & (F.col("duration_s") > 0)
    best = F.max_by(
        F.struct("duration_s", "start_us", "end_us"), F.when(held, F.struct("duration_s", -F.col("start_us")))
    )
    return islands.groupBy(*key).agg(best.alias("_b")).select(
        *key,
        F.coalesce(F.col("_b.duration_s"), F.lit(0.0)).alias(f"{prefix}_s"),
        F.col("_b.start_us").alias(f"{prefix}_start_us"),
        F.col("_b.end_us").alias(f"{prefix}_end_us"),
    )


def latched_hold(tl: Timeline, threshold, hysteresis=2.0, value="value") -> DataFrame:
    """Longest continuous hold with a hysteresis latch."""
    return longest(island_rows(latch(tl, threshold, hysteresis, value)), key=tl.key)


def band_hold(tl: Timeline, threshold, hysteresis=2.0, value="value") -> DataFrame:
    """Longest stretch at or above ``threshold - hysteresis``, no latch."""
    return longest(island_rows(mask(tl, F.col(value) >= as_col(threshold) - as_col(hysteresis))), key=tl.key)


def boolean_hold(tl: Timeline, cond: Column, max_dips_s=0.0) -> DataFrame:
    """Longest and cumulative true time; cumulative is 0 when the false time exceeds the allowance."""
    time_in = lambda flag: F.coalesce(F.sum(F.when(F.col("state") == flag, F.col("duration_s"))), F.lit(0.0))
    return island_rows(mask(tl, cond)).groupBy(*tl.key).agg(
        F.coalesce(F.max(F.when(F.col("state"), F.col("duration_s"))), F.lit(0.0)).alias("longest_s"),
        F.when(time_in(False) > as_col(max_dips_s), 0.0).otherwise(time_in(True)).alias("cumulative_s"),
    )


def budget_islands(tl: Timeline, threshold, max_dips_s, value="value") -> DataFrame:
    """Above-threshold stretches that count under a dip budget.

    Dips are used up in time order; the first dip that does not fit ends the counting.
    """
    islands = island_rows(mask(tl, F.col(value) >= as_col(threshold)))
    dip = F.when(~F.col("state"), F.col("duration_s")).otherwise(0.0)
    over = tl.again(islands, order=["island"]).scan(_used=run_sum(dip))
    over = over.with_columns(_over=(F.col("_used") > as_col(max_dips_s)).cast("int")).scan(_stopped=run_max("_over"))
    return over.rows().filter(F.col("state")).withColumn("counts", F.col("_stopped") == 0).drop("_used", "_over", "_stopped")


def budget_hold(tl: Timeline, threshold, max_dips_s, value="value") -> DataFrame:
    """Cumulative hold with a dip budget."""
    counted = budget_islands(tl, threshold, max_dips_s, value).filter("counts").groupBy(*tl.key).agg(
        F.sum("duration_s").alias("cumulative_s"), F.count(F.lit(1)).alias("intervals"))
    every = tl.per_run(F.count(F.lit(1)).alias("samples"))
    return join_runs(every, counted, key=tl.key).select(
        *tl.key, F.coalesce("cumulative_s", F.lit(0.0)).alias("cumulative_s"),
        F.coalesce("intervals", F.lit(0).cast("long")).alias("intervals"))


def step_hold(tl: Timeline, threshold, max_dips_s, value="value") -> DataFrame:
    """Cumulative hold by steps: each sample owns the step before it; excess dip time is taken off."""
    above = _true(F.col(value) >= as_col(threshold))
    stepped = tl.scan(_b=prev("us")).with_columns(_dt=F.coalesce(seconds(F.col("us"), F.col("_b")), F.lit(0.0)))
    gross, dips = F.sum(F.when(above, F.col("_dt")).otherwise(0.0)), F.sum(F.when(~above, F.col("_dt")).otherwise(0.0))
    allowed = F.max(as_col(max_dips_s))
    return stepped.per_run(
        F.when(dips > allowed, F.greatest(F.lit(0.0), gross - (dips - allowed))).otherwise(gross).alias("cumulative_s"))


def latched_total(tl: Timeline, threshold, hysteresis=2.0, value="value") -> DataFrame:
    """Sum of all latched stretches."""
    return island_rows(latch(tl, threshold, hysteresis, value)).groupBy(*tl.key).agg(
        F.coalesce(F.sum(F.when(F.col("state"), F.col("duration_s"))), F.lit(0.0)).alias("cumulative_s"))


def time_to_threshold(tl: Timeline, threshold, value="value") -> DataFrame:
    """Seconds from the first sample to the first one at or above the threshold; null if never."""
    first = F.min(F.when(F.col(value) >= as_col(threshold), F.col("us")))
    return tl.per_run(seconds(first, F.min("us")).alias("time_to_threshold_s"))


def final_hold(tl: Timeline, target, value="value") -> DataFrame:
    """Time from the first sample at or below the target to the end of the run."""
    first = F.min(F.when(F.col(value) <= as_col(target), F.col("us")))
    return tl.per_run(F.coalesce(seconds(F.max("us"), first), F.lit(0.0)).alias("final_hold_s"))


def consecutive_good(tl: Timeline, cond: Column, count: int) -> DataFrame:
    """Whether ``count`` samples in a row satisfy the condition."""
    streaks = island_rows(mask(tl, cond))
    return streaks.groupBy(*tl.key).agg(
        F.coalesce(F.max(F.when(F.col("state"), F.col("samples"))), F.lit(0)).alias("longest_streak")
    ).withColumn("exposure_met", F.col("longest_streak") >= count)


def hold_intervals(tl: Timeline, threshold, hysteresis, continuous: bool, max_dips_s=0.0, value="value") -> DataFrame:
    """Intervals to mark on a chart: the longest latched one, or all that count under the dip budget."""
    if continuous:
        best = latched_hold(tl, threshold, hysteresis, value).filter("hold_s > 0")
        return best.select(*tl.key, F.col("hold_start_us").alias("start_us"), F.col("hold_end_us").alias("end_us"))
    return budget_islands(tl, threshold, max_dips_s, value).filter("counts").select(*tl.key, "start_us", "end_us")


def numbered(tl: Timeline, name="pos") -> Timeline:
    return tl.scan(**{name: position()})
