"""Slopes, crossings, phases, uniformity and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.operators.holds import as_col
from tempaudit.operators.timeline import Timeline, following, join_runs, last_seen, next_seen, prev, range_sums, seconds


def with_step(tl: Timeline) -> Timeline:
    """Seconds since the previous sample (null on the first)."""
    return tl.scan(_before_us=prev("us")).with_columns(dt=seconds(F.col("us"), F.col("_before_us"))).dropping("_before_us")


def drop_near_duplicates(tl: Timeline, within_s=0.1) -> Timeline:
    """Drop rows at most ``within_s`` after the previous row."""
    return with_step(tl).where(F.col("dt").isNull() | (F.col("dt") > within_s))


def step_quality(tl: Timeline, max_period_s, allowed_gaps_s, exempt_gap=None) -> DataFrame:
    """Sampling checks per run with the list of issues found; limits are strict."""
    max_p, gap = as_col(max_period_s), as_col(allowed_gaps_s)
    stepped = with_step(tl).with_columns(_period=max_p, _gap=gap)
    found = stepped.per_run(
        F.count(F.lit(1)).alias("samples"), F.max("dt").alias("max_step_s"),
        F.count_if(F.col("dt") > F.col("_gap")).alias("gaps"),
        F.count_if(F.col("dt") == 0).alias("duplicates"),
        F.count_if(F.col("dt") < 0).alias("backward_steps"),
        F.max("_period").alias("_period"), F.max("_gap").alias("_gap"),
    )
    exempt = as_col(exempt_gap) if exempt_gap is not None else F.lit(False)
    issues = F.array_compact(F.array(
        F.when(F.col("samples") < 2, F.lit("too_few_samples")),
        F.when(F.col("backward_steps") > 0, F.lit("not_monotonic")),
        F.when(F.col("max_step_s") > F.col("_period"), F.lit("period_too_long")),
        F.when((F.col("gaps") > 0) & ~exempt, F.lit("gaps")),
        F.when(F.col("duplicates") > 0, F.lit("duplicate_timestamps")),
    ))
    return found.withColumn("issues", issues).drop("_period", "_gap")


def backward_ramp(tl: Timeline, value="value") -> Timeline:
    """Rate of change against the previous sample, per minute; 0 on the first row."""
    v = F.col(value)
    stepped = tl.scan(_pv=prev(value), _pu=prev("us"))
    dt = seconds(F.col("us"), F.col("_pu"))
    rate = F.when(F.col("_pu").isNull(), 0.0).when(dt > 0, (v - F.col("_pv")) / dt * 60)
    return stepped.with_columns(ramp=rate).dropping("_pv", "_pu")


def max_backward_ramp(tl: Timeline, value="value") -> DataFrame:
    return backward_ramp(tl, value).per_run(F.max("ramp").alias("max_ramp"))


def max_central_ramp(tl: Timeline, value="value") -> DataFrame:
    """Largest central difference per minute over interior points, 0 if there is none."""
    around = tl.scan(_pv=prev(value), _pu=prev("us"), _nv=following(value), _nu=following("us"))
    dt = seconds(F.col("_nu"), F.col("_pu"))
    rate = F.when(dt > 0, (F.col("_nv") - F.col("_pv")) / dt * 60)
    return around.with_columns(_r=rate).per_run(F.coalesce(F.max("_r"), F.lit(0.0)).alias("max_ramp"))


def crossing(tl: Timeline, target, direction="cooling", value="value", name="cross_s") -> DataFrame:
    """Seconds from the start to the first linearly interpolated crossing of the target; null if none."""
    v, target = F.col(value), as_col(target)
    ahead = tl.scan(_nv=following(value), _nu=following("us")).with_columns(_t=target.cast("double"))
    t, nv = F.col("_t"), F.col("_nv")
    hit = (v >= t) & (nv <= t) if direction == "cooling" else (v <= t) & (nv >= t)
    share = F.when(nv == v, 0.0).otherwise((t - v) / (nv - v))
    at = F.when(hit, F.col("us") + share * (F.col("_nu") - F.col("us")))
    return ahead.with_columns(_at=at).per_run(seconds(F.min("_at"), F.min("us")).alias(name))


def cooling_rate(tl: Timeline, start, end, value="value") -> DataFrame:
    """Mean degrees per hour between two crossings; null unless the second comes later."""
    a, b = crossing(tl, start, "cooling", value, "_a"), crossing(tl, end, "cooling", value, "_b")
    rate = (as_col(start) - as_col(end)) / ((F.col("_b") - F.col("_a")) / 3600)
    return join_runs(a, b, key=tl.key).select(*tl.key, F.when(F.col("_b") > F.col("_a"), rate).alias("cooling_rate_per_h"))


def heating_check(tl: Timeline, tolerance=2.0, value="value") -> DataFrame:
    """Largest rise between neighbours and whether it exceeds the tolerance."""
    rises = tl.scan(_pv=prev(value)).with_columns(_rise=F.col(value) - F.col("_pv"))
    return rises.per_run(F.max("_rise").alias("max_rise")).withColumn(
        "heating_detected", F.coalesce(F.col("max_rise") > tolerance, F.lit(False)))


def with_gas_phase(tl: Timeline, lo=50.0, hi=60.0, value="value", gas="k") -> Timeline:
    """Rows with their run's sterilisation phase: first sample in range up to the first later gas drop below 10 % of the median."""
    line = tl.attach_quantile(gas, 0.5, "gas_median").attach(
        phase_start_us=F.min(F.when(F.col(value).between(lo, hi), F.col("us"))), run_start_us=F.min("us"), run_end_us=F.max("us"))
    line = line.attach(first_drop_us=F.min(F.when(F.col(gas) < F.col("gas_median") * 0.1, F.col("us"))))
    end = F.when(F.col("first_drop_us") > F.col("phase_start_us"), F.col("first_drop_us")).otherwise(F.col("run_end_us"))
    return line.with_columns(phase_end_us=F.when(F.col("phase_start_us").isNotNull(), end))


def gas_phases(tl: Timeline, lo=50.0, hi=60.0, value="value", gas="k") -> DataFrame:
    """The phase of each run."""
    names = ("phase_start_us", "run_start_us", "run_end_us", "gas_median", "first_drop_us", "phase_end_us")
    return with_gas_phase(tl, lo, hi, value, gas).per_run(*[F.first(n).alias(n) for n in names])


def in_phase() -> Column:
    """Rows of the half-open sterilisation phase."""
    return (F.col("us") >= F.col("phase_start_us")) & (F.col("us") < F.col("phase_end_us"))


def rolling_uniformity(tl: Timeline, half_width_s=1800.0, value="value", min_points=3) -> DataFrame:
    """Mean of the population deviation over windows centred on each sample.

    Windows are differences of running sums (see ``range_sums``); values are centred on the run
    mean first, so that little is lost to cancellation.
    """
    half = int(half_width_s * 1_000_000)
    centred = tl.attach(_m=F.avg(value)).with_columns(_x=F.col(value) - F.col("_m"))
    w = range_sums(centred, half, half, {"_n": F.lit(1), "_s": F.coalesce("_x", F.lit(0.0)),
                                         "_q": F.coalesce(F.col("_x") * F.col("_x"), F.lit(0.0))})
    variance = F.greatest(F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), 2), F.lit(0.0))
    kept = F.when(F.col("_n") >= min_points, F.sqrt(variance))
    return w.groupBy(*tl.key).agg(F.avg(kept).alias("uniformity"), F.count(kept).alias("windows"))


def _buckets(tl: Timeline, step_s: int, value="value") -> DataFrame:
    """Mean of each bucket that holds a sample.

    Buckets start at midnight of the run's first day, which is the epoch grid where the step
    divides a day.
    """
    step, day = step_s * 1_000_000, 86_400_000_000
    if 86_400 % step_s == 0:
        placed = tl.with_columns(bucket_us=F.expr(f"us - pmod(us, {step}L)"))
    else:
        placed = tl.attach(_o=F.min("us")).with_columns(bucket_us=F.expr(f"us - pmod(us - _o + pmod(_o, {day}L), {step}L)"))
    return placed.rows().groupBy(*tl.key, "bucket_us").agg(F.avg(value).alias("mean_value"))


def _with_gaps(rows: DataFrame, step_s: int) -> DataFrame:
    """Each bucket followed by the empty cells up to the next one (``_next_us``), as rows with the cell's instant ``at_us``.

    Two levels, so that no row ever carries a long gap as one array.
    """
    step = step_s * 1_000_000
    block = step * 4096
    to = f"coalesce(_next_us - {step}L, bucket_us)"
    blocks = rows.withColumn("_b", F.explode(F.expr(f"sequence(bucket_us, {to}, {block}L)")))
    cells = F.explode(F.expr(f"sequence(_b, least({to}, _b + {block - step}L), {step}L)"))
    return blocks.withColumn("at_us", cells).drop("_b")


def grid(tl: Timeline, step_s: int, value="value") -> DataFrame:
    """Bucket means on a regular grid from each run's first bucket to its last, empty cells included.

    Cells between two buckets are made where they are missing; no grid is built apart and joined.
    """
    line = tl.again(_buckets(tl, step_s, value), order=["bucket_us"]).scan(_next_us=following("bucket_us"))
    own = F.col("at_us") == F.col("bucket_us")
    return _with_gaps(line.rows(), step_s).select(
        *tl.key, F.col("at_us").alias("bucket_us"), F.when(own, F.col("mean_value")).alias("mean_value"))


def resample(tl: Timeline, step_s: int, value="value", force=False, fill_limit=2) -> DataFrame:
    """Fixed-step series: bucket means, forward fill up to ``fill_limit`` buckets, then time interpolation.

    Runs whose median step is outside [1.15 step, 2 step] are left out unless ``force``.  One ordered pass over the buckets finds
    what each gap lies between; its cells are filled as they are made.
    """
    step = step_s * 1_000_000
    wanted = tl
    if not force:
        wanted = with_step(tl).attach_quantile("dt", 0.5, "_median").where(F.col("_median").between(1.15 * step_s, 2.0 * step_s)).dropping("dt", "_median")
    line = tl.again(_buckets(wanted, step_s, value), order=["bucket_us"])
    known = F.struct(F.col("bucket_us").alias("at"), F.col("mean_value").alias("v"))
    seen = F.when(F.col("mean_value").isNotNull(), known)
    line = line.scan(_p=last_seen(seen), _n=next_seen(seen), _next_us=following("bucket_us")).scan(_later=following("_n"))
    cells = _with_gaps(line.rows(), step_s)
    at, after = F.col("at_us"), F.when(F.col("at_us") == F.col("bucket_us"), F.col("_n")).otherwise(F.col("_later"))
    cells = cells.withColumn("_n", after)
    ffilled = F.when(at - F.col("_p.at") <= fill_limit * step, F.col("_p.v"))
    # interpolation runs between the last forward-filled cell and the next known one
    left_at = F.col("_p.at") + fill_limit * step
    share = (at - left_at) / (F.col("_n.at") - left_at)
    between = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * share
    filled = F.coalesce(ffilled, between, F.col("_p.v"), F.col("_n.v"))
    return cells.select(*tl.key, at.alias("bucket_us"), filled.alias(value))
