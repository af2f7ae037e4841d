"""Per-run statistics.

Everything here that needs no order is one partial aggregation, so a run of any length is
reduced before the shuffle.  Lag-based measures go through :class:`Timeline`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempaudit.operators.curves import in_phase, with_step
from tempaudit.operators.holds import _true, as_col, latch
from tempaudit.operators.timeline import Timeline, _join_null_safe, following, position, prev, run_sum, seconds

DAY_US = 86_400_000_000
F135_C, F70_C, F41_C = (135 - 32) * 5 / 9, (70 - 32) * 5 / 9, 5.0  # fixed values: cooling targets


def pct(cond: Column) -> Column:
    return F.avg(_true(cond).cast("double")) * 100


def run_summary(tl: Timeline, value="value") -> DataFrame:
    rank = F.struct(*tl.order)
    return tl.per_run(
        F.min_by(value, rank).alias("start_value"), F.max_by(value, rank).alias("end_value"),
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"),
        seconds(F.max("us"), F.min("us")).alias("duration_s"), F.count(F.lit(1)).alias("samples"))


def sampling_stats(tl: Timeline, value="value") -> DataFrame:
    return with_step(tl).attach_quantile("dt", 0.5, "_median").per_run(
        F.count(F.lit(1)).alias("samples"), F.avg("dt").alias("mean_step_s"), F.min("dt").alias("min_step_s"),
        F.max("dt").alias("max_step_s"), F.count_if(F.col("dt") == 0).alias("duplicates"),
        F.count_if(F.col(value).isNull()).alias("missing"), seconds(F.max("us"), F.min("us")).alias("duration_s"), F.first("_median").alias("median_step_s"))


def in_range_pct(tl: Timeline, lo, hi, value="value") -> DataFrame:
    return tl.per_run(pct(F.col(value).between(as_col(lo), as_col(hi))).alias("in_range_pct"))


def daily_compliance(df: DataFrame, lo, hi, value="value", key=("run_id",)) -> DataFrame:
    """In-range share per UTC day; the mean is rounded to 3 digits before it becomes a percentage."""
    ok = _true(F.col(value).between(as_col(lo), as_col(hi))).cast("double")
    return df.withColumn("day", F.to_date(F.timestamp_micros("us"))).groupBy(*key, "day").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(ok).cast("long").alias("samples_in_range"),
        (F.bround(F.avg(ok), 3) * 100).alias("compliance_pct"), F.min(value).alias("min_value"),
        F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"))


def daily_rollup(daily: DataFrame, required=95.0, key=("run_id",)) -> DataFrame:
    good = F.col("compliance_pct") >= required
    bad_days = F.array_sort(F.collect_list(F.when(~good, F.date_format("day", "yyyy-MM-dd"))))
    return daily.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_days"), F.count_if(good).alias("compliant_days"),
        F.count_if(~good).alias("non_compliant_days"), F.avg("compliance_pct").alias("mean_day_pct"),
        F.min("compliance_pct").alias("worst_day_pct"), F.max("compliance_pct").alias("best_day_pct"),
        bad_days.alias("non_compliant_dates"), F.every(good).alias("all_days_met"))


def mean_kinetic(tl: Timeline, value="value") -> DataFrame:
    """Harmonic mean in kelvin; null below two samples."""
    harmonic = F.lit(1.0) / F.avg(F.lit(1.0) / (F.col(value) + 273.15)) - 273.15
    return tl.per_run(F.when(F.count(value) >= 2, harmonic).alias("mkt"))


def lethality(tl: Timeline, reference=121.1, z=10.0, value="value", supplied: str | None = None) -> DataFrame:
    """F0 minutes by trapezoids over the lethal rate; a supplied F0 column wins with its maximum."""
    rate = F.pow(F.lit(10.0), (F.col(value) - reference) / z)
    line = tl.with_columns(_l=rate).scan(_pl=prev("_l"), _pu=prev("us"))
    minutes = (F.col("_l") + F.col("_pl")) / 2 * seconds(F.col("us"), F.col("_pu")) / 60
    total = F.coalesce(F.sum(minutes), F.lit(0.0))
    return line.per_run((F.coalesce(F.max(supplied), total) if supplied else total).alias("f0"))


DATUM, FACTOR = -10.0, 13.65  # fixed values: datum temperature and half-strength degree hours


def strength(hours: Column, factor=FACTOR) -> Column:
    """Percent of the final strength after so many degree hours."""
    return F.when(hours > 0, F.least(hours / (hours + factor) * 100, F.lit(100.0))).otherwise(0.0)


def maturity(tl: Timeline, datum=DATUM, factor=FACTOR, value="value") -> DataFrame:
    """Temperature-time above the datum in degree hours and the strength estimated from it."""
    ahead = tl.scan(_nv=following(value), _nu=following("us"))
    mean = (F.col(value) + F.col("_nv")) / 2
    part = F.when(mean > datum, (mean - datum) * seconds(F.col("_nu"), F.col("us")) / 3600)
    total = F.coalesce(F.sum(part), F.lit(0.0))
    return ahead.per_run(total.alias("maturity_h")).withColumn("strength_pct", strength(F.col("maturity_h"), factor))


def window_ids(tl: Timeline, window_s: int, step_s: int) -> DataFrame:
    """Attach every sample to the overlapping windows that contain it, both ends included.

    Windows start every ``step_s`` from the run's first sample and must end within the run.
    The ids follow from arithmetic, so this is no range join; each sample is in at most
    ``window_s / step_s + 1`` windows.
    """
    w, s = window_s * 1_000_000, step_s * 1_000_000
    placed = tl.attach(_t0=F.min("us"), _t1=F.max("us")).rows()
    offset = "(us - _t0)"
    first = f"greatest(0L, ({offset} - {w}L + {s - 1}L) div {s}L)"
    last = f"least({offset} div {s}L, (_t1 - _t0 - {w}L) div {s}L)"
    usable = placed.filter(F.expr(f"_t1 - _t0 >= {w}L AND {last} >= {first}"))
    return usable.withColumn("window_id", F.explode(F.expr(f"sequence({first}, {last})"))).drop("_t0", "_t1")


def with_windows(tl: Timeline, lo, hi, window_s: int, step_s: int, value="value") -> Timeline:
    """Rows with their neighbours, position and the time in the band before them: what ``window_edges`` needs."""
    line = tl.scan(_pu=prev("us"), _nu=following("us"), _pos=position()).attach(_t0=F.min("us"), _t1=F.max("us"))
    inside = _true(F.col(value).between(as_col(lo), as_col(hi)))
    line = line.with_columns(_good=F.when(inside, F.coalesce(F.col("_nu") - F.col("us"), F.lit(0))).otherwise(F.lit(0)),
                             _w=F.lit(window_s * 1_000_000), _s=F.lit(step_s * 1_000_000))
    return line.scan(_g=run_sum("_good")).with_columns(_g=F.col("_g") - F.col("_good"))


def window_edges(line: Timeline, keep: dict[str, Column] | None = None) -> DataFrame:
    """The first and the last sample of every overlapping window, as rows ``window_id``, ``_begins``, ``_pos``, ``_g``, ``_at``.

    A window's contents follow from running sums at its two edges, so each is two rows, however many samples it holds and however
    far windows overlap.  Windows begin every step from the run's first sample, hold both ends, and end within the run; those
    without samples have no rows.  ``keep`` are values of the rows themselves, on a row of their own without a window.
    """
    ceil = lambda at: f"(({at} - _t0 - _w) + _s - 1) div _s"
    last = "if(_t1 - _t0 >= _w, (_t1 - _t0 - _w) div _s, -1L)"
    held_from, held_to = ceil("us"), "(us - _t0) div _s"  # windows that hold the sample
    begin = f"greatest(coalesce((_pu - _t0) div _s + 1, 0L), {held_from}, 0L)", f"least({held_to}, {last})"
    end = f"greatest({held_from}, 0L)", f"least(coalesce({ceil('_nu')} - 1, {last}), {held_to}, {last})"
    edge = lambda span, begins: F.expr(f"if({span[1]} >= {span[0]}, transform(sequence({span[0]}, {span[1]}), k -> struct(k AS id, {begins} AS begins)), array())")
    lists = [edge(begin, "true"), edge(end, "false")]
    if keep:
        lists.append(F.array(F.struct(F.lit(None).cast("long").alias("id"), F.lit(None).cast("boolean").alias("begins"))))
    rows = line.rows().withColumns({f"_keep{n}": c for n, c in (keep or {}).items()}).withColumn("_e", F.explode(F.concat(*lists)))
    own = {n: F.when(F.col("_e.id").isNull(), F.col(f"_keep{n}")) for n in keep or ()}
    return rows.select(*line.key, F.col("_e.id").alias("window_id"), F.col("_e.begins").alias("_begins"), "_pos", "_g", F.col("us").alias("_at"),
                       *[c.alias(n) for n, c in own.items()])


def windows_of(edges: DataFrame, key, required=95.0, *extra: Column) -> DataFrame:
    """One row per window (and one without, for what ``keep`` handed on): samples, seconds, time-weighted share in the band."""
    at = lambda column, begins: F.max(F.when(F.col("_begins") == begins, F.col(column)))
    span = lambda column: at(column, False) - at(column, True)
    total = F.col("total_s")
    return edges.groupBy(*key, "window_id").agg(
        (span("_pos") + 1).alias("samples"), (span("_at") / F.lit(1e6)).alias("total_s"), (span("_g") / F.lit(1e6)).alias("_good_s"), *extra,
    ).withColumn("compliance_pct", F.when(total > 0, F.col("_good_s") / total * 100).when(F.col("window_id").isNotNull(), 0.0)).withColumn(
        "compliant", (F.col("compliance_pct") >= required) & (F.col("samples") >= 2)).drop("_good_s")


def window_compliance(tl: Timeline, lo, hi, window_s=86_400, step_s=43_200, required=95.0, value="value") -> DataFrame:
    """Time-weighted in-range share of each overlapping window; a sample's value holds until the next."""
    return windows_of(window_edges(with_windows(tl, lo, hi, window_s, step_s, value)), tl.key, required)


def window_totals(share=0.8) -> list[Column]:
    """Aggregates of a run over its windows."""
    there, good = F.col("window_id").isNotNull(), F.col("window_id").isNotNull() & F.col("compliant")
    return [F.count_if(there).alias("total_windows"), F.avg("compliance_pct").alias("mean_pct"),
            F.when(F.count_if(there) > 0, F.count_if(good) >= F.count_if(there) * share).alias("overall_pass")]


def window_rollup(windows: DataFrame, key=("run_id",), share=0.8) -> DataFrame:
    return windows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("total_windows"), F.count_if("compliant").alias("compliant_windows"),
        F.count_if(~F.col("compliant")).alias("failed_windows"), F.avg("compliance_pct").alias("mean_pct"),
    ).withColumn("overall_pass", F.col("compliant_windows") >= F.col("total_windows") * share)


def stability(tl: Timeline, max_rate=5.0, value="value") -> DataFrame:
    """Rate of change per hour: a change in no time counts as 0, the first row not at all."""
    line = tl.scan(_pv=prev(value), _pu=prev("us"))
    hours = seconds(F.col("us"), F.col("_pu")) / 3600
    change = F.abs(F.col(value) - F.col("_pv"))
    rate = F.when(hours > 0, change / hours).when((hours == 0) & (change > 0), 0.0)
    return line.with_columns(_r=rate).per_run(
        F.coalesce(F.max("_r"), F.lit(0.0)).alias("max_rate_per_h"), F.coalesce(F.avg("_r"), F.lit(0.0)).alias("mean_rate_per_h"),
        F.count_if(F.col("_r") > max_rate).alias("violations"), (F.max(value) - F.min(value)).alias("value_range"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std_value"))


# -- several sensors, long form ------------------------------------------------------------------


def band_violations(df: DataFrame, lo, hi, value="value", key=("run_id",)) -> DataFrame:
    """Percent of all sensor readings outside the band."""
    bad = _true((F.col(value) < as_col(lo)) | (F.col(value) > as_col(hi)))
    return df.groupBy(*key).agg((F.count_if(bad) / F.count(F.lit(1)) * 100).alias("violation_pct"))


def humidity_control(df: DataFrame, lo, hi, value="k", key=("run_id",)) -> DataFrame:
    return df.groupBy(*key).agg(
        F.min(value).alias("min_rh"), F.max(value).alias("max_rh"), F.avg(value).alias("mean_rh"),
    ).withColumn("controlled", (F.col("min_rh") >= lo) & (F.col("max_rh") <= hi))


def sensor_spread(df: DataFrame, value="value", key=("run_id",), sensor="sensor") -> DataFrame:
    """Largest range of any single sensor."""
    per = df.groupBy(*key, sensor).agg((F.max(value) - F.min(value)).alias("_r"))
    return per.groupBy(*key).agg(F.max("_r").alias("max_sensor_range"))


def target_deviation(df: DataFrame, target, value="value", key=("run_id",)) -> DataFrame:
    off = F.abs(F.col(value) - as_col(target))
    return df.groupBy(*key).agg(
        F.avg(off).alias("mean_dev"), F.max(off).alias("max_dev"), F.stddev_pop(off).alias("std_dev"))


def simple_range_check(df: DataFrame, lo, hi, value="value", key=("run_id",)) -> DataFrame:
    ok = _true(F.col(value).between(as_col(lo), as_col(hi)))
    share = F.count_if(ok) / F.count(F.lit(1)) * 100
    return df.groupBy(*key).agg(share.alias("in_range_pct"), F.every(ok).alias("_all")).select(
        *key, "in_range_pct", F.when(F.col("_all"), "PASS").otherwise("FAIL").alias("status"))


def low_share(df: DataFrame, minimum, limit_pct=5.0, value="k", key=("run_id",)) -> DataFrame:
    return df.groupBy(*key).agg(pct(F.col(value) < as_col(minimum)).alias("low_pct")).withColumn(
        "too_low", F.col("low_pct") > limit_pct)


# -- phases and leading windows ------------------------------------------------------------------


def phase_checks(line: Timeline, humidity="k", gas="value", *more: Column) -> DataFrame:
    """Humidity and gas inside the sterilisation phase, and the evacuation at the end of the run.

    ``line`` carries the phase (``curves.with_gas_phase``).  Without a phase four fifths of all samples must have the
    right humidity.  ``more`` are further aggregates of the run.
    """
    inside = _true(in_phase())
    line = line.with_columns(_in=inside).attach_quantile(F.when(inside, F.col(gas)), 0.5, "_median")
    ok = _true(F.col(humidity).between(45.0, 85.0))
    share = lambda cond: F.avg(F.when(F.col("_in"), cond.cast("double")))
    reached = F.first("phase_start_us").isNotNull()
    kept = share(_true(F.col(gas) >= F.col("_median") * 0.5))
    return line.per_run(
        F.when(reached, F.coalesce(F.every(F.when(F.col("_in"), ok)), F.lit(True))).otherwise(F.avg(ok.cast("double")) >= 0.8).alias("humidity_ok"),
        F.coalesce((1 - share(ok)) * 100, F.lit(0.0)).alias("humidity_bad_pct"), F.coalesce(kept >= 0.9, F.lit(True)).alias("gas_kept"),
        ((F.max(gas) > 100) & (F.max_by(gas, F.struct(*line.order)) > F.max(gas) * 0.1)).alias("evacuation_incomplete"), *more)


def first_hours(tl: Timeline, hours=24.0) -> DataFrame:
    """Samples up to ``hours`` after the run's first one, that instant included."""
    lead = F.col("us") <= F.col("_t0") + F.lit(int(hours * 3_600_000_000))
    return tl.attach(_t0=F.min("us")).where(lead).dropping("_t0").rows()


def first_day_verdict(tl: Timeline, lo=16.0, hi=27.0, value="value", humidity: str | None = None, min_samples=10,
                      required=95.0, hours=24.0) -> DataFrame:
    """Share of instants in the first day at which every sensor is in band (and humidity is high)."""
    ok = _true(F.col(value).between(as_col(lo), as_col(hi)))
    if humidity:
        ok = ok & _true(F.col(humidity) >= 95.0)
    instants = first_hours(tl, hours).groupBy(*tl.key, "us").agg(F.every(ok).alias("_ok"))
    return instants.groupBy(*tl.key).agg(
        F.count(F.lit(1)).alias("samples_24h"), (F.avg(F.col("_ok").cast("double")) * 100).alias("ok_pct"),
    ).withColumn("status", F.when(F.col("samples_24h") < min_samples, "INDETERMINATE")
                 .when(F.col("ok_pct") >= required, "PASS").otherwise("FAIL"))


def critical_period(tl: Timeline, lo=16.0, hi=27.0, value="value", humidity="k", period_s=86_400.0) -> DataFrame:
    """Leading samples as many as fit the period at the run's first step."""
    line = tl.scan(_pos=position(), _pu=prev("us"))
    lead = line.attach(_first_dt=F.max(F.when(F.col("_pos") == 2, seconds(F.col("us"), F.col("_pu"))))).rows().filter(F.col("_pos") <= F.floor(F.lit(period_s) / F.col("_first_dt")))
    return lead.groupBy(*tl.key).agg(
        F.count(F.lit(1)).alias("critical_samples"), pct(F.col(value).between(lo, hi)).alias("critical_pct"),
        pct(F.col(humidity) >= 95.0).alias("critical_rh_pct"),
    ).withColumn("critical_ok", (F.col("critical_samples") > 1) & (F.col("critical_pct") >= 98.0))


def hold_pressure(tl: Timeline, threshold, hysteresis, pressure="k", value="value") -> DataFrame:
    """Lowest pressure in each latched hold, the sample that ends the hold included."""
    latched = latch(tl, threshold, hysteresis, value).scan(_np=following(pressure), _ns=following("state"))
    leaves = F.col("state") & ~F.coalesce("_ns", F.lit(True))
    reading = F.when(leaves, F.least(F.col(pressure), F.col("_np"))).otherwise(F.col(pressure))
    islands = latched.with_columns(_p=reading).islands("state").rows().filter("state")
    return islands.groupBy(*tl.key, "island").agg(
        F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.min("_p").alias("min_pressure"))


def value_counts(df: DataFrame, value, key=()) -> DataFrame:
    """How often each value occurs per group (``_v``, ``_c``; ``_all`` stands for no key)."""
    v = F.col(value) if isinstance(value, str) else value
    keyed = df.withColumn("_all", F.lit(1)) if not key else df
    key = list(key) or ["_all"]
    # the group of missing values goes after the count, so that no filter repeats a costly value
    counts = keyed.select(*key, v.alias("_v")).groupBy(*key, "_v").agg(F.count(F.lit(1)).alias("_c"))
    return counts.filter("_v is not null")


def order_statistic(df: DataFrame, value, index, name: str, key=()) -> DataFrame:
    """Element at a 0-based ``index`` (an expression over the group's size ``_n``) of the sorted values.

    Equal values are counted first and the counts are summed along the values, so no group is
    ever sorted as a list.
    """
    return nth_of_counts(value_counts(df, value, key), index, name, key)


def value_cell(v: Column) -> Column:
    """A whole number that never falls as the value rises: 4096 cells to each doubling of its size."""
    x = v.cast("double")
    size = F.floor(F.log2(F.abs(x)) * 4096) + (1 << 23)  # positive for every double
    beyond = F.lit(1 << 40)
    cell = F.when(x == 0, F.lit(0).cast("long")).when(F.abs(x) == float("inf"), beyond).otherwise(size)
    return F.when(F.isnan(x), beyond + 1).when(x < 0, -cell).otherwise(cell)


def nth_of_counts(counts: DataFrame, index, name: str, key=()) -> DataFrame:
    """The same from value counts, as a plain plan that starts no job of its own.

    Counts are summed per cell of values and the cells put in order, which tells the cell of the wanted element; only the values of
    that cell are put in order after it.  A task orders a group's cells, whose number follows from the values' range, and then one cell.
    """
    group = list(key) or ["_all"]
    placed = counts.withColumn("_cell", value_cell(F.col("_v")))
    along, whole = Window.partitionBy(*group).orderBy("_cell"), Window.partitionBy(*group)
    cells = placed.groupBy(*group, "_cell").agg(F.sum("_c").alias("_in")).select(
        *group, "_cell", "_in", F.sum("_in").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_in").over(whole).alias("_n"))
    wanted = cells.withColumn("_at", index).filter((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_in") <= F.col("_at"))).select(
        *group, "_cell", F.col("_at"), (F.col("_upto") - F.col("_in")).alias("_before"))
    inside = _join_null_safe(placed, wanted, [*group, "_cell"], "inner")
    line = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("_upto", F.sum("_c").over(line) + F.col("_before")).filter(F.col("_upto") > F.col("_at"))
    return found.groupBy(*group).agg(F.min("_v").alias(name)).drop("_all")


def truth_by_counts(df: DataFrame, threshold, step_s: float, min_hold_min=400.0, value="value", pressure="k", key=("run_id",)) -> DataFrame:
    """Sanity verdicts that only count samples and multiply by a fixed step."""
    minutes = lambda cond: F.count_if(cond) * F.lit(step_s) / 60
    v = F.col(value)
    word = lambda ok: F.when(ok, "PASS").otherwise("FAIL")
    hold = minutes(v >= as_col(threshold))
    return df.groupBy(*key).agg(
        hold.alias("hold_min"), word(hold >= min_hold_min).alias("powder"),
        word(minutes((v >= 60) & (F.col(pressure) >= 20)) >= 150).alias("autoclave"),
        word(F.count_if(v.between(2, 150)) / F.count(F.lit(1)) * 100 >= 95).alias("coldchain"))


def truth_by_positions(tl: Timeline, targets=(F135_C, F70_C, F41_C), limits_h=(2.0, 4.0), step_s=30.0, lo=16.0, hi=27.0,
                       window=2880, humidity="k", min_humidity=80.0, value="value") -> DataFrame:
    """Sanity verdicts for cooling and curing by sample positions times a fixed step."""
    line = tl.scan(_pos=position())
    first = lambda t: F.min(F.when(F.col(value) <= t, F.col("_pos")))
    ok = _true(F.col(value).between(lo, hi)) & _true(F.col(humidity) >= min_humidity)
    lead = F.col("_pos") <= window
    f = line.per_run(*[first(t).alias(f"_p{i}") for i, t in enumerate(targets)],
                     (F.count_if(lead & ok) / F.count_if(lead) * 100).alias("leading_pct"))
    hours = lambda a, b: (F.col(b) - F.col(a)) * F.lit(step_s) / 3600
    fast = _true(hours("_p0", "_p1") <= limits_h[0]) & _true(hours("_p1", "_p2") <= limits_h[1])
    return f.select(*tl.key, F.when(fast, "PASS").otherwise("FAIL").alias("cooling"), "leading_pct",
                    F.when(F.col("leading_pct") >= 95, "PASS").otherwise("FAIL").alias("concrete"))
