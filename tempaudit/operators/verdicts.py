"""Verdicts per industry.

Each engine is a recipe (see ``recipes``): ordered columns and aggregates over them, and rules that turn the measures
into a verdict.  One engine or all of them read the samples once and cost one exchange over plain runs.  A verdict row has
``status``, ``pass``, reason ``codes`` (stable, comparable), reason texts and the measures they rest on.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.functions.scalars import join_reasons
from tempaudit.functions.units import (BAR_TO_KPA, PSI_TO_KPA, celsius_to_fahrenheit, kpa_to_psi, pressure_unit)
from tempaudit.operators import excursions, holds, stats
from tempaudit.operators.holds import _true, as_col
from tempaudit.operators.recipes import Recipe, Round, Rules, Whole, after, lasted, longest_stretch, measure, stretch_rounds
from tempaudit.operators.specs import canonical_industry
from tempaudit.operators.timeline import Timeline, following, join_runs, keyed_join, last_seen, position, prev, run_max, run_sum, seconds

# fixed values of the food-cooling rule, in Celsius
F135, F70, F41, F35 = (135 - 32) * 5 / 9, (70 - 32) * 5 / 9, (41 - 32) * 5 / 9, (35 - 32) * 5 / 9
MIN_PRESSURE_KPA = 103.4
MIN_F0 = 12.0


def attach_specs(samples: DataFrame, specs: DataFrame, on="run_id", fixed=False) -> DataFrame:
    """Samples with their run's specification.

    ``fixed`` marks a library of known small size, which is broadcast.  A table that grows with
    the runs is joined by key, the rows of very long runs dealt out over several tasks.
    """
    if fixed:
        return samples.join(F.broadcast(specs), on)
    return keyed_join(samples, specs, on, ["us", "seq"])


def _finish(df: DataFrame, key, rules: Rules) -> DataFrame:
    return df.select(
        *key, rules.status.alias("status"), (rules.status == "PASS").alias("pass"), join_reasons(*rules.codes).alias("codes"),
        join_reasons(*rules.texts).alias("reasons"), *[c.alias(n) for n, c in rules.extra.items()])


def judge(tl: Timeline, recipe: Recipe) -> DataFrame:
    """The verdict of one engine on every run."""
    return _finish(measure(tl, {"": recipe}), tl.key, recipe.rules(recipe.measured))


def judge_all(tl: Timeline, engines: dict[str, Recipe], industry="industry") -> DataFrame:
    """The verdict of each run's own engine: key, industry, status, pass, codes, reasons.

    All engines are worked out in one pass over the tagged rows, and the verdict is chosen by the industry.  A run of another
    industry has status ERROR and the code ``unknown_industry``.
    """
    f = measure(tl, engines, industry, {"_industry": F.max(industry)})
    which = F.col("_industry")
    rules = {name: r.rules(r.measured) for name, r in engines.items()}
    pick = lambda part, other: reduce(lambda c, kv: c.when(which == kv[0], part(kv[1])), rules.items(), F.when(F.lit(False), None)).otherwise(other)
    status = pick(lambda r: r.status, F.lit("ERROR"))
    return f.select(*tl.key, which.alias(industry), status.alias("status"), (status == "PASS").alias("pass"),
                    pick(lambda r: join_reasons(*r.codes), F.array(F.lit("unknown_industry"))).alias("codes"),
                    pick(lambda r: join_reasons(*r.texts), F.array(F.lit("no engine for this industry"))).alias("reasons"))


def judge_runs(samples: DataFrame, specs: DataFrame, engines: dict[str, Recipe | Callable[..., Recipe]] | None = None, key=("run_id",)) -> DataFrame:
    """Samples judged by the industries their specifications name; the further columns of ``specs`` go along with the rows.

    Runs without a specification are left out.  ``engines`` are the shipped ones by default; an entry is a recipe or makes one.
    """
    tagged = attach_specs(samples, specs.withColumn("industry", canonical_industry(F.col("industry"))), list(key))
    return judge_all(Timeline.open(tagged, key, measure=samples), {n: e() if callable(e) else e for n, e in (engines or ENGINES).items()})


def _code(cond: Column, name: str) -> Column:
    return F.when(cond, F.lit(name))


def _text(cond: Column, fmt: str, *args) -> Column:
    return F.when(cond, F.format_string(fmt, *args))


# -- holds -----------------------------------------------------------------------------------------


def hold_features(tl: Timeline, value="value", form="latch", carry=()) -> DataFrame:
    """Everything a hold verdict needs, in one ordered pass.  ``carry`` are per-run columns to keep.

    Rows carry ``threshold``, ``hysteresis``, ``continuous``, ``max_dips_s``.  A continuous run is
    split into holds by the latch (or by the band, ``form='band'``), a cumulative one by the plain
    threshold, with the dip budget applied to its islands in order.
    """
    v, thr = F.col(value), F.col("threshold")
    low = thr - F.col("hysteresis")
    line = tl.scan(_seen=last_seen(F.when(v >= thr, True).when(v < low, False)), _pv=prev(value), _pu=prev("us"))
    held = _true(F.col("_seen")) if form == "latch" else _true(v >= low)
    dt = seconds(F.col("us"), F.col("_pu"))
    line = line.with_columns(
        state=F.when(F.col("continuous"), held).otherwise(_true(v >= thr)),
        _ramp=F.when(F.col("_pu").isNull(), 0.0).when(dt > 0, (v - F.col("_pv")) / dt * 60),
        _dt=F.coalesce(dt, F.lit(0.0))).dropping("_seen", "_pv", "_pu")
    islands = holds.island_rows(
        line, "state", F.max("_ramp").alias("_ramp"), F.min(value).alias("_min"), F.max(value).alias("_max"),
        F.min(F.when(v >= thr, F.col("us"))).alias("_first"), F.max("max_dips_s").alias("_budget"),
        F.sum(F.when(v >= thr, F.col("_dt")).otherwise(0.0)).alias("_above_dt"), F.sum("_dt").alias("_all_dt"),
        F.first("continuous").alias("_continuous"), *[F.max(c).alias(c) for c in carry])
    dip = F.when(~F.col("state"), F.col("duration_s")).otherwise(0.0)
    used = tl.again(islands, order=["island"]).scan(_used=run_sum(dip))
    used = used.with_columns(_over=(F.col("_used") > F.col("_budget")).cast("int")).scan(_stop=run_max("_over"))
    on = F.col("state")
    best = F.coalesce(F.max(F.when(on, F.col("duration_s"))), F.lit(0.0))
    budgeted = F.coalesce(F.sum(F.when(on & (F.col("_stop") == 0), F.col("duration_s"))), F.lit(0.0))
    above, dips, allow = F.sum("_above_dt"), F.sum("_all_dt") - F.sum("_above_dt"), F.max("_budget")
    stepped = F.when(dips > allow, F.greatest(F.lit(0.0), above - (dips - allow))).otherwise(above)
    return used.rows().groupBy(*tl.key).agg(
        F.sum("samples").alias("samples"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
        F.min("_min").alias("min_temp"), F.max("_max").alias("max_temp"), F.max("_ramp").alias("max_ramp"),
        seconds(F.min("_first"), F.min("start_us")).alias("time_to_threshold_s"),
        F.when(F.bool_or("_continuous"), best).otherwise(budgeted if form == "latch" else stepped).alias("hold_s"),
        *[F.max(c).alias(c) for c in carry])


def hold_verdict(samples: DataFrame, form="latch", sample_period_s=30.0, too_few="INDETERMINATE", value="value",
                 key=("run_id",)) -> DataFrame:
    """Hold verdict for samples carrying their specification (V1; V2 with the band form).

    Needs ``target_temp``, ``uncertainty``, ``hold_time_s``, ``hysteresis``, ``continuous``,
    ``max_dips_s``, ``max_ramp`` and ``max_time_to_threshold_s`` (the last two may be null).
    """
    limits = ["hold_time_s", "ramp_limit", "max_time_to_threshold_s"]
    line = samples.withColumns({"threshold": F.col("target_temp") + F.col("uncertainty"), "ramp_limit": F.col("max_ramp")}).select(
        *key, "us", "seq", value, "threshold", "hysteresis", "continuous", "max_dips_s", *limits)
    f = hold_features(Timeline.open(line, key), value, form, ["threshold", *limits])
    return _finish(f, key, hold_rules(F.col, sample_period_s, too_few))


def hold_rules(c: Callable[[str], Column], sample_period_s=30.0, too_few="INDETERMINATE") -> Rules:
    """Rules over ``samples``, ``min_temp``, ``max_temp``, ``max_ramp``, ``time_to_threshold_s``, ``hold_s`` and the limits."""
    n, need = c("samples"), F.greatest(F.lit(5), F.floor(c("hold_time_s") / sample_period_s) + 2)
    short, never = n < need, c("max_temp") < c("threshold")
    fast = _true(c("max_ramp") > c("ramp_limit"))
    late = _true(c("time_to_threshold_s") > c("max_time_to_threshold_s"))
    met = c("hold_s") >= c("hold_time_s")
    status = (
        F.when(n < 2, "ERROR").when(short, too_few).when(_true(never), "FAIL")
        .when(met & ~fast & ~late, "PASS").otherwise("FAIL"))
    judged = ~short & ~_true(never)
    return Rules(
        status,
        [_code(short, "too_few_points"), _code(~short & _true(never), "never_reached"), _code(judged & fast, "ramp_too_high"),
         _code(judged & late, "too_late"), _code(judged & met, "hold_met"), _code(judged & ~met, "hold_short")],
        [_text(short, "%d samples where the hold needs %d", n, need),
         _text(~short & _true(never), "threshold %.1f °C not attained, highest sample %.1f °C", c("threshold"), c("max_temp")),
         _text(judged & fast, "heats by %.1f °C a minute, %.1f allowed", c("max_ramp"), c("ramp_limit")),
         _text(judged & late, "threshold attained after %.0f s, %.0f allowed", c("time_to_threshold_s"), c("max_time_to_threshold_s").cast("double")),
         _text(judged & met, "held %.0f s of %.0f s asked for", c("hold_s"), c("hold_time_s").cast("double")),
         _text(judged & ~met, "held only %.0f s of %.0f s asked for", c("hold_s"), c("hold_time_s").cast("double"))],
        {"hold_s": F.when(judged, c("hold_s")).otherwise(0.0)} | {x: c(x) for x in (
            "hold_time_s", "threshold", "min_temp", "max_temp", "max_ramp", "time_to_threshold_s", "samples")})


def powder_engine(sample_period_s=30.0, value="value", given=None, p="_pow_") -> Recipe:
    """The band form as a recipe.  ``given`` names the columns of the rows that carry limits; the others have their usual value."""
    usual = {"target_temp": 180.0, "uncertainty": 2.0, "hold_time_s": 600.0, "hysteresis": 2.0, "max_dips_s": 0.0,
             "max_ramp": None, "max_time_to_threshold_s": None, "continuous": True}
    v, spec = F.col(value), {k: F.col(k) if k in (given or ()) else F.lit(x) for k, x in usual.items()}
    spec = {k: x if k == "continuous" else x.cast("double") for k, x in spec.items()}
    thr = spec["target_temp"] + spec["uncertainty"]
    dt = seconds(F.col("us"), F.col(f"{p}pu"))
    start = Round({f"{p}pv": prev(value), f"{p}pu": prev("us")}, {
        f"{p}ramp": F.when(F.col(f"{p}pu").isNull(), 0.0).when(dt > 0, (v - F.col(f"{p}pv")) / dt * 60), f"{p}dt": F.coalesce(dt, F.lit(0.0))})
    held = F.when(spec["continuous"], _true(v >= thr - spec["hysteresis"])).otherwise(_true(v >= thr))
    above = F.sum(F.when(v >= thr, F.col(f"{p}dt")).otherwise(0.0))
    dips, allow = F.sum(f"{p}dt") - above, F.max(spec["max_dips_s"])
    stepped = F.when(dips > allow, F.greatest(F.lit(0.0), above - (dips - allow))).otherwise(above)
    measures = {
        "samples": F.count(F.lit(1)), "min_temp": F.min(value), "max_temp": F.max(value), "max_ramp": F.max(f"{p}ramp"),
        "time_to_threshold_s": seconds(F.min(F.when(v >= thr, F.col("us"))), F.min("us")),
        "hold_s": F.when(F.bool_or(spec["continuous"]), longest_stretch(p)).otherwise(stepped), "threshold": F.max(thr),
        "hold_time_s": F.max(spec["hold_time_s"]), "ramp_limit": F.max(spec["max_ramp"]), "max_time_to_threshold_s": F.max(spec["max_time_to_threshold_s"])}
    return Recipe(p, after(start, stretch_rounds(held, p)), measures, lambda c: hold_rules(c, sample_period_s, "FAIL"))


def powder_verdict(samples: DataFrame, sample_period_s=30.0, value="value", key=("run_id",)) -> DataFrame:
    """Band form of the hold verdict; cumulative time by steps; too few points is a failure."""
    return hold_verdict(samples, "band", sample_period_s, "FAIL", value, key)


# -- cooling ---------------------------------------------------------------------------------------


def cooling_engine(phase1_s=7200.0, phase2_s=21_600.0, rise=2.0, value="value", p="_cool_") -> Recipe:
    """Two-phase food cooling, both phases counted from the start; no reheating."""
    v, nv, nu = F.col(value), F.col(f"{p}nv"), F.col(f"{p}nu")

    def reach(target):
        hit = (v >= target) & (nv <= target)
        share = F.when(nv == v, 0.0).otherwise((target - v) / (nv - v))
        return seconds(F.min(F.when(hit, F.col("us") + share * (nu - F.col("us")))), F.min("us"))

    rank = F.struct("us", "seq")
    measures = {
        "samples": F.count(F.lit(1)), "start_temp": F.min_by(value, rank), "end_temp": F.max_by(value, rank),
        "min_temp": F.min(value), "max_temp": F.max(value), "max_rise": F.max(v - F.col(f"{p}pv")),
        "duration_s": seconds(F.max("us"), F.min("us")), "to_70f_s": reach(F70), "to_41f_s": reach(F41),
        "below_41f_s": seconds(F.max("us"), F.min(F.when(v <= F41, F.col("us"))))}
    start = Round({f"{p}pv": prev(value), f"{p}nv": following(value), f"{p}nu": following("us")})
    return Recipe(p, [start], measures, lambda c: cooling_rules(c, phase1_s, phase2_s, rise))


def cooling_rules(c: Callable[[str], Column], phase1_s: float, phase2_s: float, rise: float) -> Rules:
    cold = c("start_temp") < F135 - 0.1
    heated = _true(c("max_rise") > rise)
    p1, p2 = c("to_70f_s"), c("to_41f_s")
    slow1, slow2 = _true(p1 > phase1_s), _true(p2 > phase2_s)
    codes = [_code(cold, "start_too_cold"), _code(heated, "heating"), _code(slow1, "phase1_slow"), _code(p1.isNull(), "phase1_missed"),
             _code(slow2, "phase2_slow"), _code(p2.isNull(), "phase2_missed")]
    ok = ~cold & ~heated & ~slow1 & p1.isNotNull() & ~slow2 & p2.isNotNull()
    status = F.when(c("samples") < 2, "ERROR").when(ok, "PASS").otherwise("FAIL")
    texts = [_text(cold, "began at %.1f °F, below 135 °F", celsius_to_fahrenheit(c("start_temp"))),
             _text(heated, "warmed by %.1f °C between two samples", c("max_rise")),
             _text(slow1, "took %.1f h to 70 °F", p1 / 3600), F.when(p1.isNull(), F.lit("never down to 70 °F")),
             _text(slow2, "took %.1f h to 41 °F", p2 / 3600), F.when(p2.isNull(), F.lit("never down to 41 °F"))]
    warnings = join_reasons(_code(c("duration_s") > 8 * 3600, "long_process"), _code(c("min_temp") < F35, "below_storage_range"))
    hold = F.when(p2.isNotNull(), F.coalesce(c("below_41f_s"), F.lit(0.0))).otherwise(0.0)
    return Rules(status, codes, texts, {"hold_s": hold} | {x: c(x) for x in ("to_70f_s", "to_41f_s", "start_temp", "min_temp", "max_temp")}
                 | {"warnings": warnings})


def cooling_verdict(tl: Timeline, phase1_s=7200.0, phase2_s=21_600.0, rise=2.0, value="value") -> DataFrame:
    return judge(tl, cooling_engine(phase1_s, phase2_s, rise, value))


def plain_measures(tl: Timeline, recipe: Recipe) -> DataFrame:
    """The measures of one recipe under their own names."""
    f = measure(tl, {"": recipe})
    return f.select(*tl.key, *[recipe.measured(n).alias(n) for n in recipe.measures])


def cooling_verdict_independent(tl: Timeline, phase1_s=7200.0, phase2_s=21_600.0, value="value") -> DataFrame:
    """Cooling phases without a start tolerance; a cold start leaves both phases undecided."""
    f = plain_measures(tl, cooling_engine(value=value))
    warm = F.col("start_temp") >= F135
    keep = lambda c: F.when(warm, F.col(c))
    return f.select(
        *tl.key, warm.alias("start_ok"), keep("to_70f_s").alias("phase1_s"), keep("to_41f_s").alias("phase2_s"),
        _true(warm & (F.col("to_70f_s") <= phase1_s)).alias("phase1_pass"),
        _true(warm & (F.col("to_41f_s") <= phase2_s)).alias("phase2_pass"),
    ).withColumn("pass", F.col("phase1_pass") & F.col("phase2_pass"))


# -- autoclave -------------------------------------------------------------------------------------


def autoclave_engine(lowest=119.0, highest=123.0, hold_time_s=900.0, value="value", pressure: str | None = "k", f0_column=None,
                     reference=121.1, z=10.0, require_pressure=False, hysteresis=0.3, p="_auto_") -> Recipe:
    """Steam cycle: lethality, hold (or twice the lethality), maximum temperature and pressure.

    The pressure unit is known only once the run's extremes are, so low readings are counted for
    every unit and the right count is picked at the end.
    """
    v, kpa = F.col(value), F.col(pressure) if pressure else F.lit(None).cast("double")
    lo, hi = as_col(lowest).cast("double"), as_col(highest).cast("double")
    rate = F.pow(F.lit(10.0), (v - reference) / z)
    start = Round({
        f"{p}seen": last_seen(F.when(v >= lo, True).when(v < lo - hysteresis, False)), f"{p}pu": prev("us"), f"{p}pr": prev(rate),
        f"{p}np": following(kpa)}, {f"{p}f0": (rate + F.col(f"{p}pr")) / 2 * seconds(F.col("us"), F.col(f"{p}pu")) / 60})
    rounds = after(start, stretch_rounds(_true(F.col(f"{p}seen")), p))
    on = F.col(f"{p}state")
    leaves = on & ~F.coalesce(F.col(f"{p}will"), F.lit(True))
    held_kpa = F.when(leaves, F.least(kpa, F.col(f"{p}np"))).when(on, kpa)
    low = lambda factor: F.count_if(kpa * factor < MIN_PRESSURE_KPA)
    given = F.max(f0_column) if f0_column else F.lit(None).cast("double")
    measures = {
        "f0": F.coalesce(given, F.sum(f"{p}f0"), F.lit(0.0)), "hold_s": longest_stretch(p), "min_temp": F.min(value), "max_temp": F.max(value),
        "max_allowed": F.max(hi), "in_range": F.count_if(v.between(lo, hi)), "samples": F.count(F.lit(1)), "readings": F.count(kpa),
        "held_kpa": F.min(held_kpa), "pressure_unit": pressure_unit(F.min(kpa), F.max(kpa)), "low_bar": low(BAR_TO_KPA), "low_psi": low(PSI_TO_KPA),
        "low_kpa": low(1.0), "duration_s": seconds(F.max("us"), F.min("us"))}
    return Recipe(p, rounds, measures, lambda c: autoclave_rules(c, hold_time_s, require_pressure))


def autoclave_rules(c: Callable[[str], Column], hold_time_s: float, require_pressure: bool) -> Rules:
    pick = lambda a, b, d: F.when(c("pressure_unit") == "bar", a).when(c("pressure_unit") == "psi", b).otherwise(d)
    held_kpa = c("held_kpa") * pick(F.lit(BAR_TO_KPA), F.lit(PSI_TO_KPA), F.lit(1.0))
    low_pct = F.when(c("readings") > 0, pick(c("low_bar"), c("low_psi"), c("low_kpa")) / c("readings") * 100)
    f0_ok, reached = c("f0") >= MIN_F0, c("in_range") > 0
    long_enough = c("hold_s") >= hold_time_s
    compensated = reached & ~long_enough & (c("f0") >= 2 * MIN_F0)
    hot = _true(c("max_temp") > c("max_allowed"))
    dropped = _true(held_kpa < MIN_PRESSURE_KPA)
    lowp = _true(low_pct > 5)
    unmeasured = low_pct.isNull()
    passed = f0_ok & reached & (long_enough | compensated) & ~hot & ~dropped & ~lowp
    status = F.when(c("samples") < 2, "ERROR")
    if require_pressure:
        status = status.when(unmeasured, "INDETERMINATE")
    status = status.when(passed, "PASS").otherwise("FAIL")
    short = reached & ~long_enough & ~compensated
    codes = [_code(~f0_ok, "f0_low"), _code(compensated, "hold_compensated"), _code(short, "hold_short"),
             _code(~reached, "never_in_range"), _code(hot, "too_hot"), _code(dropped, "pressure_dropped"), _code(lowp, "pressure_low")]
    texts = [_text(~f0_ok, "lethality of %.1f min is under 12 min", c("f0")),
             _text(compensated, "short hold, made up for by a lethality of %.1f min", c("f0")),
             _text(short, "held for %.1f min only", c("hold_s") / 60),
             F.when(~reached, F.lit("no sample in the sterilising range")),
             _text(hot, "%.1f °C exceeds %.1f °C", c("max_temp"), c("max_allowed")),
             _text(dropped, "pressure fell to %.1f psi in the hold", kpa_to_psi(held_kpa)),
             _text(lowp, "pressure too low in %.1f%% of the samples", low_pct)]
    return Rules(status, codes, texts, {x: c(x) for x in ("f0", "hold_s", "min_temp", "max_temp", "pressure_unit")} | {
        "hold_pressure_kpa": held_kpa, "low_pressure_pct": low_pct, "fallback_used": unmeasured})


def autoclave_verdict(tl: Timeline, lowest=119.0, highest=123.0, hold_time_s=900.0, value="value", pressure: str | None = "k",
                      f0_column=None, reference=121.1, z=10.0, require_pressure=False) -> DataFrame:
    return judge(tl, autoclave_engine(lowest, highest, hold_time_s, value, pressure, f0_column, reference, z, require_pressure))


def autoclave_verdict_independent(tl: Timeline, target=121.0, min_f0=8.0, min_hold_s=900.0, z=10.0, value="value") -> DataFrame:
    f = plain_measures(tl, autoclave_engine(target, 1e9, min_hold_s, value, None, None, target, z, hysteresis=2.0))
    return f.select(*tl.key, "f0", "hold_s", "min_temp", "max_temp", ((F.col("f0") >= min_f0) & (F.col("hold_s") >= min_hold_s)).alias("pass"))


# -- gas sterilisation -----------------------------------------------------------------------------


def sterile_engine(lo=50.0, hi=60.0, min_hold_s=7200.0, value="value", humidity="k", gas="gas", require_humidity=False,
                   require_gas=False, p="_eto_") -> Recipe:
    """Ethylene-oxide cycle over its identified phase; a required signal without any value cannot be judged.

    The phase begins at the first sample in range and ends at the first later one whose gas is below a tenth of the run's median, or
    with the run.  Without a phase the whole series is looked at, and four fifths of it must have the right humidity.
    """
    v, g, us = F.col(value), F.col(gas), F.col("us")
    begin, drop, end = F.col(f"{p}begin"), F.col(f"{p}drop"), F.col(f"{p}end")
    inside = F.col(f"{p}in")
    first = Round({f"{p}median": Whole("median", g), f"{p}begin": Whole("min", F.when(v.between(lo, hi), us)), f"{p}stop": Whole("max", us),
                   f"{p}seen": last_seen(F.when(v >= lo, True).when(v < lo - 1.0, False))})
    held, marked, dated = after(first, stretch_rounds(_true(F.col(f"{p}seen")), p))
    phase = Round(marked.ordered | {f"{p}drop": Whole("min", F.when(g < F.col(f"{p}median") * 0.1, us))}, marked.columns | {
        f"{p}end": F.when(begin.isNotNull(), F.when(drop > begin, drop).otherwise(F.col(f"{p}stop"))),
        f"{p}in": _true((us >= begin) & (us < end))})
    last = Round(dated.ordered | {f"{p}level": Whole("median", F.when(inside, g))})
    damp = _true(F.col(humidity).between(45.0, 85.0))
    share = lambda cond: F.avg(F.when(inside, cond.cast("double")))
    kept = share(_true(g >= F.col(f"{p}level") * 0.5))
    measures = {
        "humidity_ok": F.when(F.first(begin).isNotNull(), F.coalesce(F.every(F.when(inside, damp)), F.lit(True))).otherwise(
            F.avg(damp.cast("double")) >= 0.8),
        "humidity_bad_pct": F.coalesce((1 - share(damp)) * 100, F.lit(0.0)), "gas_kept": F.coalesce(kept >= 0.9, F.lit(True)),
        "evacuation_incomplete": (F.max(g) > 100) & (F.max_by(g, F.struct("us", "seq")) > F.max(g) * 0.1),
        "samples": F.count(F.lit(1)), "min_temp": F.min(value), "max_temp": F.max(value), "phase_start_us": F.first(begin),
        "phase_end_us": F.first(end), "phase_min": F.min(F.when(inside, v)), "humidities": F.count(humidity), "gases": F.count(gas),
        "hold_s": longest_stretch(p)}
    return Recipe(p, [held, phase, last], measures, lambda c: sterile_rules(c, lo, hi, min_hold_s, require_humidity, require_gas))


def sterile_rules(c: Callable[[str], Column], lo: float, hi: float, min_hold_s: float, require_humidity: bool, require_gas: bool) -> Rules:
    reached = c("phase_start_us").isNotNull()
    hot = c("max_temp") > hi
    coldest = F.when(reached, c("phase_min")).otherwise(c("min_temp"))
    dropped = (c("min_temp") < lo - 2.0) & _true(coldest < lo)
    time_ok = reached & (c("hold_s") >= min_hold_s)
    range_ok = reached & ~hot & ~dropped
    phase_s = seconds(c("phase_end_us"), c("phase_start_us"))
    phases_ok = F.when(range_ok & time_ok, True).when(reached, phase_s >= min_hold_s).otherwise(True)
    passed = range_ok & time_ok & c("humidity_ok") & c("gas_kept") & phases_ok
    lacking = (F.lit(require_humidity) & (c("humidities") == 0)) | (F.lit(require_gas) & (c("gases") == 0))
    status = F.when(c("samples") < 2, "ERROR").when(lacking, "INDETERMINATE").when(passed, "PASS").otherwise("FAIL")
    codes = [_code(lacking, "signal_missing"), _code(reached & ~time_ok, "time_short"), _code(~reached, "never_in_range"), _code(hot, "too_hot"),
             _code(dropped, "dropped_below"), _code(~c("humidity_ok"), "humidity_out"), _code(~c("gas_kept"), "gas_not_kept"),
             _code(c("evacuation_incomplete"), "evacuation_incomplete"), _code(~phases_ok, "phase_short")]
    texts = [F.when(lacking, F.lit("a required signal has no values")), _text(reached & ~time_ok, "exposed for %.1f h only", c("hold_s") / 3600),
             F.when(~reached, F.lit("no sample in the exposure range")), _text(hot, "%.1f °C is too hot", c("max_temp")),
             F.when(dropped, F.lit("cooled down during the exposure")),
             _text(~c("humidity_ok"), "humidity off in %.1f%% of the exposure", c("humidity_bad_pct")),
             F.when(~c("gas_kept"), F.lit("gas concentration fell")), F.when(c("evacuation_incomplete"), F.lit("gas left at the end")),
             _text(~phases_ok, "phase of %.1f h is too short", phase_s / 3600)]
    return Rules(status, codes, texts, {x: c(x) for x in ("hold_s", "min_temp", "max_temp")} | {"phase_s": phase_s})


def sterile_verdict(tl: Timeline, lo=50.0, hi=60.0, min_hold_s=7200.0, value="value", humidity="k", gas="gas", require_humidity=False,
                    require_gas=False) -> DataFrame:
    return judge(tl, sterile_engine(lo, hi, min_hold_s, value, humidity, gas, require_humidity, require_gas))


# -- concrete --------------------------------------------------------------------------------------


def concrete_engine(lo=16.0, hi=27.0, value="value", humidity: str | None = "k", min_samples=10, required=95.0, day_hours=24.0,
                    period_s=86_400.0, require_humidity=False, p="_conc_") -> Recipe:
    """First-day compliance decides; range, stability and the critical period add reasons; fewer than 5 samples are an error.

    An instant of the first day counts once: it is in order if all its samples are.  The critical period is as many leading samples as
    fit ``period_s`` at the run's first step.
    """
    v, us = F.col(value), F.col("us")
    good = _true(v.between(lo, hi))
    day_ok = good & _true(F.col(humidity) >= 95.0) if require_humidity else good
    start = Round({
        f"{p}pv": prev(value), f"{p}pu": prev("us"), f"{p}nu": following("us"), f"{p}bad": last_seen(F.when(~day_ok, us)), f"{p}pos": position(),
        f"{p}seen": last_seen(F.when(v >= lo, True).when(v < lo - 0.5, False)), f"{p}t0": Whole("min", us)}, {
        f"{p}dt": seconds(us, F.col(f"{p}pu")),
        f"{p}day": (us <= F.col(f"{p}t0") + F.lit(int(day_hours * 3_600_000_000))) & ~us.eqNullSafe(F.col(f"{p}nu"))})
    held, marked, dated = after(start, stretch_rounds(_true(F.col(f"{p}seen")), p))
    step = Round(marked.ordered | {f"{p}step": Whole("max", F.when(F.col(f"{p}pos") == 2, F.col(f"{p}dt")))}, marked.columns | {
        f"{p}lead": _true(F.col(f"{p}pos") <= F.floor(F.lit(period_s) / F.col(f"{p}step")))})
    hours, change = F.col(f"{p}dt") / 3600, F.abs(v - F.col(f"{p}pv"))
    rate = F.when(hours > 0, change / hours).when((hours == 0) & (change > 0), 0.0)
    within = lambda cond, rows: F.avg(F.when(F.col(rows), _true(cond).cast("double"))) * 100
    measures = {
        "samples": F.count(F.lit(1)), "min_temp": F.min(value), "max_temp": F.max(value), "mean_temp": F.avg(value),
        "duration_s": seconds(F.max("us"), F.min("us")), "in_range_pct": stats.pct(v.between(lo, hi)), "samples_24h": F.count_if(f"{p}day"),
        "ok_pct": within(F.col(f"{p}bad").isNull() | (F.col(f"{p}bad") < us), f"{p}day"), "max_rate_per_h": F.coalesce(F.max(rate), F.lit(0.0)),
        "critical_samples": F.count_if(f"{p}lead"), "critical_pct": within(v.between(lo, hi), f"{p}lead"), "hold_s": longest_stretch(p)}
    return Recipe(p, [held, step, dated], measures, lambda c: concrete_rules(c, lo, hi, min_samples, required))


def concrete_rules(c: Callable[[str], Column], lo: float, hi: float, min_samples: int, required: float) -> Rules:
    few = c("samples") < 5
    decided = F.when(c("samples_24h") < min_samples, "INDETERMINATE").when(c("ok_pct") >= required, "PASS").otherwise("FAIL")
    status = F.when(few, "ERROR").otherwise(decided)
    failed, unsure = status == "FAIL", status == "INDETERMINATE"
    jumpy = c("max_rate_per_h") > 5.0
    crit_bad = ~F.coalesce((c("critical_samples") > 1) & (c("critical_pct") >= 98.0), F.lit(False))
    codes = [_code(few, "too_short"), _code(unsure, "too_few_samples"), _code(failed, "first_day_out"),
             _code(failed & (c("duration_s") < 86_400), "period_short"), _code(failed & (c("in_range_pct") < 95), "range_out"),
             _code(failed & crit_bad, "critical_out"), _code(failed & (c("min_temp") < lo), "below_range"),
             _code(failed & (c("max_temp") > hi), "above_range"), _code(failed & jumpy, "unstable")]
    texts = [_text(few, "%d samples in the log", c("samples")), _text(unsure, "%d instants in the first day", c("samples_24h")),
             _text(~few & ~unsure, "first day in order for %.1f%%", c("ok_pct")),
             _text(failed & jumpy, "temperature changes by %.1f °C an hour", c("max_rate_per_h"))]
    held = F.when(~few & ~unsure & (c("in_range_pct") > 0), c("hold_s")).otherwise(0.0)
    return Rules(status, codes, texts, {"hold_s": held} | {x: c(x) for x in (
        "ok_pct", "in_range_pct", "critical_pct", "max_rate_per_h", "min_temp", "max_temp")})


def concrete_verdict(tl: Timeline, readings: DataFrame | None = None, lo=16.0, hi=27.0, value="value", humidity: str | None = "k",
                     min_samples=10, required=95.0, day_hours=24.0, period_s=86_400.0, require_humidity=False) -> DataFrame:
    """The concrete engine.  ``readings`` are the separate sensors in long form where there are several; they decide on the first day."""
    recipe = concrete_engine(lo, hi, value, humidity, min_samples, required, day_hours, period_s, require_humidity)
    if readings is None:
        return judge(tl, recipe)
    f = plain_measures(tl, recipe).drop("samples_24h", "ok_pct")
    sensors = Timeline.open(readings, tl.key, ["us", "sensor"])
    day = stats.first_day_verdict(sensors, lo, hi, value, humidity if require_humidity else None, min_samples, required, day_hours)
    return _finish(join_runs(f, day.drop("status"), key=tl.key), tl.key, concrete_rules(F.col, lo, hi, min_samples, required))


def concrete_verdict_independent(tl: Timeline, lo=10.0, hi=35.0, window_s=86_400, step_s=43_200, required=95.0,
                                 min_strength=50.0, min_days=7.0, value="value") -> DataFrame:
    line = stats.with_windows(tl, lo, hi, window_s, step_s, value).scan(_mv=following(value))
    mean = (F.col(value) + F.col("_mv")) / 2
    part = F.when(mean > stats.DATUM, (mean - stats.DATUM) * seconds(F.col("_nu"), F.col("us")) / 3600)
    edges = stats.window_edges(line, {"_part": part, "_us": F.col("us")})
    windows = stats.windows_of(edges, tl.key, required, F.sum("_part").alias("_part"), F.min("_us").alias("_a"), F.max("_us").alias("_z"))
    f = windows.groupBy(*tl.key).agg(*stats.window_totals(), seconds(F.max("_z"), F.min("_a")).alias("duration_s"),
                                     F.coalesce(F.sum("_part"), F.lit(0.0)).alias("maturity_h"))
    f = f.withColumn("strength_pct", stats.strength(F.col("maturity_h")))
    temp = F.coalesce("overall_pass", F.lit(False))
    strong, aged = F.col("strength_pct") >= min_strength, F.col("duration_s") >= min_days * 86_400
    return f.select(*tl.key, temp.alias("temperature_pass"), strong.alias("strength_pass"), aged.alias("duration_pass"),
                    (temp & strong & aged).alias("pass"), F.coalesce("total_windows", F.lit(0).cast("long")).alias("total_windows"),
                    "strength_pct", F.coalesce("mean_pct", F.lit(0.0)).alias("compliance_pct"))


# -- cold chain ------------------------------------------------------------------------------------


def coldchain_engine(lo=2.0, hi=8.0, required=95.0, samples_per_day=96.0, value="value", alarm_s=1800.0, p="_cold_") -> Recipe:
    """Share of samples in range; a log too thin for its length cannot decide."""
    v, dt = F.col(value), seconds(F.col("us"), F.col(f"{p}pu"))
    rounds = after(Round({f"{p}pu": prev("us")}), stretch_rounds(excursions.outside(lo, hi, value), p))
    over = F.col(f"{p}state") & F.col(f"{p}last")
    alarm = over & (lasted(p) >= alarm_s)
    measures = {
        "samples": F.count(F.lit(1)), "samples_outside": F.count_if(f"{p}state"), "events": F.count_if(over), "alarm_events": F.count_if(alarm),
        "max_s": longest_stretch(p), "alarm_s": F.coalesce(F.sum(F.when(alarm, lasted(p))), F.lit(0.0)),
        "in_range_s": F.sum(F.when(v.between(lo, hi), F.coalesce(dt, F.lit(0.0))).otherwise(0.0)),
        "duration_s": seconds(F.max("us"), F.min("us")), "min_temp": F.min(value), "max_temp": F.max(value)}
    return Recipe(p, rounds, measures, lambda c: coldchain_rules(c, required, samples_per_day))


def coldchain_rules(c: Callable[[str], Column], required: float, samples_per_day: float) -> Rules:
    days = c("duration_s") / 86_400
    need = F.greatest(F.lit(10).cast("long"), F.floor(days * samples_per_day))
    share = (c("samples") - c("samples_outside")) / c("samples") * 100
    thin, good = c("samples") < need, share >= required
    status = F.when(thin, "INDETERMINATE").when(good, "PASS").otherwise("FAIL")
    codes = [_code(thin, "too_few_samples"), _code(~thin & good, "in_range"), _code(~thin & ~good, "compliance_low")]
    texts = [_text(thin, "%d samples where the period asks for %d", c("samples"), need),
             _text(~thin & good, "in range for %.1f%% of the samples", share), _text(~thin & ~good, "in range for %.1f%% of the samples only", share)]
    warnings = join_reasons(_code(days < 1, "short_period"), _code(days >= 30, "extended_period"), _code(c("events") > 0, "excursions"))
    return Rules(status, codes, texts, {"hold_s": c("in_range_s"), "compliance_pct": share} | {x: c(x) for x in (
        "events", "max_s", "min_temp", "max_temp")} | {"warnings": warnings})


def coldchain_verdict(tl: Timeline, lo=2.0, hi=8.0, required=95.0, samples_per_day=96.0, value="value", alarm_s=1800.0) -> DataFrame:
    return judge(tl, coldchain_engine(lo, hi, required, samples_per_day, value, alarm_s))


def coldchain_details(tl: Timeline, lo=2.0, hi=8.0, required=95.0, alarm_s=1800.0, value="value") -> DataFrame:
    """Storage conditions in detail: daily compliance, alarms, logging interval, extremes."""
    daily = stats.daily_rollup(stats.daily_compliance(tl.rows(), lo, hi, value, tl.key), required, tl.key)
    f = join_runs(excursions.band_features(tl, lo, hi, alarm_s, value), daily, key=tl.key)
    range_ok = F.col("compliance_pct") >= required
    calm = F.col("alarm_s") <= 7200.0
    step = F.col("duration_s") / (F.col("samples") - 1)
    daily_ok = F.when(F.col("duration_s") >= 86_400, F.col("all_days_met") & (F.col("mean_day_pct") >= required)).otherwise(range_ok)
    return f.select(
        *tl.key, "compliance_pct", range_ok.alias("range_ok"), ((F.col("alarm_events") == 0) | calm).alias("alarms_ok"),
        ((F.col("alarm_events") <= 1) & calm).alias("control_ok"), daily_ok.alias("daily_ok"),
        F.coalesce(step <= 900, F.lit(False)).alias("logging_ok"),
        F.when(F.col("min_temp") < -2, "critical").when(F.col("min_temp") < lo, "below").otherwise("ok").alias("low_side"),
        F.when(F.col("max_temp") > 15, "critical").when(F.col("max_temp") > hi, "above").otherwise("ok").alias("high_side"))


def coldchain_verdict_independent(tl: Timeline, lo=2.0, hi=8.0, hard_lo=-5.0, hard_hi=15.0, max_hours=24.0, value="value") -> DataFrame:
    """Hard limits, then severity and duration of each excursion."""
    hours = F.col("duration_s") / 3600
    bad = (F.col("severity") == "critical") | (hours > max_hours) | ((F.col("severity") == "high") & (hours > 4))
    events = excursions.closed_excursions(tl, lo, hi, 0.0, value).groupBy(*tl.key).agg(F.count_if(bad).alias("bad_events"))
    ends = tl.per_run(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    f = join_runs(ends, events, key=tl.key).fillna(0, ["bad_events"])
    limits = (F.col("_lo") >= hard_lo) & (F.col("_hi") <= hard_hi)
    return f.select(*tl.key, limits.alias("limits_ok"), "bad_events", (limits & (F.col("bad_events") == 0)).alias("pass"))


# industry -> maker of the engine, by default with the limits of its rules; callers may add entries or parameters
ENGINES: dict[str, Callable[..., Recipe]] = {
    "powder": powder_engine,
    "haccp": cooling_engine,
    "autoclave": autoclave_engine,
    "sterile": sterile_engine,
    "concrete": concrete_engine,
    "coldchain": coldchain_engine,
}
