"""Process specifications: validation, adaptation and dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.functions.scalars import one_of
from tempaudit.operators.timeline import keyed_join
from tempaudit.session import few_listing_tasks

SPEC_SCHEMA = """
version string, industry string, job struct<job_id: string>,
spec struct<method: string, target_temp_C: double, hold_time_s: long, temp_band_C: struct<min: double, max: double>,
  sensor_uncertainty_C: double>,
data_requirements struct<max_sample_period_s: double, allowed_gaps_s: double>,
sensor_selection struct<mode: string, sensors: array<string>, require_at_least: int>,
logic struct<continuous: boolean, max_total_dips_s: long>,
preconditions struct<max_ramp_rate_C_per_min: double, max_time_to_threshold_s: long>,
parameter_requirements struct<require_pressure: boolean, require_fo: boolean, require_humidity: boolean,
  require_gas_concentration: boolean>,
reporting struct<units: string, language: string, timezone: string>
"""

# fixed values: legacy spellings
METHOD_ALIASES = {"REFRIGERATION": "OVEN_AIR", "AMBIENT_CURE": "OVEN_AIR", "ETO_STERILIZATION": "OVEN_AIR"}
MODE_ALIASES = {"mean": "mean_of_set", "min": "min_of_set", "majority": "majority_over_threshold"}
INDUSTRY_ALIASES = {"powder-coating": "powder", "cold-chain": "coldchain", "eto": "sterile"}
INDUSTRIES = ("powder", "haccp", "autoclave", "sterile", "concrete", "coldchain")

# fixed values per industry: (parameter holding the target, default), (parameter holding the hold
# time, default, seconds per unit), uncertainty, method
ADAPTATION = {
    "powder": (("target_temp", 180.0), ("hold_duration_minutes", 10.0, 60), None, "PMT"),
    "autoclave": (("sterilization_temp", 121.0), ("sterilization_time_minutes", 15.0, 60), 2.0, "OVEN_AIR"),
    "coldchain": (("max_temp", 8.0), (None, 1.0, 3600), 1.0, "OVEN_AIR"),
    "haccp": (("temp_1", 135.0), ("time_1_to_2_hours", 2.0, 3600), 2.0, "OVEN_AIR"),
    "concrete": (("max_temp", 30.0), ("time_window_hours", 24.0, 3600), 2.0, "OVEN_AIR"),
    "sterile": (("min_temp", 55.0), ("exposure_hours", 12.0, 3600), 2.0, "OVEN_AIR"),
}
OTHER = (("target_temp", 100.0), ("hold_time_s", 600.0, 1), None, "OVEN_AIR")


def canonical_industry(name: Column) -> Column:
    return one_of(F.lower(F.trim(name)), INDUSTRY_ALIASES)


def read_specs(spark, path: str) -> DataFrame:
    """One row per specification file; malformed files keep their text for the quarantine."""
    reader = spark.read.schema(SPEC_SCHEMA + ", _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    with few_listing_tasks(spark):
        return reader.json(path)


def adapt(parameters: Column, industry: Column) -> Column:
    """Version-2 parameter map to the version-1 specification struct, defaults and units by industry."""

    def build(rule):
        (target, t_default), (hold, h_default, unit), uncertainty, method = rule
        get = lambda key, default: F.coalesce(parameters[key].try_cast("double"), F.lit(default)) if key else F.lit(default)
        u = F.lit(uncertainty) if uncertainty is not None else get("sensor_uncertainty", 2.0)
        return F.struct(
            F.lit(method).alias("method"), get(target, t_default).alias("target_temp_C"),
            (get(hold, h_default) * unit).cast("long").alias("hold_time_s"), u.alias("sensor_uncertainty_C"))

    out = build(OTHER)
    for name in reversed(INDUSTRIES):
        out = F.when(industry == name, build(ADAPTATION[name])).otherwise(out)
    return out


def rule_violations(s: str = "") -> Column:
    """Names of the validation rules a specification row breaks."""
    c = lambda path: F.col(f"{s}{path}")
    method = one_of(c("spec.method"), METHOD_ALIASES)
    bad = lambda cond, text: F.when(cond, F.lit(text))
    sensors = c("sensor_selection.sensors")
    return F.array_compact(F.array(
        bad(c("version") != "1.0", "version"),
        bad(c("job.job_id").isNull() | ~c("job.job_id").rlike("^[a-zA-Z0-9_-]{1,100}$"), "job_id"),
        bad(c("spec.method").isNull() | ~method.isin("PMT", "OVEN_AIR"), "method"),
        bad(c("spec.target_temp_C").isNull() | (c("spec.target_temp_C") <= 0) | (c("spec.target_temp_C") > 300), "target_temp_C"),
        bad(c("spec.hold_time_s").isNull() | ~c("spec.hold_time_s").between(1, 172_800), "hold_time_s"),
        bad(c("spec.temp_band_C.min") > c("spec.temp_band_C.max"), "temp_band_C"),
        bad(~c("spec.sensor_uncertainty_C").between(0, 10), "sensor_uncertainty_C"),
        bad(~c("data_requirements.max_sample_period_s").between(1, 3600), "max_sample_period_s"),
        bad(~c("data_requirements.allowed_gaps_s").between(0, 7200), "allowed_gaps_s"),
        bad(F.size(sensors) == 0, "sensors_empty"),
        bad(F.size(F.array_distinct(sensors)) != F.size(sensors), "sensors_not_unique"),
        bad(F.exists(sensors, lambda x: F.trim(x) == ""), "sensor_name_empty"),
        bad(c("sensor_selection.require_at_least") < 1, "require_at_least"),
        bad(c("logic.max_total_dips_s") < 0, "max_total_dips_s"),
        bad(c("preconditions.max_ramp_rate_C_per_min") < 0, "max_ramp_rate_C_per_min"),
        bad(c("preconditions.max_time_to_threshold_s") < 1, "max_time_to_threshold_s"),
        bad((c("industry").isin("haccp", "autoclave", "sterile", "concrete", "coldchain")) & (method != "OVEN_AIR"), "industry_method"),
    ))


def split_valid(specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid specifications and the quarantine with its reasons."""
    judged = specs.withColumn("violations", rule_violations())
    return judged.filter(F.size("violations") == 0), judged.filter(F.size("violations") > 0)


def dispatch(samples: DataFrame, specs: DataFrame, engines: dict) -> DataFrame:
    """Route each run to its industry's engine and stack the verdicts.

    ``engines`` maps a canonical industry to ``function(samples, specs) -> verdicts``; callers may
    add their own.
    """
    routed = specs.withColumn("industry", canonical_industry(F.col("industry")))
    parts = []
    for name, engine in engines.items():
        mine = routed.filter(F.col("industry") == name)
        if "industry" in samples.columns:  # stored by industry: each engine reads its own partition only
            rows = samples.filter(F.col("industry") == name)
        else:
            rows = keyed_join(samples, mine.select("run_id"), "run_id", ["us", "seq"], "left_semi")
        parts.append(engine(rows, mine))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
