"""Unit conversions and unit inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.operators.timeline import keyed_join

PSI_TO_KPA = 6.895
BAR_TO_KPA = 100.0


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def celsius_to_fahrenheit(c: Column) -> Column:
    return c * 9 / 5 + 32


def psi_to_kpa(p: Column) -> Column:
    return p * PSI_TO_KPA


def kpa_to_psi(p: Column) -> Column:
    return p / PSI_TO_KPA


def bar_to_kpa(p: Column) -> Column:
    return p * BAR_TO_KPA


def pressure_unit(lowest: Column, highest: Column) -> Column:
    """Unit of a pressure series from its extremes."""
    return (
        F.when(highest.between(0.8, 3.0) & (lowest >= 0.5), "bar")
        .when(highest.between(10, 50) & (lowest >= 5), "psi")
        .when(highest.between(80, 300) & (lowest >= 50), "kPa")
        .otherwise("unknown"))


def to_kpa(p: Column, unit: Column) -> Column:
    return F.when(unit == "bar", bar_to_kpa(p)).when(unit == "psi", psi_to_kpa(p)).otherwise(p)


def with_pressure_kpa(df: DataFrame, pressure="k", key=("run_id",)) -> DataFrame:
    """Pressure in kPa by the unit inferred for each run."""
    unit = df.groupBy(*key).agg(pressure_unit(F.min(pressure), F.max(pressure)).alias("pressure_unit"))
    return keyed_join(df, unit, key, ["us", "seq"]).withColumn("pressure_kpa", to_kpa(F.col(pressure), F.col("pressure_unit")))


def named_fahrenheit(name: Column) -> Column:
    """Whether a column name says Fahrenheit, by whole tokens (``shelf`` does not)."""
    return F.lower(name).rlike(r"(^|[_\s(\[])(°?f|deg_?f|fahrenheit)($|[_\s)\]])|°f|degf|fahrenheit")


def looks_fahrenheit(n: Column, mean: Column, lowest: Column, highest: Column) -> Column:
    """Range heuristic for cure processes; off unless asked for, since hot Celsius runs match it too."""
    hot = (mean > 80) & (highest > 200)
    warm = (lowest > 32) & (mean > 100) & (highest > 300)
    return (n > 5) & (hot | warm)


def celsius_samples(df: DataFrame, value="value", sensor="sensor", key=("run_id",), heuristic=False,
                    units: DataFrame | None = None) -> DataFrame:
    """Long-form temperatures in Celsius.

    ``units`` (sensor, unit) is the caller's own table and overrides the name and range rules.
    """
    named = named_fahrenheit(F.col(sensor))
    if heuristic:
        shape = df.groupBy(*key, sensor).agg(
            looks_fahrenheit(F.count(value), F.avg(value), F.min(value), F.max(value)).alias("_hot"))
        df, named = keyed_join(df, shape, [*key, sensor], ["us", "seq"]), named | F.col("_hot")
    if units is not None:
        df = df.join(units.select(F.col("sensor").alias(sensor), F.col("unit").alias("_unit")), sensor, "left")
        named = F.when(F.col("_unit").isNotNull(), F.lower("_unit").isin("f", "°f", "fahrenheit")).otherwise(named)
    out = df.withColumn("converted", F.coalesce(named, F.lit(False)))
    return out.withColumn(value, F.when(F.col("converted"), fahrenheit_to_celsius(F.col(value))).otherwise(F.col(value))).drop(
        "_hot", "_unit")
