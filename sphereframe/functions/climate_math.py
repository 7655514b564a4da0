"""Pointwise rules on climate channels and stored model channels."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import clip

# Channel order of a guide and the units of the five climate bands.
CHANNELS = ["heightmap", "temperature", "temperature_std", "precipitation", "precipitation_cv"]
BAND_UNITS = {
    "baseline": ("Air temperature at the surface height", "degC"),
    "temp_std100": ("Seasonal spread of temperature", "degC"),
    "precip": ("Rain and snow in a year", "mm"),
    "precip_cv": ("Relative spread of monthly precipitation", "%"),
    "beta": ("Change of temperature with height", "degC/m"),
}


def standardise(value, mean, std) -> Column:
    return (value - mean) / std


def unstandardise(value, mean, std) -> Column:
    return value * std + mean


def channel_difference(first, second) -> Column:
    """The part of one stored channel that another does not explain."""
    return first - second


def mix_signal_noise(signal, noise, snr: float) -> Column:
    """Rotate between a signal and unit noise by the angle ``atan(snr)``."""
    angle = math.atan(snr)
    return F.lit(math.cos(angle)) * signal + F.lit(math.sin(angle)) * noise


def finalise_climate(df: DataFrame, *, a_temp_std: float, b_temp_std: float, temp_std_p1: float,
                     temp_std_p99: float, elev="elev", temp="temp", temp_std="temp_std",
                     precip="precip", precip_std="precip_cv") -> DataFrame:
    """Physical climate channels from raw ones: lapse, cold stretch, spread and damping.

    The four coefficients describe the training population and are inputs, never constants.
    """
    lapse = clip(F.lit(-6.5) + F.lit(0.0015) * F.col(precip), -9.8, -4.0) / F.lit(1000.0)
    df = df.withColumn("__t", clip(F.col(temp) + lapse * F.greatest(F.lit(0.0), F.col(elev)),
                                   -10.0, 40.0))
    df = df.withColumn(temp, F.when(F.col("__t") > 20, F.col("__t"))
                       .otherwise((F.col("__t") - F.lit(20.0)) * F.lit(1.25) + F.lit(20.0))).drop("__t")
    trend = F.lit(a_temp_std) * F.col(temp) + F.lit(b_temp_std)
    share = (F.col(temp_std) - F.lit(temp_std_p1)) / F.lit(temp_std_p99 - temp_std_p1)
    df = df.withColumn("__base", F.greatest(F.lit(float(temp_std_p1)), -trend))
    df = df.withColumn(temp_std, F.greatest(
        share * (F.lit(temp_std_p99) - F.col("__base")) + F.col("__base") + trend, F.lit(20.0)))
    damp = F.greatest(F.lit(0.0), (F.lit(185.0) - F.lit(0.04111) * F.col(precip)) / F.lit(185.0))
    return df.withColumn(precip_std, F.col(precip_std) * damp).drop("__base")


def adjust_to_elevation(df: DataFrame, elevation: str, baseline="baseline", beta="beta",
                        temp_std100="temp_std100", out_temp="temp", out_std="temp_std") -> DataFrame:
    """Temperature at an elevation, and spread back in degrees."""
    return df.withColumns({
        out_temp: F.col(baseline) + F.col(beta) * F.greatest(F.col(elevation), F.lit(0.0)),
        out_std: F.col(temp_std100) / F.lit(100.0)})


def parse_weight_list(text: Column) -> Column:
    """Five channel weights from a comma list; NULL when the list breaks the contract."""
    values = F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("double"))
    good = (F.size(values) == 5) & F.forall(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0.01) & (v <= 4))
    return F.when(good, values)


def describe_bands(df: DataFrame) -> DataFrame:
    """Attach band names and units as column metadata."""
    for column, (text, unit) in BAND_UNITS.items():
        if column in df.columns:
            df = df.withMetadata(column, {"description": text, "unit": unit})
    return df
