"""Sky brightness and thermodynamics of columns as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Natural zenith brightness (mcd/m2), sky average over zenith, gravity, gas constant of dry air.
NATURAL, SKY_AVERAGE = 0.174, 2.25
GRAVITY, R_DRY = 9.80665, 287.05


def mag_arcsec2(mcd: Column) -> Column:
    """Luminance to surface brightness."""
    return F.log10(mcd * 1e-3 / 108000.0) * -2.5


def sqm_to_artificial(mag: Column) -> Column:
    """A sky-meter reading to artificial brightness."""
    return F.greatest(F.pow(F.lit(10.0), mag * -0.4) * 108000.0e3 - NATURAL, F.lit(0.0))


def describe(mcd: Column) -> dict[str, Column]:
    """What every brightness answer carries."""
    v = F.greatest(mcd, F.lit(0.0))
    return {"artificial_mcd": v, "artificial_cd": v * 1e-3, "blp_cd": v * 1e-3 * SKY_AVERAGE, "ratio_natural": v / NATURAL, "total_mag": mag_arcsec2(v + NATURAL)}


def corrected(mcd: Column, factor: Column) -> Column:
    """Brightness scaled with its natural part, at least 0."""
    return F.greatest((mcd + NATURAL) * factor - NATURAL, F.lit(0.0))


def trend_factor(rate: Column, from_year: Column, to_year: Column) -> Column:
    """Growth by a yearly rate."""
    return F.pow(rate + 1.0, to_year - from_year)


def to_kelvin(v: Column, units: Column) -> Column:
    """Kelvin from a value with named units."""
    return F.when(F.lower(F.trim(units)).isin("degc", "c", "celsius", "deg c", "degrees_celsius"), v + 273.15).otherwise(v)


def to_pascal(v: Column, units: Column) -> Column:
    """Pascal from a value with named units."""
    return F.when(F.lower(F.trim(units)).isin("mb", "hpa", "millibar", "millibars"), v * 100.0).otherwise(v)


def hydrostatic(p: Column, rise: Column, kelvin: Column) -> Column:
    """Pressure after rising through air of a mean temperature."""
    return p * F.exp(-GRAVITY * rise / (R_DRY * kelvin))


def sea_level_celsius(kelvin: Column, height: Column) -> Column:
    """Temperature reduced to sea level by the standard lapse."""
    return kelvin - 273.15 + 0.0065 * height


def surface_floor(ground: Column) -> Column:
    """Real low ground counts; what lies just under sea level is the sea's floor."""
    return F.when(ground < -20, ground).otherwise(0.0)


def real_ground(samples: Column, model_ground: Column) -> Column:
    """Mean of samples; heights under sea level count only in a depression."""
    mean = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x) / F.size(samples)
    dry = F.aggregate(samples, F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(0.0))) / F.size(samples)
    return F.when((model_ground >= -20) & (mean >= -20), dry).otherwise(mean)
