"""Air columns: ordered levels, the monotone filter, shifting onto the real ground, hydrostatics, horizons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almucantar.functions.photometry import GRAVITY, R_DRY

#: A level this close to another height adds nothing (m).
LEVEL_GAP = 15.0
#: Earth radius (m) and refraction coefficient of the horizon proxy.
R_HORIZON, REFRACTION = 6371008.8, 0.13
_LEVEL = "struct<h:double,t:double,p:double>"


def monotone(levels: Column) -> Column:
    """Levels (h, t, p) by height, each kept only if it is higher and at lower pressure than the last one kept."""
    start = F.array().cast(f"array<{_LEVEL}>")

    def step(kept: Column, level: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        return F.when((F.size(kept) == 0) | ((level["h"] > last["h"]) & (level["p"] < last["p"])), F.concat(kept, F.array(level))).otherwise(kept)

    ordered = F.array_sort(levels, lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    return F.aggregate(ordered.cast(f"array<{_LEVEL}>"), start, step)


def _level(h: Column, t: Column, p: Column) -> Column:
    return F.struct(h.cast("double").alias("h"), t.cast("double").alias("t"), p.cast("double").alias("p"))


def profile(columns: DataFrame, near: dict[int, str], near_surface: float = 2.0) -> DataFrame:
    """Adds ``profile`` to columns (orog, t2m, psfc, land, near fields, levels array of p_mb, z, t).

    The surface, the fixed heights above it with hydrostatic pressures, and the pressure levels above ground
    that are not within the gap of those, through the monotone filter. Kelvin and Pascal become Celsius and hPa.
    """
    surface = F.col("orog") + near_surface
    fixed = [
        F.when(F.col(name).isNotNull(), _level(F.col("orog") + float(agl), F.col(name) - 273.15, F.col("psfc") * F.exp(-GRAVITY * agl / (R_DRY * (F.col("t2m") + F.col(name)) / 2)) / 100))
        for agl, name in sorted(near.items())
        if agl > near_surface
    ]
    near_levels = F.array_compact(F.array(*fixed)) if fixed else F.array().cast(f"array<{_LEVEL}>")
    usable = F.filter("levels", lambda v: v["z"].isNotNull() & v["t"].isNotNull() & (v["p_mb"] * 100 < F.col("psfc")) & (v["z"] > surface + LEVEL_GAP) & F.forall(near_levels, lambda n: F.abs(v["z"] - n["h"]) > LEVEL_GAP))
    above = F.transform(usable, lambda v: _level(v["z"], v["t"] - 273.15, v["p_mb"]))
    ground = F.array(_level(surface, F.col("t2m") - 273.15, F.col("psfc") / 100))
    return columns.withColumn("profile", monotone(F.concat(ground, near_levels, above))).withColumn("water", F.col("land") < 0.5)


def follow_terrain(levels: Column, model_ground: Column, ground: Column, full: float = 500.0, fade: float = 2000.0) -> Column:
    """Levels moved by the ground's difference, wholly up to ``full`` m above it and less and less up to ``fade``.

    Pressures of moved levels are recomputed from the lowest unmoved one down, or, if all moved, from the
    surface up. Differences under 1 m leave the levels as they are.
    """
    shift = ground - model_ground
    top = F.greatest(F.lit(fade), F.abs(shift) * 2 + full)

    def weight(v: Column) -> Column:
        a = v["h"] - model_ground
        return F.when(a <= full, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (a - full) / (top - full)))

    moved = F.transform(levels, lambda v: _level(v["h"] + shift * weight(v), v["t"], F.when(weight(v) > 0, F.lit(None)).otherwise(v["p"])))

    def pressure(p: Column, rise: Column, a: Column, b: Column) -> Column:
        return p * F.exp(-GRAVITY * rise / (R_DRY * ((a["t"] + b["t"]) / 2 + 273.15)))

    def down(done: Column, v: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        p = F.coalesce(v["p"], pressure(last["p"], v["h"] - last["h"], last, v))
        return F.concat(done, F.array(_level(v["h"], v["t"], p)))

    empty = F.array().cast(f"array<{_LEVEL}>")
    from_top = F.reverse(F.aggregate(F.reverse(moved), empty, down))
    first, second = F.element_at(levels, 1), F.element_at(moved, 1)
    base = first["p"] * F.exp(-GRAVITY * shift / (R_DRY * (first["t"] + 273.15)))
    from_base = F.aggregate(F.slice(moved, F.lit(2), F.greatest(F.size(moved) - 1, F.lit(0))), F.array(_level(second["h"], second["t"], base)), down)
    return F.when((F.size(levels) == 0) | (F.abs(shift) < 1), levels).when(F.exists(moved, lambda v: v["p"].isNotNull()), from_top).otherwise(from_base)


def running_pressure(rows: DataFrame, keys: list[str], order: str, rise: str, kelvin: str, start: float) -> DataFrame:
    """Pressure carried up through layers (rise in m, mean temperature in K) from ``start``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("pressure", F.exp(F.sum(-GRAVITY * F.col(rise) / (R_DRY * F.col(kelvin))).over(w)) * start)


def horizon_proxy(height: Column, eye: Column, metres: Column, k: float = REFRACTION, floor: Column | None = None) -> Column:
    """How high a point stands seen over a curved Earth with refraction: a slope, not an angle."""
    h = F.greatest(height, floor) if floor is not None else height
    return (h - eye) / metres - metres * (1 - k) / (2 * R_HORIZON)


def horizon(samples: DataFrame, keys: list[str]) -> DataFrame:
    """The highest point of each direction (azimuth) of samples (metres, height, eye); ties to the nearest."""
    angle = horizon_proxy(F.col("height"), F.col("eye"), F.col("metres"))
    best = F.max_by(F.struct("metres", "height"), F.struct(angle, F.negative("metres")))
    return samples.groupBy(*keys, "azimuth").agg(F.max(angle).alias("slope"), best.alias("b")).select(*keys, "azimuth", "slope", F.col("b.metres").alias("metres"), F.col("b.height").alias("height"))


def distance_steps(min_km: float, max_km: float, fine: bool = True) -> list[float]:
    """Distances in metres, growing with range: a fixed, short list that the driver makes."""
    grow, least = (0.004, 15.0) if fine else (0.015, 40.0)
    out, d = [], max(30.0, min_km * 1000)
    while d <= max_km * 1000:
        out.append(d)
        d += max(least, d * grow)
    return out


def azimuth_ranges(rows: DataFrame, keys: list[str], azimuth: str, step: float) -> DataFrame:
    """Azimuths at most one and a half steps apart as ranges, a step wider on both sides."""
    from almucantar.operators.relational import islands

    runs = islands(rows, keys, azimuth, step * 1.5)
    return runs.select(*keys, F.pmod(F.col("first") - step, F.lit(360.0)).alias("lo"), F.pmod(F.col("last") + step, F.lit(360.0)).alias("hi"))


def candidate_grid(lat0: float, lon0: float, radius_km: float, grid_m: float) -> list[tuple[float, float]]:
    """Spots of a disc around a place, its own first: a short list that the driver makes."""
    n = int(radius_km * 1000 // grid_m)
    dlat = grid_m / 111195.0
    dlon = dlat / math.cos(math.radians(lat0))
    return [(lat0, lon0)] + [(lat0 + i * dlat, lon0 + j * dlon) for i in range(-n, n + 1) for j in range(-n, n + 1) if (i or j) and math.hypot(i, j) * grid_m <= radius_km * 1000]


def filled_heights(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Levels (p hPa, z, t Celsius) with missing heights from the nearest known level at higher pressure, else from the first known.

    Columns without any known height are left out.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("p"))
    known = F.when(F.col("z").isNotNull(), F.struct("p", "z", "t"))
    base = F.coalesce(F.last(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first(known, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = levels.withColumn("_k", base).where("_k is not null")
    z = F.col("_k.z") + R_DRY * ((F.col("_k.t") + F.col("t")) / 2 + 273.15) / GRAVITY * F.log(F.col("_k.p") / F.col("p"))
    return rows.withColumn("z", F.coalesce("z", z)).drop("_k")


def rising(rows: DataFrame, keys: list[str], gap: float = 0.5) -> DataFrame:
    """Levels (p, z, t) of each column from the highest pressure up, each kept only if ``gap`` above the last one kept."""
    ordered = F.array_sort(F.collect_list(F.struct(F.negative("p").alias("_o"), "p", "z", "t")))
    kind = "array<struct<_o:double,p:double,z:double,t:double>>"

    def step(kept: Column, v: Column) -> Column:
        return F.when((F.size(kept) == 0) | (v["z"] > F.try_element_at(kept, F.lit(-1))["z"] + gap), F.concat(kept, F.array(v))).otherwise(kept)

    kept = rows.groupBy(*keys).agg(F.aggregate(ordered.cast(kind), F.array().cast(kind), step).alias("_kept"))
    return kept.select(*keys, F.explode("_kept").alias("v")).select(*keys, "v.p", "v.z", "v.t")
