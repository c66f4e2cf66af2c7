"""Heights from tiles, horizons with the crests between samples, directions of the Sun and the Moon, spots of an area."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almucantar.operators import columns, relational

#: Earth radius (m), refraction coefficient, metres in a degree.
R_EARTH, REFRACTION, M_PER_DEGREE = 6371008.8, 0.13, 111194.9
#: Highest maxima that are sampled anew, samples in each window, steps to either side.
PEAKS, SAMPLES, REACH = 3, 81, 2
#: Largest declinations of the Sun and the Moon (degrees), how high a horizon the Moon's range covers.
SUN_DECLINATION, MOON_DECLINATION, MOON_HORIZON = 23.44, 28.75, 10.0


def destinations(lat: Column, lon: Column, azimuth: Column, metres: Column) -> tuple[Column, Column]:
    """Where rays get to: latitude, and longitude that is not wrapped."""
    d, p, a = metres / R_EARTH, F.radians(lat), F.radians(azimuth)
    up = F.greatest(F.least(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(a), F.lit(1.0)), F.lit(-1.0))
    return F.degrees(F.asin(up)), lon + F.degrees(F.atan2(F.sin(a) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * up))


def tile_heights(points: DataFrame, cells: DataFrame, key: str, n: int, size: float = 1.0, sea: float | None = 0.0) -> DataFrame:
    """key, height of points (key, lat, lon; keys that differ) between the four cells around them.

    ``cells`` has ti, tj (south-west corner over ``size``), row, col, h of n x n cells, row 0 in the north; edges are in
    both tiles. Without a tile the height is ``sea``; longitudes are wrapped. Cells are looked up by number.
    """
    at = points.select(key, F.col("lat").alias("_lat"), (F.pmod(F.col("lon") + 180.0, F.lit(360.0)) - 180.0).alias("_lon"))
    at = at.withColumns({"ti": F.floor(F.col("_lat") / size), "tj": F.floor(F.col("_lon") / size)})
    at = at.withColumns({"_r": ((F.col("ti") + 1) * size - F.col("_lat")) / size * (n - 1), "_c": (F.col("_lon") - F.col("tj") * size) / size * (n - 1)})
    low = lambda x: F.greatest(F.least(F.floor(x), F.lit(n - 2)), F.lit(0)).cast("int")
    at = at.withColumns({"_i": low("_r"), "_j": low("_c")})
    fy, fx = F.col("_r") - F.col("_i"), F.col("_c") - F.col("_j")
    corner = lambda a, b: F.struct((F.col("_i") + a).alias("row"), (F.col("_j") + b).alias("col"), ((fy if a else F.lit(1.0) - fy) * (fx if b else F.lit(1.0) - fx)).alias("w"))
    spread = at.select(key, "ti", "tj", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("_k")).select(key, "ti", "tj", "_k.row", "_k.col", "_k.w")
    hit = spread.join(cells, ["ti", "tj", "row", "col"]).groupBy(key).agg(F.sum(F.col("w") * F.col("h")).alias("_h"), F.count("h").alias("_n"))
    whole = F.when(F.col("_n") == 4, F.col("_h")).when(F.col("_n").isNull(), F.lit(sea).cast("double"))
    return points.select(key).join(hit, key, "left").select(key, whole.alias("height"))


def ground_heights(points: DataFrame, coarse: DataFrame, fine: DataFrame, key: str, n: int, fine_n: int, fine_size: float) -> DataFrame:
    """key, height: the fine tiles' where they have one, else the coarse ones'."""
    a = tile_heights(points, fine, key, fine_n, fine_size, None).withColumnRenamed("height", "_fine")
    return tile_heights(points, coarse, key, n).join(a, key).select(key, F.coalesce("_fine", "height").alias("height"))


def _slope(factor: float) -> Column:
    """How high a sample stands, with a term of curvature and refraction for each metre."""
    return (F.col("height") - F.col("eye")) / F.col("metres") - F.col("metres") * factor


def crests(observers: DataFrame, azimuths: list[float], steps: list[float], heights: Callable[[DataFrame], DataFrame], alternates: list[float] | None = None, refine: bool = True) -> DataFrame:
    """site, azimuth, slope, metres, height (and alternates, lowest) of the horizon of observers (site, lat, lon, eye, floor).

    Rays are sampled at ``steps`` (metres, a short list); around the highest maxima of each, and around each alternate
    coefficient's highest sample, they are sampled anew, so that crests between two steps count. ``heights`` adds
    ``height`` to rows with lat and lon, from tiles or whatever else there is. With ``alternates`` (coefficients of
    refraction) the points that are highest under these, if they are not the main crest nor at the floor, are listed
    by distance, and the lowest height out to the farthest point.
    """
    k = len(steps)
    main = (1 - REFRACTION) / (2 * R_EARTH)
    factors = {f"_s{i}": (1 - c) / (2 * R_EARTH) for i, c in enumerate(alternates or [])}
    ray = ["site", "azimuth"]

    def sampled(rows: DataFrame) -> DataFrame:
        lat2, lon2 = destinations(F.col("_lat"), F.col("_lon"), F.col("azimuth"), F.col("metres"))
        out = heights(rows.withColumns({"lat": lat2, "lon": lon2})).withColumn("height", F.greatest("height", "floor"))
        return out.withColumns({"slope": _slope(main)} | {name: _slope(f) for name, f in factors.items()})

    own = relational.spread(observers, len(azimuths) * k).select("site", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "eye", "floor").withColumn("azimuth", F.explode(F.lit([float(a) for a in azimuths])))
    coarse = sampled(own.select("*", F.posexplode(F.lit([float(d) for d in steps])).alias("at", "metres"))).withColumns({"stage": F.lit(0), "order": F.col("at")})
    parts = coarse
    if refine and k >= 3:
        along = Window.partitionBy(*ray).orderBy("at")
        before, after = F.lag("slope").over(along), F.lead("slope").over(along)
        peak = before.isNull() | after.isNull() | ((F.col("slope") >= before) & (F.col("slope") >= after))
        ranked = coarse.withColumn("_peak", F.when(peak, F.col("slope"))).withColumn("_rank", F.row_number().over(Window.partitionBy(*ray).orderBy(F.desc_nulls_last("_peak"), "at")))
        best = [F.max_by("at", F.struct(F.col(name), F.negative("at"))).alias(name) for name in factors]
        centres = ranked.groupBy(*ray).agg(F.sort_array(F.collect_list(F.when(F.col("_rank") <= PEAKS, F.struct("_rank", "at")))).alias("_top"), *best)  # as many as windows
        listed = F.concat(F.transform("_top", lambda t: t["at"]), F.array(*[F.col(name) for name in factors]).cast("array<int>"))
        windows = centres.select(*ray, F.posexplode(listed).alias("window", "centre"))
        edge = F.lit([float(d) for d in steps])
        lo, hi = F.element_at(edge, F.greatest(F.col("centre") - REACH, F.lit(0)) + 1), F.element_at(edge, F.least(F.col("centre") + REACH, F.lit(k - 1)) + 1)
        anew = windows.withColumns({"_lo": lo, "_hi": hi}).withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES - 1))))
        anew = anew.select(*ray, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_f") / float(SAMPLES - 1))).alias("metres"), (F.col("window") * SAMPLES + F.col("_f")).alias("order"))
        parts = coarse.drop("at").unionByName(sampled(anew.join(own, ray)).withColumn("stage", F.lit(1)))
    point = F.struct("metres", "height")
    first = lambda name: F.max_by(point, F.struct(F.col(name), F.negative("stage"), F.negative("order")))
    lowest = [F.sort_array(F.collect_list(F.when(F.col("stage") == 0, F.struct("metres", "height")))).alias("_all")] if factors else []
    out = parts.groupBy(*ray).agg(F.max("slope").alias("slope"), first("slope").alias("_p"), F.first("floor").alias("_floor"), *[first(name).alias(name) for name in factors], *lowest)
    if not factors:
        return out.select(*ray, "slope", "_p.metres", "_p.height")
    apart = lambda q: (F.abs(q["metres"] - F.col("_p.metres")) > 2 * F.greatest(F.lit(15.0), F.col("_p.metres") * 0.004)) & (q["height"] > F.col("_floor"))
    out = out.withColumn("alternates", F.array_sort(F.array_distinct(F.filter(F.array(*[F.col(name) for name in factors]), apart))))
    far = F.greatest(F.col("_p.metres"), F.coalesce(F.array_max(F.transform("alternates", lambda q: q["metres"])), F.lit(0.0)))
    low = F.array_min(F.transform(F.filter("_all", lambda q: q["metres"] <= far), lambda q: q["height"]))
    return out.select(*ray, "slope", "_p.metres", "_p.height", "alternates", low.alias("lowest"))


def vantage(profiles: DataFrame, area: str, tolerance: float, most: int = 12, step: float = 0.5) -> DataFrame:
    """area, spot, ranges, width of profiles (area, spot, azimuth, slope): the spots that serve an area, the widest first.

    Few spots such that each direction has one within ``tolerance`` of its lowest horizon; a spot's ranges are the
    directions that it serves, a step wider on both sides.
    """
    from almucantar.operators import kernels

    chosen = kernels.cover(profiles, area, tolerance, most).select(area, "spot")
    least = profiles.groupBy(area, "azimuth").agg(F.min("slope").alias("_least"))
    good = profiles.join(chosen, [area, "spot"]).join(least, [area, "azimuth"]).where(F.col("slope") <= F.col("_least") + tolerance)
    wide = columns.azimuth_ranges(good, [area, "spot"], "azimuth", step).withColumn("_w", F.pmod(F.col("hi") - F.col("lo"), F.lit(360.0)))
    out = wide.groupBy(area, "spot").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"), F.sum("_w").alias("width"))
    return out.orderBy(area, F.desc("width"), "spot")


def standable(spots: DataFrame, floor: Column, area: str) -> DataFrame:
    """Spots (area, spot, height) that are not in the sea, 3 m under the floor; all of an area's if none is."""
    dry = F.col("height") >= floor - 3.0
    return spots.withColumn("_dry", dry).withColumn("_any", F.max("_dry").over(Window.partitionBy(area))).where("_dry or not _any").drop("_dry", "_any")


def percentile_spots(profiles: DataFrame, area: str, share: float) -> DataFrame:
    """area, azimuth, spot, level: the spot whose horizon, less the tilt of its zenith, stands at the higher percentile.

    ``profiles`` has area, spot, azimuth, slope, and the spot's distance (m) and bearing (degrees) from the area's place.
    """
    tilt = F.col("metres") / R_EARTH * F.cos(F.radians(F.col("azimuth") - F.col("bearing")))
    spots = F.sort_array(F.collect_list(F.struct((F.col("slope") - tilt).alias("level"), "spot")))  # the spots of one area
    grouped = profiles.groupBy(area, "azimuth").agg(spots.alias("_s"))
    level = F.element_at("_s", F.ceil(F.round((F.size("_s") - 1) * share, 9)).cast("int") + 1)["level"]
    picked = F.element_at(F.filter("_s", lambda q: q["level"] == level), 1)
    return grouped.select(area, "azimuth", picked["spot"].alias("spot"), picked["level"].alias("level"))


def rise_ranges(places: DataFrame, declination: float = SUN_DECLINATION, margin: Column | float = 3.0) -> DataFrame:
    """Adds rise_lo, rise_hi, set_lo, set_hi to places (lat, ...): the year's directions of rise and set, widened."""
    x = F.lit(math.sin(math.radians(declination))) / F.cos(F.radians("lat"))
    spread = F.when(x >= 1, 90.0).otherwise(F.degrees(F.asin(F.least(x, F.lit(1.0)))))
    wide = spread + (F.lit(margin) if isinstance(margin, float) else margin)
    return places.withColumns({"rise_lo": F.lit(90.0) - wide, "rise_hi": F.lit(90.0) + wide, "set_lo": F.lit(270.0) - wide, "set_hi": F.lit(270.0) + wide})


def _rising(phi: Column, dec: Column, turn: Column) -> tuple[Column, Column]:
    """Azimuth and altitude in degrees at an hour angle."""
    up = F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(turn)
    azimuth = F.degrees(F.atan2(F.negative(F.cos(dec) * F.sin(turn)), F.sin(dec) * F.cos(phi) - F.cos(dec) * F.sin(phi) * F.cos(turn)))
    return F.pmod(azimuth, F.lit(360.0)), F.degrees(F.asin(F.greatest(F.least(up, F.lit(1.0)), F.lit(-1.0))))


def rise_path(places: DataFrame, declinations: list[float], most_altitude: float, step: float = 0.02) -> DataFrame:
    """Rows (place, declination, k, azimuth, altitude) of bodies that rise over places (place, lat), by steps of the hour
    angle from the horizon up to the first at ``most_altitude`` or the culmination; none where they do not rise."""
    at = places.select("place", F.radians("lat").alias("_phi")).withColumn("declination", F.explode(F.lit([float(d) for d in declinations])))
    at = at.withColumn("_dec", F.radians("declination")).withColumn("_cos", F.negative(F.tan("_phi") * F.tan("_dec"))).where("_cos > -1 and _cos < 1")
    at = at.withColumn("_h0", F.negative(F.acos("_cos")))
    size = math.radians(step)
    at = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.negative("_h0") / size).cast("int")))).where(F.col("_h0") + F.col("k") * size < 0)
    azimuth, altitude = _rising(F.col("_phi"), F.col("_dec"), F.col("_h0") + F.col("k") * size)
    _, before = _rising(F.col("_phi"), F.col("_dec"), F.col("_h0") + (F.col("k") - 1) * size)
    return at.where((F.col("k") == 0) | (before < most_altitude)).select("place", "declination", "k", azimuth.alias("azimuth"), altitude.alias("altitude"))


def moon_ranges(places: DataFrame, horizon: float = MOON_HORIZON) -> DataFrame:
    """``rise_ranges`` of the Moon over places (place, lat), widened by how far it drifts outward until it stands at ``horizon``."""
    path = rise_path(places, [MOON_DECLINATION, -MOON_DECLINATION], horizon, 0.05)
    start = F.min_by("azimuth", "k").over(Window.partitionBy("place", "declination"))
    out = path.withColumn("_a0", start).withColumn("_out", F.when(F.col("_a0") > 90, F.col("azimuth") - F.col("_a0")).otherwise(F.col("_a0") - F.col("azimuth")))
    drift = out.groupBy("place").agg(F.greatest(F.max("_out"), F.lit(0.0)).alias("drift"))
    at = places.join(drift, "place", "left").withColumn("drift", F.coalesce("drift", F.lit(0.0)))
    x = F.lit(math.sin(math.radians(MOON_DECLINATION))) / F.cos(F.radians("lat"))
    spread = F.when(x >= 1, 90.0).otherwise(F.degrees(F.asin(F.least(x, F.lit(1.0)))))
    return rise_ranges(at, MOON_DECLINATION, F.least(F.col("drift") + 1.3, F.lit(179.0) - spread))


def ends(lat: Column, lon: Column, radius_km: Column) -> Column:
    """A place, and the extremes of a disc around it, as an array of (lat, lon)."""
    r = radius_km * 1000.0 / M_PER_DEGREE
    rx = r / F.greatest(F.lit(0.05), F.cos(F.radians(lat)))
    at = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.when(radius_km > 0, F.array(at(lat, lon), at(lat + r, lon), at(lat - r, lon), at(lat, lon + rx), at(lat, lon - rx))).otherwise(F.array(at(lat, lon)))


def box_ends(s: Column, w: Column, n: Column, e: Column) -> Column:
    """The centre and the corners of a box."""
    at = lambda a, b: F.struct(a.alias("lat"), b.alias("lon"))
    return F.array(at((s + n) / 2, (w + e) / 2), at(s, w), at(s, e), at(n, w), at(n, e))


def ray_tiles(places: DataFrame, km: float) -> DataFrame:
    """place, i, j: the one-degree tiles that rays from places (place, lat, ends) toward the year's rises and sets cross.

    Rays leave every end, each half degree of azimuth at the place's own latitude, and are sampled each 2 km. Of a ray
    that is short and not near a pole, longitude goes one way, and latitude bends by less than ``bend``: if its two ends
    lie in one tile or on either side of one edge, and it comes near no other, they are all that its samples cross.
    """
    last = int(km * 1000 // 2000) * 2000.0
    bend = math.degrees((last / R_EARTH) ** 2 / 8) * math.tan(math.radians(81)) + 1e-9
    wide = rise_ranges(relational.spread(places.select("place", "lat", "ends"), 5000))
    count = F.ceil((F.col("rise_hi") - F.col("rise_lo") + 0.5) / 0.5).cast("int")
    side = lambda lo: F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.col(lo) + k * 0.5)
    rays = wide.select("place", F.explode("ends").alias("_e"), F.concat(side("rise_lo"), side("set_lo")).alias("_az")).select("place", "_e", F.posexplode("_az").alias("_k", "azimuth"))
    to = lambda metres: destinations(F.col("_e.lat"), F.col("_e.lon"), F.col("azimuth"), metres)
    row, column = F.floor, lambda lon: F.floor(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)
    (lat0, lon0), (lat1, lon1) = to(F.lit(0.0)), to(F.lit(last))
    rays = rays.withColumns({"_lat0": lat0, "_lat1": lat1, "_j0": column(lon0), "_j1": column(lon1)}).withColumns({"_i0": row("_lat0"), "_i1": row("_lat1")})
    i0, i1, j0, j1 = (F.col(c) for c in ("_i0", "_i1", "_j0", "_j1"))
    lo, hi = F.least("_lat0", "_lat1"), F.greatest("_lat0", "_lat1")
    clear = (row(lo - bend) == row(lo)) & (row(hi + bend) == row(hi)) & (hi < 80) & (lo > -80) & (F.abs(F.sin(F.radians("azimuth"))) > 1e-6)
    plain = clear & F.lit(0 < last <= 100_000) & (((i0 == i1) & F.pmod(j1 - j0, F.lit(360)).isin(0, 1, 359)) | (j0 == j1))
    every = F.lit([k * 2000.0 for k in range(int(last // 2000) + 1)])
    steps = F.when(plain & (F.col("_k") == 0), F.lit([0.0, last])).when(plain, F.lit([last])).otherwise(every)  # all rays of an end begin in one tile
    lat2, lon2 = to(F.col("metres"))
    return rays.select("place", "_e", "azimuth", F.explode(steps).alias("metres")).select("place", row(lat2).alias("i"), column(lon2).alias("j")).distinct()


def path_box(places: DataFrame, keys: list[str], reach_km: float, grid: float = 0.25) -> DataFrame:
    """keys, s, w, n, e: a box around all that the year's paths toward the Sun reach from places, snapped outward and a cell wider."""
    from almucantar.functions.geo import destination

    turns = [-SUN_DECLINATION + k * (2 * SUN_DECLINATION / 12) for k in range(13)]
    at = places.withColumn("_d", F.explode(F.lit(turns))).withColumn("_c", F.sin(F.radians("_d")) / F.cos(F.radians("lat"))).where("_c between -1 and 1")
    at = at.withColumn("_a", F.degrees(F.acos("_c"))).withColumn("_az", F.explode(F.array(F.col("_a"), F.lit(360.0) - F.col("_a")))).withColumn("_km", F.explode(F.lit([reach_km / 4, reach_km / 2, reach_km])))
    lat2, lon2 = destination(F.col("lat"), F.col("lon"), F.col("_az"), F.col("_km"))
    reached = at.select(*keys, lat2.alias("lat"), lon2.alias("lon")).unionByName(places.select(*keys, "lat", "lon"))
    out = lambda f, x: f(x / grid) * grid
    return reached.groupBy(*keys).agg((out(F.floor, F.min("lat")) - grid).alias("s"), (out(F.floor, F.min("lon")) - grid).alias("w"), (out(F.ceil, F.max("lat")) + grid).alias("n"), (out(F.ceil, F.max("lon")) + grid).alias("e"))
