"""Operators of the answers: time and space interpolation, corrections, calendars, retention, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blend_hours(requests: DataFrame, grid: DataFrame, keys: list[str], hours: list[int], value: str = "value") -> DataFrame:
    """Adds ``blended`` to requests (req_id, keys, tau hours since the run): between the stored hours around tau.

    Equi-joins on the two hours; null outside the stored hours or if either is missing. The last hour
    belongs to the last step.
    """
    edge = F.lit([float(h) for h in hours])
    k = F.least(F.greatest(F.size(F.filter(edge, lambda h: h <= F.col("tau"))) - 1, F.lit(0)), F.lit(len(hours) - 2))
    r = requests.withColumns({"h0": F.element_at(edge, k + 1), "h1": F.element_at(edge, k + 2)}).withColumn("w", (F.col("tau") - F.col("h0")) / (F.col("h1") - F.col("h0")))
    sides = [grid.select(*keys, F.col("hour").cast("double").alias(h), F.col(value).alias(v)) for h, v in (("h0", "v0"), ("h1", "v1"))]
    out = r.join(sides[0], [*keys, "h0"], "left").join(sides[1], [*keys, "h1"], "left")
    inside = F.col("tau").between(hours[0], hours[-1])
    return out.withColumn("blended", F.when(inside, F.col("v0") * (F.lit(1.0) - F.col("w")) + F.col("v1") * F.col("w"))).drop("h0", "h1", "w", "v0", "v1")


def bilinear(points: DataFrame, grid: DataFrame, lat0: float, lon0: float, step: float, rows: int, cols: int) -> DataFrame:
    """Adds ``value`` to points (place, lat, lon) from a regular grid (i, j, value), rows from the south.

    Each point looks up its four corners by number; the last line belongs to the last cell; null outside the
    grid or with a corner missing.
    """

    def cell(x: Column, start: float, n: int) -> Column:
        return F.least(F.floor((x - start) / step), F.lit(n - 2)).cast("int")

    inside = F.col("lat").between(lat0, lat0 + (rows - 1) * step) & F.col("lon").between(lon0, lon0 + (cols - 1) * step)
    p = points.where(inside).withColumns({"i": cell(F.col("lat"), lat0, rows), "j": cell(F.col("lon"), lon0, cols)})
    fy, fx = (F.col("lat") - lat0) / step - F.col("i"), (F.col("lon") - lon0) / step - F.col("j")
    corner = lambda a, b, w: F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j"), w.alias("w"))
    corners = F.array(corner(0, 0, (F.lit(1.0) - fy) * (F.lit(1.0) - fx)), corner(0, 1, (F.lit(1.0) - fy) * fx), corner(1, 0, fy * (F.lit(1.0) - fx)), corner(1, 1, fy * fx))
    spread = p.select("place", F.explode(corners).alias("c")).select("place", "c.i", "c.j", "c.w")
    out = spread.join(grid, ["i", "j"]).groupBy("place").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count("*").alias("n")).where("n = 4").drop("n")
    return points.join(out, "place", "left")


def correction(places: DataFrame, readings: DataFrame, place_key: str, natural: float = 0.174) -> DataFrame:
    """The factor on total brightness of each place: the median of measured over atlas among its readings
    (place, measured, atlas); else the trend's ``fallback``."""
    ratio = (F.col("measured") + natural) / (F.col("atlas") + natural)
    own = readings.groupBy(place_key).agg(F.median(ratio).alias("_f"), F.count("*").alias("used"))
    out = places.join(own, place_key, "left")
    return out.select(place_key, F.coalesce("_f", "fallback").alias("factor"), F.when(F.col("_f").isNotNull(), "measured").otherwise("trend").alias("method"), F.coalesce("used", F.lit(0)).alias("used"))


def latest_cycles(now: Column, hours: list[int], slots: int = 8) -> Column:
    """Run ids of the last six-hourly slots at some hours of the day, newest first."""
    start = F.date_trunc("day", now)
    at = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.timestamp_add("HOUR", (F.floor(F.hour(now) / 6) - k) * 6, start))
    return F.transform(F.filter(at, lambda t: F.hour(t).isin(hours)), lambda t: F.date_format(t, "yyyyMMddHH"))


def prior_window(today: Column, years: int, finished_month: int = 3) -> tuple[Column, Column]:
    """First and last year of the rolling prior: the last year counts once it is finished."""
    last = F.year(today) - F.when(F.month(today) >= finished_month, 1).otherwise(2)
    return last - years + 1, last


def retained(runs: DataFrame, run: str, newest: int) -> DataFrame:
    """The newest runs; the rest may go."""
    return runs.orderBy(F.desc(run)).limit(newest)


def months_ready(counts: DataFrame, keys: list[str], least: int, slots: int = 8) -> DataFrame:
    """Months of which all slots have enough samples."""
    return counts.where(F.col("n") >= least).groupBy(*keys, "month").agg(F.count("*").alias("k")).where(F.col("k") == slots).drop("k")


def first_crossing(path: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Where x first rises through 0 along a path: y there, between the points on both sides."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = path.withColumns({"_x": F.lag(x).over(w), "_y": F.lag(y).over(w)}).where(F.col("_x").isNotNull() & (F.col("_x") < 0) & (F.col(x) >= 0))
    at = F.col("_y") + (F.col(y) - F.col("_y")) * (-F.col("_x")) / (F.col(x) - F.col("_x"))
    return rows.groupBy(*keys).agg(F.min_by(at, order).alias("crossing"))


def lowest_horizon(slopes: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest horizon over the spots of a group in each direction."""
    return slopes.groupBy(*keys, "azimuth").agg(F.min("slope").alias("slope"))


def forward_filled(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Missing values from the last known one before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def in_all_groups(rows: DataFrame, group: str, key: str) -> DataFrame:
    """Keys that every group has."""
    n = rows.agg(F.count_distinct(group).alias("n"))
    return rows.groupBy(key).agg(F.count_distinct(group).alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select(key)
