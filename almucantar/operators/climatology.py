"""Running climatologies by month and time-of-day slot, and reading them at a time and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The day of year that stands for each month.
MID_MONTH = [15.5, 45.0, 74.5, 105.0, 135.5, 166.0, 196.5, 227.5, 258.0, 288.5, 319.0, 349.5]


def sums(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", weight: str | None = None) -> DataFrame:
    """Sum and count of samples by month (0 to 11), slot of three hours and ``keys``; null and NaN samples are left out."""
    w = F.col(weight) if weight else F.lit(1)
    known = samples.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy((F.month(ts) - 1).alias("month"), F.floor(F.hour(ts) / 3).cast("int").alias("slot"), *keys).agg(
        F.sum(F.col(value) * w).alias("total"), F.sum(w).cast("long").alias("n")
    )


def _bracket(x: Column, points: list[float], period: float) -> tuple[Column, Column, Column]:
    """The two points around x on a circle, by number, and the second one's weight. A point belongs to the bracket that it ends."""
    n = len(points)
    edges = F.lit([*points, points[0] + period])
    y = F.when(x < points[0], x + period).otherwise(x)
    k = sum((F.when(y > e, 1).otherwise(0) for e in points[1:]), F.lit(0))
    lo, hi = F.element_at(edges, k + 1), F.element_at(edges, k + 2)
    return k, (k + 1) % n, (y - lo) / (hi - lo)


def month_weights(ts: Column) -> tuple[Column, Column, Column]:
    """The months whose middles lie around a time, and the second one's weight; seconds do not count."""
    return _bracket(F.dayofyear(ts) - 1 + (F.hour(ts) + F.minute(ts) / 60.0) / 24.0, MID_MONTH, 365.0)


def slot_weights(ts: Column, centres: list[float] | None = None) -> tuple[Column, Column, Column]:
    """The slots whose centres lie around a time of day, and the second one's weight."""
    centres = centres or [1.5 + 3 * k for k in range(8)]
    return _bracket(F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0, centres, 24.0)


def packed(store: DataFrame, keys: list[str], min_samples: int, slots: int = 8) -> DataFrame:
    """One row for each key with ``means``, an array over month and slot; null where there are fewer samples."""
    ready = store.where((F.col("n") >= min_samples) & (F.col("n") > 0)).select(*keys, (F.col("month") * slots + F.col("slot")).alias("at"), (F.col("total") / F.col("n")).alias("mean"))
    maps = ready.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "mean"))).alias("m"))  # 12 months of slots at most
    return maps.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(12 * slots - 1)), lambda i: F.try_element_at("m", i)).alias("means"))


def _blended(means: Column, slots: int) -> Column:
    """The weighted mean of the four slots around a time (m0, m1, mw, s0, s1, sw) that are ready, if they carry half of the weight."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for month, wm in ((F.col("_m0"), F.lit(1.0) - F.col("_mw")), (F.col("_m1"), F.col("_mw"))):
        for slot, ws in ((F.col("_s0"), F.lit(1.0) - F.col("_sw")), (F.col("_s1"), F.col("_sw"))):
            v, w = F.try_element_at(means, month * slots + slot + 1), wm * ws
            ready = v.isNotNull() & (w > 0)
            total, weight = total + F.when(ready, w * v).otherwise(0.0), weight + F.when(ready, w).otherwise(0.0)
    return F.when(weight >= 0.5, total / weight)


def _timed(requests: DataFrame, centres: list[float] | None) -> DataFrame:
    names = [*zip(("_m0", "_m1", "_mw"), month_weights(F.col("ts")), strict=True), *zip(("_s0", "_s1", "_sw"), slot_weights(F.col("ts"), centres), strict=True)]
    return requests.withColumns(dict(names))


_WORKING = ["_m0", "_m1", "_mw", "_s0", "_s1", "_sw", "means"]


def blend(requests: DataFrame, store: DataFrame, keys: list[str], min_samples: int = 1, centres: list[float] | None = None) -> DataFrame:
    """Adds ``blended`` to requests (ts, keys): the weighted mean of the slots around a time that are ready.

    Slots with fewer samples are dropped and the rest share the weight, if at least half of it remains; else null. A
    key's slots are one row, so it is one equi-join, and requests are not spread or shuffled for their slots.
    """
    slots = len(centres or range(8))
    out = _timed(requests, centres).join(packed(store, keys, min_samples, slots), keys, "left")
    return out.withColumn("blended", _blended(F.col("means"), slots)).drop(*_WORKING)


def fields_at(requests: DataFrame, store: DataFrame, lat0: float, lon0: float, step: float, rows: int, cols: int, min_samples: int = 1, centres: list[float] | None = None) -> DataFrame:
    """req_id, field, value for requests (req_id, ts, lat, lon): slots around the time, grid points around the place.

    ``store`` has field, i, j, month, slot, total, n on a regular grid, rows from the south. The last line belongs to the
    last cell. Requests outside the grid, or whose slots carry less than half of the weight, have no rows.
    """
    slots = len(centres or range(8))
    inside = F.col("lat").between(lat0, lat0 + (rows - 1) * step) & F.col("lon").between(lon0, lon0 + (cols - 1) * step)
    cell = lambda x, start, n: F.least(F.floor((F.col(x) - start) / step), F.lit(n - 2)).cast("int")
    at = _timed(requests.where(inside), centres).withColumns({"_i": cell("lat", lat0, rows), "_j": cell("lon", lon0, cols)})
    at = at.withColumns({"_fy": (F.col("lat") - lat0) / step - F.col("_i"), "_fx": (F.col("lon") - lon0) / step - F.col("_j")})
    corner = lambda a, b: F.struct((F.col("_i") + a).alias("i"), (F.col("_j") + b).alias("j"), ((F.col("_fy") if a else F.lit(1.0) - F.col("_fy")) * (F.col("_fx") if b else F.lit(1.0) - F.col("_fx"))).alias("b"))
    spread = at.withColumn("_c", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)]))).withColumns({"i": F.col("_c.i"), "j": F.col("_c.j"), "_b": F.col("_c.b")})
    hit = spread.join(packed(store, ["field", "i", "j"], min_samples, slots), ["i", "j"]).withColumn("_v", _blended(F.col("means"), slots))
    out = hit.groupBy("req_id", "field").agg(F.sum(F.col("_b") * F.col("_v")).alias("value"), F.count("_v").alias("_n"))
    return out.where("_n = 4").drop("_n")


def weighted_merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Means of parts (mean, n) merged by their counts; null means count for nothing."""
    known = parts.where("mean is not null")
    return known.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def moments(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Means of all columns and of all their products in pairs: what a covariance needs."""
    aggs = [F.avg(c).alias(f"m_{c}") for c in columns]
    aggs += [F.avg(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy(*keys).agg(*aggs)


def whole_samples(samples: DataFrame, value: str = "value") -> DataFrame:
    """The samples (cycle_id, ts) of which no cell is null or NaN; one that has such a cell is left out with all its cells."""
    bad = samples.where(F.col(value).isNull() | F.isnan(F.col(value).cast("double"))).select("cycle_id", "ts").distinct()
    return samples.join(bad, ["cycle_id", "ts"], "left_anti")


def add_to_store(store: DataFrame, ledger: DataFrame, samples: DataFrame, keys: list[str], weight: int = 1) -> tuple[DataFrame, DataFrame]:
    """The store and ledger after samples (cycle_id, ts, value, keys) of cycles that the ledger lacks.

    Only whole samples are added, so all cells of a month and slot have the same count; the cycles of the others are
    in the ledger all the same.
    """
    new = samples.join(ledger.select("cycle_id").distinct(), "cycle_id", "left_anti")
    added = sums(whole_samples(new).withColumn("_w", F.lit(weight)), keys, weight="_w")
    both = store.select("month", "slot", *keys, "total", "n").unionByName(added)
    return both.groupBy("month", "slot", *keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n")), ledger.unionByName(new.select("cycle_id").distinct())


def reduced(steps: DataFrame, keys: list[str], slots: int = 4) -> DataFrame:
    """Means and counts by month, slot and ``keys`` of a year's steps (ts, value, units, field), in Kelvin and Pascal.

    Temperatures (fields t...) and pressures (psfc) are brought to one unit. Every month must have all slots of every
    field: else it is an error. Slots are 24 / ``slots`` hours apart.
    """
    from almucantar.functions.photometry import to_kelvin, to_pascal

    v = F.when(F.col("field").startswith("t"), to_kelvin(F.col("value"), F.col("units"))).when(F.col("field") == "psfc", to_pascal(F.col("value"), F.col("units"))).otherwise(F.col("value"))
    at = steps.select((F.month("ts") - 1).alias("month"), F.floor(F.hour("ts") / (24 // slots)).cast("int").alias("slot"), "field", *keys, v.alias("value"))
    out = at.where("value is not null and not isnan(value)").groupBy("month", "slot", "field", *keys).agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    there = at.groupBy("field").agg(F.count_distinct("month", "slot").alias("_slots"))
    whole = F.when(F.col("_slots") < 12 * slots, F.raise_error(F.concat(F.lit("some slots have no data: "), "field")).cast("int")).otherwise(F.col("_slots"))
    return out.join(there.select("field", whole.alias("_slots")), "field").where("_slots > 0").drop("_slots")


def combined(years: DataFrame, keys: list[str], first: int, last: int, further: int = 5) -> DataFrame:
    """Means over the years ``first`` to ``last`` of parts (year, mean, n), weighted by their steps.

    A year that is missing is replaced by the latest one before ``first``, up to ``further`` years back. At least half
    of the years must be there: else it is an error.
    """
    wanted = last - first + 1
    have = years.where(F.col("year").between(first - further, last)).select("year").distinct()
    used = have.orderBy(F.desc("year")).limit(wanted)
    enough = used.agg(F.count("*").alias("n")).select(F.when(F.col("n") < max(1, (wanted + 1) // 2), F.raise_error(F.concat(F.lit("too few years: "), F.col("n").cast("string"))).cast("long")).otherwise(F.col("n")).alias("_years"))
    parts = years.join(F.broadcast(used), "year").where("mean is not null")  # as many rows as years
    out = parts.groupBy(*keys).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    return out.join(F.broadcast(enough)).where("_years > 0").withColumnRenamed("_years", "years")
