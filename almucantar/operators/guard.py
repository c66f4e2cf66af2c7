"""Plausibility guards: physical limits by field, rising levels, and jumps between runs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almucantar.operators import stats

#: Limits by field name or pattern, in K, Pa, m and fractions, and the largest median change.
LIMITS = [
    ("^t2m$", 178.0, 334.0),
    ("^tsfc$", 178.0, 348.0),
    ("^psfc$", 30000.0, 110000.0),
    ("^orog$", -500.0, 9000.0),
    ("^land$", -0.01, 1.01),
    (r"^t\d+m$", 170.0, 340.0),
    (r"^t\d+$", 160.0, 350.0),
    (r"^z\d+$", -2000.0, 40000.0),
]
JUMPS = {"t2m": 3.0, "psfc": 300.0, "z500": 40.0}


def limits(field: Column) -> Column:
    """A field's least and largest value (lo, hi); null for fields without limits."""
    out = F.lit(None).cast("struct<lo:double,hi:double>")
    for pattern, lo, hi in reversed(LIMITS):
        out = F.when(field.rlike(pattern), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))).otherwise(out)
    return out


def out_of_range(cells: DataFrame) -> DataFrame:
    """For cells (field, value): how many values of each field are outside its limits, NaN and null aside, and how many infinite.

    The limits are found once for each field, not for each value.
    """
    of_field = cells.select("field").distinct().select("field", limits(F.col("field")).alias("_l"))
    v = F.col("value").cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    bad = finite & ((v < F.col("_l.lo")) | (v > F.col("_l.hi")))
    counted = cells.join(F.broadcast(of_field), "field").groupBy("field")  # a row for each field name
    return counted.agg(F.count_if(bad).alias("bad"), F.count_if(F.abs(v) == float("inf")).alias("infinite")).where("bad > 0 or infinite > 0")


def not_rising(levels: DataFrame, cell: list[str], pressure: str, height: str) -> DataFrame:
    """Levels whose height is not above that of the next higher pressure in their cell."""
    below = F.lag(height).over(Window.partitionBy(*cell).orderBy(F.desc(pressure)))
    return levels.withColumn("below", below).where(F.col(height) <= F.col("below"))


def jumps(new: DataFrame, serving: DataFrame, keys: list[str], limits: dict[str, float] | None = None) -> DataFrame:
    """Fields whose median absolute change between two runs (keys, field, value) is over their limit."""
    limits = limits or JUMPS
    both = new.select(*keys, "field", F.col("value").alias("a")).join(serving.select(*keys, "field", F.col("value").alias("b")), [*keys, "field"])
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("field")]
    changes = both.where(F.col("field").isin(*limits)).select("field", F.abs(F.col("a") - F.col("b")).alias("change"))
    return stats.medians(changes, ["field"], "change").select("field", F.col("median").alias("change")).where(F.col("change") > most)


def aligned_jumps(new: DataFrame, serving: DataFrame, new_cycle: str, serving_cycle: str, keys: list[str], limits: dict[str, float] | None = None, within: int = 24) -> DataFrame:
    """``jumps`` by forecast hour between two runs (keys, hour, field, value) at the times that both forecast.

    Only a serving run that is some whole hours, up to a day, older is compared, and only the new run's first ``within``
    hours: else there is nothing to hold back.
    """
    lag = (datetime.strptime(new_cycle, "%Y%m%d%H") - datetime.strptime(serving_cycle, "%Y%m%d%H")).total_seconds() / 3600
    a = new.where(F.col("hour") <= within) if 0 < lag <= 24 and lag == int(lag) else new.where("false")
    limits = limits or JUMPS
    b = serving.withColumn("hour", F.col("hour") - int(lag))
    both = a.select(*keys, "hour", "field", F.col("value").alias("a")).join(b.select(*keys, "hour", "field", F.col("value").alias("b")), [*keys, "hour", "field"])
    most = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("field")]
    changes = both.where(F.col("field").isin(*limits)).select("hour", "field", F.abs(F.col("a") - F.col("b")).alias("change"))
    return stats.medians(changes, ["hour", "field"], "change").select("hour", "field", F.col("median").alias("change")).where(F.col("change") > most)
