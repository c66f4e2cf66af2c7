"""Queries of the answers' parts: interpolation, pixels, tiles, corrections, calendars, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.functions import astro, geo
from almucantar.operators import climatology, serving
from almucantar.plans.registry import micro, points, query, sql_points
from almucantar.session import table

_P = sql_points()


@query("""WITH g AS (SELECT l_orderkey % 100 AS cell, l_linenumber * 3 AS hour, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
r AS (SELECT o_orderkey AS req_id, o_orderkey % 100 AS cell, CAST(o_orderkey % 25 AS DOUBLE) AS tau FROM orders),
b AS (SELECT *, 3 * least(greatest(CAST(floor(tau / 3) AS INT), 1), 6) AS h0 FROM r)
SELECT req_id, round(CASE WHEN tau BETWEEN 3 AND 21 THEN a.v * (1 - (tau - h0) / 3.0) + c.v * (tau - h0) / 3.0 END * 1e6) AS blended
FROM b LEFT JOIN g a ON a.cell = b.cell AND a.hour = h0 LEFT JOIN g c ON c.cell = b.cell AND c.hour = h0 + 3""")
def hour_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between the stored hours around a time."""
    grid = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("cell"), (F.col("l_linenumber") * 3).alias("hour")).agg(F.avg("l_quantity").alias("value"))
    r = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), (F.col("o_orderkey") % 100).alias("cell"), (F.col("o_orderkey") % 25).cast("double").alias("tau"))
    out = serving.blend_hours(r, grid, ["cell"], [3, 6, 9, 12, 15, 18, 21])
    return out.select("req_id", F.round(F.col("blended") * 1e6).alias("blended"))


@query(f"""WITH g AS (SELECT i, j, sin(i) * 10 + j * 0.5 AS v FROM range(0, 21) a(i), range(0, 31) b(j)), p AS (
SELECT *, least(CAST(floor((lat + 20) / 2) AS INT), 19) AS i, least(CAST(floor((lon + 60) / 2) AS INT), 29) AS j FROM ({_P}) WHERE lat BETWEEN -20 AND 20 AND lon BETWEEN -60 AND 0)
SELECT q.place, round(v * 1e6) AS value FROM ({_P}) q LEFT JOIN (SELECT place, sum(v * abs((lat + 20) / 2 - p.i - 1 + di) * abs((lon + 60) / 2 - p.j - 1 + dj)) AS v
FROM p, range(0, 2) x(di), range(0, 2) y(dj), g WHERE g.i = p.i + di AND g.j = p.j + dj GROUP BY 1) USING (place)""")
def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between the four grid points around each place."""
    grid = spark.range(21).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(30))).alias("j")).withColumn("value", F.sin("i") * 10 + F.col("j") * 0.5)
    return serving.bilinear(points(spark, sf_dir), grid, -20.0, -60.0, 2.0, 21, 31).select("place", F.round(F.col("value") * 1e6).alias("value"))


_PX = "0.008333330000000002"


@query(f"""SELECT place, least(CAST(floor((85.0541668645001 - lat) / {_PX}) AS BIGINT), 17405) AS r, least(greatest(CAST(floor((lon + 180.00000000000003) / {_PX}) AS BIGINT), 0), 43199) AS c
FROM ({_P}) WHERE lat BETWEEN 85.0541668645001 - 17406 * {_PX} AND 85.0541668645001""")
def atlas_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atlas pixel of each place."""
    r, c = geo.atlas_pixel(F.col("lat"), F.col("lon"))
    return points(spark, sf_dir).select("place", r.alias("r"), c.alias("c")).where("r is not null")


@query(f"""SELECT i, j, count(*) AS n FROM (SELECT unnest(range(CAST(floor(lat - d) AS BIGINT), CAST(floor(lat + d) AS BIGINT) + 1)) AS i, lon, e FROM (
SELECT *, 100.0 / 111.19 AS d, 100.0 / (111.19 * greatest(0.05, cos(radians(lat)))) AS e FROM ({_P}))), LATERAL (SELECT unnest(range(CAST(floor(lon - e) AS BIGINT), CAST(floor(lon + e) AS BIGINT) + 1)) AS j) GROUP BY ALL""")
def tiles_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places need each one-degree tile."""
    spread = points(spark, sf_dir).select(F.explode(geo.tiles_around(F.col("lat"), F.col("lon"), 100.0)).alias("t"))
    return spread.groupBy("t.i", "t.j").agg(F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT s_nationkey % 20 AS place, s_suppkey % 9 / 4.0 AS measured, s_suppkey % 5 / 3.0 AS atlas FROM supplier),
f AS (SELECT place, median((measured + 0.174) / (atlas + 0.174)) AS f, count(*) AS used FROM m GROUP BY 1)
SELECT n_nationkey AS place, CAST(round(coalesce(f, pow(1.096, 12.0)) * 1e6) AS BIGINT) AS factor, CASE WHEN f IS NULL THEN 'trend' ELSE 'measured' END AS method, coalesce(used, 0) AS used FROM nation LEFT JOIN f ON n_nationkey = place""")
def brightness_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor from readings near each place, else from the trend."""
    k = F.col("s_suppkey")
    readings = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 20).alias("place"), (k % 9 / 4.0).alias("measured"), (k % 5 / 3.0).alias("atlas"))
    places = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.pow(F.lit(1.096), F.lit(12.0)).alias("fallback"))
    out = serving.correction(places, readings, "place")
    return out.select("place", micro("factor").alias("factor"), "method", F.col("used").cast("long").alias("used"))


@query("""SELECT event_id, strftime(date_trunc('day', ts) + to_hours(CAST((hour(ts) // 6 - k) * 6 AS BIGINT)), '%Y%m%d%H') AS cycle_id FROM events, range(0, 8) r(k)
WHERE ((hour(ts) // 6 - k) * 6 + 48) % 24 IN (0, 12)""")
def latest_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs to look for at the time of each event."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.explode(serving.latest_cycles(F.col("ts").cast("timestamp"), [0, 12])).alias("cycle_id"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 3 THEN 1 ELSE 2 END - 9 AS INT) AS first_year, CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) >= 3 THEN 1 ELSE 2 END AS INT) AS last_year FROM orders""")
def prior_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten years that the prior covers on a day."""
    a, b = serving.prior_window(F.col("o_orderdate"), 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", a.alias("first_year"), b.alias("last_year"))


@query("SELECT day FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events) ORDER BY day DESC LIMIT 5")
def runs_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five runs, which retention keeps."""
    return serving.retained(table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("day")).distinct(), "day", 5)


@query("""SELECT event_type, month FROM (SELECT event_type, CAST(month(ts) - 1 AS INT) AS month, hour(ts) // 3 AS slot, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL) WHERE n >= 9 GROUP BY ALL HAVING count(*) = 8""")
def months_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months of which every slot has enough samples."""
    return serving.months_ready(climatology.sums(table(spark, sf_dir, "events"), ["event_type"]), ["event_type"], 9)


@query("""SELECT l_orderkey, CAST(round(arg_min(py + (y - py) * (-px) / (x - px), k) * 1e6) AS BIGINT) AS crossing FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (
SELECT l_orderkey, l_linenumber AS k, max(l_quantity) - 25.0 AS x, max(l_discount) AS y FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)) WHERE px < 0 AND x >= 0 GROUP BY 1""")
def first_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a path first crosses a line."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("k")).agg((F.max("l_quantity") - 25.0).alias("x"), F.max("l_discount").alias("y"))
    return serving.first_crossing(p, ["l_orderkey"], "k", "x", "y").select("l_orderkey", micro("crossing").alias("crossing"))


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def in_all_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that every group has."""
    return serving.in_all_groups(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@query()
def moon_altitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How high the Moon stands over each place, tested against plain Python."""
    jd = F.lit(2461000.5) + F.col("place") % 30
    return points(spark, sf_dir).select("place", astro.moon_altitude(jd, F.col("lat"), F.col("lon")).alias("altitude"))
