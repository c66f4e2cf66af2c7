"""Queries of the serving side: places, areas, the Sun, brightness, horizons, tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almucantar.functions import astro, geo, photometry
from almucantar.operators import columns, kernels, relational, stats
from almucantar.plans.registry import micro, points, query, sql_points
from almucantar.session import table

#: Stations of a network that is solved as one system.
MOST_STATIONS = 4000
_P, _S = sql_points(), sql_points("supplier", "s_suppkey")


@query(f"""SELECT place, CAST(round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(31.78 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(31.78)) * pow(sin(radians(35.22 - lon) / 2), 2)))) * 1e3) AS BIGINT) AS metres FROM ({_P})""")
def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distances to one place."""
    return points(spark, sf_dir).withColumn("d", geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(31.78), F.lit(35.22))).select("place", micro("d", 3).alias("metres"))


@query(f"""SELECT place, CAST(round(degrees(p2) * 1e6) AS BIGINT) AS lat2, CAST(round((((degrees(radians(lon) + atan2(sin(a) * sin(d) * cos(p), cos(d) - sin(p) * sin(p2))) + 540) % 360 + 360) % 360 - 180) * 1e6) AS BIGINT) AS lon2
FROM (SELECT *, asin(sin(p) * cos(d) + cos(p) * sin(d) * cos(a)) AS p2 FROM (SELECT place, lon, radians(lat) AS p, radians(60.0) AS a, 100.0 / 6371.0088 AS d FROM ({_P})))""")
def destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred kilometres along an azimuth from each place."""
    p = points(spark, sf_dir)
    lat2, lon2 = geo.destination(F.col("lat"), F.col("lon"), F.lit(60.0), F.lit(100.0))
    return p.select("place", lat2.alias("a"), lon2.alias("b")).select("place", micro("a").alias("lat2"), micro("b").alias("lon2"))


_SUN = """SELECT o_orderkey, T, radians(357.52911 + 35999.05029 * T - 0.0001537 * T * T) AS M, radians(125.04 - 1934.136 * T) AS om, jd FROM (
SELECT o_orderkey, jd, (jd - 2451545.0) / 36525.0 AS T FROM (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440587.5 + 0.25 AS jd FROM orders))"""


@query(f"""SELECT o_orderkey, CAST(round(asin(sin(eps) * sin(lam)) * 1e7) AS BIGINT) AS dec, CAST(round(atan2(cos(eps) * sin(lam), cos(lam)) * 1e7) AS BIGINT) AS ra FROM (
SELECT o_orderkey, radians(280.46646 + 36000.76983 * T + 0.0003032 * T * T + (1.914602 - 0.004817 * T - 0.000014 * T * T) * sin(M) + (0.019993 - 0.000101 * T) * sin(2 * M) + 0.000289 * sin(3 * M) - 0.00569 - 0.00478 * sin(om)) AS lam,
radians(23.4392911 - 0.0130042 * T + 0.00256 * cos(om)) AS eps FROM ({_SUN}))""")
def sun_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the Sun stands."""
    jd = F.unix_date(F.to_date("o_orderdate")) + 2440587.5 + 0.25
    place = astro.sun_place(jd)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(place["dec"] * 1e7).cast("long").alias("dec"), F.round(place["ra"] * 1e7).cast("long").alias("ra"))


@query()
def sun_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sunrise and sunset of each place on two days: an iteration, tested against plain Python."""
    days = points(spark, sf_dir).withColumn("day", F.explode(F.array(F.lit("2026-03-20").cast("date"), F.lit("2026-12-21").cast("date")))).withColumn("event", F.explode(F.array(F.lit("sunrise"), F.lit("sunset"))))
    return astro.sun_events(days).select("place", "day", "event", "event_jd", "azimuth")


_BOXES = [(0, -60.0, -180.0, 0.0, -30.0, "south-west"), (1, 7.0, -170.0, 85.0, -50.0, "north-america"), (2, 35.0, -25.0, 72.0, 45.0, "europe"), (3, -30.0, -60.0, 40.0, 90.0, "middle")]


def _boxes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_BOXES, "ord int, s double, w double, n double, e double, name string")


_SQL_BOXES = "(VALUES " + ", ".join(str(b) for b in _BOXES) + ") b(ord, s, w, n, e, name)"


@query(f"SELECT place, coalesce(name, 'world') AS name FROM ({_P}) LEFT JOIN (SELECT place, arg_min(name, ord) AS name FROM ({_P}), {_SQL_BOXES} WHERE lat BETWEEN s AND n AND lon BETWEEN w AND e GROUP BY 1) USING (place)")
def region_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first configured box that contains each place."""
    return relational.first_box(points(spark, sf_dir), _boxes(spark), "place").select("place", F.coalesce("name", F.lit("world")).alias("name"))


_AREAS = """SELECT CAST(p_partkey AS BIGINT) AS id, lat - h AS s, lon - h AS w, lat + h AS n, lon + h AS e, 10 * (1 + p_partkey % 3) AS level, CAST(p_partkey % 25 AS DOUBLE) AS radius_km
FROM (SELECT p_partkey, CAST((p_partkey * 7919) % 12000 AS DOUBLE) / 100.0 - 60.0 AS lat, CAST((p_partkey * 104729) % 36000 AS DOUBLE) / 100.0 - 180.0 AS lon, 1.0 + p_partkey % 4 AS h FROM part)"""


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir, "part", "p_partkey").withColumn("h", F.col("place") % 4 + 1.0)
    return p.select(F.col("place").alias("id"), (F.col("lat") - F.col("h")).alias("s"), (F.col("lon") - F.col("h")).alias("w"), (F.col("lat") + F.col("h")).alias("n"), (F.col("lon") + F.col("h")).alias("e"), ((F.col("place") % 3 + 1) * 10).alias("level"), (F.col("place") % 25).cast("double").alias("radius_km"))


_PICKED = f"""WITH a AS ({_AREAS}), c AS (SELECT place, a.*, row_number() OVER (PARTITION BY place, level < 30 ORDER BY level DESC, (n - s) * (e - w), id) AS k,
row_number() OVER (PARTITION BY place ORDER BY level DESC, (n - s) * (e - w), id) AS best FROM ({_P}) JOIN a ON lat BETWEEN s AND n AND lon BETWEEN w AND e)"""


@query(f"{_PICKED} SELECT place, id AS area_id FROM c WHERE best = 1")
def area_finest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finest area that contains each place."""
    return relational.best_areas(points(spark, sf_dir), _areas(spark, sf_dir), "place")


@query(f"""{_PICKED}, t AS (SELECT * FROM c WHERE k = 1 AND level < 30), h AS (SELECT * FROM c WHERE k = 1 AND level >= 30), b AS (SELECT * FROM c WHERE best = 1)
SELECT b.place, CASE WHEN t.radius_km <= 13 THEN t.id ELSE coalesce(h.id, b.id) END AS area_id FROM b LEFT JOIN t USING (place) LEFT JOIN h USING (place)""")
def area_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The town that contains each place, or, in a large one, the neighbourhood."""
    return relational.best_areas(points(spark, sf_dir), _areas(spark, sf_dir), "place", "city")


_RING = [-100.0, -40.0, 60.0, -50.0, 120.0, 10.0, 30.0, 50.0, 0.0, 0.0, -120.0, 40.0]
_SQL_EDGES = "(VALUES " + ", ".join(f"({_RING[2 * i]}, {_RING[2 * i + 1]}, {_RING[2 * i - 2]}, {_RING[2 * i - 1]})" for i in range(len(_RING) // 2)) + ") r(xi, yi, xj, yj)"


@query(f"SELECT place, sum(CASE WHEN (yi > lat) != (yj > lat) AND lon < (xj - xi) * (lat - yi) / (yj - yi) + xi THEN 1 ELSE 0 END) % 2 = 1 AS inside FROM ({_P}), {_SQL_EDGES} GROUP BY place")
def ring_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which places lie in a ring."""
    return points(spark, sf_dir).select("place", geo.ring_contains(F.col("lon"), F.col("lat"), F.lit(_RING)).alias("inside"))


@query(f"""SELECT place, CAST(round(v * 1e4) AS BIGINT) AS mcd, CAST(round(-2.5 * log10((v + 0.174) * 1e-3 / 108000.0) * 1e4) AS BIGINT) AS mag, CAST(round(v * 1e-3 * 2.25 * 1e9) AS BIGINT) AS blp,
CAST(round(greatest((v + 0.174) * pow(1.096, 8.0) - 0.174, 0.0) * 1e4) AS BIGINT) AS later FROM (SELECT place, greatest(lat, 0.0) / 10.0 AS v FROM ({_P}))""")
def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a brightness answer carries, and the sky some years on."""
    v = F.greatest(F.col("lat"), F.lit(0.0)) / 10.0
    d = photometry.describe(v)
    later = photometry.corrected(v, photometry.trend_factor(F.lit(0.096), F.lit(2014.0), F.lit(2022.0)))
    out = points(spark, sf_dir).select("place", d["artificial_mcd"].alias("a"), d["total_mag"].alias("m"), d["blp_cd"].alias("b"), later.alias("l"))
    return out.select("place", micro("a", 4).alias("mcd"), micro("m", 4).alias("mag"), micro("b", 9).alias("blp"), micro("l", 4).alias("later"))


@query("""SELECT l_returnflag, count(l_extendedprice) AS n, CAST(round(avg(l_extendedprice) * 10000) AS BIGINT) AS mean, CAST(round(min(l_extendedprice) * 10000) AS BIGINT) AS least,
CAST(round(quantile_cont(l_extendedprice, 0.1) * 10000) AS BIGINT) AS p10, CAST(round(quantile_cont(l_extendedprice, 0.5) * 10000) AS BIGINT) AS median, CAST(round(quantile_cont(l_extendedprice, 0.9) * 10000) AS BIGINT) AS p90,
CAST(round(max(l_extendedprice) * 10000) AS BIGINT) AS most, CAST(round(quantile_cont(l_extendedprice, 0.75) * 10000) AS BIGINT) AS p FROM lineitem GROUP BY 1""")
def area_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the pixels of areas."""
    out = stats.summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 75.0)
    return out.select("l_returnflag", "n", *[micro(c, 4).alias(c) for c in ("mean", "least", "p10", "median", "p90", "most", "p")])


@query(f"""WITH p AS (SELECT place % 12 AS month, round(lat / 60.0) * 2.5 + 40.0 AS lat, round(lon / 60.0) * 2.5 + 10.0 AS lon, lat / 3.0 AS t FROM ({_P})), q AS (
SELECT month, lat, lon, t, unnest(CASE WHEN (lat + 90) % 5 = 0 THEN [CAST(floor((lat + 90) / 5) AS BIGINT) - 1, CAST(floor((lat + 90) / 5) AS BIGINT)] ELSE [CAST(floor((lat + 90) / 5) AS BIGINT)] END) AS cell_i FROM p), r AS (
SELECT *, unnest(CASE WHEN (lon + 180) % 5 = 0 THEN [CAST(floor((lon + 180) / 5) AS BIGINT) - 1, CAST(floor((lon + 180) / 5) AS BIGINT)] ELSE [CAST(floor((lon + 180) / 5) AS BIGINT)] END) AS cell_j FROM q), s AS (
SELECT cell_i, cell_j, month, CAST(floor(min(t)) AS BIGINT) AS lo, CAST(ceil(max(t)) AS BIGINT) AS hi FROM r GROUP BY ALL)
SELECT * FROM s WHERE (cell_i, cell_j) IN (SELECT (cell_i, cell_j) FROM s GROUP BY cell_i, cell_j HAVING count(*) = 12)""")
def envelope_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and largest sea-level air by cell and month; edges belong to both cells."""
    p = points(spark, sf_dir).select((F.col("place") % 12).alias("month"), (F.round(F.col("lat") / 60.0) * 2.5 + 40.0).alias("lat"), (F.round(F.col("lon") / 60.0) * 2.5 + 10.0).alias("lon"), (F.col("lat") / 3.0).alias("t"))
    return stats.envelope(p)


_LAGS = f"""WITH s AS (SELECT *, ln(1.0 + place % 7) AS z FROM ({_S})), p AS (
SELECT 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS h, pow(a.z - b.z, 2) / 2 AS g
FROM s a JOIN s b ON a.place < b.place), o AS (SELECT *, row_number() OVER (ORDER BY h, g) - 1 AS i, count(*) OVER () AS n FROM p WHERE h <= (SELECT max(h) / 2 FROM p))
SELECT CAST(least(i // 30, greatest(n // 30 - 1, 0)) AS BIGINT) AS lag, CAST(round(avg(h) * 1e3) AS BIGINT) AS h, CAST(round(avg(g) * 1e6) AS BIGINT) AS g, count(*) AS pairs FROM o WHERE n >= 30 GROUP BY 1"""


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir, "supplier", "s_suppkey").withColumnRenamed("place", "site").withColumn("z", F.log(F.col("site") % 7 + 1.0))


@query(_LAGS)
def variogram_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of stations by distance, in lags."""
    out = stats.variogram_lags(_sites(spark, sf_dir))
    return out.select("lag", micro("h", 3).alias("h"), micro("g", 6).alias("g"), "pairs")


@query()
def kriging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The factor at each place from the station network; SQL solves no equations."""
    sites = _sites(spark, sf_dir)
    model = stats.network_model(sites).first()
    rows = sites.limit(MOST_STATIONS + 1).collect()  # the network is the model
    if len(rows) > MOST_STATIONS:
        raise ValueError(f"a network of more than {MOST_STATIONS} stations is not kriged as a whole")
    network = [{"site": r["site"], "lat": r["lat"], "lon": r["lon"], "ratio": 1.0 + r["site"] % 7, "error": 0.01} for r in sorted(rows, key=lambda r: r["site"])]
    return kernels.krige(points(spark, sf_dir), network, model["nugget"], model["sill"], model["range_km"]).drop("stations")


@query(f"""SELECT site, azimuth, CAST(round(max(slope) * 1e9) AS BIGINT) AS slope, arg_max(metres, (slope, -metres)) AS metres FROM (
SELECT place AS site, a * 30.0 AS azimuth, d * 500.0 AS metres, (400.0 + 300.0 * sin((a * 30.0 + d) / 7.0) - (300.0 + place % 50)) / (d * 500.0) - (d * 500.0) * (1 - 0.13) / (2 * 6371008.8) AS slope
FROM ({_S}), range(0, 12) ra(a), range(1, 101) rd(d)) GROUP BY 1, 2""")
def horizon_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon of each observer over analytic terrain."""
    s = _terrain(spark, sf_dir)
    return columns.horizon(s, ["site"]).select("site", "azimuth", micro("slope", 9).alias("slope"), "metres")


def _terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples along rays: a short list of directions and distances for each observer."""
    s = points(spark, sf_dir, "supplier", "s_suppkey").select(F.col("place").alias("site"), (F.col("place") % 50 + 300.0).alias("eye"))
    s = relational.spread(s, 1200).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(100))))
    return s.select("site", "eye", (F.col("a") * 30.0).alias("azimuth"), (F.col("d") * 500.0).alias("metres"), (F.sin((F.col("a") * 30.0 + F.col("d")) / 7.0) * 300.0 + 400.0).alias("height"))


@query()
def set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest spots of each group with a near-lowest horizon in every direction; greedy, tested against plain Python."""
    h = columns.horizon(_terrain(spark, sf_dir), ["site"])
    return kernels.cover(h.select((F.col("site") % 5).alias("area"), F.col("site").alias("spot"), "azimuth", "slope"), "area", 5e-5)


@query(f"""SELECT place, CAST(round(degrees(atan(sinh(pi() * (1 - 2 * (place % 32 + 0.5) / 32.0)))) * 1e6) AS BIGINT) AS lat, CAST(round(((place % 17 + 0.5) / 32.0 * 360.0 - 180.0) * 1e6) AS BIGINT) AS lon,
CAST(floor((v + 32768.0) / 256.0) AS BIGINT) AS r, CAST(floor(v + 32768.0 - floor((v + 32768.0) / 256.0) * 256.0) AS BIGINT) AS g, CAST(floor((v + 32768.0 - floor(v + 32768.0)) * 256.0) AS BIGINT) AS b,
(CASE WHEN floor(plat) >= 0 THEN 'N' ELSE 'S' END) || lpad(CAST(abs(CAST(floor(plat) AS BIGINT)) AS VARCHAR), 2, '0') || (CASE WHEN floor(plon) >= 0 THEN 'E' ELSE 'W' END) || lpad(CAST(abs(CAST(floor(plon) AS BIGINT)) AS VARCHAR), 3, '0') AS tile
FROM (SELECT place, lat AS plat, lon AS plon, lat * 25.0 AS v FROM ({_P}))""")
def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile coordinates, heights as bytes and tile names."""
    h, half = geo.terrarium(F.col("lat") * 25.0), F.lit(0.5)
    lat, lon = geo.mercator(F.lit(5.0), F.col("place") % 17, F.col("place") % 32, half, half)
    out = points(spark, sf_dir).select("place", lat.alias("a"), lon.alias("b"), *[h[k].cast("long").alias(f"_{k}") for k in "rgb"], geo.tile_name(F.floor("lat"), F.floor("lon")).alias("tile"))
    return out.select("place", micro("a").alias("lat"), micro("b").alias("lon"), F.col("_r").alias("r"), F.col("_g").alias("g"), F.col("_b").alias("b"), "tile")


@query(f"""SELECT place, CAST(round((n + 100.0) * cos(p) * cos(k)) AS BIGINT) AS x, CAST(round((n + 100.0) * cos(p) * sin(k)) AS BIGINT) AS y, CAST(round((n * (1 - 6.69437999014e-3) + 100.0) * sin(p)) AS BIGINT) AS z
FROM (SELECT place, radians(lat) AS p, radians(lon) AS k, 6378137.0 / sqrt(1 - 6.69437999014e-3 * pow(sin(radians(lat)), 2)) AS n FROM ({_P}))""")
def earth_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earth-centred coordinates."""
    c = geo.ecef(F.col("lat"), F.col("lon"), F.lit(100.0))
    return points(spark, sf_dir).select("place", *[F.round(v).cast("long").alias(k) for k, v in c.items()])


@query()
def terrain_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights as PNG tiles; binary, tested by a round trip."""
    heights = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.sin(i * 0.3 + F.col("place")) * 500.0)
    return points(spark, sf_dir, "supplier", "s_suppkey").select("place", kernels.terrarium_png(heights, 8).alias("png"))


@query()
def path_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the paths toward the rising Sun lie and what the climatology has there: events, distances, values."""
    from almucantar.operators import climatology

    p = points(spark, sf_dir, "supplier", "s_suppkey").select("place", "lat", "lon", F.lit("2026-01-20").cast("date").alias("day"), F.lit("sunrise").alias("event"))
    path = astro.sun_events(p).where("event_jd is not null").withColumn("km", F.explode(F.lit([0.0, 20.0, 50.0, 100.0])))
    lat2, lon2 = geo.destination(F.col("lat"), F.col("lon"), F.col("azimuth"), F.col("km"))
    ts = F.timestamp_micros(((F.col("event_jd") - 2440587.5) * 86400e6).cast("long"))
    requests = path.select("place", "km", lat2.alias("lat"), lon2.alias("lon"), ts.alias("ts"), F.pmod(F.floor(lat2).cast("long"), F.lit(5)).alias("cell"))
    events = table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 5)
    store = climatology.sums(events, ["cell"])
    out = climatology.blend(requests, store, ["cell"], 1)
    first_gap = F.min(F.when(F.col("blended").isNull(), F.col("km"))).over(Window.partitionBy("place"))
    return out.withColumn("_gap", first_gap).where("_gap is null or km < _gap").select("place", "km", "lat", "lon", "ts", "blended")
