"""Queries of requests and answers, states of built tiles and smoothed ground."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.operators import answers
from almucantar.plans.registry import points, query, sql_points
from almucantar.session import table

_P = sql_points()


@query("""SELECT CASE WHEN event_id % 8 < 4 THEN 'city' WHEN event_id % 8 = 4 THEN 'finest' END AS rule, count(*) AS n FROM events GROUP BY 1""")
def area_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule for areas is asked for."""
    spelled = F.get(F.array(*[F.lit(x) for x in [*answers.CITY, *answers.FINEST, *answers.NO_AREA]]), (F.col("event_id") % 8).cast("int"))
    return table(spark, sf_dir, "events").groupBy(answers.area_rule(spelled).alias("rule")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN f AND r <= 30 THEN 'a' || c_custkey END AS area, CASE WHEN NOT f THEN 'no official area here; used the request as given' WHEN r > 30 THEN c_name || ' is ' || r || ' km from centre to corner, over terrain.max_area_radius_km (30); used the request as given' END AS area_note,
NOT f OR r > 30 AS as_given FROM (SELECT c_custkey, c_name, c_custkey % 3 = 0 AS f, c_custkey % 50 AS r FROM customer)""")
def resolved_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of each request, or why it runs as given."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    found = c.where(k % 3 == 0).select(k, F.concat(F.lit("a"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), (k % 50).cast("double").alias("radius_km"))
    return answers.resolved(c.select("c_custkey"), found, "c_custkey", 30.0)


@query(f"""SELECT place, printf('%s%04d%s%04d', CASE WHEN i >= 0 THEN 'n' ELSE 's' END, abs(i), CASE WHEN j >= 0 THEN 'e' ELSE 'w' END, abs(j)) AS name FROM (SELECT place, CAST(floor(lat * 10) AS BIGINT) AS i, CAST(floor(lon * 10) AS BIGINT) AS j FROM ({_P}))""")
def chunk_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the fine chunks that places are in."""
    return points(spark, sf_dir).select("place", answers.chunk_name(F.floor(F.col("lat") * 10), F.floor(F.col("lon") * 10)).alias("name"))


@query(f"""SELECT place, 6 AS size, CAST(round((list_sum(list_transform([lon, lat, lon + 1.0 / 3, lat, lon, lat + 2.0 / 7], lambda v: round(v, 5)))) * 100000) AS BIGINT) AS total, place % 2 = 0 AS outlined FROM ({_P})""")
def flat_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings as rounded numbers in a row, and whether the outline is given."""
    at = lambda dx, dy: F.array(F.col("lon") + dx, F.col("lat") + dy)
    flat = answers.flat_ring(F.array(at(0.0, 0.0), at(1.0 / 3, 0.0), at(0.0, 2.0 / 7)))
    p = points(spark, sf_dir).select("place", flat.alias("flat"), answers.outline(F.lit([[[0.0, 0.0]]]), F.col("place") % 2 == 0).isNotNull().alias("outlined"))
    total = F.round(F.aggregate("flat", F.lit(0.0), lambda a, v: a + v) * 100000).cast("long")
    return p.select("place", F.size("flat").alias("size"), total.alias("total"), "outlined")


@query("""SELECT o_orderkey, '[' || repeat('#', n) || repeat('.', 20 - n) || '] ' || d || '/' || t AS bar FROM (SELECT o_orderkey, d, t, CAST(round_even(20.0 * d / greatest(t, 1), 0) AS BIGINT) AS n FROM (SELECT o_orderkey, o_orderkey % 64 AS d, CASE WHEN o_orderkey % 64 = 0 THEN 0 ELSE 64 END AS t FROM orders))""")
def progress_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of progress."""
    d = F.col("o_orderkey") % 64
    return table(spark, sf_dir, "orders").select("o_orderkey", answers.progress(d, F.when(d == 0, 0).otherwise(64)).alias("bar"))


@query("""SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS whole, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'E' || p_partkey ELSE b END AS error FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN '{"features":[' WHEN 3 THEN '{"x":1}' WHEN 4 THEN '' END AS b FROM part)""")
def checked_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which downloads are whole, and what is wrong with them."""
    k = F.col("p_partkey")
    body = F.when(k % 5 == 0, ' {"features":[1]}\n').when(k % 5 == 1, F.concat(F.lit('{"error":"E'), k.cast("string"), F.lit('"}'))).when(k % 5 == 2, '{"features":[').when(k % 5 == 3, '{"x":1}').otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", answers.whole_json(body).alias("whole"), answers.features_error(body).alias("error"))


@query("""SELECT n_nationkey, n_name || CASE WHEN n_nationkey % 4 != 0 THEN ', ' || r_name ELSE '' END AS name FROM nation JOIN region ON r_regionkey = n_regionkey""")
def names_with_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that end with the place they are in."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("r_name")).alias("place"))
    return answers.with_places(n.select("n_nationkey", F.col("n_name").alias("name")), places, "n_nationkey")


@query("""WITH m AS (SELECT l_orderkey AS req, l_returnflag AS field, max(l_quantity) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL), n AS (SELECT l_orderkey AS req, l_returnflag AS field, max(l_tax) AS v FROM lineitem WHERE l_linenumber >= 2 AND l_returnflag != 'N' GROUP BY ALL)
SELECT req, field, coalesce(n.v, m.v) AS value FROM m FULL JOIN (SELECT * FROM n WHERE req IN (SELECT req FROM m)) n USING (req, field)""")
def near_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the main store with those of the near-surface store."""
    l = table(spark, sf_dir, "lineitem")
    of = lambda rows, v: rows.groupBy(F.col("l_orderkey").alias("req"), F.col("l_returnflag").alias("field")).agg(F.max(v).cast("double").alias("value"))
    return answers.with_near(of(l.where("l_linenumber <= 2"), "l_quantity"), of(l.where("l_linenumber >= 2 AND l_returnflag != 'N'"), "l_tax"), "req")


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '{"area":"' || n_name || '"}' ELSE '{"key":' || n_nationkey || CASE WHEN n_nationkey % 3 = 1 THEN ',"area":"' || n_name || '"}' ELSE '}' END END AS body FROM nation""")
def spliced_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers with an area's fields added."""
    k = F.col("n_nationkey")
    body = F.when(k % 3 == 0, "{}").otherwise(F.to_json(F.struct(k.alias("key"))))
    extra = F.when(k % 3 == 2, "{}").otherwise(F.to_json(F.struct(F.col("n_name").alias("area"))))
    return table(spark, sf_dir, "nation").select("n_nationkey", answers.with_extra(body, extra).alias("body"))


_TILES = """t AS (SELECT tile, string_agg(DISTINCT s, '+' ORDER BY s) AS parts, count(*) AS n, count(*) FILTER (WHERE s = 'fab') / count(*) AS own FROM (SELECT l_orderkey AS tile, CASE l_returnflag WHEN 'A' THEN 'sea (no data)' WHEN 'R' THEN 'skadi (fallback)' ELSE 'fab' END AS s FROM lineitem) GROUP BY 1),
u AS (SELECT *, CASE parts WHEN 'sea (no data)' THEN 'sea' WHEN 'skadi (fallback)' THEN 'plain' ELSE 'built' END AS state FROM t)"""


@query(f"""WITH {_TILES} SELECT tile, state, round(own, 4) AS own, CASE WHEN tile % 4 = 0 THEN 0 ELSE 5 + CAST(CASE state WHEN 'sea' THEN old != 'sea' WHEN 'plain' THEN old = 'sea' OR (old = 'built' AND n % 2 = 0) ELSE old != 'built' OR n % 2 = 0 END AS INT) END AS rev
FROM (SELECT *, ['', 'sea', 'plain', 'built'][tile % 4 + 1] AS old FROM u)""")
def tile_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built tiles and markers, with the revisions that horizons depend on."""
    source = F.when(F.col("l_returnflag") == "A", answers.SEA).when(F.col("l_returnflag") == "R", answers.FALLBACK).otherwise("fab")
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tile"), source.alias("source"))
    made = answers.tile_states(cells.withColumn("n", F.lit(1)), "tile")
    n = cells.groupBy("tile").agg(F.count("*").alias("digest"))
    was = F.get(F.array(F.lit(None).cast("string"), F.lit("sea"), F.lit("plain"), F.lit("built")), (F.col("tile") % 4).cast("int"))
    before = n.where("tile % 4 != 0").select("tile", was.alias("state"), (F.col("digest") + (F.col("digest") % 2 == 0).cast("int")).alias("digest"), F.lit(5).alias("rev"))
    out = answers.revised(made.join(n, "tile"), before, "tile")
    return out.select("tile", "state", F.coalesce(F.element_at("fractions", "fab"), F.lit(0.0)).alias("own"), "rev")


@query("""SELECT state, count(*) AS n FROM (SELECT CASE WHEN p_size % 3 = 0 THEN 'sea' WHEN p_size % 3 = 1 AND p_partkey % 5 != 0 AND p_partkey % 2 = 0 THEN 'plain' ELSE 'built' END AS state FROM part) GROUP BY 1""")
def slim_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built copies of the plain tile as markers."""
    fallback = F.create_map(F.lit(answers.FALLBACK), F.lit(1.0))
    mixed = F.create_map(F.lit(answers.FALLBACK), F.lit(0.5), F.lit("fab"), F.lit(0.5))
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, "sea").otherwise("built").alias("state"), F.when((F.col("p_size") % 3 == 1) & (F.col("p_partkey") % 2 == 0), fallback).otherwise(mixed).alias("fractions"), F.when(F.col("p_partkey") % 5 == 0, True).alias("provisional"))
    return answers.slimmed(p).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT s_suppkey AS tile, CASE WHEN s_suppkey % 2 = 0 THEN 'own' || s_suppkey WHEN s_suppkey % 3 != 0 THEN 'other' || s_suppkey END AS body, s_suppkey % 2 = 0 AS final FROM supplier""")
def best_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles from our own data or those that stand in."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tile"))
    of = lambda name, rows: rows.select("tile", F.concat(F.lit(name), F.col("tile").cast("string")).alias("body"))
    return answers.best_tile(s, of("own", s.where("tile % 2 = 0")), of("other", s.where("tile % 3 != 0")), ["tile"])


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_quantity < 30 AND l_quantity != 7) AS n, max(CASE WHEN l_quantity < 30 AND l_quantity != 7 THEN l_quantity END) AS high FROM lineitem GROUP BY 1""")
def valid_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights below a source's clip, without its mark of no data."""
    h = answers.below(F.col("l_quantity").cast("double"), 30.0, 7.0)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(h).alias("n"), F.max(h).alias("high"))


@query("""WITH r AS (SELECT s_suppkey AS ray, k, 300 + 50 * sin(s_suppkey + k * 0.7) + 3.0 * k AS h FROM supplier, range(0, 31) t(k)),
s AS (SELECT a.ray, a.k, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * u * u * u) AS s3, sum(w * u * u * u * u) AS s4, sum(w * h) AS t0, sum(w * u * h) AS t1, sum(w * u * u * h) AS t2
FROM (SELECT a.ray, a.k, b.h, (b.k - a.k) * 0.5 AS u, exp(-pow((b.k - a.k) * 0.5, 2) / 8.0) AS w FROM r a JOIN r b USING (ray)) a GROUP BY ALL)
SELECT ray, k, CAST(round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) * 1e4) AS BIGINT) AS height FROM s""")
def smoothed_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground along rays as local quadratic fits."""
    ray = F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.sin(F.col("s_suppkey") + k * 0.7) * 50 + 300 + k * 3.0)
    fits = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ray"), F.posexplode(answers.smoothed_ground(ray, 0.5, 2.0)).alias("k", "h"))
    return fits.select("ray", F.col("k").cast("long").alias("k"), F.round(F.col("h") * 1e4).cast("long").alias("height"))


@query("""WITH s AS (SELECT l_orderkey AS edge, l_linenumber AS k, l_quantity >= 12 AND l_linenumber * 0.5 <= 3 AND l_returnflag != 'R' AS hidden FROM lineitem)
SELECT edge, CASE WHEN last > 0 THEN last * 0.5 + 1.5 ELSE 0 END AS by FROM (SELECT edge, coalesce(min(k) FILTER (WHERE NOT hidden) - 1, max(k)) AS last FROM s GROUP BY 1)""")
def widened_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the edges of the Sun's range move out while the ground hides it."""
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("double").alias("horizon"), F.when(F.col("l_returnflag") != "R", 14.0).alias("altitude"))
    return answers.widened(steps, ["edge"], 2.0, 0.5, 1.5, 3.0)
