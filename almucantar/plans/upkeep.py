"""Queries of fetching and keeping: grids, calendars, what is left to do, reuse, versions, headers, sources of a path."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.operators import climatology, guard, ingest, relational, stats
from almucantar.plans.registry import micro, points, query, sql_points
from almucantar.session import table

_P = sql_points()


@query("""SELECT day FROM (SELECT DISTINCT CAST(d AS DATE) AS d FROM range(DATE '2021-03-22', DATE '2026-10-01', INTERVAL 1 DAY) t(d)), LATERAL (SELECT CAST(d AS VARCHAR) AS day) WHERE date_diff('day', DATE '2021-01-01', d) % 4 = 1""")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days that a backfill samples."""
    return ingest.sample_days(spark, date(2021, 3, 22), date(2026, 9, 30), 4, 1, date(2021, 1, 1)).select(F.col("day").cast("string").alias("day"))


@query("""SELECT strftime(h, '%Y%m') AS month, count(DISTINCT day(h)) AS days, count(DISTINCT hour(h)) AS hours, count(DISTINCT (day(h), hour(h))) AS pairs
FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) + INTERVAL 1 HOUR]) AS h FROM events) GROUP BY 1""")
def hours_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days and hours to ask for around all events."""
    out = ingest.hours_either_side(table(spark, sf_dir, "events"), "ts")
    return out.select("month", *[F.size(c).cast("long").alias(c) for c in ("days", "hours", "pairs")])


@query(f"SELECT place % 25 AS nation, ceil((max(lat) + 0.5) * 4) / 4 AS n, floor((min(lon) - 0.5) * 4) / 4 AS w, floor((min(lat) - 0.5) * 4) / 4 AS s, ceil((max(lon) + 0.5) * 4) / 4 AS e FROM ({_P}) GROUP BY 1")
def event_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on the grid around groups of places."""
    return ingest.event_box(points(spark, sf_dir).withColumn("nation", F.col("place") % 25), ["nation"])


@query("""SELECT o_custkey, CAST(round(avg(v) * 1e6) AS BIGINT) AS mean, count(*) AS n FROM (SELECT o_custkey, v0 * (1 - w) + v1 * w AS v FROM (
SELECT o_custkey, epoch(o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT))) AS t FROM orders), LATERAL (SELECT CAST(floor(t / 3600) AS BIGINT) AS h, t / 3600 - floor(t / 3600) AS w),
LATERAL (SELECT CASE WHEN h % 7 != 0 THEN sin(h % 1000) END AS v0, CASE WHEN (h + 1) % 7 != 0 THEN sin((h + 1) % 1000) END AS v1) WHERE v0 IS NOT NULL AND v1 IS NOT NULL) GROUP BY 1""")
def hourly_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between the hours on either side, where both are there."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.timestamp_add("MINUTE", F.col("o_orderkey") % 1440, F.col("o_orderdate").cast("timestamp")).alias("ts"))
    hours = o.select(F.explode(F.array(F.date_trunc("hour", "ts"), F.timestamp_add("HOUR", F.lit(1), F.date_trunc("hour", "ts")))).alias("hour")).distinct().withColumn("h", (F.unix_seconds("hour") / 3600).cast("long"))
    grid = hours.where("h % 7 != 0").select("hour", F.lit(1).alias("cell"), F.sin(F.col("h") % 1000).alias("value"))
    out = ingest.between_hours(o.withColumn("cell", F.lit(1)), grid, ["cell"])
    return out.groupBy("o_custkey").agg(F.round(F.avg("blended") * 1e6).cast("long").alias("mean"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT event_id AS obs, user_id, floor(epoch(ts)) AS t FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, floor(epoch(ts)) AS u, max(value) AS value FROM events WHERE event_type != 'purchase' GROUP BY ALL)
SELECT o.obs, arg_min(value, (abs(u - t), u)) FILTER (WHERE abs(u - t) <= 7200) AS near, min(value) FILTER (WHERE u BETWEEN t - 28800 AND t) AS least FROM o LEFT JOIN r ON r.user_id = o.user_id AND u BETWEEN t - 28800 AND t + 7200 GROUP BY 1""")
def dawn_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest record's value, and the least of those before."""
    e = table(spark, sf_dir, "events").withColumn("u", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    o = e.where("event_type = 'purchase'").select(F.col("event_id").alias("obs"), "user_id", F.col("u").alias("t"))
    r = e.where("event_type != 'purchase'").groupBy("user_id", "u").agg(F.max("value").alias("value"))
    return ingest.dawn(o, r, "user_id", 7200.0, 28800.0)


@query("""WITH e AS (SELECT user_id % 50 AS site, value, make_timestamp(CAST((floor(epoch(ts)) + (user_id % 50 * 7 - 170) / 15.0 * 3600) * 1000000 AS BIGINT)) AS t FROM (SELECT *, ts AS t0 FROM events) WHERE value >= 0)
SELECT site, CAST(CAST(t AS DATE) AS VARCHAR) AS day, CAST(round(avg(value) * 1e6) AS BIGINT) AS mean FROM e WHERE hour(t) + minute(t) / 60.0 BETWEEN 8 AND 16 GROUP BY 1, 2 HAVING count(*) >= 4""")
def daytime_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means over local solar daytime, of days with enough hours."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("site"), "value", F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("ts")).withColumn("lon", F.col("site") * 7.0 - 170.0)
    out = ingest.daytime_means(e, ["site"], "lon")
    return out.select("site", F.col("day").cast("string").alias("day"), micro("mean").alias("mean"))


@query("SELECT n_name FROM nation WHERE n_nationkey % 3 != 0 ORDER BY n_name")
def unchanged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored parts that are made as they would be now."""
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("box"), F.array(F.lit(1000), F.lit(925)).alias("levels"))
    stored = table(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 3 == 0, None).otherwise(F.col("n_regionkey")).alias("box"), F.array(F.lit(1000), F.lit(925)).alias("levels"))
    return ingest.unchanged(stored, n, "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 != 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def left_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neither ledger nor the list of those to skip has."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return ingest.to_fetch(c, done, c.where("c_custkey % 3 = 0"), "c_custkey")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'a/' || c_custkey WHEN c_custkey % 4 IN (1, 2) THEN 'b/' || c_custkey END AS url FROM customer""")
def first_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of two layouts of a file's place that is there."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey").cast("string")
    there = c.where("c_custkey % 4 = 0").select(F.concat(F.lit("a/"), k).alias("url")).unionByName(c.where("c_custkey % 4 < 3").select(F.concat(F.lit("b/"), k).alias("url")))
    return ingest.first_layout(c, there, "c_custkey", [F.concat(F.lit("a/"), k), F.concat(F.lit("b/"), k)])


@query("""SELECT user_id, event_type, min(event_id) AS first, count(*) AS waiting FROM events GROUP BY 1, 2""")
def single_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for requests that are alike."""
    return ingest.single_flight(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")


@query("""SELECT event_type, CAST(round(sum(value * CASE event_type WHEN 'click' THEN 2.5 WHEN 'view' THEN 15.0 WHEN 'purchase' THEN 60.0 ELSE 0 END) * 100) AS BIGINT) AS seconds FROM events GROUP BY 1""")
def work_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds of the work that is left, by learned costs or the usual ones."""
    work = table(spark, sf_dir, "events").select("event_type", F.col("event_type").alias("kind"), F.col("value").alias("units"))
    costs = spark.createDataFrame([("click", 2.5)], "kind string, seconds double")
    out = ingest.remaining_seconds(work, costs, ["event_type"], {"click": 9.0, "view": 15.0, "purchase": 60.0})
    return out.select("event_type", F.round(F.col("seconds") * 100).cast("long").alias("seconds"))


@query("""SELECT n_regionkey, substr(sha1(string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_name)), 1, 12) AS version FROM (SELECT n_regionkey, n_name, n_nationkey FROM nation) GROUP BY 1""")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of what each answer was made from."""
    return ingest.version_hash(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name", "n_nationkey")


@query("""SELECT o_orderkey, CASE WHEN s = 0 THEN 'no-store' ELSE 'public, max-age=' || least(s, 86400) || ', stale-if-error=86400' END AS cache_control, CASE WHEN s > 0 THEN 'public, max-age=' || s || ', stale-if-error=86400' END AS cdn_cache_control,
CASE WHEN s > 0 THEN 'sky,sky-terrain,sky-' || o_orderstatus END AS cache_tag FROM (SELECT o_orderkey, o_orderstatus, o_orderkey % 5 * 40000 AS s FROM orders)""")
def cache_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long answers are kept, and their tags."""
    h = ingest.cache_headers(F.col("o_orderkey") % 5 * 40000, F.array(F.lit("terrain"), F.col("o_orderstatus")), "sky")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[v.alias(k) for k, v in h.items()])


@query("""WITH p AS (SELECT l_orderkey, l_linenumber AS km, max(CASE WHEN l_quantity > 8 THEN l_quantity END) AS a, max(CASE WHEN l_discount > 0.01 THEN l_discount END) AS b FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, min(km) AS f, min(km) FILTER (WHERE a IS NULL) AS ga, min(km) FILTER (WHERE b IS NULL) AS gb FROM p GROUP BY 1),
s AS (SELECT *, CASE WHEN ga IS NULL OR ga > f THEN 'forecast' WHEN gb IS NULL OR gb > f THEN 'typical' END AS source FROM g)
SELECT l_orderkey, km, source, CASE WHEN source = 'forecast' THEN a ELSE b END AS value FROM p JOIN s USING (l_orderkey) WHERE (source = 'forecast' AND km < coalesce(ga, 99)) OR (source = 'typical' AND km < coalesce(gb, 99))""")
def path_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the first source that has their beginning, as far as it goes."""
    li = relational.spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"), 1, keys=("l_orderkey",))  # a path is in one task
    p = li.groupBy("l_orderkey", F.col("l_linenumber").alias("km")).agg(F.max(F.when(F.col("l_quantity") > 8, F.col("l_quantity"))).alias("a"), F.max(F.when(F.col("l_discount") > 0.01, F.col("l_discount"))).alias("b"))
    parts = p.select("l_orderkey", "km", F.explode(F.array(F.struct(F.lit("typical").alias("source"), F.col("b").alias("value")), F.struct(F.lit("forecast").alias("source"), F.col("a").alias("value")))).alias("s")).select("l_orderkey", "km", "s.source", "s.value")
    return ingest.first_source(parts, ["l_orderkey"], "km", "source", ["forecast", "typical"]).select("l_orderkey", "km", "source", "value")


@query("""WITH m AS (SELECT l_orderkey, l_returnflag AS member, l_linenumber AS km, max(l_quantity) AS v FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey, member, count(*) AS c FROM m GROUP BY ALL), w AS (SELECT l_orderkey, max(c) AS n FROM n GROUP BY 1)
SELECT l_orderkey, member, CAST(round(1e6 / any_value(k)) AS BIGINT) AS weight FROM m JOIN (SELECT l_orderkey, count(*) AS k FROM n JOIN w USING (l_orderkey) GROUP BY 1 HAVING bool_and(c = n)) USING (l_orderkey) GROUP BY 1, 2""")
def whole_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an ensemble that all have the whole path, with their weights."""
    m = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("member"), F.col("l_linenumber").alias("km")).agg(F.max("l_quantity").alias("value"))
    paths = m.groupBy("l_orderkey", "member").agg(F.count("*").alias("c")).groupBy("l_orderkey").agg(F.max("c").alias("n"))
    out = ingest.whole_members(m, paths, ["l_orderkey"])
    return out.groupBy("l_orderkey", "member").agg(F.round(F.max("weight") * 1e6).cast("long").alias("weight"))


@query(f"""WITH c AS (SELECT unnest(range(0, 12)) AS m), s AS (SELECT m, k, i, j, CASE WHEN (m + k) % 9 != 0 THEN 270 + 10 * sin(m) + k + 2.0 * i + 0.5 * j END AS v FROM c, range(0, 8) a(k), range(0, 9) x(i), range(0, 13) y(j)),
r AS (SELECT event_id AS req_id, ts, -20 + (event_id % 161) / 4.0 AS lat, -60 + (event_id * 7 % 241) / 2.0 AS lon FROM events), t AS (SELECT *, dayofyear(ts) - 1 + (hour(ts) + minute(ts) / 60.0) / 24.0 AS doy, hour(ts) + minute(ts) / 60.0 + second(ts) / 3600.0 AS h FROM r),
p(k, a, b) AS (VALUES (0, 15.5, 45.0), (1, 45.0, 74.5), (2, 74.5, 105.0), (3, 105.0, 135.5), (4, 135.5, 166.0), (5, 166.0, 196.5), (6, 196.5, 227.5), (7, 227.5, 258.0), (8, 258.0, 288.5), (9, 288.5, 319.0), (10, 319.0, 349.5), (11, 349.5, 380.5)),
mw AS (SELECT t.*, k AS m0, (k + 1) % 12 AS m1, (d - a) / (b - a) AS wm FROM (SELECT *, CASE WHEN doy < 15.5 THEN doy + 365 ELSE doy END AS d FROM t) t, p WHERE d > a AND d <= b OR d = 15.5 AND k = 0),
sw AS (SELECT *, CAST(greatest(ceil((x - 1.5) / 3.0) - 1, 0) AS INT) AS sk FROM (SELECT *, CASE WHEN h < 1.5 THEN h + 24 ELSE h END AS x FROM mw)), sv AS (SELECT *, (x - 1.5 - 3.0 * sk) / 3.0 AS ws FROM sw),
q AS (SELECT req_id, lat, lon, unnest([m0, m0, m1, m1]) AS m, unnest([sk % 8, (sk + 1) % 8, sk % 8, (sk + 1) % 8]) AS k, unnest([(1 - wm) * (1 - ws), (1 - wm) * ws, wm * (1 - ws), wm * ws]) AS w FROM sv)
SELECT req_id, 't2m' AS field, round(sum(w * (270 + 10 * sin(m) + k + 2.0 * (lat + 20) / 5 + 0.5 * (lon + 60) / 10)) / sum(w) * 1e4) AS value FROM q WHERE (m + k) % 9 != 0 AND w > 0 GROUP BY 1 HAVING sum(w) >= 0.5""")
def clim_fields_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typical fields at times and places: slots around the time, grid points around the place."""
    grid = spark.range(12).select(F.col("id").alias("month"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("slot")).where("(month + slot) % 9 != 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(12))))
    mean = F.sin("month") * 10 + 270.0 + F.col("slot") + F.col("i") * 2.0 + F.col("j") * 0.5
    # a grid of 5 degrees by 5: longitudes are halved so that one step serves both
    store = grid.select(F.lit("t2m").alias("field"), "month", "slot", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), (mean * 3).alias("total"), F.lit(3).alias("n"))
    e = table(spark, sf_dir, "events")
    r = e.select(F.col("event_id").alias("req_id"), "ts", (F.col("event_id") % 161 / 4.0 - 20.0).alias("lat"), ((F.col("event_id") * 7 % 241 / 2.0 - 60.0 + 60.0) / 2 - 20.0).alias("lon"))
    out = climatology.fields_at(r, store, -20.0, -20.0, 5.0, 9, 13)
    return out.select("req_id", "field", F.round(F.col("value") * 1e4).alias("value"))


@query("""WITH y AS (SELECT year(o_orderdate) AS year, o_orderpriority AS cell, avg(o_totalprice) AS mean, count(*) AS n FROM orders WHERE year(o_orderdate) NOT IN (1996) GROUP BY ALL), u AS (SELECT DISTINCT year FROM y WHERE year BETWEEN 1994 - 5 AND 1998 ORDER BY year DESC LIMIT 5)
SELECT cell, CAST(round(sum(mean * n) / sum(n) * 100) AS BIGINT) AS mean, CAST(sum(n) AS BIGINT) AS n, (SELECT count(*) FROM u) AS years FROM y JOIN u USING (year) GROUP BY 1""")
def prior_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over some years, a missing one replaced by an earlier one."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("cell")).agg(F.avg("o_totalprice").alias("mean"), F.count("*").alias("n"))
    out = climatology.combined(o.where("year != 1996"), ["cell"], 1994, 1998)
    return out.select("cell", F.round(F.col("mean") * 100).cast("long").alias("mean"), "n", "years")


@query(f"""SELECT place, CASE WHEN cell_j IS NULL THEN NULL ELSE month END AS month, lo FROM (SELECT place, least(floor((lat + 90) / 5), 35) AS ci, CAST(floor((lon + 180) / 5) AS BIGINT) % 72 AS cj FROM ({_P})) p
LEFT JOIN (SELECT i AS cell_i, j AS cell_j, m AS month, i + j - m AS lo FROM range(0, 36) a(i), range(0, 72) b(j), range(0, 12) c(m) WHERE (i * 5 + j) % 4 != 0) e ON cell_i = ci AND cell_j = cj""")
def envelope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months' envelope of each place's cell."""
    cells = spark.range(36).select(F.col("id").alias("cell_i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(71).cast("long"))).alias("cell_j")).where("(cell_i * 5 + cell_j) % 4 != 0").withColumn("month", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))))
    return stats.envelope_at(points(spark, sf_dir), cells.withColumn("lo", F.col("cell_i") + F.col("cell_j") - F.col("month"))).select("place", "month", "lo")


@query("""WITH a AS (SELECT o_custkey AS cell, month(o_orderdate) * 2 AS hour, o_orderpriority AS field, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey AS cell, month(o_orderdate) * 2 + 6 - 6 AS hour, o_orderpriority AS field, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
SELECT a.hour, a.field, CAST(round(median(abs(a.v - b.v)) * 100) AS BIGINT) AS change FROM a JOIN b USING (cell, hour, field) WHERE a.field IN ('1-URGENT', '5-LOW') AND a.hour <= 12 GROUP BY ALL HAVING median(abs(a.v - b.v)) > 10""")
def run_jump_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps between two runs six hours apart at the times that both forecast."""
    o = table(spark, sf_dir, "orders")
    run = lambda k, shift: o.where(F.col("o_orderkey") % 2 == k).groupBy(F.col("o_custkey").alias("cell"), (F.month("o_orderdate") * 2 + shift).alias("hour"), F.col("o_orderpriority").alias("field")).agg(F.avg("o_totalprice").alias("value"))
    out = guard.aligned_jumps(run(0, 0), run(1, 6), "2026010106", "2026010100", ["cell"], {"1-URGENT": 10.0, "5-LOW": 10.0}, 12)
    return out.select("hour", "field", F.round(F.col("change") * 100).cast("long").alias("change"))


@query(f"""SELECT count(*) AS cells, CAST(sum(CAST(round((lat * 4)) AS BIGINT) * 1000 + CAST(round(lon * 4) AS BIGINT)) AS BIGINT) AS mark FROM (SELECT DISTINCT round(lat) AS lat, round(lon) AS lon FROM ({_P}))""")
def cropped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a global grid, from 0 to 360 degrees, at the points of a region."""
    wanted = points(spark, sf_dir).select(F.round("lat").alias("lat"), F.round("lon").alias("lon")).distinct()
    grid = spark.range(181).select((F.col("id") - 90.0).alias("lat"), F.explode(F.sequence(F.lit(0), F.lit(359))).alias("lon")).withColumn("lon", F.col("lon").cast("double"))
    grid = grid.withColumn("row", F.round(F.col("lat") * 4).cast("long") * 1000)
    out = ingest.cropped(grid, wanted)  # the region's longitudes, of which 180 and -180 are one cell of the grid
    return out.agg(F.count("*").alias("cells"), F.sum(F.col("row") + F.round(F.col("lon") * 4).cast("long")).alias("mark"))
