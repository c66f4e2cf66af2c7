"""Queries of the ingest side: climatologies, guards, merges, ledgers, calendars and calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almucantar.functions import text
from almucantar.operators import climatology, columns, guard, kernels, relational, stats
from almucantar.plans.registry import query
from almucantar.session import table
from almucantar.sources import records
from almucantar.streaming import flows

_SUMS = """SELECT CAST(month(ts) - 1 AS INT) AS month, CAST(hour(ts) // 3 AS INT) AS slot, event_type, sum(value) AS total, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY ALL"""


@query(f"SELECT month, slot, event_type, CAST(round(total * 100) AS BIGINT) AS total, n FROM ({_SUMS})")
def clim_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and counts by month and slot."""
    out = climatology.sums(table(spark, sf_dir, "events"), ["event_type"])
    return out.select("month", "slot", "event_type", F.round(F.col("total") * 100).cast("long").alias("total"), "n")


_BLEND = f"""
WITH store AS ({_SUMS}), r AS (
  SELECT event_id AS req_id, event_type, ts + INTERVAL 20 DAY AS t FROM events
), m AS (
  SELECT *, dayofyear(t) - 1 + (hour(t) + minute(t) / 60.0) / 24.0 AS doy, hour(t) + minute(t) / 60.0 + second(t) / 3600.0 AS h FROM r
), p(k, a, b) AS (VALUES (0, 15.5, 45.0), (1, 45.0, 74.5), (2, 74.5, 105.0), (3, 105.0, 135.5), (4, 135.5, 166.0), (5, 166.0, 196.5),
  (6, 196.5, 227.5), (7, 227.5, 258.0), (8, 258.0, 288.5), (9, 288.5, 319.0), (10, 319.0, 349.5), (11, 349.5, 380.5)
), mw AS (
  SELECT req_id, event_type, h, k, (d - a) / (b - a) AS w FROM (SELECT *, CASE WHEN doy < 15.5 THEN doy + 365 ELSE doy END AS d FROM m), p
  WHERE d BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY k) = 1
), mm AS (
  SELECT req_id, event_type, h, k AS month, 1 - w AS wm FROM mw UNION ALL SELECT req_id, event_type, h, (k + 1) % 12, w FROM mw
), sw AS (
  SELECT *, CASE WHEN h < 1.5 THEN h + 24 ELSE h END AS x FROM mm
), s1 AS (
  SELECT *, CAST(greatest(ceil((x - 1.5) / 3.0) - 1, 0) AS INT) AS sk FROM sw
), s2 AS (
  SELECT *, (x - 1.5 - 3.0 * sk) / 3.0 AS w2 FROM s1
), both_slots AS (
  SELECT req_id, event_type, month, sk % 8 AS slot, wm * (1 - w2) AS w FROM s2 UNION ALL SELECT req_id, event_type, month, (sk + 1) % 8, wm * w2 FROM s2
), o AS (
  SELECT b.req_id, sum(w * total / n) / sum(w) AS v FROM both_slots b JOIN store USING (month, slot, event_type) WHERE w > 0 AND n >= 5
  GROUP BY 1 HAVING sum(w) >= 0.5
)
SELECT r.req_id, r.event_type, round(v * 10000) AS blended FROM r LEFT JOIN o USING (req_id)
"""


@query(_BLEND)
def clim_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typical value at the time of each event twenty days on; null where too few slots are ready."""
    events = table(spark, sf_dir, "events")
    store = climatology.sums(events, ["event_type"])
    requests = events.select(F.col("event_id").alias("req_id"), "event_type", (F.col("ts") + F.expr("interval 20 days")).alias("ts"))
    out = climatology.blend(requests, store, ["event_type"], min_samples=5)
    return out.select("req_id", "event_type", F.round(F.col("blended") * 1e4).alias("blended"))


@query("""SELECT user_id % 10 AS cell, CAST(round(sum(m * n) / sum(n) * 1e6) AS BIGINT) AS mean, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT user_id, event_type, avg(value) AS m, count(value) AS n FROM events GROUP BY ALL) WHERE m IS NOT NULL GROUP BY 1""")
def clim_weighted_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of parts merged by their counts."""
    parts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    out = climatology.weighted_merge(parts.withColumn("cell", F.col("user_id") % 10), ["cell"])
    return out.select("cell", F.round(F.col("mean") * 1e6).cast("long").alias("mean"), "n")


@query("""SELECT l_returnflag, CAST(round(avg(l_quantity) * 1e4) AS BIGINT) AS m_q, CAST(round(avg(l_discount) * 1e6) AS BIGINT) AS m_d,
CAST(round(avg(l_quantity * l_quantity) * 1e4) AS BIGINT) AS m_qq, CAST(round(avg(l_quantity * l_discount) * 1e4) AS BIGINT) AS m_qd,
CAST(round(avg(l_discount * l_discount) * 1e6) AS BIGINT) AS m_dd FROM lineitem GROUP BY 1""")
def covariance_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and products that covariances are made of."""
    m = climatology.moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], ["l_returnflag"])
    names = {"m_q": ("m_l_quantity", 1e4), "m_d": ("m_l_discount", 1e6), "m_qq": ("m_l_quantity_l_quantity", 1e4), "m_qd": ("m_l_quantity_l_discount", 1e4), "m_dd": ("m_l_discount_l_discount", 1e6)}
    return m.select("l_returnflag", *[F.round(F.col(c) * k).cast("long").alias(n) for n, (c, k) in names.items()])


@query()
def sigma_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted variations along the strongest modes of a covariance; SQL has no eigenvectors."""
    m = climatology.moments(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])
    return kernels.sigma_members(m, "l_returnflag", ["l_quantity", "l_discount", "l_tax"])


@query("""SELECT f AS field, count(*) FILTER (WHERE v < lo OR v > hi) AS bad, CAST(0 AS BIGINT) AS infinite FROM (
  SELECT 't2m' AS f, l_quantity * 8.0 AS v, 178.0 AS lo, 334.0 AS hi FROM lineitem UNION ALL SELECT 'psfc', l_extendedprice * 2.0, 30000.0, 110000.0 FROM lineitem
  UNION ALL SELECT 't80m', l_quantity * 9.0, 170.0, 340.0 FROM lineitem UNION ALL SELECT 't850', l_quantity * 10.0, 160.0, 350.0 FROM lineitem
  UNION ALL SELECT 'z500', l_extendedprice, -2000.0, 40000.0 FROM lineitem) GROUP BY 1 HAVING bad > 0""")
def guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each field no air can have."""
    fields = {"t2m": F.col("l_quantity") * 8.0, "psfc": F.col("l_extendedprice") * 2.0, "t80m": F.col("l_quantity") * 9.0, "t850": F.col("l_quantity") * 10.0, "z500": F.col("l_extendedprice")}
    cells = table(spark, sf_dir, "lineitem").select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in fields.items()])).alias("c")).select("c.*")
    return guard.out_of_range(cells)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, below FROM (
SELECT *, lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS below FROM (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY ALL)) WHERE l_extendedprice <= below""")
def level_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that do not rise."""
    levels = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("l_extendedprice"))
    return guard.not_rising(levels, ["l_orderkey"], "l_linenumber", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_extendedprice", "below")


@query("""SELECT o_orderpriority AS field, CAST(round(median(abs(a.p - b.p)) * 100) AS BIGINT) AS change
FROM (SELECT o_custkey, o_orderpriority, avg(o_totalprice) p FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL) a
JOIN (SELECT o_custkey, o_orderpriority, avg(o_totalprice) p FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL) b USING (o_custkey, o_orderpriority)
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1 HAVING median(abs(a.p - b.p)) > 10""")
def run_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose median change between two runs is over their limit."""
    o = table(spark, sf_dir, "orders")
    run = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey", F.col("o_orderpriority").alias("field")).agg(F.avg("o_totalprice").alias("value"))
    out = guard.jumps(run(0), run(1), ["o_custkey"], {"1-URGENT": 10.0, "2-HIGH": 10.0, "5-LOW": 10.0})
    return out.select("field", F.round(F.col("change") * 100).cast("long").alias("change"))


@query("""SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'purchase'), max(value) FILTER (WHERE event_type = 'click'), max(value) FILTER (WHERE event_type = 'view')) AS value,
CASE WHEN count(value) FILTER (WHERE event_type = 'purchase') > 0 THEN 'purchase' WHEN count(value) FILTER (WHERE event_type = 'click') > 0 THEN 'click'
WHEN count(value) FILTER (WHERE event_type = 'view') > 0 THEN 'view' END AS event_type FROM events GROUP BY 1""")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value of the best source that has one."""
    return relational.by_priority(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["purchase", "click", "view"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key."""
    return relational.first_wins(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def ledger_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the ledger lacks."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return relational.not_in_ledger(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_name")


@query("""SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT user_id, event_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 7200 THEN 0 ELSE 1 END AS new
FROM (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events))) GROUP BY user_id, run""")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of events at most two hours apart."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    return relational.islands(e, ["user_id"], "t", 7200)


@query("""SELECT a.event_id, arg_min(b.event_id, (abs(b.t - a.t), b.event_id)) AS near_id,
CAST(floor(min(abs(b.t - a.t))) AS BIGINT) AS seconds FROM (SELECT *, epoch(ts) AS t FROM events WHERE event_type = 'purchase') a
LEFT JOIN (SELECT *, epoch(ts) AS t FROM events WHERE event_type = 'click') b ON a.user_id = b.user_id AND b.t - a.t BETWEEN -21600 AND 5400 GROUP BY 1""")
def nearest_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest click within six hours before and an hour and a half after each purchase."""
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("t").alias("u"))
    out = relational.nearest_within(left, right, "user_id", "t", "u", "click_id", 21600, 5400)
    return out.select("event_id", "near_id", F.floor(F.abs("seconds")).alias("seconds"))


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT o_custkey, count(*) n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) n FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.o_custkey = b.o_custkey
WHERE a.n IS DISTINCT FROM b.n""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two snapshots."""
    o = table(spark, sf_dir, "orders")
    snap = lambda k: o.where(F.col("o_orderkey") % 2 == k).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return relational.snapshot_diff(snap(0), snap(1), "o_custkey", "n")


@query("""SELECT CAST(arg_max(k, (c, -k)) AS INT) AS phase FROM (SELECT ((date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) % 4) + 4) % 4 AS k, count(*) AS c FROM orders GROUP BY 1)""")
def mode_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase that most days have."""
    return stats.mode_phase(table(spark, sf_dir, "orders"), "o_orderdate", "1992-01-01", 4).select(F.col("phase").cast("int").alias("phase"))


@query("""SELECT CAST(DATE '2026-09-30' - CAST(4 * i + ((date_diff('day', DATE '2021-01-01', DATE '2026-09-30') - 1) % 4) AS INT) AS VARCHAR) AS day FROM range(0, 600) t(i)
WHERE DATE '2026-09-30' - CAST(4 * i + ((date_diff('day', DATE '2021-01-01', DATE '2026-09-30') - 1) % 4) AS INT) >= DATE '2021-03-22'""")
def sample_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth day of a fixed calendar, newest first."""
    days = spark.range(1).select(F.explode(F.expr("sequence(date'2021-03-22', date'2026-09-30', interval 1 day)")).alias("d"))
    return days.where("pmod(datediff(d, date'2021-01-01'), 4) = 1").orderBy(F.desc("d")).select(F.col("d").cast("string").alias("day"))


@query("SELECT CAST(h AS INT) AS hour FROM (SELECT unnest(range(0, 121)) AS h UNION ALL SELECT unnest(range(123, 169, 3)))")
def forecast_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly to 120, then every three hours to 168."""
    return spark.range(1).select(F.explode(F.concat(F.sequence(F.lit(0), F.lit(120)), F.sequence(F.lit(123), F.lit(168), F.lit(3)))).alias("hour"))


@query("""SELECT l_orderkey, l_linenumber, CAST(round(101325.0 * exp(sum(-9.80665 * (l_quantity * 10.0) / (287.05 * (250.0 + l_linenumber * 5.0))) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING)) * 100) AS BIGINT) AS pressure FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)""")
def hydrostatic_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pressure carried up through layers."""
    layers = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    rows = layers.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 10.0).alias("rise"), (F.col("l_linenumber") * 5.0 + 250.0).alias("kelvin"))
    out = columns.running_pressure(rows, ["l_orderkey"], "l_linenumber", "rise", "kelvin", 101325.0)
    return out.select("l_orderkey", "l_linenumber", F.round(F.col("pressure") * 100).cast("long").alias("pressure"))


def _columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    level = F.struct((F.lit(1000) - F.col("l_linenumber") * 25).alias("p_mb"), (F.col("l_extendedprice") / 40.0).alias("z"), (F.col("l_quantity") + 240.0).alias("t"))
    own = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(level)).alias("levels"), F.max("l_tax").alias("tax"))
    k = F.col("l_orderkey")
    return own.select("l_orderkey", (k % 700 + 0.0).alias("orog"), (F.lit(283.15) + k % 11).alias("t2m"), (F.lit(97000.0) - k % 900).alias("psfc"), (k % 2 + 0.0).alias("land"), (F.lit(282.65) + k % 11).alias("t80m"), F.lit(None).cast("double").alias("t100m"), "levels")


@query()
def build_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered levels of each column, moved onto the ground: folds over arrays, tested against plain Python."""
    out = columns.profile(_columns(spark, sf_dir), {80: "t80m", 100: "t100m"})
    moved = columns.follow_terrain(F.col("profile"), F.col("orog"), F.col("orog") + F.col("l_orderkey") % 300)
    return out.select("l_orderkey", "water", "profile", moved.alias("moved"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(source, '')) = '' THEN 'no reading' WHEN TRY_CAST(substr(CAST(n_chars AS VARCHAR), 1, 2) AS DOUBLE) IS NULL THEN 'bad row'
WHEN NOT TRY_CAST(substr(CAST(n_chars AS VARCHAR), 1, 2) AS DOUBLE) BETWEEN 16.0 AND 22.1 THEN 'out of range' WHEN lang != 'en' THEN 'not clear' WHEN doc_id % 5 > 3 THEN 'twilight' WHEN doc_id % 7 > 4 THEN 'moon up' END AS reason FROM documents) GROUP BY 1""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each test leaves out."""
    d = table(spark, sf_dir, "documents")
    raw = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "").otherwise(F.substring(F.col("n_chars").cast("string"), 1, 2))
    cloud = F.when(F.col("lang") == "en", "Clear").otherwise("cloudy")
    sun = F.when(F.col("doc_id") % 5 > 3, 0.0).otherwise(-30.0)
    moon = F.when(F.col("doc_id") % 7 > 4, 1.0).otherwise(-1.0)
    return d.select(records.reading_reason(raw, cloud, F.current_date(), sun, moon).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT user_id, CAST(round(exp(med) * 1e6) AS BIGINT) AS ratio, n, CAST(round(l[n // 2 + 1] * 1e6) AS BIGINT) AS spread FROM (
SELECT user_id, any_value(med) AS med, count(*) AS n, list_sort(list(abs(x - med))) AS l FROM (
SELECT user_id, x, median(x) OVER (PARTITION BY user_id) AS med FROM (SELECT user_id, ln(a / b) AS x FROM (
SELECT user_id, CAST(ts AS DATE) AS d, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY ALL) WHERE a > 0.01 AND b > 0.02)) GROUP BY 1) WHERE n >= 3""")
def log_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median log ratio of two daily series."""
    e = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    out = stats.log_ratio(e, ["user_id"], "a", "b", 3)
    return out.select("user_id", F.round(F.col("ratio") * 1e6).cast("long").alias("ratio"), "n", F.round(F.col("spread") * 1e6).cast("long").alias("spread"))


@query("""SELECT user_id, l[CAST(ceil(round(0.9 * (n - 1), 9)) AS BIGINT) + 1] AS higher, l[n // 2 + 1] AS upper FROM (SELECT user_id, list_sort(list(value)) AS l, count(*) AS n FROM events GROUP BY 1)""")
def percentile_higher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The higher percentile and the upper median of each group."""
    e = table(spark, sf_dir, "events").select("user_id", "value")
    return stats.higher_percentile(e, ["user_id"], "value", 0.9).join(stats.upper_median(e, ["user_id"], "value"), "user_id")


@query("SELECT DISTINCT substr(md5(o_orderpriority), 1, 4) AS tag, CAST(strftime(o_orderdate, '%Y%m%d') || '06' AS VARCHAR) AS cycle_id FROM orders")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run ids and tags; ids are parsed and written again."""
    o = table(spark, sf_dir, "orders")
    made = text.cycle_time(F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("06")))
    return o.select(F.substring(F.md5("o_orderpriority"), 1, 4).alias("tag"), F.date_format(made, "yyyyMMddHH").alias("cycle_id")).distinct()


@query("SELECT time_bucket(INTERVAL 3 HOUR, ts) AS start, event_type, CAST(round(sum(value) * 100) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1, 2")
def window_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-time windows; the same code runs on a stream."""
    out = flows.window_sums(table(spark, sf_dir, "events"), ["event_type"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round(F.col("total") * 100).cast("long").alias("total"), "n")


_LEVELS = """SELECT l_orderkey, 1000.0 - l_linenumber * 100 AS p, CASE WHEN max(l_quantity) > 20 THEN max(l_extendedprice) / 50 END AS z, max(l_discount) * 100 AS t FROM lineitem WHERE l_linenumber < 8 GROUP BY l_orderkey, l_linenumber"""


@query(f"""WITH l AS ({_LEVELS}), b AS (SELECT *, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
first_value(k IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS f
FROM (SELECT *, CASE WHEN z IS NOT NULL THEN struct_pack(p := p, z := z, t := t) END AS k FROM l))
SELECT l_orderkey, CAST(p AS BIGINT) AS p, CAST(round(coalesce(z, f.z + 287.05 * ((f.t + t) / 2 + 273.15) / 9.80665 * ln(f.p / p)) * 1000) AS BIGINT) AS z FROM b WHERE f IS NOT NULL""")
def filled_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing heights of levels from the known ones below."""
    li = table(spark, sf_dir, "lineitem").where("l_linenumber < 8").groupBy("l_orderkey", "l_linenumber")
    rows = li.agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("e"), F.max("l_discount").alias("d"))
    levels = rows.select("l_orderkey", (F.lit(1000.0) - F.col("l_linenumber") * 100).alias("p"), F.when(F.col("q") > 20, F.col("e") / 50).alias("z"), (F.col("d") * 100).alias("t"))
    out = columns.filled_heights(levels, ["l_orderkey"])
    return out.select("l_orderkey", F.col("p").cast("long").alias("p"), F.round(F.col("z") * 1000).cast("long").alias("z"))
