"""What only larger tables showed: results that hung on the order of rows, odd places, last bits."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from almucantar.operators import answers, ingest, relational, stats, terrain
from almucantar.plans import registry, sky


def from_sql(name, **tables):
    con = duckdb.connect()
    for t, frame in tables.items():
        con.register(t, frame)
    out = con.execute(registry.oracle_sql()[name]).df()
    return sorted(map(tuple, out[sorted(out.columns)].astype(object).values.tolist()))


def from_query(spark, folder, name, **tables):
    for t, frame in tables.items():
        frame.to_parquet(folder / f"{t}.parquet")
    out = registry.queries()[name](spark, str(folder))
    return sorted(tuple(r) for r in out.select(*sorted(out.columns)).collect())


def keys(**columns):
    return pd.DataFrame({k: pd.Series(v, dtype="int64") for k, v in columns.items()})


def test_ranks_whatever_the_order_of_rows(spark):
    values = np.random.default_rng(8).normal(size=60000)

    def mixed(frames):
        for _ in frames:
            pass
        yield pd.DataFrame({"k": 1, "v": np.random.default_rng().permutation(values)})  # another order each time

    rows = spark.range(0, 1, 1, 1).mapInPandas(mixed, "k int, v double")
    r = stats.percentiles(rows, ["k"], "v", {"a": 0.1, "b": 0.37, "c": 0.9}).collect()
    assert len(r) == 1 and [r[0]["a"], r[0]["b"], r[0]["c"]] == pytest.approx(np.percentile(values, [10, 37, 90]).tolist(), abs=1e-12)


def test_hourly_weights_to_the_last_bit(spark):
    at = [1_000_000_020 + 3600 * 977 * k + 60 * (k % 60) for k in range(200)]
    requests = spark.createDataFrame([(t, 1) for t in at], "t long, cell int").withColumn("ts", F.timestamp_seconds("t"))
    hours = sorted({t // 3600 + k for t in at for k in (0, 1)})
    grid = spark.createDataFrame([(h * 3600, 1, float(np.sin(h % 1000))) for h in hours], "t long, cell int, value double").select(F.timestamp_seconds("t").alias("hour"), "cell", "value")
    for r in ingest.between_hours(requests, grid, ["cell"]).select("t", "blended").collect():
        h = r["t"] // 3600
        w = r["t"] / 3600 - h
        assert r["blended"] == float(np.sin(h % 1000)) * (1.0 - w) + float(np.sin((h + 1) % 1000)) * w


def test_cells_at_the_date_line(spark, tmp_path):
    customer = keys(c_custkey=[k for k in range(36000) if (k * 104729) % 36000 >= 35900 or (k * 104729) % 36000 < 100])
    assert from_query(spark, tmp_path, "cropped_cells", customer=customer) == from_sql("cropped_cells", customer=customer)


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["area_finest", "area_city", "areas_containing"])
def test_no_task_holds_all_cells(spark, name):
    """Cells of areas are many more rows than Spark expects: a broadcast of them fills the driver."""
    joins = [line for line in plan(registry.queries()[name](spark, "/root/testdata/sf0.001")).splitlines() if "Join" in line and "_i#" in line]
    assert joins and not [line for line in joins if "Broadcast" in line]


@pytest.mark.parametrize("rule", ["finest", "city"])
def test_best_areas_against_all_pairs(spark, rule):
    rng = np.random.default_rng(11)
    n = 400
    s, w = rng.integers(-40, 40, n) / 4, rng.integers(-40, 40, n) / 4
    h, e = 2.0 ** rng.integers(-3, 5, n), 2.0 ** rng.integers(-3, 5, n)
    h[:5] = 0.0  # lines and points
    rows = [(k, float(s[k]), float(w[k]), float(s[k] + h[k]), float(w[k] + e[k]), int(rng.integers(1, 4)) * 10, float(rng.integers(0, 26))) for k in range(n)]
    rows += [(n + r[0], *r[1:]) for r in rows[:60]]
    boxes = spark.createDataFrame(rows, "id long, s double, w double, n double, e double, level int, radius_km double")
    at = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.integers(-44, 60, 900) / 4, rng.integers(-44, 60, 900) / 4, strict=True))], "place long, lat double, lon double")
    expected = relational.pick_area(relational.containing_areas(at, boxes, "place"), "place", rule).collect()
    assert sorted(relational.best_areas(at, boxes, "place", rule).collect()) == sorted(expected) and expected


def test_small_files_are_dealt_to_tasks(spark, tmp_path):
    keys(s_suppkey=range(3000)).assign(s_name="x").to_parquet(tmp_path / "supplier.parquet")
    assert sky._terrain(spark, str(tmp_path)).rdd.getNumPartitions() == 4
    for name in ("horizon_tiles", "horizon_crests", "variogram_lags"):
        assert "RoundRobinPartitioning" in plan(registry.queries()[name](spark, str(tmp_path)))


def test_ray_tiles_by_their_ends(spark):
    """Places near edges, the date line and the poles, against all samples of their rays."""
    rows = [(1, 60.37, -179.9), (2, -33.0, 20.99), (3, 79.9, 5.1), (4, 89.7, 0.0), (5, -0.001, 0.001), (6, 45.5, 7.5), (7, 66.9, 100.0), (8, -80.05, 33.33)]
    p = spark.createDataFrame(rows, "place long, lat double, lon double").withColumn("ends", terrain.ends(F.col("lat"), F.col("lon"), F.lit(2.0)))
    wide = terrain.rise_ranges(p)
    count = F.ceil((F.col("rise_hi") - F.col("rise_lo") + 0.5) / 0.5).cast("int")
    side = lambda lo: F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.col(lo) + k * 0.5)
    rays = wide.withColumn("azimuth", F.explode(F.concat(side("rise_lo"), side("set_lo")))).withColumn("e", F.explode("ends")).withColumn("metres", F.explode(F.lit([k * 2000.0 for k in range(21)])))
    lat, lon = terrain.destinations(F.col("e.lat"), F.col("e.lon"), F.col("azimuth"), F.col("metres"))
    expected = rays.select("place", F.floor(lat).alias("i"), F.floor(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("j")).distinct()
    assert sorted(terrain.ray_tiles(p, 40.0).collect()) == sorted(expected.collect())


def test_fits_of_all_lengths(spark):
    """Rays are fitted whole, not sample by sample in Spark's interpreter."""
    rows = spark.createDataFrame([([1.0, 4.0, 9.0, 16.0],), ([2.0, None, 3.0],), ([5.0, 5.0, 5.0],), ([1.0, 2.0],), (None,)], "h array<double>").select(answers.smoothed_ground(F.col("h"), 1.0, 2.0).alias("f"))
    got = [r["f"] for r in rows.collect()]
    assert got[0] == pytest.approx([1.0, 4.0, 9.0, 16.0]) and got[1] == [None] * 3 and got[2] == pytest.approx([5.0] * 3) and got[3:] == [[1.0, 2.0], None]
    assert "ArrowEvalPython" in plan(rows)


def test_paths_are_sorted_once(spark, tmp_path):
    """A path is in one task, and none sorts its rows for joins with what was found of them."""
    rows = [(1, 1, "b", 5.0), (1, 2, "b", 6.0), (1, 1, "a", None), (1, 2, "a", 7.0), (2, 1, "a", 1.0), (2, 2, "a", None), (2, 3, "a", 3.0), (3, 1, "a", None), (3, 1, "b", None), (4, 1, "c", 1.0), (5, 2, "a", 4.0)]
    out = ingest.first_source(spark.createDataFrame(rows, "k long, at int, source string, value double"), ["k"], "at", "source", ["a", "b"])
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, "b", 5.0), (1, 2, "b", 6.0), (2, 1, "a", 1.0), (5, 2, "a", 4.0)]
    assert "Join" not in plan(registry.queries()["path_sources"](spark, "/root/testdata/sf0.001"))
