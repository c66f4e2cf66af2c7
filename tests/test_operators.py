"""Operators that SQL does not check, against plain Python."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from almucantar.functions import astro, geo, photometry, text
from almucantar.operators import climatology, columns, guard, kernels, relational, stats
from almucantar.sources import records
from almucantar.streaming import flows


def test_monotone_filter_and_follow_terrain(spark):
    levels = [(2.0, 10.0, 1000.0), (100.0, 9.0, 988.0), (90.0, 9.5, 995.0), (800.0, 5.0, 920.0), (700.0, 4.0, 930.0), (3000.0, -5.0, 700.0), (2990.0, -4.0, 690.0)]
    df = spark.createDataFrame([(levels,)], "levels array<struct<h:double,t:double,p:double>>")
    kept = []
    for lv in sorted(levels):
        if not kept or (lv[0] > kept[-1][0] and lv[2] < kept[-1][2]):
            kept.append(lv)
    out = df.select(columns.monotone(F.col("levels")).alias("k")).withColumn("m", columns.follow_terrain(F.col("k"), F.lit(0.0), F.lit(200.0))).first()
    assert [tuple(x) for x in out["k"]] == kept
    moved = [tuple(x) for x in out["m"]]
    assert moved[0][0] == pytest.approx(202.0) and moved[-1] == kept[-1]
    for lo, hi in zip(moved, moved[1:], strict=False):
        assert hi[0] > lo[0] and hi[2] < lo[2]
    assert out["m"][0]["p"] == pytest.approx(moved[1][2] * math.exp(9.80665 * (moved[1][0] - moved[0][0]) / (287.05 * ((moved[0][1] + moved[1][1]) / 2 + 273.15))))


def test_guard_edges(spark):
    cells = [("t2m", 184.0), ("t2m", 329.0), ("psfc", 33000.0), ("t500", 185.0), ("t2m", None), ("t2m", float("nan")), ("t2m", 10.0), ("psfc", 1013.0), ("orog", 12000.0), ("land", 7.0), ("odd", 1e9), ("t850", float("inf"))]
    found = {r["field"]: (r["bad"], r["infinite"]) for r in guard.out_of_range(spark.createDataFrame(cells, "field string, value double")).collect()}
    assert found == {"t2m": (1, 0), "psfc": (1, 0), "orog": (1, 0), "land": (1, 0), "t850": (0, 1)}


def test_sun_events(spark):
    days = spark.createDataFrame([(date(2026, 3, 20), 31.78, 35.22, e) for e in ("sunrise", "sunset")] + [(date(2026, 12, 21), 80.0, 0.0, "sunrise")], "day date, lat double, lon double, event string")
    rows = {(r["day"], r["event"]): r for r in astro.sun_events(days).collect()}
    rise = rows[date(2026, 3, 20), "sunrise"]
    hours = ((rise["event_jd"] - 2440587.5) % 1) * 24
    assert 3.6 < hours < 3.85 and 88 < rise["azimuth"] < 91
    assert rows[date(2026, 12, 21), "sunrise"]["event_jd"] is None


def test_add_to_store_counts_each_cycle_once(spark):
    samples = spark.createDataFrame([("a", "2026-01-01 01:00:00", 1.0, 0), ("a", "2026-01-01 02:00:00", 3.0, 0), ("b", "2026-01-02 01:00:00", float("nan"), 0)], "cycle_id string, t string, value double, cell int").withColumn("ts", F.col("t").cast("timestamp"))
    store = spark.createDataFrame([], "month int, slot int, cell int, total double, n long")
    ledger = spark.createDataFrame([], "cycle_id string")
    store, ledger = climatology.add_to_store(store, ledger, samples, ["cell"], 3)
    again, ledger2 = climatology.add_to_store(store, ledger, samples, ["cell"], 3)
    assert [tuple(r) for r in again.collect()] == [(0, 0, 0, 12.0, 6)]
    assert sorted(r[0] for r in ledger2.collect()) == ["a", "b"]


def test_stream_archive_is_exactly_once(spark, tmp_path):
    root, landing = f"file://{tmp_path}/store", f"{tmp_path}/in"
    make = lambda c, v: spark.createDataFrame([(c, "2026-01-01 04:00:00", v, 1)], "cycle_id string, t string, value double, cell int").select("cycle_id", F.col("t").cast("timestamp").alias("ts"), "value", "cell")
    held = lambda b: b.where("value > 100")
    for c, v in (("a", 2.0), ("a", 2.0), ("b", 4.0), ("c", 999.0)):
        make(c, v).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("cycle_id string, ts timestamp, value double, cell int").parquet(landing)
        stream.writeStream.foreachBatch(flows.archive_batch(root, ["cell"], held)).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in flows.current(spark, root).collect()] == [(0, 1, 1, 6.0, 2)]
    assert spark.read.parquet(f"{root}/quarantine").count() == 1


def test_sigma_points_keep_mean_and_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4))
    points = kernels.sigma_points(x.mean(0), np.cov(x.T))
    assert sum(w for w, _ in points) == pytest.approx(1) and len(points) == 7
    assert np.allclose(sum(w * d for w, d in points), 0)


def test_encoders_round_trip():
    rng = np.random.default_rng(2)
    rgb = rng.integers(0, 256, (8, 8, 3), dtype=np.uint8)
    assert (kernels.png_pixels(kernels.png(rgb)) == rgb).all()
    v = rng.integers(0, 30000, 50)
    z = kernels.zigzag_delta(v).astype(np.int64)
    assert (np.cumsum((z >> 1) ^ -(z & 1)) == v).all()
    assert kernels.high_water([0, 1, 2, 0, 3]) == [0, 0, 0, 3, 0]
    assert kernels.oct_encode(np.array([[0, 0, 1.0], [1.0, 0, 0]])).tolist() == [[128, 128], [255, 128]]


def test_simplify_and_cover():
    ring = [(0, 0), (0.5, 0.00001), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert kernels.simplify(ring, 25) == [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    profiles = np.array([[0, 0, 5.0], [1, 1, 0], [0.5, 0, 0]])
    assert kernels.set_cover(profiles, 0.1, 12) == [0, 1]
    assert kernels.set_cover(profiles, 0.1, 1) == [0, 1]


def test_polygon_with_hole_and_azimuths(spark):
    outer, hole = [0.0, 0.0, 10.0, 0.0, 10.0, 10.0, 0.0, 10.0], [4.0, 4.0, 6.0, 4.0, 6.0, 6.0, 4.0, 6.0]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 1.0)], "x double, y double")
    got = [r[0] for r in df.select(geo.polygon_contains(F.col("x"), F.col("y"), F.lit([outer, hole]))).collect()]
    assert got == [True, False, False]
    row = spark.range(1).select(geo.in_azimuths(F.lit(5.0), F.lit(350.0), F.lit(10.0)), geo.in_azimuths(F.lit(20.0), F.lit(350.0), F.lit(10.0))).first()
    assert tuple(row) == (True, False)


def test_text(spark):
    df = spark.createDataFrame([("Ã©t", "NEW YORK", "2020-07"), ("plain", "Mixed Case", "2020"), ("日本", "x", "bad")], "a string, b string, c string")
    rows = [tuple(r) for r in df.select(text.fix_text(F.col("a")), text.title_case(F.col("b")), text.decimal_year(F.col("c"))).collect()]
    assert rows[0] == ("ét", "New York", pytest.approx(2020 + 6.5 / 12)) and rows[1] == ("plain", "Mixed Case", 2020.5) and rows[2][0] == "日本" and rows[2][2] is None


def test_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("#ISM00040179 2020 01 02 00 2330    3 x\n21 00000  97000   100 " + "  120 x\n10 00000  85000  1500    50 x\n10 00000  70000 -9999  -100 x\n")
    got = records.soundings(records.numbered_lines(spark, str(tmp_path / "s.txt"))).orderBy("line_no").collect()
    assert [(r["p"], r["z"]) for r in got] == [(970.0, 100.0), (850.0, 1500.0), (700.0, None)]
    assert str(got[0]["release"]) == "2020-01-02 23:30:00"
    lines = spark.createDataFrame([("a", 1, "x,Jan-02-1999,6:30:01"), ("a", 2, "05:59:59,03/04/87"), ("a", 3, "junk")], "file string, line_no long, line string")
    assert [(str(r["day"]), r["time"]) for r in records.observations(lines).orderBy("line_no").collect()] == [("1999-01-02", "06:30:01"), ("1987-03-04", "05:59:59")]
    index = spark.createDataFrame([("f", 0, "t", "1"), ("f", 10, "z", "1"), ("f", 30, "q", "1"), ("f", 50, "t", "2")], "file string, pos long, name string, level string")
    want = spark.createDataFrame([("t", "1"), ("z", "1"), ("t", "2")], "name string, level string")
    assert sorted(tuple(r) for r in records.byte_ranges(index, want).collect()) == [("f", 0, 29, 2), ("f", 50, None, 1)]
    feature = '{"properties":{"id":"a"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]],[[0,0],[1,1],[0,0]]]}}'
    row = records.geojson_polygons(spark.createDataFrame([(feature,)], "feature string")).first()
    assert row["id"] == "a" and len(row["polygons"]) == 1 and len(row["polygons"][0]) == 1


def test_ranges_and_units(spark):
    az = spark.createDataFrame([(1, a) for a in (0.0, 0.5, 1.0, 5.0)], "k int, azimuth double")
    assert sorted((r["lo"], r["hi"]) for r in columns.azimuth_ranges(az, ["k"], "azimuth", 0.5).collect()) == [(4.5, 5.5), (359.5, 1.5)]
    row = spark.range(1).select(photometry.to_kelvin(F.lit(10.0), F.lit("degC")), photometry.to_pascal(F.lit(10.0), F.lit("mb")), photometry.real_ground(F.lit([-5.0, 5.0]), F.lit(0.0)), photometry.real_ground(F.lit([-50.0, -30.0]), F.lit(0.0))).first()
    assert tuple(row) == (283.15, 1000.0, 2.5, -40.0)
    r, g, b = (geo.terrarium(F.lit(123.5))[k] for k in "rgb")
    assert spark.range(1).select(geo.from_terrarium(r, g, b)).first()[0] == 123.5
    assert columns.distance_steps(0, 1)[:2] == [30.0, 45.0] and len(columns.candidate_grid(31, 35, 0.2, 100)) == 13


def test_nearest_ties_and_empty(spark):
    left = spark.createDataFrame([(1, 1, 100.0)], "event_id long, user_id long, t double")
    right = spark.createDataFrame([(1, 8, 90.0), (1, 7, 110.0)], "user_id long, click_id long, u double")
    out = relational.nearest_within(left, right, "user_id", "t", "u", "click_id", 50, 50).collect()
    assert [(r["near_id"], r["seconds"]) for r in out] == [(7, 10.0)]
    assert relational.nearest_within(left.limit(0), right, "user_id", "t", "u", "click_id", 50, 50).count() == 0
    assert stats.mode_phase(spark.createDataFrame([], "d date"), "d", "2020-01-01", 4).first()["phase"] == 0


def test_moon_altitude_is_plausible(spark):
    """Full Moon of 2026-01-03 about 10:03 UT: opposite the Sun, so high where it is midnight."""
    jd = F.lit(2461043.9190)
    rows = spark.createDataFrame([(28.0, 30.0), (28.0, -150.0)], "lat double, lon double").select(astro.moon_altitude(jd, F.col("lat"), F.col("lon")), astro.altitude(astro.sun_place(jd), F.col("lat"), F.col("lon"))).collect()
    for moon, sun in rows:
        assert abs(moon + sun) < 8
    assert rows[1][0] > 70


def test_rising_and_retention(spark):
    levels = spark.createDataFrame([(1, 1000.0, 100.0, 10.0), (1, 900.0, None, 5.0), (1, 800.0, 2000.0, 0.0), (1, 790.0, 2000.2, 0.0), (2, 900.0, None, 1.0)], "k int, p double, z double, t double")
    filled = columns.filled_heights(levels, ["k"])
    z = {(r["k"], r["p"]): r["z"] for r in filled.collect()}
    assert (2, 900.0) not in z and z[1, 900.0] == pytest.approx(100 + 287.05 * (7.5 + 273.15) / 9.80665 * math.log(1000 / 900))
    assert sorted(r["p"] for r in columns.rising(filled, ["k"]).collect()) == [800.0, 900.0, 1000.0]
    runs = spark.createDataFrame([(f"20260101{h:02d}",) for h in (0, 6, 12)], "run string")
    from almucantar.operators import serving

    assert sorted(r[0] for r in serving.retained(runs, "run", 2).collect()) == ["2026010106", "2026010112"]
