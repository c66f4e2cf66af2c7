"""Horizons, tiles, areas and upkeep against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from almucantar.operators import areas, climatology, ingest, kernels, relational, stats, terrain
from almucantar.sources import records

R = 6371008.8


def ground(lat, lon):
    return np.sin(lat * 50) * np.cos(lon * 40) * 200.0 + 300.0


def plain_crest(lat, lon, eye, az, steps, coefficients):
    """The highest point of a ray for each coefficient of refraction, with the crests between steps."""
    steps = np.array(steps)

    def at(d):
        p, x, a = math.radians(lat), d / R, math.radians(az)
        up = math.sin(p) * np.cos(x) + math.cos(p) * np.sin(x) * math.cos(a)
        return np.maximum(ground(np.degrees(np.arcsin(up)), lon + np.degrees(np.arctan2(math.sin(a) * np.sin(x) * math.cos(p), np.cos(x) - math.sin(p) * up))), 0.0)

    h = at(steps)
    views = {c: (h - eye) / steps - steps * (1 - c) / (2 * R) for c in [0.13, *coefficients]}
    v = views[0.13]
    peaks = [k for k in range(len(v)) if k in (0, len(v) - 1) or (v[k] >= v[k - 1] and v[k] >= v[k + 1])]
    centres = sorted(peaks, key=lambda k: (-v[k], k))[:3] + [int(views[c].argmax()) for c in coefficients]
    fine = np.concatenate([np.linspace(steps[max(k - 2, 0)], steps[min(k + 2, len(v) - 1)], 81) for k in centres])
    hf, best = at(fine), {}
    for c in [0.13, *coefficients]:
        k, vf = int(views[c].argmax()), (hf - eye) / fine - fine * (1 - c) / (2 * R)
        j = int(vf.argmax())
        best[c] = (fine[j], hf[j]) if vf[j] > views[c][k] else (steps[k], h[k])
    return best, h


def test_crests_and_alternates(spark):
    steps = [1000.0 + 60 * k for k in range(1200)]
    rows = [(i, 30.0 + i * 0.37, 35.0 - i * 0.21, 510.0, 0.0) for i in range(6)]
    observers = spark.createDataFrame(rows, "site long, lat double, lon double, eye double, floor double")
    hills = lambda df: df.withColumn("height", F.sin(F.col("lat") * 50) * F.cos(F.col("lon") * 40) * 200.0 + 300.0)
    coefficients = [-0.2, 0.0, 0.3, 0.6, 0.9]
    listed = 0
    for r in terrain.crests(observers, [80.0, 120.0], steps, hills, coefficients).collect():
        _, lat, lon, eye, _ = rows[r["site"]]
        best, h = plain_crest(lat, lon, eye, r["azimuth"], steps, coefficients)
        d0 = best[0.13][0]
        assert r["metres"] == pytest.approx(d0, abs=1e-3) and r["height"] == pytest.approx(best[0.13][1], abs=1e-6)
        other = sorted({(round(d, 3), round(x, 4)) for d, x in (best[c] for c in coefficients) if abs(d - d0) > 2 * max(15.0, 0.004 * d0) and x > 0})
        got = sorted({(round(a["metres"], 3), round(a["height"], 4)) for a in r["alternates"]})
        assert got == other
        listed += len(other)
        far = max([d0] + [d for d, _ in other])
        assert r["lowest"] == pytest.approx(h[np.array(steps) <= far].min())
    assert listed


def test_vantage_and_standing(spark):
    rng = np.random.default_rng(3)
    slopes = rng.normal(size=(2, 9, 10))
    rows = [(a, s, float(z), float(slopes[a, s, z])) for a in range(2) for s in range(9) for z in range(10)]
    out = terrain.vantage(spark.createDataFrame(rows, "area long, spot long, azimuth double, slope double"), "area", 0.05, 12, 1.0).collect()
    for a in range(2):
        own = [r for r in out if r["area"] == a]
        assert sorted(r["spot"] for r in own) == sorted(kernels.set_cover(slopes[a], 0.05, 12))
        assert [r["width"] for r in own] == sorted((r["width"] for r in own), reverse=True)
        served = {z for r in own for z in range(10) if slopes[a, r["spot"], z] <= slopes[a, :, z].min() + 0.05}
        assert served == set(range(10))
    spots = spark.createDataFrame([(1, 1, -5.0), (1, 2, 1.0), (2, 3, -9.0)], "area int, spot int, height double")
    assert sorted(r["spot"] for r in terrain.standable(spots, F.lit(0.0), "area").collect()) == [2, 3]


def test_ray_tiles(spark):
    p = spark.createDataFrame([(1, 31.0, 35.0), (2, -20.5, 179.9)], "place long, lat double, lon double").withColumn("ends", terrain.ends(F.col("lat"), F.col("lon"), F.lit(0.0)))
    got = {}
    for r in terrain.ray_tiles(p, 60.0).collect():
        got.setdefault(r["place"], set()).add((r["i"], r["j"]))
    for place, lat, lon in ((1, 31.0, 35.0), (2, -20.5, 179.9)):
        wide = math.degrees(math.asin(math.sin(math.radians(23.44)) / math.cos(math.radians(lat)))) + 3
        expected = set()
        for middle in (90, 270):
            for az in np.arange(middle - wide, middle + wide + 0.5, 0.5):
                for d in np.arange(0.0, 60001.0, 2000.0):
                    x, a, q = d / R, math.radians(az), math.radians(lat)
                    up = math.sin(q) * math.cos(x) + math.cos(q) * math.sin(x) * math.cos(a)
                    to = lon + math.degrees(math.atan2(math.sin(a) * math.sin(x) * math.cos(q), math.cos(x) - math.sin(q) * up))
                    expected.add((math.floor(math.degrees(math.asin(up))), math.floor((to + 180) % 360 - 180)))
        assert got[place] == expected


def test_names_and_levels(spark):
    df = spark.createDataFrame([({"NAME": "", "Name2": "x"}, "ST. ANDREW'S-HILL", "Wards", 3), ({"name": "y"}, "Ünder", "unknown", 2)], "p map<string,string>, n string, c string, l int")
    rows = df.select(areas.prop(F.col("p"), "name", "NAME2").alias("p"), areas.title_case(F.col("n")).alias("t"), areas.level_name(F.col("c"), F.col("l")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("x", "St. Andrew's-Hill", "Wards"), ("y", "Ünder", "ADM2 unit")]
    levels = spark.createDataFrame([("A", 2, "Districts"), ("A", 3, "Wards"), ("B", 1, "Provinces"), ("B", 2, "Municipalities"), ("C", 4, "Village")], "iso string, level int, canonical string")
    assert sorted(tuple(r) for r in areas.default_levels(levels, "iso").collect()) == [("A", 2, 3), ("B", 2, None), ("C", 4, None)]


def test_areas_are_simplified(spark):
    ring = [[0.0, 0.0], [0.5, 0.00001], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    row = areas.as_areas(spark.createDataFrame([("a", [[ring]])], "id string, polygons array<array<array<array<double>>>>")).first()
    assert row["polygons"] == [[[0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 0.0]]] and (row["s"], row["w"], row["n"], row["e"]) == (0.0, 0.0, 1.0, 1.0)


def test_upkeep(spark):
    fields = spark.createDataFrame([(f,) for f in ("t2m", "t80m", "t500", "z850")], "field string")
    got = {r["field"]: tuple(r["m"]) for r in fields.select("field", ingest.message_of(F.col("field")).alias("m")).collect()}
    assert got == {"t2m": ("TMP", "2 m above ground"), "t80m": ("TMP", "80 m above ground"), "t500": ("TMP", "500 mb"), "z850": ("HGT", "850 mb")}
    index = spark.createDataFrame([("TMP", "500 mb"), ("TMP", "500 mb")], "variable string, level string")
    assert [r["field"] for r in ingest.present(fields, index).collect()] == ["t500"]
    grid = spark.createDataFrame([(10.0, 359.75, 1.0), (10.0, 0.0, 2.0), (10.25, 0.0, 3.0), (10.25, 359.75, 4.0)], "lat double, lon double, v double")
    want = spark.createDataFrame([(10.0, -0.25)], "lat double, lon double")
    assert [tuple(r) for r in ingest.cropped(grid, want).collect()] == [(10.0, -0.25, 1.0)]
    with pytest.raises(Exception, match="not on the grid"):
        ingest.cropped(grid, want.withColumn("lat", F.lit(11.0))).collect()
    assert ingest.covering(grid, 10.0, -0.25, 10.25, 0.0, 0.0).count() == 4
    with pytest.raises(Exception, match="too small"):
        ingest.covering(grid, 10.0, 0.0, 10.25, 0.0, 0.0).collect()
    steps = spark.createDataFrame([(0, 1460), (4 * 59, 1460), (4 * 59, 1464), (1459, 1460)], "k int, n int")
    month, slot = ingest.month_and_slot(F.col("k"), F.col("n"))
    assert [tuple(r) for r in steps.select(month, slot).collect()] == [(0, 0), (2, 0), (1, 0), (11, 3)]
    states = spark.createDataFrame([("partial", 0), ("failed", 3400), ("failed", 3200), ("done", 0)], "state string, t long").withColumn("at", F.timestamp_seconds("t"))
    assert sorted((r["state"], r["t"]) for r in ingest.due(states, F.timestamp_seconds(F.lit(3600))).collect()) == [("failed", 3200), ("partial", 0)]


def test_climatology_rules(spark):
    samples = spark.createDataFrame([("a", "2026-01-01 01:00:00", 1.0, 0), ("a", "2026-01-01 01:00:00", float("nan"), 1), ("a", "2026-01-01 02:00:00", 3.0, 0), ("a", "2026-01-01 02:00:00", 5.0, 1)], "cycle_id string, t string, value double, cell int").withColumn("ts", F.col("t").cast("timestamp"))
    store, ledger = climatology.add_to_store(spark.createDataFrame([], "month int, slot int, cell int, total double, n long"), spark.createDataFrame([], "cycle_id string"), samples, ["cell"])
    assert sorted(tuple(r) for r in store.collect()) == [(0, 0, 0, 3.0, 1), (0, 0, 1, 5.0, 1)] and ledger.count() == 1
    hours = spark.range(12 * 4).select(F.make_timestamp(F.lit(2025), (F.floor(F.col("id") / 4) + 1).cast("int"), F.lit(3), (F.col("id") % 4 * 6).cast("int"), F.lit(0), F.lit(0)).alias("ts"), F.lit(10.0).alias("value"), F.lit("degC").alias("units"), F.lit("t2m").alias("field"), F.lit(1).alias("cell"))
    assert {r["mean"] for r in climatology.reduced(hours, ["cell"]).collect()} == {283.15}
    with pytest.raises(Exception, match="some slots have no data"):
        climatology.reduced(hours.where("month(ts) != 4"), ["cell"]).collect()
    years = spark.createDataFrame([(2000, 1, 1.0, 1)], "year int, cell int, mean double, n long")
    with pytest.raises(Exception, match="too few years"):
        climatology.combined(years, ["cell"], 2000, 2003).collect()


def test_ranks_of_groups(spark):
    rng = np.random.default_rng(5)
    groups = {0: np.repeat([1.0, 2.0], 500).tolist(), 1: rng.normal(size=997).tolist(), 2: [4.0], 3: [float("nan"), None]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k int, v double")
    got = {r["k"]: r for r in stats.percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 1.0}).collect()}
    assert sorted(got) == [0, 1, 2]
    for k, r in got.items():
        assert [r["a"], r["b"], r["c"]] == pytest.approx(np.percentile(groups[k], [0, 37, 100]).tolist()) and r["n"] == len(groups[k])
    upper = {r["k"]: r["upper"] for r in stats.upper_median(df, ["k"], "v").collect()}
    assert upper == {k: sorted(groups[k])[len(groups[k]) // 2] for k in (0, 1, 2)}


def test_left_rows_stay(spark):
    left = spark.createDataFrame([(1, 1, 100.0), (1, 1, 100.0), (2, 9, 5.0)], "event_id long, user_id long, t double")
    right = spark.createDataFrame([(1, 8, 90.0)], "user_id long, click_id long, u double")
    out = relational.nearest_within(left, right, "user_id", "t", "u", "click_id", 50, 50).collect()
    assert sorted((r["event_id"], r["near_id"] or 0) for r in out) == [(1, 8), (1, 8), (2, 0)]


def test_kriging_against_one_place_at_a_time(spark):
    rng = np.random.default_rng(6)
    sites = [{"site": k, "lat": float(a), "lon": float(b), "ratio": float(c), "error": 0.02} for k, (a, b, c) in enumerate(zip(rng.uniform(30, 40, 25), rng.uniform(0, 10, 25), rng.uniform(0.5, 2, 25), strict=True))]
    places = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(28, 42, 40), rng.uniform(-2, 12, 40), strict=True))], "place long, lat double, lon double")
    lat, lon, z = (np.array([s[k] for s in sites]) for k in ("lat", "lon", "ratio"))
    z, micro = np.log(z), 0.05 - 0.02
    k_all = 0.3 * np.exp(-kernels._km(lat[:, None], lon[:, None], lat, lon) / 100) + np.diag(np.full(25, micro + 0.02))
    one = np.linalg.solve(k_all, np.ones(25))
    mean = one @ z / one.sum()
    for r in kernels.krige(places, sites, 0.05, 0.3, 100.0).collect():
        d = kernels._km(r["lat"], r["lon"], lat, lon)
        use = np.flatnonzero(d <= 300)
        k = 0.3 * np.exp(-d[use] / 100)
        w = np.linalg.solve(k_all[np.ix_(use, use)], k) if len(use) else k
        assert r["factor"] == pytest.approx(math.exp(mean + w @ (z[use] - mean))) and r["sd_log"] == pytest.approx(math.sqrt(0.3 + micro - w @ k))
        assert [s["site"] for s in r["stations"]] == use[np.argsort(d[use])].tolist() and sum(s["weight"] for s in r["stations"]) == pytest.approx(w.sum())
    few = spark.createDataFrame([(1, 30.0, 30.0, 0.1), (2, 31.0, 31.0, 0.3)], "site long, lat double, lon double, z double")
    assert tuple(stats.network_model(few).first()) == (pytest.approx(0.02), 0.0, 1.0)


def test_png_row_filters():
    import struct
    import zlib

    rng = np.random.default_rng(9)
    pixels = rng.integers(0, 256, (5, 7, 3))
    rows = []
    for y in range(5):
        out, flat = [y], pixels.reshape(5, 21)
        for i in range(21):
            a, b, c = (flat[y, i - 3] if i > 2 else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - 3] if y and i > 2 else 0)
            p = int(a) + int(b) - int(c)
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out.append(int(flat[y, i] - [0, a, b, (int(a) + int(b)) // 2, paeth][y]) % 256)
        rows.append(bytes(out))
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    data = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">II5B", 7, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")
    assert (kernels.png_pixels(data) == pixels).all()


def test_observation_files(spark):
    lines = lambda text: spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no long, line string")
    plain = lines(["DOY DATE 1995 1996", "  59 28-Feb 6:10:11 B, 6:10:12", "  60 29-Feb 06:09:01,06:09:02k", "x"])
    assert sorted((str(r["day"]), r["time"], r["code"]) for r in records.year_table(plain).collect()) == [("1995-02-28", "06:10:11", "B"), ("1996-02-28", "06:10:12", ""), ("1996-02-29", "06:09:02", "k")]
    quoted = lines(['Day of 1991 1992 1993 1994', '"01-Jan" "6:38:01" "#N/A" "06:38:03K" "x"', '"bad" "6:38:01"'])
    assert sorted((str(r["day"]), r["time"], r["code"]) for r in records.year_table(quoted, quoted=True).collect()) == [("1991-01-01", "06:38:01", ""), ("1993-01-01", "06:38:03", "K")]
    sheet = spark.createDataFrame([(60, 1995, 0.25, ""), (60, 1996, 0.25, "כ"), (61, 1995, 42.0, ""), (366, 1995, 0.5, "")], "number int, year int, value double, mark string")
    assert sorted((str(r["day"]), r["time"], r["code"]) for r in records.day_fractions(sheet).collect()) == [("1995-12-31", "12:00:00", ""), ("1996-02-29", "06:00:00", "K")]
    body = '{"data":[{"datetime":"2020-01-01T06:00:00+02:00","channels":[{"name":"TD","value":3.5},{"name":"TD","valid":false,"value":4},{"name":"RH","value":1}]}]}'
    got = records.station_temperatures(spark.createDataFrame([(7, body)], "station int, body string")).collect()
    assert [(r["station"], r["at"].hour, r["value"]) for r in got] == [(7, 4, 3.5)]
    own = lines(["# comment", "date,time,event", "2020-01-02,6:30,sunrise", "", "2020-01-03,06:31:05,sunrise"])
    assert [str(r["ts"]) for r in records.observation_times(own).orderBy("line_no").collect()] == ["2020-01-02 04:30:00", "2020-01-03 04:31:05"]
    assert [str(r["day"]) for r in records.leading_dates(lines(["2020-02-01 x", " 2020-01-01", "no", "2020-02-01"])).collect()] == ["2020-01-01", "2020-02-01"]
    feature = '{"properties":{"id":"a"},"geometry":{"type":"GeometryCollection","geometries":[{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]},{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[0,0],[1,1],[0,0]]]]},{"type":"Point","coordinates":[1,2]}]}}'
    assert len(records.geojson_polygons(spark.createDataFrame([(feature,)], "feature string")).first()["polygons"]) == 2


def test_request_places(spark):
    df = spark.createDataFrame([(31.1234567, 35.0, 99.0), (70.0, 35.0, 1.0), (10.0, -20.0, None), (10.0, 20.0, -3.0)], "a double, b double, r double")
    p = ingest.place_parameters(F.col("a"), F.col("b"), F.col("r"), 30.0)
    assert [tuple(r) for r in df.select(*[v.alias(k) for k, v in p.items()]).collect()] == [(31.12346, 35.0, 30.0), (None, None, None), (10.0, -20.0, 0.0), (10.0, 20.0, 0.0)]
    box = spark.range(1).select(terrain.box_ends(F.lit(0.0), F.lit(2.0), F.lit(4.0), F.lit(8.0)).alias("e")).first()["e"]
    assert [tuple(q) for q in box] == [(2.0, 5.0), (0.0, 2.0), (0.0, 8.0), (4.0, 2.0), (4.0, 8.0)]
