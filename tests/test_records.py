"""Rules of the text sources that leave out, replace or refuse rows."""

import pytest

from almucantar.sources import records


def test_soundings_that_are_dropped(spark):
    head = "#ISM00040179 2020 01 02 00 2330    3 x"
    ground, middle, top = "21 00000  97000   100   120 x", "10 00000  85000  1500    50 x", "10 00000  70000  3010  -100 x"
    soundings = [[ground, middle, top], [ground, top], [middle, top, "10 00000  50000  5600  -200 x"], [ground, middle, "10 00000  75000  2500   -50 x"]]
    lines = [line for s in soundings for line in [head, *s]]
    df = spark.createDataFrame([("f", i, line) for i, line in enumerate(lines)], "file string, line_no long, line string")
    got = records.soundings(df).collect()
    assert sorted(r["line_no"] for r in got) == [1, 2, 3]


def test_photometer_days(spark):
    text = ["AERONET Version 3;", "Site,b", "AERONET_Site,Date(dd:mm:yyyy),AOD_500nm,440-870_Angstrom_Exponent,Site_Latitude(Degrees),Site_Longitude(Degrees)"]
    text += ["a,02:01:2020,0.5,1.0,31.5,35.0", "a,02:01:2020,0.25,-999,32.5,35.0<br>a,03:01:2020,-999,1,31.5,35", "a,04:01:2020,x,1,31.5,35", "a,5:1:2020,0.1,2.0,31.5,35", "a,06:01:2020,0.1"]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)] + [("none", 0, "nothing")], "file string, line_no long, line string")
    got = sorted((r["site"], r["lat"], r["lon"], str(r["date"]), r["aod550"]) for r in records.photometer_days(lines).collect())
    assert got == [("a", 31.5, 35.0, "2020-01-02", pytest.approx(0.25 * 1.1**-1.3)), ("a", 31.5, 35.0, "2020-01-05", pytest.approx(0.1 * 1.1**-2))]
    with pytest.raises(Exception, match="unexpected photometer columns"):
        records.photometer_days(spark.createDataFrame([("f", 0, "AERONET_Site,Date(dd:mm:yyyy)"), ("f", 1, "a,02:01:2020")], lines.schema)).collect()


def test_byte_ranges_miss_no_field(spark):
    index = spark.createDataFrame([("f", 0, "t", "1"), ("f", 10, "z", "1"), ("f", 30, "t", "1")], "file string, pos long, name string, level string")
    want = spark.createDataFrame([("t", "1"), ("q", "1")], "name string, level string")
    assert [tuple(r) for r in records.byte_ranges(index, want, want.where("name = 'q'")).collect()] == [("f", 0, 9, 1)]
    with pytest.raises(Exception, match="field not in the file: f q 1"):
        records.byte_ranges(index, want).collect()
    with pytest.raises(Exception, match="field not in the file: f q 1"):
        records.byte_ranges(index, want).count()
