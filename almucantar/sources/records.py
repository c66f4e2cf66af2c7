"""Text sources: soundings, sunrise observations, photometer series, sky readings, GeoJSON, byte-range indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almucantar.operators import columns


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and number, in order within each file."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"))
    return lines.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("_at"))).drop("_at")


def soundings(lines: DataFrame) -> DataFrame:
    """Fixed-width soundings from lines (file, line_no, line): header and level fields by position, missing values as null.

    A sounding stays if, with missing heights filled and only rising levels counted, it has three levels, begins at the
    surface and reaches 3000 m; the levels themselves are given as they were read.
    """
    head = F.col("line").startswith("#")
    own = lines.withColumn("sounding", F.sum(head.cast("int")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))

    def number(start: int, size: int) -> Column:
        return F.trim(F.substring("line", start, size)).try_cast("int")

    heads = own.where(head).select("file", "sounding", F.try_to_date(F.format_string("%04d-%02d-%02d", number(14, 4), number(19, 2), number(22, 2)), "yyyy-MM-dd").cast("timestamp").alias("day"), number(25, 2).alias("hour"), number(28, 2).alias("rel_h"), number(30, 2).alias("rel_m"))
    hour = F.when(F.col("rel_h") != 99, F.col("rel_h") * 60 + F.when(F.col("rel_m") != 99, F.col("rel_m")).otherwise(0)).otherwise(F.col("hour") * 60)
    heads = heads.where("hour != 99").select("file", "sounding", F.timestamp_add("MINUTE", hour, F.col("day")).alias("release"))
    levels = own.where(~head).select("file", "sounding", "line_no", (F.substring("line", 2, 1) == "1").alias("surface"), number(10, 6).alias("p"), number(17, 5).alias("z"), number(23, 5).alias("t"))
    levels = levels.where("p >= 0 and t not in (-9999, -8888)")
    rows = heads.join(levels, ["file", "sounding"]).select("file", "sounding", "release", "line_no", "surface", (F.col("p") / 100.0).alias("p"), F.when(~F.col("z").isin(-9999, -8888), F.col("z").cast("double")).alias("z"), (F.col("t") / 10.0).alias("t"))
    keys = ["file", "sounding"]
    whole = columns.rising(columns.filled_heights(rows, keys), keys).groupBy(*keys).agg(F.count("*").alias("n"), F.max("z").alias("top"))
    whole = whole.where("n >= 3 and top >= 3000").join(rows.groupBy(*keys).agg(F.max_by("surface", "p").alias("first")).where("first"), keys)
    return rows.join(whole, keys, "left_semi")


def observations(lines: DataFrame) -> DataFrame:
    """Sunrise observations of two layouts: ``name,Mon-DD-YYYY,H:MM:SS`` and ``HH:MM:SS,MM/DD/YY`` (of the 1900s)."""
    line = F.col("line")
    a, b = r"^[^,]*,([A-Z][a-z]{2}-\d{2}-\d{4}),(\d{1,2}:\d{2}:\d{2})", r"^(\d{2}:\d{2}:\d{2}),(\d{2})/(\d{2})/(\d{2})"
    day = F.coalesce(F.try_to_date(F.regexp_extract(line, a, 1), "MMM-dd-yyyy"), F.try_to_date(F.concat(F.lit("19"), F.regexp_extract(line, b, 4), F.lit("-"), F.regexp_extract(line, b, 2), F.lit("-"), F.regexp_extract(line, b, 3)), "yyyy-MM-dd"))
    time = F.coalesce(F.nullif(F.regexp_extract(line, a, 2), F.lit("")), F.nullif(F.regexp_extract(line, b, 1), F.lit("")))
    return lines.withColumns({"day": day, "time": F.lpad(time, 8, "0")}).where("day is not null and time is not null")


#: A time of day, as the observation files have it.
TIME = r"(\d{1,2}):(\d{2}):(\d{2})"


def year_table(lines: DataFrame, quoted: bool = False) -> DataFrame:
    """file, line_no, day, time, code of tables with a line for each day and a cell for each year.

    Plain files: a header with DATE and the years, then number, DD-Mon and cells between commas. ``quoted`` ones: a line
    of four years or more, then cells in quotes, the day first. 29 February of common years and cells without a time are
    left out, as are files without a header.
    """
    line = F.col("line")
    years = F.regexp_extract_all(line, F.lit(r"\b(19\d\d)\b" if quoted else r"\b(19\d\d|20\d\d)\b"), F.lit(1))
    is_head = F.size(years) >= 4 if quoted else (F.size(years) >= 2) & F.upper(line).contains("DATE")
    heads = lines.where(is_head).groupBy("file").agg(F.min_by(years, "line_no").alias("years"), F.min("line_no").alias("head"))
    rows = lines.join(heads, "file").where("line_no > head")
    if quoted:
        every = F.regexp_extract_all(line, F.lit('"([^"]*)"'), F.lit(1))
        rows = rows.withColumn("_c", every).where("size(_c) >= 2").withColumns({"ddmon": F.get("_c", F.lit(0)), "cells": F.slice("_c", F.lit(2), F.size("_c"))}).where(F.col("ddmon").rlike(r"^\d{2}-[A-Za-z]{3}$"))
        pattern = f"^{TIME}([A-Za-z]?)$"
    else:
        own = r"^\s*\d+\s+(\d{2}-[A-Za-z]{3})\s*(.*)$"
        rows = rows.where(line.rlike(own)).withColumns({"ddmon": F.regexp_extract(line, own, 1), "cells": F.split(F.regexp_extract(line, own, 2), ",")})
        pattern = TIME + r"\s*([A-Za-z]?)"
    cells = rows.select("file", "line_no", "ddmon", "years", F.posexplode("cells").alias("at", "cell")).where("at < size(years)").withColumn("cell", F.trim("cell")).where(F.col("cell").rlike(pattern))
    part = lambda k: F.regexp_extract("cell", pattern, k)
    day = F.try_to_date(F.concat(F.get("years", F.col("at")), F.lit("-"), F.initcap(F.substring("ddmon", 4, 3)), F.lit("-"), F.substring("ddmon", 1, 2)), "yyyy-MMM-dd")
    return cells.select("file", "line_no", day.alias("day"), F.concat(F.lpad(part(1), 2, "0"), F.lit(":"), part(2), F.lit(":"), part(3)).alias("time"), part(4).alias("code")).where("day is not null")


def leap_day(number: Column, year: Column) -> Column:
    """The date of a day that is counted as in a leap year (60: 29 February); null where the year has none."""
    at = F.date_add(F.lit("2000-01-01").cast("date"), number.cast("int") - 1)
    return F.try_to_date(F.concat(year.cast("string"), F.date_format(at, "-MM-dd")), "yyyy-MM-dd")


def day_fractions(cells: DataFrame) -> DataFrame:
    """day, time, code of a sheet's cells (number of the day as in leap years, year, value, mark): a time is a fraction of a
    day; other values are no observation. Marks are one of three letters."""
    seconds = F.round(F.col("value") * 86400).cast("int")
    time = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds / 60).cast("int") % 60, seconds % 60)
    code = F.coalesce(F.try_element_at(F.create_map(F.lit("ב"), F.lit("B"), F.lit("כ"), F.lit("K"), F.lit("מ"), F.lit("M")), F.trim("mark")), F.lit(""))
    rows = cells.where("value > 0 and value < 1 and number between 1 and 366")
    return rows.select(leap_day(F.col("number"), F.col("year")).alias("day"), time.alias("time"), code.alias("code")).where("day is not null")


def station_temperatures(days: DataFrame, column: str = "body") -> DataFrame:
    """The columns of a station's days, and at, value of its valid readings of channel TD, from JSON text."""
    kind = "struct<data:array<struct<datetime:string,channels:array<struct<name:string,valid:boolean,value:double>>>>>"
    own = days.withColumn("_r", F.explode(F.from_json(column, kind)["data"])).withColumn("_c", F.explode("_r.channels"))
    good = own.where((F.col("_c.name") == "TD") & F.coalesce(F.col("_c.valid"), F.lit(True)) & F.col("_c.value").isNotNull())
    return good.select(*[c for c in days.columns if c != column], F.try_to_timestamp(F.col("_r.datetime")).alias("at"), F.col("_c.value").alias("value"))


def observation_times(lines: DataFrame, offset_hours: int = 2) -> DataFrame:
    """file, line_no, ts in UTC of CSV observations in local time with columns date and time, by name; blank lines and those
    that begin with # are left out."""
    own = lines.where("trim(line) != '' and not startswith(line, '#')").withColumn("f", F.split("line", ","))
    heads = own.groupBy("file").agg(F.min_by("f", "line_no").alias("names"), F.min("line_no").alias("head"))
    rows = own.join(heads, "file").where("line_no > head")
    field = lambda name: F.trim(F.get("f", F.array_position("names", name).cast("int") - 1))
    time = F.when(F.size(F.split(field("time"), ":")) == 2, F.concat(field("time"), F.lit(":00"))).otherwise(field("time"))
    local = F.try_to_timestamp(F.concat(field("date"), F.lit(" "), F.lpad(time, 8, "0")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return rows.select("file", "line_no", F.timestamp_add("HOUR", F.lit(-offset_hours), local).alias("ts")).where("ts is not null")


def leading_dates(lines: DataFrame) -> DataFrame:
    """day: the different dates that lines begin with, in order."""
    return lines.select(F.try_to_date(F.regexp_extract("line", r"^\s*(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd").alias("day")).where("day is not null").distinct().orderBy("day")


def first_per_day(rows: DataFrame, order: str) -> DataFrame:
    """One observation a day, of the first file."""
    at = F.row_number().over(Window.partitionBy("day").orderBy(order, "line_no"))
    return rows.withColumn("_at", at).where("_at = 1").drop("_at").orderBy("day")


def daily_aod(rows: DataFrame) -> DataFrame:
    """Photometer days (site, date, aod500, angstrom): at 550 nm; missing or odd exponents as 1.3, missing depths left out."""
    return rows.where("aod500 >= 0 and aod500 != -999").select("site", "date", _at_550("aod500", "angstrom").alias("aod550"))


def photometer_days(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, line) of daily photometer files as file, site, lat, lon, date, aod550.

    Columns are found by name in the first line that has the date's; a file without that line gives nothing and
    one without a needed column is an error. The last row of a day counts; rows that cannot be read are left out.
    """
    own = lines.select("file", "line_no", F.posexplode(F.split("line", "<br>")).alias("part", "text"))
    own = own.select("file", F.struct("line_no", "part").alias("at"), F.split(F.trim("text"), ",").alias("f"), F.contains("text", F.lit("Date(dd:mm:yyyy)")).alias("names"))
    heads = own.where("names").groupBy("file").agg(F.min_by("f", "at").alias("names"), F.min("at").alias("head"))

    def place(test) -> Column:
        at = F.transform("names", lambda c, k: F.when(test(c), k + 1))
        return F.array_min(at)

    needed = {
        "site": place(lambda c: c.isin("AERONET_Site", "AERONET_Site_Name")),
        "day": place(lambda c: c == "Date(dd:mm:yyyy)"),
        "aod": place(lambda c: c == "AOD_500nm"),
        "lat": place(lambda c: F.contains(c, F.lit("Site_Latitude"))),
        "lon": place(lambda c: F.contains(c, F.lit("Site_Longitude"))),
    }
    most = F.greatest(*needed.values())
    complete = F.when(F.array_contains(F.array(*[c.isNull() for c in needed.values()]), True), F.raise_error(F.concat(F.lit("unexpected photometer columns: "), F.concat_ws(",", "names"))).cast("int")).otherwise(most)
    heads = heads.select("file", "head", complete.alias("most"), *[c.alias(f"i_{k}") for k, c in needed.items()], place(lambda c: c == "440-870_Angstrom_Exponent").alias("i_exponent"))
    rows = own.drop("names").join(heads, "file").where("at > head and size(f) >= most")
    value = {k: F.trim(F.get("f", F.col(f"i_{k}") - 1)) for k in (*needed, "exponent")}
    rows = rows.select("file", "at", F.get("f", F.col("i_site") - 1).alias("site"), F.try_to_date(value["day"], "d:M:yyyy").alias("date"), *[value[k].try_cast("double").alias(k) for k in ("lat", "lon")], value["aod"].try_cast("double").alias("aod500"), F.when(F.col("i_exponent").isNull(), F.lit(-999.0)).otherwise(value["exponent"].try_cast("double")).alias("angstrom"))
    rows = rows.where("date is not null and lat is not null and lon is not null and angstrom is not null and aod500 >= 0")
    first = Window.partitionBy("file", "site").orderBy("at")
    rows = rows.withColumns({"lat": F.first("lat").over(first), "lon": F.first("lon").over(first)})
    days = rows.groupBy("file", "site", "lat", "lon", "date").agg(F.max_by(F.struct("aod500", "angstrom"), "at").alias("v"))
    return days.select("file", "site", "lat", "lon", "date", _at_550("v.aod500", "v.angstrom").alias("aod550"))


def _at_550(depth: str, angstrom: str) -> Column:
    """A depth at 500 nm taken to 550 nm."""
    a = F.col(angstrom)
    return F.col(depth) * F.pow(F.lit(550 / 500), -F.when((a > -1) & (a < 4), a).otherwise(1.3))


def reading_reason(sqm: Column, cloud: Column, day: Column, sun: Column, moon: Column, least: float = 16.0, most: float = 22.1, sun_most: float = -18.0) -> Column:
    """Why a sky reading is left out, by the first test it fails, or null."""
    value = sqm.try_cast("double")
    return (
        F.when(F.coalesce(F.trim(sqm), F.lit("")) == "", "no reading")
        .when(value.isNull(), "bad row")
        .when(~value.between(least, most), "out of range")
        .when(F.coalesce(F.lower(F.trim(cloud)), F.lit("")) != "clear", "not clear")
        .when(day.isNull(), "bad row")
        .when(sun > sun_most, "twilight")
        .when(moon > 0, "moon up")
    )


def geojson_polygons(features: DataFrame, column: str = "feature") -> DataFrame:
    """Features as JSON text to id and polygons (rings of at least four points, as lon, lat pairs); of a collection all its parts'."""
    ring = "array<array<array<double>>>"

    def of(kind: Column, shape: Column) -> Column:
        made = F.when(kind == "Polygon", F.array(F.from_json(shape, ring))).when(kind == "MultiPolygon", F.from_json(shape, f"array<{ring}>"))
        return F.coalesce(made, F.array().cast(f"array<{ring}>"))

    parts = F.from_json(F.get_json_object(column, "$.geometry.geometries"), "array<struct<type:string,coordinates:string>>")
    one = of(F.get_json_object(column, "$.geometry.type"), F.get_json_object(column, "$.geometry.coordinates"))
    polygons = F.concat(one, F.coalesce(F.flatten(F.transform(parts, lambda g: of(g["type"], g["coordinates"]))), F.array().cast(f"array<{ring}>")))
    whole = F.transform(polygons, lambda p: F.filter(p, lambda r: F.size(r) >= 4))
    return features.select(F.get_json_object(column, "$.properties.id").alias("id"), F.filter(whole, lambda p: F.size(p) > 0).alias("polygons"))


def byte_ranges(index: DataFrame, wanted: DataFrame, optional: DataFrame | None = None) -> DataFrame:
    """Index rows (file, pos, name, level) of the wanted names and levels as ranges, neighbours merged; the last has no end.

    Each field is taken once, where it first stands. A file that lacks a wanted field which is not ``optional`` is an error.
    """
    order, field = Window.partitionBy("file").orderBy("pos"), ["name", "level"]
    rows = index.withColumns({"end": F.lead("pos").over(order) - 1, "i": F.row_number().over(order)}).join(wanted, field, "left_semi")
    once = F.row_number().over(Window.partitionBy("file", *field).orderBy("pos"))
    rows = rows.withColumn("_n", once).where("_n = 1").drop("_n")
    needed = wanted.join(optional, field, "left_anti") if optional is not None else wanted
    missing = index.select("file").distinct().crossJoin(needed.select(*field).distinct()).join(index, ["file", *field], "left_anti")
    field_names = F.concat_ws(" ", F.lit("field not in the file:"), "file", "name", "level")
    missing = missing.groupBy("file").agg(F.min(field_names).alias("message"))  # the error stays above the join
    picked = rows.withColumn("run", F.col("i") - F.row_number().over(order))
    ranges = picked.groupBy("file", "run").agg(F.min("pos").alias("start"), F.max_by("end", "i").alias("end"), F.count("*").alias("parts")).drop("run")
    failed = missing.where(F.raise_error(F.col("message")).isNotNull())
    none = [F.lit(None).cast(ranges.schema[c].dataType).alias(c) for c in ("start", "end", "parts")]
    return ranges.unionByName(failed.select("file", *none))
