"""Areas from features of several sources: names, kinds, grouping, merging, simplified outlines, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almucantar.functions import geo
from almucantar.functions import text as texts
from almucantar.operators import kernels, relational

#: Levels of localities and neighbourhoods.
LOCALITY, NEIGHBOURHOOD = 20, 30
#: What marks a unit within municipalities, and a council of a whole region.
WITHIN = r"(?i)village|ward|cell|colline|fokontany|grama|enumeration|barrio|quartier|^communit|submunic|freguesia|hamlet|mukim|dehestan|union council"
REGIONAL = r"(?i)מועצה אזורית|regional council"
#: Place tags of localities and of neighbourhoods.
PLACES, HOODS = ("city", "town", "village", "hamlet", "isolated_dwelling"), ("suburb", "neighbourhood", "quarter")


def prop(properties: Column, *names: str) -> Column:
    """The first property that is not empty, whatever the case of its name; else empty."""
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(properties), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    return F.coalesce(*[F.nullif(F.element_at(low, n.lower()), F.lit("")) for n in names], F.lit(""))


def title_case(s: Column) -> Column:
    """All-capital names with each run of letters and apostrophes begun by a capital; others as they are."""
    runs = F.regexp_extract_all(F.lower(s), F.lit("([A-Za-zÀ-ÿ']+|[^A-Za-zÀ-ÿ']+)"), F.lit(1))
    begun = F.transform(runs, lambda x: F.when(x.rlike("^[A-Za-zÀ-ÿ']"), F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))).otherwise(x))
    return F.when(s == F.upper(s), F.array_join(begun, "")).otherwise(s)


def level_name(canonical: Column, level: Column) -> Column:
    """What a level's units are called, or ADM<n> unit."""
    c = F.trim(F.coalesce(canonical, F.lit("")))
    named = (c != "") & ~F.lower(c).isin("unknown", "gbopen") & ~F.upper(c).startswith("ADM")
    return F.when(named, c).otherwise(F.concat(F.lit("ADM"), level.cast("string"), F.lit(" unit")))


def default_levels(levels: DataFrame, key: str) -> DataFrame:
    """key, municipal, finer of levels (key, level, canonical): the finest one, or the one above if its units lie within municipalities."""
    name = level_name(F.col("canonical"), F.col("level"))
    by = levels.groupBy(key).agg(F.max_by(name, "level").alias("_name"), F.sort_array(F.collect_set("level"), asc=False).alias("_l"))
    above = F.get(F.filter("_l", lambda x: (x > 0) & (x < F.get("_l", F.lit(0)))), F.lit(0))
    down = above.isNotNull() & F.col("_name").rlike(WITHIN)
    return by.select(key, F.when(down, above).otherwise(F.get("_l", F.lit(0))).alias("municipal"), F.when(down, F.get("_l", F.lit(0))).alias("finer"))


def is_locality(code: Column, name: Column) -> Column:
    """Whether a town's code and name are those of a place that people live in."""
    return (code > 0) & ~code.between(5500, 5599) & (code < 9900) & ~F.lower(name).isin("no name", "") & ~name.rlike("^[0-9]+$")


def _merged(rows: DataFrame, keys: list[str], first: list[str]) -> DataFrame:
    """One row for each key: the first values by ``ord``, and all polygons in that order."""
    some = [F.min_by(c, "ord").alias(c) for c in first]
    polygons = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "polygons"))), lambda p: p["polygons"]))
    return rows.where(F.size("polygons") > 0).groupBy(*keys).agg(*some, polygons.alias("polygons"))


def quarter_units(features: DataFrame, by_statistical_area: list[int]) -> DataFrame:
    """id, name, kind, polygons of features (ord, code, town, sub, quarter, stat, polygons): one unit for each sub-quarter
    of a town; in the towns listed, features without one are units by statistical area, and others are left out."""
    town = F.when(F.trim(F.coalesce("town", F.lit(""))) == "", F.col("code").cast("string")).otherwise(F.initcap(F.trim("town")))
    sub = F.coalesce("sub", F.lit(0)) != 0
    stat = F.col("code").isin(by_statistical_area) & (F.coalesce("stat", F.lit(0)) != 0)
    made = features.where(sub | stat).select(
        "ord", "polygons", "code", F.when(sub, "q").otherwise("s").alias("t"), F.when(sub, F.col("sub")).otherwise(F.col("stat")).alias("n"),
        F.concat(town, F.when(sub, F.lit(", sub-quarter ")).otherwise(F.lit(", statistical area ")), F.when(sub, F.col("sub")).otherwise(F.col("stat")).cast("string")).alias("name"),
        F.when(~sub, "statistical area").when(F.coalesce("quarter", F.lit(0)) != 0, F.concat(F.lit("sub-quarter (quarter "), F.col("quarter").cast("string"), F.lit(")"))).otherwise("sub-quarter").alias("kind"),
    )
    out = _merged(made, ["t", "code", "n"], ["name", "kind"])
    return out.select(F.concat(F.when(F.col("t") == "q", "subq:").otherwise("stat:"), F.col("code").cast("string"), F.lit("-"), F.col("n").cast("string")).alias("id"), "name", "kind", F.lit(NEIGHBOURHOOD).alias("level"), "polygons")


def locality_units(features: DataFrame) -> DataFrame:
    """id, name, polygons of features (ord, code, town, function, polygons): one unit for each locality. Industrial and
    open areas (functions 2 and 4) are left out where it has others."""
    rows = features.where(is_locality(F.col("code"), F.initcap(F.trim(F.coalesce("town", F.lit(""))))) & (F.size("polygons") > 0))
    rows = rows.withColumn("_other", F.coalesce(F.col("function").isin(2, 4), F.lit(False)))
    pieces = lambda other: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("_other") == other, F.struct("ord", "polygons")))), lambda p: p["polygons"]))
    out = rows.groupBy("code").agg(F.initcap(F.trim(F.min_by("town", "ord"))).alias("name"), pieces(False).alias("_lived"), pieces(True).alias("_rest"))
    return out.select(F.concat(F.lit("loc:"), F.col("code").cast("string")).alias("id"), "name", F.lit("locality").alias("kind"), F.lit(LOCALITY + 1).alias("level"), F.when(F.size("_lived") > 0, F.col("_lived")).otherwise(F.col("_rest")).alias("polygons"))


def city_units(features: DataFrame, key: str, name: list[str], ident: list[str], only: dict[str, list[str]] | None = None, titled: bool = False, kind: str = "neighbourhood") -> DataFrame:
    """id, name, polygons of features (ord, properties map, polygons) of a city's service; pieces of one id are one unit.

    Features whose ``only`` fields have other values are left out (a field that a feature lacks filters nothing), as
    are those without a name or polygons. Without an id a feature has its place in the file.
    """
    p = F.col("properties")
    rows = features
    for field, values in (only or {}).items():
        v = prop(p, field)
        rows = rows.where((v == "") | F.lower(F.trim(v)).isin([x.lower() for x in values]))
    label = F.trim(texts.fix_text(prop(p, *name)))
    number = F.coalesce(F.nullif(F.regexp_replace(prop(p, *ident), r"\.0$", ""), F.lit("")), F.col("ord").cast("string"))
    made = rows.select("ord", F.concat(F.lit(f"{key}:"), number).alias("id"), (title_case(label) if titled else label).alias("name"), "polygons").where("name != ''")
    return _merged(made, ["id"], ["name"]).select("id", "name", F.lit(kind).alias("kind"), F.lit(NEIGHBOURHOOD).alias("level"), "polygons")


def tagged_unit(tags: Column) -> Column:
    """kind, level, name and source of an area by its tags; null for those that are none."""
    t = lambda k: F.coalesce(F.element_at(tags, k), F.lit(""))
    name = F.coalesce(*[F.nullif(F.element_at(tags, k), F.lit("")) for k in ("name:en", "int_name", "name")], F.lit(""))
    administrative, level, place = t("boundary") == "administrative", t("admin_level"), t("place")
    regional = t("name").rlike(REGIONAL) | t("name:en").rlike(REGIONAL) | t("official_name").rlike(REGIONAL) | t("official_name:en").rlike(REGIONAL)
    ministry = F.lower(F.concat(t("source"), t("source:boundary"))).contains("interior")
    made = lambda kind, rank, source: F.struct(kind.alias("kind"), F.lit(rank).alias("level"), name.alias("name"), source.alias("source"))
    municipal = F.when(~regional, made(F.lit("municipality"), LOCALITY, F.when(ministry, "official jurisdiction").otherwise("municipal boundary (admin_level 8)")))
    hood = F.when(level.isin("9", "10"), F.concat(F.lit("neighbourhood boundary (admin_level "), level, F.lit(")"))).otherwise(F.concat(F.lit("neighbourhood outline (place="), place, F.lit(")")))
    return (
        F.when(name == "", None)
        .when(administrative & (level == "8"), municipal)
        .when(place.isin(*PLACES), made(F.concat(F.lit("locality ("), place, F.lit(")")), LOCALITY - 1, F.lit("locality outline")))
        .when((administrative & level.isin("9", "10")) | place.isin(*HOODS), made(F.lit("neighbourhood"), NEIGHBOURHOOD, hood))
    )


def as_areas(units: DataFrame, metres: float = 25.0) -> DataFrame:
    """Units (id, polygons of rings of lon, lat pairs, ...) with simplified polygons of flat rings, their box, and radius_km.

    Rings that collapse are dropped, a polygon with its outer ring; units without any polygon left have empty ``polygons``.
    """

    @F.pandas_udf("array<array<array<double>>>")
    def simple(column: pd.Series) -> pd.Series:
        def one(polygons) -> list:
            out = []
            for rings in polygons:
                kept = [kernels.simplify([tuple(p) for p in ring], metres) for ring in rings]
                if kept and kept[0] is not None:
                    out.append([[round(float(v), 5) for p in ring for v in p] for ring in kept if ring is not None])
            return out

        return column.map(one)

    edge = lambda k, f: f(F.transform("polygons", lambda p: f(F.transform(p[0], lambda q: q[k]))))
    box = units.withColumns({"s": F.round(edge(1, F.array_min), 5), "w": F.round(edge(0, F.array_min), 5), "n": F.round(edge(1, F.array_max), 5), "e": F.round(edge(0, F.array_max), 5)})
    radius = F.round(geo.half_diagonal_km(F.col("s"), F.col("w"), F.col("n"), F.col("e")), 2)
    return box.withColumn("radius_km", radius).withColumn("polygons", simple("polygons"))


def written_report(areas: DataFrame, country: str, cap_km: float = 30.0) -> DataFrame:
    """country, areas, over_cap, dropped, duplicates, kinds of areas (country, ord, id, kind, radius_km, polygons).

    Areas without polygons are dropped, and of those that share an id over all countries the first counts.
    """
    left = areas.withColumn("_gone", F.size("polygons") == 0)
    first = relational.first_wins(left.where("not _gone").select(country, "ord", "id", "kind", "radius_km"), ["id"], ["ord"])
    taken = first.groupBy(country).agg(F.count("*").alias("areas"), F.count_if(F.col("radius_km") > cap_km).alias("over_cap"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    total = left.groupBy(country).agg(F.count_if("_gone").alias("dropped"), F.count_if(~F.col("_gone")).alias("_n"))
    out = total.join(taken, country, "left").withColumns({"areas": F.coalesce("areas", F.lit(0)), "over_cap": F.coalesce("over_cap", F.lit(0))})
    return out.select(country, "areas", "over_cap", "dropped", (F.col("_n") - F.col("areas")).alias("duplicates"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))


def near_or_inside(points: DataFrame, readings: DataFrame, key: str, radius_km: float) -> DataFrame:
    """Pairs of points (key, lat, lon, and polygons of an area or null) and readings (reading, rlat, rlon) that lie within
    some distance on a flat map, or in the area. Readings go to cells of the radius, and of the areas' boxes."""
    size = radius_km / geo.KM_PER_DEGREE
    step = max(size, 0.05)
    lon_reach = F.lit(size) / F.greatest(F.cos(F.radians("lat")), F.lit(0.02))
    spread = lambda lo, hi: F.sequence(F.floor(lo / step), F.floor(hi / step))
    edge = lambda k, f: f(F.transform("polygons", lambda p: f(F.filter(p[0], lambda v, i: i % 2 == k))))
    s, n = F.least(F.col("lat") - size, edge(1, F.array_min)), F.greatest(F.col("lat") + size, edge(1, F.array_max))
    w, e = F.least(F.col("lon") - lon_reach, edge(0, F.array_min)), F.greatest(F.col("lon") + lon_reach, edge(0, F.array_max))
    cells = points.withColumn("_i", F.explode(spread(s, n))).withColumn("_j", F.explode(spread(w, e)))
    at = readings.withColumns({"_i": F.floor(F.col("rlat") / step), "_j": F.floor(F.col("rlon") / step)})
    dy, dx = (F.col("rlat") - F.col("lat")) * geo.KM_PER_DEGREE, (F.col("rlon") - F.col("lon")) * geo.KM_PER_DEGREE * F.cos(F.radians("lat"))
    inside = F.coalesce(F.exists("polygons", lambda rings: geo.polygon_contains(F.col("rlon"), F.col("rlat"), rings)), F.lit(False))
    return cells.join(at, ["_i", "_j"]).where((F.hypot(dx, dy) <= radius_km) | inside).drop("_i", "_j")
