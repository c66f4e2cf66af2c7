"""Requests and answers: rules asked for, areas found, names, checks of bodies, joined answers; states of built tiles; smoothed ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almucantar.operators import kernels

#: Spellings of the area rules.
CITY, FINEST, NO_AREA = ["auto", "city", "1", "true"], ["finest"], ["", "0", "false"]
#: The note of a request without an area.
NO_AREA_NOTE = "no official area here; used the request as given"
#: Names of the two sources that make a tile a marker.
SEA, FALLBACK = "sea (no data)", "skadi (fallback)"


def area_rule(asked: Column) -> Column:
    """city, finest, or null if no area is asked for; any other spelling raises."""
    wrong = F.raise_error(F.lit("area must be auto, city or finest"))
    return F.when(asked.isNull() | asked.isin(NO_AREA), None).when(asked.isin(CITY), "city").when(asked.isin(FINEST), "finest").otherwise(wrong.cast("string"))


def resolved(requests: DataFrame, found: DataFrame, key: str, cap_km: float) -> DataFrame:
    """Requests with the area that was found (key, id, name, radius_km; one for a key) or, without one that is small enough, a note.

    Adds area, area_note and as_given: whether the request runs as it is.
    """
    hit = found.select(F.col(key), F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("radius_km").alias("_radius"))
    short = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    over = F.col("_radius") > cap_km
    note = F.concat("_name", F.lit(" is "), short(F.col("_radius")), F.lit(" km from centre to corner, over terrain.max_area_radius_km ("), short(F.lit(float(cap_km))), F.lit("); used the request as given"))
    out = requests.join(hit, key, "left")
    return out.withColumns({
        "area": F.when(~over, F.col("_id")),
        "area_note": F.when(F.col("_id").isNull(), NO_AREA_NOTE).when(over, note),
        "as_given": F.col("_id").isNull() | over,
    }).drop("_id", "_name", "_radius")


def outline(polygons: Column, wanted: Column) -> Column:
    """An area's polygons if its outline is wanted, else null."""
    return F.when(wanted, polygons)


def flat_ring(ring: Column, digits: int = 5) -> Column:
    """A ring of points as one array of rounded numbers."""
    return F.flatten(F.transform(ring, lambda p: F.transform(p, lambda v: F.round(v, digits))))


def chunk_name(i: Column, j: Column) -> Column:
    """The name of a fine chunk by the numbers of its south-west corner."""
    return F.format_string("%s%04d%s%04d", F.when(i >= 0, "n").otherwise("s"), F.abs(i), F.when(j >= 0, "e").otherwise("w"), F.abs(j))


def progress(done: Column, total: Column, width: int = 20) -> Column:
    """A bar of progress with its counts."""
    n = F.bround(done * float(width) / F.greatest(total, F.lit(1))).cast("int")
    bar = F.concat(F.expr(f"repeat('#', {width * 8})").substr(F.lit(1), n), F.expr(f"repeat('.', {width * 8})").substr(F.lit(1), F.lit(width) - n))
    return F.concat(F.lit("["), bar, F.lit("] "), done.cast("string"), F.lit("/"), total.cast("string"))


def first_field(columns: list[str], candidates: list[str], what: str) -> str:
    """The first of the candidates that is a column, in any case of letters; a clear error if none is."""
    have = {c.lower(): c for c in columns}
    for c in candidates:
        if c.lower() in have:
            return have[c.lower()]
    raise ValueError(f"no column for {what}: looked for {candidates}, the data has {sorted(columns)}")


def whole_json(body: Column) -> Column:
    """Whether a body begins and ends as a JSON object does."""
    return F.coalesce(body.rlike(r"(?s)^\s*\{.*\}\s*$"), F.lit(False))


def features_error(body: Column) -> Column:
    """What is wrong with a body that should hold features (an error that came as an answer); null if nothing is."""
    keys = F.json_object_keys(body)
    bad = keys.isNull() | F.array_contains(keys, "error") | ~F.array_contains(keys, "features")
    return F.when(bad, F.substring(F.coalesce(F.get_json_object(body, "$.error"), body, F.lit("")), 1, 300))


def with_places(units: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Units (key, name) whose names end with that of the place (key, place) they are in, where it is known."""
    known = places.where(F.col("place") != "").groupBy(key).agg(F.max("place").alias("_place"))
    return units.join(known, key, "left").withColumn("name", F.when(F.col("_place").isNotNull(), F.concat("name", F.lit(", "), "_place")).otherwise(F.col("name"))).drop("_place")


def with_near(main: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """key, field, value of the main store, with those of the near-surface store put in or added where the key has any main ones."""
    extra = near.join(main.select(key).distinct(), key, "left_semi").select(key, "field", F.col("value").alias("_near"), F.lit(True).alias("_there"))
    out = main.select(key, "field", "value").join(extra, [key, "field"], "full")
    return out.select(key, "field", F.when(F.col("_there"), F.col("_near")).otherwise(F.col("value")).alias("value"))


def with_extra(body: Column, extra: Column) -> Column:
    """A JSON object with another one's fields added at its end, without parsing either; anything but objects raises."""
    b, e = F.trim(body), F.trim(extra)
    glue = F.when((b == "{}") | (e == "{}"), "").otherwise(",")
    spliced = F.concat(F.substring(b, F.lit(1), F.length(b) - 1), glue, F.substring(e, F.lit(2), F.length(e)))
    return F.when(F.endswith(b, F.lit("}")) & F.startswith(e, F.lit("{")), spliced).otherwise(F.raise_error(F.lit("not a JSON object")).cast("string"))


def below(value: Column, most: float, nodata: float | None = None) -> Column:
    """A height before it is resampled: null if it is not finite, clipped at ``most`` or the source's mark of no data."""
    bad = F.isnan(value) | (F.abs(value) == float("inf")) | (value >= most)
    return F.when(~(bad if nodata is None else bad | (value == nodata)), value)


def tile_states(cells: DataFrame, tile: str) -> DataFrame:
    """tile, state, fractions of tiles by how many of their cells (tile, source, n) came from each source.

    A tile all of which is open sea or the plain tile's is only a marker, ``sea`` or ``plain``; others are ``built``.
    """
    by = cells.groupBy(tile, "source").agg(F.sum("n").alias("_n")).where("_n > 0")
    total = by.groupBy(tile).agg(F.sum("_n").alias("_all"), F.min("source").alias("_a"), F.max("source").alias("_b"), F.collect_list(F.struct("source", "_n")).alias("_parts"))
    only = lambda s: (F.col("_a") == s) & (F.col("_b") == s)
    state = F.when(only(SEA), "sea").when(only(FALLBACK), "plain").otherwise("built")
    parts = F.map_from_entries(F.transform(F.array_sort("_parts"), lambda p: F.struct(p["source"], F.round(p["_n"] / F.col("_all"), 4))))
    return total.select(tile, state.alias("state"), parts.alias("fractions"))


def revised(made: DataFrame, before: DataFrame, tile: str) -> DataFrame:
    """Tiles as made (tile, state, digest of the heights) with their revision, one more than before (with rev) if heights changed."""
    old = before.select(tile, F.col("state").alias("_state"), F.col("digest").alias("_digest"), F.col("rev").alias("_rev"))
    other = ~F.col("digest").eqNullSafe(F.col("_digest"))
    changed = (
        F.when(F.col("_state").isNull(), False)
        .when(F.col("state") == "sea", F.col("_state") != "sea")
        .when(F.col("state") == "plain", (F.col("_state") == "sea") | ((F.col("_state") == "built") & other))
        .otherwise((F.col("_state") != "built") | other)
    )
    return made.join(old, tile, "left").withColumn("rev", F.coalesce("_rev", F.lit(0)) + changed.cast("int")).drop("_state", "_digest", "_rev")


def slimmed(tiles: DataFrame) -> DataFrame:
    """Built tiles (state, fractions, provisional) whose heights all are the plain tile's become markers; their revision stays."""
    copies = (F.col("state") == "built") & ~F.coalesce("provisional", F.lit(False)) & F.map_keys("fractions").eqNullSafe(F.array(F.lit(FALLBACK)))
    return tiles.withColumn("state", F.when(copies, "plain").otherwise(F.col("state")))


def best_tile(wanted: DataFrame, own: DataFrame, stand_in: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles from our own data, else those that stand in for them, which are not final."""
    a = own.select(*keys, F.col("body").alias("_own"))
    b = stand_in.select(*keys, F.col("body").alias("_other"))
    out = wanted.select(*keys).join(a, keys, "left").join(b, keys, "left")
    return out.select(*keys, F.coalesce("_own", "_other").alias("body"), F.col("_own").isNotNull().alias("final"))


def smoothed_ground(heights: Column, step_km: float, sigma_km: float) -> Column:
    """Heights along a ray (one array, a sample each ``step_km``) as the local quadratic fits at each sample.

    Samples count by a Gaussian of their distance; the fit's value is the solution of its three normal equations.
    """
    whole = F.when(F.exists(heights, lambda h: h.isNull()), F.transform(heights, lambda _: F.lit(None).cast("double"))).otherwise(kernels.quadratic_fits(heights, step_km, sigma_km))
    return F.when(F.size(heights) >= 3, whole).otherwise(heights)


def widened(steps: DataFrame, keys: list[str], clear: float, step: float, pad: float, most: float) -> DataFrame:
    """keys, by: how far an edge moves out while the ground hides the Sun on its way (steps k from 1, altitude, horizon).

    Steps follow one another until one is clear, has no altitude (the path ends) or is further than ``most``.
    """
    hidden = F.col("altitude").isNotNull() & (F.col("k") * step <= most) & (F.col("horizon") >= F.col("altitude") - clear)
    ends = steps.groupBy(*keys).agg(F.min(F.when(~F.coalesce(hidden, F.lit(False)), F.col("k"))).alias("_stop"), F.max("k").alias("_far"))
    last = F.coalesce(F.col("_stop") - 1, F.col("_far"))
    return ends.select(*keys, F.when(last > 0, last * step + pad).otherwise(F.lit(0.0)).alias("by"))
