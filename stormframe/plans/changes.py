"""What changed since the previous product, as it is shown: what is drawn at the old places, its notes, and counts.

Rows are pairs of ``product_diff``: ``change`` is paired, added or removed, and the
columns of the previous product begin with ``previous_``. ``old`` is its stated
time. Something without an old place draws nothing; it counts as gone if it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.scalars import round_half_up

# The wording of notes, and the tags of areas that draw the eye.
WAS, GONE, NO_TIME, UNKNOWN, UP, DOWN = "was here · ", "gone from this issuance · ", "previous issuance", "n/a", " ▲", " ▼"
ACTIVE = r"^AL9[0-9]\z"


def _direction(before: Column, now: Column) -> Column:
    return F.when(now > before, F.lit(UP)).otherwise(F.lit(DOWN))


def odds_change(before: Column, now: Column) -> Column:
    """``40%→60% ▲``; one value where they agree; no direction where one is unknown."""
    a, b = (F.coalesce(F.concat(c.cast("string"), F.lit("%")), F.lit(UNKNOWN)) for c in (before, now))
    way = F.when(before.isNotNull() & now.isNotNull(), _direction(before, now)).otherwise(F.lit(""))
    return F.when(a == b, b).otherwise(F.concat(a, F.lit("→"), b, way))


def wind_change(before: Column, now: Column) -> Column:
    """`` · 40→55 kt ▲``; nothing where a wind is unknown or they agree."""
    told = F.concat(F.lit(" · "), before.cast("string"), F.lit("→"), now.cast("string"), F.lit(" kt"), _direction(before, now))
    return F.when(before != now, told).otherwise(F.lit(""))


def axis_shift(before: Column, now: Column) -> Column:
    """Whole degrees between the mean longitudes of two axes."""
    mean = lambda axis: F.aggregate(axis, F.lit(0.0), lambda s, p: s + p["lon"]) / F.size(axis)
    return round_half_up(F.abs(mean(now) - mean(before))).cast("int")


def _shown(pairs: DataFrame, old: Column, moved: Column, drawn: Column, told: Column) -> DataFrame:
    """``moved``, ``drawn`` and ``note`` of each pair; ``told`` is the note of a drawn pair."""
    paired, removed = F.col("change") == "paired", F.col("change") == "removed"
    note = F.when(~drawn, None).when(paired, told).when(removed, F.concat(F.lit(GONE), old))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return pairs.withColumns({"moved": flag(paired & moved), "drawn": flag((paired | removed) & drawn), "note": note})


def _old(old: str) -> Column:
    return F.coalesce(F.col(old), F.lit(NO_TIME))


def area_changes(pairs: DataFrame, old: str = "old") -> DataFrame:
    """Areas of outlooks: moved is what has both places and they differ; the odds' changes are told either way."""
    had, has = F.col("previous_lat").isNotNull(), F.col("lat").isNotNull()
    moved = had & has & ~(F.col("previous_lat").eqNullSafe(F.col("lat")) & F.col("previous_lon").eqNullSafe(F.col("lon")))
    odds = F.concat(F.lit(" · 48h "), odds_change(F.col("previous_chance48"), F.col("chance48")), F.lit(" · 7d "), odds_change(F.col("previous_chance7"), F.col("chance7")))
    return _shown(pairs, _old(old), moved, had, F.concat(F.when(moved, F.lit(WAS)).otherwise(F.lit("")), _old(old), odds))


def cyclone_changes(pairs: DataFrame, old: str = "old") -> DataFrame:
    """Cyclones: every pair moved; a change of wind is told."""
    told = F.concat(F.lit(WAS), _old(old), wind_change(F.col("previous_wind_kt"), F.col("wind_kt")))
    return _shown(pairs, _old(old), F.lit(True), F.col("previous_lat").isNotNull(), told)


def wave_changes(pairs: DataFrame, old: str = "old") -> DataFrame:
    """Waves: every pair moved; a shift of the axis that rounds to a degree or more is told."""
    shift = axis_shift(F.col("previous_axis"), F.col("axis"))
    told = F.concat(F.lit(WAS), _old(old), F.when(shift > 0, F.concat(F.lit(" · moved ~"), shift.cast("string"), F.lit("°"))).otherwise(F.lit("")))
    return _shown(pairs, _old(old), F.lit(True), F.size("previous_axis") > 0, told)


def change_totals(shown: DataFrame, keys: list[str], old: str = "old") -> DataFrame:
    """How many moved, came and went between two products, and the line that says so; ``keys`` name the pair of products."""
    count = lambda c: F.count_if(F.col("change") == c)
    totals = shown.groupBy(*keys).agg(F.max(old).alias("_old"), F.count_if("moved").alias("moved"), count("added").alias("new"), count("removed").alias("gone"))
    part = lambda c: F.concat(F.col(c).cast("string"), F.lit(f" {c}"))
    line = F.concat(F.lit("Δ vs "), _old("_old"), F.lit(": "), F.concat_ws(" · ", part("moved"), part("new"), part("gone")))
    return totals.withColumn("line", line).drop("_old")


def active_points(cyclones: DataFrame, areas: DataFrame) -> DataFrame:
    """``file, lat, lon`` of what a view opens on: cyclones with a place, and placed areas with a tag of the Atlantic's invests."""
    spot = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    tagged = F.col("lat").isNotNull() & F.coalesce(F.col("invest").rlike(ACTIVE), F.lit(False))
    return cyclones.filter(spot).select("file", "lat", "lon").unionByName(areas.filter(tagged).select("file", "lat", "lon"))
