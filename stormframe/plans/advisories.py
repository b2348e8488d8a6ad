"""Forecast advisories to rows: header, center, winds, radii and the forecast track with its cone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.geometry import forecast_cone
from stormframe.functions.scalars import forecast_hours, signed_degrees
from stormframe.functions.text import bind, found, motion, paragraphs, rejoin_wraps, title_case
from stormframe.session import once

# The lines of an advisory.
KINDS = "HURRICANE|TROPICAL STORM|TROPICAL DEPRESSION|SUBTROPICAL STORM|SUBTROPICAL DEPRESSION|POTENTIAL TROPICAL CYCLONE|POST-TROPICAL CYCLONE|REMNANTS OF"
HEAD = rf"(?i)\b({KINDS})\s+([A-Z][A-Z-]+)\s+(?:SPECIAL\s+)?FORECAST/ADVISORY\s+NUMBER\s+(\d+)"
PLACE = r"(\d{1,2}(?:\.\d)?)\s*([NS])\s+(\d{1,3}(?:\.\d)?)\s*([EW])"
CENTER = rf"(?i)CENTER LOCATED NEAR\s+{PLACE}\s+AT\s+(\d{{2}})/(\d{{2}})(\d{{2}})Z"
STORM = r"\b((?:AL|EP|CP)\d{6})\b"
WINDS = r"(?i)MAX SUSTAINED WINDS\s+(\d{1,3})\s*KT(?:\s+WITH\s+GUSTS\s+TO\s+(\d{1,3})\s*KT)?"
PRESSURE = r"(?i)MINIMUM CENTRAL PRESSURE\s+(\d{3,4})\s*MB"
RADII = r"(?i)(\d{2})\s*KT\.+\s*(\d{1,3})NE\s+(\d{1,3})SE\s+(\d{1,3})SW\s+(\d{1,3})NW"
AHEAD = rf"(?i)^\s*(FORECAST|OUTLOOK)\s+VALID\s+(\d{{2}})/(\d{{2}})(\d{{2}})Z\s+{PLACE}"
PEAK = r"(?i)MAX WIND\s+(\d{1,3})\s*KT"
ISSUED = r"\b(\d{3,4}\s+UTC\s+[A-Za-z]{3}\s+[A-Za-z]{3}\s+\d{1,2}\s+\d{4})\b"
QUADRANTS = ("ne", "se", "sw", "nw")


def _place(text: Column, pattern: str, first: int) -> tuple[Column, Column]:
    part = lambda k: found(text, pattern, first + k)
    return signed_degrees(part(0).cast("double"), F.upper(part(1))), signed_degrees(part(2).cast("double"), F.upper(part(3)))


def _clock(text: Column, pattern: str, first: int) -> Column:
    day, hour, minute = (found(text, pattern, first + k) for k in range(3))
    return F.concat(day, F.lit("/"), hour, minute, F.lit("Z"))


def wind_radii(text: Column) -> Column:
    """Knots to quadrant radii of the current position: what stands before the first forecast, the last line of a
    speed; a line of zeros says nothing."""
    now = F.get(F.split(text, "(?i)FORECAST VALID"), F.lit(0))
    lines = F.arrays_zip(*(F.regexp_extract_all(now, F.lit(RADII), F.lit(k)).alias(n) for k, n in enumerate(("kt", *QUADRANTS), 1)))
    lines = F.filter(lines, lambda x: F.greatest(*(x[q].cast("int") for q in QUADRANTS)) > 0)

    def by_knots(lines: Column) -> Column:
        last = bind(F.reverse(F.transform(lines, lambda x: x["kt"])), lambda knots: F.filter(lines, lambda x, i: F.array_position(knots, x["kt"]) == F.size(lines) - i))
        entries = F.transform(last, lambda x: F.struct(x["kt"].cast("int"), F.struct(*(x[q].cast("int").alias(q) for q in QUADRANTS))))
        return F.when(F.size(lines) > 0, F.map_from_entries(entries))

    return bind(lines, by_knots)


def forecast_track(text: Column, day: Column, hour: Column) -> Column:
    """The positions ahead, by paragraph; one without a position or with a time that does not follow is left out."""

    def point(chunk: Column) -> Column:
        lat, lon = _place(chunk, AHEAD, 5)
        state = F.when(chunk.rlike("(?i)DISSIPAT"), "dissipated").when(chunk.rlike("(?i)POST-TROP"), "post-tropical")
        return F.struct(
            F.upper(found(chunk, AHEAD)).alias("kind"),
            bind(F.struct(found(chunk, AHEAD, 2).cast("int").alias("d"), found(chunk, AHEAD, 3).cast("int").alias("h")), lambda x: forecast_hours(day, hour, x["d"], x["h"])).alias("hours"),
            _clock(chunk, AHEAD, 2).alias("valid_z"),
            lat.alias("lat"),
            lon.alias("lon"),
            found(chunk, PEAK).cast("int").alias("wind_kt"),
            state.alias("state"),
        )

    return F.filter(F.transform(paragraphs(text), point), lambda p: p["kind"].isNotNull() & p["hours"].isNotNull())


def advisories(products: DataFrame) -> DataFrame:
    """One row per ``file, text`` that has a header and a center; what is not stated is null."""
    cut = once(products, t=rejoin_wraps(F.regexp_replace("text", "\r\n?", "\n"))).select("file", "t")
    text = F.col("t")
    cut = cut.filter(text.rlike(HEAD) & text.rlike(CENTER))
    lat, lon = _place(text, CENTER, 1)
    cut = once(cut, day=found(text, CENTER, 5).cast("int"), hour=found(text, CENTER, 6).cast("int"))
    cut = once(cut, radii=wind_radii(text), track=forecast_track(text, F.col("day"), F.col("hour")), motion=motion(text))
    return cut.select(
        "file",
        found(text, STORM).alias("storm_id"),
        title_case(found(text, HEAD, 2)).alias("name"),
        title_case(found(text, HEAD)).alias("classification"),
        found(text, HEAD, 3).cast("int").alias("advisory"),
        F.struct(lat.alias("lat"), lon.alias("lon")).alias("center"),
        _clock(text, CENTER, 5).alias("issued"),
        found(text, ISSUED).alias("issued_header"),
        found(text, WINDS).cast("int").alias("wind_kt"),
        found(text, WINDS, 2).cast("int").alias("gust_kt"),
        found(text, PRESSURE).cast("int").alias("pressure_mb"),
        F.col("radii").alias("wind_radii"),
        "motion",
        "track",
    )


def with_cone(rows: DataFrame) -> DataFrame:
    """Add ``cone``, the ring around center and track; null without a track."""
    start = F.array(F.struct(F.col("center.lat").alias("lat"), F.col("center.lon").alias("lon"), F.lit(0).alias("hours")))
    ahead = F.transform("track", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"), p["hours"].alias("hours")))
    path = rows.withColumn("path", F.concat(start, ahead))
    return path.withColumn("cone", forecast_cone(F.col("path"), F.substring("storm_id", 1, 2))).drop("path")
