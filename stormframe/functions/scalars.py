"""Scalar rules on stamps, degrees, names and odds, as Columns. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forecast-cone radii in nautical miles by forecast hour.
CONE_NM = {
    "AL": [(0, 10), (12, 25), (24, 39), (36, 49), (48, 62), (60, 77), (72, 95), (96, 134), (120, 200)],
    "EP": [(0, 10), (12, 25), (24, 37), (36, 48), (48, 56), (60, 66), (72, 78), (96, 106), (120, 138)],
}


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half goes towards plus infinity, unlike Spark's round."""
    k = F.lit(float(10**digits))
    return F.floor(x * k + 0.5) / k


def signed_degrees(value: Column, hemisphere: Column) -> Column:
    return value * F.when(F.upper(hemisphere).isin("S", "W"), -1).otherwise(1)


def tenths_to_degrees(token: Column) -> Column:
    """``"255N"`` is 25.5; anything else is unknown."""
    value = F.regexp_extract(token, r"^(\d+)([NSEW])$", 1)
    return F.when(value != "", signed_degrees(value.try_cast("double") / 10, F.regexp_extract(token, r"([NSEW])$", 1)))


def stamp_time(stamp: Column) -> Column:
    """A 12-digit stamp as a time; an impossible date is null."""
    return F.when(stamp.rlike(r"^\d{12}$"), F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmm")))


def time_stamp(time: Column) -> Column:
    return F.date_format(time, "yyyyMMddHHmm")


def hours_between(start: Column, end: Column) -> Column:
    """Hours from one time to another."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(3.6e9)


def plus_hours(time: Column, hours: int) -> Column:
    return time + F.expr(f"INTERVAL '{hours}' HOUR")


def pad_dtg(dtg: Column) -> Column:
    return F.when(F.length(dtg) == 10, F.concat(dtg, F.lit("00"))).otherwise(dtg)


def storm_name(name: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "-[EC]$", "")


def cone_radius(hours: Column, basin: Column) -> Column:
    """Nautical miles at a forecast hour: linear between the table's rows, held at its ends; Central Pacific as Eastern."""

    def along(table: list[tuple[int, int]]) -> Column:
        out = F.lit(float(table[-1][1]))
        for (h0, r0), (h1, r1) in reversed(list(zip(table, table[1:], strict=False))):
            out = F.when(hours <= h1, F.lit(float(r0)) + (r1 - r0) * (hours - h0) / float(h1 - h0)).otherwise(out)
        return F.when(hours <= table[0][0], F.lit(float(table[0][1]))).otherwise(out)

    return F.when(basin.isin("EP", "CP"), along(CONE_NM["EP"])).otherwise(along(CONE_NM["AL"]))


def forecast_hours(day: Column, hour: Column, to_day: Column, to_hour: Column) -> Column:
    """Hours between two day/hour stamps without month: the first month length that gives 0 to 6 days."""
    ahead = to_day - day
    days = F.coalesce(F.when(ahead >= 0, ahead), *(F.when((ahead + n).between(0, 6), ahead + n) for n in (31, 30, 29, 28)))
    hours = days * 24 + to_hour - hour
    return F.when(hours >= 0, hours)


def odds_delta(current: Column, previous: Column) -> Column:
    """``+20``, ``-10``, ``0``; null where either is unknown."""
    d = current - previous
    return F.concat(F.when(d > 0, "+").otherwise(""), d.cast("string"))


def area_key(tag: Column, lat: Column, lon: Column, source: Column) -> Column:
    """An area's key for alerts: its tag, else its 5-degree cell, else the start of its text."""
    cell = lambda x: (F.floor(x / 5 + 0.5) * 5).cast("int").cast("string")
    return F.coalesce(tag, F.concat(F.lit("G"), cell(lat), F.lit(","), cell(lon)), F.concat(F.lit("S"), F.substring(F.coalesce(source, F.lit("")), 1, 40)))


def is_stale(issued: Column, now: Column, hours: float = 7) -> Column:
    """Older than so many hours; an unknown time is stale."""
    return F.coalesce(hours_between(issued, now) > hours, F.lit(True))


def mean_longitude(axis: Column) -> Column:
    return F.aggregate(axis, F.lit(0.0), lambda a, p: a + p["lon"]) / F.size(axis)


def overlaps(low: Column, high: Column, first: Column, last: Column, before: int, after: int) -> Column:
    """Whether [low, high] meets [first - before, last + after] hours; unknown ends do not meet."""
    return F.coalesce((low <= plus_hours(last, after)) & (high >= plus_hours(first, -before)), F.lit(False))


def header_time(stamp: Column, now: Column) -> Column:
    """The time of a ``DDHHMM`` header: this month's, else the month before's; not more than six hours ahead of now."""
    good = stamp.rlike(r"^\d{6}$")
    day, hour, minute = (F.substring(stamp, k, 2).try_cast("int") for k in (1, 3, 5))
    first = F.date_trunc("month", now)

    def in_month(back: int) -> Column:
        start = F.add_months(first, -back).cast("timestamp")
        t = F.timestamp_micros(F.unix_micros(start) + ((day - 1) * 86400 + hour * 3600 + minute * 60).cast("long") * 1_000_000)
        return F.when((F.dayofmonth(t) == day) & (F.unix_micros(t) <= F.unix_micros(now) + 6 * 3_600_000_000), t)

    return F.when(good & day.between(1, 31) & (hour <= 23) & (minute <= 59), F.coalesce(in_month(0), in_month(1)))


def relative_age(at: Column, now: Column) -> Column:
    """``just now``, ``12m ago``, ``3h ago``, ``2d ago``; nothing for a time that lies over two minutes ahead."""
    minutes = F.floor((F.unix_micros(now) - F.unix_micros(at)) / 6e7 + 0.5).cast("long")
    hours = F.floor(minutes / 60 + 0.5).cast("long")
    days = F.floor(hours / 24 + 0.5).cast("long")
    told = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return F.when(minutes < -2, "").when(minutes < 1, "just now").when(minutes < 60, told(minutes, "m")).when(hours < 48, told(hours, "h")).otherwise(told(days, "d"))


def next_synoptic(now: Column) -> Column:
    """``hour, minutes``: the next of 00, 06, 12 and 18 UTC, and the minutes until then."""
    seconds = F.unix_seconds(now.cast("timestamp"))
    slot = (F.floor(seconds / 21600) + 1) * 21600
    minutes = F.floor((slot - seconds) / 60 + 0.5).cast("int")
    return F.struct(F.pmod(F.floor(slot / 3600), F.lit(24)).cast("int").alias("hour"), minutes.alias("minutes"))


def invest_tag(file_id: Column, season: Column) -> Column:
    """``AL90`` of ``al902026``: an invest of that season in the Atlantic or the eastern Pacific, else null."""
    p = r"^(al|ep)(9\d)(\d{4})$"
    low = F.lower(file_id)
    return F.when(low.rlike(p) & (F.regexp_extract(low, p, 3) == season.cast("string")), F.concat(F.upper(F.regexp_extract(low, p, 1)), F.regexp_extract(low, p, 2)))


def snapshot_name(name: Column, stamp: Column) -> Column:
    """``bal012026.dat`` with its content's stamp put before the ending."""
    return F.regexp_replace(name, r"\.dat$", F.concat(F.lit("."), stamp, F.lit(".dat")))


def chart_time(time: Column) -> Column:
    """``Jul 7 06:30Z``."""
    return F.date_format(time, "MMM d HH:mm'Z'")


def axis_middle(axis: Column, mean_lon: Column) -> Column:
    """The middle of an axis' first and last point; without an axis, its mean longitude at 12 N."""
    a, b = F.element_at(axis, 1), F.element_at(axis, -1)
    of = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    return F.when(F.size(axis) > 0, of((a["lat"] + b["lat"]) / 2, (a["lon"] + b["lon"]) / 2)).when(mean_lon.isNotNull(), of(F.lit(12.0), mean_lon))


def odds_tier(pct: Column) -> Column:
    """Low under 40, medium under 60, else high."""
    return F.when(pct < 40, "low").when(pct < 60, "medium").when(pct.isNotNull(), "high")


def wind_tier(knots: Column) -> Column:
    """Depression under 34, storm under 64, of which the stronger from 50, else hurricane."""
    return F.when(knots < 34, "depression").when(knots < 50, "storm").when(knots < 64, "strong storm").when(knots.isNotNull(), "hurricane")


#: Fixed values: (south, north, west, east) that positions of a basin's discussions and outlooks, and of its forecast tracks, lie in.
SANE = {"AT": (-8, 45, -105, 5), "EP": (-5, 35, -145, -70)}
SANE_TRACK = {"AT": (-8, 65, -105, 10), "EP": (0, 50, -180, -80)}


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lon.between(west, east)


def sane(lat: Column, lon: Column, basin: Column, boxes: dict = SANE) -> Column:
    """Whether a position lies where its basin's products may place it."""
    return F.when(basin == "EP", in_box(lat, lon, boxes["EP"])).otherwise(in_box(lat, lon, boxes["AT"]))
