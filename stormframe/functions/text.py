"""Teletype text: wraps, paragraphs, coordinates, motions, odds, issuance lines."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Degrees of the compass points, and minutes from each zone to UTC.
COMPASS = {
    "n": 0.0, "nne": 22.5, "ne": 45.0, "ene": 67.5, "e": 90.0, "ese": 112.5, "se": 135.0, "sse": 157.5,
    "s": 180.0, "ssw": 202.5, "sw": 225.0, "wsw": 247.5, "w": 270.0, "wnw": 292.5, "nw": 315.0, "nnw": 337.5,
}
ZONES = {
    "UTC": 0, "GMT": 0, "Z": 0, "AST": 240, "ADT": 180, "EST": 300, "EDT": 240, "CST": 360, "CDT": 300,
    "MST": 420, "MDT": 360, "PST": 480, "PDT": 420, "HST": 600,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MPH_TO_KT = 0.868976
# A position, a single coordinate, and the pieces of a position. Hemispheres are capitals in free text.
LAT, LON = r"(\d{1,2}(?:\.\d)?)\s*([NS])", r"(\d{1,3}(?:\.\d)?)\s*([EW])"
PAIR = LAT + r"\s*" + LON
COORDINATE = r"\b\d{1,3}(?:\.\d)?\s*[NSEW]\b"


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def lookup_or_null(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def bind(value: Column, then) -> Column:
    """Name a value: ``then`` may use it many times, and it is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return bind(F.regexp_extract(text, pattern, group), lambda got: F.when(got != "", got))


def rejoin_wraps(text: Column) -> Column:
    """Put together words that a line break parted after a hyphen, and blank lines after it; the hyphen stays."""
    return F.regexp_replace(text, r"-\n\s*", "-")


def paragraphs(text: Column) -> Column:
    return F.split(text, r"\n\s*\n")


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.])\s+")


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unwrap_pre(html: Column) -> Column:
    """The text of the first pre element, or of the whole, without tags and entities; the ampersand comes last."""
    body = F.coalesce(found(html, r"(?is)<pre[^>]*>(.*?)</pre>"), html)
    body = F.regexp_replace(body, "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return body


def coordinate_pairs(text: Column) -> Column:
    """All ``12.5N 61W`` and ``14N76W`` of a text as points; west and south are negative."""
    groups = [F.regexp_extract_all(text, F.lit(PAIR), k) for k in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("a", "b", "c", "d"), strict=True)))
    sign = lambda v, h, minus: F.when(h == minus, -v.cast("double")).otherwise(v.cast("double"))
    return F.transform(zipped, lambda z: F.struct(sign(z["a"], z["b"], "S").alias("lat"), sign(z["c"], z["d"], "W").alias("lon")))


def compass_degrees(word: Column) -> Column:
    """Degrees of ``west-northwestward``, ``wnw`` or ``west``; null for other words."""

    def degrees(bare: Column) -> Column:
        letters = F.regexp_replace(bare, "[- ]", "")
        for name in ("north", "south", "east", "west"):
            letters = F.replace(letters, F.lit(name), F.lit(name[0]))
        spelled = bare.rlike(r"^((north|south)?(east|west)?[- ]?)+$") | bare.rlike("^[nsew]{1,3}$")
        return F.when(spelled, F.try_element_at(F.create_map(*(F.lit(x) for kv in COMPASS.items() for x in kv)), letters))

    return bind(F.regexp_replace(F.trim(F.lower(word)), "ward$", ""), degrees)


# How a speed and a course are worded.
_SPEED = r"(\d{1,2})\s*(?:to\s*(\d{1,2}))?\s*(kt|knots|mph)\b"
_TOWARD = r"(?:moving|movement(?:\s+is)?|drifting)\s+(?:toward(?:s)?(?: the)?\s+|to the\s+)?((?:north|south|east|west)(?:[- ]?(?:north|south|east|west))*(?:ward)?|[nsew]{1,3})\b"


def motion(text: Column) -> Column:
    """``bearing, slow_kt, fast_kt, stationary, unit``; null where nothing is stated."""
    kind = "struct<bearing:double,slow_kt:int,fast_kt:int,stationary:boolean,unit:string>"

    def told(bearing, low, high, still: bool, in_unit) -> Column:
        return F.struct(bearing.alias("bearing"), low.alias("slow_kt"), high.alias("fast_kt"), F.lit(still).alias("stationary"), in_unit.alias("unit")).cast(kind)

    def words(t: Column) -> Column:
        return F.struct(
            t.rlike(r"\b(?:nearly\s+)?stationary\b|\blittle (?:overall )?movement\b").alias("still"), t.rlike(r"\bdrifting\b").alias("drifts"),
            found(t, _SPEED).cast("int").alias("slow"), found(t, _SPEED, 2).cast("int").alias("fast"), found(t, _SPEED, 3).alias("unit"),
            (found(t, r"(\d{1,3})\s*degrees[,\s]*at\s*\d").cast("double") % 360).alias("degrees"), compass_degrees(found(t, _TOWARD)).alias("toward"),
        )

    def stated(x: Column) -> Column:
        slow, unit, degrees, toward = x["slow"], x["unit"], x["degrees"], x["toward"]
        fast, none, in_mph = F.coalesce(x["fast"], slow), F.lit(None).cast("string"), F.when(unit == "mph", unit)
        knots = lambda v: F.when(unit == "mph", F.floor(v * MPH_TO_KT + 0.5)).otherwise(v).cast("int")
        return (
            F.when(x["still"], told(F.lit(None).cast("double"), F.lit(0), F.lit(0), True, none))
            .when(degrees.isNotNull() & slow.isNotNull(), told(degrees, knots(slow), knots(fast), False, in_mph))
            .when(toward.isNull(), F.lit(None))
            .when(slow.isNotNull(), told(toward, knots(slow), knots(fast), False, in_mph))
            .when(x["drifts"], told(toward, F.lit(0), F.lit(2), False, none))
        )

    return bind(F.lower(text), lambda t: bind(words(t), stated))


def formation_chance(flat: Column, horizon: str) -> Column:
    """Category and percent of ``Formation chance through <horizon>``."""
    p = rf"(?i)formation chance through {horizon}[.\s]*([a-z]+)[.\s]*(?:near\s+)?(\d{{1,3}})\s*percent"
    return F.when(flat.rlike(p), F.struct(F.lower(F.regexp_extract(flat, p, 1)).alias("cat"), F.regexp_extract(flat, p, 2).cast("int").alias("pct")))


# Fixed value: an issuance line.
_ISSUED = r"(?i)(\d{3,4})\s*(AM|PM)?\s*([A-Z]{1,4})\s+[A-Za-z]{3,}\s+([A-Za-z]{3})[A-Za-z]*\s+(\d{1,2})\s+(\d{4})"


def issued_time(line: Column) -> Column:
    """The UTC time of ``805 AM EDT Sat Aug 8 2026``; an unknown zone or month is null."""
    clump, half = found(line, _ISSUED), F.upper(F.regexp_extract(line, _ISSUED, 2))
    offset = lookup(ZONES, F.upper(F.regexp_extract(line, _ISSUED, 3)))
    month = lookup({m: k for k, m in enumerate(MONTHS, 1)}, F.lower(F.regexp_extract(line, _ISSUED, 4)))
    hour = F.substring(clump, F.lit(1), F.length(clump) - 2).cast("int")
    hour = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).otherwise(hour)
    day, year = (found(line, _ISSUED, k).cast("int") for k in (5, 6))
    start = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)) if hasattr(F, "try_make_timestamp") else F.make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0))
    minutes = hour * 60 + F.substring(clump, F.length(clump) - 1, F.lit(2)).cast("int") + offset
    return F.timestamp_micros(F.unix_micros(start) + minutes.cast("long") * 60_000_000)


# What the head of an eastern Pacific product holds, and how far the head reaches.
_EASTERN = r"\b(?:TWDEP|TWOEP|AXPZ20|ABPZ20)\b|(?i:\bfor\s+the\s+east(?:ern)?(?:\s+and\s+central)?(?:\s+north)?\s+pacific\b)"
_HEAD = 400


def detect_basin(text: Column) -> Column:
    """EP where the head of a product says so, else AT; what the body says of the Pacific does not count."""
    return F.when(F.substring(F.coalesce(text, F.lit("")), 1, _HEAD).rlike(_EASTERN), "EP").otherwise("AT")


def product_route(text: Column) -> Column:
    """Which kind of product a pasted text is: TCM, else TWO, else TWD, by its head."""
    head = F.upper(F.substring(F.coalesce(text, F.lit("")), 1, _HEAD))
    return F.when(head.rlike(r"FORECAST/ADVISORY"), "TCM").when(F.substring(head, 1, 300).rlike(r"TROPICAL WEATHER OUTLOOK|\bTWO(?:AT|EP)\b"), "TWO").otherwise("TWD")


def leftmost_key(text: Column, keys: list[str]) -> Column:
    """The key that occurs first in a text; of two at one place the longer one."""
    return leftmost_entry(text, dict.fromkeys(keys, (None, None)))["key"]


def leftmost_entry(text: Column, places: dict[str, tuple]) -> Column:
    """``at, size, key, lat, lon`` of the place that a text names first; of two at one place the longer one.

    The table is one constant, so that an expression on it stays small however many places there are.
    """
    rows = json.dumps([{"key": k, "lat": lat, "lon": lon} for k, (lat, lon) in sorted(places.items())])
    known = F.from_json(F.lit(rows), "array<struct<key:string,lat:double,lon:double>>")

    def hits(low: Column) -> Column:
        hit = lambda k: F.struct(F.instr(low, k["key"]).alias("at"), (-F.length(k["key"])).alias("size"), k["key"].alias("key"), k["lat"].alias("lat"), k["lon"].alias("lon"))
        return F.array_min(F.filter(F.transform(known, hit), lambda x: x["at"] > 0))

    return bind(F.lower(text), hits)


def find_all(text: Column, pattern: str, groups: int) -> Column:
    """All matches as ``at`` (code points before it), ``g0`` (the match) and ``g1`` to ``g<groups>``."""
    names = [f"g{k}" for k in range(groups + 1)]
    found_groups = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names))
    # One stretch of other text stands before each match, and one after the last.
    stretches = F.arrays_zip(F.split(text, pattern).alias("gap"), *found_groups)
    kind = "array<struct<at:int," + ",".join(f"{n}:string" for n in names) + ">>"
    start = F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("hits"))

    def step(state: Column, x: Column) -> Column:
        at = state["end"] + F.length(x["gap"])
        hit = F.struct(at.alias("at"), *(x[n].alias(n) for n in names))
        return F.struct((at + F.coalesce(F.length(x["g0"]), F.lit(0))).alias("end"), F.concat(state["hits"], F.array(hit)).alias("hits"))

    return F.filter(F.aggregate(stretches, start, step)["hits"], lambda h: h["g0"].isNotNull())


def title_case(text: Column) -> Column:
    """Capitals at the start of each word, also after a hyphen."""
    return F.array_join(F.transform(F.split(text, "-"), lambda w: F.initcap(w)), "-")


#: Characters of a context that is shown.
CONTEXT = 600


def cap_context(text: Column, at: Column, size: Column) -> Column:
    """At most CONTEXT characters around a span ``at`` (from 0), cut between words, with an ellipsis where something is left out."""

    def window(t: Column) -> Column:
        length = F.length(t)
        low = F.greatest(F.lit(0), F.least(at - F.floor((CONTEXT - size) / 2).cast("int"), length - CONTEXT))
        return F.when(length <= CONTEXT, t).otherwise(bind(low, lambda x: bind(_word_bounds(t, x, at, size), lambda r: _shown(t, r))))

    return bind(text, window)


def _word_bounds(t: Column, low: Column, at: Column, size: Column) -> Column:
    """``start, end`` of a window moved in to blanks that do not touch the span."""
    blank = F.locate(" ", F.substring(t, low + 1, F.length(t)))
    before = F.substring(t, F.lit(1), low + CONTEXT + 1)
    last = F.length(before) - F.locate(" ", F.reverse(before))
    start = F.when((low > 0) & (blank > 0) & (low + blank - 1 < at), low + blank).otherwise(low)
    end = F.when((low + CONTEXT < F.length(t)) & (last < F.length(before)) & (last > at + size), last).otherwise(low + CONTEXT)
    return F.struct(start.alias("start"), end.alias("end"))


def _shown(t: Column, r: Column) -> Column:
    return F.concat(F.when(r["start"] > 0, "\u2026").otherwise(""), F.substring(t, r["start"] + 1, r["end"] - r["start"]), F.when(r["end"] < F.length(t), "\u2026").otherwise(""))


def sentence_around(flat: Column, at: Column, size: Column) -> Column:
    """The sentence, or sentences, that a span ``at`` (from 0) of a one-line text stands in, capped."""

    def piece(f: Column) -> Column:
        stop = F.locate(".", F.reverse(F.substring(f, F.lit(1), at)))
        start = F.when(stop > 0, at - stop + 1).otherwise(0)
        rest = F.locate(".", F.substring(f, at + size + 1, F.length(f)))
        end = F.when(rest > 0, at + size + rest).otherwise(F.length(f))
        return bind(start, lambda x: F.struct(x.alias("start"), F.substring(f, x + 1, end - x).alias("t")))

    def capped(p: Column) -> Column:
        lead = F.length(p["t"]) - F.length(F.ltrim(p["t"]))
        return bind(at - p["start"] - lead, lambda x: cap_context(F.trim(p["t"]), x, size))

    return bind(flat, lambda f: bind(piece(f), capped))


def stated_time(header: Column) -> Column:
    """``805 AM EDT`` of an issuance line; the whole line where it has no such head."""
    return F.coalesce(F.trim(F.regexp_replace(found(header, r"(?i)^\s*(\d{3,4}\s*(?:AM|PM)?\s*[A-Z]{1,4})\b"), r"\s+", " ")), header)


def stated_date(header: Column) -> Column:
    """``Jul 7`` of an issuance line, or nothing."""
    p = r"\b([A-Za-z]{3})[a-z]*\s+(\d{1,2})\s+\d{4}\b"
    return F.when(header.rlike(p), F.concat(F.initcap(F.regexp_extract(header, p, 1)), F.lit(" "), F.regexp_extract(header, p, 2))).otherwise("")


def with_respelling(name: Column, respelling: Column) -> Column:
    """A name in capitals with how it is said; one said as it is written stands alone."""
    same = respelling.isNull() | (F.lower(respelling) == F.lower(name))
    return F.when(same, F.upper(name)).otherwise(F.concat(F.upper(name), F.lit(" ("), respelling, F.lit(")")))


def chance_lines(context: Column) -> Column:
    """An area's text cut before each of its bullets."""
    return F.filter(F.transform(F.split(context, r"(?=\*\s)"), lambda x: F.trim(x)), lambda x: x != "")
