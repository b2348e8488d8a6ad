"""Outlook products to disturbance rows: paragraphs, titles, tags, stated odds and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.functions.geometry import offset_point
from stormframe.functions.scalars import round_half_up
from stormframe.functions.text import MPH_TO_KT, bind, compass_degrees, formation_chance, found, leftmost_entry, lookup_or_null, one_line, paragraphs, rejoin_wraps, sentences
from stormframe.plans.places import PLACES

# What makes a sentence speak of a feature, of one that has left its basin, or of a model or section;
# the names of climatology that hold a noun of a feature. EP text says of arrivals what AT text says of departures.
FEATURE = r"(?i)\b(?:wave|low|disturbance|disturbed|trough|area|system|gyre)\b"
ELSEWHERE = r"(?i)\brefer to\b|\b(?:gfs|ecmwf|nam|model)\b"
LEFT_BASIN = {
    "AT": r"(?i)\bmoved\s+(?:in)?to\s+the\s+(?:eastern\s+)?pacific\b",
    "EP": r"(?i)\b(?:in)?to\s+the\s+central\s+pacific\b|\bw(?:est)?\s+of\s+140w\b|\bcrossed\s+140w\b|\bmoved\s+inland\b",
}
_CLIMATOLOGY = (
    r"(?i)(?:colombian|panama)\s+low|(?:bermuda-azores|bermuda|azores)\s+high|(?:subtropical|atlantic)\s+ridge|\w+\s+warning\s+area"
    r"|(?:north|south|east|west)\s+of\s+the\s+(?:forecast\s+)?area|this\s+area"
)
CLIMATOLOGY = {
    "AT": _CLIMATOLOGY,
    "EP": _CLIMATOLOGY + r"|(?:tehuantepec|papagayo)\s+(?:gap\s+)?winds?(?:\s+(?:event|area))?|gap\s+wind\s+(?:event|area)",
}
OFFSET = r"(?:(?:a\s+)?(couple|few|several)(?:\s+of)?\s+hundred|(\d{2,4}))\s+(nautical\s+)?miles\s+(?:to\s+the\s+)?([a-z][a-z-]{1,20})\s+of\s+([\s\S]+)\z"
VAGUE = r"\b(?:well|far)\s+(?:to\s+the\s+)?([a-z-]{1,20})\s+of\s+(?:the\s+)?\z"
TITLE = r"^\s*(?:\d+\.\s*)?([^:.]{1,80}):"
# A line of odds, a paragraph with a title of its own or a title before, and the tag in a title.
ODDS, OWN_TITLE, TITLED, TAG = r"(?i)\*\s*formation chance", r"^[^\n]*:", r"^\s*(?:\d+\.\s*)?[^:.\n]{1,80}:", r"(?i)\(((?:AL|EP|CP)\d{2})\)"

Gazetteer = dict[str, tuple[float, float]]


def _spot(hit: Column) -> Column:
    return F.when(hit.isNotNull(), F.struct(hit["lat"].alias("lat"), hit["lon"].alias("lon")))


def _bare(phrase: Column) -> Column:
    """A phrase as places are looked up in it: without an article at its head and a mark at its end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(phrase, r"^\s+|\s+\z", ""), r"^the\s+", ""), r"[.,]\z", "")


def anchor_point(phrase: Column, places: Gazetteer) -> Column:
    """The point of the leftmost, then longest, place that a phrase names."""
    return bind(leftmost_entry(_bare(phrase), places), _spot)


# A place between two others, the miles of vague hundreds, and the farthest a product would measure.
BETWEEN = r"between (.+?) and (?:the )?(.+?)(?:[.,]|\z)"
HUNDREDS, FARTHEST = {"couple": 200, "few": 300, "several": 400}, 1500


def resolve_place(phrase: Column, places: Gazetteer) -> Column:
    """Between two places: the middle. A distance and direction from one: that point, to a tenth. Else the place
    named, unless the phrase puts the feature far from it by an unstated amount. Line breaks stand: no name goes over one."""
    return bind(F.lower(phrase), lambda p: F.coalesce(_middle(p, places), _away(p, places), _named(p, places)))


def _middle(p: Column, places: Gazetteer) -> Column:
    ends = F.array(anchor_point(F.regexp_extract(p, BETWEEN, 1), places), anchor_point(F.regexp_extract(p, BETWEEN, 2), places))
    told = bind(ends, lambda e: F.when(F.size(F.array_compact(e)) == 2, F.struct(*(((e[0][k] + e[1][k]) / 2).alias(k) for k in ("lat", "lon")))))
    return F.when(p.rlike(BETWEEN), told)


def _away(p: Column, places: Gazetteer) -> Column:
    hundreds = lookup_or_null(HUNDREDS, found(p, OFFSET)).cast("double")
    miles = F.coalesce(hundreds, found(p, OFFSET, 2).cast("double"))
    nm = F.when(found(p, OFFSET, 3).isNotNull(), miles).otherwise(miles * MPH_TO_KT)
    # Only the first of two landmarks counts.
    base = anchor_point(F.get(F.split(found(p, OFFSET, 5), r"\s+and\s+"), F.lit(0)), places)
    told = F.struct(base.alias("base"), compass_degrees(found(p, OFFSET, 4)).alias("bearing"), nm.alias("nm"))

    def moved(x: Column) -> Column:
        to = bind(offset_point(x["base"]["lat"], x["base"]["lon"], x["bearing"], x["nm"]), lambda q: F.struct(*(round_half_up(q[k], 1).alias(k) for k in ("lat", "lon"))))
        return F.when(x["base"].isNotNull() & x["bearing"].isNotNull() & (x["nm"] <= FARTHEST), to)

    # Fixed value: a distance that is a reach, not an offset.
    within = p.rlike(r"\bwithin\s+(?:about\s+|around\s+|approximately\s+)?" + OFFSET)
    return F.when(p.rlike(OFFSET) & ~within, bind(told, moved))


def _named(p: Column, places: Gazetteer) -> Column:
    def told(h: Column, hit: Column) -> Column:
        vague = compass_degrees(found(F.substring(h, F.lit(1), hit["at"] - 1), VAGUE)).isNotNull()
        return F.when(~F.coalesce(vague, F.lit(False)), _spot(hit))

    return bind(_bare(p), lambda h: bind(leftmost_entry(h, places), lambda hit: told(h, hit)))


def locates(sentence: Column, basin: Column) -> Column:
    """Whether a sentence speaks of a feature of its basin, and not of a model or another section."""

    def gate(name: str) -> Column:
        return ~sentence.rlike(LEFT_BASIN[name]) & F.regexp_replace(sentence, CLIMATOLOGY[name], " ").rlike(FEATURE)

    return ~sentence.rlike(ELSEWHERE) & F.when(basin == "EP", gate("EP")).otherwise(gate("AT"))


def disturbances(products: DataFrame, places: Gazetteer | None = None) -> DataFrame:
    """Areas of outlook products: ``file, basin, stamp, ts, id, invest, lat, lon, chance48, chance7, source, context``.

    A paragraph with a line of odds ends an area; its body takes in the paragraph
    before if it starts with the odds, or if that one is titled and it is not.
    A place in the title counts as it is, one in a sentence only if the
    sentence speaks of a feature that has not left this basin. Places are the
    basin's, unless others are given.
    """
    resolve = (lambda p: resolve_place(p, places)) if places else (lambda p: F.when(F.col("basin") == "EP", resolve_place(p, PLACES["EP"])).otherwise(resolve_place(p, PLACES["AT"])))
    cut = products.filter("kind = 'TWO'").select("file", "basin", "stamp", "ts", F.posexplode(paragraphs(rejoin_wraps(F.col("text")))).alias("n", "chunk"))
    order = Window.partitionBy("file").orderBy("n")
    cut = cut.withColumn("before", F.coalesce(F.lag("chunk").over(order), F.lit("")))
    ends = cut.filter(F.col("chunk").rlike(ODDS))
    own_title = F.ltrim("chunk").rlike(OWN_TITLE)
    titled_before = F.col("before").rlike(TITLED)
    inherits = F.col("chunk").rlike(r"^\s*\*") | (~own_title & titled_before)
    ends = ends.withColumn("body", F.when(inherits, F.concat("before", F.lit("\n"), "chunk")).otherwise(F.col("chunk")))
    ends = ends.withColumn("flat", one_line(F.col("body")))
    prose = one_line(F.array_join(F.filter(F.split("body", "\n"), lambda x: ~x.rlike(r"^\s*\*")), " "))
    ends = ends.withColumn("prose", prose).withColumn("title", found(F.col("prose"), TITLE))
    by_sentence = F.filter(F.transform(F.filter(sentences(F.col("prose")), lambda s: locates(s, F.col("basin"))), resolve), lambda x: x.isNotNull())
    ends = ends.withColumn("pos", F.coalesce(resolve(F.col("title")), F.get(by_sentence, F.lit(0))))
    return ends.select(
        "file",
        "basin",
        "stamp",
        "ts",
        F.concat(F.lit("D"), F.row_number().over(order).cast("string")).alias("id"),
        F.upper(found(F.col("title"), TAG)).alias("invest"),
        F.col("pos.lat").alias("lat"),
        F.col("pos.lon").alias("lon"),
        formation_chance(F.col("flat"), "48 hours").alias("chance48"),
        formation_chance(F.col("flat"), "7 days").alias("chance7"),
        F.substring("flat", 1, 300).alias("source"),
        F.col("flat").alias("context"),
    )
