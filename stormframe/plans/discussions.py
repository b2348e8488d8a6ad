"""Discussion products to features: waves, cyclones, boxes of convection, troughs, point fixes and points told by place names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.functions.geometry import day_band, segment_distance
from stormframe.functions.scalars import signed_degrees
from stormframe.functions.text import (
    COORDINATE,
    LAT,
    LON,
    PAIR,
    bind,
    cap_context,
    coordinate_pairs,
    find_all,
    found,
    motion,
    one_line,
    paragraphs,
    rejoin_wraps,
    sentence_around,
    sentences,
    title_case,
)
from stormframe.plans.outlook import CLIMATOLOGY, ELSEWHERE, FEATURE, LEFT_BASIN, resolve_place
from stormframe.plans.places import PLACES
from stormframe.session import merged, once, settled

# How a box and a fix are worded, what calls a box strong, and how far around it that is looked for.
BOX = rf"(?i)from\s+{LAT}\s+to\s+{LAT}\s+between\s+{LON}\s+and\s+{LON}"
FIX = rf"(?i)(?:near|centered near|centered at|at)\s+{LAT}\s*{LON}"
STRONG, BEFORE, AFTER = r"(?i)isolated strong|strong convection", 60, 40
# The line above a section, and the sections that a pass reads.
HEADER = r"(?m)^(?=(?:\.{2,}[ \t]*[A-Z][A-Z /]{2,}?[ \t]*\.{2,}|[A-Z][A-Z /]{4,}?\.{3})[ \t]*$)"
HEADER_NAME = r"^\.{2,}[ \t]*([A-Z][A-Z /]{2,}?)[ \t]*\.{2,}[ \t]*(?:\n|$)|^([A-Z][A-Z /]{4,}?)\.{3}[ \t]*(?:\n|$)"
WAVE_SECTION, TROUGH_SECTION, SPECIAL_SECTION, PREAMBLE = "(?i)WAVE", "(?i)ITCZ|MONSOON|TROUGH", "(?i)SPECIAL FEATURE", "PREAMBLE"
# The longitude of a wave's axis, how far north and south it is said to reach, and how far where only one end is told.
AXIS = rf"(?i)\b(?:along|near)\s+{LON}(?:\s*(?:-|to|/)\s*{LON})?"
_BY = r"(?:\s+(?:in|near|over)\s+[A-Za-z .-]{1,25}?)?"
SOUTH_OF, SOUTHWARD = rf"(?i)\b(?:south|s)\s+of\s+{LAT}", rf"(?i)\bfrom\s+{LAT}{_BY}\s+southward"
NORTH_OF, NORTHWARD = rf"(?i)\b(?:north|n)\s+of\s+{LAT}", rf"(?i)\bfrom\s+{LAT}{_BY}\s+northward"
SPAN = rf"(?i)from\s+{LAT}\s+to\s+{LAT}(?!\s*,?\s*between)"
SHORT_SPAN = rf"(?i)from\s+(\d{{1,2}}(?:\.\d)?)\s*-\s*{LAT}(?!\s*,?\s*between)"
REACH, LEAST_LAT = 12, 2
# A cyclone's class and name, the words that are no name, and its stated center, wind and pressure.
CYCLONE = r"(?i)\b(Hurricane|Tropical Storm|Tropical Depression|Subtropical Storm|Subtropical Depression|Potential Tropical Cyclone|Post-Tropical Cyclone|Remnants of)\s+([A-Za-z][A-Za-z]*(?:-[A-Za-z]+)?)"
NO_NAME = (
    "(?i)^(?:or|is|are|was|were|will|would|could|can|may|might|should|has|have|had|and|but|to|of|the|an?|that|this|it|its|near|over|along|with|from|in|on|by|as|at"
    "|expected|forecast|likely|possible|probable|forms?|forming|formation|develops?|developing|development|conditions|activity|force|watch|warnings?|center|intensity|strength|remnants|status|category)$"
)
INDEFINITE = r"(?i)\b(?:a|an)\s+$"
CENTER = rf"(?i)(?:centered|located)\s+(?:near|at)\s+{LAT}\s*{LON}"
WIND = r"(?i)max(?:imum)? sustained winds?(?:\s+speeds?)?(?:\s+(?:is|are|of))?\s*(?:near\s+)?(\d{1,3})\s*k(?:t|nots?)\b"
PRESSURE = r"(?i)(?:minimum central\s+)?pressure(?:\s+is)?(?:\s+estimated(?:\s+to be)?)?\D{0,15}(\d{3,4})\s*mb"
ANY_PRESSURE = r"(\d{3,4})\s*mb"
# A chain of positions, what names its feature, and what keeps a sentence from being one.
CHAIN = r"(?i)from\s+((?:\d{1,2}(?:\.\d)?[NS]\d{1,3}(?:\.\d)?[EW]\s*(?:to\s*)?){2,})"
CUE, NO_CHAIN = r"(?i)monsoon trough|itcz|trough", r"(?i)convection|\bfrom\s+\d"
KIND_CUE = r"(?is)^.*(itcz|intertropical convergence|monsoon trough)"
# Words of the future, words that point back at a drawn feature, and the distance under which a point repeats one.
FUTURE = r"(?i)\b(?:will|should|is expected|are expected|forecast)\b"
SAME_WAVE, SAME_TROUGH = r"(?i)\b(?:the|this|that)\s+(?:[a-z-]+\s+)?wave\b", r"(?i)\b(?:the|this|that)\s+(?:[a-z-]+\s+)?trough\b"
POINT_NOUN, REPEATS = r"(?i)\b(?:low|disturbance|disturbed|system|gyre|area)\b", 2.0

POINT = "struct<lat:double,lon:double>"


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def _pair(text: Column, pattern: str, first: int = 1) -> Column:
    """The point in four groups of a pattern, or null."""
    part = lambda k: found(text, pattern, first + k)
    lat, lon = signed_degrees(part(0).cast("double"), part(1)), signed_degrees(part(2).cast("double"), part(3))
    return F.when(part(0).isNotNull(), _point(lat, lon))


def _degrees(hit: str, k: int) -> Column:
    return signed_degrees(F.col(f"{hit}.g{k}").cast("double"), F.upper(F.col(f"{hit}.g{k + 1}")))


def _flat(text_col: str) -> Column:
    return F.replace(F.col(text_col), F.lit("\n"), F.lit(" "))


def split_sections(products: DataFrame) -> DataFrame:
    """``section, name, body`` of ``text``, with the product's other columns: what stands before the first header is
    PREAMBLE, and a header without a line under it gives nothing."""
    pieces = F.split(rejoin_wraps(F.regexp_replace("text", "\r\n?", "\n")), HEADER)
    kept = [c for c in products.columns if c != "text"]
    cut = products.select(*kept, F.size(pieces).alias("_n"), F.posexplode(pieces).alias("section", "_piece"))
    name = F.coalesce(found(F.col("_piece"), HEADER_NAME), found(F.col("_piece"), HEADER_NAME, 2))
    body = F.when(name.isNull(), F.col("_piece")).otherwise(F.regexp_replace("_piece", r"^[^\n]*\n?", ""))
    out = cut.select(*kept, "section", F.coalesce(F.trim(name), F.lit(PREAMBLE)).alias("name"), body.alias("body"), "_n").filter("body <> ''")
    return out.withColumn("body", F.when(F.col("section") < F.col("_n") - 1, F.regexp_replace("body", r"\n\z", "")).otherwise(F.col("body"))).drop("_n")


def wave_axis(flat: Column) -> Column:
    """The northern, then the southern end of a wave, by the way of telling it that comes first; else all positions."""
    lat = lambda p, k, h=1: signed_degrees(found(flat, p, k).cast("double"), found(flat, p, k + h))
    at = lambda *ps: F.coalesce(*(bind(F.regexp_instr(flat, F.lit(p)), lambda i: F.when(i > 0, i)) for p in ps))
    stated = {
        "one": lat(AXIS, 1), "two": lat(AXIS, 3), "a": lat(SPAN, 1), "b": lat(SPAN, 3), "c": lat(SHORT_SPAN, 1, 2), "d": lat(SHORT_SPAN, 2),
        "top": F.coalesce(lat(SOUTH_OF, 1), lat(SOUTHWARD, 1)), "bottom": F.coalesce(lat(NORTH_OF, 1), lat(NORTHWARD, 1)),
    }

    def axis(x: Column) -> Column:
        lon = F.when(x["two"].isNotNull(), (x["one"] + x["two"]) / 2).otherwise(x["one"])
        told = [
            (at(SPAN), F.greatest(x["a"], x["b"]), F.least(x["a"], x["b"])),
            (at(SHORT_SPAN), F.greatest(x["c"], x["d"]), F.least(x["c"], x["d"])),
            (at(SOUTH_OF, SOUTHWARD), x["top"], F.greatest(F.lit(float(LEAST_LAT)), x["top"] - REACH)),
            (at(NORTH_OF, NORTHWARD), x["bottom"] + REACH, x["bottom"]),
        ]
        ways = F.array(*(F.struct(p.alias("at"), F.lit(k).alias("k"), a.alias("north"), b.alias("south")) for k, (p, a, b) in enumerate(told)))
        first = F.array_min(F.filter(ways, lambda w: w["at"].isNotNull()))
        return bind(F.struct(lon.alias("lon"), first.alias("w")), lambda y: F.when(y["lon"].isNotNull() & y["w"].isNotNull(), F.array(_point(y["w"]["north"], y["lon"]), _point(y["w"]["south"], y["lon"]))))

    return F.coalesce(bind(F.struct(*(v.alias(k) for k, v in stated.items())), axis), coordinate_pairs(flat))


def waves(sections: DataFrame) -> DataFrame:
    """``id, axis, motion, source, context`` for each paragraph on a wave that tells where it is; paragraphs count whether they do or not."""
    kept = [c for c in sections.columns if c != "body"]
    chunks = F.filter(paragraphs(F.col("body")), lambda c: c.rlike("(?i)wave"))
    cut = sections.filter(F.col("name").rlike(WAVE_SECTION)).select(*kept, F.posexplode(chunks).alias("n", "chunk"))
    flat = once(cut, flat=one_line(F.col("chunk"))).select(*kept, F.concat(F.lit("W"), (F.col("n") + 1).cast("string")).alias("id"), "flat")
    out = once(once(flat, axis=wave_axis(F.col("flat"))).filter(F.size("axis") > 0), motion=motion(F.col("flat")))
    return out.select(
        *kept, "id", "axis", "motion", F.substring("flat", 1, 220).alias("source"),
        cap_context(F.col("flat"), F.lit(0), F.least(F.length("flat"), F.lit(220))).alias("context"),
    )


def named_cyclone(flat: Column) -> Column:
    """The first match of a class and a name that is a cyclone's: no word of forecasts, capitalised unless all is, and
    not after an indefinite article."""
    all_caps = flat == F.upper(flat)

    def real(hit: Column) -> Column:
        capital = F.substring(hit["g2"], 1, 1) == F.upper(F.substring(hit["g2"], 1, 1))
        return ~F.substring(flat, F.lit(1), hit["at"]).rlike(INDEFINITE) & ~hit["g2"].rlike(NO_NAME) & (all_caps | capital)

    return F.get(F.filter(find_all(flat, CYCLONE, 2), real), F.lit(0))


def cyclones(sections: DataFrame) -> DataFrame:
    """``id, cyclone, classification, lat, lon, wind_kt, pressure_mb, motion, source, context`` of the preamble and special features."""
    kept = [c for c in sections.columns if c != "body"]
    cut = sections.filter(F.col("name").rlike(SPECIAL_SECTION) | (F.col("name") == PREAMBLE)).select(*kept, F.posexplode(paragraphs(F.col("body"))).alias("n", "chunk"))
    flat = F.col("flat")
    told = once(once(cut, flat=one_line(F.col("chunk"))).select(*kept, "n", "flat"), hit=named_cyclone(flat)).filter("hit IS NOT NULL")
    told = once(told, pos=F.coalesce(_pair(F.upper(flat), CENTER), F.get(coordinate_pairs(flat), F.lit(0)))).filter("pos IS NOT NULL")
    told = once(told, motion=motion(flat))
    order = Window.partitionBy(*[c for c in ("file", "section") if c in kept]).orderBy("n")
    return told.select(
        *kept, F.concat(F.lit("C"), F.row_number().over(order).cast("string")).alias("id"), title_case(F.col("hit.g2")).alias("cyclone"),
        title_case(F.col("hit.g1")).alias("classification"), F.col("pos.lat").alias("lat"), F.col("pos.lon").alias("lon"), found(flat, WIND).cast("int").alias("wind_kt"),
        F.coalesce(found(flat, PRESSURE), found(flat, ANY_PRESSURE)).cast("int").alias("pressure_mb"), "motion",
        F.substring("flat", 1, 240).alias("source"), cap_context(flat, F.lit(0), F.least(F.length(flat), F.lit(240))).alias("context"),
    )


def convection_boxes(sections: DataFrame, text_col: str = "body") -> DataFrame:
    """``south, north, west, east, strong, source, context`` for each box of each section, with the section's other columns."""
    kept = [c for c in sections.columns if c != text_col]
    hits = sections.select(*kept, _flat(text_col).alias("flat")).select(*kept, "flat", F.explode(find_all(F.col("flat"), BOX, 8)).alias("hit"))
    a, b, c, d = (_degrees("hit", k) for k in (1, 3, 5, 7))
    begin, size = F.col("hit.at"), F.length("hit.g0")
    around = F.substring("flat", F.greatest(begin - BEFORE, F.lit(0)) + 1, F.least(begin, F.lit(BEFORE)) + size + AFTER)
    return hits.select(
        *kept,
        F.least(a, b).alias("south"),
        F.greatest(a, b).alias("north"),
        F.least(c, d).alias("west"),
        F.greatest(c, d).alias("east"),
        around.rlike(STRONG).alias("strong"),
        F.col("hit.g0").alias("source"),
        sentence_around(F.col("flat"), begin, size).alias("context"),
    )


def point_fixes(sections: DataFrame, text_col: str = "body") -> DataFrame:
    """``lat, lon, source, context`` for each stated position of each section, with the section's other columns."""
    kept = [c for c in sections.columns if c != text_col]
    hits = sections.select(*kept, _flat(text_col).alias("flat")).select(*kept, "flat", F.explode(find_all(F.col("flat"), FIX, 4)).alias("hit"))
    context = sentence_around(F.col("flat"), F.col("hit.at"), F.length("hit.g0"))
    return hits.select(*kept, _degrees("hit", 1).alias("lat"), _degrees("hit", 3).alias("lon"), F.col("hit.g0").alias("source"), context.alias("context"))


def trough_kind(head: Column, tail: Column) -> Column:
    """itcz, monsoon or trough: by the last cue of the sentence before the positions, else by one after them."""
    cue = F.lower(found(head, KIND_CUE))
    return (
        F.when(cue == "monsoon trough", "monsoon")
        .when(cue.isNotNull(), "itcz")
        .when(tail.rlike(r"(?i)\bitcz\b|intertropical convergence"), "itcz")
        .when(tail.rlike("(?i)monsoon trough"), "monsoon")
        .otherwise("trough")
    )


def troughs(sections: DataFrame) -> DataFrame:
    """``subtype, line, source``: chains after a "from", and sentences that name the feature before two positions or more."""
    kept = [c for c in sections.columns if c != "body"]
    read = sections.filter(F.col("name").rlike(TROUGH_SECTION) | F.col("body").rlike("(?i)TROUGH")).select(*kept, _flat("body").alias("flat"))
    chains = read.select(*kept, "flat", F.explode(find_all(F.col("flat"), CHAIN, 1)).alias("hit"))
    head = F.element_at(F.split(F.substring("flat", F.lit(1), F.col("hit.at")), r"\. "), -1)
    tail = F.element_at(F.split(F.substring("flat", F.col("hit.at") + 1, F.length("flat")), r"\. "), 1)
    chains = chains.select(
        *kept, trough_kind(head, tail).alias("subtype"), coordinate_pairs(F.col("hit.g1")).alias("line"), F.trim(F.substring(F.concat(F.lit("from "), "hit.g1"), 1, 160)).alias("source")
    )
    told = read.select(*kept, F.explode(F.split("flat", r"(?<=\.) ")).alias("sent")).filter(~F.col("sent").rlike(NO_CHAIN) & F.col("sent").rlike(CUE))
    told = told.withColumn("hits", find_all(F.col("sent"), PAIR, 0)).filter(F.size("hits") >= 2)
    first, last = F.element_at("hits", 1), F.element_at("hits", -1)
    told = told.filter(F.regexp_instr("sent", F.lit(CUE)) - 1 < first["at"])
    prose = told.select(
        *kept,
        trough_kind(F.substring("sent", F.lit(1), first["at"]), F.substring("sent", first["at"] + 1, F.length("sent"))).alias("subtype"),
        coordinate_pairs(F.col("sent")).alias("line"),
        F.substring(F.substring("sent", first["at"] + 1, last["at"] + F.length(last["g0"]) - first["at"]), 1, 160).alias("source"),
    )
    return chains.unionByName(prose).filter(F.size("line") >= 2)


def inferred_points(sections: DataFrame) -> DataFrame:
    """``lat, lon, source, context``: places named in sentences that bring in a feature, without a coordinate, of now and of this basin."""
    kept = [c for c in sections.columns if c != "body"]
    read = sections.filter(~F.col("name").rlike(SPECIAL_SECTION) & (F.col("name") != PREAMBLE)).select(*kept, F.explode(sentences(F.col("body"))).alias("sent"))
    sent = F.col("sent")
    read = read.filter(~sent.rlike(COORDINATE) & ~sent.rlike(ELSEWHERE)).withColumn("present", F.get(F.split("sent", FUTURE), F.lit(0)))

    def of_basin(name: str) -> Column:
        gated = F.regexp_replace("present", CLIMATOLOGY[name], " ").rlike(FEATURE) & ~sent.rlike(LEFT_BASIN[name])
        return F.when(gated, resolve_place(F.col("present"), PLACES[name]))

    found_at = F.when(F.col("basin") == "EP", of_basin("EP")).otherwise(of_basin("AT"))
    out = read.withColumn("pos", found_at).filter("pos IS NOT NULL")
    told = F.trim(sent)
    return out.select(*kept, "pos.lat", "pos.lon", F.substring(told, 1, 200).alias("source"), cap_context(told, F.lit(0), F.least(F.length(told), F.lit(200))).alias("context"))


def _segments(line: Column) -> Column:
    """The stretches of a line; a single point is a stretch of no length."""
    ends = F.concat(F.slice(line, 2, F.size(line) - 1), F.slice(line, -1, 1))
    pairs = F.zip_with(line, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(line) > 0, pairs)


def without_repeats(points: DataFrame, geometry: DataFrame) -> DataFrame:
    """Inferred points that no drawn feature of their product already tells.

    ``geometry`` has ``file, kind, line`` with kind wave, trough or point. A sentence that
    points back ("the wave") goes if the product has such a feature; so does one
    that lies within two degrees of a feature of the kind it names.
    """
    held = geometry.groupBy("file").agg(*(F.collect_list(F.when(F.col("kind") == k, F.col("line"))).alias(f"_{k}") for k in ("wave", "trough", "point")))
    joined = points.join(merged(held), "file", "left")

    def near(kind: str) -> Column:
        close = lambda s: segment_distance(F.col("lat"), F.col("lon"), s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]) < REPEATS
        return F.exists(F.coalesce(f"_{kind}", F.array().cast(f"array<array<{POINT}>>")), lambda line: F.exists(_segments(line), close))

    some = lambda kind: F.coalesce(F.size(f"_{kind}"), F.lit(0)) > 0
    source = F.col("source")
    told = (
        (source.rlike(SAME_WAVE) & some("wave"))
        | (source.rlike(SAME_TROUGH) & some("trough"))
        | (source.rlike(r"(?i)\bwave\b") & near("wave"))
        | (source.rlike(r"(?i)\btrough\b") & near("trough"))
        | (source.rlike(POINT_NOUN) & near("point"))
    )
    return joined.filter(~told).select(points.columns)


def discussion_features(products: DataFrame) -> dict[str, DataFrame]:
    """The tables of features of ``file, basin, text`` products, each pass on its sections; ``inferred`` without what the others tell.

    Each table is worked out once and checkpointed, as passes read one another's.
    """
    sections = settled(split_sections(products))
    found_cyclones = settled(cyclones(sections))
    fixed = point_fixes(sections).join(merged(found_cyclones.select("file", "section").distinct()), ["file", "section"], "left_anti")
    lines = settled(troughs(sections))
    vertices = lines.select("file", "name", F.explode("line").alias("p")).select("file", "name", "p.lat", "p.lon").distinct()
    fixed = settled(fixed.join(merged(vertices), ["file", "name", "lat", "lon"], "left_anti"))
    axes = settled(waves(sections))
    spot = F.array(_point(F.col("lat"), F.col("lon")))
    kinds = (("wave", axes, F.col("axis")), ("trough", lines, F.col("line")), ("point", found_cyclones, spot), ("point", fixed, spot))
    drawn = None
    for kind, df, line in kinds:
        part = df.select("file", F.lit(kind).alias("kind"), line.cast(f"array<{POINT}>").alias("line"))
        drawn = part if drawn is None else drawn.unionByName(part)
    return {
        "sections": sections, "cyclones": found_cyclones, "waves": axes, "convection": convection_boxes(sections), "troughs": lines, "fixes": fixed,
        "inferred": settled(without_repeats(inferred_points(sections), drawn)), "projections": projections(axes, found_cyclones),
    }


def projections(axes: DataFrame, found_cyclones: DataFrame) -> DataFrame:
    """``file, id, slow, fast, band``: where the first point of each axis and each cyclone is in a day."""
    start = F.element_at("axis", 1)
    a = axes.select("file", "id", day_band(start["lat"], start["lon"], F.col("motion")).alias("to"))
    c = found_cyclones.select("file", F.coalesce("cyclone", "id").alias("id"), day_band(F.col("lat"), F.col("lon"), F.col("motion")).alias("to"))
    return a.unionByName(c).filter("to IS NOT NULL").select("file", "id", "to.*")


def discussion_summary(products: DataFrame) -> DataFrame:
    """One row per product: its cyclones and waves in order, and counts of everything else; troughs also by kind."""
    tables = discussion_features(products)
    out = products.select("file", "basin")
    lists = {
        "cyclones": F.struct("section", "id", "cyclone", "classification", "lat", "lon", "wind_kt"),
        "waves": F.struct("section", "id", "axis", "motion"),
    }
    for name, item in lists.items():
        # By number: the tenth comes after the second.
        number = F.regexp_extract("id", r"(\d+)$", 1).try_cast("int").alias("number")
        listed = tables[name].groupBy("file").agg(F.sort_array(F.collect_list(F.struct("section", number, item.alias("item")))).alias("x"))
        out = out.join(listed.select("file", F.transform("x", lambda v: v["item"]).alias(name)), "file", "left")
    for name in ("sections", "convection", "fixes", "inferred", "projections"):
        out = out.join(tables[name].groupBy("file").agg(F.count("*").alias(f"n_{name}")), "file", "left")
    kinds = [F.count_if(F.col("subtype") == k).alias(f"n_{k}") for k in ("itcz", "monsoon", "trough")]
    out = out.join(tables["troughs"].groupBy("file").agg(F.count("*").alias("n_troughs"), *kinds), "file", "left")
    return out.fillna(0, [c for c in out.columns if c.startswith("n_")])
