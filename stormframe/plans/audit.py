"""Quality flags of parsed products, their totals, and differences between two products for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.scalars import SANE_TRACK, sane
from stormframe.session import merged

# Words that promise a wave, and a storm among the special features.
WAVE_WORDS = r"(?i)tropical wave"
STORM_WORDS = r"(?i)\b(hurricane|tropical storm|tropical depression|subtropical (?:storm|depression)|potential tropical cyclone)\s+(?!center\b|warning\b)[a-z-]+"


def flags(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order; an unknown one does not."""
    return F.array_compact(F.array(*(F.when(test, name) for name, test in tests.items())))


def _off(points: Column, basin: Column, boxes: dict | None = None) -> Column:
    """How many of the points lie out of their basin's box; a point without a position is none."""
    out = F.filter(points, lambda p: p["lat"].isNotNull() & ~(sane(p["lat"], p["lon"], basin, boxes) if boxes else sane(p["lat"], p["lon"], basin)))
    return F.coalesce(F.size(out), F.lit(0))


def audit_outlooks(products: DataFrame, areas: DataFrame) -> DataFrame:
    """``file, flags, n, star_pairs, unmapped``: odds that gave no area, areas without place or odds, places out of the basin."""
    found = areas.groupBy("file").agg(
        F.count("*").alias("n"), F.count_if(F.col("lat").isNull()).alias("unmapped"), F.count_if(F.col("chance48").isNull() & F.col("chance7").isNull()).alias("no_odds"),
        F.collect_list(F.struct("lat", "lon")).alias("points"),
    )
    stars = F.floor(F.size(F.regexp_extract_all("text", F.lit(r"(?i)\*\s*formation chance"), F.lit(0))) / 2 + 0.5).cast("int")
    rows = products.select("file", "basin", stars.alias("star_pairs")).join(found, "file", "left").fillna(0, ["n", "unmapped", "no_odds"])
    tests = {
        "chances-in-text/none-parsed": (F.col("star_pairs") > 0) & (F.col("n") == 0),
        "unmapped-disturbances": F.col("unmapped") > 0,
        "disturbance-no-chances": F.col("no_odds") > 0,
        "disturbance-out-of-basin": _off(F.col("points"), F.col("basin")) > 0,
    }
    return rows.select("file", flags(tests).alias("flags"), "n", "star_pairs", "unmapped")


def audit_discussions(products: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``file, flags`` and the counts of features: waves or storms that the text promises and no pass found, places out of the basin.

    All tables are counted in one grouping, which products meet in one join; a place is judged by the boxes
    of both basins before that, so that no lists of places are made.
    """
    rows = products.select("file", "basin", F.col("text").rlike(WAVE_WORDS).alias("wave_words"))
    spot = F.array(F.struct("lat", "lon"))
    places = {"waves": F.col("axis"), "troughs": F.col("line"), "cyclones": spot, "fixes": spot, "inferred": spot}
    storm = F.when(F.upper("name").like("%SPECIAL FEATURE%"), F.col("body").rlike(STORM_WORDS))
    counts = [c for c in tables if c in ("sections", "waves", "cyclones", "troughs", "convection", "fixes", "inferred", "projections")]
    features = None
    for name in counts:
        off = [(_off(places[name], F.lit(b)) if name in places else F.lit(0)).alias(f"off_{b}") for b in ("EP", "AT")]
        part = tables[name].select("file", F.lit(name).alias("kind"), (storm if name == "sections" else F.lit(None).cast("boolean")).alias("storm"), *off)
        features = part if features is None else features.unionByName(part)
    sums = [F.sum(f"off_{b}").alias(f"off_{b}") for b in ("EP", "AT")]
    found = features.groupBy("file").agg(*(F.count_if(F.col("kind") == c).alias(c) for c in counts), F.max("storm").alias("storm_words"), *sums)
    rows = rows.join(merged(found), "file", "left").fillna(0, [*counts, "off_EP", "off_AT"])
    tests = {
        "waves-in-text/none-parsed": F.col("wave_words") & (F.col("waves") == 0),
        "special-features/no-cyclone": F.col("storm_words") & (F.col("cyclones") == 0),
        "sections-not-split": F.col("sections") <= 1,
        "coords-out-of-basin": F.when(F.col("basin") == "EP", F.col("off_EP")).otherwise(F.col("off_AT")) > 0,
    }
    return rows.select("file", flags(tests).alias("flags"), *counts)


def audit_advisories(products: DataFrame, parsed: DataFrame) -> DataFrame:
    """``file, flags``: products that gave no advisory, advisories without track or wind, tracks out of the basin."""
    rows = products.select("file").join(parsed, "file", "left")
    basin = F.when(F.substring("storm_id", 1, 2) == "EP", "EP").otherwise("AT")
    tests = {
        "parse-null": F.col("center").isNull(),
        "no-track-points": F.size("track") == 0,
        "track-point-out-of-basin": _off(F.col("track"), basin, SANE_TRACK) > 0,
        "center-out-of-basin": _off(F.array("center"), basin, SANE_TRACK) > 0,
        "no-wind": F.col("center").isNotNull() & F.col("wind_kt").isNull(),
    }
    return rows.select("file", flags(tests).alias("flags"))


def _named(kind: str, names: Column) -> Column:
    """``kind:name`` of each name."""
    return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.concat(F.lit(kind + ":"), F.coalesce(n, F.lit("null"))))


def _told(kind: str, wanted: Column, got: Column) -> Column:
    """``kind:wanted/got:got`` where the two differ."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    flag = F.array(F.concat(F.lit(kind + ":"), text(wanted), F.lit("/got:"), text(got)))
    return F.when(~wanted.eqNullSafe(got), flag).otherwise(F.array().cast("array<string>"))


def _if(test: Column, flag: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(flag))).otherwise(F.array().cast("array<string>"))


def _lost(wanted: Column, got: Column) -> Column:
    """The wanted names, in their order, that are not there; whatever the case."""
    there = F.transform(F.coalesce(got, F.array().cast("array<string>")), lambda x: F.upper(x))
    return F.filter(F.coalesce(wanted, F.array().cast("array<string>")), lambda n: ~F.exists(there, lambda x: F.coalesce(x == F.upper(n), F.lit(False))))


def expected_outlooks(expected: DataFrame, products: DataFrame, areas: DataFrame) -> DataFrame:
    """``file, flags`` for each ``file, disturbances, invests`` that is expected: other counts, tags that are missing,
    areas that lie out of the basin or state no odds. A file that is not there has none of what is expected."""
    box = F.when(F.col("lat").isNotNull() & ~sane(F.col("lat"), F.col("lon"), F.col("basin")), F.coalesce("invest", F.lit("untagged")))
    silent = F.when(F.col("chance48").isNull() & F.col("chance7").isNull(), F.coalesce("invest", F.lit("untagged")))
    item = F.struct(F.substring("id", 2, 9).cast("int").alias("n"), "invest", box.alias("off"), silent.alias("silent"))
    found = areas.groupBy("file").agg(F.sort_array(F.collect_list(item)).alias("x"))
    rows = expected.join(products.select("file").distinct(), "file", "left").join(found, "file", "left")
    part = lambda c: F.array_compact(F.transform("x", lambda v: v[c]))
    n = F.coalesce(F.size("x"), F.lit(0))
    told = F.concat(_told("disturbance-count", F.col("disturbances"), F.greatest(n, F.lit(0))), _named("missing-invest", _lost(F.col("invests"), part("invest"))), _named("disturbance-out-of-basin", part("off")), _named("no-chances", part("silent")))
    return rows.select("file", told.alias("flags"))


def expected_discussions(expected: DataFrame, products: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """``file, flags`` for each ``file, cyclones, names, waves_min``: counts, names that are missing, cyclones without a
    place in the basin or a wind, sections that were not told apart."""
    rows = expected.join(products.select("file", "basin"), "file", "left")
    spot = F.struct("cyclone", "lat", "lon", "wind_kt")
    found = tables["cyclones"].groupBy("file").agg(F.sort_array(F.collect_list(spot)).alias("x"))
    rows = rows.join(found, "file", "left")
    for name in ("waves", "sections"):
        rows = rows.join(tables[name].groupBy("file").agg(F.count("*").alias(f"n_{name}")), "file", "left")
    rows = rows.fillna(0, ["n_waves", "n_sections"])
    part = lambda test: F.transform(F.filter(F.coalesce("x", F.array().cast(dict(found.dtypes)["x"])), test), lambda v: v["cyclone"])
    off = part(lambda v: ~F.coalesce(sane(v["lat"], v["lon"], F.col("basin")), F.lit(False)))
    few = F.when(F.col("n_waves") < F.col("waves_min"), F.array(F.concat(F.lit("waves-min:"), F.col("waves_min").cast("string"), F.lit("/got:"), F.col("n_waves").cast("string"))))
    told = F.concat(
        _told("cyclone-count", F.col("cyclones"), F.greatest(F.coalesce(F.size("x"), F.lit(0)), F.lit(0))), _named("missing-cyclone", _lost(F.col("names"), part(lambda v: F.lit(True)))),
        _named("cyclone-out-of-basin", off), _named("cyclone-no-wind", part(lambda v: v["wind_kt"].isNull())), F.coalesce(few, F.array().cast("array<string>")), _if(F.col("n_sections") <= 1, "sections-not-split"),
    )
    return rows.select("file", told.alias("flags"))


def expected_advisories(expected: DataFrame, products: DataFrame, parsed: DataFrame) -> DataFrame:
    """``file, flags`` for each ``file, classification, name, post_tropical``: the flags of the audit, and what was read otherwise than expected."""
    audited = audit_advisories(products, parsed).withColumnRenamed("flags", "_flags")
    got = parsed.select("file", F.col("classification").alias("_class"), F.col("name").alias("_name"), F.exists("track", lambda p: F.coalesce(p["state"] == "post-tropical", F.lit(False))).alias("_post"), F.lit(True).alias("_read"))
    rows = expected.join(got, "file", "left").join(audited, "file", "left")
    other = F.concat(_told("expected-classification", F.col("classification"), F.col("_class")), _told("expected-name", F.col("name"), F.col("_name")))
    tagged = _if(F.col("post_tropical") & ~F.coalesce("_post", F.lit(False)), "no-post-trop-tag")
    told = F.when(F.col("_read").isNull(), F.array(F.lit("parse-null"))).otherwise(F.concat(other, F.coalesce("_flags", F.array().cast("array<string>")), tagged))
    return rows.select("file", told.alias("flags"))


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row: products, flagged ones, and the sum of every count."""
    counts = [c for c, kind in audited.dtypes if kind in ("int", "bigint") and c != "file"]
    return audited.agg(F.count("*").alias("products"), F.count_if(F.size("flags") > 0).alias("flagged"), *(F.sum(c).cast("long").alias(c) for c in counts))


def flag_counts(audited: DataFrame) -> DataFrame:
    return audited.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def diff_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """How many features a later product moved, brought and lost; ``change`` is paired, added or removed."""
    count = lambda c: F.count_if(F.col("change") == c)
    return pairs.groupBy(*keys).agg(count("paired").alias("moved"), count("added").alias("new"), count("removed").alias("gone"))
