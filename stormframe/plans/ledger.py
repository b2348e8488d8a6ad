"""Scores of stated odds: verdicts, calibration, agreement with best tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.functions.geometry import flat_distance
from stormframe.functions.scalars import hours_between, plus_hours, round_half_up, stamp_time, time_stamp
from stormframe.operators.matching import count_near, overlapping

HORIZONS = (48, 168)
CATEGORIES = ("low", "medium", "high")
VERDICTS = ("formed", "not-formed", "unresolved", "pending")


def chain_outcome(linked: Column, hours_since_last: Column, near: Column, open_hours: float = 18) -> Column:
    """formed, open, unresolved-nearby-cyclone or no-cyclone, in this precedence."""
    is_open = F.coalesce(hours_since_last <= open_hours, F.lit(False))
    return F.when(linked, "formed").when(is_open, "open").when(near, "unresolved-nearby-cyclone").otherwise("no-cyclone")


def statement_verdict(stated_at: Column, hours: int, stated: Column, genesis_at: Column, nearest_at: Column, now: Column) -> Column:
    """formed, pending, unresolved or not-formed, in this precedence; null where nothing was stated.

    Genesis and a nearby cyclone count from any time up to the window's end.
    """
    end = plus_hours(stated_at, hours)
    return F.when(
        stated.isNotNull() & end.isNotNull(),
        F.when(F.coalesce(genesis_at <= end, F.lit(False)), "formed")
        .when(end > now, "pending")
        .when(F.coalesce(nearest_at <= end, F.lit(False)), "unresolved")
        .otherwise("not-formed"),
    )


def observed_rate(formed: Column, not_formed: Column, digits: int = 3) -> Column:
    """Formed among the decided; null where none is."""
    return F.when(formed + not_formed > 0, round_half_up(formed.cast("double") / (formed + not_formed), digits))


def calibration(statements: DataFrame, grid: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """Counts of verdicts by group and category, with empty cells of the grid; a category outside it is left out."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    cells = statements.filter("verdict IS NOT NULL").groupBy(*by, "cat").agg(
        F.count("*").alias("statements"), *(count(v).alias(v.replace("-", "_")) for v in VERDICTS)
    )
    names = ("statements", *(v.replace("-", "_") for v in VERDICTS))
    full = grid.join(cells, [*by, "cat"], "left").select(*by, "cat", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))
    return full.withColumn("observed_rate", observed_rate(F.col("formed"), F.col("not_formed"), digits))


def agreement(ledger: Column, truth: Column) -> Column:
    """How an outcome of the ledger stands against the best tracks."""
    decided_not = truth.isin("not-formed", "no-genesis")
    return (
        F.when(truth.isNull(), "no-data")
        .when(ledger == "formed", F.when(truth == "formed", "confirms").otherwise("refutes"))
        .when(ledger == "open", F.when(truth == "open", "open").otherwise("resolves"))
        .when(truth == "open", "open")
        .when(ledger == "unresolved-nearby-cyclone", "resolves")
        .when(decided_not, "confirms")
        .otherwise("refutes")
    )


def truth_kind(cyclone_file: Column, first_td: Column, hours_since_invest: Column, open_hours: float = 12) -> Column:
    """What best-track files say: formed or no-genesis by a cyclone's file, open or not-formed by an invest's."""
    return F.when(cyclone_file, F.when(first_td.isNotNull(), "formed").otherwise("no-genesis")).when(
        hours_since_invest.isNotNull(), F.when(hours_since_invest <= open_hours, "open").otherwise("not-formed")
    )


# Degrees and hours within which a cyclone that no link claims leaves an invest unresolved.
NEAR_DEGREES, NEAR_TAIL_HOURS = 10.0, 48
#: Hours of the bins in which spans of chains and eras of files meet: about the length of one.
SPAN_HOURS = 240.0


def data_now(*tables: DataFrame) -> DataFrame:
    """One row with ``now``, the latest stamp of all tables: no clock is read."""
    stamps = None
    for df in tables:
        part = df.agg(F.max("at_stamp" if "at_stamp" in df.columns else "stamp").alias("now"))
        stamps = part if stamps is None else stamps.unionByName(part)
    return stamps.agg(F.max("now").alias("now"))


def chain_spans(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("basin", "chain_id").agg(F.first("tag", ignorenulls=True).alias("tag"), F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"))


def nearby_cyclones(invests: DataFrame, cyclones: DataFrame, links: DataFrame) -> DataFrame:
    """``basin, chain_id, cyclone_id, name, first_stamp, dist`` of cyclones that no invest is linked to and that open near one.

    A cyclone opens between an invest's first sighting and 48 hours after its last, within ten degrees of the
    sighting nearest in time; an unknown distance counts, as null.
    """
    claimed = links.filter("kind = 'invest-cyclone'").select(F.col("target").alias("cyclone_id"))
    first = cyclones.filter("seq = 1").select("basin", F.col("chain_id").alias("cyclone_id"), "name", F.col("stamp").alias("opens"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    first = first.join(claimed, "cyclone_id", "left_anti")
    spans = chain_spans(invests).withColumn("tail", time_stamp(plus_hours(stamp_time(F.col("last_stamp")), NEAR_TAIL_HOURS)))
    hour = lambda c: F.unix_seconds(stamp_time(F.col(c))) / F.lit(3600.0)
    spans = spans.withColumns({"_from": hour("first_stamp"), "_to": hour("tail")})
    met = overlapping(spans, first.withColumn("_at", hour("opens")), ["basin"], ("_from", "_to"), ("_at", "_at"), SPAN_HOURS)
    placed = invests.filter("lat IS NOT NULL AND lon IS NOT NULL").select("basin", "chain_id", "seq", F.col("stamp").alias("s_stamp"), "lat", "lon")
    far = F.abs(hours_between(stamp_time(F.col("s_stamp")), stamp_time(F.col("opens"))))
    keys = ["basin", "chain_id", "cyclone_id", "name", "opens", "c_lat", "c_lon"]
    nearest = met.select(*keys).join(placed, ["basin", "chain_id"], "left").groupBy(*keys).agg(F.min_by(F.struct("lat", "lon"), F.when(F.col("lat").isNotNull(), F.struct(far.alias("h"), "seq"))).alias("p"))
    dist = round_half_up(flat_distance(F.col("c_lat"), F.col("c_lon"), F.col("p.lat"), F.col("p.lon")), 3)
    out = nearest.select("basin", "chain_id", "cyclone_id", "name", F.col("opens").alias("first_stamp"), dist.alias("dist"))
    return out.filter(F.col("dist").isNull() | (F.col("dist") <= NEAR_DEGREES))


def _half_minutes(stamp: str) -> Column:
    """A stamp in half minutes, so that the middle between two stamps is a whole number."""
    return (F.unix_seconds(stamp_time(F.col(stamp))) / 30).cast("long")


def nearby_counts(invests: DataFrame, cyclones: DataFrame, links: DataFrame) -> DataFrame:
    """``basin, chain_id, n_near, near_stamp``: how many rows ``nearby_cyclones`` has of a chain, and the first stamp, without these rows.

    Each sighting counts the cyclones that open while it is the nearest in time. Cyclones without a position, and those
    of a chain without one, count by time alone: they are added up by stamp.
    """
    at = _half_minutes
    claimed = links.filter("kind = 'invest-cyclone'").select(F.col("target").alias("cyclone_id"))
    first = cyclones.filter("seq = 1").withColumn("cyclone_id", F.col("chain_id")).join(claimed, "cyclone_id", "left_anti")
    first = first.select("basin", at("stamp").alias("at"), "lat", "lon").filter("at IS NOT NULL")
    spans = chain_spans(invests).select("basin", "chain_id", at("first_stamp").alias("_from"), (at("last_stamp") + NEAR_TAIL_HOURS * 120).alias("_to"))
    chain = Window.partitionBy("basin", "chain_id")
    placed = invests.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("basin", "chain_id", at("stamp").alias("t")).agg(F.min(F.struct("seq", "lat", "lon")).alias("s"))
    # A sighting at an unknown time is nearest to all. Of two that are equally near the one of lower seq counts.
    placed = placed.withColumn("_none", F.max(F.col("t").isNull()).over(chain)).filter("t IS NULL OR NOT _none")
    order = chain.orderBy("t")
    before, after = (F.col("s.seq") < f("s").over(order)["seq"] for f in (F.lag, F.lead))
    edge = placed.withColumns(
        {"_lo": F.lag("t").over(order) + F.col("t") + F.when(before, 0).otherwise(2), "_hi": F.lead("t").over(order) + F.col("t") - F.when(after, 0).otherwise(2)}
    )
    # An edge is the sum of two stamps, twice the middle between them.
    own = edge.join(spans, ["basin", "chain_id"]).select(
        "basin", F.struct("basin", "chain_id").alias("id"), F.greatest("_from", F.ceil(F.col("_lo") / 2)).alias("lo"), F.least("_to", F.floor(F.col("_hi") / 2)).alias("hi"), F.col("s.lat").alias("lat"), F.col("s.lon").alias("lon")
    )
    close = count_near(own.filter("lo <= hi"), first.filter("lat IS NOT NULL AND lon IS NOT NULL"), NEAR_DEGREES, 3, 24 * 120)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    by_time = first.groupBy("basin", "at").agg(F.count_if(~known).alias("_some"), F.count("*").alias("_all"))
    met = overlapping(spans.join(placed.select("basin", "chain_id", F.lit(True).alias("_seen")).distinct(), ["basin", "chain_id"], "left"), by_time, ["basin"], ("_from", "_to"), ("at", "at"), 24 * 120)
    met = met.withColumn("n", F.when(F.col("_seen"), F.col("_some")).otherwise(F.col("_all"))).filter("n > 0")
    met = met.groupBy("basin", "chain_id").agg(F.sum("n").alias("n"), F.min("at").alias("first"))
    both = close.select("id.*", "n", "first").unionByName(met).groupBy("basin", "chain_id").agg(F.sum("n").alias("n_near"), F.min("first").alias("first"))
    return both.select("basin", "chain_id", "n_near", time_stamp(F.timestamp_seconds(F.col("first") * 30)).alias("near_stamp"))


def _records(invests: DataFrame, cyclones: DataFrame, links: DataFrame, now: DataFrame, near: DataFrame, family: DataFrame) -> DataFrame:
    """Rows of the ledger with what is given of nearby cyclones by chain and of chains by tag; ``_near`` tells whether any is near."""
    stated = invests.filter("chance48 IS NOT NULL OR chance7 IS NOT NULL").select("chain_id").distinct()
    spans = chain_spans(invests)
    made = links.filter("kind = 'invest-cyclone'").select("basin", F.col("source").alias("chain_id"), F.col("target").alias("cyclone_id"), F.col("at_stamp").alias("genesis_stamp"))
    names = cyclones.filter("seq = 1").select(F.col("chain_id").alias("cyclone_id"), F.col("name").alias("cyclone_name"))
    origin = links.filter("kind = 'wave-invest'").groupBy("basin", F.col("target").alias("chain_id")).agg(F.max_by("source", F.struct("at_stamp", "source")).alias("wave_id"))
    out = spans.join(stated, "chain_id").join(made, ["basin", "chain_id"], "left").join(names, "cyclone_id", "left").join(origin, ["basin", "chain_id"], "left")
    out = out.join(near.withColumn("_near", F.lit(True)), ["basin", "chain_id"], "left").join(family, ["basin", "tag"], "left").crossJoin(F.broadcast(now))
    since = hours_between(stamp_time(F.col("last_stamp")), stamp_time(F.col("now")))
    linked = F.col("cyclone_id").isNotNull()
    return out.withColumn("outcome", chain_outcome(linked, since, F.coalesce("_near", F.lit(False)))).withColumn("_linked", linked)


RECORD = ["basin", "chain_id", "tag", "first_stamp", "last_stamp", "wave_id", "cyclone_id", "cyclone_name", "genesis_stamp", "outcome"]


def ledger_records(invests: DataFrame, cyclones: DataFrame, links: DataFrame, now: DataFrame) -> DataFrame:
    """A row for each invest chain with a stated chance: its span, origin, outcome, nearby cyclones, and other chains of its tag.

    Lists grow with what is near; ``ledger_outcomes`` has their sizes and first stamp instead.
    """
    near = nearby_cyclones(invests, cyclones, links).groupBy("basin", "chain_id").agg(F.sort_array(F.collect_list(F.struct("cyclone_id", "name", "first_stamp", "dist"))).alias("nearby"))
    tagged = chain_spans(invests).filter("tag IS NOT NULL")
    # A tag is used again for few chains of a season.
    family = tagged.groupBy("basin", "tag").agg(F.sort_array(F.collect_list("chain_id")).alias("family"))
    out = _records(invests, cyclones, links, now, near, family)
    return out.select(
        *RECORD,
        F.when(F.col("_linked") | F.col("nearby").isNull(), F.array().cast("array<struct<cyclone_id:string,name:string,first_stamp:string,dist:double>>")).otherwise(F.col("nearby")).alias("nearby"),
        F.coalesce(F.array_remove("family", F.col("chain_id")), F.array().cast("array<string>")).alias("siblings"), "now",
    )


def ledger_outcomes(invests: DataFrame, cyclones: DataFrame, links: DataFrame, now: DataFrame) -> DataFrame:
    """``ledger_records`` with ``n_near, near_stamp, n_siblings`` in place of the lists, so that a row stays small in any season."""
    family = chain_spans(invests).filter("tag IS NOT NULL").groupBy("basin", "tag").agg(F.count("*").alias("_n"))
    out = _records(invests, cyclones, links, now, nearby_counts(invests, cyclones, links), family)
    return out.select(
        *RECORD, F.when(F.col("_linked"), 0).otherwise(F.coalesce("n_near", F.lit(0))).cast("long").alias("n_near"), F.when(~F.col("_linked"), F.col("near_stamp")).alias("near_stamp"),
        F.coalesce(F.col("_n") - 1, F.lit(0)).cast("long").alias("n_siblings"), "now",
    )


def ledger_statements(records: DataFrame, invests: DataFrame) -> DataFrame:
    """``basin, chain_id, stamp, horizon, cat, pct, verdict`` of each stated chance."""
    told = F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("chance")) for h, c in zip(HORIZONS, ("chance48", "chance7"), strict=True)))
    rows = invests.select("basin", "chain_id", "stamp", F.explode(told).alias("s")).filter("s.chance IS NOT NULL")
    earliest = F.col("near_stamp") if "near_stamp" in records.columns else F.array_min(F.transform("nearby", lambda n: n["first_stamp"]))
    known = records.select("basin", "chain_id", "genesis_stamp", earliest.alias("near_stamp"), "now")
    time = lambda c: stamp_time(F.col(c))
    verdict = F.coalesce(*(F.when(F.col("s.horizon") == h, statement_verdict(time("stamp"), h, F.col("s.chance"), time("genesis_stamp"), time("near_stamp"), time("now"))) for h in HORIZONS))
    return rows.join(known, ["basin", "chain_id"]).select("basin", "chain_id", "stamp", "s.horizon", "s.chance.cat", "s.chance.pct", verdict.alias("verdict"))


def calibration_total(cells: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """Cells summed over groups, by horizon and category, with the rate worked out anew."""
    names = ("statements", *(v.replace("-", "_") for v in VERDICTS))
    out = cells.groupBy(*by, "cat").agg(*(F.sum(n).alias(n) for n in names))
    return out.withColumn("observed_rate", observed_rate(F.col("formed"), F.col("not_formed"), digits))


def verdict_tally(statements: DataFrame) -> DataFrame:
    """How many statements of each basin have each verdict."""
    return statements.filter("verdict IS NOT NULL").groupBy("basin", "verdict").agg(F.count("*").alias("n"))
