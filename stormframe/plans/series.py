"""Stated odds as steps over time, and the windows of a chain's ruler."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stormframe.functions.scalars import plus_hours, stamp_time, time_stamp

#: Hours of the longer horizon: a chain's last statement is open that long.
WINDOW_HOURS = 168


def step_series(statements: DataFrame) -> DataFrame:
    """``basin, chain_id, horizon, k, stamp, x, pct, previous, segment`` from ``basin, chain_id, stamp, horizon, pct``, a row a statement.

    ``x`` is true to time: a series of n statements is n - 1 wide, whatever its
    gaps. A statement without odds has none, and parts the steps before it from
    those after; ``previous`` is the level that a step comes from, null where a
    segment begins.
    """
    order = Window.partitionBy("basin", "chain_id", "horizon").orderBy("stamp")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    time = F.unix_seconds(stamp_time(F.col("stamp")))
    span = F.max(time).over(whole) - F.min(time).over(whole)
    told = statements.select("basin", "chain_id", "horizon", "stamp", "pct").withColumn("k", F.row_number().over(order) - 1)
    told = told.withColumn("x", F.when(span > 0, (time - F.min(time).over(whole)) / span * (F.count("*").over(whole) - 1)).otherwise(F.lit(0.0)))
    before = F.lag("pct").over(order)
    begins = (F.col("pct").isNotNull() & before.isNull()).cast("int")
    told = told.withColumns({"previous": F.when(F.col("pct").isNotNull(), before), "_new": begins})
    return told.withColumn("segment", F.when(F.col("pct").isNotNull(), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_new")


def on_grid(statements: DataFrame, hours: int) -> DataFrame:
    """``basin, chain_id, horizon, at, pct`` every so many hours from a series' first statement to its last.

    The odds in force at a time are those of the last statement at or before it;
    where that states none, they are null. Each statement fills the times up to
    the next, so no row is compared with another series' times.
    """
    order = Window.partitionBy("basin", "chain_id", "horizon").orderBy("stamp")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    step = F.lit(hours * 3600)
    time = F.unix_seconds(stamp_time(F.col("stamp")))
    rows = statements.filter(stamp_time(F.col("stamp")).isNotNull()).withColumns({"_t": time, "_first": F.min(time).over(whole), "_last": F.max(time).over(whole)})
    rows = rows.withColumn("_end", F.coalesce(F.lead("_t").over(order), F.col("_last") + 1) - 1)
    low = F.ceil((F.col("_t") - F.col("_first")) / step)
    high = F.floor((F.col("_end") - F.col("_first")) / step)
    ticks = rows.filter(low <= high).withColumn("_k", F.explode(F.sequence(low, high)))
    at = time_stamp(F.timestamp_seconds(F.col("_first") + F.col("_k") * step))
    return ticks.select("basin", "chain_id", "horizon", at.alias("at"), "pct")


def ruler_windows(records: DataFrame, statements: DataFrame) -> DataFrame:
    """``basin, chain_id, starts, ends, kind``: disjoint spans of a chain's ruler that are pending, unresolved, or both.

    Pending is what is left of the seven days after the last sighting, from now
    on, unless the chain formed; unresolved runs from the first statement whose
    verdict is (else from the first sighting) to the first near cyclone, no
    earlier than the last sighting and no later than the ruler's end. ``records``
    has ``first_stamp, last_stamp, now, outcome, near_stamp``; ``statements`` has ``chain_id, stamp, verdict``.
    """
    first = statements.filter("verdict = 'unresolved'").groupBy("chain_id").agg(F.min("stamp").alias("_doubt"))
    t = lambda c: stamp_time(F.col(c))
    rows = records.join(first, "chain_id", "left")
    end = plus_hours(t("last_stamp"), WINDOW_HOURS)
    pending = (end > t("now")) & (t("now") >= t("first_stamp")) & (F.col("outcome") != "formed")
    doubtful = F.col("outcome") == "unresolved-nearby-cyclone"
    until = F.when(F.col("near_stamp").isNull(), t("last_stamp")).otherwise(F.least(F.greatest(t("near_stamp"), t("last_stamp")), end))
    span = lambda test, low, high: F.when(test, F.struct(low.alias("a"), high.alias("z")))
    rows = rows.select("basin", "chain_id", span(pending, F.greatest(t("now"), t("last_stamp")), end).alias("p"), span(doubtful, F.coalesce(t("_doubt"), t("first_stamp")), until).alias("u"))
    # The ends of both spans cut the ruler; each piece has what covers it.
    cuts = F.array_sort(F.array_distinct(F.array_compact(F.array("p.a", "p.z", "u.a", "u.z"))))
    pieces = F.when(F.size("cuts") > 1, F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda k: F.struct(F.element_at("cuts", k).alias("a"), F.element_at("cuts", k + 1).alias("z"))))
    cut = rows.withColumn("cuts", cuts).withColumn("piece", F.explode(pieces))
    covered = lambda s: F.coalesce((F.col(f"{s}.a") <= F.col("piece.a")) & (F.col("piece.z") <= F.col(f"{s}.z")), F.lit(False))
    kind = F.when(covered("p") & covered("u"), "both").when(covered("p"), "pending").when(covered("u"), "unresolved")
    out = cut.select("basin", "chain_id", time_stamp(F.col("piece.a")).alias("starts"), time_stamp(F.col("piece.z")).alias("ends"), kind.alias("kind"))
    return out.filter("kind IS NOT NULL")
