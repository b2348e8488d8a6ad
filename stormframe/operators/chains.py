"""Chains: gaps, tag conflicts, crossings, sections, latest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.functions.scalars import hours_between

GAP_HOURS = 18


def gap_chains(rows: DataFrame, keys: list[str], at: str, order: list[str], gap_hours: float = GAP_HOURS) -> DataFrame:
    """Number the chains of each key from 1; a gap over the limit, or one that can't be measured, starts a new one."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    gap = hours_between(F.lag(at).over(w), F.col(at))
    fresh = F.coalesce(gap > gap_hours, F.lit(True)).cast("int")
    return rows.withColumn("_f", fresh).withColumn("chain", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_f")


def tag_segments(rows: DataFrame, keys: list[str], order: list[str], tag: str) -> DataFrame:
    """Number the stretches of each path that hold one tag: a tag that differs from the last known one starts a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(tag, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce(F.col(tag) != before, F.lit(False)).cast("int")
    return rows.withColumn("_b", breaks).withColumn("segment", 1 + F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def crossed(previous: Column, current: Column, thresholds: tuple[int, ...] = (40, 60)) -> Column:
    """The first threshold that a rise passed; null for none."""
    return F.coalesce(*(F.when((previous < t) & (current >= t), F.lit(t)) for t in thresholds))


def threshold_alerts(rows: DataFrame, keys: list[str], order: list[str], value: str, thresholds: tuple[int, ...] = (40, 60)) -> DataFrame:
    """Rows at which a value rose past a threshold."""
    w = Window.partitionBy(*keys).orderBy(*order)
    previous = F.lag(value).over(w)
    return rows.withColumn("previous", previous).withColumn("threshold", crossed(F.col("previous"), F.col(value), thresholds)).filter("threshold IS NOT NULL")


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order; one key's rows are cut before they are sorted together."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sections(rows: DataFrame, keys: list[str], text: str, header: str) -> DataFrame:
    """Cut texts into sections at lines that match ``header``; what comes before is PREAMBLE, empty ones go."""
    lines = rows.select(*keys, F.posexplode(F.split(text, "\n")).alias("n", "line"))
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("is_head", F.col("line").rlike(header)).withColumn("section", F.sum(F.col("is_head").cast("int")).over(w))
    out = lines.groupBy(*keys, "section").agg(
        F.coalesce(F.min(F.when(F.col("is_head"), F.col("line"))), F.lit("PREAMBLE")).alias("name"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_head"), F.struct("n", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    return out.filter(F.trim("body") != "")
