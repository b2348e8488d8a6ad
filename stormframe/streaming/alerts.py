"""Alerts on new areas and rising odds, as a stateful stream keyed by basin."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from stormframe.functions.scalars import area_key
from stormframe.functions.text import found

THRESHOLDS = (40, 60)
AREAS = "array<struct<key:string,tag:string,odds:int,place:string>>"
ALERT = "basin string, product string, kind string, area string, tag string, odds int, place string, threshold int, was int"
STATE = "state string"
# Fixed value: the invests that alert; central Pacific tags are known, but are no new invests.
_INVEST = re.compile(r"(AL|EP)9\d")


def product_areas(products: DataFrame, areas: DataFrame) -> DataFrame:
    """``basin, product, areas``: one row per product, with an empty array where it has no area, so that what is gone is forgotten."""
    # Fixed value: the title of an area.
    place = found(F.col("source"), r"^\s*\d+\.\s*(.+?)[:(]")
    item = F.struct(area_key(F.col("invest"), F.col("lat"), F.col("lon"), F.col("source")).alias("key"), F.col("invest").alias("tag"), F.col("chance7.pct").alias("odds"), F.trim(place).alias("place"))
    number = F.substring("id", 2, 9).cast("int").alias("n")
    per = areas.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(number, item.alias("a")))).alias("x"))
    per = per.select("file", F.transform("x", lambda v: v["a"]).alias("areas"))
    return products.join(per, "file", "left").select("basin", F.col("file").alias("product"), F.coalesce("areas", F.array().cast(AREAS)).alias("areas"))


def compare(areas: list[dict], known: list[dict] | None) -> list[tuple[str, dict, int | None, int | None]]:
    """Alerts of a product's areas against the last product's: ``kind, area, threshold, odds before``. A first product only primes.

    Of areas with one key the last known counts. A rise past two thresholds alerts on the lower.
    """
    if known is None:
        return []
    by_key, tags, out = {a["key"]: a for a in known}, {a["tag"] for a in known if a["tag"]}, []
    for area in areas:
        before = by_key.get(area["key"])
        if area["tag"] and _INVEST.fullmatch(area["tag"]) and area["tag"] not in tags:
            out.append(("new-invest", area, None, None))
        elif before is None:
            out.append(("new-area", area, None, None))
        elif before["odds"] is not None and area["odds"] is not None:
            passed = [t for t in THRESHOLDS if before["odds"] < t <= area["odds"]]
            if passed:
                out.append(("threshold", area, passed[0], before["odds"]))
    return out


def _areas(values) -> list[dict]:
    return [{"key": a["key"], "tag": a["tag"], "odds": None if a["odds"] is None else int(a["odds"]), "place": a["place"]} for a in values]


def load_state(text: str | None) -> dict:
    """The state of each basin from stored JSON; one without basins, of an older form, is the Atlantic's."""
    state = json.loads(text) if text else {}
    if "product" in state or "areas" in state:
        return {"AT": state, "EP": None}
    return {"AT": state.get("AT"), "EP": state.get("EP")}


def alert_stream(products: DataFrame) -> DataFrame:
    """Alerts of a stream of ``basin, product, areas`` rows, one per product.

    A product that comes again alerts no more. State is the last product's areas
    per basin, which is small however long the stream runs; a product without
    areas empties it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("product")
        held = json.loads(state.get[0]) if state.exists else None
        alerts = []
        for product, values in zip(rows["product"], rows["areas"], strict=True):
            if held is not None and product <= held["product"]:
                continue
            areas = _areas(values)
            for kind, a, threshold, was in compare(areas, held and held["areas"]):
                alerts.append((key[0], product, kind, a["key"], a["tag"], a["odds"], a["place"], threshold, was))
            held = {"product": product, "areas": areas}
        if held is not None:
            state.update((json.dumps(held),))
        out = pd.DataFrame(alerts, columns=[c.split()[0] for c in ALERT.split(", ")])
        yield out.astype({"odds": "Int32", "threshold": "Int32", "was": "Int32"})

    return products.groupBy("basin").applyInPandasWithState(step, ALERT, STATE, "append", "NoTimeout")


def messages(alerts: DataFrame) -> DataFrame:
    """``title, body, tags, priority`` of each alert, ready for a sink in ``foreachBatch``."""
    label = F.when(F.col("basin") == "EP", "East Pacific").otherwise("Atlantic")
    place, pct = F.coalesce("place", label), F.coalesce(F.concat(F.col("odds").cast("string"), F.lit("%")), F.lit("n/a"))
    chance = F.concat(place, F.lit(" \u2014 7-day formation chance "), pct, F.lit("."))
    is_kind = lambda k: F.col("kind") == k
    crossed = F.concat(F.lit("Crossed "), F.col("threshold").cast("string"), F.lit("% (was "), F.col("was").cast("string"), F.lit("%)."), F.coalesce(F.concat(F.lit(" "), "tag", F.lit(".")), F.lit("")))

    def pick(invest: Column, area: Column, rise: Column) -> Column:
        return F.when(is_kind("new-invest"), invest).when(is_kind("new-area"), area).otherwise(rise)

    return alerts.select(
        "basin", "product",
        pick(F.concat(F.lit("Invest "), "tag", F.lit(" designated")), F.concat(F.lit("New "), label, F.lit(" disturbance")), F.concat(F.lit("7-day chance now "), pct, F.lit(" ("), place, F.lit(")"))).alias("title"),
        pick(chance, chance, crossed).alias("body"),
        pick(F.lit("cyclone"), F.lit("eyes"), F.lit("chart_with_upwards_trend")).alias("tags"),
        pick(F.lit("4"), F.lit("3"), F.lit("4")).alias("priority"),
    )
