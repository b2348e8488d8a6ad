"""State that starts from a stored table, and timers that settle what is pending: alerts and verdicts as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from stormframe.plans.ledger import HORIZONS
from stormframe.streaming.alerts import ALERT, AREAS, _areas, compare, load_state

#: What a session needs for these streams.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HELD = f"product string, areas {AREAS}"


def stored_state(spark: SparkSession, text: str | None) -> DataFrame:
    """``basin, product, areas`` of a stored state file, of the present or of the older form, to start a stream from."""
    rows = [(basin, s["product"], [(a["key"], a.get("tag"), a.get("odds"), a.get("place")) for a in s.get("areas", [])]) for basin, s in load_state(text).items() if s]
    return spark.createDataFrame(rows, f"basin string, {HELD}")


class Alerts(StatefulProcessor):
    """The last product's areas of each basin; what comes after is compared with them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", HELD)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.last.update((row["product"], [tuple(a.values()) for a in _areas(row["areas"])]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        if self.last.exists():
            product, areas = self.last.get()
            held = {"product": product, "areas": [dict(zip(("key", "tag", "odds", "place"), a, strict=True)) for a in areas]}
        alerts = []
        for product, values in pd.concat(list(rows)).sort_values("product")[["product", "areas"]].itertuples(index=False, name=None):
            if held is not None and product <= held["product"]:
                continue
            areas = _areas(values)
            for kind, a, threshold, was in compare(areas, held and held["areas"]):
                alerts.append((key[0], product, kind, a["key"], a["tag"], a["odds"], a["place"], threshold, was))
            held = {"product": product, "areas": areas}
        if held is not None:
            self.last.update((held["product"], [tuple(a.values()) for a in held["areas"]]))
        out = pd.DataFrame(alerts, columns=[c.split()[0] for c in ALERT.split(", ")])
        yield out.astype({"odds": "Int32", "threshold": "Int32", "was": "Int32"})

    def close(self) -> None:
        pass


def alerts_from(products: DataFrame, start: DataFrame) -> DataFrame:
    """Alerts of a stream of ``basin, product, areas``, from the stored state ``basin, product, areas`` on."""
    return products.groupBy("basin").transformWithStateInPandas(Alerts(), StructType.fromDDL(ALERT), "append", "None", start.groupBy("basin"))


VERDICT = "chain_id string, stamp timestamp, horizon int, cat string, verdict string"
PENDING = "stamp timestamp, horizon int, cat string"


class Verdicts(StatefulProcessor):
    """The windows of a chain's statements that have not ended; a timer at the end of each settles it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PENDING)
        self.known = handle.getValueState("known", "genesis timestamp, near timestamp")

    def _known(self) -> list:
        return [*self.known.get()] if self.known.exists() else [None, None]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, new = self._known(), []
        for batch in rows:
            for kind, at, horizon, cat in batch[["kind", "at", "horizon", "cat"]].itertuples(index=False, name=None):
                if kind == "statement":
                    new.append((at.to_pydatetime(), int(horizon), cat))
                    self.handle.registerTimer(_ends(at, horizon))
                else:
                    k = 0 if kind == "genesis" else 1
                    known[k] = min(x for x in (known[k], at.to_pydatetime()) if x is not None)
        if any(known):
            self.known.update(tuple(known))
        if new:
            self.pending.appendList(new)
        yield _verdicts([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, known = expiredTimerInfo.getExpiryTimeInMs(), self._known()
        genesis, near = (None if t is None else _ms(t) for t in known)
        held, out = [*self.pending.get()], []
        for stamp, horizon, cat in held:
            end = _ends(stamp, horizon)
            if end == now:
                settled = "formed" if genesis is not None and genesis <= end else "unresolved" if near is not None and near <= end else "not-formed"
                out.append((key[0], stamp, horizon, cat, settled))
        left = [h for h in held if _ends(h[0], h[1]) != now]
        self.pending.put(left) if left else self.pending.clear()
        yield _verdicts(out)

    def close(self) -> None:
        pass


def _ms(time) -> int:
    return int(pd.Timestamp(time).value // 1_000_000)


def _ends(time, hours) -> int:
    return _ms(time) + int(hours) * 3_600_000


def _verdicts(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in VERDICT.split(", ")])
    return out.astype({"stamp": "datetime64[us]", "horizon": "int32"})


def settled_verdicts(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """``chain_id, stamp, horizon, cat, verdict`` of each statement, once its window has ended.

    ``events`` is a stream of ``chain_id, kind, at, horizon, cat``: a statement of
    odds for so many hours (48 or 168), a genesis, or the first sighting of a near
    cyclone. A window is formed if genesis came by its end, however early, else
    unresolved if a near cyclone did, else not formed. It is settled when all
    events up to its end are in, that is ``late`` after it by the events' own time.
    """
    kinds = f"(kind = 'statement' AND horizon IN {HORIZONS}) OR kind IN ('genesis', 'near')"
    known = events.filter("chain_id IS NOT NULL AND at IS NOT NULL").filter(kinds).withWatermark("at", late)
    return known.groupBy("chain_id").transformWithStateInPandas(Verdicts(), StructType.fromDDL(VERDICT), "append", "EventTime", eventTimeColumnName="")
