"""Kernels on literals; expected values are stated rules, not snapshots."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stormframe import queries
from stormframe.functions import geometry, scalars, text
from stormframe.operators import matching
from stormframe.plans import advisories, discussions, ledger, outlook
from stormframe.sources import products
from stormframe.streaming.alerts import AREAS, alert_stream, compare, load_state, messages

D = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("said, bearing, slow, fast", [("moving wnw at 12 kt", 292.5, 12, 12), ("moving west-northwest at 10-15", None, None, None), ("moving northwestward, or 320 degrees, at 9 kt", 320.0, 9, 9), ("nearly stationary", None, 0, 0), ("drifting west", 270.0, 0, 2), ("moving west at 10 to 15 mph", 270.0, 9, 13)])
def test_motion(spark, said, bearing, slow, fast):
    got = one(spark, text.motion(F.lit(said)))
    assert (got and (got["bearing"], got["slow_kt"], got["fast_kt"])) == (None if slow is None else (bearing, slow, fast))


@pytest.mark.parametrize("line, iso", [("805 AM EDT Sat Aug 8 2026", "2026-08-08T12:05:00"), ("0300 UTC Mon Jul 6 2026", "2026-07-06T03:00:00"), ("1230 AM EST Sun Nov 1 2026", "2026-11-01T05:30:00"), ("1215 PM AST Sun Nov 1 2026", "2026-11-01T16:15:00"), ("100 PM XYZ Sun Nov 1 2026", None)])
def test_issued(spark, line, iso):
    got = one(spark, text.issued_time(F.lit(line)).cast("timestamp_ntz"))
    assert (got and got.isoformat()) == iso


def test_scalars(spark):
    assert one(spark, scalars.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, scalars.forecast_hours(F.lit(30), F.lit(21), F.lit(1), F.lit(6))) == 33
    assert one(spark, scalars.cone_radius(F.lit(6), F.lit("XX"))) == 17.5
    assert one(spark, scalars.stamp_time(F.lit("202602300000"))) is None
    assert one(spark, scalars.tenths_to_degrees(F.lit("742W"))) == -74.2
    assert one(spark, scalars.area_key(F.lit(None), F.lit(15.5), F.lit(-61.3), F.lit(""))) == "G15,-60"
    assert one(spark, scalars.area_key(F.lit(None), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit("A low"))) == "SA low"
    assert one(spark, scalars.is_stale(F.lit(None).cast("timestamp"), F.current_timestamp())) is True
    assert one(spark, F.array_max(F.transform(geometry.quadrant_ring(F.lit(10.0), F.lit(0.0), [F.lit(150.0)] * 4), lambda p: p["lat"]))) == 12.5


TWO = "ABNT20 KNHC 081146\nTWOAT\n\nFor the North Atlantic...Caribbean Sea:\n\n1. Western Gulf (AL92):\nA low is near the coast.\n\n* Formation chance through 48 hours...low...near 20 percent.\n* Formation chance through 7 days...medium...50 percent.\n\n$$"


def test_outlook(spark):
    files = spark.createDataFrame([("TWOAT.202608081146.txt", TWO), ("notes.txt", "x")], "file string, text string")
    rows = outlook.disturbances(products.name_products(files), {"gulf": (25.0, -90.0), "western gulf": (24.0, -95.0)}).collect()
    assert [(r["invest"], r["lat"], r["lon"], tuple(r["chance48"]), tuple(r["chance7"])) for r in rows] == [("AL92", 24.0, -95.0, ("low", 20), ("medium", 50))]


def test_best_track(spark):
    line = "AL, 01, 20260618{h}, , BEST, 0, 255N, 742W, {v}, 1000, {s}" + ", " * 17 + "{n}, genesis-num, 007, SPAWNINVEST, al902026 to al012026"
    text_ = [line.format(h="00", v="30", s="DB", n="INVEST"), line.format(h="06", v="x", s="TD", n="ONE"), line.format(h="06", v="40", s="TS", n="ANNA")]
    lines = spark.createDataFrame([("bal012026.202606180600.dat", k, t) for k, t in enumerate(text_)], "file string, n int, line string")
    f = products.best_track_files(lines).first()
    assert (f["names"], f["genesis_num"], f["refs"], f["first_td_dtg"], f["max_dtg"], f["num"]) == (["ONE", "ANNA"], "007", ["al012026", "al902026"], "202606180600", "202606180600", 1)
    assert sorted((r["dtg"], r["vmax"]) for r in products.best_track_fixes(lines).collect()) == [("202606180000", 30), ("202606180600", 0)]


def test_greedy_rounds_equal_the_fold(spark):
    r = random.Random(3)
    # Ties of distance, repeated candidates, a chain in which each waits for the next, a group of null, a side that is a struct.
    rows = [(g, i, j, float(r.randrange(8))) for g in ("a", None) for i in range(12) for j in range(12) if r.random() < 0.6] * 2
    rows += [("chain", (k + 1) // 2, k // 2, 20.0 - k) for k in range(14)]
    c = spark.createDataFrame(rows, "g string, i int, j int, d double").withColumn("i", F.struct("i"))
    told = lambda f, of: sorted(map(str, f(of, ["g"], "i", "j", "d").collect()))
    assert told(matching.greedy_rounds, c) == told(matching.greedy_pairs, c)
    odd = c.unionByName(spark.sql("SELECT 'a' AS g, CAST(NULL AS STRUCT<i: INT>) AS i, 1 AS j, 0D AS d UNION ALL SELECT 'a', struct(1), 1, NULL"))
    assert told(matching.greedy_rounds, odd) == told(matching.greedy_pairs, c)
    assert told(matching.greedy_rounds, c.limit(0)) == []


def test_greedy_rounds_of_a_large_group(spark):
    pairs = spark.range(10_000).select(F.lit("g").alias("g"), (F.col("id") / 100).cast("int").alias("i"), (F.col("id") % 100).cast("int").alias("j"))
    c = pairs.withColumn("d", F.pmod(F.xxhash64("i", "j"), F.lit(500)).cast("double"))
    free, expected = (set(), set()), set()
    for d, i, j in sorted((x["d"], x["i"], x["j"]) for x in c.collect()):
        if i not in free[0] and j not in free[1]:
            free[0].add(i)
            free[1].add(j)
            expected.add((i, j, d))
    assert {(x["i"], x["j"], x["d"]) for x in matching.greedy_rounds(c, ["g"], "i", "j", "d").collect()} == expected


def test_greedy(spark):
    c = spark.createDataFrame([("g", 1, 1, 2.0), ("g", 1, 2, 1.0), ("g", 2, 2, 0.5), ("g", 2, 1, 3.0)], "g string, i int, j int, d double")
    assert sorted(tuple(r) for r in matching.greedy_pairs(c, ["g"], "i", "j", "d").collect()) == [("g", 1, 1, 2.0), ("g", 2, 2, 0.5)]


def test_verdict_order(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    v = lambda g, n, now: one(spark, ledger.statement_verdict(t("2026-06-01"), 48, F.lit(20), t(g), t(n), t(now)))
    assert [v("2026-06-02", None, "2026-07-01"), v("2026-06-05", "2026-06-02", "2026-06-02"), v(None, "2026-06-02", "2026-07-01"), v("2026-06-04", None, "2026-07-01")] == ["formed", "pending", "unresolved", "not-formed"]


def area(key, tag=None, odds=None):
    return {"key": key, "tag": tag, "odds": odds, "place": None}


def test_alerts(spark, tmp_path):
    known = [area("A", odds=35), area("B", odds=55), area("CP91", "CP91", 10)]
    told = compare([area("A", odds=65), area("B", odds=55), area("AL91", "AL91"), area("CP90", "CP90", 10), area("CP91", "CP91", 20)], known)
    assert [(k, a["key"], t, w) for k, a, t, w in told] == [("threshold", "A", 40, 35), ("new-invest", "AL91", None, None), ("new-area", "CP90", None, None)]
    assert compare([area("A", odds=65)], None) == []
    assert load_state('{"product": "x", "areas": []}') == {"AT": {"product": "x", "areas": []}, "EP": None} and load_state(None) == {"AT": None, "EP": None}
    # The second product has no area: what it forgets is new when it comes back, in a batch of its own.
    rows = [("AT", "1", [("A", None, 35, None)]), ("AT", "2", [("A", None, 45, "Gulf"), ("G5,5", None, 10, None)]), ("AT", "3", []), ("AT", "2", [("A", None, 45, None)]), ("AT", "4", [("A", None, 45, None)])]
    schema = f"basin string, product string, areas {AREAS}"
    for k, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = alert_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["product"], r["kind"], r["area"], r["threshold"]) for r in out.collect()) == [("2", "new-area", "G5,5", None), ("2", "threshold", "A", 40), ("4", "new-area", "A", None)]
    assert {r["title"] for r in messages(out).collect()} == {"New Atlantic disturbance", "7-day chance now 45% (Gulf)"}


def test_append_and_upsert(spark):
    new = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, t string")
    old = spark.createDataFrame([("a", "x"), ("b", "q")], "k string, t string")
    assert {r["k"]: r["action"] for r in products.upsert_actions(new, old, ["k"], "t").collect()} == {"a": "skip", "b": "overwrite", "c": "write"}
    assert [r["k"] for r in products.new_rows(new, old, "k").collect()] == ["c"]


@pytest.mark.parametrize("name", ["calibration", "gap_chains", "asof_last", "cone_radius", "outcome_matrix", "full_outer_diff", "advisory_fields", "convection_boxes", "point_fixes"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem", "part", "customer"):
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    told = con.execute(f"select {', '.join(cols)} from ({queries.SQL[name]})").fetchall()
    key = lambda r: tuple(round(float(v), 6) if isinstance(v, float) else str(v) for v in r)
    assert sorted(map(str, map(key, told))) == sorted(map(str, map(key, df.select(cols).collect())))


TCM = """TROPICAL STORM ANNA-LEE SPECIAL FORECAST/ADVISORY NUMBER  7
NWS SOMEWHERE        EP092031
2100 UTC THU JUN 12 2031

TROPICAL STORM CENTER LOCATED NEAR 14.5N 110.0W AT 12/2100Z
PRESENT MOVEMENT TOWARD THE WEST OR 270 DEGREES AT  10 KT
ESTIMATED MINIMUM CENTRAL PRESSURE  999 MB
MAX SUSTAINED WINDS  50 KT WITH GUSTS TO  60 KT.
50 KT.......  0NE   0SE   0SW   0NW.
34 KT....... 60NE  40SE  30SW  50NW.
12 FT SEAS..120NE  90SE  90SW 120NW.

FORECAST VALID 13/0600Z 14.6N 111.5W
MAX WIND  55 KT...GUSTS  65 KT.
50 KT... 20NE  20SE   0SW  20NW.

OUTLOOK VALID 15/1800Z 16.0N 118.0W...POST-TROPICAL
MAX WIND  30 KT

OUTLOOK VALID 16/1800Z...DISSIPATED
"""


def test_advisory_and_cone(spark):
    rows = spark.createDataFrame([("a", TCM), ("b", "NO HEADER"), ("c", None), ("d", TCM.split("FORECAST VALID")[0])], "file string, text string")
    got = {r["file"]: r for r in advisories.with_cone(advisories.advisories(rows)).collect()}
    a = got["a"]
    assert set(got) == {"a", "d"} and got["d"]["cone"] is None and got["d"]["track"] == []
    assert (a["storm_id"], a["name"], a["classification"], a["advisory"], a["issued"]) == ("EP092031", "Anna-Lee", "Tropical Storm", 7, "12/2100Z")
    assert (a["wind_kt"], a["gust_kt"], a["pressure_mb"], tuple(a["center"])) == (50, 60, 999, (14.5, -110.0))
    assert {k: tuple(v) for k, v in a["wind_radii"].items()} == {34: (60, 40, 30, 50)}
    assert [(p["hours"], p["lon"], p["wind_kt"], p["state"]) for p in a["track"]] == [(9, -111.5, 55, None), (69, -118.0, 30, "post-tropical")]
    assert len(a["cone"]) == 2 * 3 + 14 and min(p["lon"] for p in a["cone"]) < -118


def test_boxes_and_fixes(spark):
    body = "Isolated strong is from 07N to 11N between 40W and\n50W." + " x" * 60 + " Convection from 12N to 10N between 20W and 10W, centered at 9.5N45W" + " y" * 30 + " strong convection"
    rows = spark.createDataFrame([("s", body), ("t", ""), ("u", None)], "section string, body string")
    boxes = discussions.convection_boxes(rows).orderBy("south").collect()
    assert [tuple(b)[:6] for b in boxes] == [("s", 7.0, 11.0, -50.0, -40.0, True), ("s", 10.0, 12.0, -20.0, -10.0, False)]
    assert [tuple(b)[:3] for b in discussions.point_fixes(rows).collect()] == [("s", 9.5, -45.0)]
