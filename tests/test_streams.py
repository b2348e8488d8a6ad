"""Streams that are stopped and started again: ingest, merge, state with a start, and timers."""

import datetime
import os
import shutil

from pyspark.sql import functions as F

from stormframe.streaming import ingest, stateful


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


def test_products_are_appended_once(spark, tmp_path):
    landed, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    run = lambda: ingest.ingest_products(spark, landed, table, state).awaitTermination(90)
    told = lambda: sorted((r["file"], r["kind"], r["basin"], r["season"], r["text"]) for r in spark.read.parquet(table).withColumn("season", F.col("season").cast("string")).collect())
    put(landed, "TWOAT.202606010000.txt", "a\r\nb")
    put(landed, "other.txt", "x")
    run()
    first = [("TWOAT.202606010000.txt", "TWO", "AT", "2026", "a\nb")]
    assert told() == first
    put(landed, "TWDEP.202606010600.txt", "c")
    put(landed + "/again", "TWOAT.202606010000.txt", "changed")
    run()
    assert told() == sorted([*first, ("TWDEP.202606010600.txt", "TWD", "EP", "2026", "c")])
    shutil.rmtree(state)  # a run that lost its checkpoint reads all files again
    run()
    assert len(told()) == 2
    # A batch that was written but not committed comes again.
    ingest.append_products(spark.createDataFrame([("TWDEP.202606010600.txt", "c")], "file string, text string"), table)
    assert len(told()) == 2


ROW = "AL, 90, {dtg}, , BEST, 0, 120N, 0300W, {kt}, 1008, DB"


def rows(*fixes):
    return "\n".join(ROW.format(dtg=d, kt=k) for d, k in fixes)


def test_snapshots_merge(spark, tmp_path):
    landed, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    run = lambda: ingest.ingest_snapshots(spark, landed, table, state).awaitTermination(90)
    versions = lambda: sorted(d for d in os.listdir(f"{table}/season=2026"))
    kept = lambda: {(r["base"], r["stamp"]): r["text"] for r in ingest.current_snapshots(spark, table).collect()}
    early, late = rows(("2026060100", 20), ("2026060106", 25)), rows(("2026060100", 20), ("2026060106", 25), ("2026060112", 30))
    put(landed, "bal902026.202606010600.dat", early)
    run()
    assert kept() == {("bal902026", "202606010600"): early} and versions() == ["version=1"]
    put(landed + "/b", "bal902026.202606010600.dat", early)  # equal bytes write nothing
    run()
    assert versions() == ["version=1"]
    changed = early.replace(" 25,", " 35,")
    put(landed + "/c", "bal902026.202606010600.dat", changed)  # the same last time, other bytes
    put(landed + "/c", "bal902026.202606011200.dat", late)
    put(landed + "/c", "bep012026.202606010600.dat", early.replace("AL, 90", "EP, 01"))
    run()
    assert kept()[("bal902026", "202606010600")] == changed and len(kept()) == 3 and len(versions()) == 2
    # The same batch again: the same version, nothing else.
    batch = spark.createDataFrame([("bal902026.202606010600.dat", changed, datetime.datetime(2026, 6, 2))], "file string, text string, landed timestamp")
    ingest.merge_snapshots(batch, table, 9)
    assert len(versions()) == 2
    eras = {(r["base"], r["stamp"]) for r in ingest.current_eras(ingest.current_snapshots(spark, table)).collect()}
    assert eras == {("bal902026", "202606011200"), ("bep012026", "202606010600")}


def test_alerts_start_from_stored_state(spark, tmp_path):
    spark.conf.set(*stateful.STATE_STORE)
    old = '{"product": "1", "areas": [{"key": "A", "tag": null, "odds": 35, "place": null}]}'  # the form without basins
    start = stateful.stored_state(spark, old)
    schema = f"basin string, {stateful.HELD}"
    batches = [[("AT", "1", [("A", None, 90, None)]), ("AT", "2", [("A", None, 45, "Gulf")]), ("EP", "2", [("B", None, 50, None)])], [("AT", "3", [("A", None, 65, None), ("C", "AL91", None, None)]), ("EP", "3", [("B", None, 70, None)])]]
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stateful.alerts_from(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), start).writeStream.format("parquet").outputMode("append")
        q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r["basin"], r["product"], r["kind"], r["area"], r["threshold"], r["was"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("AT", "2", "threshold", "A", 40, 35), ("AT", "3", "new-invest", "C", None, None), ("AT", "3", "threshold", "A", 60, 45), ("EP", "3", "threshold", "B", 60, 50)]


def test_a_timer_settles_a_window(spark, tmp_path):
    spark.conf.set(*stateful.STATE_STORE)
    day = lambda d, h=0: datetime.datetime(2026, 6, d, h)
    schema = "chain_id string, kind string, at timestamp, horizon int, cat string"
    batches = [
        [("I1", "statement", day(1), 48, "low"), ("I1", "statement", day(1), 168, "low"), ("I2", "statement", day(1), 48, "high"), ("I3", "statement", day(1), 48, "medium"), (None, "statement", day(1), 48, "low"), ("I1", "noise", day(1), 48, None)],
        [("I2", "genesis", day(2), None, None), ("I3", "near", day(3), None, None)],
        [("I4", "statement", day(4), 48, "low")],
        [("I4", "genesis", day(7), None, None), ("I1", "genesis", day(8), None, None)],
        [("I5", "statement", day(20), 48, "low")],
        [("I5", "genesis", day(20, 6), None, None)],
    ]
    told = []
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stateful.settled_verdicts(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").outputMode("append")
        q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        told.append(sorted((r["chain_id"], r["horizon"], r["verdict"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert told[1] == [] and told[2] == [("I1", 48, "not-formed"), ("I2", 48, "formed"), ("I3", 48, "unresolved")]
    assert told[-1] == sorted([*told[2], ("I1", 168, "formed"), ("I4", 48, "not-formed")])
