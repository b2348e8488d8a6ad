"""What is shown of a change; expected notes are stated rules."""

from pyspark.sql import functions as F

from stormframe.plans import changes

AREA = "change string, old string, previous_lat double, previous_lon double, lat double, lon double, previous_chance48 int, chance48 int, previous_chance7 int, chance7 int"


def test_areas(spark):
    rows = [
        ("paired", "8 AM", 10.0, -40.0, 11.0, -41.0, 40, 60, 70, 70),
        ("paired", "8 AM", 10.0, -40.0, 10.0, -40.0, 40, 20, None, 70),
        ("paired", "8 AM", None, None, 10.0, -40.0, 40, 60, 70, 80),
        ("paired", None, 10.0, -40.0, None, None, None, None, 70, None),
        ("removed", "8 AM", 10.0, -40.0, None, None, 10, None, 20, None),
        ("removed", "8 AM", None, None, None, None, 10, None, 20, None),
        ("added", "8 AM", None, None, 10.0, -40.0, None, 10, None, 20),
    ]
    shown = changes.area_changes(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, " + AREA))
    assert [(x["moved"], x["drawn"], x["note"]) for x in shown.orderBy("k").collect()] == [
        (True, True, "was here · 8 AM · 48h 40%→60% ▲ · 7d 70%"),
        (False, True, "8 AM · 48h 40%→20% ▼ · 7d n/a→70%"),
        (False, False, None),
        (False, True, "previous issuance · 48h n/a · 7d 70%→n/a"),
        (False, True, "gone from this issuance · 8 AM"),
        (False, False, None),
        (False, False, None),
    ]
    (total,) = changes.change_totals(shown.withColumn("p", F.lit(1)), ["p"]).collect()
    assert tuple(total) == (1, 1, 1, 2, "Δ vs 8 AM: 1 moved · 1 new · 2 gone")
    assert changes.change_totals(shown.limit(0), ["change"]).collect() == []


def test_cyclones_and_waves(spark):
    c = spark.createDataFrame([(1, "paired", "8 AM", 10.0, 40, 55), (2, "paired", "8 AM", 10.0, 55, 40), (3, "paired", "8 AM", 10.0, None, 40), (4, "removed", "8 AM", 10.0, 40, None)], "k int, change string, old string, previous_lat double, previous_wind_kt int, wind_kt int")
    notes = [x["note"] for x in changes.cyclone_changes(c).orderBy("k").collect()]
    assert notes == ["was here · 8 AM · 40→55 kt ▲", "was here · 8 AM · 55→40 kt ▼", "was here · 8 AM", "gone from this issuance · 8 AM"]
    axis = lambda *lons: [(10.0 + k, float(x)) for k, x in enumerate(lons)]
    w = spark.createDataFrame([(1, "paired", "8 AM", axis(-40, -41), axis(-42, -44)), (2, "paired", "8 AM", axis(-40), axis(-40.4)), (3, "removed", "8 AM", axis(-40), None), (4, "added", "8 AM", None, axis(-40))], "k int, change string, old string, previous_axis array<struct<lat: double, lon: double>>, axis array<struct<lat: double, lon: double>>")
    got = [(x["moved"], x["note"]) for x in changes.wave_changes(w).orderBy("k").collect()]
    assert got == [(True, "was here · 8 AM · moved ~3°"), (True, "was here · 8 AM"), (False, "gone from this issuance · 8 AM"), (False, None)]


def test_active_points(spark):
    c = spark.createDataFrame([("a", 10.0, -40.0), ("a", None, -40.0)], "file string, lat double, lon double")
    a = spark.createDataFrame([("b", 11.0, -41.0, "AL91"), ("b", 11.0, -41.0, "EP91"), ("b", None, None, "AL92"), ("b", 12.0, -42.0, None), ("b", 12.0, -42.0, "AL911")], "file string, lat double, lon double, invest string")
    assert sorted(map(tuple, changes.active_points(c, a).collect())) == [("a", 10.0, -40.0), ("b", 11.0, -41.0)]
