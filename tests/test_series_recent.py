"""Steps, ruler spans, recent products with failures, expectations, and the rules that earlier rounds had otherwise."""

import json

import pytest
from pyspark.sql import functions as F

from stormframe.functions import text
from stormframe.plans import audit, discussions, outlook, series
from stormframe.plans.places import PLACES
from stormframe.sources import products, recent
from stormframe.streaming import alerts


def test_steps_and_grid(spark):
    rows = [("2026060100" + "00", 20), ("202606010600", None), ("202606011200", 40), ("202606020000", 60)]
    s = spark.createDataFrame([("AT", "I1", 48, t, p) for t, p in rows] + [("AT", "I2", 48, "202606010000", 10)], "basin string, chain_id string, horizon int, stamp string, pct int")
    got = [(r["x"], r["pct"], r["previous"], r["segment"]) for r in series.step_series(s).filter("chain_id = 'I1'").orderBy("k").collect()]
    assert got == [(0.0, 20, None, 1), (0.75, None, None, None), (1.5, 40, None, 2), (3.0, 60, 40, 2)]
    assert [r["x"] for r in series.step_series(s).filter("chain_id = 'I2'").collect()] == [0.0]
    grid = [(r["at"][6:10], r["pct"]) for r in series.on_grid(s, 5).filter("chain_id = 'I1'").orderBy("at").collect()]
    assert grid == [("0100", 20), ("0105", 20), ("0110", None), ("0115", 40), ("0120", 40)]


def test_ruler_spans(spark):
    r = [
        ("A", "202606010000", "202606050000", "202606060000", "no-cyclone", None),
        ("B", "202606010000", "202606050000", "202606060000", "unresolved-nearby-cyclone", "202606080000"),
        ("C", "202606010000", "202606050000", "202607060000", "unresolved-nearby-cyclone", None),
        ("D", "202606010000", "202606050000", "202606060000", "formed", None),
        ("E", "202606010000", "202606050000", "202607060000", "no-cyclone", None),
    ]
    records = spark.createDataFrame([("AT", *x) for x in r], "basin string, chain_id string, first_stamp string, last_stamp string, now string, outcome string, near_stamp string")
    told = spark.createDataFrame([("B", "202606020000", "unresolved"), ("B", "202606010000", "pending")], "chain_id string, stamp string, verdict string")
    got = sorted((x["chain_id"], x["starts"][6:8], x["ends"][6:8], x["kind"]) for x in series.ruler_windows(records, told).collect())
    assert got == [("A", "06", "12", "pending"), ("B", "02", "06", "unresolved"), ("B", "06", "08", "both"), ("B", "08", "12", "pending"), ("C", "01", "05", "unresolved")]


def test_recent_products(spark, tmp_path):
    folder = tmp_path / "landed"
    folder.mkdir()
    (folder / "list.json").write_text(json.dumps({"@graph": [{"@id": f"https://x/products/p{k}"} for k in range(5)]}))
    for k, body in {0: '{"productText": "TWDAT a"}', 1: "no json", 3: '{"productText": "TCMAT1 b"}', 4: '{"productText": "TWDAT c"}'}.items():
        (folder / f"p{k}.json").write_text(body)
    got = recent.recent_products(spark, str(folder), newest=4)
    assert got.rdd.getNumPartitions() == 4
    assert [(r["place"], r["text"], r["error"]) for r in got.orderBy("place").collect()] == [(0, "TWDAT a", None), (1, "", "JSONDecodeError"), (2, "", "FileNotFoundError"), (3, "TCMAT1 b", None)]
    assert [r["place"] for r in recent.newest_with(got, "TCMAT1").collect()] == [3] and recent.newest_with(got, "TWDEP").count() == 0
    (folder / "list.json").write_text("{}")
    assert recent.recent_products(spark, f"file://{folder}").count() == 0
    with pytest.raises(Exception, match="none|No such|FileNotFound|Errno"):
        recent.recent_products(spark, str(tmp_path / "none")).collect()


def test_products_are_read_whole(spark, tmp_path):
    (tmp_path / "AT").mkdir()
    (tmp_path / "AT" / "TWOAT.202606010000.txt").write_bytes(b"one\r\ntwo\n")
    (tmp_path / "x.txt").write_bytes(b"other")
    (tmp_path / "bal902026.202606010600.dat").write_bytes(b"a, b\r\nc, d")
    assert [(r["file"], r["text"]) for r in products.read_products(spark, str(tmp_path)).collect()] == [("TWOAT.202606010000.txt", "one\ntwo\n")]
    assert [(r["n"], r["line"]) for r in products.read_best_tracks(spark, str(tmp_path)).orderBy("n").collect()] == [(0, "a, b"), (1, "c, d")]


def test_places_keep_line_breaks_and_drop_articles(spark):
    at = lambda phrase: spark.range(1).select(outlook.resolve_place(F.lit(phrase), PLACES["AT"]).alias("p")).first()["p"]
    middle = at("a low between hispaniola and the southeastern bahamas.")
    assert middle["lat"] == 20.5 and at("a low between hispaniola and the\nsoutheastern bahamas.")["lat"] == 19.0
    assert at("The Bahamas (AL91)") is None and tuple(at("between the Bahamas and Cuba")) == (24.3, -76.0)
    assert at("well southwest of the\nJamaica") is None and at("just south of Jamaica") is not None
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.rejoin_wraps(F.lit("upper-\n \n\t level low"))) == "upper-level low"


def test_areas_come_by_number(spark):
    found = spark.createDataFrame([("f", f"D{k}", None, None, None, f"{k}. Area {k}: x", 10 * k) for k in (10, 2, 1, 11)], "file string, id string, invest string, lat double, lon double, source string, pct int")
    found = found.withColumn("chance7", F.struct("pct"))
    p = spark.createDataFrame([("f", "AT")], "file string, basin string")
    assert [a["place"] for a in alerts.product_areas(p, found).first()["areas"]] == ["Area 1", "Area 2", "Area 10", "Area 11"]


def test_expected_discussions(spark):
    body = "000\nAXNT20 KNHC 010000\nTWDAT\n\n...SPECIAL FEATURES...\n\nTropical Storm Ana is centered near 20.0N 60.0W at 01/0000 UTC moving W at 10 kt. Maximum sustained wind speed is 45 kt.\n\n...TROPICAL WAVES...\n\nA tropical wave is along 40W south of 15N, moving W at 10 kt.\n"
    p = products.name_products(spark.createDataFrame([("TWDAT.202606010000.txt", body), ("TWDAT.202606010600.txt", "nothing here")], "file string, text string"))
    e = spark.createDataFrame([("TWDAT.202606010000.txt", 1, ["ANA"], 1), ("TWDAT.202606010600.txt", 1, ["Bob"], 2), ("TWDAT.202606011200.txt", 0, [], None)], "file string, cyclones int, names array<string>, waves_min int")
    got = {r["file"][12:16]: r["flags"] for r in audit.expected_discussions(e, p, discussions.discussion_features(p)).collect()}
    assert got == {"0100": [], "0106": ["cyclone-count:1/got:0", "missing-cyclone:Bob", "waves-min:2/got:0", "sections-not-split"], "0112": ["sections-not-split"]}
