"""Passes, chains, links, ledger and truth on small bulletins and seasons; expected values are stated rules."""

import pytest
from pyspark.sql import functions as F

from stormframe.plans import audit, discussions, ledger, lineage, truth
from stormframe.sources import products, sinks

TWD = """AXNT20 KNHC 081146
TWDAT

...SPECIAL FEATURES...

A tropical depression or tropical storm is expected. Hurricane Otis
is centered near 14.5N 45.0W moving WNW at 12 kt. Maximum sustained
winds are 90 kt. Minimum central pressure is 970 mb.

...TROPICAL WAVES...

A tropical wave axis is along 33W, south of 17N, moving west at 10
to 15 kt.

A wave without place.

A tropical wave is near 61W-62W from 05N to 15N.

MONSOON TROUGH/ITCZ...

The monsoon trough extends from 11N15W to 09N25W. A ship near
09N25W reports rain. Convection is from 04N to 08N between 20W and
30W.

GULF OF AMERICA...

A low is near 27N85W. A disturbed area between Hispaniola and the
southeastern Bahamas bears watching. The wave over Jamaica is weak.
"""


def test_discussion(spark):
    rows = spark.createDataFrame([("a", "AT", TWD), ("b", "AT", None), ("c", "AT", "")], "file string, basin string, text string")
    t = discussions.discussion_features(rows)
    assert [r["name"] for r in t["sections"].orderBy("section").collect()] == ["PREAMBLE", "SPECIAL FEATURES", "TROPICAL WAVES", "MONSOON TROUGH/ITCZ", "GULF OF AMERICA"]
    assert [(r["cyclone"], r["lat"], r["wind_kt"], r["pressure_mb"]) for r in t["cyclones"].collect()] == [("Otis", 14.5, 90, 970)]
    assert [(r["id"], [tuple(p) for p in r["axis"]]) for r in t["waves"].orderBy("id").collect()] == [("W1", [(17.0, -33.0), (5.0, -33.0)]), ("W3", [(15.0, -61.5), (5.0, -61.5)])]
    assert [(r["subtype"], len(r["line"])) for r in t["troughs"].collect()] == [("monsoon", 2)]
    assert [(r["lat"], r["lon"]) for r in t["fixes"].collect()] == [(27.0, -85.0)]
    # The second place is named over a line break, so only the first is found.
    assert [(r["lat"], r["lon"]) for r in t["inferred"].collect()] == [(19.0, -71.0)]
    assert {r["id"] for r in t["projections"].collect()} == {"W1", "Otis"}


def test_chains_links_ledger_and_truth(spark):
    stamps = ["202606010000", "202606010600", "202606011200", "202606020700", "202606020900"]
    stream = lineage.product_stream(spark.createDataFrame([(f"f{k}", "AT", s) for k, s in enumerate(stamps)], "file string, basin string, stamp string"))
    assert [r["run"] for r in stream.orderBy("n").collect()] == [1, 1, 1, 2, 2]
    areas = [("f0", 1, None, 10.0, -40.0, ("low", 20)), ("f1", 1, "AL90", 10.5, -41.0, ("low", 20)), ("f1", 2, None, 30.0, -60.0, None), ("f2", 1, "AL91", 10.6, -42.9, ("high", 70)), ("f3", 1, "AL91", 11.0, -42.0, None)]
    kind = "file string, ord int, invest string, lat double, lon double, chance48 struct<cat:string,pct:int>"
    invests = lineage.invest_chains(stream, spark.createDataFrame(areas, kind)).withColumn("chance7", F.lit(None).cast("struct<cat:string,pct:int>"))
    got = [(r["file"], r["ord"], r["chain_id"], r["seq"], r["link"]) for r in invests.orderBy("file", "ord").collect()]
    assert got == [
        ("f0", 1, "AT-I-202606010000-1", 1, None), ("f1", 1, "AT-I-202606010000-1", 2, "proximity"), ("f1", 2, "AT-I-202606010600-1", 1, None),
        ("f2", 1, "AT-I-202606011200-1", 1, None), ("f3", 1, "AT-I-202606020700-1", 1, None),
    ]
    axis = lambda lon: [(15.0, lon), (5.0, lon)]
    waves = lineage.wave_chains(stream, spark.createDataFrame([("f0", 1, axis(-38.5)), ("f1", 1, axis(-38.0)), ("f2", 1, axis(-35.5))], "file string, ord int, axis array<struct<lat:double,lon:double>>"))
    assert sorted((r["file"], r["chain_id"], r["link"]) for r in waves.collect()) == [("f0", "AT-W-202606010000-1", None), ("f1", "AT-W-202606010000-1", "axis"), ("f2", "AT-W-202606011200-1", None)]
    cyclones = lineage.cyclone_chains(stream, spark.createDataFrame([("f3", 1, "Otis", 11.2, -42.5), ("f4", 1, "OTIS", 11.3, -43.0)], "file string, ord int, name string, lat double, lon double"))
    assert {r["chain_id"] for r in cyclones.collect()} == {"AT-C-202606020700-1"}
    links = lineage.genesis_links(waves, invests, cyclones)
    # Several invests are near the storm's first position, so none is linked; the first invest's wave is alone.
    assert sorted((r["kind"], r["source"], r["target"]) for r in links.collect()) == [("wave-invest", "AT-W-202606010000-1", "AT-I-202606010000-1")]
    now = ledger.data_now(waves, invests, cyclones, links)
    records = {r["chain_id"]: r for r in ledger.ledger_records(invests, cyclones, links, now).collect()}
    assert {k: r["outcome"] for k, r in records.items()} == {"AT-I-202606010000-1": "unresolved-nearby-cyclone", "AT-I-202606011200-1": "unresolved-nearby-cyclone"}
    assert records["AT-I-202606011200-1"]["siblings"] == ["AT-I-202606020700-1"] and records["AT-I-202606010000-1"]["wave_id"] == "AT-W-202606010000-1"
    files = spark.createDataFrame(
        [("bal902026", "al902026", 90, "AL", "202606010000", "202606010600", [], "7", None, ["X"], "1"), ("bal012026", "al012026", 1, "AL", "202606010600", "202606020900", [], "7", "202606020600", ["OTIS"], "2"), ("bal022026", "al022026", 2, "AL", "202606010600", "202606020900", ["al912026"], "", None, [], "3")],
        "base string, id string, num int, basin string, min_dtg string, max_dtg string, refs array<string>, genesis_num string, first_td_dtg string, names array<string>, file string",
    )
    told = truth.invest_truth(ledger.ledger_records(invests, cyclones, links, now), files, F.lit("202606020900"))
    assert {r["tag"]: (r["truth"], r["cyclone_base"]) for r in told.collect()} == {"AL90": ("formed", "bal012026"), "AL91": ("no-genesis", "bal022026")}
    tracks = {r["base"]: r["invest_tags"] for r in truth.storm_tracks(files, spark.createDataFrame([("bal012026", "202606010600", 1.0, 2.0, 30, "TD")], "base string, dtg string, lat double, lon double, vmax int, status string"), F.lit(2026)).collect()}
    assert tracks == {"bal902026": ["AL90"], "bal012026": ["AL90"], "bal022026": ["AL91"]}


def test_sinks_refuse_flags_and_repeat_themselves(spark, tmp_path):
    rows = spark.createDataFrame([(2, "AT", ["bad"]), (1, "EP", [])], "k int, basin string, flags array<string>")
    with pytest.raises(ValueError):
        sinks.write_unflagged(rows, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    sinks.write_unflagged(rows.filter("k = 1"), str(tmp_path / "yes"))
    for name in ("a", "b"):
        sinks.write_json(rows, str(tmp_path / name), ["k"])
    assert spark.read.text(str(tmp_path / "a")).collect() == spark.read.text(str(tmp_path / "b")).collect()
    sinks.write_partitioned(rows.withColumn("season", F.lit(2026)), str(tmp_path / "p"))
    assert (tmp_path / "p" / "season=2026" / "basin=AT").is_dir()


def test_sources(spark):
    files = spark.createDataFrame([("TWOAT.202606010000.txt", "a\r\nb"), ("TCMAT1.202606010300.txt", "x"), ("notes.txt", "y")], "file string, text string")
    named = products.name_products(files)
    assert [(r["kind"], r["basin"], r["stamp"], r["text"]) for r in named.orderBy("stamp").collect()] == [("TWO", "AT", "202606010000", "a\nb"), ("TCM", "AT", "202606010300", "x")]
    assert products.since(named, "2026-06-02").count() == 0 and products.since(named, "soon").count() == 2
    assert audit.flag_counts(spark.createDataFrame([(["a", "b"],), (["a"],)], "flags array<string>")).filter("flag = 'a'").first()["n"] == 2
