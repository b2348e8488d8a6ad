"""Rows that joins put out where many rows share a key: they grow with the input, not with its square."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from stormframe import session
from stormframe.operators.matching import first_overlapping
from stormframe.operators.ranking import numbered_places
from stormframe.plans import discussions, ledger, lineage, truth
from stormframe.session import once, spread


def joined(df):
    """The rows of a query, and the most that any join of it put out."""
    rows, most = df.collect(), [0]

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if name.endswith("QueryStage"):
            return walk(plan.plan())
        if "Join" in name:
            most[0] = max(most[0], plan.metrics().get("numOutputRows").get().value())
        for k in range(plan.children().size()):
            walk(plan.children().apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return rows, most[0]


def test_storm_tracks_of_one_number(spark):
    n = 200
    k = F.col("id")
    files = spark.range(n).select(
        F.format_string("f%03d", k).alias("base"), F.when(k % 2 == 0, F.concat(F.lit("al9"), (k % 10).cast("string"), F.lit("2026"))).otherwise("al012026").alias("id"),
        F.array().cast("array<string>").alias("refs"), F.lit("7").alias("genesis_num"), F.array(F.lit("X")).alias("names"), F.lit(None).cast("string").alias("first_td_dtg"), F.lit("202606010000").alias("min_dtg"), F.lit("202606020000").alias("max_dtg"),
    )
    fixes = spark.createDataFrame([("f000", "202606010600", 1.0, 2.0, 30, "TD")], "base string, dtg string, lat double, lon double, vmax int, status string")
    rows, most = joined(truth.storm_tracks(files, fixes, F.lit(2026)).select("base", "invest_tags"))
    assert len(rows) == n and all(r["invest_tags"] == ["AL90", "AL92", "AL94", "AL96", "AL98"] for r in rows)
    assert most <= 5 * n


def test_waves_and_invests_in_one_place(spark):
    n = 300
    stamp = F.format_string("2026060100%02d", F.col("id") % 60)
    at = lambda lat, lon: [F.lit(lat).alias("lat"), (F.lit(lon) + F.col("id") / 1000.0).alias("lon")]
    chain = lambda who: [F.lit("AT").alias("basin"), F.concat(F.lit(who), F.col("id").cast("string")).alias("chain_id"), F.lit(1).alias("seq"), stamp.alias("stamp")]
    lone = spark.createDataFrame([("AT", "w", 1, "202606100000", 15.0, -80.0)], "basin string, chain_id string, seq int, stamp string, lat double, lon double")
    waves = spark.range(n).select(*chain("W"), *at(15.0, -40.0)).unionByName(lone)
    waves = waves.withColumn("mean_lon", F.col("lon")).withColumn("axis", F.array(F.struct("lat", "lon")))
    invests = spark.range(n).select(*chain("I"), *at(15.0, -40.0)).unionByName(lone.withColumn("chain_id", F.lit("i")))
    rows, most = joined(lineage.wave_links(waves, invests))
    assert [(r["source"], r["target"]) for r in rows] == [("w", "i")] and most <= 4 * n
    rows, most = joined(lineage.cyclone_links(invests, invests.withColumn("chain_id", F.concat(F.lit("c"), "chain_id"))))
    assert [(r["source"], r["target"]) for r in rows] == [("i", "ci")] and most <= 4 * n
    shown = invests.select("basin", F.col("chain_id").alias("wave"), F.col("lon").alias("mean_lon"), lineage._hours("stamp").alias("h"))
    rows, most = joined(lineage.match_waves(shown, waves))
    assert {(r["chain_id"], r["ambiguous"]) for r in rows} == {("w", False), (None, True)} and len(rows) == n + 1 and most <= 4 * n


def test_lookup_as_by_all_pairs(spark):
    """Cells that decide by themselves give what all pairs give."""
    from pyspark.sql import Window

    r = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("double")
    stamp = lambda h: F.date_format(F.timestamp_seconds(F.lit(1780272000) + h * 3600), "yyyyMMddHHmm")
    waves = spark.range(150).select(F.lit("AT").alias("basin"), F.concat(F.lit("W"), F.col("id").cast("string")).alias("chain_id"), F.lit(1).alias("seq"), stamp(r(1, 400)).alias("stamp"), (-r(2, 640) / 8).alias("mean_lon"))
    shown = spark.range(400).select(F.lit("AT").alias("basin"), F.col("id").alias("wave"), (-r(3, 640) / 8).alias("mean_lon"), (F.lit(1780272000) / 3600 + r(4, 500)).alias("h"))
    last = waves.select("chain_id", F.col("mean_lon").alias("x"), lineage._hours("stamp").alias("t"))
    order = Window.partitionBy("wave").orderBy("d", "chain_id")
    pairs = shown.crossJoin(last).withColumn("d", F.abs(F.col("x") - F.col("mean_lon"))).filter("d <= 6 AND abs(h - t) <= 30")
    pairs = pairs.withColumn("k", F.row_number().over(order)).withColumn("y", F.lead("x").over(order)).filter("k = 1")
    want = {(q["wave"], None if q["y"] is not None and abs(q["x"] - q["y"]) <= 2 else q["chain_id"]) for q in pairs.collect()}
    got = {(q["wave"], q["chain_id"]) for q in lineage.match_waves(shown, waves).collect()}
    assert got == want and len({c is None for _, c in got}) == 2


def _season(spark, chains, seed):
    """Sightings of chains at odd stamps and places, some unknown, and cyclones of as many."""
    r = lambda k, m, *c: F.pmod(F.xxhash64("id", *c, F.lit(k + seed)), F.lit(m))
    stamp = lambda m: F.date_format(F.timestamp_seconds(F.lit(1780272000) + m * 60), "yyyyMMddHHmm")
    lat = lambda *c: F.when((r(1, 5, *c) > 0) & (F.col("id") % 11 > 0), 10.0 + r(2, 200, *c) / 10)
    rows = spark.range(chains).withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(6))))
    rows = rows.select("id", "seq", F.when(r(6, 40, "seq") > 0, stamp(r(3, 2000) + (F.col("seq") / 2).cast("long") * 60 * r(4, 7, "seq"))).otherwise("9").alias("stamp"), lat("seq").alias("lat"), (-r(5, 300, "seq") / 10.0).alias("lon"))
    rows = rows.withColumn("stamp", F.when((F.col("seq") > 1) & (F.col("seq") < 6), F.col("stamp")).otherwise(stamp(r(3, 2000) + F.col("seq") * 300)))
    rows = rows.select(F.lit("AT").alias("basin"), F.concat(F.lit("I"), F.col("id").cast("string")).alias("chain_id"), "seq", "stamp", "lat", "lon", F.when(F.col("id") % 3 > 0, F.concat(F.lit("AL9"), (F.col("id") % 5).cast("string"))).alias("tag"))
    chance = lambda test: F.when(test, F.struct(F.lit("low").alias("cat"), F.lit(20).alias("pct")))
    rows = rows.withColumns({"chance48": chance(F.col("seq") % 2 == 0), "chance7": chance(F.col("seq") % 3 == 0)})
    cyclones = rows.withColumn("chain_id", F.concat(F.lit("C"), "chain_id")).withColumn("name", F.lit("N"))
    return rows, cyclones.withColumn("lon", F.col("lon") + 0.3)


def test_counts_of_nearby_cyclones(spark):
    """Sizes and first stamps are those of the lists, with ties of time, unknown places and unknown stamps."""
    invests, cyclones = (df.localCheckpoint() for df in _season(spark, 120, 0))
    links = spark.createDataFrame([("AT", "invest-cyclone", "I1", "CI1", "202606010600"), ("AT", "wave-invest", "W1", "I2", "202606010600")], "basin string, kind string, source string, target string, at_stamp string")
    now = spark.createDataFrame([("202606040000",)], "now string")
    lists = {r["chain_id"]: r for r in ledger.ledger_records(invests, cyclones, links, now).collect()}
    rows = ledger.ledger_outcomes(invests, cyclones, links, now).collect()
    assert len(rows) == len(lists) == 120 and sum(len(r["nearby"]) for r in lists.values()) > 1500
    for r in rows:
        own = lists[r["chain_id"]]
        firsts = [n["first_stamp"] for n in own["nearby"]]
        assert (r["n_near"], r["near_stamp"], r["n_siblings"]) == (len(firsts), min(firsts, default=None), len(own["siblings"])), own
        assert all(r[c] == own[c] for c in (*ledger.RECORD, "now"))


def test_first_overlapping(spark):
    """As by all pairs: touching ends, points, empty, turned and unknown intervals, long ones; and joins stay small."""
    r = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    side = lambda n, k, a, b: spark.range(n).select("id", (r(k, 2)).alias("g"), (r(k + 1, 500) - 250).alias(a)).withColumn(b, F.when(r(k + 2, 9) == 0, F.col(a) - 3).when(r(k + 2, 9) == 1, F.col(a) + 60000).when(r(k + 2, 9) > 2, F.col(a) + r(k + 3, 60)))
    left, right = side(200, 0, "a", "b").localCheckpoint(), side(200, 10, "c", "d").withColumn("f", F.format_string("f%04d", r(20, 10000))).drop("id").localCheckpoint()
    pairs = left.filter("a <= b").join(right, "g").filter("c <= b AND d >= a")
    want = {(x["id"], x["f"]) for x in pairs.groupBy("id").agg(F.min("f").alias("f")).collect()}
    got = [(x["id"], x["_first"]["f"]) for x in first_overlapping(left, right, ["g"], ("a", "b"), ("c", "d"), ["f"]).collect()]
    assert len(got) == len(want) > 100 and set(got) == want


def test_files_of_one_name_and_era(spark):
    n = 1000
    k = F.col("id").cast("string")
    cyclones = spark.range(n).select(F.lit("AT").alias("basin"), F.concat(F.lit("C"), k).alias("chain_id"), F.lit(1).alias("seq"), F.lit("202606010600").alias("stamp"), F.lit("OTIS").alias("name"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    files = spark.range(n).select(F.concat(F.lit("b"), k).alias("base"), F.lit("al012026").alias("id"), F.lit(1).alias("num"), F.lit("AL").alias("basin"), F.lit("202606010000").alias("min_dtg"), F.lit("202606020000").alias("max_dtg"), F.array(F.lit("OTIS")).alias("names"), F.format_string("f%04d", F.col("id")).alias("file"))
    fixes = files.select("base", F.col("min_dtg").alias("dtg"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon")).filter("base = 'b0'")
    rows, most = joined(truth.cyclone_truth(cyclones, files, fixes))
    assert len(rows) == n and {(x["base"], x["n"], x["max_deg"]) for x in rows} == {("b0", 1, 0.0)} and most <= 3 * n


TEXT_QUERIES = ("motion_bands", "advisory_fields", "wave_axes", "cyclone_records")


def test_texts_are_read_once_and_by_all_tasks(spark):
    """A rule on a text is worked out once a row, not again for each field of what it gives, and a small table's rows meet all tasks."""
    for name in TEXT_QUERIES:
        df = queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") <= 30 and plan.count("format_string(") <= 8, name
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_once_is_not_put_into_its_readers(spark):
    rows = once(spark.range(20), x=F.struct(F.regexp_extract(F.col("id").cast("string"), r"(\d)", 1).alias("a"), F.regexp_extract(F.col("id").cast("string"), r"\d(\d)", 1).alias("b")))
    out = rows.filter("x.a <> '3' AND x.b <> '3'").select("id", "x.a", "x.b", F.concat("x.a", "x.b").alias("ab"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(") == 2
    assert [r["id"] for r in out.orderBy("id").collect()] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 17, 18, 19]
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_places_over_blocks(spark):
    """Stretches of blocks are put together to the paths that pointers give, also where an earlier item is missing."""
    rows = [(key, n, i, None if n == 1 or (n * 7 + i) % 11 == 0 else (i + n) % 4) for key in "ab" for n in range(1, 41) if n != 30 for i in range(4)]
    df = spark.createDataFrame(rows, "basin string, n int, ord int, p int")
    got = {(r["basin"], r["n"], r["ord"]): (r["root"], r["place"]) for r in numbered_places(df, "basin", "n", "ord", "p", block=4).collect()}
    want = {}
    for key, n, i, p in sorted(rows):
        root, place = want.get((key, n - 1, p), (f"{key}:{n}:{i}", -1)) if p is not None else (f"{key}:{n}:{i}", -1)
        want[key, n, i] = (root, place + 1)
    assert got == want and max(place for _, place in want.values()) > 8


def test_a_long_chain_takes_no_rounds(spark):
    n = 300
    hour = F.timestamp_seconds(F.lit(1780272000) + F.col("id") * 3600)
    stream = lineage.product_stream(spark.range(n).select("id", F.col("id").alias("file"), F.lit("AT").alias("basin"), F.date_format(hour, "yyyyMMddHHmm").alias("stamp")))
    storms = spark.range(n).select(F.col("id").alias("file"), F.lit(1).alias("ord"), F.lit("Otis").alias("name"), F.lit(10.0).alias("lat"), F.lit(-40.0).alias("lon"))
    before = len(session._SETTLED)
    rows = lineage.cyclone_chains(stream, storms)
    assert len(session._SETTLED) - before <= 6
    assert sorted(r["seq"] for r in rows.collect()) == list(range(1, n + 1)) and rows.select("chain_id").distinct().count() == 1


def test_stored_features_are_not_broadcast(spark, monkeypatch):
    """A stored table seems as small as its compressed columns: no step of the audit sends one through the driver."""
    plans, stored = [], discussions.settled
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(discussions, "settled", lambda df: (plans.append(plan(df)), stored(df))[1])
    out = queries()["discussion_audit"](spark, "/root/testdata/sf0.001")
    plans.append(plan(out))
    assert len(plans) == 7 and not any("Broadcast" in p for p in plans)
    assert sum("SortMergeJoin" in p for p in plans) == 3 and plans[-1].count("SortMergeJoin") == 1


def _features(spark, seed):
    """Products of two basins with few and many features, gaps, long chains, and tags that come late, differ or are empty."""
    r = lambda k, m, *c: F.pmod(F.xxhash64("k", "basin", *c, F.lit(k + seed)), F.lit(m))
    products = spark.range(90).select(F.col("id").alias("k"), F.explode(F.array(F.lit("AT"), F.lit("EP"))).alias("basin"))
    hour = F.col("k") * 6 + F.when(F.col("k") > 60, 30).otherwise(0)
    products = products.withColumn("stamp", F.date_format(F.timestamp_seconds(F.lit(1780272000) + hour * 3600), "yyyyMMddHHmm"))
    products = products.withColumn("file", F.concat("basin", F.lpad(F.col("k").cast("string"), 3, "0")))
    rows = products.filter(r(1, 12) > 0).withColumn("ord", F.explode(F.sequence(F.lit(1), (r(2, 4) + 1).cast("int"))))
    tag = F.when(r(3, 9, "ord") == 0, F.concat(F.lit("AL9"), r(4, 2, "ord").cast("string"))).when(r(3, 9, "ord") == 1, "")
    rows = rows.select("file", "ord", tag.alias("invest"), (10.0 + 7 * F.col("ord") + r(5, 30, "ord") / 10).alias("lat"), F.when(r(6, 15, "ord") > 0, F.lit(-50.0)).alias("lon"), F.concat(F.lit("N"), F.col("ord").cast("string")).alias("name"))
    return products.select("file", "basin", "stamp"), rows.localCheckpoint()


def test_chains_over_blocks(spark):
    """However products are cut into blocks, chains, places, tags and links are the same, also of chains that cross many blocks."""
    for seed in (0, 100):
        products, rows = _features(spark, seed)
        axis = rows.select("file", "ord", F.array(F.struct(F.lit(15.0).alias("lat"), (-F.col("lat")).alias("lon"))).alias("axis"))
        for build, features in ((lineage.invest_chains, rows.drop("name")), (lineage.wave_chains, axis), (lineage.cyclone_chains, rows.drop("invest"))):
            one, many = (build(lineage.product_stream(products, block=b), features) for b in (4096, 3))
            told = [sorted(map(str, df.collect())) for df in (one, many)]
            assert told[0] == told[1] and len(told[0]) == rows.count()
            assert one.agg(F.max("seq")).first()[0] > 12
        tags = lineage.invest_chains(lineage.product_stream(products, block=3), rows).groupBy("chain_id").agg(F.min("tag").alias("a"), F.max("tag").alias("z"), F.first("invest", True).alias("own"))
        assert tags.filter("a <> z OR (a IS NULL) <> (own IS NULL)").count() == 0 and tags.filter("a LIKE 'AL9%'").count() > 10


def test_features_meet_in_one_shuffle(spark, monkeypatch):
    """Areas are dealt out by product and by block, then only first sightings and the others by chain; tables that no step reads any more are gone."""
    plans, stored, before = [], lineage.settled, len(session._SETTLED)
    monkeypatch.setattr(lineage, "settled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stored(df))[1])
    out = queries()["invest_chains"](spark, "/root/testdata/sf0.001")
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 16
    assert len(session._SETTLED) - before <= 4 and out.count() == 6000
    assert spark.conf.get(session._CLEANUP) == "false"


def test_chain_tasks_follow_rows(spark, monkeypatch):
    told = [sorted(map(str, queries()["invest_chains"](spark, "/root/testdata/sf0.001").collect()))]
    monkeypatch.setattr(session, "ROWS", 500)
    out = queries()["invest_chains"](spark, "/root/testdata/sf0.001")
    told.append(sorted(map(str, out.collect())))
    assert told[0] == told[1] and len(told[0]) == 6000 and len(out.inputFiles()) > 12
