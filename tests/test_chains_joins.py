"""Paths, interval joins and sweeps against plain loops."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from stormframe.operators import matching
from stormframe.operators.ranking import path_places
from stormframe.plans import lineage


def test_path_places(spark):
    rows, want, k = [], {}, 0
    for length in (1, 1, 2, 3, 7, 64, 100):
        for place in range(length):
            rows.append((k, k - 1 if place else None))
            want[k] = (k - place, place)
            k += 1
    rows.append((k, 10_000))  # a predecessor that is no row
    want[k] = (k, 0)
    random.Random(1).shuffle(rows)
    got = {r["node"]: (r["root"], r["place"]) for r in path_places(spark.createDataFrame(rows, "node long, before long"), "node", "before").collect()}
    assert got == want
    assert path_places(spark.createDataFrame([], "node long, before long"), "node", "before").count() == 0


def walked(products, areas, gap=18):
    """Chains product by product, as ``file, ord -> first file, first ord, place``."""
    import datetime

    time = lambda s: datetime.datetime.strptime(s, "%Y%m%d%H%M")
    out, before, last = {}, [], {}
    for basin in sorted({b for _, b, _ in products}):
        before, at = [], None
        for file, _, stamp in sorted((p for p in products if p[1] == basin), key=lambda p: (p[2], p[0])):
            if at is None or (time(stamp) - at).total_seconds() > gap * 3600:
                before = []
            now = [(o, tag, lat) for f, o, tag, lat in areas if f == file]
            taken, pairs = set(), {}
            tags = {t: o for o, t, _ in before if t}
            for o, tag, _ in now:
                if tag in tags and tag not in {t for p, t in pairs.values() if t}:
                    pairs[o] = (tags[tag], tag)
                    taken.add(tags[tag])
            near = sorted((abs(lat - q), (1 if u else 0), p, o) for o, tag, lat in now if o not in pairs for p, u, q in before if p not in taken and not (u and tag and u != tag) and abs(lat - q) <= 4)
            for _, _, p, o in near:
                if o not in pairs and p not in taken:
                    pairs[o] = (p, None)
                    taken.add(p)
            for o, tag, _ in now:
                p = pairs.get(o)
                first = last.get((basin, p[0])) if p else None
                if first and tag and first[3] and first[3] != tag:
                    first = None
                out[(file, o)] = first = (*first[:2], first[2] + 1, first[3] or tag) if first else (file, o, 1, tag)
            last = {(basin, o): out[(file, o)] for o, _, _ in now}
            before, at = now, time(stamp)
    return {k: v[:3] for k, v in out.items()}


def test_invest_chains_by_ranking(spark):
    r = random.Random(4)
    products, areas, hour = [], [], 0
    for k in range(160):
        hour += r.choice([3, 6, 6, 18, 19, 40]) if k % 9 == 0 else 6
        stamp = f"2026{6 + hour // 720:02d}{1 + hour // 24 % 30:02d}{hour % 24:02d}00"
        for basin in ("AT", "EP"):
            file = f"{basin}{k:04d}"
            products.append((file, basin, stamp))
            tags = r.sample(["AL90", "AL91", "AL92", None, None, None], r.randrange(5))
            areas += [(file, o, tag, 10.0 + 7 * r.randrange(4) + r.random()) for o, tag in enumerate(tags)]
    stream = lineage.product_stream(spark.createDataFrame(products, "file string, basin string, stamp string"))
    rows = spark.createDataFrame([(f, o, t, lat, -50.0) for f, o, t, lat in areas], "file string, ord int, invest string, lat double, lon double")
    got = lineage.invest_chains(stream, rows).collect()
    by_chain = collections.defaultdict(list)
    for x in got:
        by_chain[x["chain_id"]].append((x["seq"], x["file"], x["ord"]))
    told = {(f, o): (*min(v)[1:], seq) for v in by_chain.values() for seq, f, o in v}
    assert told == walked(products, areas) and max(map(len, by_chain.values())) > 5


def test_product_stream_numbers_across_days(spark):
    rows = [("a", "AT", "202606010000"), ("b", "AT", "202606011800"), ("c", "AT", "202606021200"), ("d", "AT", "202606030601"), ("e", "AT", "202606030601"), ("f", "EP", "202606010000"), ("g", "AT", "202602300000"), ("h", "AT", None)]
    got = lineage.product_stream(spark.createDataFrame(rows, "file string, basin string, stamp string")).orderBy("basin", "n").collect()
    at = [(r["file"], r["n"], r["run"]) for r in got if r["basin"] == "AT"]
    assert [x[:2] for x in at] == [("h", 1), ("g", 2), ("a", 3), ("b", 4), ("c", 5), ("d", 6), ("e", 7)]
    runs = [x[2] for x in at]
    # A time that can't be read parts what stands on either side of it; 18 hours is no gap, and a minute more is.
    assert [b - a for a, b in zip(runs, runs[1:], strict=False)] == [1, 1, 0, 0, 1, 0]


def test_overlapping(spark):
    r = random.Random(2)
    side = lambda n: [(k, k % 3, x := r.randrange(100) / 2, x + r.choice([0, 0.5, 3, 40])) for k in range(n)]
    left, right = [*side(60), (90, 0, None, 1.0), (91, 0, 5.0, 1.0)], side(60)
    a = spark.createDataFrame(left, "i int, g int, a double, b double")
    b = spark.createDataFrame(right, "j int, g int, c double, d double")
    got = [(x["i"], x["j"]) for x in matching.overlapping(a, b, ["g"], ("a", "b"), ("c", "d"), 7.0).collect()]
    want = {(p[0], q[0]) for p in left for q in right if None not in p and p[2] <= p[3] and p[1] == q[1] and p[2] <= q[3] and q[2] <= p[3]}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("swept", [50_000, 40])
def test_not_superseded(spark, swept):
    r = random.Random(3)
    rows = [(k, "hot" if k % 2 else r.choice("abc"), r.randrange(80), x := r.randrange(40), x + r.randrange(60), None) for k in range(700)]
    rows += [(800, None, 1, 5, 6, 7), (801, "a", None, 5, 6, 7), (802, "a", 1, None, 6, 7), (803, "a", 0, 5, None, 7), (804, "same", 1, 0, 9, None), (805, "same", 1, 2, 3, 2**60 + 1)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "i int, k string, s int, l int, h int, big long").repartition(5)
    got = matching.not_superseded(df, "k", "s", "l", "h", swept)
    whole = [x for x in rows if None not in x[1:5]]
    want = [x for x in rows if x not in whole or not any(y[1] == x[1] and y[2] > x[2] and y[3] <= x[3] and y[4] >= x[4] for y in whole)]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    stamps = df.select("k", *(F.timestamp_seconds(c).alias(c) for c in "slh"))
    assert matching.not_superseded(stamps, "k", "s", "l", "h", swept).count() == got.count()
