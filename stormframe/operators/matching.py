"""Pairing rows: greedy one-to-one matches, range and as-of joins by buckets, ambiguity rejection."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stormframe.session import settled


def nearest_first(candidates: Column) -> Column:
    """Of an array of ``d, l, r`` those that nearest first take, one to one; ties by l, then r."""

    def take(done: Column, x: Column) -> Column:
        used = F.exists(done, lambda y: (y["l"] == x["l"]) | (y["r"] == x["r"]))
        return F.when(used, done).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.sort_array(candidates), F.slice(candidates, 1, 0), take)


def greedy_pairs(candidates: DataFrame, group: list[str], left: str, right: str, distance: str) -> DataFrame:
    """One-to-one pairs of each group, nearest first; ties by left, then right.

    A group holds the candidates of two consecutive products, tens of rows; they
    are folded as one sorted array, without Python. ``greedy_rounds`` gives the
    same pairs where a group may hold thousands.
    """
    item = F.struct(F.col(distance).alias("d"), F.col(left).alias("l"), F.col(right).alias("r"))
    folded = candidates.groupBy(*group).agg(F.collect_list(item).alias("all"))
    pairs = folded.select(*group, F.explode(nearest_first(F.col("all"))).alias("p"))
    return pairs.select(*group, F.col("p.l").alias(left), F.col("p.r").alias(right), F.col("p.d").alias(distance))


def greedy_rounds(candidates: DataFrame, group: list[str], left: str, right: str, distance: str) -> DataFrame:
    """The pairs of ``greedy_pairs`` for groups of any size, none of which has to fit a task.

    A candidate that comes first both among those of its left and among those of
    its right is taken whatever else happens, so each round takes all of these
    and drops what shares a side with them, until none is left. The firsts are
    minima, combined before the shuffle; they meet as whole candidates, each of
    which is there once, so no join has a hot key but for the removal, where the
    taken side holds a left or right once. Rounds grow with the longest chain of
    candidates that wait for each other, for distances in no particular order
    with the logarithm of a group. A group of null is a group; a candidate whose
    left, right or distance is null is none; of repeated candidates one counts.
    """
    item = F.struct(F.col(distance).alias("d"), F.col(left).alias("l"), F.col(right).alias("r"))
    whole = F.col(left).isNotNull() & F.col(right).isNotNull() & F.col(distance).isNotNull()
    open_ = settled(candidates.filter(whole).select(F.struct(*group).alias("g"), item.alias("x")).distinct())
    taken = []
    while not open_.isEmpty():
        first = lambda side: open_.groupBy("g", F.col(f"x.{side}").alias("_s")).agg(F.min("x").alias("x")).select("g", "x")  # noqa: B023, E731
        pairs = settled(first("l").join(first("r"), ["g", "x"]))
        taken.append(pairs)
        for side in ("l", "r"):
            gone = pairs.select("g", F.col(f"x.{side}").alias("_s"))
            open_ = open_.withColumn("_s", F.col(f"x.{side}")).join(gone, ["g", "_s"], "left_anti").select("g", "x")
        open_ = settled(open_)
    pairs = functools.reduce(DataFrame.unionByName, taken, open_)
    return pairs.select("g.*", F.col("x.l").alias(left), F.col("x.r").alias(right), F.col("x.d").alias(distance))


def within(left: DataFrame, right: DataFrame, keys: list[str], *near: tuple[str, str, float]) -> DataFrame:
    """Pairs with equal keys and numbers at most a width apart: ``near`` has ``left_at, right_at, width``, once or for several numbers.

    Numbers are cut into buckets of that width and the left side is repeated for
    the bucket and its neighbours, so this is an equi-join of three times the left
    rows for each number, not a comparison of all.
    """
    if not isinstance(near[0], tuple):
        near = (near,)
    bucket = lambda c, width: F.floor(F.col(c) / width).cast("long")
    names = [f"_b{k}" for k in range(len(near))]
    for name, (left_at, right_at, width) in zip(names, near, strict=True):
        left = left.withColumn(name, F.explode(F.array(*(bucket(left_at, width) + k for k in (-1, 0, 1)))))
        right = right.withColumn(name, bucket(right_at, width))
    joined = left.join(right, [*keys, *names]).drop(*names)
    for left_at, right_at, width in near:
        joined = joined.filter(F.abs(F.col(left_at) - F.col(right_at)) <= width)
    return joined


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: float) -> DataFrame:
    """Pairs with equal keys whose closed intervals of numbers meet, each pair once.

    Both sides are dealt into bins of ``width``, so a row costs its length in
    bins; a pair meets in every bin that both cover, and the one in which the
    later of the two begins owns it. An interval with an unknown end, or one
    that ends before it begins, meets nothing.
    """
    (a, b), (c, d) = left_span, right_span
    at = lambda x: F.floor(x / width).cast("long")

    def dealt(rows: DataFrame, low: str, high: str) -> DataFrame:
        return rows.filter(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(at(F.col(low)), at(F.col(high)))))

    joined = dealt(left, a, b).join(dealt(right, c, d), [*keys, "_bin"])
    meet = (F.col(a) <= F.col(d)) & (F.col(c) <= F.col(b)) & (F.col("_bin") == at(F.greatest(a, c)))
    return joined.filter(meet).drop("_bin")


#: Levels of spans of two to the power of the level, up to about eleven days of minutes.
LEVELS = 15


def _span_nodes(low: Column, high: Column) -> Column:
    """The fewest spans ``(level, node)`` of two to the level that make up the whole numbers from low to high."""
    top = LEVELS - 1
    inner = lambda k: (F.shiftright(low + (2**k - 1), k), F.shiftright(high + 1, k) - 1)
    node = lambda k, n: F.struct(F.lit(k).alias("level"), n.alias("node"))
    out = []
    for k in range(top):
        a, z = inner(k)
        out += [F.when((a <= z) & (F.pmod(a, F.lit(2)) == 1), node(k, a)), F.when((a <= z) & (F.pmod(z, F.lit(2)) == 0), node(k, z))]
    a, z = inner(top)
    rest = F.when(a <= z, F.transform(F.sequence(a, z), lambda n: node(top, n))).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))
    return F.concat(F.array_compact(F.array(*out)), rest)


def _point_nodes(at: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("node")) for k in range(LEVELS)))


def first_overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], order: list[str]) -> DataFrame:
    """Each left row with the first right row, in a stated order, that has its keys and whose closed interval meets its own.

    Ends are whole numbers. No pairs are made: what begins in a left interval is
    looked up in minima of spans of powers of two, and what holds its start in
    the spans that make up the right intervals, so a row costs a few spans
    however many it meets. Right rows come as ``_first``; a left row that meets
    none is left out. A right interval that ends before it begins meets what holds both ends.
    """
    (a, b), (c, d) = left_span, right_span
    pick = F.struct(*order, *(x for x in right.columns if x not in (*order, *keys)))
    rows = right.filter(F.col(c).isNotNull() & F.col(d).isNotNull()).select(*keys, F.col(c).alias("_c"), F.col(d).alias("_d"), pick.alias("_first"))
    least = lambda df, *by: df.groupBy(*keys, *by).agg(F.min("_first").alias("_first"))
    rows = least(rows, "_c", "_d")
    spans = left.filter(F.col(a) <= F.col(b)).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    node = F.explode("_nodes").alias("_node")
    by_start = least(least(rows.filter("_c <= _d"), "_c").withColumn("_nodes", _point_nodes(F.col("_c"))).select(*keys, "_first", node), "_node")
    begun = spans.withColumn("_nodes", _span_nodes(F.col("_a"), F.col("_b"))).select(*keys, "_a", "_b", node).join(by_start, [*keys, "_node"])
    # From the number after its start to its end a right interval holds the start of a left one.
    lasting = least(rows.filter("_c < _d").withColumn("_nodes", _span_nodes(F.col("_c") + 1, F.col("_d"))).select(*keys, "_first", node), "_node")
    held = spans.select(*keys, "_a").distinct().withColumn("_nodes", _point_nodes(F.col("_a"))).select(*keys, "_a", node).join(lasting, [*keys, "_node"])
    held = spans.join(least(held, "_a"), [*keys, "_a"])
    turned = overlapping(spans, rows.filter("_d < _c"), keys, ("_a", "_b"), ("_d", "_c"), float(2 ** (LEVELS - 1))).filter("_c <= _b AND _d >= _a")
    found = least(begun, "_a", "_b").unionByName(held, allowMissingColumns=True).unionByName(turned.select(*keys, "_a", "_b", "_first"))
    found = least(found, "_a", "_b").withColumnRenamed("_a", a).withColumnRenamed("_b", b)
    return left.join(found, [*keys, a, b])


#: Rows of a block, and of the blocks that it is compared with.
BLOCK = 512


def _blocks(rows: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(at)
    dealt = rows.withColumn("_k", F.floor((F.row_number().over(order) - 1) / BLOCK))
    packed = F.struct(*(c for c in rows.columns if c not in keys))
    return dealt.groupBy(*keys, "_k").agg(F.collect_list(packed).alias(name)).drop("_k")


def count_near(left: DataFrame, right: DataFrame, degrees: float, digits: int, bin_length: int) -> DataFrame:
    """``id, n, first``: how many right rows lie near each left row, and the least ``at`` among them; no pair is put out.

    ``left`` has ``basin, id, lo, hi, lat, lon`` and ``right`` ``basin, at, lat, lon``, none of them null. Near is a
    flat distance, rounded to so many digits, of at most so many degrees, with ``at`` from lo to hi. Rows are dealt into bins
    of time and of longitude, a right row into one bin, and compared in blocks, so a full bin never is one task's.
    """
    bins = ["basin", "_t", "_x"]
    at = lambda x, w: F.floor(x / w).cast("long")
    reach = degrees + 10.0**-digits
    near = left.withColumn("_t", F.explode(F.sequence(at(F.col("lo"), bin_length), at(F.col("hi"), bin_length))))
    near = near.withColumn("_x", F.explode(F.sequence(at(F.col("lon") - reach, degrees), at(F.col("lon") + reach, degrees))))
    far = right.withColumns({"_t": at(F.col("at"), bin_length), "_x": at(F.col("lon"), degrees)})
    low = lambda name, field: F.array_min(F.transform(name, lambda r: r[field]))
    high = lambda name, field: F.array_max(F.transform(name, lambda r: r[field]))
    one = _blocks(near, bins, "lo", "l").withColumns({"_lo": low("l", "lo"), "_hi": high("l", "hi")})
    two = _blocks(far, bins, "at", "r").withColumns({"_low": low("r", "at"), "_high": high("r", "at")})
    pairs = one.join(two, bins).filter("_lo <= _high AND _low <= _hi").select("l", "r")
    kind = f"id {dict(left.dtypes)['id']}, n long, first long"
    counted = pairs.mapInArrow(lambda batches: _count_near(batches, degrees, 10.0**digits), kind)
    return counted.groupBy("id").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _count_near(batches: Iterator[pa.RecordBatch], degrees: float, unit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for one, two in zip(batch.column("l"), batch.column("r"), strict=True):
            l, r = one.values, two.values  # noqa: E741
            of = lambda rows, name: rows.field(name).to_numpy(zero_copy_only=False)
            at = of(r, "at")
            order = np.argsort(at, kind="stable")
            at, lat, lon = at[order], of(r, "lat")[order], of(r, "lon")[order]
            dy, dx = of(l, "lat")[:, None] - lat, of(l, "lon")[:, None] - lon
            near = np.floor(np.sqrt(dy * dy + dx * dx) * unit + 0.5) / unit <= degrees
            near &= (at >= of(l, "lo")[:, None]) & (at <= of(l, "hi")[:, None])
            n = near.sum(axis=1)
            some = np.flatnonzero(n)
            if len(some):
                yield pa.RecordBatch.from_arrays([l.field("id").take(pa.array(some)), pa.array(n[some], pa.int64()), pa.array(at[near[some].argmax(axis=1)], pa.int64())], ["id", "n", "first"])


def last_before(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, payload: list[str]) -> DataFrame:
    """Each left row with the last right row at or before it: one union, one sort, one pass; no join."""
    value = F.struct(F.col(right_at).alias(right_at), *payload)
    kind = right.select(value.alias("v")).schema["v"].dataType
    tag = lambda df, at, v, own: df.select(*keys, F.col(at).alias("_t"), v.alias("_v"), own.alias("_own"))
    own = F.struct(*left.columns)
    all_rows = tag(left, left_at, F.lit(None).cast(kind), own).unionByName(
        tag(right, right_at, value, F.lit(None).cast(left.select(own.alias("o")).schema["o"].dataType))
    )
    order = Window.partitionBy(*keys).orderBy("_t", F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = all_rows.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).filter("_own IS NOT NULL")
    return seen.select("_own.*", *(F.col(f"_last.{c}").alias(c) for c in (right_at, *payload)))


def sure_nearest(candidates: DataFrame, source: list[str], target: str, distance: str, margin: float) -> DataFrame:
    """Each source's nearest target, if no other target is within the margin of it; an unknown distance comes last.

    Candidates dealt by source (``session.dealt``) stay where they are.
    """
    order = Window.partitionBy(*source).orderBy(F.asc_nulls_last(distance), F.asc_nulls_last(target))
    ranked = candidates.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead(distance).over(order))
    return ranked.filter((F.col("_n") == 1) & (F.col("_next").isNull() | (F.col("_next") - F.col(distance) > margin))).drop("_n", "_next")


def first_match(joined: DataFrame, source: list[str], order: list[str]) -> DataFrame:
    """The first match of each source in a stated order."""
    w = Window.partitionBy(*source).orderBy(*order)
    return joined.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def product_diff(previous: DataFrame, current: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Full outer pairing by key: the last previous row of a key counts; ``change`` is paired, added or removed."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    last = previous.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    rest = [c for c in previous.columns if c not in keys]
    last = last.select(*keys, *(F.col(c).alias(f"previous_{c}") for c in rest), F.lit(True).alias("_p"))
    both = last.join(current.withColumn("_c", F.lit(True)), keys, "full_outer")
    return both.withColumn("change", F.when(F.col("_p") & F.col("_c"), "paired").when(F.col("_c"), "added").otherwise("removed")).drop("_p", "_c")


#: Rows of a key that one task sweeps; a key with more is cut into chunks by stamp.
SWEPT = 50_000


def not_superseded(rows: DataFrame, key: str, stamp: str, low: str, high: str, swept: int = SWEPT) -> DataFrame:
    """Rows whose interval no row of the key with a later stamp contains.

    A sweep by falling stamp holds the intervals that no later one contains, in
    order of their lower ends, and asks of each row whether the last of them that
    begins no later than it ends before it does. A key of many rows is swept in
    chunks of stamps; each chunk's outermost intervals are then passed on to the
    chunks before it, where all of them are later, so a running maximum over the
    order of lower ends finds what they contain. A row with a null among the
    four columns contains nothing and is contained by nothing.
    """
    whole = F.col(key).isNotNull() & F.col(stamp).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull()
    hot = rows.filter(whole).groupBy(key).agg(F.count("*").alias("_n"), F.min(stamp).alias("_a"), F.max(stamp).alias("_z"))
    hot = settled(hot.filter((F.col("_n") > swept) & (F.col("_a") < F.col("_z"))).select(key))
    # Rows with a null pass through; they are dealt out, as they may be many.
    chunked, many = rows.withColumn("_chunk", F.when(whole, 0).otherwise(-1 - F.pmod(F.xxhash64(stamp, low, high), F.lit(256)).cast("int"))), not hot.isEmpty()
    if many:
        # Bounds of chunks from a table of each stamp's rows, added up in order.
        per = rows.filter(whole).join(hot, key, "left_semi").groupBy(key, stamp).agg(F.count("*").alias("_m"))
        upto = F.sum("_m").over(Window.partitionBy(key).orderBy(stamp).rowsBetween(Window.unboundedPreceding, -1))
        chunks = settled(per.select(key, stamp, F.floor(F.coalesce(upto, F.lit(0)) / swept).cast("int").alias("_chunk")))
        chunked = chunked.join(chunks.withColumnRenamed("_chunk", "_later"), [key, stamp], "left")
        chunked = chunked.withColumn("_chunk", F.when(whole, F.coalesce("_later", "_chunk")).otherwise(F.col("_chunk"))).drop("_later")
    kept = chunked.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", F.desc(stamp))
    names = (key, stamp, low, high)
    kept = kept.mapInArrow(lambda batches: _sweep(batches, *names), kept.schema)
    if many:
        kept = settled(kept)
        hot_rows = kept.filter("_chunk >= 0").join(hot, key, "left_semi")
        by_low = Window.partitionBy(key, "_chunk").orderBy(low, F.desc(high)).rowsBetween(Window.unboundedPreceding, -1)
        outer = hot_rows.withColumn("_reach", F.max(high).over(by_low)).filter(F.col("_reach").isNull() | (F.col("_reach") < F.col(high)))
        passed = outer.filter("_chunk > 0").select(key, F.col(low), F.col(high).alias("_far"), F.explode(F.sequence(F.lit(0), F.col("_chunk") - 1)).alias("_chunk"))
        far = dict(kept.dtypes)[high]
        both = hot_rows.withColumn("_far", F.lit(None).cast(far)).withColumn("_own", F.lit(True)).unionByName(passed.withColumn("_own", F.lit(False)), allowMissingColumns=True)
        seen = F.max("_far").over(Window.partitionBy(key, "_chunk").orderBy(low, "_own").rowsBetween(Window.unboundedPreceding, 0))
        free = both.withColumn("_seen", seen).filter(F.col("_own") & (F.col("_seen").isNull() | (F.col("_seen") < F.col(high)))).select(kept.columns)
        kept = kept.filter("_chunk < 0").unionByName(kept.filter("_chunk >= 0").join(hot, key, "left_anti")).unionByName(free)
    return kept.select(rows.columns)


def _sweep(batches: Iterator[pa.RecordBatch], key: str, stamp: str, low: str, high: str) -> Iterator[pa.RecordBatch]:
    """Rows in order of key, chunk and falling stamp, without those that a later row of their chunk contains."""
    at, now, lows, highs = None, None, [], []
    own_lows, own_highs = [], []  # rows of the present stamp, which do not contain each other
    plain = lambda x: (x.cast(pa.int64()) if pa.types.is_timestamp(x.type) else x).to_pylist()
    for batch in batches:
        keep = []
        for k, c, s, a, b in zip(*(plain(batch.column(name)) for name in (key, "_chunk", stamp, low, high)), strict=True):
            if at != (k, c):
                at, now, lows, highs, own_lows, own_highs = (k, c), s, [], [], [], []
            elif s != now:
                for x, y in zip(own_lows, own_highs, strict=True):
                    _hold(lows, highs, x, y)
                now, own_lows, own_highs = s, [], []
            if c < 0:
                keep.append(True)
                continue
            place = bisect.bisect_right(lows, a)
            keep.append(not place or highs[place - 1] < b)
            if keep[-1]:
                _hold(own_lows, own_highs, a, b)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _hold(lows: list, highs: list, a, b) -> None:
    """Add an interval to those held; both ends rise, and what it contains goes."""
    end = bisect.bisect_right(lows, a)
    if end and highs[end - 1] >= b:
        return
    start = bisect.bisect_left(lows, a)
    stop = bisect.bisect_right(highs, b, lo=start)
    lows[start:stop], highs[start:stop] = [a], [b]
