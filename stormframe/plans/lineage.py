"""From a stream of products to chains of sightings, and from chains to genesis links. A broken chain is better than an invented link."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stormframe.functions.geometry import flat_distance
from stormframe.functions.scalars import hours_between, mean_longitude, round_half_up, stamp_time
from stormframe.functions.text import bind
from stormframe.operators.chains import GAP_HOURS
from stormframe.operators.matching import nearest_first, sure_nearest, within
from stormframe.operators.ranking import BLOCK, path_places
from stormframe.session import dealt, let_go, merged, settled

# Degrees between paired waves and areas, the eastward drift that parts a wave, and the gates of genesis.
WAVE_DEGREES, AREA_DEGREES, EAST_DEGREES = 6.0, 4.0, 2.0
WAVE_HOURS, WAVE_LON, LAT_PAD, AMBIGUOUS = 24.0, 4.0, 3.0, 2.0
CYCLONE_HOURS, CYCLONE_DEGREES = 36.0, 3.0
LETTERS = {"waves": "W", "invests": "I", "cyclones": "C"}


def product_stream(products: DataFrame, gap_hours: float = GAP_HOURS, block: int = BLOCK) -> DataFrame:
    """``file, basin, stamp, n, run`` in the order (stamp, file); a gap over the limit, or one that can't be measured, starts a new run.

    Products without features count: they part what stands before from what comes after.
    Products are numbered and parted within their day; what the days before it add up to comes from a row a day.
    ``_block`` numbers stretches of whole days with about ``block`` products each; the last product
    of one has the number of the block that follows as ``_next``.
    """
    rows = products.select("file", "basin", "stamp", F.coalesce(F.substring("stamp", 1, 8), F.lit("")).alias("_day"))
    rows = dealt(rows, products.count(), "basin", "_day")
    time = stamp_time(F.col("stamp"))
    order = Window.partitionBy("basin", "_day").orderBy("stamp", "file")
    fresh = lambda before, own: F.coalesce(hours_between(before, own) > gap_hours, F.lit(True)).cast("long")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("_fresh", F.when(F.col("n") > 1, fresh(F.lag(time).over(order), time)).otherwise(0))
    rows = rows.withColumn("run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy("basin", "_day").agg(F.count("*").alias("_n"), F.sum("_fresh").alias("_runs"), F.min_by(time, "n").alias("_first"), F.max_by(time, "n").alias("_last"))
    by_day = Window.partitionBy("basin").orderBy("_day")
    days = days.withColumn("_runs", F.col("_runs") + fresh(F.lag("_last").over(by_day), F.col("_first")))
    earlier = by_day.rowsBetween(Window.unboundedPreceding, -1)
    # The first product of a day opens a run of its own, or goes on with the last of the day before.
    opened = F.coalesce(F.sum("_runs").over(earlier), F.lit(0)) + fresh(F.lag("_last").over(by_day), F.col("_first"))
    days = days.select("basin", "_day", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), opened.alias("_opened"))
    days = days.withColumn("_block", F.floor(F.col("_before") / block).cast("int"))
    days = days.withColumn("_next", F.nullif(F.lead("_block").over(by_day), F.col("_block")))
    told = rows.join(days, ["basin", "_day"])
    return told.select(
        "file", "basin", "stamp", (F.col("n") + F.col("_before")).cast("int").alias("n"), (F.col("run") + F.col("_opened")).alias("run"),
        "_block", F.when(F.col("n") == F.col("_n"), F.col("_next")).alias("_next"),
    )


def _same(items: Column, key, own: Column) -> Column:
    """The items, in their order, that have a key; none for an unknown one."""
    return F.filter(items, lambda x: key(x) == own)


def _by_key(before: Column, items: Column, key) -> Column:
    """Pairs ``p_ord, ord`` of items with one key: the last earlier one that has it with the first later one."""
    pair = lambda i: F.struct(F.get(F.reverse(_same(before, key, key(i))), F.lit(0))["ord"].alias("p_ord"), i["ord"].alias("ord"), F.get(_same(items, key, key(i)), F.lit(0))["ord"].alias("first"))
    return F.filter(F.transform(items, pair), lambda t: t["p_ord"].isNotNull() & (t["ord"] == t["first"]))


def _near(before: Column, items: Column, left, distance, most: float, fits=None) -> Column:
    """One-to-one pairs ``d, l, r`` of items at most so far apart, nearest first; ``l`` is what ``left`` gives of the earlier one, ``r`` the later one's ord."""

    def of(i: Column) -> Column:
        near = F.filter(before, lambda p: (distance(p, i) <= most) & (fits(p, i) if fits else F.lit(True)))
        return F.transform(near, lambda p: F.struct(distance(p, i).alias("d"), left(p).alias("l"), i["ord"].alias("r")))

    return bind(F.flatten(F.transform(items, of)), nearest_first)


def _matched(pairs: Column, right: str, own: Column) -> Column:
    return F.get(F.filter(pairs, lambda t: t[right] == own), F.lit(0))


# A family's pairs: of the features of two consecutive products of a run, in the order of ``ord``, those of the later
# one as ``item, before, link``. A pair that its gate rejects has no link and is never matched anew.


def _link(i: Column, p_ord: Column, link: Column) -> Column:
    return F.struct(i.alias("item"), F.when(link.isNotNull(), p_ord).alias("before"), link.alias("link"))


def wave_pairs(before: Column, items: Column) -> Column:
    """Nearest first by mean longitude, one to one."""
    left = lambda p: F.struct(p["ord"].alias("p_ord"), p["mean_lon"].alias("p_mean_lon"))
    near = _near(before, items, left, lambda p, i: F.abs(p["mean_lon"] - i["mean_lon"]), WAVE_DEGREES)

    def linked(i: Column, p: Column) -> Column:
        return _link(i, p["p_ord"], F.when(i["mean_lon"] - p["p_mean_lon"] <= EAST_DEGREES, "axis"))

    return bind(near, lambda pairs: F.transform(items, lambda i: bind(_matched(pairs, "r", i["ord"])["l"], lambda p: linked(i, p))))


def area_pairs(before: Column, items: Column) -> Column:
    """Equal tags first, then nearest first among the rest, which never joins two tags.

    Of earlier areas with one tag the last counts and the others are gone. Where
    distances tie, untagged earlier areas come before tagged ones that are left.
    """
    tag = lambda x: x["invest"]
    taken = lambda tagged, side, o: F.exists(tagged, lambda t: t[side] == o)

    def rank(p: Column) -> Column:
        first = F.get(_same(before, tag, p["invest"]), F.lit(0))["ord"]
        r = F.struct(F.when(p["invest"].isNull(), 0).otherwise(1).alias("a"), F.when(p["invest"].isNull(), p["ord"]).otherwise(first).alias("b"))
        return F.struct(r.alias("r"), p["ord"].alias("p_ord"), p["invest"].alias("p_invest"))

    def left_over(tagged: Column) -> Column:
        last = lambda p: F.get(F.reverse(_same(before, tag, p["invest"])), F.lit(0))["ord"]
        old = F.filter(before, lambda p: (p["invest"].isNull() | (p["ord"] == last(p))) & ~taken(tagged, "p_ord", p["ord"]))
        new = F.filter(items, lambda i: ~taken(tagged, "ord", i["ord"]))
        d = lambda p, i: flat_distance(p["lat"], p["lon"], i["lat"], i["lon"])
        fits = lambda p, i: ~F.coalesce(p["invest"] != i["invest"], F.lit(False))
        return bind(F.struct(old.alias("old"), new.alias("new")), lambda x: _near(x["old"], x["new"], rank, d, AREA_DEGREES, fits))

    def linked(i: Column, t: Column, p: Column) -> Column:
        same = t["p_ord"].isNotNull() | F.coalesce(p["p_invest"] == i["invest"], F.lit(False))
        return bind(F.coalesce(t["p_ord"], p["p_ord"]), lambda o: _link(i, o, F.when(o.isNotNull(), F.when(same, "tag").otherwise("proximity"))))

    both = lambda tagged: F.struct(tagged.alias("tagged"), left_over(tagged).alias("near"))
    told = lambda x: F.transform(items, lambda i: linked(i, _matched(x["tagged"], "ord", i["ord"]), _matched(x["near"], "r", i["ord"])["l"]))
    return bind(_by_key(before, items, tag), lambda tagged: bind(both(tagged), told))


def cyclone_pairs(before: Column, items: Column) -> Column:
    """Equal names, whatever the case."""
    named = _by_key(before, items, lambda x: F.upper(x["name"]))
    told = lambda i, o: _link(i, o, F.when(o.isNotNull(), "name"))
    return bind(named, lambda pairs: F.transform(items, lambda i: bind(_matched(pairs, "ord", i["ord"])["p_ord"], lambda o: told(i, o))))


def plain_number(x: Column) -> Column:
    """A number as text without a bare fraction: -44, -44.5; minus zero is 0."""
    return F.regexp_replace((x.cast("double") + F.lit(0.0)).cast("string"), r"\.0$", "")


def _walked(block: pa.Table) -> pa.Table:
    """A block's rows with the chain that each belongs to, as far as the block tells.

    ``_fn, _fo`` is its first sighting, ``seq`` the place in it, ``tag`` its first tag. A path that comes from an
    earlier block (its first row here is ``_rn, _ro``, from which ``_steps`` lead to a row) is of ``_kind`` 1 up to its first
    tag and of ``_kind`` 2 from there on, as that tag may part it from what came before. ``_reach`` marks chains, and ``_end``
    rows, that the next block may go on with; ``_more`` marks chains of more than one row, or that may be.
    ``_own`` and ``_blank`` are the first tag of a path from an earlier block and the empty one before it, ``_held`` the last.
    """
    block = block.sort_by([("n", "ascending"), ("ord", "ascending")])
    numbers, ords, befores, tags = (block.column(c).to_pylist() for c in ("n", "ord", "_before", "_tag"))
    root, start, steps, seq, kind, held = [], [], [], [], [], []
    tag, end, first_tag = {}, {}, {}
    at, last, now = None, {}, {}
    for i, (n, o, b, t) in enumerate(zip(numbers, ords, befores, tags, strict=True)):
        if n != at:
            at, last, now = n, now if n - 1 == at else {}, {}
        p, own = last.get(b) if b is not None else None, t or None
        if p is None:
            row = (i, i, 0, 1, 0 if b is None else 2 if own else 1, own)
        else:
            known = held[p]
            parts = own is not None and (own != known if known is not None else kind[p] == 1)
            begins = (i, 1, 0 if known is not None else 2) if parts else (start[p], seq[p] + 1, kind[p])
            row = (root[p], begins[0], steps[p] + 1, begins[1], begins[2], own or known)
        for values, value in zip((root, start, steps, seq, kind, held), row, strict=True):
            values.append(value)
        r, s = row[:2]
        if own is not None:
            first_tag.setdefault(r, own)
        if tag.get(s) is None:
            tag[s] = t
        end[s] = now[o] = i
    top = numbers[-1] if numbers else None
    ends = [n == top for n in numbers]
    crosses = [k > 0 or e for k, e in zip(kind, ends, strict=True)]
    enters = [k > 0 and r == i for i, (k, r) in enumerate(zip(kind, root, strict=True))]
    only = lambda flags, values: [v if f else None for f, v in zip(flags, values, strict=True)]
    reach = [numbers[end[s]] == top for s in start]
    item = block.schema.field("ord").type
    added = {
        "_rn": pa.array(only(crosses, [numbers[r] for r in root]), pa.int32()), "_ro": pa.array(only(crosses, [ords[r] for r in root]), item),
        "_steps": pa.array(only(crosses, steps), pa.int32()), "_fn": pa.array([numbers[s] for s in start], pa.int32()), "_fo": pa.array([ords[s] for s in start], item),
        "seq": pa.array(seq, pa.int32()), "tag": pa.array([tag[s] for s in start], pa.string()), "_kind": pa.array(kind, pa.int32()), "_end": pa.array(ends, pa.bool_()),
        "_reach": pa.array(reach, pa.bool_()), "_more": pa.array([f or end[s] != s for f, s in zip(reach, start, strict=True)], pa.bool_()),
        "_held": pa.array(only(ends, held), pa.string()), "_own": pa.array([first_tag.get(r) if f else None for f, r in zip(enters, root, strict=True)], pa.string()),
        "_blank": pa.array([tag[r] if f and kind[r] == 1 else None for f, r in zip(enters, root, strict=True)], pa.string()),
    }
    for name, values in added.items():
        block = block.append_column(name, values)
    return block.drop_columns(["_tag"])


def _crossing(walked: DataFrame) -> DataFrame:
    """A row for each path that enters a block: the chain it goes on with, how many rows that has before, its tag, and whether the path's first tag in the block parts it.

    A path has one row for each block that it enters, and only these meet in one task.
    """
    node = lambda n, o: F.concat_ws(":", "basin", n, o)
    e = {"e_held": "_held", "e_kind": "_kind", "e_fn": "_fn", "e_fo": "_fo", "e_seq": "seq", "e_tag": "tag"}
    ends = walked.filter("_end").select("basin", (F.col("n") + 1).alias("n"), F.col("ord").alias("_before"), node("_rn", "_ro").alias("_prior"), (F.col("_steps") + 1).alias("e_len"), *(F.col(c).alias(k) for k, c in e.items()))
    enters = walked.filter("_kind > 0 AND _steps = 0").select("basin", "n", "ord", "_before", node("n", "ord").alias("_root"), "_own", "_blank")
    t = settled(enters.join(ends, ["basin", "n", "_before"]))
    places = path_places(t, "_root", "_prior").select(F.col("node").alias("_root"), F.col("root").alias("path"))
    path = Window.partitionBy("path").orderBy("n")
    upto = path.rowsBetween(Window.unboundedPreceding, 0)
    t = t.join(places, "_root").withColumn("_h", F.last("e_held", ignorenulls=True).over(upto))
    t = t.withColumn("_parts", F.coalesce(F.col("_own") != F.col("_h"), F.lit(False)))
    # Where the earlier block's last row stands in a chain that begins in that block, the path goes on with that one.
    begun = (F.col("e_kind") == 0) | ((F.col("e_kind") == 2) & F.coalesce(F.lag("_parts").over(path), F.lit(False)))
    t = t.withColumn("_begun", begun).withColumn("_chain", F.sum(F.col("_begun").cast("int")).over(upto))
    chain = Window.partitionBy("path", "_chain").orderBy("n")
    whole = chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.coalesce(F.when(F.col("_begun"), F.col("e_tag")), F.col("_blank"), F.when(~F.col("_parts"), F.col("_own")))
    return t.select(
        "basin", F.col("n").alias("_rn"), F.col("ord").alias("_ro"), "_begun", "_parts", F.first("e_fn").over(chain).alias("x_fn"), F.first("e_fo").over(chain).alias("x_fo"),
        F.sum(F.when(F.col("_begun"), F.col("e_seq")).otherwise(F.col("e_len"))).over(chain.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("x_rows"),
        F.first(told, ignorenulls=True).over(whole).alias("x_tag"),
    )


def _chains(stream: DataFrame, features: DataFrame, family: str, pairs, tag: str | None, signature: Column) -> DataFrame:
    """Sightings of a family with ``chain_id, seq, tag, link``.

    Pairs are one to one, so they make paths; a path parts where a tag differs from the last one before it: from
    there on it is a chain of that tag. The features of a product are one row, tens of them at most, and rows meet
    once, by block: the last product of a block is shown to the next one too, so pairs, paths and tags are told within a
    block, and only what crosses the bounds of blocks is put together from a row for each crossing. Chains are numbered by their
    first sightings, and only the other sightings look their number up. Tasks are dealt by rows, so that what they sort stays in
    memory; what a step stores is deleted when no other reads it.
    """
    rest = [c for c in features.columns if c not in ("file", "ord")]
    items = features.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("ord", *rest))).alias("items"))
    products = settled(items.join(merged(stream), "file"))
    total = products.agg(F.sum(F.size("items"))).first()[0] or 0
    cut = dealt(products.withColumn("_at", F.explode(F.array_compact(F.array("_block", "_next")))), total, "basin", "_at")
    order = Window.partitionBy("basin", "_at").orderBy("n")
    follows = (F.lag("run").over(order) == F.col("run")) & (F.lag("n").over(order) == F.col("n") - 1)
    sided = cut.withColumn("before", F.coalesce(F.when(follows, F.lag("items").over(order)), F.slice("items", 1, 0))).filter("_at = _block")
    paired = sided.select("file", "basin", "stamp", "n", F.col("_at").alias("_block"), F.explode(pairs(F.col("before"), F.col("items"))).alias("x"))
    own = F.lit(None) if tag is None else F.col("x.item")[tag]
    flat = paired.select("file", "x.item.*", "basin", "stamp", "n", "_block", F.col("x.before").alias("_before"), F.col("x.link").alias("_link"), own.cast("string").alias("_tag"))
    kind = flat.schema["ord"].dataType.simpleString()
    kept = [f for f in flat.schema.fields if f.name != "_tag"]
    added = f"_rn int, _ro {kind}, _steps int, _fn int, _fo {kind}, seq int, tag string, _kind int, _end boolean, _reach boolean, _more boolean, _held string, _own string, _blank string"
    walked = settled(flat.groupBy("basin", "_block").applyInArrow(_walked, StructType([*kept, *StructType.fromDDL(added)])))
    let_go(products)
    crossing = _crossing(walked)
    stays = ["file", "ord", *rest, "basin", "stamp"]
    row = [*stays, "n", "_link", "_more"]
    entered = walked.filter("_kind > 0").join(crossing, ["basin", "_rn", "_ro"])
    parted = (F.col("_kind") == 2) & F.col("_parts")
    either = lambda here, there: F.when(parted, F.col(here)).otherwise(there).alias(here)
    entered = entered.select(*row, either("_fn", F.col("x_fn")), either("_fo", F.col("x_fo")), either("seq", F.col("x_rows") + F.col("_steps") + 1), either("tag", F.col("x_tag")))
    untold = F.col("_reach") & F.col("tag").isNull()
    later = crossing.filter("_begun").select("basin", F.col("x_fn").alias("_fn"), F.col("x_fo").alias("_fo"), "x_tag")
    here, chain = walked.filter("_kind = 0"), ["_fn", "_fo", "seq"]
    late = here.filter(untold).join(later, ["basin", "_fn", "_fo"], "left").select(*row, *chain, F.col("x_tag").alias("tag"))
    rows = here.filter(~untold).select(*row, *chain, "tag").unionByName(late).unionByName(entered)
    number = F.row_number().over(Window.partitionBy("basin", "stamp").orderBy("_sig", "n", "ord")).cast("string")
    # Signatures are told after the shuffle.
    firsts = dealt(rows.filter("seq = 1").repartition("basin", "stamp"), total, "basin", "stamp")
    firsts = firsts.withColumn("_sig", signature).withColumn("chain_id", F.concat_ws("-", "basin", F.lit(LETTERS[family]), "stamp", number))
    out = [*stays, "chain_id", "seq", "tag"]
    # Links, ledger and lookups all read the chains.
    firsts = settled(firsts.select(*out, F.lit(None).cast("string").alias("link"), F.col("n").alias("_fn"), F.col("ord").alias("_fo"), "_more"))
    ids = firsts.filter("_more").select("basin", "_fn", "_fo", "chain_id")
    others = dealt(rows.filter("seq > 1"), total, "basin", "_fn", "_fo")
    others = settled(others.join(merged(ids), ["basin", "_fn", "_fo"]).select(*out, F.col("_link").alias("link")))
    let_go(walked)
    return firsts.select(*out, "link").unionByName(others)


def wave_chains(stream: DataFrame, waves: DataFrame) -> DataFrame:
    """Chains of ``file, ord, axis``; a wave that jumps more than two degrees east is another one."""
    f = waves.withColumn("mean_lon", mean_longitude(F.col("axis")))
    out = _chains(stream, f, "waves", wave_pairs, None, plain_number(round_half_up(F.col("mean_lon"), 3)))
    return out.withColumn("mean_lon", round_half_up(F.col("mean_lon"), 3)).drop("tag")


def invest_chains(stream: DataFrame, areas: DataFrame) -> DataFrame:
    """Chains of ``file, ord, invest, lat, lon, ...``; a chain takes the first tag it meets and parts from another one."""
    number = lambda c: F.coalesce(plain_number(F.col(c)), F.lit("null"))
    signature = F.concat(F.lit('["'), F.coalesce("tag", F.lit("")), F.lit('",'), number("lat"), F.lit(","), number("lon"), F.lit("]"))
    return _chains(stream, areas, "invests", area_pairs, "invest", signature).withColumn("tagged", F.col("invest").isNotNull())


def cyclone_chains(stream: DataFrame, cyclones: DataFrame) -> DataFrame:
    """Chains of ``file, ord, name, lat, lon, ...`` by name."""
    out = _chains(stream, cyclones, "cyclones", cyclone_pairs, None, F.col("name")).drop("tag")
    first = Window.partitionBy("chain_id").orderBy("seq")
    return out.withColumn("chain_name", F.first("name").over(first))


def _hours(stamp: str) -> Column:
    return F.unix_seconds(stamp_time(F.col(stamp))) / F.lit(3600.0)


def wave_links(waves: DataFrame, invests: DataFrame) -> DataFrame:
    """``basin, kind, source, target, at_stamp``: the wave an invest came from, if only one is near it and it is near only one."""
    first = invests.filter("seq = 1 AND lat IS NOT NULL AND lon IS NOT NULL").select("basin", F.col("chain_id").alias("invest_id"), "stamp", "lat", "lon", _hours("stamp").alias("h"))
    lats = F.transform("axis", lambda p: p["lat"])
    seen = waves.select("basin", F.col("chain_id").alias("wave_id"), "mean_lon", F.array_min(lats).alias("low"), F.array_max(lats).alias("high"), _hours("stamp").alias("wave_h"))
    # Two waves in an invest's own cell lie within the margin of the nearest one, so it has no sure wave: it meets none of them.
    cell = lambda h, lon: [F.floor(F.col(h) / WAVE_HOURS).alias("_h"), F.floor(F.col(lon) / AMBIGUOUS).alias("_x")]
    full = seen.groupBy("basin", *cell("wave_h", "mean_lon"), F.floor("low"), F.floor("high")).agg(
        F.max("low").alias("low"), F.min("high").alias("high"), F.min(F.xxhash64("wave_id")).alias("_a"), F.max(F.xxhash64("wave_id")).alias("_z")
    )
    full = full.filter("_a <> _z").select("basin", "_h", "_x", "low", "high")
    celled = first.select("*", *cell("h", "lon")).alias("l")
    inside = F.col("l.lat").between(F.col("r.low") - LAT_PAD, F.col("r.high") + LAT_PAD)
    first = celled.join(full.alias("r"), (F.col("l.basin") == F.col("r.basin")) & (F.col("l._h") == F.col("r._h")) & (F.col("l._x") == F.col("r._x")) & inside, "left_anti").drop("_h", "_x")
    near = within(first, seen, ["basin"], ("h", "wave_h", WAVE_HOURS), ("lon", "mean_lon", WAVE_LON)).withColumn("dist", F.abs(F.col("mean_lon") - F.col("lon")))
    near = near.filter((F.col("dist") <= WAVE_LON) & F.col("lat").between(F.col("low") - LAT_PAD, F.col("high") + LAT_PAD))
    near = near.groupBy("basin", "invest_id", "stamp", "wave_id").agg(F.min("dist").alias("dist"))
    sure = sure_nearest(near, ["basin", "invest_id"], "wave_id", "dist", AMBIGUOUS)
    sure = sure_nearest(sure, ["basin", "wave_id"], "invest_id", "dist", AMBIGUOUS)
    return sure.select("basin", F.lit("wave-invest").alias("kind"), F.col("wave_id").alias("source"), F.col("invest_id").alias("target"), F.col("stamp").alias("at_stamp"))


def cyclone_links(invests: DataFrame, cyclones: DataFrame) -> DataFrame:
    """The invest a cyclone came from: the only one whose last position is near the cyclone's first."""
    placed = invests.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("basin", F.col("chain_id").alias("invest_id"))
    last = placed.agg(F.max_by(F.struct("stamp", "lat", "lon"), "seq").alias("last")).select("basin", "invest_id", "last.*")
    last = last.select("basin", "invest_id", F.col("lat").alias("last_lat"), F.col("lon").alias("last_lon"), _hours("stamp").alias("last_h"))
    first = cyclones.filter("seq = 1 AND lat IS NOT NULL AND lon IS NOT NULL").select("basin", F.col("chain_id").alias("cyclone_id"), "stamp", "lat", "lon", _hours("stamp").alias("h"))
    # Two invests in a cyclone's own cell, whose diagonal is under the limit, are both near it, so neither is the only one.
    side = CYCLONE_DEGREES / 1.5
    cell = lambda *c: [F.floor(F.col(x) / w).alias(n) for x, w, n in zip(c, (CYCLONE_HOURS, side, side), ("_h", "_y", "_x"), strict=True)]
    full = last.groupBy("basin", *cell("last_h", "last_lat", "last_lon")).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    first = first.select("*", *cell("h", "lat", "lon")).join(full, ["basin", "_h", "_y", "_x"], "left_anti").drop("_h", "_y", "_x")
    near = within(first, last, ["basin"], ("h", "last_h", CYCLONE_HOURS), ("lon", "last_lon", CYCLONE_DEGREES))
    near = near.withColumn("dist", flat_distance(F.col("lat"), F.col("lon"), F.col("last_lat"), F.col("last_lon"))).filter(F.col("dist") <= CYCLONE_DEGREES)
    alone = near.withColumn("_n", F.count("*").over(Window.partitionBy("basin", "cyclone_id"))).filter("_n = 1")
    sure = sure_nearest(alone, ["basin", "invest_id"], "cyclone_id", "dist", AMBIGUOUS)
    return sure.select("basin", F.lit("invest-cyclone").alias("kind"), F.col("invest_id").alias("source"), F.col("cyclone_id").alias("target"), F.col("stamp").alias("at_stamp"))


def genesis_links(waves: DataFrame, invests: DataFrame, cyclones: DataFrame) -> DataFrame:
    return settled(wave_links(waves, invests).unionByName(cyclone_links(invests, cyclones)).withColumn("confidence", F.lit("inferred-genesis")))


#: The order of links in a file.
LINK_ORDER = ["at_stamp", "kind", "source", "target"]


def newest_chain(chains: DataFrame, keys: list[str]) -> DataFrame:
    """The chain of each name or tag that was seen last; of two at one stamp the first by id."""
    last = chains.groupBy(*keys, "chain_id").agg(F.max("stamp").alias("last_stamp"))
    order = Window.partitionBy(*keys).orderBy(F.desc("last_stamp"), "chain_id")
    return last.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def match_waves(shown: DataFrame, waves: DataFrame, hours: float = 30.0, degrees: float = WAVE_DEGREES, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """``chain_id`` for each ``basin, wave, mean_lon, h`` that is shown: the nearest recent chain by its last sighting.

    ``ambiguous`` where the two nearest chains lie within two degrees of each other, whatever their distances.
    """
    last = waves.groupBy("basin", "chain_id").agg(F.max_by(F.struct("mean_lon", "stamp"), "seq").alias("s"))
    last = last.select("basin", "chain_id", F.col("s.mean_lon").alias("last_lon"), (F.unix_seconds(stamp_time(F.col("s.stamp"))) / F.lit(3600.0)).alias("last_h"))
    # Two chains in a cell all of which is nearer than half the margin: the two nearest are so too, and lie within it of each other.
    side, doubted = min(ambiguous / 2, degrees), []
    for n, m in ((1, 1), (6, 2)) if side > 0 else ():
        cell = lambda h, lon: (F.floor(F.col(h) / (hours / n)), F.floor(F.col(lon) / (side / m)))  # noqa: B023, E731
        h, x = cell("last_h", "last_lon")
        full = last.groupBy("basin", h.alias("_h"), x.alias("_x")).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        h, x = cell("h", "mean_lon")
        around = shown.select("basin", "wave", F.explode(F.sequence(h - n + 1, h + n - 1)).alias("_h"), x.alias("_x"))
        around = around.select("basin", "wave", "_h", F.explode(F.sequence(F.col("_x") - m + 1, F.col("_x") + m - 1)).alias("_x"))
        found = settled(around.join(full, ["basin", "_h", "_x"], "left_semi").select("basin", "wave").distinct())
        doubted.append(found.select("basin", "wave", F.lit(None).cast(dict(last.dtypes)["chain_id"]).alias("chain_id"), F.lit(True).alias("ambiguous")))
        shown = settled(shown.select("basin", "wave", "mean_lon", "h").join(found, ["basin", "wave"], "left_anti"))
    near = within(shown, last, ["basin"], ("h", "last_h", hours), ("mean_lon", "last_lon", degrees)).withColumn("dist", F.abs(F.col("last_lon") - F.col("mean_lon")))
    order = Window.partitionBy("basin", "wave").orderBy("dist", "chain_id")
    near = near.withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("last_lon").over(order)).filter("_n = 1")
    doubtful = F.coalesce(F.abs(F.col("last_lon") - F.col("_next")) <= ambiguous, F.lit(False))
    near = near.select("basin", "wave", F.when(~doubtful, F.col("chain_id")).alias("chain_id"), doubtful.alias("ambiguous"))
    return functools.reduce(DataFrame.unionByName, doubted, near)


def link_anchors(links: DataFrame, sightings: DataFrame, end: str) -> DataFrame:
    """The position that a link starts from (``source``: the last at or before it, else the first) or leads to
    (``target``: the first at or after it, else the last). ``sightings`` are mappable ``chain_id, seq, stamp, lat, lon``."""
    joined = links.join(sightings.select(F.col("chain_id").alias(end), "seq", "stamp", F.struct("lat", "lon").alias("pos")), end)
    seen = F.col("stamp") <= F.col("at_stamp") if end == "source" else F.col("stamp") >= F.col("at_stamp")
    when_seen = F.when(seen, F.col("seq"))
    picks = (F.max_by("pos", when_seen), F.min_by("pos", "seq")) if end == "source" else (F.min_by("pos", when_seen), F.max_by("pos", "seq"))
    return joined.groupBy("basin", "kind", "source", "target", "at_stamp").agg(F.coalesce(*picks).alias("anchor"))


def trail(sightings: DataFrame) -> DataFrame:
    """Mappable ``chain_id, seq, lat, lon, link, inferred``: rank from 0 (oldest) to 1, whether the stretch to each is sure, and whether all lie on one point."""
    chain = Window.partitionBy("chain_id")
    n, k = F.count("*").over(chain), F.row_number().over(chain.orderBy("seq"))
    one_point = (F.min("lat").over(chain) == F.max("lat").over(chain)) & (F.min("lon").over(chain) == F.max("lon").over(chain))
    placed = sightings.filter("lat IS NOT NULL AND lon IS NOT NULL")
    return placed.withColumns(
        {
            "fade": F.when(n > 1, (k - 1) / (n - 1)).otherwise(F.lit(1.0)),
            "solid": F.col("link").isin("tag", "name", "axis") & ~F.coalesce("inferred", F.lit(False)),
            "degenerate": one_point,
        }
    )
