"""The ledger against best tracks: what the files say, where they disagree, and how far positions lie apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stormframe.functions.geometry import flat_distance
from stormframe.functions.scalars import hours_between, invest_tag, plus_hours, round_half_up, stamp_time, storm_name
from stormframe.operators.matching import first_overlapping, within
from stormframe.plans.ledger import HORIZONS, agreement, observed_rate, truth_kind
from stormframe.session import settled

# Hours that an era may lie off a chain, that genesis may trail it, between a sighting and a fix, and an outlier's degrees.
ERA_HOURS, TRAIL_HOURS, MATCH_HOURS, OUTLIER_DEGREES = 48, 240, 6.0, 5.0
FILE_BASIN = {"AT": "AL", "EP": "EP"}


def _files(files: DataFrame, *names: str) -> DataFrame:
    return files.select(*(F.col(c).alias(f"f_{c}") for c in ("base", "id", "num", "basin", "min_dtg", "max_dtg", *names)))


def _first_in_era(chains: DataFrame, eras: DataFrame, keys: list[str], after: int) -> DataFrame:
    """Chains, each with the first file by name that has its keys and its era."""
    minute = lambda c: F.floor(F.unix_seconds(stamp_time(F.col(c))) / 60)
    spans = chains.withColumns({"_from": minute("first_stamp") - ERA_HOURS * 60, "_to": minute("last_stamp") + after * 60})
    files = eras.withColumns({"_low": minute("f_min_dtg"), "_high": minute("f_max_dtg")})
    met = first_overlapping(spans, files, keys, ("_from", "_to"), ("_low", "_high"), ["f_file"])
    # A chain may have several keys. Plans over these few rows read the chains and files many times.
    return settled(met.groupBy("chain_id").agg(F.min("_first").alias("_first")).select("chain_id", "_first.*"))


def invest_truth(records: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """The truth of tagged chains by explicit evidence only: ``truth, invest_base, cyclone_base, cyclone_names, genesis_num,
    first_td_dtg`` added to ``chain_id, tag, first_stamp, last_stamp``.

    An invest's own file is met by id and era; a cyclone's by era and a stated
    reference or a shared genesis number. Of several the first by file name counts.
    """
    tagged = records.filter(F.col("tag").rlike(r"^(AL|EP|CP)\d{2}$")).withColumn("file_id", F.concat(F.lower("tag"), F.substring("first_stamp", 1, 4)))
    f = _files(files, "refs", "genesis_num", "first_td_dtg", "names", "file")
    own = _first_in_era(tagged.select("chain_id", "file_id", "first_stamp", "last_stamp"), f.withColumn("file_id", F.col("f_id")), ["file_id"], ERA_HOURS)
    own = own.select("chain_id", F.col("f_base").alias("invest_base"), F.col("f_refs").alias("own_refs"), F.col("f_genesis_num").alias("own_num"), F.col("f_max_dtg").alias("own_max"))
    known = tagged.join(own, "chain_id", "left")
    # Each kind of evidence is an equality: a reference to the chain's invest, one number of both, a reference of the invest's file.
    said = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    each = lambda kind, values: F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: said(kind, x))
    sought = F.concat(F.array(said("names", F.col("file_id")), said("number", F.nullif("own_num", F.lit("")))), each("named", F.col("own_refs")))
    shown = F.concat(F.array(said("named", F.col("f_id")), said("number", F.col("f_genesis_num"))), each("names", F.col("f_refs")))
    chains = known.select("chain_id", "first_stamp", "last_stamp", F.substring("tag", 1, 2).alias("area"), F.explode(F.array_distinct(sought)).alias("evidence")).filter("evidence.value IS NOT NULL")
    eras = f.filter("f_num < 90").select(*f.columns, F.col("f_basin").alias("area"), F.explode(F.array_distinct(shown)).alias("evidence"))
    cyclone = _first_in_era(chains, eras, ["area", "evidence"], TRAIL_HOURS)
    cyclone = cyclone.select("chain_id", F.col("f_base").alias("cyclone_base"), "f_first_td_dtg", F.col("f_names").alias("cyclone_names"), F.col("f_genesis_num").alias("cyclone_num"))
    out = records.join(known.select("chain_id", "invest_base", "own_num", "own_max"), "chain_id", "left").join(cyclone, "chain_id", "left")
    kind = truth_kind(F.col("cyclone_base").isNotNull(), F.col("f_first_td_dtg"), hours_between(stamp_time(F.col("own_max")), stamp_time(now)))
    return out.select(
        *records.columns, kind.alias("truth"), "invest_base", "cyclone_base", F.coalesce("cyclone_names", F.array().cast("array<string>")).alias("cyclone_names"),
        F.coalesce("own_num", "cyclone_num").alias("genesis_num"), F.col("f_first_td_dtg").alias("first_td_dtg"),
    )


def position_stats(sightings: DataFrame, fixes: DataFrame, bases: DataFrame) -> DataFrame:
    """``chain_id, n, mean_deg, max_deg``: each sighting's least distance to a fix of its chain's files within six hours.

    ``bases`` has ``chain_id, base``, one or more; ``fixes`` has ``base, dtg, lat, lon``.
    """
    hour = lambda c: F.unix_seconds(stamp_time(F.col(c))) / F.lit(3600.0)
    placed = sightings.filter("lat IS NOT NULL AND lon IS NOT NULL").select("chain_id", "seq", "lat", "lon", hour("stamp").alias("h"))
    placed = placed.join(bases.filter("base IS NOT NULL").select("chain_id", "base").distinct(), "chain_id")
    known = fixes.filter("lat IS NOT NULL AND lon IS NOT NULL").select("base", hour("dtg").alias("fix_h"), F.col("lat").alias("fix_lat"), F.col("lon").alias("fix_lon"))
    near = within(placed, known, ["base"], "h", "fix_h", MATCH_HOURS)
    d = flat_distance(F.col("lat"), F.col("lon"), F.col("fix_lat"), F.col("fix_lon"))
    least = near.groupBy("chain_id", "seq").agg(F.min(d).alias("d"))
    return least.groupBy("chain_id").agg(F.count("*").alias("n"), round_half_up(F.avg("d"), 1).alias("mean_deg"), round_half_up(F.max("d"), 1).alias("max_deg"))


def truth_overlay(records: DataFrame, sightings: DataFrame, files: DataFrame, fixes: DataFrame, now: Column) -> DataFrame:
    """Ledger records with truth, agreement, genesis delta and position statistics.

    A confirmed genesis into a storm of another name than the files have is refuted.
    """
    told = invest_truth(records, files, now)
    kind = agreement(F.col("outcome"), F.col("truth"))
    other = (F.col("outcome") == "formed") & F.col("cyclone_name").isNotNull() & ~F.array_contains("cyclone_names", storm_name(F.col("cyclone_name")))
    delta = round_half_up(hours_between(stamp_time(F.col("first_td_dtg")), stamp_time(F.col("genesis_stamp")))).cast("int")
    told = told.withColumn("agreement", F.when((kind == "confirms") & F.coalesce(other, F.lit(False)), "refutes").otherwise(kind)).withColumn("genesis_delta_h", delta)
    bases = told.select("chain_id", F.explode(F.array("invest_base", "cyclone_base")).alias("base"))
    return told.join(position_stats(sightings, fixes, bases), "chain_id", "left")


def statement_truth(stamp: Column, hours: int, truth: Column, first_td: Column, now: Column) -> Column:
    """formed, pending or not-formed by the files; null where they say nothing."""
    end = plus_hours(stamp_time(stamp), hours)
    return F.when(
        truth.isNotNull(),
        F.when(F.coalesce(stamp_time(first_td) <= end, F.lit(False)), "formed").when(end > stamp_time(now), "pending").otherwise("not-formed"),
    )


def truth_statements(statements: DataFrame, overlay: DataFrame, now: Column) -> DataFrame:
    rows = statements.join(overlay.select("chain_id", "truth", "first_td_dtg"), "chain_id", "left")
    verdict = F.coalesce(*(F.when(F.col("horizon") == h, statement_truth(F.col("stamp"), h, F.col("truth"), F.col("first_td_dtg"), now)) for h in HORIZONS))
    return rows.withColumn("verdict", verdict).drop("truth", "first_td_dtg")


def truth_calibration(statements: DataFrame, grid: DataFrame) -> DataFrame:
    """Counts by horizon and category; rates to two digits. ``grid`` has the cells, empty ones too."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    cells = statements.filter("verdict IS NOT NULL").groupBy("horizon", "cat").agg(
        F.count("*").alias("statements"), count("formed").alias("formed"), count("not-formed").alias("not_formed"), count("pending").alias("pending")
    )
    full = grid.join(cells, ["horizon", "cat"], "left").fillna(0, ["statements", "formed", "not_formed", "pending"])
    return full.withColumn("observed_rate", observed_rate(F.col("formed"), F.col("not_formed"), 2))


def cyclone_truth(cyclones: DataFrame, files: DataFrame, fixes: DataFrame) -> DataFrame:
    """``basin, chain_id, name, base, n, mean_deg, max_deg``: a cyclone chain's file by name, basin and era."""
    spans = cyclones.groupBy("basin", "chain_id").agg(F.min_by("name", "seq").alias("name"), F.min("stamp").alias("first_stamp"), F.max("stamp").alias("last_stamp"))
    spans = spans.withColumn("file_basin", F.when(F.col("basin") == "AT", "AL").otherwise(F.col("basin")))
    f = _files(files, "names", "file").filter("f_num < 90")
    named = f.select(*f.columns, F.col("f_basin").alias("file_basin"), F.explode(F.array_distinct("f_names")).alias("storm"))
    base = _first_in_era(spans.withColumn("storm", storm_name(F.col("name"))), named, ["file_basin", "storm"], ERA_HOURS).select("chain_id", F.col("f_base").alias("base"))
    out = spans.select("basin", "chain_id", "name").join(base, "chain_id", "left")
    return out.join(position_stats(cyclones, fixes, base), "chain_id", "left")


def truth_flags(overlay: DataFrame, cyclone_rows: DataFrame) -> DataFrame:
    """``basin, subject, kind, detail``: claims that truth resolves or refutes, positions far off, storms split over chains."""
    into = F.when(F.col("cyclone_base").isNotNull(), F.concat(F.lit(" into "), "cyclone_base", F.lit(" ("), F.array_join("cyclone_names", "/"), F.lit(")"))).otherwise("")
    claimed = F.when(F.col("cyclone_name").isNotNull(), F.concat(F.lit(" into "), "cyclone_name")).otherwise("")
    tag = F.coalesce("tag", F.lit("untagged"))
    far = lambda who: F.concat(who, F.lit(": "), F.col("max_deg").cast("string"), F.lit(" deg off at most, "), F.col("mean_deg").cast("string"), F.lit(" on average, of "), F.col("n").cast("string"))
    resolves = overlay.filter("agreement = 'resolves'").select(
        "basin", F.col("chain_id").alias("subject"), F.when(F.col("outcome") == "unresolved-nearby-cyclone", "truth-resolves-unresolved").otherwise("truth-resolves-open").alias("kind"),
        F.concat(tag, F.lit(": ledger "), "outcome", F.lit(", best track "), "truth", into).alias("detail"),
    )
    refutes = overlay.filter("agreement = 'refutes'").select(
        "basin", F.col("chain_id").alias("subject"), F.concat(F.lit("truth-refutes-"), "outcome").alias("kind"),
        F.concat(tag, F.lit(": ledger "), "outcome", claimed, F.lit(", best track "), "truth", into).alias("detail"),
    )
    off = lambda df, who: df.filter(F.col("max_deg") > OUTLIER_DEGREES).select("basin", F.col("chain_id").alias("subject"), F.lit("position-outlier").alias("kind"), far(who).alias("detail"))
    split = cyclone_rows.filter("base IS NOT NULL").groupBy("basin", "base").agg(F.sort_array(F.collect_list(F.concat("name", F.lit(" ("), "chain_id", F.lit(")")))).alias("chains")).filter(F.size("chains") > 1)
    split = split.select("basin", F.col("base").alias("subject"), F.lit("same-storm-split").alias("kind"), F.array_join("chains", " + ").alias("detail"))
    return resolves.unionByName(refutes).unionByName(off(overlay, tag)).unionByName(off(cyclone_rows, F.col("name"))).unionByName(split)


def agreement_summary(overlay: DataFrame, flags: DataFrame) -> DataFrame:
    """One row: invests, each agreement's count, and flags."""
    count = lambda a: F.count_if(F.col("agreement") == a).alias(a.replace("-", "_"))
    return overlay.agg(F.count("*").alias("invests"), *map(count, ("confirms", "resolves", "refutes", "open", "no-data"))).crossJoin(flags.agg(F.count("*").alias("flags")))


def storm_tracks(files: DataFrame, fixes: DataFrame, season: Column) -> DataFrame:
    """A row for each best-track file, by id and era: kind, names, fixes in order, and the tags of invests that the files
    themselves name: its own, its references', and those of files of its basin with its genesis number."""
    area = F.substring("id", 1, 2)
    own = files.select("base", invest_tag(F.col("id"), season).alias("tag"))
    refs = files.select("base", area.alias("area"), F.explode("refs").alias("ref")).filter(F.substring("ref", 1, 2) == F.col("area"))
    named = refs.select("base", invest_tag(F.col("ref"), season).alias("tag"))
    numbered = files.filter("genesis_num <> ''").select("base", area.alias("area"), "genesis_num")
    # A number's invests have few tags, however many files bear it.
    others = files.filter("genesis_num <> ''").select(area.alias("area"), "genesis_num", invest_tag(F.col("id"), season).alias("tag")).filter("tag IS NOT NULL").distinct()
    shared = numbered.join(others, ["area", "genesis_num"]).select("base", "tag")
    tags = own.unionByName(named).unionByName(shared).groupBy("base").agg(F.sort_array(F.collect_set("tag")).alias("invest_tags"))
    points = fixes.groupBy("base").agg(F.sort_array(F.collect_list(F.struct(F.col("dtg").alias("t"), "lat", "lon", F.col("vmax").alias("kt"), "status"))).alias("fixes"))
    rows = files.join(tags, "base", "left").join(points, "base", "left")
    kind = F.when(invest_tag(F.col("id"), season).isNotNull(), "invest").otherwise("cyclone")
    return rows.select(
        F.when(area == "al", "AT").when(area == "ep", "EP").alias("basin"), "id", "base", kind.alias("kind"), "names", "invest_tags", "first_td_dtg",
        F.struct(F.col("min_dtg").alias("min"), F.col("max_dtg").alias("max")).alias("era"), "fixes",
    )


def truth_by_tag(overlay: DataFrame) -> DataFrame:
    """The last record's truth of each tag, in the order of the ledger (chain id)."""
    told = F.struct("agreement", "truth", "cyclone_names", "cyclone_base")
    return overlay.filter("tag IS NOT NULL").groupBy("basin", "tag").agg(F.max_by(told, "chain_id").alias("t")).select("basin", "tag", "t.*")
