"""Rules on bulletins: each query writes products from a table's numbers in the forms that products use, and its SQL states what they say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormframe.functions import geometry, scalars, text
from stormframe.plans import audit, discussions, outlook
from stormframe.queries import query, r4
from stormframe.session import once, spread, table
from stormframe.sources import products
from stormframe.streaming import alerts


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("s"))).select("p_partkey", F.col("p_partkey").cast("string").alias("file"), "s")


def _pick(k: Column, *forms: Column | str) -> Column:
    """One of several forms by the remainder of a key."""
    out = None
    for i, form in enumerate(forms):
        value = F.lit(form) if isinstance(form, str) else form
        out = F.when(F.pmod(k, F.lit(len(forms))) == i, value) if out is None else out.when(F.pmod(k, F.lit(len(forms))) == i, value)
    return out


def _sections(spark: SparkSession, d: str, name: str, body: Column, basin: Column | None = None) -> DataFrame:
    basin = F.lit("AT") if basin is None else basin
    rows = _parts(spark, d).select("p_partkey", "file", "s", basin.alias("basin"), F.lit(1).alias("section"), F.lit(name).alias("name"))
    return once(rows, body=body).drop("s")


@query("""SELECT event_id, CAST(event_id % 90 AS DOUBLE) + 0.5 AS lat, CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END * CAST(event_id % 179 AS DOUBLE) AS lon, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END AS INT) AS n FROM events""")
def coordinate_forms(spark: SparkSession, d: str) -> DataFrame:
    """Positions with and without blanks between latitude and longitude; lower case is no hemisphere."""
    e = F.col("event_id")
    told = F.concat(
        F.lit("A LOW NEAR "), F.format_string("%02d.5N", (e % 90).cast("int")), F.when(e % 5 == 0, " ").otherwise(""), F.format_string("%d", (e % 179).cast("int")),
        F.when(e % 3 == 0, "E").otherwise("W"), F.lit(" AND 12n45w"), F.when(e % 2 == 0, " TO 09N 34W").otherwise(""),
    )
    rows = table(spark, d, "events").select("event_id", text.coordinate_pairs(told).alias("p"))
    return rows.select("event_id", F.col("p")[0]["lat"].alias("lat"), F.col("p")[0]["lon"].alias("lon"), F.size("p").alias("n"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 7 IN (0, 1, 2, 3) THEN 'EP' ELSE 'AT' END AS basin, CASE p_partkey % 3 WHEN 0 THEN 'TCM' WHEN 1 THEN 'TWO' ELSE 'TWD' END AS route FROM part""")
def basin_and_route(spark: SparkSession, d: str) -> DataFrame:
    head = _pick(
        F.col("p_partkey"), "000\nAXPZ20 KNHC 081146\n", "ABPZ20 KNHC\n", "TWOEP\n", "x\nFor the eastern and central North Pacific east of 180 longitude:\n",
        "ABNT20 KNHC\nThe wave moved into the eastern Pacific.\n", "AXNT20\n", "PZ20 is no header\n",
    )
    kind = _pick(F.col("p_partkey"), "HURRICANE OTIS FORECAST/ADVISORY NUMBER 3", "Tropical Weather Outlook", "Tropical Weather Discussion")
    late = F.concat(F.lit("ABNT20\n"), F.repeat(F.lit("x"), 400), F.lit(" TWOEP"))
    told = F.when(F.col("p_partkey") % 7 == 6, late).otherwise(head)
    rows = _parts(spark, d)
    return rows.select("p_partkey", text.detect_basin(told).alias("basin"), text.product_route(F.concat(F.lit("ABNT20\n"), kind)).alias("route"))


@query("""SELECT p_partkey, id, CAST(north AS DOUBLE) AS north, CAST(south AS DOUBLE) AS south, CAST(lon AS DOUBLE) AS lon FROM (
SELECT p_partkey, 'W2' AS id, CASE p_partkey % 7 WHEN 0 THEN greatest(s, 10) WHEN 1 THEN 19 WHEN 2 THEN s WHEN 3 THEN s WHEN 4 THEN s + 12 WHEN 5 THEN s + 12 ELSE 11 END AS north,
 CASE p_partkey % 7 WHEN 0 THEN least(s, 10) WHEN 1 THEN 12 WHEN 2 THEN greatest(2, s - 12) WHEN 3 THEN greatest(2, s - 12) WHEN 4 THEN s WHEN 5 THEN s ELSE 5 END AS south,
 CASE WHEN p_partkey % 7 = 6 THEN -40 WHEN p_partkey % 2 = 0 THEN -(s + 20.5) ELSE -(s + 20) END AS lon FROM (SELECT *, p_size AS s FROM part))""")
def wave_axes(spark: SparkSession, d: str) -> DataFrame:
    """A paragraph that tells no place, then one with an axis; a range of a box, told later, is not the axis."""
    s, k = F.col("s"), F.col("p_partkey")
    fill = lambda form, *values: F.format_string(form, *values)
    at = F.when(k % 2 == 0, fill("is near %dW-%dW", s + 20, s + 21)).otherwise(fill("has its axis along %dW", s + 20))
    extent = _pick(
        k, fill("from %dN to 10N", s), "from 12-19N", fill("south of %dN", s), fill("from %dN in Haiti southward", s), fill("N of %dN", s), fill("from %dN northward to the coast", s), "."
    )
    body = F.concat(F.lit("A wave is over land.\n\nA tropical wave "), at, F.lit(", "), extent, F.lit(", moving west at 10\nto 15 kt. Convection is from 03N to 04N between 10W and 20W."))
    fallback = F.lit("A wave over land.\n\nA tropical wave reaches 11N40W and then 05N40W.")
    out = discussions.waves(_sections(spark, d, "TROPICAL WAVES", F.when(k % 7 == 6, fallback).otherwise(body)))
    return out.select("p_partkey", "id", F.col("axis")[0]["lat"].alias("north"), F.element_at("axis", -1)["lat"].alias("south"), F.col("axis")[0]["lon"].alias("lon"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'Otis-Two' ELSE 'Otis' END AS cyclone, CASE WHEN p_partkey % 5 = 1 THEN 'Post-Tropical Cyclone' ELSE 'Hurricane' END AS classification,
 CAST(p_size AS DOUBLE) AS lat, CAST(-(p_size + 30) AS DOUBLE) AS lon, CASE WHEN p_partkey % 5 = 3 THEN NULL ELSE CAST(p_size + 60 AS INT) END AS wind_kt, CAST(950 + p_size AS INT) AS pressure_mb,
 CASE WHEN p_partkey % 5 = 2 THEN 320.0 ELSE 292.5 END AS bearing FROM part WHERE p_partkey % 5 <> 4""")
def cyclone_records(spark: SparkSession, d: str) -> DataFrame:
    """Storms that are, past storms that may come; a storm that is only forecast gives no row."""
    s, k = F.col("s"), F.col("p_partkey")
    maybe = F.lit("A tropical depression or tropical storm is expected. A Tropical Storm may form, and a tropical depression forms. ")
    name = F.when(k % 5 == 1, "POST-TROPICAL CYCLONE OTIS-TWO IS").otherwise("Hurricane Otis is")
    place = F.format_string(" centered near %d.0N %dW", s, s + 30)
    moving = F.when(k % 5 == 2, ", moving northwestward, or 320 degrees, at 9 kt.").otherwise(", moving west-northwest at 12 kt.")
    wind = F.when(k % 5 == 3, "").otherwise(F.format_string(" Maximum sustained winds are %d kt.", s + 60))
    mb = F.format_string(" Minimum central pressure is %d mb.", s + 950)
    storm = F.concat(F.when(k % 5 == 1, "").otherwise(maybe), name, place, moving, wind, mb)
    body = F.when(k % 5 == 4, maybe).when(k % 5 == 1, F.upper(storm)).otherwise(storm)
    out = discussions.cyclones(_sections(spark, d, "SPECIAL FEATURES", F.concat(F.lit("Gale warning.\n\n"), body)))
    return out.select("p_partkey", "cyclone", "classification", "lat", "lon", "wind_kt", "pressure_mb", "motion.bearing")


@query("""SELECT p_partkey, unnest(['monsoon', CASE WHEN p_partkey % 3 = 0 THEN 'itcz' WHEN p_partkey % 3 = 1 THEN 'trough' ELSE 'itcz' END]) AS subtype, unnest([2, CASE WHEN p_partkey % 3 = 2 THEN 3 ELSE 2 END]) AS points,
 unnest([-20.0, -(p_size + 30.0)]) AS first_lon FROM part""")
def trough_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chains after "from" and a sentence that names the feature first; a sentence on convection is no line."""
    s, k = F.col("s"), F.col("p_partkey")
    second = _pick(
        k, F.format_string("Segments of the ITCZ are from 07.5N%dW to 06N90W.", s + 30), F.format_string("A surface trough extends from 25N%dW to 22N95W.", s + 30),
        F.format_string("The ITCZ enters near 05N%dW and continues to\n06N95W to 07N99W.", s + 30),
    )
    body = F.concat(F.lit("The monsoon trough reaches the coast, then from 11N20W to 09N25W. "), second, F.lit(" Convection near the trough is at 08N20W and 09N21W."))
    out = discussions.troughs(_sections(spark, d, "MONSOON TROUGH/ITCZ", body))
    return out.select("p_partkey", "subtype", F.size("line").alias("points"), F.col("line")[0]["lon"].alias("first_lon"))


@query("""SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 20.5 ELSE 19.0 END WHEN 1 THEN 16.0 WHEN 2 THEN round(16.4 - p_size / 10.0, 1) WHEN 9 THEN 17.0 ELSE 18.1 END AS lat, CASE p_partkey % 12 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN -72.25 ELSE -71.0 END WHEN 1 THEN -24.0 WHEN 9 THEN -102.0 ELSE -77.3 END AS lon
FROM part WHERE p_partkey % 12 IN (0, 1, 2, 9, 10)""")
def inferred_gates(spark: SparkSession, d: str) -> DataFrame:
    """Places in sentences of a feature of now and of the basin; the other sentences place nothing."""
    k = F.col("p_partkey")
    s = F.col("s")
    # A name does not go over a line break, so there the middle of two places is not found.
    between = F.concat(F.lit("A disturbed area between Hispaniola and the"), F.when(s % 2 == 0, " ").otherwise("\n"), F.lit("southeastern Bahamas."))
    said = [
        between, "A low is just west of Cabo Verde.", F.format_string("A low is about %d nautical miles south of Jamaica and 5 miles east of Cuba.", s * 6 + 102),
        "Trades over the Gulf of Honduras will pulse.", "The GFS shows a low near Cuba.", "A low near 61W is over Jamaica.", "The Colombian low is near Nicaragua.",
        "A wave should reach Jamaica.", "A wave that moved into the eastern Pacific left Jamaica.", "A wave moved into the eastern Pacific near southwestern Mexico.",
        "A low over Jamaica is expected to reach Cuba.", "A low is well southwest of Jamaica.",
    ]
    basin = F.when(k % 12 == 9, "EP").otherwise("AT")
    body = F.concat(F.lit("Weather is fair. "), _pick(k, *said))
    out = discussions.inferred_points(_sections(spark, d, "GULF OF AMERICA", body, basin))
    return out.select("p_partkey", "lat", "lon")


@query("""SELECT p_partkey, unnest(['D1', 'D2', 'D3']) AS id, unnest([CASE WHEN p_partkey % 2 = 0 THEN 'AL92' END, 'CP91', NULL]) AS invest,
 unnest([11.0, NULL, CASE p_partkey % 4 WHEN 0 THEN 18.1 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 12.8 END]) AS lat, unnest([CAST(p_size AS INT), 10, 0]) AS pct48, unnest(['low', 'medium', 'low']) AS cat48, unnest([NULL, 40, 30]) AS pct7 FROM part""")
def outlook_areas(spark: SparkSession, d: str) -> DataFrame:
    """Three areas of a product: titled, titled without a known place, and prose whose sentences pass the gates or not."""
    out = outlook.disturbances(_outlooks(spark, d))
    return out.select(F.col("file").cast("long").alias("p_partkey"), "id", "invest", "lat", F.col("chance48.pct").alias("pct48"), F.col("chance48.cat").alias("cat48"), F.col("chance7.pct").alias("pct7"))


def _outlooks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tag = F.when(k % 2 == 0, " (AL92)").otherwise("")
    first = F.concat(F.lit("1. Central Tropical Atlantic"), tag, F.format_string(":\nA low is here.\n\n* Formation chance through 48 hours...low...near %d percent.\n", F.col("s")))
    second = F.lit("2. South of Hawaii (CP91):\nNothing near.\n\nRegardless of formation, rain will fall.\n* Formation chance through 48 hours...medium...10 percent.\n* Formation chance through 7 days...medium...40 percent.\n")
    prose = _pick(k, "A low is over Jamaica.", "Rain is likely across Nicaragua.", "Refer to the low near Cuba.", "Rain over Cuba. A trough moves over Nicaragua.")
    third = F.concat(prose, F.lit("\n* Formation chance through 48 hours...low...near 0 percent.\n* Formation chance through 7 days...low...30 percent.\n"))
    return _parts(spark, d).select(
        "p_partkey", "file", F.lit("AT").alias("basin"), F.lit("TWO").alias("kind"), F.lit("202606010000").alias("stamp"), F.lit(None).cast("timestamp").alias("ts"),
        F.concat(F.lit("ABNT20 KNHC\n\nFor the North Atlantic...\n\n"), first, F.lit("\n"), second, F.lit("\n"), third, F.lit("\n$$")).alias("text"),
    )


@query("""SELECT p_partkey, '[' || array_to_string(list_concat(list_concat(CASE WHEN p_size % 5 <> 3 THEN ['disturbance-count:' || (p_size % 5) || '/got:3'] ELSE [] END, CASE WHEN p_partkey % 2 = 1 THEN ['missing-invest:AL92'] ELSE [] END),
 CASE WHEN p_size % 7 = 0 THEN ['missing-invest:AL9' || (3 + p_size % 4)] ELSE [] END), ', ') || ']' AS flags FROM part""")
def expected_outlooks(spark: SparkSession, d: str) -> DataFrame:
    """Products against what they are known to hold: counts, tags that are missing, places and odds."""
    rows = _outlooks(spark, d)
    own = F.when(F.col("p_size") % 7 == 0, F.array(F.concat(F.lit("AL9"), (3 + F.col("p_size") % 4).cast("string")))).otherwise(F.array().cast("array<string>"))
    known = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), (F.col("p_size") % 5).cast("int").alias("disturbances"), F.concat(F.array(F.lit("AL92"), F.lit("CP91")), own).alias("invests"))
    out = audit.expected_outlooks(known, rows, outlook.disturbances(rows))
    return out.select(F.col("file").cast("long").alias("p_partkey"), F.concat(F.lit("["), F.array_join("flags", ", "), F.lit("]")).alias("flags"))


@query("""SELECT p_partkey, 'A low is near ' || p_size || 'N45W now.' AS around, CASE WHEN p_partkey % 2 = 0 THEN (1005 + p_size) - (1005 + p_size + 1) % 5 - (405 + p_size + 4 - (405 + p_size) % 5 + 1) + 2 ELSE 240 + 5 * p_size END AS shown, p_partkey % 2 = 0 AND TRUE AS cut FROM part""")
def shown_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The sentence around a position, and a long text cut to a window with an ellipsis at both ends."""
    s, k = F.col("s"), F.col("p_partkey")
    flat = F.concat(F.lit("One. A low is near "), s.cast("string"), F.lit("N45W now. The end."))
    at = F.locate("near", flat) - 1
    long = F.when(k % 2 == 0, F.repeat(F.lit("abcd "), 300)).otherwise(F.repeat(F.lit("abcd "), 48 + s))
    window = text.cap_context(long, s + 700, F.lit(10))
    rows = _parts(spark, d).select("p_partkey", text.sentence_around(flat, at, F.lit(8)).alias("around"), F.when(k % 2 == 0, window).otherwise(long).alias("w"))
    return rows.select("p_partkey", "around", F.length("w").alias("shown"), F.col("w").startswith("…").alias("cut"))


@query(r"""SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE CASE WHEN p_partkey % 4 = 1 THEN floor((p_size % 30 + 1) * 0.868976 + 0.5) ELSE p_size % 30 + 1 END END AS INT) AS slow_kt,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE (p_partkey % 16) * 22.5 END AS bearing, CASE WHEN p_partkey % 4 = 1 THEN 'mph' END AS unit, 'AL' || (90 + p_size % 10) AS invest, NULL AS other_tag,
 CASE WHEN p_size % 2 = 0 THEN 'AL91' ELSE 'S' || left('Text of an area ' || p_size, 40) END AS key, 'Jul ' || (1 + p_size % 28) AS day, '805 AM EDT' AS clock, 'Anna-Lee' AS title,
 CASE WHEN p_size % 2 = 0 THEN 'ANNA (AN-uh)' ELSE 'ANNA' END AS spoken, CAST(2 + p_size % 3 AS INT) AS bullets, CASE WHEN p_size < 40 THEN 'low' WHEN p_size < 60 THEN 'medium' ELSE 'high' END AS tier,
 CASE WHEN p_size + 20 < 34 THEN 'depression' WHEN p_size + 20 < 50 THEN 'storm' WHEN p_size + 20 < 64 THEN 'strong storm' ELSE 'hurricane' END AS wind,
 CASE WHEN p_size % 3 = 0 THEN '+' || p_size WHEN p_size % 3 = 1 THEN '-' || p_size ELSE '0' END AS delta, CAST(p_size + 10 AS DOUBLE) AS mean_lon, CAST(p_size AS DOUBLE) AS middle, CAST(-p_size / 10.0 AS DOUBLE) AS tenths,
 'ANNA' AS norm, 'bal012026.202606180600.dat' AS snapshot, TIMESTAMP '2026-07-01 00:00:00' + to_hours(48) AS later FROM part""")
def scalar_rules(spark: SparkSession, d: str) -> DataFrame:
    """Motions, tags, keys, headers, names, tiers and roundings."""
    s, k = F.col("s"), F.col("p_partkey")
    words = F.get(F.array(*map(F.lit, ("north", "north-northeast", "northeast", "east-northeast", "east", "east-southeastward", "southeast", "ssw", "south", "south-southwest", "sw", "west-southwest", "west", "west-northwestward", "northwest", "nnw"))), F.pmod(k, F.lit(16)).cast("int"))
    words = F.when(k % 16 == 7, "south-southeast").otherwise(words)
    speed = F.format_string("at %d %s", s % 30 + 1, F.when(k % 4 == 1, "mph").otherwise("kt"))
    move = text.motion(F.when(k % 4 == 0, "it is nearly stationary").otherwise(F.concat(F.lit("Moving toward the "), words, F.lit(" "), speed)))
    axis = F.array(*(F.struct(F.lit(v).cast("double").alias("lat"), (s + x).cast("double").alias("lon")) for v, x in ((1, 0), (9, 20))))
    line = F.concat(F.lit("805  AM EDT Mon Jul "), (s % 28 + 1).cast("string"), F.lit(" 2026"))
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    mid = scalars.axis_middle(F.array(*(F.struct((s + x).cast("double").alias("lat"), F.lit(-40.0).alias("lon")) for x in (-4, 4))), F.lit(None).cast("double"))
    delta = scalars.odds_delta(_pick(s, s * 2, F.lit(0), s), s * F.when(s % 3 == 1, 1).otherwise(1))
    spoken = text.with_respelling(F.lit("Anna"), F.when(s % 2 == 0, "AN-uh").otherwise("anna"))
    return _parts(spark, d).select(
        "p_partkey", move["slow_kt"].alias("slow_kt"), move["bearing"].alias("bearing"), move["unit"].alias("unit"),
        scalars.invest_tag(F.format_string("al%d2026", s % 10 + 90), F.lit(2026)).alias("invest"), scalars.invest_tag(F.lit("cp912026"), F.lit(2026)).cast("int").alias("other_tag"),
        scalars.area_key(F.when(s % 2 == 0, "AL91"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.concat(F.lit("Text of an area "), s.cast("string"))).alias("key"),
        text.stated_date(line).alias("day"), text.stated_time(line).alias("clock"), text.title_case(F.lit("ANNA-LEE")).alias("title"), spoken.alias("spoken"),
        F.size(text.chance_lines(F.concat(F.lit("Head. "), F.repeat(F.lit("* one "), (s % 3 + 1).cast("int"))))).alias("bullets"), scalars.odds_tier(s).alias("tier"), scalars.wind_tier(s + 20).alias("wind"),
        delta.alias("delta"), scalars.mean_longitude(axis).alias("mean_lon"), mid["lat"].alias("middle"), scalars.tenths_to_degrees(F.concat(s.cast("string"), F.lit("S"))).alias("tenths"),
        scalars.storm_name(F.lit("Anna-E")).alias("norm"), scalars.snapshot_name(F.lit("bal012026.dat"), F.lit("202606180600")).alias("snapshot"), scalars.plus_hours(now, 48).cast("timestamp_ntz").alias("later"),
    )


@query("""SELECT event_id, date_trunc('minute', ts) AS heard, CASE WHEN event_id % 5 = 4 THEN '' WHEN event_id % 5 = 0 THEN 'just now' WHEN event_id % 5 = 1 THEN '12m ago' WHEN event_id % 5 = 2 THEN '3h ago' ELSE '2d ago' END AS age,
 CAST(((hour(ts) // 6 + 1) * 6) % 24 AS INT) AS slot, event_id % 5 = 3 AS stale, strftime(ts, '%Y%m%d%H%M') AS stamp, 48.0 AS hours FROM events""")
def clock_rules(spark: SparkSession, d: str) -> DataFrame:
    """Header times against now, ages, the next synoptic hour, staleness and stamps."""
    t, k = F.col("ts").cast("timestamp"), F.col("event_id")
    back = _pick(k, F.lit(0), F.lit(12), F.lit(180), F.lit(48 * 60), F.lit(-5))
    then = F.timestamp_micros(F.unix_micros(t) - back.cast("long") * 60_000_000)
    stamp = F.date_format(t, "yyyyMMddHHmm")
    return table(spark, d, "events").select(
        "event_id", scalars.header_time(F.date_format(t, "ddHHmm"), t).cast("timestamp_ntz").alias("heard"), scalars.relative_age(then, t).alias("age"), scalars.next_synoptic(t)["hour"].alias("slot"),
        scalars.is_stale(then, t).alias("stale"), scalars.time_stamp(scalars.stamp_time(stamp)).alias("stamp"), scalars.hours_between(t, scalars.plus_hours(t, 48)).alias("hours"),
    )


@query("""SELECT p_partkey, CAST(3 AS INT) AS sections, CAST(1 AS INT) AS waves, CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS cyclones, CAST(1 AS INT) AS troughs, CAST(1 AS INT) AS convection, CAST(1 AS INT) AS fixes,
 CAST(CASE WHEN p_partkey % 3 = 1 THEN 0 ELSE 1 END AS INT) AS inferred, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INT) AS projections,
 CASE WHEN p_partkey % 3 = 1 THEN 'special-features/no-cyclone' ELSE '' END || CASE WHEN p_size > 45 THEN CASE WHEN p_partkey % 3 = 1 THEN ',' ELSE '' END || 'coords-out-of-basin' ELSE '' END AS flags FROM part""")
def discussion_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whole products through all passes: sections, features of each kind, points told twice dropped, projections and flags."""
    s, k = F.col("s"), F.col("p_partkey")
    storm = F.when(k % 3 == 0, "Hurricane Otis is centered near 20N60W moving west at 10 kt.").when(k % 3 == 1, "A tropical storm warning and a tropical storm watch.").otherwise("Gale warning.")
    place = F.when(k % 3 == 1, "A low is near the wave over Cuba, and the tropical wave is weak.").otherwise("A low is over Cuba.")
    body = F.concat(
        F.lit("AXNT20 KNHC\n\n...SPECIAL FEATURES...\n"), storm, F.lit("\n\n...TROPICAL WAVES...\nA tropical wave is along 30W, south of 15N, moving west at 10 kt.\n"),
        F.lit("Convection is from 10N to 12N between 28W and\n32W.\n\nMONSOON TROUGH/ITCZ...\nThe monsoon trough is from 09N20W to 08N25W. A ship near 08N25W reports rain. A buoy at "), F.format_string("%dN40W", s), F.lit(" too. "), place,
    )
    rows = once(_parts(spark, d), basin=F.lit("AT"), text=body).select("file", "basin", "text")
    tables = discussions.discussion_features(rows)
    tables["sections"] = tables["sections"].filter("name <> 'PREAMBLE'")
    out = audit.audit_discussions(rows, tables)
    names = ("sections", "waves", "cyclones", "troughs", "convection", "fixes", "inferred", "projections")
    return out.select(F.col("file").cast("long").alias("p_partkey"), *(F.col(c).cast("int").alias(c) for c in names), F.array_join("flags", ",").alias("flags"))


@query("""SELECT p_partkey, unnest([34, 50]) AS kt, 64 AS points, unnest([round((p_size + 60) / 60.0 + p_size % 20, 4), round((p_size + 20) / 60.0 + p_size % 20, 4)]) AS top FROM part""")
def wind_fields(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    quad = lambda base: F.struct(*((s + base).alias(q) for q in ("ne", "se", "sw", "nw")))
    field = geometry.wind_field(F.struct((s % 20).cast("double").alias("lat"), F.lit(-50.0).alias("lon")), F.create_map(F.lit(50), quad(20), F.lit(34), quad(60)))
    rows = _parts(spark, d).select("p_partkey", F.explode(field).alias("b"))
    return rows.select("p_partkey", "b.kt", F.size("b.ring").alias("points"), r4(F.array_max(F.transform("b.ring", lambda p: p["lat"]))).alias("top"))


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS lat, round(-50 - CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE p_size END * 24 / (60 * cos(radians(p_size))), 4) AS slow_lon, round(-50 - 20 * 24 / (60 * cos(radians(p_size))), 4) AS fast_lon, TRUE AS band FROM part WHERE p_partkey % 3 <> 0 AND NOT (p_partkey % 2 = 1 AND p_size = 20)""")
def motion_bands(spark: SparkSession, d: str) -> DataFrame:
    """Slow and fast ends of a motion a day ahead; a stationary one leads nowhere."""
    s, k = F.col("s"), F.col("p_partkey")
    move = text.motion(F.when(k % 3 == 0, "nearly stationary").otherwise(F.format_string("moving west at %d to 20 kt", F.when(k % 2 == 0, 10).otherwise(s))))
    to = once(_parts(spark, d), to=geometry.day_band(s.cast("double"), F.lit(-50.0), move)).filter("to IS NOT NULL AND to.band")
    return to.select("p_partkey", r4("to.slow.lat").alias("lat"), r4("to.slow.lon").alias("slow_lon"), r4("to.fast.lon").alias("fast_lon"), "to.band")


@query("""SELECT p_partkey, count(*) AS n_lines, sum(CASE WHEN i > 0 AND i < 9 THEN 3 ELSE 2 END)::BIGINT AS points FROM (SELECT p_partkey, i FROM part, (SELECT unnest(range(10)) AS i) WHERE (p_size + i) % 2 = 0) GROUP BY p_partkey""")
def clip_paths(spark: SparkSession, d: str) -> DataFrame:
    """Lines that step in and out of a box: each stretch inside keeps the point before and the point after it."""
    s = F.col("s")
    line = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct(i.cast("double").alias("lon"), F.when((s + i) % 2 == 0, 1.0).otherwise(20.0).alias("lat")))
    out = geometry.clip_lines(_parts(spark, d).select("p_partkey", line.alias("line")), "line", (-5.0, -5.0, 15.0, 5.0))
    return out.groupBy("p_partkey").agg(F.count("*").alias("n_lines"), F.sum(F.size("line")).cast("long").alias("points"))


@query("""SELECT p_partkey, CASE WHEN p_size < 30 THEN 'fine' ELSE 'coarse' END AS layer, CAST(power(p_size / 1000.0, 2) AS DOUBLE) AS area FROM part WHERE power(p_size / 1000.0, 2) >= 0.0005""")
def inset_layers(spark: SparkSession, d: str) -> DataFrame:
    """Rings wholly in the inset from the fine layer, others from the coarse one, islets left out."""
    s = F.col("s")
    west, side = F.when(s < 30, -62.0).otherwise(-70.0), s / 1000.0
    ring = F.array(*(F.struct((west + x).alias("lon"), (F.lit(15.0) + y).alias("lat")) for x, y in ((0.0 * side, 0.0 * side), (side, 0.0 * side), (side, side), (0.0 * side, side))))
    rows = _parts(spark, d).select("p_partkey", ring.alias("ring"))
    swapped = geometry.swap_inset(rows.withColumn("layer", F.lit("coarse")), rows.withColumn("layer", F.lit("fine")), "ring")
    return geometry.large_rings(swapped, "ring").select("p_partkey", "layer", F.round(geometry.ring_area(F.col("ring")), 9).alias("area"))


@query("""SELECT p_partkey, unnest(['new-invest', CASE WHEN p_size % 3 = 0 THEN 'threshold' ELSE 'new-area' END]) AS kind, unnest(['Invest AL91 designated', CASE WHEN p_size % 3 = 0 THEN '7-day chance now 65% (Gulf)' ELSE 'New Atlantic disturbance' END]) AS title,
 unnest(['Atlantic ' || chr(8212) || ' 7-day formation chance n/a.', CASE WHEN p_size % 3 = 0 THEN 'Crossed 40% (was 35%).' ELSE 'Gulf ' || chr(8212) || ' 7-day formation chance 65%.' END]) AS body FROM part WHERE p_partkey % 2 = 0""")
def alert_messages(spark: SparkSession, d: str) -> DataFrame:
    """Two products of each basin through the comparison that the stream makes: the first primes, the second alerts; a
    central Pacific tag that is known is no new invest."""
    import pandas as pd

    odd = F.col("p_partkey") % 2 == 1
    rows = _parts(spark, d).select("p_partkey", odd.alias("odd"), (F.col("s") % 3 == 0).alias("risen"))

    def step(batches):
        for batch in batches:
            found = []
            for key, is_odd, risen in zip(batch["p_partkey"], batch["odd"], batch["risen"], strict=True):
                area = {"key": "G15,-60" if risen else "G20,-60", "tag": None, "odds": 35, "place": "Gulf"}
                old = [area, {"key": "CP91", "tag": "CP91", "odds": 10, "place": None}]
                new = [{"key": "AL91", "tag": "AL91", "odds": None, "place": None}, {**area, "key": "G15,-60", "odds": 65}, {"key": "CP91", "tag": "CP91", "odds": 20, "place": None}]
                for kind, a, threshold, was in alerts.compare(new, None if is_odd else old):
                    found.append(("AT", str(key), kind, a["key"], a["tag"], a["odds"], a["place"], threshold, was))
            out = pd.DataFrame(found, columns=[c.split()[0] for c in alerts.ALERT.split(", ")])
            yield out.astype({"odds": "Int32", "threshold": "Int32", "was": "Int32"})

    told = rows.mapInPandas(step, alerts.ALERT)
    said = alerts.messages(told.withColumn("basin", F.lit("AT")))
    kinds = F.when(F.col("title").startswith("Invest"), "new-invest").when(F.col("title").startswith("New"), "new-area").otherwise("threshold")
    return said.select(F.col("product").cast("long").alias("p_partkey"), kinds.alias("kind"), "title", "body")


@query("""SELECT page_id, 'TWOAT.2026060' || (1 + page_id % 9) || '0000.txt' AS name FROM pages WHERE page_id % 9 >= 4""")
def listing_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Names of a listing, the first that begins with a wanted time, and products from a day on."""
    row = F.format_string("<a href=\"TWOAT.2026060%d0000.txt\">x</a> <a>TWOAT.2026060%d0000.txt</a>", F.col("page_id") % 9 + 1, F.col("page_id") % 9 + 1)
    pages = table(spark, d, "pages").select("page_id", row.alias("html"))
    names = products.listed_names(pages, "html", r"TWOAT\.\d{12}\.txt")
    wanted = pages.select(F.lit("TWOAT").alias("type"), F.format_string("2026060%d", F.col("page_id") % 9 + 1).alias("prefix"), "page_id")
    found = products.resolve_manifest(wanted.select("type", "prefix").distinct(), names)
    joined = wanted.join(found, ["type", "prefix"]).withColumn("stamp", F.substring("name", 7, 12))
    return products.since(joined, "2026-06-05").select("page_id", "name")


@query("""SELECT basin, CASE WHEN basin = 'EP' THEN 'mirror' ELSE 'primary' END AS source, max(o_orderkey) AS newest FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'EP' ELSE 'AT' END AS basin, o_orderkey FROM orders) GROUP BY basin""")
def mirror_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The newest product of each basin; a stale primary gives way to a newer mirror."""
    k = F.col("o_orderkey")
    time = F.timestamp_seconds(k * 60)
    rows = table(spark, d, "orders").select(k.cast("string").alias("file"), F.when(k % 2 == 0, "EP").otherwise("AT").alias("basin"), time.alias("ts"), k.cast("string").alias("text"))
    newest = products.latest_of_basin(rows)
    primary = newest.withColumn("ts", F.when(F.col("basin") == "EP", F.timestamp_seconds(F.unix_seconds("ts") - 10 * 3600)).otherwise(F.col("ts")))
    now = rows.agg(F.max("ts").alias("now"))
    both = products.with_mirror(primary.crossJoin(F.broadcast(now)).drop("now"), newest, F.lit("9999-01-01").cast("timestamp")).filter("file IS NOT NULL")
    return both.select("basin", "source", F.col("file").cast("long").alias("newest"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'LineString' WHEN 1 THEN 'MultiPolygon' ELSE 'MultiLineString' END AS kind, CAST(CASE WHEN p_partkey % 3 = 1 THEN 4 ELSE 2 END AS INT) AS points, CAST(-p_size AS DOUBLE) AS first_lon FROM part, (SELECT unnest(range(2)) AS i) WHERE i = 0 OR p_partkey % 3 <> 0""")
def geojson_layers(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("s"), F.col("p_partkey")
    line = F.format_string("[[-%d,1],[2.5,3]]", s)
    ring = F.format_string("[[[-%d,1],[2,3],[4,5],[-%d,1]]]", s, s)
    shape = _pick(
        k, F.concat(F.lit('{"type":"LineString","coordinates":'), line, F.lit("}")), F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), ring, F.lit(","), ring, F.lit("]}")),
        F.concat(F.lit('{"type":"MultiLineString","coordinates":['), line, F.lit(","), line, F.lit("]}")),
    )
    value = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":'), shape, F.lit("}]}"))
    out = products.geojson_features(_parts(spark, d).select("p_partkey", value.alias("value")))
    return out.select("p_partkey", "kind", F.size("line").alias("points"), F.col("line")[0]["lon"].alias("first_lon"))
