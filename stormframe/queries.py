"""The engine's kernels on the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormframe.functions import geometry, scalars, text
from stormframe.operators import chains, matching
from stormframe.plans import advisories, discussions, ledger
from stormframe.session import dealt, once, settled, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r4(x):
    return F.round(x, 4)


@query("""
WITH f AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) <= 18 * 3600 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain FROM f)
SELECT user_id, CAST(chain AS BIGINT) AS chain, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM g GROUP BY ALL""")
def gap_chains(spark: SparkSession, d: str) -> DataFrame:
    rows = chains.gap_chains(table(spark, d, "events").select("event_id", "user_id", "ts"), ["user_id"], "ts", ["event_id"])
    return rows.groupBy("user_id", F.col("chain").cast("long").alias("chain")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""
WITH t AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN event_type END AS tag FROM events),
p AS (SELECT *, last_value(tag IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t)
SELECT event_id, user_id, CAST(1 + sum(CASE WHEN tag <> before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM p""")
def path_tag_break(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("tag"))
    return chains.tag_segments(e, ["user_id"], ["ts", "event_id"], "tag").select("event_id", "user_id", F.col("segment").cast("long").alias("segment"))


@query("""
WITH p AS (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
c AS (SELECT *, CASE WHEN previous < 40 AND value >= 40 THEN 40 WHEN previous < 60 AND value >= 60 THEN 60 END AS threshold FROM p)
SELECT event_id, user_id, previous, threshold FROM c WHERE threshold IS NOT NULL""")
def threshold_cross(spark: SparkSession, d: str) -> DataFrame:
    return chains.threshold_alerts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "previous", "threshold")


@query("""
WITH e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY ALL)
SELECT o.o_orderkey, e.ts, e.event_id FROM orders o ASOF LEFT JOIN e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts""")
def asof_last(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("o_custkey"), "ts").agg(F.max("event_id").alias("event_id"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return matching.last_before(o, e, ["o_custkey"], "o_orderdate", "ts", ["event_id"]).select("o_orderkey", "ts", "event_id")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) / 3.6e9 AS h, value FROM events),
p AS (SELECT a.event_id, min(abs(a.value - b.value)) AS near FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(a.h - b.h) <= 6 GROUP BY a.event_id)
SELECT count(*) AS n, round(avg(near), 4) AS mean_near, round(max(near), 4) AS max_near FROM p""")
def window_stats(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).alias("h"), "value")
    other = e.select(F.col("event_id").alias("other_id"), "user_id", F.col("h").alias("other_h"), F.col("value").alias("other_value"))
    near = matching.within(e, other, ["user_id"], "h", "other_h", 6.0).filter("event_id <> other_id")
    near = near.groupBy("event_id").agg(F.min(F.abs(F.col("value") - F.col("other_value"))).alias("near"))
    return near.agg(F.count("*").alias("n"), r4(F.avg("near")).alias("mean_near"), r4(F.max("near")).alias("max_near"))


@query("""
WITH c AS (SELECT o.o_orderkey, l.l_linenumber, abs(l.l_quantity - 25) AS dist FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey),
r AS (SELECT *, row_number() OVER w AS n, lead(dist) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY o_orderkey ORDER BY dist, l_linenumber))
SELECT o_orderkey, l_linenumber, dist FROM r WHERE n = 1 AND (nxt IS NULL OR nxt - dist > 2)""")
def ambiguity_links(spark: SparkSession, d: str) -> DataFrame:
    o, items = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    rows = o.count() + items.count()
    pairs = dealt(o, rows, "o_orderkey").join(dealt(items, rows, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    pairs = pairs.select("o_orderkey", "l_linenumber", F.abs(F.col("l_quantity") - 25).alias("dist"))
    return matching.sure_nearest(pairs, ["o_orderkey"], "l_linenumber", "dist", 2.0)


@query("""
WITH p AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS previous_o_totalprice FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1),
c AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1996)
SELECT coalesce(p.o_custkey, c.o_custkey) AS o_custkey, c.o_orderkey, previous_o_totalprice, o_totalprice,
 CASE WHEN p.o_custkey IS NOT NULL AND c.o_custkey IS NOT NULL THEN 'paired' WHEN c.o_custkey IS NOT NULL THEN 'added' ELSE 'removed' END AS change
FROM p FULL JOIN c ON p.o_custkey = c.o_custkey""")
def full_outer_diff(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    p = o.filter(F.year("o_orderdate") == 1995).select("o_custkey", "o_orderkey", "o_totalprice")
    c = o.filter(F.year("o_orderdate") == 1996).select("o_custkey", "o_orderkey", "o_totalprice")
    out = matching.product_diff(p, c, ["o_custkey"], ["o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "previous_o_totalprice", "o_totalprice", "change")


@query("""
WITH s AS (SELECT l_suppkey AS supp, l_orderkey AS stamp, min(l_shipdate) AS low, max(l_shipdate) AS high FROM lineitem GROUP BY ALL)
SELECT a.supp, a.stamp FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.supp = a.supp AND b.stamp > a.stamp AND b.low <= a.low AND b.high >= a.high)""")
def anti_superseded(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("stamp")).agg(F.min("l_shipdate").alias("low"), F.max("l_shipdate").alias("high"))
    return matching.not_superseded(settled(s), "supp", "stamp", "low", "high").select("supp", "stamp")


def _statements(spark: SparkSession, d: str) -> DataFrame:
    """Orders as stated odds, their first shipment as genesis, by horizon."""
    ship = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))).alias("genesis"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("near")
    )
    o = table(spark, d, "orders").join(ship, "o_orderkey", "left")
    cat = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority").startswith("2"), "medium").when(F.col("o_orderpriority").startswith("3"), "low")
    now = F.lit("1998-07-20").cast("timestamp_ntz")
    verdicts = F.array(*(F.struct(F.lit(h).alias("horizon"), ledger.statement_verdict(F.col("o_orderdate"), h, cat, F.col("genesis"), F.col("near"), now).alias("verdict")) for h in ledger.HORIZONS))
    return o.select("o_orderkey", F.col("o_orderstatus").alias("basin"), cat.alias("cat"), F.explode(verdicts).alias("v")).select("o_orderkey", "basin", "cat", "v.*")


_STATEMENTS = """
WITH ship AS (SELECT l_orderkey, min(l_shipdate) FILTER (WHERE l_returnflag <> 'R') AS genesis, min(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS near FROM lineitem GROUP BY 1),
st AS (SELECT o_orderkey, o_orderstatus AS basin, o_orderdate AS t, genesis, near, h AS horizon,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'high' WHEN '2' THEN 'medium' WHEN '3' THEN 'low' END AS cat
  FROM orders LEFT JOIN ship ON o_orderkey = l_orderkey CROSS JOIN (SELECT unnest([48, 168]) AS h)),
vd AS (SELECT o_orderkey, basin, cat, horizon, CASE WHEN cat IS NULL THEN NULL WHEN genesis <= t + to_hours(horizon) THEN 'formed'
  WHEN t + to_hours(horizon) > TIMESTAMP '1998-07-20' THEN 'pending' WHEN near <= t + to_hours(horizon) THEN 'unresolved' ELSE 'not-formed' END AS verdict FROM st)"""


@query(_STATEMENTS + "SELECT * FROM vd")
def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d)


def _rate(n: int) -> str:
    return f"CASE WHEN formed + not_formed > 0 THEN floor(formed / (formed + not_formed) * {10**n}.0 + 0.5) / {10**n}.0 END AS observed_rate"


_CELLS = """ basin, horizon, cat, count(*) AS statements, count(*) FILTER (WHERE verdict = 'formed') AS formed, count(*) FILTER (WHERE verdict = 'not-formed') AS not_formed,
 count(*) FILTER (WHERE verdict = 'unresolved') AS unresolved, count(*) FILTER (WHERE verdict = 'pending') AS pending FROM vd WHERE verdict IS NOT NULL GROUP BY ALL"""


@query(_STATEMENTS + ", c AS (SELECT" + _CELLS + """),
g AS (SELECT * FROM (SELECT unnest(['F', 'O', 'P']) AS basin), (SELECT unnest([48, 168]) AS horizon), (SELECT unnest(['low', 'medium', 'high']) AS cat)),
f AS (SELECT g.*, coalesce(statements, 0) AS statements, coalesce(formed, 0) AS formed, coalesce(not_formed, 0) AS not_formed, coalesce(unresolved, 0) AS unresolved, coalesce(pending, 0) AS pending
 FROM g LEFT JOIN c USING (basin, horizon, cat)) SELECT *, """ + _rate(3) + " FROM f")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: how often stated odds came true, by basin, horizon and category."""
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, "FOP"))).alias("basin"))
    grid = grid.select("basin", F.explode(F.array(*map(F.lit, ledger.HORIZONS))).alias("horizon"))
    grid = grid.select("basin", "horizon", F.explode(F.array(*map(F.lit, ledger.CATEGORIES))).alias("cat"))
    return ledger.calibration(_statements(spark, d), grid, ["basin", "horizon"])


@query(_STATEMENTS + """, t AS (SELECT basin, horizon, count(*) AS statements, count(*) FILTER (WHERE verdict = 'formed') AS formed, count(*) FILTER (WHERE verdict = 'not-formed') AS not_formed
 FROM vd WHERE verdict IS NOT NULL GROUP BY ROLLUP (basin, horizon)) SELECT *, """ + _rate(2) + " FROM t")
def calibration_total(spark: SparkSession, d: str) -> DataFrame:
    out = _statements(spark, d).filter("verdict IS NOT NULL").rollup("basin", "horizon").agg(
        F.count("*").alias("statements"), F.count_if(F.col("verdict") == "formed").alias("formed"), F.count_if(F.col("verdict") == "not-formed").alias("not_formed")
    )
    return out.withColumn("observed_rate", ledger.observed_rate(F.col("formed"), F.col("not_formed"), 2))


@query("""
WITH k AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'formed' WHEN 1 THEN 'open' WHEN 2 THEN 'unresolved-nearby-cyclone' ELSE 'no-cyclone' END AS l,
 CASE o_custkey % 5 WHEN 0 THEN 'formed' WHEN 1 THEN 'open' WHEN 2 THEN 'not-formed' WHEN 3 THEN 'no-genesis' END AS t FROM orders)
SELECT l AS ledger, t AS truth, count(*) AS n, CASE WHEN t IS NULL THEN 'no-data' WHEN l = 'formed' AND t = 'formed' THEN 'confirms' WHEN l = 'formed' THEN 'refutes'
 WHEN t = 'open' THEN 'open' WHEN l = 'no-cyclone' AND t = 'formed' THEN 'refutes' WHEN l = 'no-cyclone' THEN 'confirms' ELSE 'resolves' END AS agreement FROM k GROUP BY ALL""")
def outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    pick = lambda c, n, *names: F.get(F.array(*map(F.lit, names)), (F.col(c) % n).cast("int"))
    k = o.select(
        pick("o_orderkey", 4, "formed", "open", "unresolved-nearby-cyclone", "no-cyclone").alias("ledger"), pick("o_custkey", 5, "formed", "open", "not-formed", "no-genesis").alias("truth")
    )
    return k.groupBy("ledger", "truth").count().withColumnRenamed("count", "n").withColumn("agreement", ledger.agreement(F.col("ledger"), F.col("truth")))


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    return chains.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS o_orderkey FROM orders GROUP BY 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 8")
def newest_8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter("event_type = 'click'").select("event_id", "ts").orderBy(F.desc("ts"), F.desc("event_id")).limit(8)


@query(r"""SELECT doc_id, len(p) AS n_paragraphs, list_sum(list_transform(p, lambda x: length(x)))::BIGINT AS chars
FROM (SELECT doc_id, regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n') AS p FROM documents)""")
def text_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    spaced = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    p = table(spark, d, "documents").select("doc_id", text.paragraphs(spaced).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_paragraphs"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[.]\s+')) + 1 AS BIGINT) AS n_sentences FROM documents")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
h AS (SELECT *, regexp_matches(line, '^[A-Z]') AS head FROM l), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h),
g AS (SELECT doc_id, section, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT head) AS body FROM s GROUP BY ALL)
SELECT doc_id, count(*) AS n_sections, sum(length(body))::BIGINT AS chars FROM g WHERE trim(body) <> '' GROUP BY doc_id""")
def header_sections(spark: SparkSession, d: str) -> DataFrame:
    s = chains.sections(table(spark, d, "documents"), ["doc_id"], "text", "^[A-Z]")
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("body")).cast("long").alias("chars"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(CASE WHEN regexp_matches(html, '(?is)<pre[^>]*>.+?</pre>') THEN regexp_extract(html, '(?is)<pre[^>]*>(.*?)</pre>', 1) ELSE html END, '<[^>]+>', '', 'g') AS t FROM pages)
SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS text FROM b""")
def html_unwrap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.unwrap_pre(F.col("html")).alias("text"))


@query("SELECT event_id, (event_id % 900) / 10.0 * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS lat, (event_id % 1799) / 10.0 * CASE WHEN event_id % 3 = 0 THEN 1 ELSE -1 END AS lon FROM events")
def coord_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    said = F.concat(
        F.lit("LOW NEAR "), F.format_string("%.1f", (e % 900) / 10.0), F.when(e % 2 == 0, "N").otherwise("S"), F.lit(" "),
        F.format_string("%.1f", (e % 1799) / 10.0), F.when(e % 3 == 0, "E").otherwise("W"), F.lit(" MOVING"),
    )
    return table(spark, d, "events").select("event_id", F.get(text.coordinate_pairs(said), F.lit(0)).alias("p")).select("event_id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS lat, -p_retailprice / 20 AS lon, (p_partkey % 16) * 22.5 AS b, CAST(p_size % 30 AS DOUBLE) AS kt FROM part)
SELECT p_partkey, round(lat + kt * 24 * cos(radians(b)) / 60, 4) AS to_lat, round(lon + kt * 24 * sin(radians(b)) / (60 * cos(radians(lat))), 4) AS to_lon FROM p""")
def motion_project(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("lat"), (-F.col("p_retailprice") / 20).alias("lon"), ((F.col("p_partkey") % 16) * 22.5).alias("b"), (F.col("p_size") % 30).cast("double").alias("kt"))
    to = p.select("p_partkey", geometry.project_day(F.col("lat"), F.col("lon"), F.col("b"), F.col("kt")).alias("to"))
    return to.select("p_partkey", r4("to.lat").alias("to_lat"), r4("to.lon").alias("to_lon"))


@query("""WITH h AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'EP' ELSE 'AL' END AS basin, p_size * 3 AS h FROM part),
t AS (SELECT * FROM (VALUES ('AL',0,10),('AL',12,25),('AL',24,39),('AL',36,49),('AL',48,62),('AL',60,77),('AL',72,95),('AL',96,134),('AL',120,200),
('EP',0,10),('EP',12,25),('EP',24,37),('EP',36,48),('EP',48,56),('EP',60,66),('EP',72,78),('EP',96,106),('EP',120,138)) v(basin, t1, r)),
n AS (SELECT *, lag(t1) OVER (PARTITION BY basin ORDER BY t1) AS a0, lag(r) OVER (PARTITION BY basin ORDER BY t1) AS r0, max(r) OVER (PARTITION BY basin) AS top FROM t)
SELECT p_partkey, round(coalesce((SELECT r0 + (r - r0) * (h.h - a0) / CAST(t1 - a0 AS DOUBLE) FROM n WHERE n.basin = h.basin AND h.h > a0 AND h.h <= t1),
 CASE WHEN h.h <= 0 THEN 10.0 ELSE (SELECT max(top) FROM n WHERE n.basin = h.basin) END), 4) AS nm FROM h""")
def cone_radius(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", r4(scalars.cone_radius(F.col("p_size") * 3, F.when(p % 2 == 0, "EP").otherwise("AL"))).alias("nm"))


@query("""WITH p AS (SELECT p_partkey, p_size % 40 + 1.0 AS lat, -p_size - 10.0 AS lon, [p_size + 0.0, p_size + 5.0, p_size + 10.0, p_size + 15.0] AS q FROM part),
v AS (SELECT p_partkey, lat, lon, q[1 + k // 16] AS r, (k // 16) * 90 + (k % 16) * 6 AS b, k FROM p CROSS JOIN (SELECT unnest(range(64)) AS k)),
x AS (SELECT p_partkey, k, lon + r * sin(radians(b)) / (60 * cos(radians(lat))) AS x, lat + r * cos(radians(b)) / 60 AS y FROM v),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM x WINDOW w AS (PARTITION BY p_partkey ORDER BY k))
SELECT p_partkey, round(abs(sum(x * y2 - x2 * y)) / 2, 4) AS area FROM n GROUP BY 1""")
def quad_ring_area(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    ring = geometry.quadrant_ring(s % 40 + 1.0, -s - 10.0, [s + float(k) for k in (0, 5, 10, 15)])
    return table(spark, d, "part").select("p_partkey", r4(geometry.ring_area(ring)).alias("area"))


@query("SELECT event_id, date_trunc('minute', ts) AS issued FROM events")
def issued_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    local = F.col("ts").cast("timestamp") - F.expr("INTERVAL '4' HOUR")
    line = F.concat(F.date_format(local, "hhmm a"), F.lit(" EDT "), F.date_format(local, "E MMM d yyyy"))
    return table(spark, d, "events").select("event_id", text.issued_time(line).cast("timestamp_ntz").alias("issued"))


@query("""WITH k AS (SELECT unnest(['the', 'then', 'tion', 'que', 'ung', 'ment']) AS key),
h AS (SELECT doc_id, key, instr(lower(text), key) AS place FROM documents CROSS JOIN k)
SELECT d.doc_id, (SELECT key FROM h WHERE h.doc_id = d.doc_id AND place > 0 ORDER BY place, -length(key), key LIMIT 1) AS key FROM documents d""")
def anchor_leftmost_longest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.leftmost_key(F.col("text"), ["the", "then", "tion", "que", "ung", "ment"]).alias("key"))


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN n_chars < 100 THEN 'short' END, CASE WHEN text LIKE '%!!%' THEN 'shouting' END, CASE WHEN quality = 0 THEN 'low quality' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS flags
FROM documents d LEFT JOIN labels USING (doc_id)""")
def quality_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "n_chars", "text").join(table(spark, d, "labels"), "doc_id", "left")
    tests = {"short": F.col("n_chars") < 100, "shouting": F.contains("text", F.lit("!!")), "low quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    return rows.select("doc_id", F.array_join(F.array_compact(F.array(*(F.when(c, name) for name, c in tests.items()))), ",").alias("flags"))


@query("""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey) AS ord, year(o_orderdate) AS y FROM orders),
c AS (SELECT a.o_custkey || ':' || b.y AS g, a.ord AS l, b.ord AS r, abs(a.o_totalprice - b.o_totalprice) AS d FROM u a JOIN u b ON a.o_custkey = b.o_custkey AND b.y = a.y + 1 WHERE abs(a.o_totalprice - b.o_totalprice) <= 100000),
ck AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, l, r) AS k FROM c),
gr AS (SELECT DISTINCT g, 0::BIGINT AS k, []::BIGINT[] AS ul, []::BIGINT[] AS ur FROM ck UNION ALL
 SELECT gr.g, ck.k, CASE WHEN list_contains(ul, ck.l) OR list_contains(ur, ck.r) THEN ul ELSE list_append(ul, ck.l) END, CASE WHEN list_contains(ul, ck.l) OR list_contains(ur, ck.r) THEN ur ELSE list_append(ur, ck.r) END
 FROM gr JOIN ck ON ck.g = gr.g AND ck.k = gr.k + 1),
gf AS (SELECT g, arg_max(ul, k) AS ul, arg_max(ur, k) AS ur FROM gr GROUP BY g)
SELECT CAST(split_part(g, ':', 1) AS BIGINT) AS o_custkey, CAST(split_part(g, ':', 2) AS INT) AS y, unnest(ul) AS before, unnest(ur) AS now FROM gf""")
def greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each year's orders of a customer with those of the year before, nearest in price first, one to one."""
    rank = F.row_number().over(Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderkey"))
    u = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), rank.cast("long").alias("now"), "o_totalprice")
    before = u.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("now").alias("before"), F.col("o_totalprice").alias("was"))
    near = before.join(u, ["o_custkey", "y"]).withColumn("dist", F.abs(F.col("was") - F.col("o_totalprice"))).filter("dist <= 100000")
    return matching.greedy_pairs(near, ["o_custkey", "y"], "before", "now", "dist").select("o_custkey", "y", "before", "now")


@query("""WITH RECURSIVE c AS (SELECT a.o_custkey || ':' || year(b.o_orderdate) AS g, year(b.o_orderdate) AS y, a.o_orderkey AS l, b.o_orderkey AS r, abs(CAST(a.o_totalprice AS DOUBLE) - b.o_totalprice) AS d FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND year(b.o_orderdate) = year(a.o_orderdate) + 1),
ck AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY d, l, r) AS k FROM c),
gr AS (SELECT DISTINCT g, y, 0::BIGINT AS k, []::BIGINT[] AS ul, []::BIGINT[] AS ur FROM ck UNION ALL
 SELECT gr.g, gr.y, ck.k, CASE WHEN list_contains(ul, ck.l) OR list_contains(ur, ck.r) THEN ul ELSE list_append(ul, ck.l) END, CASE WHEN list_contains(ul, ck.l) OR list_contains(ur, ck.r) THEN ur ELSE list_append(ur, ck.r) END
 FROM gr JOIN ck ON ck.g = gr.g AND ck.k = gr.k + 1),
gf AS (SELECT g, arg_max(y, k) AS y, arg_max(ul, k) AS ul, arg_max(ur, k) AS ur FROM gr GROUP BY g)
SELECT CAST(y AS INT) AS y, unnest(ul) AS before, unnest(ur) AS now FROM gf""")
def greedy_rounds(spark: SparkSession, d: str) -> DataFrame:
    """A year's orders in one group, each with an order of the same customer of the year before, nearest in price first.

    Candidates never cross customers, so the SQL may go customer by customer.
    """
    u = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("now"), F.col("o_totalprice").cast("double").alias("price"))
    before = u.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("now").alias("before"), F.col("price").alias("was"))
    near = before.join(u, ["o_custkey", "y"]).withColumn("dist", F.abs(F.col("was") - F.col("price")))
    return matching.greedy_rounds(near, ["y"], "before", "now", "dist").select("y", "before", "now")


@query("""WITH b AS (SELECT p_partkey, greatest(0.0, least(-15, -p_size + 10.0) - greatest(-40, -p_size - 10.0)) AS w, greatest(0.0, least(30, p_size % 40 + 5.0) - greatest(0, p_size % 40 - 5.0)) AS h FROM part)
SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN round(w * h, 4) END AS area FROM b""")
def clip_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clipped to a frame: what is left of each is its overlap with it."""
    s = F.col("p_size")
    corner = lambda x, y: F.struct((-s + F.lit(x)).cast("double").alias("lon"), (s % 40 + F.lit(y)).cast("double").alias("lat"))
    ring = F.array(*(corner(x, y) for x, y in ((-10, -5), (10, -5), (10, 5), (-10, 5))))
    out = geometry.clip_rings(table(spark, d, "part").select("p_partkey", ring.alias("ring")), "ring", (-40.0, 0.0, -15.0, 30.0))
    area = r4(geometry.ring_area(F.col("ring")))
    return out.select("p_partkey", F.when(area > 0, area).alias("area"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size / 50.0 > 0.5 THEN 4 ELSE 2 END AS INT) AS points FROM part")
def simplify_rings(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose two bumps go if they are no higher than half a degree, and stay otherwise, without the point between them."""
    a = F.col("p_size") / F.lit(50.0)
    line = F.array(*(F.struct(F.lit(x).alias("lon"), y.cast("double").alias("lat")) for x, y in ((0.0, F.lit(0)), (25.0, a), (50.0, F.lit(0)), (75.0, -a), (100.0, F.lit(0)))))
    return geometry.simplify_lines(table(spark, d, "part").select("p_partkey", line.alias("ring")), "ring", 0.5).select("p_partkey", F.size("ring").alias("points"))


@query("SELECT p_partkey, CASE WHEN b < 0 THEN NULL WHEN h < 0 THEN NULL ELSE h END AS hours FROM (SELECT *, b * 24 + (h1 - h0) AS h FROM (SELECT p_partkey, h0, h1, CASE WHEN d1 - d0 >= 0 THEN d1 - d0 WHEN d1 - d0 + 31 BETWEEN 0 AND 6 THEN d1 - d0 + 31 WHEN d1 - d0 + 30 BETWEEN 0 AND 6 THEN d1 - d0 + 30 WHEN d1 - d0 + 29 BETWEEN 0 AND 6 THEN d1 - d0 + 29 WHEN d1 - d0 + 28 BETWEEN 0 AND 6 THEN d1 - d0 + 28 ELSE -1 END AS b FROM (SELECT p_partkey, CAST(25 + p_size % 6 AS INT) AS d0, CAST(1 + p_size % 5 + CASE WHEN p_size % 7 = 0 THEN 25 ELSE 0 END AS INT) AS d1, CAST(p_size % 24 AS INT) AS h0, CAST((p_size * 5) % 24 AS INT) AS h1 FROM part)))")
def forecast_hours(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    to_day = 1 + s % 5 + F.when(s % 7 == 0, 25).otherwise(0)
    return table(spark, d, "part").select("p_partkey", scalars.forecast_hours(25 + s % 6, s % 24, to_day, (s * 5) % 24).alias("hours"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(p_partkey AS INT) AS advisory, CAST(p_size / 2.0 AS DOUBLE) AS lat, CAST(-(p_size + 40.0) AS DOUBLE) AS lon, p_size + 30 AS wind_kt, p_size * 2 AS ne_34,
 CAST(3 AS BIGINT) AS n_track, CAST(96 AS INT) AS last_hours, 'Post-Tropical Cyclone' AS classification FROM part""")
def advisory_fields(spark: SparkSession, d: str) -> DataFrame:
    place = "%.1fN  %.1fW"
    lines = (
        "POST-TROPICAL CYCLONE TEST FORECAST/ADVISORY NUMBER %d\n\nPOST-TROPICAL CYCLONE CENTER LOCATED NEAR " + place + " AT 30/0600Z\n\n"
        "MAX SUSTAINED WINDS %d KT WITH GUSTS TO 99 KT.\n34 KT.......%3dNE   0SE   0SW  10NW.\n\n"
        "FORECAST VALID 30/1800Z 20.0N  50.0W\nMAX WIND  40 KT\n\nFORECAST VALID 01/0600Z 21.0N  51.0W\n34 KT... 99NE 0SE 0SW 0NW.\n\n"
        "OUTLOOK VALID 03/0600Z 22.0N  52.0W...DISSIPATED\n\nOUTLOOK VALID 04/0600Z...DISSIPATED\n"
    )
    s = F.col("p_size")
    told = F.format_string(lines, "p_partkey", s / F.lit(2.0), (s + F.lit(40.0)), s + 30, s * 2)
    parts = spread(table(spark, d, "part").select("p_partkey", "p_size"))
    rows = advisories.advisories(once(parts, text=told).select(F.col("p_partkey").cast("string").alias("file"), "text"))
    return rows.select(
        "file", "advisory", "center.lat", "center.lon", "wind_kt", F.col("wind_radii")[34]["ne"].alias("ne_34"), F.size("track").cast("long").alias("n_track"),
        F.try_element_at("track", F.lit(-1))["hours"].alias("last_hours"), "classification",
    )


@query("""SELECT p_partkey, CAST(least(p_size, 20) AS DOUBLE) AS south, CAST(greatest(p_size, 20) AS DOUBLE) AS north, CAST(-p_size - 40 AS DOUBLE) AS west, CAST(-p_size - 20 AS DOUBLE) AS east, p_size % 2 = 0 AS strong FROM part""")
def convection_boxes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    told = F.format_string("A 1012 mb low. %s is noted\nfrom %dN to 20N between %dW and\n%dW.", F.when(s % 2 == 0, "Strong convection").otherwise("Convection"), s, s + 20, s + 40)
    return discussions.convection_boxes(table(spark, d, "part").select("p_partkey", told.alias("body"))).drop("source", "context")


@query("""SELECT p_partkey, unnest([CAST(p_size + 0.5 AS DOUBLE), CAST(-p_size AS DOUBLE)]) AS lat, unnest([CAST(-76 AS DOUBLE), CAST(100 AS DOUBLE)]) AS lon FROM part""")
def point_fixes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    told = F.format_string("A low is centered near %d.5N76W. A ship\nat %dS 100E reports; 12N 30W is no fix.", s, s)
    return discussions.point_fixes(table(spark, d, "part").select("p_partkey", told.alias("body"))).drop("source", "context")


@query("""WITH t AS (SELECT p_partkey, k, p_size % 30 + 10.0 + k AS lat, -p_size - 20.0 - 2.0 * k AS lon, CASE WHEN p_partkey % 2 = 0 THEN [10, 37, 56, 78] ELSE [10, 39, 62, 95] END[k + 1] AS nm FROM part CROSS JOIN (SELECT unnest(range(4)) AS k)),
h AS (SELECT *, lead(lat) OVER w AS la, lead(lon) OVER w AS lo FROM t WINDOW w AS (PARTITION BY p_partkey ORDER BY k)),
c AS (SELECT *, degrees(atan2((lo - lon) * cos(radians((lat + la) / 2)), la - lat)) AS nxt FROM h),
d AS (SELECT *, lag(nxt) OVER (PARTITION BY p_partkey ORDER BY k) AS prv FROM c),
e AS (SELECT p_partkey, k, lat, lon, nm, CASE WHEN k = 0 THEN nxt WHEN k = 3 THEN prv ELSE degrees(atan2(sin(radians(prv)) + sin(radians(nxt)), cos(radians(prv)) + cos(radians(nxt)))) END AS hd FROM d),
r AS (SELECT p_partkey, k AS o, lat, lon, nm, hd - 90 AS b FROM e UNION ALL SELECT p_partkey, 3 + i, lat, lon, nm, hd - 90 + i * 22.5 FROM e CROSS JOIN (SELECT unnest(range(1, 8)) AS i) WHERE k = 3
 UNION ALL SELECT p_partkey, 14 - k, lat, lon, nm, hd + 90 FROM e UNION ALL SELECT p_partkey, 14 + i, lat, lon, nm, hd + 90 + i * 22.5 FROM e CROSS JOIN (SELECT unnest(range(1, 8)) AS i) WHERE k = 0),
x AS (SELECT p_partkey, o, lon + nm * sin(radians(b)) / (60 * cos(radians(lat))) AS x, lat + nm * cos(radians(b)) / 60 AS y FROM r),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM x WINDOW w AS (PARTITION BY p_partkey ORDER BY o))
SELECT p_partkey, CAST(count(*) AS INT) AS points, round(abs(sum(x * y2 - x2 * y)) / 2, 4) AS area FROM n GROUP BY 1""")
def forecast_cones(spark: SparkSession, d: str) -> DataFrame:
    """The ring of a track of four points from each part's numbers."""
    s = F.col("p_size").cast("double")
    points = F.array(*(F.struct((s % 30 + 10 + k).alias("lat"), (-s - 20 - 2.0 * k).alias("lon"), F.lit(24 * k).alias("hours")) for k in range(4)))
    cone = geometry.forecast_cone(points, F.when(F.col("p_partkey") % 2 == 0, "EP").otherwise("AL"))
    return table(spark, d, "part").select("p_partkey", F.size(cone).alias("points"), r4(geometry.ring_area(cone)).alias("area"))
