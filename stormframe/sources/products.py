"""Text products and best-track files as tables; writers that do not repeat themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stormframe.functions.scalars import is_stale, pad_dtg, stamp_time, tenths_to_degrees

_NAME = r"(?:^|/)(?:(TW[OD])(AT|EP)|TCM(AT|EP)\d?)\.(\d{12})\.txt$"
_TRACK = r"(b((?:al|ep)(\d{2})(\d{4})))\.(\d{12})\.dat$"
# Fixed value: status codes of a tropical or subtropical cyclone.
CYCLONE_STATUS = ("TD", "TS", "HU", "TY", "ST", "SD", "SS")


def read_products(spark: SparkSession, folder: str) -> DataFrame:
    """``file, kind, basin, stamp, ts, text`` of each product file; other names are left out before reading."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "T*.txt").text(folder, wholetext=True)
    return name_products(raw.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def name_products(files: DataFrame) -> DataFrame:
    """Kind, basin and time from ``file, text`` rows; line ends become LF."""
    outlook = F.regexp_extract("file", _NAME, 1)
    named = files.filter(F.col("file").rlike(_NAME)).select(
        "file",
        F.when(outlook != "", outlook).otherwise("TCM").alias("kind"),
        F.concat(F.regexp_extract("file", _NAME, 2), F.regexp_extract("file", _NAME, 3)).alias("basin"),
        F.regexp_extract("file", _NAME, 4).alias("stamp"),
        F.regexp_replace("text", "\r\n?", "\n").alias("text"),
    )
    return named.withColumn("ts", stamp_time(F.col("stamp")))


def since(products: DataFrame, bound: str | None) -> DataFrame:
    """Products from a day (``2026-06-01`` or ``20260601``) at 00 UTC on; a bound that is none keeps all."""
    day = (bound or "").replace("-", "")
    return products.filter(F.col("stamp") >= F.lit(day + "0000")) if len(day) == 8 and day.isdigit() else products


def with_errors(products: DataFrame, parsed: DataFrame) -> DataFrame:
    """Every product with its parsed columns; one that gave nothing has ``error``, and stays a row."""
    rest = [c for c in parsed.columns if c != "file"]
    joined = products.select("file", "kind", "stamp", F.col("text").isNull().alias("_empty")).join(parsed.withColumn("_found", F.lit(True)), "file", "left")
    error = F.when(F.col("_empty"), "no text").when(F.col("_found").isNull(), "not parsed")
    return joined.select("file", "kind", "stamp", *rest, error.alias("error"))


def latest_of_basin(products: DataFrame, newest: int = 12) -> DataFrame:
    """The newest product of each basin among so many newest ones; order by time, then file."""
    few = products.orderBy(F.desc("ts"), F.desc("file")).limit(newest)
    return few.withColumn("_n", F.row_number().over(Window.partitionBy("basin").orderBy(F.desc("ts"), F.desc("file")))).filter("_n = 1").drop("_n")


def matching(products: DataFrame, product_id: str, newest: int = 30, keep: int = 8) -> DataFrame:
    """Of so many newest products the newest whose text has the id on a line of its own; a failed text does not match."""
    few = products.orderBy(F.desc("ts"), F.desc("file")).limit(newest)
    return few.filter(F.coalesce(F.col("text").rlike(rf"(?m)^{product_id}\b"), F.lit(False))).orderBy(F.desc("ts"), F.desc("file")).limit(keep)


def with_mirror(primary: DataFrame, mirror: DataFrame, now: Column) -> DataFrame:
    """The primary's product of each basin, or the mirror's where the primary is missing or stale and the mirror is strictly newer."""
    p = primary.select("basin", F.struct("file", "ts", "text").alias("p"))
    m = mirror.select("basin", F.struct("file", "ts", "text").alias("m"))
    newer = F.coalesce(F.col("m.ts") > F.col("p.ts"), F.lit(True)) & F.col("m.ts").isNotNull()
    use = (F.col("p").isNull() | is_stale(F.col("p.ts"), now)) & newer
    both = p.join(m, "basin", "full_outer").withColumn("x", F.when(use, F.col("m")).otherwise(F.col("p")))
    return both.select("basin", "x.*", F.when(use, "mirror").otherwise("primary").alias("source")).filter("file IS NOT NULL")


def resolve_manifest(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """The first listed name, in order, that begins with each wanted ``type`` and time ``prefix``; null if none does."""
    starts = F.concat("type", F.lit("."), "prefix")
    kinds = names.select("name", F.substring_index("name", ".", 1).alias("type"))
    met = wanted.join(kinds, "type", "left").filter(F.col("name").isNull() | F.startswith("name", starts))
    return wanted.join(met.groupBy("type", "prefix").agg(F.min("name").alias("name")), ["type", "prefix"], "left")


def bijection(raw: DataFrame, derived: DataFrame, key: str = "file") -> DataFrame:
    """Keys that only one of the two has, or that one has twice; none if every file has its record."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(raw, "raw").join(count(derived, "derived"), key, "full_outer").fillna(0, ["raw", "derived"])
    return both.filter("raw <> 1 OR derived <> 1")


def geojson_features(text: DataFrame, column: str = "value") -> DataFrame:
    """``layer, kind, line``: each line or outer ring of feature collections, points as ``lon, lat``."""
    shape = "struct<features:array<struct<geometry:struct<type:string,coordinates:string>>>>"
    feature = F.explode(F.from_json(column, shape)["features"])
    kept = [c for c in text.columns if c != column]
    rows = text.select(*kept, feature.alias("f")).select(*kept, F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    deep = {"LineString": 2, "MultiLineString": 3, "Polygon": 3, "MultiPolygon": 4}
    read = lambda n: F.from_json("c", "array<" * n + "double" + ">" * n)
    lines = (
        F.when(F.col("kind") == "LineString", F.array(read(deep["LineString"])))
        .when(F.col("kind") == "MultiLineString", read(deep["MultiLineString"]))
        .when(F.col("kind") == "Polygon", F.slice(read(deep["Polygon"]), 1, 1))
        .when(F.col("kind") == "MultiPolygon", F.transform(read(deep["MultiPolygon"]), lambda p: p[0]))
    )
    points = rows.select(*kept, "kind", F.explode(lines).alias("l"))
    return points.select(*kept, "kind", F.transform("l", lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("line"))


def read_best_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """``file, n, line`` of best-track files, in file order."""
    raw = spark.read.option("pathGlobFilter", "b*.dat").text(folder, wholetext=True)
    lines = F.posexplode(F.split("value", "\r?\n"))
    return raw.select(F.col("_metadata.file_name").alias("file"), lines.alias("n", "line"))


def best_track_fixes(lines: DataFrame) -> DataFrame:
    """One row per file and time: the first of its lines. Ragged lines are split, not read as CSV."""
    f = F.transform(F.split("line", ","), lambda x: F.trim(x))
    at = lambda k: F.get("f", F.lit(k))
    rows = lines.withColumn("f", f).filter((F.size("f") >= 11) & at(2).rlike(r"^\d{10}(\d{2})?$"))
    told = rows.select(
        "file",
        "n",
        at(0).alias("basin"),
        at(1).alias("num"),
        pad_dtg(at(2)).alias("dtg"),
        tenths_to_degrees(at(6)).alias("lat"),
        tenths_to_degrees(at(7)).alias("lon"),
        F.coalesce(at(8).try_cast("int"), F.lit(0)).alias("vmax"),
        at(10).alias("status"),
        F.coalesce(at(27), F.lit("")).alias("name"),
        "f",
    )
    first = told.groupBy("file", "dtg").agg(F.min_by(F.struct(*[c for c in told.columns if c not in ("file", "dtg")]), "n").alias("r"))
    return first.select("file", "dtg", "r.*")


def best_track_files(lines: DataFrame) -> DataFrame:
    """One row per snapshot: names in order of appearance, genesis number, references, first cyclone time, first and last time in file order."""
    f = F.transform(F.split("line", ","), lambda x: F.trim(x))
    at = lambda k: F.get("f", F.lit(k))
    rows = lines.withColumn("f", f).filter((F.size("f") >= 11) & at(2).rlike(r"^\d{10}(\d{2})?$") & F.col("file").rlike(_TRACK))
    pairs = F.zip_with(F.slice("f", F.lit(1), F.size("f") - 1), F.slice("f", F.lit(2), F.size("f") - 1), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    name = F.coalesce(at(27), F.lit(""))
    is_name = (name != "") & (name != "INVEST") & ~name.rlike(r"^GENESIS\d+$")
    handoff = F.filter("pairs", lambda p: p["k"].isin("SPAWNINVEST", "TRANSITIONED", "DISSIPATED"))
    ids = F.flatten(F.transform(handoff, lambda p: F.transform(F.regexp_extract_all(p["v"], F.lit(r"(?i)([a-z]{2}[0-9a-z]{2}\d{4})"), 1), F.lower)))
    number = F.filter("pairs", lambda p: (p["k"] == "genesis-num") & (p["v"] != ""))
    rows = rows.withColumn("pairs", pairs).select(
        "file", "n", pad_dtg(at(2)).alias("dtg"), at(10).alias("status"), F.when(is_name, name).alias("name"),
        ids.alias("ids"), F.try_element_at(F.transform(number, lambda p: p["v"]), F.lit(-1)).alias("genesis"), at(0).alias("basin"),
    )
    made = rows.groupBy("file").agg(
        F.min_by("basin", "n").alias("basin"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("n", "name")))), lambda x: x["name"])).alias("names"),
        F.max_by("genesis", F.when(F.col("genesis").isNotNull(), F.col("n"))).alias("genesis_num"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("refs"),
        F.min_by("dtg", F.when(F.col("status").isin(*CYCLONE_STATUS), F.col("n"))).alias("first_td_dtg"),
        F.min_by("dtg", "n").alias("min_dtg"),
        F.max_by("dtg", "n").alias("max_dtg"),
    )
    return made.select(
        "*",
        F.regexp_extract("file", _TRACK, 1).alias("base"),
        F.regexp_extract("file", _TRACK, 2).alias("id"),
        F.regexp_extract("file", _TRACK, 3).cast("int").alias("num"),
        F.regexp_extract("file", _TRACK, 5).alias("stamp"),
    )


def new_rows(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows to append: those whose key is not there yet."""
    return incoming.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def upsert_actions(incoming: DataFrame, known: DataFrame, keys: list[str], content: str) -> DataFrame:
    """write, skip or overwrite for each incoming row, by a digest of its content."""
    old = known.select(*keys, F.sha2(content, 256).alias("_old"))
    joined = incoming.join(old, keys, "left")
    action = F.when(F.col("_old").isNull(), "write").when(F.col("_old") == F.sha2(content, 256), "skip").otherwise("overwrite")
    return joined.withColumn("action", action).drop("_old")


def listed_names(html: DataFrame, column: str, pattern: str) -> DataFrame:
    """The sorted distinct file names of directory listings."""
    return html.select(F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(pattern), 0))).alias("name")).distinct().orderBy("name")
