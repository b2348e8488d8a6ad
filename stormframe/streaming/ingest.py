"""Files as they land: products that are appended once by name, and best-track snapshots that are merged as they change."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stormframe.operators.matching import not_superseded
from stormframe.sources.products import best_track_files, name_products, new_rows, upsert_actions

#: Seasons and basins are folders, so that a batch is compared with the files of its own ones only.
FOLDERS = ["season", "basin"]
_SNAPSHOT = r"(b(?:al|ep)\d{2}(\d{4}))\.(\d{12})\.dat$"


def table_or_none(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A Parquet table, without rows before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def append_products(batch: DataFrame, path: str) -> None:
    """Append the products of ``file, text`` rows whose names the table does not have; line ends become LF.

    A batch that comes again, as after a restart, appends nothing.
    """
    rows = name_products(batch).withColumn("season", F.substring("stamp", 1, 4)).persist()
    known = table_or_none(batch.sparkSession, path, rows.schema)
    # A season's basins are few.
    of_batch = known.join(F.broadcast(rows.select(*FOLDERS).distinct()), FOLDERS, "left_semi")
    new = new_rows(rows, of_batch, "file").persist()
    if not new.isEmpty():
        new.repartition(*FOLDERS).write.mode("append").partitionBy(*FOLDERS).parquet(path)
    new.unpersist()
    rows.unpersist()


def landed(spark: SparkSession, folder: str, names: str) -> DataFrame:
    """A stream of ``file, text, landed``: each file that lands in a folder or below it, whole."""
    files = spark.readStream.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("landed"))


def ingest_products(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Take in the product files that have landed since the last run; each name is appended once."""
    stream = landed(spark, folder, "T*.txt").drop("landed")
    return stream.writeStream.foreachBatch(lambda batch, _: append_products(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_snapshots(batch: DataFrame, path: str, version: int) -> None:
    """Merge ``file, text, landed`` rows of best-track files into a table keyed by base and stamp.

    A new key is added, other bytes under a known key replace it, equal bytes
    write nothing. A season with a change is written anew as a version of its
    own, so readers never see half of one; the same batch writes the same version
    again. Of two files with one key in a batch the last to land counts.
    """
    spark = batch.sparkSession
    base, season, stamp = (F.regexp_extract("file", _SNAPSHOT, k) for k in (1, 2, 3))
    rows = batch.filter(F.col("file").rlike(_SNAPSHOT)).select("file", base.alias("base"), stamp.alias("stamp"), "text", "landed", season.alias("season"))
    last = rows.groupBy("base", "stamp", "season").agg(F.max_by(F.struct("file", "text", "landed"), F.struct("landed", "text")).alias("r"))
    last = last.select("r.file", "base", "stamp", "r.text", "r.landed", "season").persist()
    known = current_snapshots(spark, path, before=version)
    changed = upsert_actions(last, known, ["base", "stamp"], "text").filter("action <> 'skip'").drop("action").persist()
    if not changed.isEmpty():
        kept = known.join(F.broadcast(changed.select("season").distinct()), "season", "left_semi").join(changed, ["base", "stamp"], "left_anti")
        whole = kept.unionByName(changed).withColumn("version", F.lit(version))
        whole.repartition("season").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "version").parquet(path)
    changed.unpersist()
    last.unpersist()


SNAPSHOTS = "file string, base string, stamp string, text string, landed timestamp, season string, version int"


def current_snapshots(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``file, base, stamp, text, landed, season``: the newest version of each season (before a stated one)."""
    rows = table_or_none(spark, path, StructType.fromDDL(SNAPSHOTS))
    rows = rows if before is None else rows.filter(F.col("version") < before)
    newest = rows.groupBy("season").agg(F.max("version").alias("version"))
    return rows.join(F.broadcast(newest), ["season", "version"], "left_semi").drop("version")


def current_eras(snapshots: DataFrame) -> DataFrame:
    """Best-track files of the snapshots, without those whose era a later snapshot of their base contains."""
    lines = snapshots.select("file", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    return not_superseded(best_track_files(lines), "base", "stamp", "min_dtg", "max_dtg")


def ingest_snapshots(spark: SparkSession, folder: str, path: str, checkpoint: str) -> StreamingQuery:
    """Take in the best-track files that have landed since the last run."""
    stream = landed(spark, folder, "b*.dat")
    return stream.writeStream.foreachBatch(lambda batch, k: merge_snapshots(batch, path, k + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
