"""Session defaults: UTC clock, adaptive execution, Arrow for the few Python stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    os.environ.setdefault("PYSPARK_PYTHON", "python")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("stormframe")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all tasks: a Parquet file of a few MB is read by few of them, however long its rows take after that."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


#: Rows of a join or sort that a task takes, about, where tasks are dealt by rows.
ROWS = 1 << 20


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt by key over a task for each ROWS of ``rows``, where shuffles have fewer tasks than that.

    The number of a session's shuffle partitions is fixed, so what a task sorts would grow with the input.
    Sides that are dealt by the same ``rows`` meet without another shuffle.
    """
    n = -(-rows // ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged, never broadcast.

    What a Parquet table is taken to weigh is the size of its compressed columns,
    so millions of short rows of a stored table would go through the driver.
    """
    return df.hint("merge")


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Add columns that are worked out once a row, whatever reads them.

    The optimizer puts an expression into each filter and column that names it,
    and again for each field that is taken of it; what a generator gives stays as it is.
    """
    kept = [c for c in df.columns if c not in values]
    told = df.select(*kept, F.explode(F.array(F.struct(*(v.alias(k) for k, v in values.items())))).alias("_once"))
    return told.select(*kept, *(F.col("_once")[k].alias(k) for k in values))


def settled(df: DataFrame) -> DataFrame:
    """A table that several plans read, worked out once and written as Parquet in the folder that driver and executors share.

    That is ``spark.checkpoint.dir``; only a local session without it, as in tests, gets a folder of its own.
    Later reads take the columns they need. Who runs many seasons in one session calls ``drop_settled`` between them.
    What was shuffled for a table goes once it is written; else it would stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_SETTLED: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def let_go(df: DataFrame) -> None:
    """Delete a table of ``settled`` that no plan reads any more."""
    files = df.inputFiles()
    for path in [p for p in _SETTLED if any(f"/{os.path.basename(p)}/" in f for f in files)]:
        _delete(df.sparkSession, path)
        _SETTLED.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_settled(spark: SparkSession) -> int:
    """Delete the tables of ``settled``; plans over them can't run after this. Returns how many there were."""
    n = len(_SETTLED)
    for path in _SETTLED:
        _delete(spark, path)
    _SETTLED.clear()
    return n
