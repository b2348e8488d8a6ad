"""Paths of rows that each name their predecessor: every row's first row and its place, by doubling pointers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stormframe.session import settled


def path_places(rows: DataFrame, node: str, before: str, step: str | None = None) -> DataFrame:
    """``node, root, place``: where the path to each row begins, and how many steps it is from there (0 for a first row).

    A row has at most one predecessor and is that of at most one row; a null
    predecessor, or one that is no row, makes it a first row. In each round a row
    that has not met its root skips as far as its pointer has come, so the rounds
    grow with the logarithm of the longest path, and no task holds a path. Rows
    that have met their root move no more. ``step``, where given, is how far a row is from its predecessor.
    """
    known = rows.select(F.col(node).alias("_k"))
    far = (F.lit(1) if step is None else F.col(step)).cast("long").alias("_far")
    linked = rows.select(F.col(node).alias("node"), F.col(before).alias("at"), far).join(known, F.col("at") == F.col("_k"), "left")
    now = settled(linked.select("node", F.coalesce("_k", "node").alias("at"), F.when(F.col("_k").isNotNull(), F.col("_far")).otherwise(0).alias("place"), F.col("_k").isNull().alias("met")))
    while not now.filter("NOT met").isEmpty():
        target = now.select(F.col("node").alias("at"), F.col("at").alias("_next"), F.col("place").alias("_more"), F.col("met").alias("_met"))
        moved = now.filter("NOT met").join(target, "at").select("node", F.col("_next").alias("at"), (F.col("place") + F.col("_more")).alias("place"), F.col("_met").alias("met"))
        now = settled(now.filter("met").unionByName(moved))
    return now.select("node", F.col("at").alias("root"), "place")


#: Numbers of one key that a task walks through in their order.
BLOCK = 4096


def numbered_places(rows: DataFrame, key: str, number: str, item: str, before: str, block: int = BLOCK) -> DataFrame:
    """Rows with ``root, place`` as of ``path_places``, where a predecessor is the item ``before`` of the number one less.

    Numbers are cut into blocks. A task walks through a block in order and holds
    one number's items, so a path costs no rounds there; only stretches that
    come from an earlier block are put together by doubling pointers, one row for
    each of them however long it is. The result is stored, as both steps read it.
    """
    kept = rows.columns
    cut = rows.withColumn("_block", F.floor(F.col(number) / block)).repartition(key, "_block").sortWithinPartitions(key, number, item)
    schema = StructType([*cut.schema.fields, StructField("_from", LongType()), StructField("_first", cut.schema[item].dataType), StructField("_steps", LongType())])
    walked = settled(cut.mapInArrow(lambda batches: _walk(batches, key, number, item, before, block), schema))
    node = lambda n, i: F.concat_ws(":", key, n, i)
    walked = walked.withColumn("_root", node("_from", "_first"))
    heads = walked.filter((F.col("_steps") == 0) & F.col(before).isNotNull()).select("_root", node(F.col(number) - 1, before).alias("_at"))
    ends = walked.filter(F.pmod(F.col(number), F.lit(block)) == block - 1).select(node(number, item).alias("_at"), F.col("_root").alias("_stretch"), (F.col("_steps") + 1).alias("_far"))
    linked = heads.join(ends, "_at", "left").select("_root", "_stretch", "_far")
    # The stretch that another goes on with is a node too, wherever it begins.
    firsts = linked.select(F.col("_stretch").alias("_root")).filter("_root IS NOT NULL").distinct().join(linked.select("_root"), "_root", "left_anti")
    nodes = linked.unionByName(firsts.select("_root", F.lit(None).cast("string").alias("_stretch"), F.lit(None).cast("long").alias("_far")))
    places = path_places(settled(nodes), "_root", "_stretch", "_far").select(F.col("node").alias("_root"), F.col("root"), F.col("place").alias("_more"))
    out = walked.join(places, "_root", "left")
    return out.select(*kept, F.coalesce("root", "_root").alias("root"), (F.col("_steps") + F.coalesce("_more", F.lit(0))).alias("place"))


def _walk(batches: Iterator[pa.RecordBatch], key: str, number: str, item: str, before: str, block: int) -> Iterator[pa.RecordBatch]:
    """Add to sorted rows the number and item at which their stretch begins in its block, and the steps from there."""
    at, last, now = None, {}, {}
    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (key, number, item, before))
        begins, firsts, steps = [], [], []
        for k, n, i, b in zip(*columns, strict=True):
            if at != (k, n):
                last = now if at == (k, n - 1) and n % block else {}
                at, now = (k, n), {}
            place = last.get(b) if b is not None else None
            now[i] = place = (n, i, 0) if place is None else (place[0], place[1], place[2] + 1)
            begins.append(place[0])
            firsts.append(place[1])
            steps.append(place[2])
        kind = batch.schema.field(item).type
        added = [pa.array(begins, pa.int64()), pa.array(firsts, kind), pa.array(steps, pa.int64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_from", "_first", "_steps"])
