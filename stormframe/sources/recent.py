"""A list of recent products and its items, as they have landed: a Python data source with a partition for each item."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "recent_products"
SCHEMA = "place int, id string, text string, error string"


def _read(path: str) -> dict:
    """A JSON file by a local path or by the address of a store."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_stream(inner) as f:
        return json.loads(f.read())


class Item(InputPartition):
    def __init__(self, place: int, key: str) -> None:
        self.place, self.key = place, key


class RecentReader(DataSourceReader):
    """Each item of the list is a partition; one that can't be read has an empty text and says why."""

    def __init__(self, options: dict) -> None:
        self.folder, self.newest = options["path"].rstrip("/"), int(options.get("newest", 30))

    def partitions(self) -> list[Item]:
        told = _read(f"{self.folder}/list.json")
        items = (told.get("@graph") or told.get("features") or [])[: self.newest]
        return [Item(k, str(x.get("@id") or x.get("id") or "")) for k, x in enumerate(items)] or [Item(-1, "")]

    def read(self, partition: Item) -> Iterator[tuple]:
        if partition.place < 0:
            return
        try:
            text, error = _read(f"{self.folder}/{partition.key.rstrip('/').rsplit('/', 1)[-1]}.json").get("productText") or "", None
        except (OSError, ValueError, AttributeError) as e:
            text, error = "", type(e).__name__
        yield (partition.place, partition.key, text, error)


class RecentProducts(DataSource):
    """``place`` (0 is the newest)``, id, text, error`` of the first ``newest`` items that ``list.json`` of a folder names.

    An item's file has the last part of its id as its name. A list that can't be read is an error.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecentReader:
        return RecentReader(self.options)


def recent_products(spark: SparkSession, folder: str, newest: int = 30) -> DataFrame:
    spark.dataSource.register(RecentProducts)
    return spark.read.format(FORMAT).option("newest", newest).load(folder)


def newest_with(recent: DataFrame, product_id: str, keep: int = 1) -> DataFrame:
    """The newest rows whose text holds an id; an item that failed is no match."""
    return recent.filter(F.contains("text", F.lit(product_id))).orderBy("place").limit(keep)
