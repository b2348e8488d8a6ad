"""Writers: the same rows give the same files, partitions by basin, and nothing is written from flagged rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(rows: DataFrame, path: str, by: tuple[str, ...] = ("season", "basin")) -> None:
    """Overwrite a table with a folder for each season and basin."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)


def json_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """``line``: each row as JSON with its columns in order and its nulls, in a stated total order."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.orderBy(*order).select(line.alias("line"))


def write_json(rows: DataFrame, path: str, order: list[str]) -> None:
    """Overwrite a folder of JSON lines; no clock and no chance goes into it."""
    json_lines(rows, order).write.mode("overwrite").text(path)


def write_unflagged(rows: DataFrame, path: str, flags: str = "flags") -> None:
    """Overwrite a table of fixtures, unless any row is flagged: then nothing is written."""
    bad = rows.filter(F.size(flags) > 0).count()
    if bad:
        raise ValueError(f"{bad} flagged rows, nothing written to {path}")
    rows.write.mode("overwrite").parquet(path)


def write_report(audited: DataFrame, totals: DataFrame, path: str) -> None:
    """An audit's rows and totals side by side."""
    audited.write.mode("overwrite").parquet(f"{path}/rows")
    totals.write.mode("overwrite").parquet(f"{path}/totals")


def write_layers(layers: dict[str, DataFrame], path: str) -> None:
    """A Parquet table for each layer of a map."""
    for name, rows in layers.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
