"""Writers of ordered files; tables with versions are in ``bucketed``, fitted parameters in ``bundles``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] = (), order: list[str] = ()) -> None:
    """Snappy Parquet, sorted inside files so that key ranges prune.

    With partition columns, rows are spread by them and a hash of the order
    columns, so one hot partition value is written by many tasks.
    """
    if partition_by:
        df = df.repartition(*partition_by, *order)
    if order:
        df = df.sortWithinPartitions(*partition_by, *order)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path, compression="snappy")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)
