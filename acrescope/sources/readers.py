"""Readers: explicit schemas, closed value sets and shape checks inside the plan."""

from __future__ import annotations

import csv
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from acrescope import constants as K
from acrescope.functions import scalars as S
from acrescope.operators.quality import expect_columns
from acrescope.session import _file_system


def guard(df: DataFrame, ok: Column, message: Column | str) -> DataFrame:
    """Fail the job on the first row that breaks a rule (no extra pass)."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def clean_doubles(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column, at the source boundary."""
    return df.withColumns({n: S.null_if_nan(n) for n, t in df.dtypes if t in ("double", "float")})


def read_panel(spark: SparkSession, path: str, required: list[str], states: list[str], key: str = "geoid", state: str = "state") -> DataFrame:
    """Master panel with padded keys; unknown dates or states fail the read."""
    df = spark.read.parquet(path)
    expect_columns(df, required)
    df = clean_doubles(df).withColumn(key, S.zfill(key, 5))
    df = guard(df, F.col("forecast_date").isin(*K.FORECAST_DATES), F.concat(F.lit("unknown forecast date "), "forecast_date"))
    return guard(df, F.col(state).isin(*states), F.concat(F.lit("unknown state "), state))


def read_min_year(spark: SparkSession, path: str, schema: str, min_year: int) -> DataFrame:
    """CSV survey rows from a year on; with a year layout this prunes folders."""
    return clean_doubles(spark.read.schema(schema).csv(path, header=True).where(F.col("year") >= min_year))


def read_static(spark: SparkSession, path: str, schema: str, drop: list[str]) -> DataFrame:
    """Static dimension; columns it has no authority over are dropped."""
    return clean_doubles(spark.read.schema(schema).csv(path, header=True)).drop(*drop)


def read_dated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Per-date feature table; the date label is text and must be known."""
    df = clean_doubles(spark.read.schema(schema).csv(path, header=True))
    return guard(df, F.col("forecast_date").isin(*K.FORECAST_DATES), "unknown forecast date")


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: its first line is read and nothing else."""
    store, place = _file_system(spark, path)
    stream = store.open(place)
    try:
        line = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        stream.close()
    return next(csv.reader([(line or "").removeprefix("\ufeff")]), [])


def glob_union(spark: SparkSession, path: str, key: str, declared: str, parallelism: int = 16) -> DataFrame:
    """Per-year CSV files whose columns differ, by name, as the declared columns (a schema string) with their types.

    Only first lines are read to learn the layouts, from whatever store Spark reads; then there is one scan per distinct layout, and
    a column that a file lacks is NULL in its rows. A file without the key column (unless it is empty), a declared column absent from
    every file, and a value that is not of its column's type are errors. The driver sees the name and header of every file, as a listing does.
    """
    files = sorted(spark.read.format("binaryFile").load(path).inputFiles())
    with ThreadPool(parallelism) as pool:
        headers = dict(zip(files, pool.map(inheritable_thread_target(spark)(lambda f: _header(spark, f)), files)))
    layouts: dict[tuple, list[str]] = {}
    for f, names in headers.items():
        if names:
            layouts.setdefault(tuple(names), []).append(f)
    unkeyed = [f for names, some in layouts.items() if key not in names for f in some]
    if unkeyed:
        raise ValueError(f"no column {key} in {unkeyed[:5]}")
    if not layouts:
        raise FileNotFoundError(f"no file with column {key} under {path}")
    wanted = _parse_schema(spark, declared)
    missing = [f.name for f in wanted if not any(f.name in names for names in layouts)]
    if missing:
        raise KeyError(f"no file has the columns {missing}")
    kind, out = {f.name: f.dataType for f in wanted}, None
    for names, some in layouts.items():
        schema = StructType([StructField(n, kind.get(n, StringType())) for n in names])
        rows = spark.read.schema(schema).csv(some, header=True, mode="FAILFAST", enforceSchema=False)
        part = rows.select(*[(F.col(f"`{f.name}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
        out = part if out is None else out.unionByName(part)
    return out


def _parse_schema(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def reconcile_slices(slices: list[DataFrame], keys: list[str], values: list[str], label: str, labels: dict[str, str]) -> DataFrame:
    """Overlapping slices: drop exact repeats, map labels, fail if a key has two values."""
    out = None
    for s in slices:
        part = s.select(*keys, *values)
        out = part if out is None else out.unionByName(part)
    mapped = out.withColumn(label, S.map_codes(label, labels))
    mapped = guard(mapped, F.col(label).isNotNull(), f"unknown {label}")
    packed = F.struct(*values)
    per = mapped.groupBy(*keys).agg(F.min(packed).alias("_v"), F.max(packed).alias("_w"))
    return guard(per, F.col("_v").eqNullSafe(F.col("_w")), "a key has two values").select(*keys, "_v.*")


def read_shards(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Index shards with their file name; an unreadable shard is skipped, ``silent_shards`` names it."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    df = (reader.schema(schema) if schema else reader).parquet(path)
    return df.select("*", F.col("_metadata.file_name").alias("shard_source"))


def silent_shards(spark: SparkSession, path: str, shards: DataFrame) -> DataFrame:
    """Files under a folder that gave no rows to ``read_shards``: unreadable or empty ones. Contents are not read again."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    listed = listed.select(F.element_at(F.split("path", "/"), -1).alias("shard_source"))
    return listed.join(shards.select("shard_source").distinct(), "shard_source", "left_anti")


def combine_years(spark: SparkSession, path: str, sort: list[str], partitions: int | None = None) -> DataFrame:
    """Yearly shards as one table in global key order (range shuffle, local sort)."""
    df = spark.read.parquet(path)
    ranged = df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)
    return ranged.sortWithinPartitions(*sort)


def json_records(payloads: DataFrame, column: str, record: str, keep: list[str] = ()) -> DataFrame:
    """Rows of the ``data`` array of each payload; an ``error`` payload has none."""
    doc = F.from_json(column, f"data array<struct<{record}>>, error array<string>")
    return payloads.select(*keep, doc.alias("_d")).select(*keep, F.explode("_d.data").alias("_r")).select(*keep, "_r.*")


def latest_file(df: DataFrame, group: list[str], name: Column | None = None) -> DataFrame:
    """Newest file per group by its name, or by a part of its path."""
    name = F.col("_metadata.file_name") if name is None else name
    return df.select(*group, name.alias("file")).groupBy(*group).agg(F.max("file").alias("latest"))
