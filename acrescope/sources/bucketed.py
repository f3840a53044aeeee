"""A table in key-hash buckets: an upsert rewrites the buckets it touches, an append reads those that may hold its keys."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from acrescope.operators.survey import first_per_key, last_per_key
from acrescope.session import drop_path, fresh_path
from acrescope.sources import versions

BUCKETS = 64
ATTEMPTS = 20
FILTER_BITS, FILTER_HASHES = 1 << 22, 4  # bits of a bucket's key filter, in pieces of 32,768, and positions of a key in it
_PIECE = 1 << 15
_BUCKET = "_bucket"


@dataclass(frozen=True)
class State:
    """One version of a table: which folders hold each bucket, which hold key filters."""

    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: StructType
    data: dict[int, tuple[str, ...]]
    filters: tuple[str, ...]
    sources: dict[str, int]  # last batch of every stream that appends

    def document(self) -> dict:
        return {"keys": list(self.keys), "buckets": self.buckets, "schema": self.schema.jsonValue(), "data": {str(b): list(f) for b, f in self.data.items()},
                "filters": list(self.filters), "sources": self.sources}

    @classmethod
    def read(cls, version: int, d: dict) -> State:
        return cls(version, tuple(d["keys"]), d["buckets"], StructType.fromJson(d["schema"]), {int(b): tuple(f) for b, f in d["data"].items()},
                   tuple(d["filters"]), d["sources"])


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def current(spark: SparkSession, path: str) -> State | None:
    """The newest version that readers see; a damaged one is an error."""
    found = versions.latest(spark, f"{path}/versions")
    return None if found is None else State.read(*found)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its newest, or a stated, version."""
    state = current(spark, path) if version is None else State.read(version, versions.read_version(spark, f"{path}/versions", version))
    if state is None:
        raise FileNotFoundError(path)
    return _read_buckets(spark, path, state, sorted(state.data))


def _read_buckets(spark: SparkSession, path: str, state: State, buckets: list[int], folders: set[tuple[int, str]] | None = None) -> DataFrame:
    """Only the files of the given buckets (and, if given, folders) are listed and read."""
    places = [f"{path}/data/{f}/{_BUCKET}={b}" for b in buckets for f in state.data.get(b, ()) if folders is None or (b, f) in folders]
    if not places:
        return spark.createDataFrame([], state.schema)
    return spark.read.schema(state.schema).parquet(*places)


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> tuple[str, list[int]]:
    """Rows in a new folder, a part per bucket; (folder, buckets written)."""
    folder = uuid.uuid4().hex
    spread = rows.withColumn(_BUCKET, bucket_of(keys, buckets)).repartition(_BUCKET)
    spread.write.mode("errorifexists").partitionBy(_BUCKET).parquet(f"{path}/data/{folder}")
    written = rows.sparkSession.read.schema(f"{_BUCKET} int").parquet(f"{path}/data/{folder}").select(_BUCKET).distinct().collect()  # one row a bucket at most
    return folder, sorted(r[0] for r in written)


def _checked(state: State | None, new: DataFrame, keys: list[str]) -> None:
    if state is not None and (list(state.keys) != list(keys) or [f.name for f in state.schema] != new.columns):
        raise ValueError(f"the table has keys {list(state.keys)} and columns {[f.name for f in state.schema]}")


def _stage(new: DataFrame, keys: list[str], buckets: int) -> tuple[DataFrame, list[int], str]:
    """A batch, written once so that every attempt merges the same rows, the buckets it touches, and where it lies."""
    path = fresh_path(new.sparkSession, "batch")
    new.withColumn(_BUCKET, bucket_of(keys, buckets)).write.parquet(path)
    staged = new.sparkSession.read.schema(StructType([*new.schema, StructField(_BUCKET, IntegerType())])).parquet(path)
    touched = sorted(r[0] for r in staged.select(_BUCKET).distinct().collect())
    return staged.drop(_BUCKET), touched, path


def _commit(spark: SparkSession, path: str, before: State | None, keys: list[str], buckets: int, schema: StructType, data: dict[int, tuple[str, ...]],
            filters: tuple[str, ...], source: tuple[str, int] | None = None) -> State:
    """The next version, published or VersionTaken."""
    sources = {**(before.sources if before else {}), **({source[0]: source[1]} if source else {})}
    after = State((before.version if before else 0) + 1, tuple(keys), buckets, schema, data, filters, sources)
    versions.publish(spark, f"{path}/versions", after.version, after.document())
    return after


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> State | None:
    """Existing and new rows, last per key, as a new version.

    Only buckets with keys of the batch are read and written; the new version's list
    names the old folders of all others. It is published by creating one file: a
    writer that finds its version taken merges again on top of the other's, so
    no update hides another. A failed job leaves the old version. An empty batch publishes nothing.
    """
    spark = new.sparkSession
    state = current(spark, path)
    _checked(state, new, keys)
    n = state.buckets if state else buckets
    rows, touched, staged = _stage(new, keys, n)
    for _ in range(ATTEMPTS if touched else 0):
        state = current(spark, path)
        merged = rows.withColumn("_new", F.lit(1))
        if state is not None:
            merged = _read_buckets(spark, path, state, touched).withColumn("_new", F.lit(0)).unionByName(merged)
        folder, written = _write(last_per_key(merged, keys, ["_new", *order]).select(*new.columns), path, keys, n)
        data = {**(state.data if state else {}), **{b: (folder,) for b in written}}
        filters = (*(state.filters if state else ()), _filters(spark, path, keys, n, new.schema, folder))
        try:
            state = _commit(spark, path, state, keys, n, new.schema, data, filters)
            break
        except versions.VersionTaken:
            continue
    else:
        if touched:
            raise versions.VersionTaken(f"{path}: {ATTEMPTS} attempts")
    drop_path(spark, staged)
    return state


# --- appends of new keys -----------------------------------------------------------
def _positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row's places in its bucket's filter: number of the piece and bit in it."""
    places = F.array(*[F.pmod(F.xxhash64(*keys, F.lit(k)), F.lit(FILTER_BITS)) for k in range(1, FILTER_HASHES + 1)])
    return rows.withColumn("_place", F.explode(F.array_distinct(places))).withColumns({
        "_piece": F.floor(F.col("_place") / _PIECE).cast("int"), "_bit": F.col("_place") % _PIECE})


def _filters(spark: SparkSession, path: str, keys: list[str], buckets: int, schema: StructType, folder: str) -> str:
    """Key filters of a written folder: a bitmap per bucket and piece with a bit set."""
    name = uuid.uuid4().hex
    rows = spark.read.schema(schema).parquet(f"{path}/data/{folder}").select(*keys)
    placed = _positions(rows.withColumn(_BUCKET, bucket_of(keys, buckets)), keys)
    bits = placed.groupBy(_BUCKET, "_piece").agg(F.bitmap_construct_agg("_bit").alias("bits"))
    bits.select(_BUCKET, "_piece", F.lit(folder).alias("folder"), "bits").write.parquet(f"{path}/filters/{name}")
    return name


def may_hold(spark: SparkSession, path: str, state: State, rows: DataFrame) -> set[tuple[int, str]]:
    """(bucket, folder) pairs whose filter has all bits of some row's key: no other can hold a key of ``rows``.

    The driver gets one pair per bucket and folder at most, as many as the version's list has.
    """
    if not state.filters:
        return set()
    keys = list(state.keys)
    table = spark.read.schema(f"{_BUCKET} int, _piece int, folder string, bits binary").parquet(*[f"{path}/filters/{f}" for f in state.filters])
    keyed = rows.select(*keys).withColumn(_BUCKET, bucket_of(keys, state.buckets)).withColumn("_key", F.xxhash64(*keys, F.lit(0)))
    placed = _positions(keyed, keys).select(_BUCKET, "_key", "_piece", "_bit").distinct()
    asked = placed.groupBy(_BUCKET, "_key").agg(F.count("*").alias("_n"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.bit_get(byte, (F.col("_bit") % 8).cast("int")) == 1
    found = placed.join(table, [_BUCKET, "_piece"]).where(hit).groupBy(_BUCKET, "_key", "folder").agg(F.count("*").alias("_n"))
    pairs = found.join(asked, [_BUCKET, "_key", "_n"], "left_semi").select(_BUCKET, "folder").distinct().collect()
    return {(b, f) for b, f in pairs if f in state.data.get(b, ())}


def append_new(new: DataFrame, path: str, keys: list[str], source: str, batch: int, buckets: int = BUCKETS) -> State:
    """Append the rows of a batch whose key the table does not hold; of rows with one key, the smallest by the other columns.

    Batches of a source are numbered upwards: one that was published is not looked at again. Under another name the same rows
    add nothing either, by an anti-join with the keys of those bucket folders whose filter may hold one of them; no
    other file is read. Data, filter and batch number become visible with one published version.
    """
    spark = new.sparkSession
    state = current(spark, path)
    _checked(state, new, keys)
    if state is not None and state.sources.get(source, -1) >= batch:
        return state
    n = state.buckets if state else buckets
    rows, touched, staged = _stage(first_per_key(new, keys, [c for c in new.columns if c not in keys]).select(*new.columns), keys, n)
    for _ in range(ATTEMPTS):
        state = current(spark, path)
        if state is not None and state.sources.get(source, -1) >= batch:
            break
        near = may_hold(spark, path, state, rows) if state is not None and touched else set()
        fresh = rows
        if near:
            fresh = rows.join(_read_buckets(spark, path, state, sorted({b for b, _ in near}), near).select(*keys), keys, "left_anti")
        folder, written = _write(fresh, path, keys, n) if touched else ("", [])
        old = state.data if state else {}
        filters = state.filters if state else ()
        if written:
            filters = (*filters, _filters(spark, path, keys, n, new.schema, folder))
        try:
            state = _commit(spark, path, state, keys, n, new.schema, {**old, **{b: (*old.get(b, ()), folder) for b in written}}, filters, (source, batch))
            break
        except versions.VersionTaken:
            continue
    else:
        raise versions.VersionTaken(f"{path}: {ATTEMPTS} attempts")
    drop_path(spark, staged)
    return state


def compact(spark: SparkSession, path: str, at_most: int = 8) -> State:
    """Rewrite buckets of more than ``at_most`` folders as one, with one filter; when another writer is first, nothing changes."""
    state = current(spark, path)
    if state is None:
        raise FileNotFoundError(path)
    many = [b for b, folders in state.data.items() if len(folders) > at_most]
    if not many:
        return state
    keys = list(state.keys)
    folder, _ = _write(_read_buckets(spark, path, state, many), path, keys, state.buckets)
    data = {**state.data, **{b: (folder,) for b in many}}
    live = {f for folders in data.values() for f in folders}
    kept = spark.read.schema(f"{_BUCKET} int, _piece int, folder string, bits binary").parquet(*[f"{path}/filters/{f}" for f in state.filters])
    name = uuid.uuid4().hex
    kept.join(spark.createDataFrame([(f,) for f in sorted(live)], "folder string"), "folder", "left_semi").select(_BUCKET, "_piece", "folder", "bits").write.parquet(
        f"{path}/filters/{name}")
    try:
        return _commit(spark, path, state, keys, state.buckets, state.schema, data, (name, _filters(spark, path, keys, state.buckets, state.schema, folder)))
    except versions.VersionTaken:
        return current(spark, path)
