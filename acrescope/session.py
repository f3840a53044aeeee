"""Session construction and lineage control."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "acrescope", cpus: int | str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine is written for.

    On a cluster the master and sizes come from spark-submit; only the local
    default is set here. Broadcasts are left to Spark: a side is broadcast when
    its planned or, under AQE, its measured size is under the threshold.
    """
    builder = SparkSession.builder.appName(app)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus))
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the configured checkpoint folder, or the warehouse where none is set.

    A warehouse on a plain local path is taken only with a local master; on a
    cluster every executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.sql.warehouse.dir")
        local = spark.sparkContext.master.split("[")[0] == "local"
        if not local and folder.split(":", 1)[0] in ("file", folder):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {folder} is local to a machine")
    return f"{folder.rstrip('/')}/acrescope-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a reused intermediate as a table in the shared folder and read it back.

    Later steps start from durable files with known sizes, so they survive lost
    executors, prune columns and get size-based join strategies.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads the path from."""
    store, place = _file_system(spark, path)
    return store.exists(place)


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int]:
    """(bytes, time of the last change) of a file or folder, without reading it."""
    store, place = _file_system(spark, path)
    return store.getContentSummary(place).getLength(), store.getFileStatus(place).getModificationTime()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediates that nothing reads any more."""
    store, place = _file_system(spark, path)
    store.delete(place, True)


def drop_intermediates(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; results that still read it must be saved before."""
    store, place = _file_system(spark, shared_folder(spark))
    store.delete(place, True)
