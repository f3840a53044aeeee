"""Versions of a stored thing: small documents, each published by creating one file that must not exist yet."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from acrescope.session import _file_system

NAME = "v{:012d}.json"


class VersionTaken(Exception):
    """Another writer published this version first."""


def publish(spark: SparkSession, root: str, version: int, document: dict) -> None:
    """Make ``document`` the version ``version`` of ``root``, or raise VersionTaken; nothing is ever overwritten."""
    store, place = _file_system(spark, f"{root}/{NAME.format(version)}")
    try:
        out = store.create(place, False)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            raise VersionTaken(f"{root} {version}") from None
        raise
    try:
        out.write(json.dumps(document).encode())
    finally:
        out.close()


def versions(spark: SparkSession, root: str) -> list[int]:
    """All published versions, oldest first; none where nothing lies."""
    store, place = _file_system(spark, root)
    if not store.exists(place):
        return []
    names = [s.getPath().getName() for s in store.listStatus(place)]
    return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit())


def read_version(spark: SparkSession, root: str, version: int, wait: float = 10.0) -> dict:
    """The document of a version. One that is being written is waited for; one that stays damaged is an error."""
    store, place = _file_system(spark, f"{root}/{NAME.format(version)}")
    end = time.monotonic() + wait
    while True:
        stream = store.open(place)
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            if time.monotonic() > end:
                raise ValueError(f"{root} version {version} is damaged") from None
            time.sleep(0.1)


def latest(spark: SparkSession, root: str, wait: float = 10.0) -> tuple[int, dict] | None:
    """(version, document) of the newest version, None where there is none."""
    found = versions(spark, root)
    return (found[-1], read_version(spark, root, found[-1], wait)) if found else None
