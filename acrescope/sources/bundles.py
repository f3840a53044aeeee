"""Saved bundles of fitted parameters: a model per date with its contract, trends and standardizer, published as one version."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrescope.sources import versions

TRENDS, STANDARDIZER = "trends", "standardizer"


@dataclass(frozen=True)
class Bundle:
    """A loaded bundle: what it takes to predict, and where it came from."""

    version: int
    models: dict[str, GBTRegressionModel]
    by_date: dict[str, list[str]]
    tables: dict[str, DataFrame]
    notes: dict
    folder: str


def save_bundle(spark: SparkSession, root: str, models: dict[str, GBTRegressionModel], by_date: dict[str, list[str]], tables: dict[str, DataFrame],
                notes: dict | None = None) -> int:
    """Write a bundle and publish it as the next version of ``root``; returns its number.

    Models go through Spark ML's own persistence, tables to Parquet, all in a folder of the
    version; the manifest (dates, feature contract, tree counts, rows of every table, notes such as the picked configuration)
    is the file that publishes it, so a reader sees a whole bundle or none. Every date of the contract needs a model.
    """
    missing = sorted(set(by_date) ^ set(models))
    if missing:
        raise ValueError(f"contract and models differ at dates {missing}")
    wrong = [d for d in models if models[d].numFeatures != len(by_date[d])]
    if wrong:
        raise ValueError(f"models at {wrong} have other numbers of features than the contract")
    name = uuid.uuid4().hex
    for d, model in models.items():
        model.write().save(f"{root}/data/{name}/models/{d}")
    rows = {}
    for t, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/data/{name}/tables/{t}")
        rows[t] = spark.read.schema(df.schema).parquet(f"{root}/data/{name}/tables/{t}").count()
    document = {"folder": name, "by_date": by_date, "trees": {d: m.getNumTrees for d, m in models.items()}, "rows": rows,
                "schemas": {t: df.schema.jsonValue() for t, df in tables.items()}, "notes": notes or {}}
    while True:
        found = versions.versions(spark, f"{root}/versions")
        version = found[-1] + 1 if found else 1
        try:
            versions.publish(spark, f"{root}/versions", version, document)
            return version
        except versions.VersionTaken:
            continue


def load_bundle(spark: SparkSession, root: str, by_date: dict[str, list[str]], version: int | None = None) -> Bundle:
    """The newest, or a stated, version, checked against the contract the caller works with.

    A date without a model, other features or another order of them, a model with other trees than
    were saved, or a table that has lost rows is an error that names it.
    """
    from pyspark.sql.types import StructType

    if version is None:
        found = versions.latest(spark, f"{root}/versions")
        if found is None:
            raise FileNotFoundError(f"no bundle in {root}")
        version, document = found
    else:
        document = versions.read_version(spark, f"{root}/versions", version)
    missing = [d for d in by_date if d not in document["by_date"]]
    if missing:
        raise KeyError(f"bundle {version} of {root} has no model for {missing}; it has {sorted(document['by_date'])}")
    other = [d for d, cols in by_date.items() if document["by_date"][d] != list(cols)]
    if other:
        raise ValueError(f"bundle {version} of {root} has other features at {other}")
    folder = f"{root}/data/{document['folder']}"
    models = {}
    for d in by_date:
        try:
            models[d] = GBTRegressionModel.load(f"{folder}/models/{d}")
        except Exception as e:
            raise ValueError(f"model {d} of bundle {version} cannot be read") from e
        if models[d].getNumTrees != document["trees"][d]:
            raise ValueError(f"model {d} of bundle {version} has {models[d].getNumTrees} trees, {document['trees'][d]} were saved")
    tables = {}
    for t, schema in document["schemas"].items():
        tables[t] = spark.read.schema(StructType.fromJson(schema)).parquet(f"{folder}/tables/{t}")
        n = tables[t].count()
        if n != document["rows"][t]:
            raise ValueError(f"table {t} of bundle {version} has {n} rows, {document['rows'][t]} were saved")
    return Bundle(version, models, {d: list(c) for d, c in by_date.items()}, tables, document["notes"], folder)


def tree_nodes(spark: SparkSession, folder: str, dates: list[str]) -> DataFrame:
    """Nodes of all saved trees: forecast_date, tree, weight, node, prediction, rows, left, right, feature, threshold.

    A leaf has no children (-1). This is the table that Spark ML's persistence writes; a model's size follows its parameters, not the data.
    """
    out = None
    for d in dates:
        data = spark.read.parquet(f"{folder}/models/{d}/data")
        weights = spark.read.parquet(f"{folder}/models/{d}/treesMetadata").toDF("treeID", "about", "weight")
        n = F.col("nodeData")
        part = data.join(weights, "treeID").select(
            F.lit(d).alias("forecast_date"), F.col("treeID").alias("tree"), "weight", n["id"].alias("node"), n["prediction"].alias("prediction"),
            n["rawCount"].cast("double").alias("rows"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["split"]["featureIndex"].alias("feature"),
            F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"))
        out = part if out is None else out.unionByName(part)
    return out
