"""Regressors, attribution, projections and model routing on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrescope import constants as K


# --- boosted trees, one model per forecast date ------------------------------

def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector; rows with a NULL feature get a NULL vector instead of vanishing."""
    whole = F.lit(True)
    for c in features:
        whole = whole & F.col(c).isNotNull()
    vec = array_to_vector(F.array(*[F.col(c).cast("double") for c in features]))
    return df.withColumn("features", F.when(whole, vec))


def in_threads(spark: SparkSession, jobs: list[Callable], parallelism: int = 4) -> list:
    """Submit independent fits side by side, as Spark's own tuning classes do."""
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)


def gbt_predict(rows: DataFrame, models: dict[str, GBTRegressionModel], by_date: dict[str, list[str]]) -> DataFrame:
    """Route each row to its date's model. All rows come back: an incomplete one
    has a NULL prediction, and a date without a model is an error."""
    missing = [d for d in by_date if d not in models]
    if missing:
        raise KeyError(f"no model for {missing}")
    known = F.when(~F.col("forecast_date").isin(*by_date), F.raise_error(F.lit("unknown forecast date")).cast("boolean")).otherwise(True)
    rows, out = rows.where(known), None
    for d, cols in by_date.items():
        part = _assembled(rows.where(F.col("forecast_date") == d), cols)
        scored = models[d].transform(part.where(F.col("features").isNotNull())).drop("features")
        scored = scored.unionByName(part.where(F.col("features").isNull()).drop("features").withColumn("prediction", F.lit(None).cast("double")))
        out = scored if out is None else out.unionByName(scored)
    return out


# --- attribution -------------------------------------------------------------
def tree_paths(nodes: list) -> tuple[list, float]:
    """Leaves of all trees as (weight*value, [(feature, low, high, ratio)]) and the base value.

    ``nodes`` are rows of ``bundles.tree_nodes`` of one model. A path keeps one
    interval and one cover ratio per feature. The model's size is set by its
    parameters (trees x 2^depth), not by the data.
    """
    trees: dict[int, dict] = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n
    leaves, base = [], 0.0
    for tree in sorted(trees):
        of = trees[tree]
        open_ = [(of[0], {}, 1.0)]
        while open_:
            n, bounds, cover = open_.pop()
            if n.left < 0:
                leaves.append((n.weight * n.prediction, [(f, lo, hi, z) for f, (lo, hi, z) in sorted(bounds.items())]))
                base += n.weight * n.prediction * cover
                continue
            for child, left in ((of[n.right], False), (of[n.left], True)):
                ratio = child.rows / n.rows
                lo, hi, z = bounds.get(n.feature, (-np.inf, np.inf, 1.0))
                interval = (lo, min(hi, n.threshold), z * ratio) if left else (max(lo, n.threshold), hi, z * ratio)
                open_.append((child, {**bounds, n.feature: interval}, cover * ratio))
    return leaves, base


def attribute(x: np.ndarray, leaves: list, cells: int = 1 << 20) -> np.ndarray:
    """Exact path-dependent Shapley values of a tree sum, vectorised over rows and over leaves of equal length.

    On one path, a known feature contributes whether the row is inside its
    interval, an unknown one its cover ratio. The subsets of the path's other
    features are summed by size through the coefficients of a product of linear
    factors: the product of all is made once, and each feature's own factor divided out of
    it, so the work is the square of the path's length, not exponential in it.
    """
    phi, by_length = np.zeros(x.shape), {}
    for value, path in leaves:
        by_length.setdefault(len(path), []).append((value, path))
    for d, same in by_length.items():
        weights = [factorial(size) * factorial(d - size - 1) / factorial(d) for size in range(d)]
        step = max(1, cells // max(1, len(x)))
        for at in range(0, len(same) if d else 0, step):
            part = same[at:at + step]
            value = np.array([v for v, _ in part])
            feature, low, high, ratio = (np.array([[f[c] for f in p] for _, p in part]) for c in range(4))
            inside = [(x[:, feature[:, j]] > low[:, j]) & (x[:, feature[:, j]] <= high[:, j]) for j in range(d)]
            whole = [np.ones((len(x), len(part)))]
            for j in range(d):
                grown = [c * ratio[:, j] for c in whole] + [np.zeros_like(whole[0])]
                for size, c in enumerate(whole):
                    grown[size + 1] += np.where(inside[j], c, 0.0)
                whole = grown
            for i in range(d):
                total, rest = np.zeros_like(whole[0]), np.zeros_like(whole[0])
                for size in range(d - 1, -1, -1):  # coefficients without feature i, the largest subsets first
                    rest = np.where(inside[i], whole[size + 1] - ratio[:, i] * rest, whole[size] / ratio[:, i])
                    total += weights[size] * rest
                gain = value * (inside[i] - ratio[:, i]) * total
                for f in np.unique(feature[:, i]):
                    phi[:, f] += gain[:, feature[:, i] == f].sum(axis=1)
    return phi


def tree_attribution(rows: DataFrame, model: GBTRegressionModel, nodes: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Long table of additive contributions: keys, feature, value, attribution, the model's own prediction, base.

    Base value plus a row's contributions should equal the prediction, which
    comes from the model and not from the ``nodes`` (``bundles.tree_nodes``).
    """
    leaves, base = tree_paths(nodes.collect())  # bounded by model size
    shared = rows.sparkSession.sparkContext.broadcast(leaves)
    key_fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    whole = rows.where(F.array_size(F.array_compact(F.array(*[F.col(c).cast("double") for c in features]))) == len(features))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = pdf[features].to_numpy(dtype=float)
            phi = attribute(x, shared.value)
            m = len(features)
            out = pdf[keys].loc[pdf.index.repeat(m)].reset_index(drop=True)
            out["feature"] = np.tile(features, len(pdf))
            out["feature_value"], out["attribution"] = x.ravel(), phi.ravel()
            out["prediction"] = np.repeat(pdf["prediction"].to_numpy(), m)
            out["base_value"] = base
            yield out

    schema = f"{key_fields}, feature string, feature_value double, attribution double, prediction double, base_value double"
    scored = model.transform(_assembled(whole, features))
    return scored.select(*keys, *[F.col(c).cast("double").alias(c) for c in features], "prediction").mapInPandas(explain, schema)


def importance(attributions: DataFrame, by: list[str] = (), method: str = "mean_abs") -> DataFrame:
    """Mean absolute (or signed) attribution per feature."""
    value = {"mean_abs": F.avg(F.abs("attribution")), "mean_signed": F.avg("attribution")}[method]
    return attributions.groupBy(*by, "feature").agg(value.alias("importance"))


def topk_drivers(attributions: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The k largest contributions per row, exact zeros dropped, with direction.

    A row has one entry per contract feature, so its array stays small.
    """
    entry = F.struct((-F.abs("attribution")).alias("neg"), "feature", "attribution", "feature_value")
    per = attributions.where(F.col("attribution") != 0).groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("_t"))
    out = per.select(*keys, F.posexplode("_t").alias("pos", "_d")).select(*keys, (F.col("pos") + 1).alias("rank"), "_d.feature", "_d.attribution", "_d.feature_value")
    return out.withColumn("direction", F.when(F.col("attribution") > 0, "+").otherwise("-"))


def driver_rollup(attributions: DataFrame, by: list[str], weight: str) -> DataFrame:
    """Acreage-weighted drivers per state; one-hots merge into one ``state`` driver."""
    w = F.col(weight)
    rows = attributions.where(w.isNotNull() & (w > 0))
    per = rows.groupBy(*by, "feature").agg(
        (F.sum(F.col("attribution") * w) / F.sum(w)).alias("attribution"), (F.sum(F.col("feature_value") * w) / F.sum(w)).alias("feature_value"))
    onehot = F.col("feature").startswith("state_is_")
    merged = per.withColumn("feature_value", F.when(onehot, 1.0).otherwise(F.col("feature_value"))).withColumn(
        "feature", F.when(onehot, "state").otherwise(F.col("feature")))
    out = merged.groupBy(*by, "feature").agg(F.sum("attribution").alias("attribution"), F.first("feature_value").alias("feature_value"))
    kind = F.when(F.col("feature").isin(*K.STRUCTURAL_FEATURES), "structural").otherwise("biophysical")
    direction = F.when(F.col("attribution") > 0, "+").when(F.col("attribution") < 0, "-").otherwise("0")
    return out.withColumns({"kind": kind, "direction": direction})


# --- dense vectors -----------------------------------------------------------
def pca_reduce(vectors: DataFrame, vec: str, train, k: int, out: str = "reduced") -> tuple[DataFrame, list[float]]:
    """Fit on training rows with a vector, project all rows, NULL stays NULL.

    Spark's projection does not subtract the mean, so rows are centred first.
    """
    rows = vectors.withColumn("_v", F.when(F.col(vec).isNotNull(), array_to_vector(F.col(vec).cast("array<double>"))))
    fit_rows = rows.where(F.col("_v").isNotNull() & train)
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(fit_rows)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centre.transform(fit_rows))
    have = model.transform(centre.transform(rows.where(F.col("_v").isNotNull()))).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")
    none = rows.where(F.col("_v").isNull()).drop("_v").withColumn(out, F.lit(None).cast("array<double>"))
    return have.unionByName(none), [float(x) for x in model.explainedVariance]


def ridge_probe(vectors: DataFrame, vec: str, target: str, train, group: str, groups: list, alpha: float = 10.0, min_rows: int = 100) -> DataFrame:
    """Ridge on dense vectors to one scalar per group (forecast date).

    The penalty is scaled so that Spark's objective equals plain ridge with
    ``alpha``. Groups with too few training rows, and NULL vectors, give NULL.
    """
    out = None
    for g in groups:
        rows = vectors.where(F.col(group) == g).withColumn("_v", F.when(F.col(vec).isNotNull(), array_to_vector(F.col(vec).cast("array<double>"))))
        fit_rows = rows.where(F.col("_v").isNotNull() & F.col(target).isNotNull() & train).withColumn("_y", F.col(target).cast("double"))
        n, sd = fit_rows.agg(F.count(F.lit(1)), F.stddev_pop("_y")).first()
        blank = rows.drop("_v").withColumn("ridge_pred", F.lit(None).cast("double"))
        if n < min_rows or not sd:
            part = blank
        else:
            model = LinearRegression(featuresCol="_v", labelCol="_y", predictionCol="ridge_pred", elasticNetParam=0.0, standardization=False,
                                     solver="normal", regParam=alpha * sd / n).fit(fit_rows)
            part = model.transform(rows.where(F.col("_v").isNotNull())).drop("_v").unionByName(blank.where(F.col(vec).isNull()))
        out = part if out is None else out.unionByName(part)
    return out


def batch_embed(inputs: DataFrame, predict_fn: Callable[[pd.DataFrame], np.ndarray], keys: list[str], batch_rows: int = 256) -> DataFrame:
    """Run a user model over assembled sequences; mean-pool its tokens to one vector.

    ``predict_fn`` maps a batch to an array (rows, tokens, dims); a row it
    returns as NaN stays without a vector.
    """
    key_fields = ", ".join(f"`{k}` {t}" for k, t in inputs.select(*keys).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows):
                part = pdf.iloc[at:at + batch_rows]
                pooled = np.asarray(predict_fn(part), dtype=float).mean(axis=1)
                out = part[keys].reset_index(drop=True)
                out["embedding"] = [None if np.isnan(v).any() else v.tolist() for v in pooled]
                yield out

    return inputs.mapInPandas(run, f"{key_fields}, embedding array<double>")


def embedding_join(panel: DataFrame, embeddings: DataFrame, keys: list[str], version: str, columns: list[str]) -> DataFrame:
    """Version-filtered, uniqueness-checked left join of vectors and their QC columns."""
    from acrescope.operators.joins import left_join_checked

    right = embeddings.where(F.col("model_version") == version).select(*keys, *columns)
    return left_join_checked(panel, right, keys, "embeddings")


def hybrid_route(predictions: DataFrame, routed: list[str], state: str = "state", a: str = "pred_a", b: str = "pred_b") -> DataFrame:
    """Model B for the listed states, model A elsewhere."""
    return predictions.withColumn("pred_hybrid", F.when(F.col(state).isin(*routed), F.col(b)).otherwise(F.col(a)))


def long_predictions(predictions: DataFrame, keys: list[str], target: str, variants: dict[str, str]) -> DataFrame:
    """(keys, variant, prediction, target): a narrow explode of the variants."""
    entries = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("prediction")) for n, c in variants.items()])
    return predictions.select(*keys, F.col(target).alias("target"), F.explode(entries).alias("_v")).select(*keys, "target", "_v.*")
