"""Two-level models: a ridge on dense vectors, fitted out of fold, feeds a second boosted model; states are routed between both."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrescope.operators import ml, scoring

FOLDS = 5
ALPHA = 10.0
MIN_ROWS = 100
ABSENT = -1.0  # stands in model B for what a row without chips lacks; all real values are larger
FAN_IN = 64  # partial moments added up by one task of the first level
PROBE, PRESENT = "ridge_pred", "has_vector"


# --- moments ---------------------------------------------------------------------
def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (date, fold) of a partition: sums of products of (1, vector, target)."""
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = batch.column("vector")
        width = np.array(pc.list_value_length(vectors))
        if (width != width[0]).any():
            raise ValueError("vectors of one probe differ in length")
        x = np.asarray(pc.list_flatten(vectors), float).reshape(len(width), -1)
        z = np.column_stack([np.ones(len(x)), x, batch.column("target").to_numpy()])
        keys = list(zip(batch.column("date").to_pylist(), batch.column("fold").to_pylist()))
        for key in set(keys):
            part = z[[k == key for k in keys]]
            held[key] = held.get(key, 0) + part.T @ part
    yield _partials(held, TaskContext.get().partitionId())


def _partials(held: dict[tuple, np.ndarray], task: int) -> pa.RecordBatch:
    dates, folds = [k[0] for k in held], [k[1] for k in held]
    return pa.RecordBatch.from_arrays([pa.array(dates, pa.string()), pa.array(folds, pa.int32()), pa.array([task] * len(held), pa.int32()),
                                       pa.array([m.tobytes() for m in held.values()], pa.binary())], names=["date", "fold", "task", "moments"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for date, fold, m in zip(*(batch.column(c).to_pylist() for c in ("date", "fold", "moments"))):
            m = np.frombuffer(m)
            if (date, fold) in held and held[date, fold].shape != m.shape:
                raise ValueError("vectors of one probe differ in length")
            held[date, fold] = held.get((date, fold), 0) + m
    yield _partials(held, 0)


def fold_moments(rows: DataFrame, vec: str, target: str, date: str, fold: Column) -> dict[tuple[str, int], np.ndarray]:
    """(date, fold) -> sums of products; one pass, added up in two levels. The driver gets dates x folds small matrices."""
    schema = "date string, fold int, task int, moments binary"
    given = rows.where(F.col(vec).isNotNull() & F.col(target).isNotNull()).select(
        F.col(date).alias("date"), fold.cast("int").alias("fold"), F.col(vec).cast("array<double>").alias("vector"), F.col(target).cast("double").alias("target"))
    parts = given.mapInArrow(_moments, schema)
    parts = parts.repartition("date", "fold", F.floor(F.col("task") / FAN_IN)).mapInArrow(_add_up, schema)
    parts = parts.repartition("date", "fold").mapInArrow(_add_up, schema)
    out = {}
    for r in parts.collect():
        m = np.frombuffer(r.moments)
        side = int(np.sqrt(len(m)))
        out[r.date, r.fold] = m.reshape(side, side)
    return out


def solve(moments: np.ndarray, alpha: float) -> tuple[float, np.ndarray] | None:
    """(intercept, coefficients) of the ridge with a free intercept; None where the target does not vary."""
    n, sx, sy = moments[0, 0], moments[0, 1:-1], moments[0, -1]
    if n < 2 or moments[-1, -1] - sy * sy / n <= 1e-12 * max(1.0, moments[-1, -1]):
        return None
    xx = moments[1:-1, 1:-1] - np.outer(sx, sx) / n
    coef = np.linalg.solve(xx + alpha * np.eye(len(sx)), moments[1:-1, -1] - sx * sy / n)
    return float((sy - sx @ coef) / n), coef


@dataclass(frozen=True)
class Probe:
    """A ridge per date and fold (fitted without that fold), and one per date on all training rows (fold -1)."""

    table: DataFrame
    n_train: dict[str, int]


def probe_fit(rows: DataFrame, vec: str, target: str, train: Column, *, date: str = "forecast_date", fold: Column, folds: int = FOLDS, alpha: float = ALPHA,
              min_rows: int = MIN_ROWS) -> Probe:
    """All ridges of all dates and folds from one pass: a fold's ridge solves the sums of all other folds.

    A date with fewer than ``min_rows`` training rows, in all or outside a fold, has no ridge there.
    """
    moments = fold_moments(rows.where(train), vec, target, date, fold)
    out, n_train = [], {}
    for d in sorted({d for d, _ in moments}):
        total = sum(m for (at, _), m in moments.items() if at == d)
        n_train[d] = int(total[0, 0])
        for f in range(-1, folds):
            rest = total - moments.get((d, f), 0.0)
            fit = solve(rest, alpha) if rest[0, 0] >= min_rows else None
            if fit is not None:
                out.append((d, f, fit[0], fit[1].tolist()))
    table = rows.sparkSession.createDataFrame(out, "_date string, _fold int, _intercept double, _coef array<double>")
    return Probe(table, n_train)


def probe_apply(rows: DataFrame, probe: Probe, vec: str, train: Column, *, date: str = "forecast_date", fold: Column, out: str = PROBE) -> DataFrame:
    """Adds the ridge's value: training rows get that of the ridge fitted without their fold, others that of all training rows.

    A row without a vector, or without a ridge, gets NULL; no row is lost.
    """
    keyed = rows.withColumn("_at", F.when(F.coalesce(train, F.lit(False)), fold.cast("int")).otherwise(-1))
    joined = keyed.join(probe.table, (F.col(date) == F.col("_date")) & (F.col("_at") == F.col("_fold")), "left")  # dates x folds rows on the right
    dot = F.aggregate(F.zip_with(F.col(vec).cast("array<double>"), "_coef", lambda x, c: x * c), F.lit(0.0), lambda s, x: s + x)
    return joined.withColumn(out, dot + F.col("_intercept")).drop("_at", "_date", "_fold", "_intercept", "_coef")


# --- the second model --------------------------------------------------------------
def second_features(by_date: dict[str, list[str]], qc: list[str]) -> dict[str, list[str]]:
    """Feature contract of model B: that of model A, the chip columns, the probe and whether there is a vector."""
    return {d: [*cols, *qc, PROBE, PRESENT] for d, cols in by_date.items()}


def with_probe(panel: DataFrame, vectors: DataFrame, keys: list[str], qc: list[str], vec: str, target: str, train: Column, fold: Column, *, folds: int = FOLDS,
               alpha: float = ALPHA, min_rows: int = MIN_ROWS) -> tuple[DataFrame, Probe]:
    """The panel with the chip columns, ``has_vector`` and the probe of its vectors, complete for model B.

    ``vectors`` has one row per key at most (checked). ``fold`` (0 to folds - 1) should keep an
    entity together: then a row's probe has seen neither its target nor that of another year of its entity.
    Chips, vector and probe are missing together in some rows; there the columns hold ``ABSENT``.
    """
    from acrescope.operators.joins import left_join_checked

    rows = left_join_checked(panel, vectors.select(*keys, *qc, vec), keys, "vectors")
    probe = probe_fit(rows, vec, target, train, fold=fold, folds=folds, alpha=alpha, min_rows=min_rows)
    rows = probe_apply(rows, probe, vec, train, fold=fold)
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(ABSENT)) for c in [*qc, PROBE]}
    return rows.withColumns({PRESENT: F.col(vec).isNotNull().cast("double"), **filled}).drop(vec), probe


def route_scores(predictions: DataFrame, target: str, by: list[str]) -> DataFrame:
    """n, RMSE and bias of model A, model B and the routed prediction, per key, on rows that have all of them."""
    keep = predictions.where(F.col("pred_a").isNotNull() & F.col("pred_b").isNotNull() & F.col(target).isNotNull())
    long = ml.long_predictions(keep, by, target, {"rowA": "pred_a", "rowB": "pred_b", "hybrid": "pred_hybrid"})
    return scoring.ablation_metrics(long, ["variant", *by])
