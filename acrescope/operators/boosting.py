"""Boosted regressors in full: training tables written once, validation curves, a sweep by halving, trees as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrescope.operators.ml import in_threads
from acrescope.session import fresh_path

ROWS_PER_PART = 250_000  # training rows of one task
MAX_ROUNDS, PATIENCE = 2000, 50  # fixed values of the published fits
RUNGS, KEEP = (4, 12), 4  # rounds after which one in KEEP configurations goes on
FIRST_LONG = 64  # rounds of the first fit that runs to its early stop


# --- training rows -------------------------------------------------------------
@dataclass
class Training:
    """Training and validation rows of all dates, assembled and written once.

    Rows with a NULL feature are not in it; a NULL label is an error.
    """

    folder: str
    counts: dict[tuple[str, bool], int] = field(default_factory=dict)

    @classmethod
    def write(cls, train: DataFrame, val: DataFrame, by_date: dict[str, list[str]], target: str) -> Training:
        fail = F.raise_error(F.lit(f"NULL {target} in training rows")).cast("double")
        columns = list(dict.fromkeys(c for cols in by_date.values() for c in cols))
        tag = lambda df, flag: df.select("forecast_date", *columns, F.coalesce(F.col(target), fail).alias("label"), F.lit(flag).alias("is_val"))
        values = None
        for d, cols in by_date.items():
            arr = F.array(*[F.col(c).cast("double") for c in cols])
            values = F.when(F.col("forecast_date") == d, arr) if values is None else values.when(F.col("forecast_date") == d, arr)
        rows = tag(train, False).unionByName(tag(val, True)).withColumn("_v", values)
        rows = rows.where(F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull()))
        folder = fresh_path(train.sparkSession, "training")
        rows.select("forecast_date", "is_val", "label", array_to_vector("_v").alias("features")).write.partitionBy("forecast_date", "is_val").parquet(folder)
        written = train.sparkSession.read.schema("label double, forecast_date string, is_val boolean").parquet(folder)
        counts = {(r.forecast_date, r.is_val): r["count"] for r in written.groupBy("forecast_date", "is_val").count().collect()}  # two rows a date
        return cls(folder, counts)

    def rows(self, spark: SparkSession, date: str, is_val: bool) -> DataFrame:
        """Rows of one date, in as many partitions as their number asks for."""
        n = self.counts.get((date, is_val), 0)
        if not n:
            raise ValueError(f"no {'validation' if is_val else 'training'} rows at {date}")
        table = spark.read.parquet(f"{self.folder}/forecast_date={date}/is_val={str(is_val).lower()}")
        return table.coalesce(max(1, -(-n // ROWS_PER_PART)))


# --- curves ----------------------------------------------------------------------
def fit_rounds(rows: DataFrame, rounds: int, max_depth: int = 3, step: float = 0.1, min_rows: int = 1, subsample: float = 1.0, seed: int = 42) -> GBTRegressionModel:
    """Exactly ``rounds`` trees. A shorter fit on the same rows gives the first trees of a longer one."""
    return GBTRegressor(maxIter=rounds, maxDepth=max_depth, stepSize=step, minInstancesPerNode=min_rows, subsamplingRate=subsample, seed=seed).fit(rows)


def curve(model: GBTRegressionModel, val: DataFrame) -> list[float]:
    """RMSE on the validation rows after each round."""
    return [float(np.sqrt(e)) for e in model.evaluateEachIteration(val, "squared")]


def early_stop(errors: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """(best round, counted from 1; whether ``patience`` rounds followed without a gain). Later rounds do not count."""
    best = 0
    for k, e in enumerate(errors):
        if e < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The model after its first ``n`` rounds: what a fit of ``n`` rounds gives, without another fit."""
    java, ml = model._java_obj, SparkContext._active_spark_context._jvm.org.apache.spark.ml
    short = ml.regression.GBTRegressionModel(model.uid, java.trees()[:n], java.treeWeights()[:n], model.numFeatures)
    return model._copyValues(GBTRegressionModel(short))


def _stopped_fit(rows: DataFrame, val: DataFrame, config: dict, first: int, patience: int, max_rounds: int) -> tuple[GBTRegressionModel, list[float], int, bool]:
    """``fit_to_stop`` with the model of all rounds fitted."""
    rounds = min(max(first, patience + 1), max_rounds)
    while True:
        model = fit_rounds(rows, rounds, **config)
        errors = curve(model, val)
        best, stopped = early_stop(errors, patience)
        if stopped or rounds >= max_rounds:
            return model, errors, best, stopped
        rounds = min(max(2 * best, best + patience, rounds + rounds // 4), max_rounds)


def fit_to_stop(rows: DataFrame, val: DataFrame, config: dict, first: int = FIRST_LONG, patience: int = PATIENCE, max_rounds: int = MAX_ROUNDS) -> tuple[list[float], int, bool]:
    """(curve, best round, stopped) of a fit that goes on until ``patience`` rounds bring nothing, or ``max_rounds``.

    A fit cannot be continued, so the next one repeats the trees of the one before. It has as many rounds as prove the best
    one so far, and at least twice that one's, so that curves which go on falling take few fits; never more than twice the rounds before.
    """
    return _stopped_fit(rows, val, config, first, patience, max_rounds)[1:]


# --- the sweep -------------------------------------------------------------------
@dataclass(frozen=True)
class Pick:
    """The configuration of one date: its place in the grid, its rounds, and its error there."""

    seq: int
    config: dict
    rounds: int
    rmse: float
    stopped: bool


def sweep(spark: SparkSession, training: Training, dates: list[str], grid: list[dict], rungs: tuple[int, ...] = RUNGS, keep: int = KEEP, first: int = FIRST_LONG,
          patience: int = PATIENCE, max_rounds: int = MAX_ROUNDS, parallelism: int = 16) -> tuple[DataFrame, dict[str, Pick]]:
    """Successive halving over the grid at every date; the rest runs to its early stop and the first best is picked.

    On each rung all remaining configurations have the same rounds, are judged by the
    best round of their curve, and the best one in ``keep`` (rounded up) goes on. The
    table has one row per date and configuration: rounds fitted, best round and its
    RMSE, the rung it left at (0: not given up), whether it stopped early, whether
    it is picked. Ties go to the earlier configuration.
    """
    rows = {(d, v): training.rows(spark, d, v).persist() for d in dates for v in (False, True)}
    alive = {d: list(range(len(grid))) for d in dates}
    state: dict[tuple[str, int], tuple] = {}
    for rung, rounds in enumerate(rungs, 1):
        jobs = [(d, s) for d in dates for s in alive[d]]
        curves = in_threads(spark, [lambda d=d, s=s: curve(fit_rounds(rows[d, False], rounds, **grid[s]), rows[d, True]) for d, s in jobs], parallelism)
        for (d, s), errors in zip(jobs, curves):
            best, _ = early_stop(errors, max_rounds)
            state[d, s] = (rounds, best, errors[best - 1], rung, False)
        for d in dates:
            alive[d] = sorted(sorted(alive[d], key=lambda s: (state[d, s][2], s))[:-(-len(alive[d]) // keep)])
    jobs = [(d, s) for d in dates for s in alive[d]]
    fits = in_threads(spark, [lambda d=d, s=s: fit_to_stop(rows[d, False], rows[d, True], grid[s], first, patience, max_rounds) for d, s in jobs], parallelism)
    for (d, s), (errors, best, stopped) in zip(jobs, fits):
        state[d, s] = (len(errors), best, errors[best - 1], 0, stopped)
    for part in rows.values():
        part.unpersist()
    picks = {}
    for d in dates:
        s = min(alive[d], key=lambda s: (state[d, s][2], s))
        picks[d] = Pick(s, grid[s], state[d, s][1], state[d, s][2], state[d, s][4])
    table = [(d, s, *state[d, s], s == picks[d].seq) for d in dates for s in range(len(grid))]
    return spark.createDataFrame(table, "forecast_date string, seq int, rounds int, best_round int, rmse double, left_at int, stopped boolean, picked boolean"), picks


def fit_picks(spark: SparkSession, training: Training, picks: dict[str, Pick]) -> dict[str, GBTRegressionModel]:
    """Each date's model: its picked configuration at its best round."""
    fits = in_threads(spark, [lambda d=d, p=p: fit_rounds(training.rows(spark, d, False), p.rounds, **p.config) for d, p in picks.items()])
    return dict(zip(picks, fits))


def fit_dates(spark: SparkSession, training: Training, configs: dict[str, dict], first: int = FIRST_LONG, patience: int = PATIENCE,
              max_rounds: int = MAX_ROUNDS) -> tuple[dict[str, GBTRegressionModel], dict[str, Pick]]:
    """One stated configuration per date, each run to its early stop; its trees up to the best round are the model."""
    rows = {(d, v): training.rows(spark, d, v).persist() for d in configs for v in (False, True)}
    ends = in_threads(spark, [lambda d=d, c=c: _stopped_fit(rows[d, False], rows[d, True], c, first, patience, max_rounds) for d, c in configs.items()])
    for part in rows.values():
        part.unpersist()
    models = {d: first_trees(model, best) for d, (model, _, best, _) in zip(configs, ends)}
    return models, {d: Pick(0, c, best, errors[best - 1], stopped) for (d, c), (_, errors, best, stopped) in zip(configs.items(), ends)}
