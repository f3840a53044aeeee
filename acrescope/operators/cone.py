"""Percentile cones from analogs, state roll-ups and lookback baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrescope.operators.survey import first_per_key
from acrescope.operators.trend import trend_at

PERCENTS = (10, 50, 90)


def _percentiles(value: str, percents=PERCENTS) -> list[Column]:
    """Exact percentiles; a group is one query's k analogs."""
    return [F.percentile(value, F.lit(p / 100.0)).alias(f"p{p}") for p in percents]


def percentile_cone(analogs: DataFrame, params: DataFrame, query: list[str], entity: str, year: str,
                    residual: str = "detrended_yield_target", params_entity: str = "geoid") -> DataFrame:
    """p10/p50/p90 and median of analog residuals, retrended at the query's entity and year.

    An entity without any trend, its own or its state's, has no cone.
    """
    cone = analogs.groupBy(*query).agg(
        *_percentiles(residual), F.median(residual).alias("point"), F.count(F.lit(1)).alias("n_analogs"))
    lines = params.where(F.col("slope").isNotNull()).select(F.col(params_entity).alias(entity), "slope", "intercept")
    values = [f"p{p}" for p in PERCENTS] + ["point"]
    return cone.join(lines, entity).withColumns({v: F.col(v) + trend_at(year) for v in values}).drop("slope", "intercept")


def raw_cone(analogs: DataFrame, query: list[str], target: str = "yield_target") -> DataFrame:
    """Percentiles of the analogs' own values, NULLs skipped; no trend."""
    return analogs.groupBy(*query).agg(*_percentiles(target), F.count(target).alias("n_analogs"))


def weighted(value: Column, weight: Column) -> Column:
    """Sum(v*w)/sum(w) over rows with both known and a positive weight."""
    ok = value.isNotNull() & weight.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def entity_weights(panel: DataFrame, entity: str, state: str, weight: str = "acres_planted_all",
                   extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (entity, year): the first date's acreage."""
    rows = panel.select(entity, state, "year", "date_rank", weight, *extra)
    return first_per_key(rows, [entity, state, "year"], ["date_rank"]).drop("date_rank")


def weighted_mean(panel: DataFrame, entity: str, state: str, target: str = "yield_target",
                  weight: str = "acres_planted_all") -> DataFrame:
    """State truth: acreage-weighted target, one row per entity and year."""
    rows = entity_weights(panel, entity, state, weight, (target,))
    return rows.groupBy(state, "year").agg(weighted(F.col(target), F.col(weight)).alias("truth"))


def cone_rollup(cones: DataFrame, keys: list[str], weight: str = "acres_planted_all") -> DataFrame:
    """State cone: acreage-weighted mean of entity percentiles and points."""
    kept = cones.where(F.col(weight).isNotNull() & (F.col(weight) > 0))
    values = [f"p{p}" for p in PERCENTS] + ["point"]
    w = F.col(weight)
    return kept.groupBy(*keys).agg(
        *[(F.sum(F.col(v) * w) / F.sum(w)).alias(v) for v in values],
        F.count(F.lit(1)).alias("n_counties"), F.sum(w).alias("total_acres"))


def weighted_rollup_all(panel: DataFrame, keys: list[str], values: list[str], weight: str = "acres_planted_all",
                        fallback: str = "acres_harvested_all") -> DataFrame:
    """Entity to state for every numeric column, each over its own known rows."""
    w = F.coalesce(F.col(weight), F.col(fallback), F.lit(0.0))
    rows = panel.withColumn("_w", w).where(F.col("_w") > 0)
    known = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("_w")))
    return rows.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(c) * F.col("_w")), known(c)).alias(c) for c in values])


def lookback_mean(panel: DataFrame, entity: str, lookbacks=(5,), target: str = "yield_target",
                  skip_years=(), min_years: int = 3) -> DataFrame:
    """Mean of the last <= n known years strictly before each year.

    One window per entity over its years (at most one row per year, so a
    partition is bounded by the calendar) serves all lookbacks.
    """
    usable = F.when(~F.col("year").isin(*skip_years), F.col(target)) if skip_years else F.col(target)
    w = Window.partitionBy(entity).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    prior = panel.withColumn("_prior", F.collect_list(usable).over(w))
    means = {}
    for n in lookbacks:
        tail = F.when(F.size("_prior") > n, F.slice("_prior", -n, n)).otherwise(F.col("_prior"))
        mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)
        means[f"mean_{n}"] = F.when(F.size("_prior") >= min_years, mean)
    return prior.withColumns(means).drop("_prior")


def lookback_state(panel: DataFrame, entity: str, state: str, lookbacks=(5,), weight: str = "acres_planted_all", **kw) -> DataFrame:
    """Acreage-weighted state mean of the entity lookbacks, and how many counted."""
    rows = lookback_mean(panel, entity, lookbacks, **kw)
    w = F.col(weight)
    aggs = []
    for n in lookbacks:
        m = F.col(f"mean_{n}")
        aggs += [weighted(m, w).alias(f"mean_{n}"), F.count_if(m.isNotNull() & (w > 0)).alias(f"n_{n}")]
    return rows.groupBy(state, "year").agg(*aggs)
