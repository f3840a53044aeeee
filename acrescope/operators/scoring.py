"""Backtest assembly, scores, recalibration and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrescope.operators.quantiles import exact_quantiles

COVERAGE_BAND = (0.70, 0.90)  # fixed values: an 80 % cone must cover this share


def rmse(c: str) -> Column:
    return F.sqrt(F.avg(F.col(c) * F.col(c)))


def share(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.avg(F.when(c.isNotNull(), c.cast("double")))


def by_k(analogs: DataFrame, ks) -> DataFrame:
    """Reuse one neighbour list for several k: keep ranks up to each k (narrow)."""
    return analogs.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))


def backtest_rows(grid: DataFrame, cones: DataFrame, state_cones: DataFrame, truth: DataFrame, baseline: DataFrame,
                  cell: list[str]) -> DataFrame:
    """One row per (state, year, date, pool, k) of the sweep, forecast or not.

    ``grid`` carries n_queries, so entities without a cone show as skipped.
    """
    counted = cones.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_cones"))
    out = grid.join(state_cones, cell, "left").join(counted, cell, "left")
    out = out.join(truth, ["state", "year"], "left").join(baseline, ["state", "year"], "left")
    return out.select(
        F.col("year").alias("holdout_year"), "state", "forecast_date", "pool", "k",
        F.coalesce("n_counties", F.lit(0)).alias("n_counties_forecast"),
        (F.col("n_queries") - F.coalesce("n_cones", F.lit(0))).alias("n_counties_skipped"),
        "truth", "point", "p10", "p50", "p90", (F.col("p90") - F.col("p10")).alias("cone_width_80"),
        F.coalesce(F.col("truth").between(F.col("p10"), F.col("p90")), F.lit(False)).alias("in_cone_80"),
        (F.col("point") - F.col("truth")).alias("point_error"), "baseline",
        (F.col("baseline") - F.col("truth")).alias("baseline_error"))


def score_summary(results: DataFrame, by: list[str], error: str = "point_error", inside: str = "in_cone_80",
                  width: str = "cone_width_80") -> DataFrame:
    rows = results.where(F.col(error).isNotNull() & F.col("baseline_error").isNotNull())
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), rmse(error).alias("rmse_point"), rmse("baseline_error").alias("rmse_baseline"),
        (rmse("baseline_error") - rmse(error)).alias("rmse_lift"), share(inside).alias("coverage_80"),
        F.avg(width).alias("mean_width"))


def bias_constants(results: DataFrame, val_year: int, by: list[str]) -> DataFrame:
    """Mean signed error per key on exactly one validation year."""
    rows = results.where((F.col("holdout_year") == val_year) & F.col("point_error").isNotNull())
    return rows.groupBy(*by).agg(F.avg("point_error").alias("bias"), F.count(F.lit(1)).alias("n"))


def recalibrate(results: DataFrame, bias: DataFrame, by: list[str], holdout_year: int) -> DataFrame:
    """Shift point and percentiles of the holdout year by the bias (0 if unknown)."""
    rows = results.where(F.col("holdout_year") == holdout_year).join(bias.select(*by, "bias"), by, "left")
    shift = F.coalesce("bias", F.lit(0.0))
    rows = rows.withColumns({f"{c}_recal": F.col(c) - shift for c in ("point", "p10", "p50", "p90")})
    return rows.withColumns({
        "point_error_recal": F.col("point_recal") - F.col("truth"),
        "in_cone_80_recal": F.col("truth").between(F.col("p10_recal"), F.col("p90_recal")),
        "cone_width_80_recal": F.col("p90_recal") - F.col("p10_recal"),
    }).drop("bias")


def gates(summary: DataFrame, pool: str = "same_geoid") -> DataFrame:
    """Coverage in band everywhere, and at every date some k beats the baseline."""
    rows = summary.where(F.col("pool") == pool)
    per_date = rows.groupBy("forecast_date").agg(
        F.bool_and(F.col("coverage_80").between(*COVERAGE_BAND)).alias("ok"),
        F.bool_or(F.col("rmse_point") < F.col("rmse_baseline")).alias("beats"))
    return per_date.agg(
        F.lit(pool).alias("pool"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("coverage_in_band"),
        F.coalesce(F.bool_and("beats"), F.lit(False)).alias("beats_baseline"))


def lift_gate(summary: DataFrame, threshold: float, date: str = "EOS") -> DataFrame:
    """Relative gain of the regressor over the analog median at one date."""
    rows = summary.where(F.col("forecast_date") == date)
    return rows.select("year", "rmse_regressor", "rmse_analog_median", "lift_vs_analog",
                       F.coalesce(F.col("lift_vs_analog") >= threshold, F.lit(False)).alias("passed"))


def coverage_verdict(coverage: Column) -> Column:
    """In the band, wider or narrower than it, or unknown."""
    low, high = COVERAGE_BAND
    return F.when(coverage.isNull() | F.isnan(coverage), "unknown").when(coverage > high, "too wide").when(coverage < low, "too narrow").otherwise("in band")


def relative_gate(a: Column, b: Column, threshold: float) -> list[Column]:
    """Gain of error b over error a, whether it reaches the threshold, and why it could not be told."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    reason = F.when(~finite(a) | ~finite(b), "an error is not finite").when(a <= 0, "no error to improve on")
    lift = F.when(reason.isNull(), (a - b) / a)
    return [lift.alias("lift"), F.coalesce(lift >= threshold, F.lit(False)).alias("passed"), reason.alias("reason")]


def yearly_lift_gate(summary: DataFrame, year: int, threshold: float, date: str = "EOS") -> DataFrame:
    """Lift at every date of one validation year; the year passes by its lift at ``date`` alone."""
    rows = summary.where(F.col("year") == year)
    deciding = rows.where(F.col("forecast_date") == date).agg(F.max("lift_vs_analog").alias("_lift"))  # one row
    out = rows.crossJoin(F.broadcast(deciding))
    return out.select("year", "forecast_date", "lift_vs_analog", F.coalesce(F.col("_lift") >= threshold, F.lit(False)).alias("passed"))


def score_summary_c(results: DataFrame, by: list[str]) -> DataFrame:
    """RMSE of regressor, analog median and baseline with relative lift and coverage."""
    rows = results.where(F.coalesce("error_regressor", "error_analog").isNotNull()
                         & F.col("error_regressor").isNotNull() & F.col("error_analog").isNotNull()
                         & F.col("baseline_error").isNotNull())
    reg, ana = rmse("error_regressor"), rmse("error_analog")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), reg.alias("rmse_regressor"), F.avg("error_regressor").alias("bias_regressor"),
        ana.alias("rmse_analog_median"), F.avg("error_analog").alias("bias_analog_median"),
        rmse("baseline_error").alias("rmse_baseline"),
        F.when(ana > 0, (ana - reg) / ana).alias("lift_vs_analog"), share("in_cone_80").alias("coverage_80_truth"),
        F.avg("cone_width_80").alias("mean_width"))


def score_slices(results: DataFrame) -> DataFrame:
    """Coverage, errors and widths overall, by year, date, state, state x date.

    ``slice`` names the grouping set, absent keys are NULL. Sums are one aggregate over
    GROUPING SETS, combined before the shuffle, and the median of
    a slice comes from ``exact_quantiles``, so no slice meets in one task.
    """
    sets = {"overall": [], "year": ["year"], "date": ["forecast_date"], "state": ["state"], "state_date": ["state", "forecast_date"]}
    cols = ["year", "forecast_date", "state"]
    code = {n: sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in s) for n, s in sets.items()}  # what grouping_id says of it
    name = F.coalesce(*[F.when(F.col("_g") == g, F.lit(n)) for n, g in code.items()])
    own = lambda c: F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))
    key = lambda n, s: F.concat(F.lit(n), *[F.coalesce(own(F.col(c)), F.lit("-")) for c in s]) if s else F.lit(n)
    out = results.groupingSets([[F.col(c) for c in s] for s in sets.values()], *cols).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), F.avg("in_80_cone").alias("coverage_80"), rmse("error").alias("rmse_p50"),
        F.avg(F.abs("error")).alias("mae_p50"), F.avg("width").alias("width_mean")).withColumn("slice", name)
    out = out.withColumn("_key", F.coalesce(*[F.when(F.col("slice") == n, key(n, s)) for n, s in sets.items()])).drop("_g")
    each = results.select(F.explode(F.array(*[key(n, s) for n, s in sets.items()])).alias("_key"), "width")
    median = exact_quantiles(each, ["_key"], "width", [0.5]).select("_key", F.col("quantile").alias("width_median"))
    return out.join(median, "_key", "left").drop("_key")


def error_decomposition(results: DataFrame, by: str = "state", error: str = "point_error") -> DataFrame:
    e = F.col(error)
    out = results.where(e.isNotNull()).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.stddev_pop(e).alias("std"), rmse(error).alias("rmse"),
        share("in_cone_80").alias("coverage"))
    part = (F.col("bias") * F.col("bias")) / F.greatest(F.col("rmse") * F.col("rmse"), F.lit(1e-9))
    return out.withColumns({
        "bias_share": part, "direction": F.when(F.col("bias") > 0, "over").otherwise("under"),
        "kind": F.when(part > 0.5, "bias").otherwise("variance")})


def ablation_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """n, RMSE and bias of complete predictions per variant and key."""
    rows = predictions.where(F.col("prediction").isNotNull() & F.col("target").isNotNull()) \
        .withColumn("_e", F.col("prediction") - F.col("target"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), rmse("_e").alias("rmse"), F.avg("_e").alias("bias"))


def pivot_count(df: DataFrame, rows: list[str], column: str, values: list, agg: Column | None = None, prefix: str = "") -> DataFrame:
    """Pivot over a stated, closed list of values (no extra pass to find them)."""
    agg = F.count(F.lit(1)) if agg is None else agg
    out = df.groupBy(*rows).pivot(column, values).agg(agg)
    return out.select(*rows, *[F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values])
