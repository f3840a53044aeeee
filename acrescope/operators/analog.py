"""Alternative forecasts from the same analogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counterfactual_points(analogs: DataFrame, params: DataFrame, recent: DataFrame, horizon: int,
                          target: str = "yield_target", residual: str = "detrended_yield_target") -> DataFrame:
    """Four point forecasts per query, in one aggregation over its k analogs.

    ``cf_raw``: median observed value; ``cf_trend``: the usual retrended median
    residual; ``cf_recent``: the same under a trend of recent years only;
    ``cf_clipped``: each analog's trend carried at most ``horizon`` years.
    """
    full = params.select(F.col("geoid").alias("q_geoid"), F.col("slope").alias("s"), F.col("intercept").alias("i"))
    late = recent.select(F.col("geoid").alias("q_geoid"), F.col("slope").alias("rs"), F.col("intercept").alias("ri"))
    rows = analogs.join(full, "q_geoid").join(late, "q_geoid", "left")
    clip_year = F.least(F.col("q_year"), F.col("year") + horizon)
    return rows.groupBy("q_geoid", "q_year", "forecast_date").agg(
        F.median(target).alias("cf_raw"),
        (F.median(residual) + F.first(F.col("s") * F.col("q_year") + F.col("i"))).alias("cf_trend"),
        (F.median(F.col(target) - (F.col("rs") * F.col("year") + F.col("ri")))
         + F.first(F.col("rs") * F.col("q_year") + F.col("ri"))).alias("cf_recent"),
        F.median(F.col(residual) + F.col("s") * clip_year + F.col("i")).alias("cf_clipped"))
