"""Season features from entity-day weather, for all forecast dates in one pass.

Cutoffs are nested: what 08-01 may see, 09-01 may see too. So a day is tagged
once with the interval of the first cutoff that may see it, aggregated per
interval (with map-side combine) and the at most four intervals per entity-year
are added up. Daily rows are never multiplied by the cutoffs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S

_LAST = len(K.FORECAST_DATES) - 1


def in_season(daily: DataFrame, date: str = "date") -> DataFrame:
    """Days from 1 May to the day before the last cutoff, tagged with their interval."""
    tagged = daily.withColumn("interval", S.season_interval(date))
    return tagged.where(F.col("interval").isNotNull())


def spread_to_dates(intervals: DataFrame) -> DataFrame:
    """Copy each interval's partial result to every date that may see it (<= 4 copies)."""
    labels = F.array(*[F.lit(d) for d in K.FORECAST_DATES])
    ranks = F.sequence(F.col("interval"), F.lit(_LAST))
    return intervals.withColumn("date_rank", F.explode(ranks)).withColumn(
        "forecast_date", F.element_at(labels, F.col("date_rank") + 1)
    ).drop("interval")


def cutoff_range_join(daily: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """Daily rows paired with every date that may see them (1 May <= day < cutoff).

    The pairing needs no join: a narrow explode of at most four copies. Prefer
    the aggregating operators below, which never copy daily rows.
    """
    return spread_to_dates(in_season(daily, date))


def _cumulative() -> tuple[dict, dict]:
    """(partial, final) aggregates of the season sums."""
    sums = {
        "gdd_cum_f50_c86": S.gdd_capped("tmin_c", "tmax_c"),
        "edd_hours_gt86f": S.degree_hours("tmin_c", "tmax_c", K.HEAT_THRESHOLDS_F[0]),
        "edd_hours_gt90f": S.degree_hours("tmin_c", "tmax_c", K.HEAT_THRESHOLDS_F[1]),
        "prcp_cum_mm": F.col("prcp_mm"),
    }
    return {n: F.sum(c) for n, c in sums.items()}, {n: F.coalesce(F.sum(n), F.lit(0.0)) for n in sums}


def _phases() -> tuple[dict, dict]:
    """(partial, final) aggregates of the crop phase windows.

    A phase with days but no reading sums to zero; one without days is NULL.
    """
    doy, partial, final = F.dayofyear("date"), {}, {}
    for name, (low, high) in K.PHASE_DOY.items():
        here = doy.between(low, high)
        partial |= {
            f"_vs_{name}": F.sum(F.when(here, F.col("vpd_kpa"))), f"_vn_{name}": F.count(F.when(here, F.col("vpd_kpa"))),
            f"_ss_{name}": F.sum(F.when(here, F.col("srad_mjm2"))), f"_sn_{name}": F.count(F.when(here, F.lit(1))),
        }
        final |= {
            f"vpd_kpa_{name}": F.try_divide(F.sum(f"_vs_{name}"), F.sum(f"_vn_{name}")),
            f"srad_total_{name}": F.when(F.sum(f"_sn_{name}") > 0, F.coalesce(F.sum(f"_ss_{name}"), F.lit(0.0))),
        }
    return partial, final


def _named(aggs: dict) -> list:
    return [c.alias(n) for n, c in aggs.items()]


def _two_level(daily: DataFrame, keys: list[str], partial: dict, final: dict) -> DataFrame:
    per_interval = in_season(daily).groupBy(*keys, "interval").agg(*_named(partial))
    return spread_to_dates(per_interval).groupBy(*keys, "forecast_date").agg(*_named(final))


def season_cumulative(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Degree days, degree hours and rain from 1 May to each cutoff."""
    return _two_level(daily, keys, *_cumulative())


def phase_window_agg(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vapour deficit and total radiation per crop phase, clipped to each cutoff."""
    return _two_level(daily, keys, *_phases())


def _numbered_runs(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Season days with the number of wet days so far, which names the dry run.

    Keys must hold the year, so a window partition is one season of days.
    """
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    dry = in_season(daily).withColumn("dry", S.is_dry("prcp_mm"))
    return dry.withColumn("run", F.sum((~F.col("dry")).cast("int")).over(w))


def _by_run(daily: DataFrame, keys: list[str], partial: dict, final: dict) -> DataFrame:
    per_run = _numbered_runs(daily, keys).groupBy(*keys, "run", "interval").agg(F.count_if("dry").alias("days"), *_named(partial))
    carried = [F.sum(n).alias(n) for n in partial]
    per_date = spread_to_dates(per_run).groupBy(*keys, "forecast_date", "run").agg(F.sum("days").alias("days"), *carried)
    return per_date.groupBy(*keys, "forecast_date").agg(F.max("days").cast("double").alias("dry_spell_max_days"), *_named(final))


def longest_run(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Longest run of dry rows from 1 May to each cutoff.

    The groupings after the window reuse its partitioning: one shuffle in all.
    """
    return _by_run(daily, keys, {}, {})


def season_features(daily: DataFrame, keys: list[str]) -> DataFrame:
    """All eleven weather features per (keys, forecast date) from one shuffle.

    Sums ride along with the dry runs: every grouping is inside the partitions
    the run window made, so no feature group is computed or joined apart.
    """
    (p1, f1), (p2, f2) = _cumulative(), _phases()
    return _by_run(daily, keys, p1 | p2, f1 | f2)
