"""Survey cleaning, master panel assembly, completeness and split pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.functions import scalars as S
from acrescope.operators.joins import left_join_checked, skeleton_cross


def ratio_clip(survey: DataFrame) -> DataFrame:
    """Irrigated share, rainfed area and harvest ratio from reported areas."""
    return survey.withColumns({
        "irrigated_share": S.irrigated_share("acres_harvested_irr", "acres_harvested_all"),
        "acres_harvested_noirr_derived": S.rainfed_area("acres_harvested_all", "acres_harvested_irr"),
        "harvest_ratio": S.harvest_ratio("acres_harvested_all", "acres_planted_all"),
    })


def assemble_panel(survey: DataFrame, weather: DataFrame, drought: DataFrame,
                   entity: list[str], state: str) -> DataFrame:
    """Skeleton of (entity, year, date) with each source joined under a fan-out check.

    Columns are taken in a fixed order: keys, target and survey, then sources.
    """
    base = skeleton_cross(survey)
    wide = left_join_checked(base, weather, [*entity, "year", "forecast_date"], "weather")
    return left_join_checked(wide, drought, [state, "year", "forecast_date"], "drought")


def synthesize_year(history: DataFrame, year: int, prior: int | None = None, target: str = "yield_target") -> DataFrame:
    """History plus a forecast year copied from the prior one, target unknown."""
    prior = year - 1 if prior is None else prior
    reported = history.withColumn("aux_provenance", F.lit("reported"))
    future = (
        history.where(F.col("year") == prior)
        .withColumn("year", F.lit(year).cast(history.schema["year"].dataType))
        .withColumn(target, F.lit(None).cast(history.schema[target].dataType))
        .withColumn("aux_provenance", F.lit("prior_year"))
    )
    return reported.unionByName(future)


def qualifying_history(panel: DataFrame, entity: str, years: tuple[int, int], complete: str = "complete",
                       target: str = "yield_target") -> DataFrame:
    """Years in which every date row is complete and has a target, per entity (0 if none)."""
    low, high = years
    ok = F.col(complete) & F.col(target).isNotNull()
    per_year = panel.groupBy(entity, "year").agg(F.bool_and(ok).alias("ok"))
    good = F.col("ok") & F.col("year").between(low, high)
    return per_year.groupBy(entity).agg(F.count_if(good).alias("n_years"))


def min_history(panel: DataFrame, entity: str, n: int, years: tuple[int, int], **kw) -> DataFrame:
    """Rows of entities with at least n qualifying years."""
    kept = qualifying_history(panel, entity, years, **kw).where(F.col("n_years") >= n)
    return panel.join(kept.select(entity), entity, "left_semi")


def train_pool(panel: DataFrame, entity: str, n: int, years: tuple[int, int], complete: str = "complete",
               target: str = "yield_target", require_complete: bool = True) -> DataFrame:
    """Training rows: enough history, year in range, target known, row complete."""
    rows = min_history(panel, entity, n, years, complete=complete, target=target)
    rows = rows.where(F.col("year").between(*years) & F.col(target).isNotNull())
    return rows.where(F.col(complete)) if require_complete else rows


def query_grid(panel: DataFrame, keys: list[str], years: tuple[int, int], states=None, dates=None) -> DataFrame:
    """Distinct work items of the panel inside the requested ranges."""
    rows = panel.where(F.col("year").between(*years))
    if states is not None:
        rows = rows.where(F.col("state").isin(*states))
    if dates is not None:
        rows = rows.where(F.col("forecast_date").isin(*dates))
    return rows.select(*keys).distinct()


def reorder(df: DataFrame, lead: list[str], groups: list[list[str]]) -> DataFrame:
    """Keys, then known groups, then whatever is left."""
    wanted = [c for c in [*lead, *[c for g in groups for c in g]] if c in df.columns]
    rest = [c for c in df.columns if c not in wanted]
    return df.select(*wanted, *rest)


def numeric_features(df: DataFrame, exclude: set[str], curated: list[str] | None = None) -> list[str]:
    """Curated feature names that exist, or every numeric column but the excluded."""
    if curated is not None:
        return [c for c in curated if c in df.columns]
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if n not in exclude and t in numeric]
