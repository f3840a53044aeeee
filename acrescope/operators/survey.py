"""Survey records: picks, finals and first/last per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in a stated order.

    An aggregate of the smallest struct: map-side combined, so a hot key sends
    one row per task instead of its whole group to one sort.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    return df.groupBy(*keys).agg(F.min(F.struct(*lead)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    return df.groupBy(*keys).agg(F.max(F.struct(*lead)).alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])


def priority_pick(records: DataFrame, state: str, value: str, period: str, seen: str) -> DataFrame:
    """Per (state, stage) the value of lowest priority number, first seen on ties."""
    stage, rank = S.stage_of_report(period)
    rows = records.select(state, stage.alias("stage"), rank.alias("priority"), F.col(seen).alias("_seen"),
                          S.parse_reported_number(value).alias("parsed"))
    rows = rows.where(F.col("stage").isNotNull() & F.col("parsed").isNotNull())
    return first_per_key(rows, [state, "stage"], ["priority", "_seen"]).drop("_seen")


def stage_array(picks: DataFrame, state: str) -> DataFrame:
    """Picked values per state as one array in chart order (at most four stages)."""
    order = S.map_codes("stage", {s: i for i, s in enumerate(K.STAGE_ORDER)})
    entry = F.struct(order.alias("seq"), F.col("stage").alias("stage"), F.bround("parsed", 1).alias("value"))
    return picks.groupBy(state).agg(F.array_sort(F.collect_list(entry)).alias("_s")).select(
        state, F.col("_s.stage").alias("stages"), F.col("_s.value").alias("reported"))


def county_finals(records: DataFrame) -> DataFrame:
    """Counts, suppressed counts and the spread of final values per state."""
    rows = records.where(~S.is_placeholder("county_ansi", "county_name")).select(
        "state_ansi", S.parse_reported_number("value").alias("v"))
    return rows.groupBy("state_ansi").agg(
        F.count("v").alias("n_counties"), F.count_if(F.col("v").isNull()).alias("n_missing"),
        F.avg("v").alias("mean_yield"), F.bround(F.min("v"), 1).alias("min_yield"), F.bround(F.max("v"), 1).alias("max_yield"))
