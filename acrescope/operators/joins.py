"""Checked, as-of and lookup joins.

No side is hinted as broadcast here. Spark broadcasts a side when its planned
or measured (AQE) size is under the threshold and shuffles it otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrescope import constants as K


def skeleton_cross(entities: DataFrame) -> DataFrame:
    """One row per entity row and forecast date; a narrow explode of four labels."""
    labels = F.array(*[F.struct(F.lit(d).alias("forecast_date"), F.lit(i).alias("date_rank"))
                       for i, d in enumerate(K.FORECAST_DATES)])
    return entities.withColumn("_d", F.explode(labels)).select(*entities.columns, "_d.*")


def guard_unique(df: DataFrame, keys: list[str], what: str = "right side") -> DataFrame:
    """Make the job fail if a key repeats; one row per key flows on otherwise.

    The check is part of the plan (an aggregate on the join key, whose
    partitioning the join reuses), so it costs no extra job.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest]
    )
    fail = F.raise_error(F.lit(f"duplicate key in {what}: {', '.join(keys)}"))
    checked = F.when(F.col("_n") > 1, fail.cast("boolean")).otherwise(F.lit(True))
    return grouped.where(checked).select(*df.columns)


def left_join_checked(left: DataFrame, right: DataFrame, keys: list[str], what: str = "right side") -> DataFrame:
    """Left join that cannot change the row count: a repeated right key is an error."""
    return left.join(guard_unique(right, keys, what), keys, "left")


def broadcast_state(entities: DataFrame, state_rows: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """State-grain values copied to every entity of the state."""
    return entities.join(state_rows, keys, how)


def outer_metric_merge(metrics: dict[str, DataFrame], keys: list[str], value: str, required: list[str]) -> DataFrame:
    """Full outer merge of N one-value tables in one shuffle.

    Tables are stacked with their name and pivoted on the key. Rows in which
    every required metric is NULL are dropped; a missing table is a NULL column.
    """
    names = list(metrics)
    stacked = None
    for name, df in metrics.items():
        part = df.select(*keys, F.lit(name).alias("_metric"), F.col(value).cast("double").alias("_value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_metric") == n, F.col("_value"))).alias(n) for n in names]
    )
    return wide.where(F.coalesce(*[F.col(c) for c in required]).isNotNull())


def asof_strict(readings: DataFrame, key: str, at: str, values: list[str], wanted: DataFrame,
                table: dict = K.WEATHER_CUTOFF_MD) -> DataFrame:
    """Latest reading strictly before each cutoff of the wanted (key, year) pairs.

    Instead of a range join, each reading is tagged with the first cutoff after
    it and only the latest per (key, cutoff) survives a combined aggregate. What
    is left, at most one row per cutoff and key, is carried forward in order.
    """
    day, year = F.col(at), F.year(at)
    ends = [F.make_date(year + shift, F.lit(table[d][0]), F.lit(table[d][1]))
            for shift in (0, 1) for d in K.FORECAST_DATES]
    first_after = F.element_at(F.filter(F.array(*ends), lambda c: c > day), 1)
    payload = F.struct(F.col(at).alias(at), *[F.col(v).alias(v) for v in values])
    latest = (
        readings.withColumn("cutoff", first_after)
        .groupBy(key, "cutoff")
        .agg(F.max_by(payload, at).alias("reading"))
        .select(key, "cutoff", "reading", F.lit(None).cast("int").alias("year"),
                F.lit(None).cast("string").alias("forecast_date"))
    )
    dates = F.explode(F.array(*[
        F.struct(F.lit(d).alias("forecast_date"),
                 F.make_date(F.col("year"), F.lit(table[d][0]), F.lit(table[d][1])).alias("cutoff"))
        for d in K.FORECAST_DATES]))
    asked = (
        wanted.select(key, "year").distinct().select(key, "year", dates.alias("_d"))
        .select(key, "_d.cutoff", F.lit(None).cast(latest.schema["reading"].dataType).alias("reading"),
                "year", "_d.forecast_date")
    )
    w = Window.partitionBy(key).orderBy("cutoff").rangeBetween(Window.unboundedPreceding, 0)
    carried = latest.unionByName(asked).withColumn("seen", F.last("reading", ignorenulls=True).over(w))
    hit = carried.where(F.col("year").isNotNull() & F.col("seen").isNotNull())
    return hit.select(key, "year", "forecast_date", *[f"seen.{v}" for v in values], f"seen.{at}")


def code_lookup_join(pixels: DataFrame, lookup: DataFrame, code: str, group: list[str]) -> DataFrame:
    """Property per pixel code, after collapsing pixels to (group, code) counts.

    The look-up then touches distinct codes instead of pixels, and a hot code
    is one row per group before any shuffle. Unknown codes stay NULL.
    """
    counts = pixels.groupBy(*group, code).agg(F.count(F.lit(1)).alias("n_pixels"))
    return counts.join(lookup, code, "left")


def bbox_overlap_join(boxes: DataFrame, zones: DataFrame, cell: float, step: int = 4) -> DataFrame:
    """Pairs whose bounds intersect, through grids of growing cells instead of a cross join.

    A box lies in the finest grid whose cells are not smaller than it, so it
    covers at most four of them, and in those coarser grids that are some box's finest (one
    small job finds them, so one huge box adds one grid, not all sizes between). A
    pair meets in the grid of its larger box and is kept only in the cell that
    holds the lower-left corner of their overlap, so each pair appears once
    without a distinct. Boxes crowded in one cell are an equi-join key like any
    other, which adaptive execution splits.
    """
    def level(prefix):
        size = F.greatest(F.col(f"{prefix}_xmax") - F.col(f"{prefix}_xmin"), F.col(f"{prefix}_ymax") - F.col(f"{prefix}_ymin"))
        return F.greatest(F.lit(0), F.ceil(F.log(F.greatest(size / cell, F.lit(1.0))) / F.log(F.lit(float(step))))).cast("int")

    used = boxes.select(level("a").alias("l")).union(zones.select(level("b").alias("l"))).where("l IS NOT NULL").distinct().collect()  # a logarithm of the sizes
    used = F.array(*[F.lit(r["l"]) for r in sorted(used)]) if used else F.array(F.lit(0))

    def covered(df, prefix):
        side = F.lit(float(cell)) * F.pow(F.lit(float(step)), F.col("_level"))
        span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / side), F.floor(F.col(hi) / side))
        df = df.withColumn(f"_{prefix}", level(prefix)).withColumn("_level", F.explode(F.filter(used, lambda l: l >= F.col(f"_{prefix}"))))
        return (df.withColumn("_cx", F.explode(span(f"{prefix}_xmin", f"{prefix}_xmax")))
                  .withColumn("_cy", F.explode(span(f"{prefix}_ymin", f"{prefix}_ymax"))))

    a, b = covered(boxes, "a"), covered(zones, "b")
    side = F.lit(float(cell)) * F.pow(F.lit(float(step)), F.col("_level"))
    x0, y0 = F.greatest("a_xmin", "b_xmin"), F.greatest("a_ymin", "b_ymin")
    return (
        a.join(b, ["_level", "_cx", "_cy"])
        .where(F.col("_level") == F.greatest("_a", "_b"))
        .where((F.col("a_xmin") <= F.col("b_xmax")) & (F.col("b_xmin") <= F.col("a_xmax")))
        .where((F.col("a_ymin") <= F.col("b_ymax")) & (F.col("b_ymin") <= F.col("a_ymax")))
        .where((F.col("_cx") == F.floor(x0 / side)) & (F.col("_cy") == F.floor(y0 / side)))
        .drop("_level", "_cx", "_cy", "_a", "_b")
    )


def grid_resample_join(coarse: DataFrame, fine: DataFrame, tile: str, factor: int = 3, value: str = "class_code") -> DataFrame:
    """Nearest fine cell for each coarse cell by index; outside the fine grid is 0."""
    centre = factor // 2
    pick = fine.where((F.col("r") % factor == centre) & (F.col("c") % factor == centre)).select(
        tile, F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c"), value
    )
    out = coarse.join(pick, [tile, "r", "c"], "left")
    return out.withColumn(value, F.coalesce(value, F.lit(0)))


def resume_anti(work: DataFrame, done: DataFrame, keys: list[str], redo_empty: str | None = None) -> DataFrame:
    """Work items not already done; optionally those done without a result again."""
    if redo_empty is not None:
        done = done.where(F.col(redo_empty) != 0)
    return work.join(done.select(*keys), keys, "left_anti")


def semi_keep(df: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(kept.select(*keys), keys, "left_semi")


def unmatched(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of one table absent from another."""
    return df.select(*keys).distinct().join(other.select(*keys), keys, "left_anti")
