"""Raster work on long pixel tables (tile, r, c, bands...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S


def with_indices(pixels: DataFrame) -> DataFrame:
    """NDVI and EVI of valid pixels; quality bits make them NULL."""
    ok = ~S.qa_bad("qa")
    return pixels.withColumns({
        "valid": ok, "ndvi": F.when(ok, S.ndvi("nir", "red")), "evi": F.when(ok, S.evi("nir", "red", "blue"))})


def pixel_zone_join(pixels: DataFrame, zone_map: DataFrame, on: list[str]) -> DataFrame:
    """Pixels with the zones they touch (membership is an input table)."""
    return pixels.join(zone_map, on)


def zonal_mean(pixels: DataFrame, zone_map: DataFrame, on: list[str], group: list[str], values: list[str]) -> DataFrame:
    """Equal-weight mean per zone of every value, NULLs skipped per value."""
    zoned = pixel_zone_join(pixels, zone_map, on)
    return zoned.groupBy(*group).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n_pixels"))


def zonal_property(pixels: DataFrame, lookup: DataFrame, code: str, group: list[str], value: str) -> DataFrame:
    """Pixel-weighted mean of a looked-up property per group.

    Pixels collapse to (group, code) counts before the look-up; codes without a
    property are skipped by the mean.
    """
    from acrescope.operators.joins import code_lookup_join

    rows = code_lookup_join(pixels, lookup, code, group)
    known = F.when(F.col(value).isNotNull(), F.col("n_pixels"))
    return rows.groupBy(*group).agg(
        F.try_divide(F.sum(F.col(value) * F.col("n_pixels")), F.sum(known)).alias(f"mean_{value}"),
        F.sum("n_pixels").alias("n_pixels"), F.coalesce(F.sum(known), F.lit(0)).alias("n_known"))


def season_ndvi(series: DataFrame, mask: DataFrame, pixel: list[str], zone: list[str]) -> DataFrame:
    """Zone means of per-pixel season statistics over masked (crop) pixels.

    Two levels: each pixel's peak, mean, sum and phase means over the season's
    days, then equal-weight means of those over the zone's pixels.
    """
    doy = F.dayofyear("date")
    lo, hi = K.SEASON_DOY
    rows = series.where(doy.between(lo, hi)).join(mask.where("masked = 1").select(*pixel), pixel, "left_semi")
    phase = lambda name: F.avg(F.when(doy.between(*K.PHASE_DOY[name]), F.col("ndvi")))
    per_pixel = rows.groupBy(*pixel, *[z for z in zone if z not in pixel]).agg(
        F.max("ndvi").alias("ndvi_peak"), F.avg("ndvi").alias("ndvi_gs_mean"), F.sum("ndvi").alias("ndvi_gs_integral"),
        phase("silk").alias("ndvi_silking_mean"), phase("veg").alias("ndvi_veg_mean"))
    stats = ["ndvi_peak", "ndvi_gs_mean", "ndvi_gs_integral", "ndvi_silking_mean", "ndvi_veg_mean"]
    return per_pixel.groupBy(*zone).agg(*[F.avg(c).alias(c) for c in stats], F.count(F.lit(1)).alias("n_pixels"))


def scene_stats_median(pixels: DataFrame, scene: str, window: str, limit: int = 5) -> DataFrame:
    """Mean and population std per scene, then medians over <= ``limit`` scenes per window.

    The first scenes by id are taken, as a search with a result count does.
    """
    per_scene = with_indices(pixels).groupBy(window, scene).agg(
        F.avg("ndvi").alias("ndvi_mean"), F.stddev_pop("ndvi").alias("ndvi_std"),
        F.avg("evi").alias("evi_mean"), F.stddev_pop("evi").alias("evi_std"))
    w = Window.partitionBy(window).orderBy(scene)
    kept = per_scene.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    stats = ["ndvi_mean", "ndvi_std", "evi_mean", "evi_std"]
    return kept.groupBy(window).agg(*[F.median(c).alias(c) for c in stats], F.count(F.lit(1)).alias("n_granules"))


def corn_fraction(pixels: DataFrame, group: list[str], code: str = "class_code", wanted: int = 1) -> DataFrame:
    hit = S.class_mask(code, wanted)
    return pixels.groupBy(*group).agg(
        F.sum(hit).alias("mask_pixels"), F.count(F.lit(1)).alias("total_pixels"), (100.0 * F.avg(hit)).alias("pct"))


def dense_grid(cells: DataFrame, tile: str, values: list[str]) -> DataFrame:
    """Every (r, c) of each tile from 0 to its last row and column; gaps are zero."""
    extent = cells.groupBy(tile).agg(F.max("r").alias("rmax"), F.max("c").alias("cmax"))
    grid = extent.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rmax")))).withColumn(
        "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cmax")))).select(tile, "r", "c")
    out = grid.join(cells.select(tile, "r", "c", *values), [tile, "r", "c"], "left")
    return out.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def window_sums(grid: DataFrame, tile: str, size: int, values: list[str]) -> DataFrame:
    """Sums over every size x size window of a dense grid, by its top-left cell.

    Separable prefix sums: one running sum along rows, one along columns, each
    constant work per cell whatever the window size. A window partition is one
    row or one column of one tile.
    """
    def slide(df, along, across):
        w = Window.partitionBy(tile, across).orderBy(along)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        acc = df.withColumns({f"_p_{v}": F.sum(v).over(run) for v in values})
        out = acc.withColumns({v: F.lead(f"_p_{v}", size - 1).over(w) - F.col(f"_p_{v}") + F.col(v) for v in values})
        return out.where(F.col(values[0]).isNotNull()).select(tile, "r", "c", *values)

    return slide(slide(grid, "c", "r"), "r", "c")


def best_window_2d(cells: DataFrame, tile: str, size: int, score: str, also: list[str] = ()) -> DataFrame:
    """Window with the largest score per tile; ties take the lowest (row, col).

    Tiles smaller than the window have no row.
    """
    values = [score, *also]
    sums = window_sums(dense_grid(cells, tile, values), tile, size, values)
    best = F.max(F.struct(F.col(score).alias(score), (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc"), *[F.col(v).alias(v) for v in also]))
    return sums.groupBy(tile).agg(best.alias("_b")).select(
        tile, (-F.col("_b.nr")).alias("best_r"), (-F.col("_b.nc")).alias("best_c"), F.col(f"_b.{score}").alias("best_count"),
        *[F.col(f"_b.{v}").alias(v) for v in also])


def chip_decision(pixels: DataFrame, tile: str, size: int) -> DataFrame:
    """Best window per tile, or why there is none, in the fixed order of checks."""
    crop = S.class_mask("class_code")
    ok = (~S.qa_bad("qa")).cast("int")
    cells = pixels.select(tile, "r", "c", crop.alias("crop"), ok.alias("valid"), (crop * ok).alias("score"))
    whole = cells.groupBy(tile).agg(F.max("r").alias("rmax"), F.max("c").alias("cmax"), F.sum("crop").alias("crop"), F.sum("score").alias("score"))
    best = best_window_2d(cells, tile, size, "score", ["valid"]).withColumnRenamed("valid", "best_valid")
    area = float(size * size)
    crop_frac, valid_frac = F.col("best_count") / area, F.col("best_valid") / area
    reason = (
        F.when((F.col("rmax") + 1 < size) | (F.col("cmax") + 1 < size), "county_not_in_granule")
        .when(F.col("crop") == 0, "no_cdl_overlap").when(F.col("score") == 0, "all_cloud")
        .when(crop_frac < K.MIN_CROP_FRAC, "below_corn_threshold").when(valid_frac == 0, "all_cloud"))
    out = whole.join(best, tile, "left").withColumn("skip_reason", reason)
    keep = F.col("skip_reason").isNull()
    return out.select(tile, "skip_reason", *[F.when(keep, c).alias(n) for n, c in (
        ("best_r", F.col("best_r")), ("best_c", F.col("best_c")), ("corn_pixel_count", F.col("best_count")),
        ("corn_pixel_frac", crop_frac), ("valid_pixel_frac", valid_frac))])
