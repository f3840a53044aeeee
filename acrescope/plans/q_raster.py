"""Queries: raster-as-table operators over fx_pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope.functions import scalars as S
from acrescope.operators import joins, raster
from acrescope.plans.catalog import query
from acrescope.plans.oracle_views import VIEWS
from acrescope.plans.rounding import fix, fix_sql, rounded, rsql

_BAD = "(CAST(coalesce(qa, 255) AS INTEGER) & 62) > 0"
_NDVI = "least(greatest((nir - red) / (nir + red + 1e-8), -1.0), 1.0)"
_EVI = "least(greatest(2.5 * (nir - red) / (nir + 6.0 * red - 7.5 * blue + 1.0 + 1e-8), -1.0), 1.0)"
VIEWS["fx_vi"] = f"SELECT *, NOT ({_BAD}) AS valid, CASE WHEN NOT ({_BAD}) THEN {_NDVI} END AS ndvi, CASE WHEN NOT ({_BAD}) THEN {_EVI} END AS evi FROM fx_pixel"
VIEWS["fx_zone"] = "SELECT r, c, CAST(r // 8 AS BIGINT) AS zone FROM (SELECT DISTINCT r, c FROM fx_pixel) UNION ALL SELECT r, c, CAST(100 + c // 8 AS BIGINT) FROM (SELECT DISTINCT r, c FROM fx_pixel)"


def _zones(fx):
    """Membership table of the 16 x 16 grid: each pixel touches a row band and a column band; the pixels themselves are not read."""
    cells = fx.spark.range(256).select(F.floor(F.col("id") / 16).alias("r"), (F.col("id") % 16).alias("c"))
    zone = F.explode(F.array(F.floor(F.col("r") / 8), 100 + F.floor(F.col("c") / 8)))
    return cells.withColumn("zone", zone)


@query("veg_index", f"SELECT tile_id, r, c, {fix_sql(_NDVI)} AS ndvi, {fix_sql(_EVI)} AS evi FROM fx_pixel")
def _(fx):
    return fx.pixel.select("tile_id", "r", "c", fix(S.ndvi("nir", "red")).alias("ndvi"), fix(S.evi("nir", "red", "blue")).alias("evi"))


@query("qa_bits_valid", f"SELECT tile_id, r, c, NOT ({_BAD}) AS valid FROM fx_pixel")
def _(fx):
    return fx.pixel.select("tile_id", "r", "c", (~S.qa_bad("qa")).alias("valid"))


_ND = "CASE WHEN qa % 7 = 0 THEN -9999 ELSE qa END"


@query("nodata_clean", f"SELECT tile_id, r, c, ({_ND}) <> -9999 AND code <> -9999 AS valid, CASE WHEN ({_ND}) = -9999 THEN 0 ELSE ({_ND}) END AS stored FROM fx_pixel")
def _(fx):
    band = F.when(F.col("qa") % 7 == 0, -9999).otherwise(F.col("qa"))
    return fx.pixel.withColumn("b", band).select("tile_id", "r", "c", S.band_valid("b", "code").alias("valid"), S.band_clean("b").alias("stored"))


@query("class_threshold", "SELECT tile_id, r, c, CASE WHEN class_code = 1 THEN 1 ELSE 0 END AS mask FROM fx_pixel")
def _(fx):
    return fx.pixel.select("tile_id", "r", "c", S.class_mask("class_code").alias("mask"))


@query("corn_fraction", f"SELECT tile_id, count(*) FILTER (class_code = 1) AS mask_pixels, count(*) AS total_pixels, {fix_sql('100.0 * avg(CASE WHEN class_code = 1 THEN 1.0 ELSE 0.0 END)')} AS pct FROM fx_pixel GROUP BY tile_id")
def _(fx):
    return rounded(raster.corn_fraction(fx.pixel, ["tile_id"]), ["pct"])


@query("pixel_zone_join", "SELECT p.tile_id, z.zone, count(*) AS n_pixels, CAST(sum(p.code) AS BIGINT) AS code_sum FROM fx_pixel p JOIN fx_zone z USING (r, c) GROUP BY ALL")
def _(fx):
    return raster.pixel_zone_join(fx.pixel, _zones(fx), ["r", "c"]).groupBy("tile_id", "zone").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("code").alias("code_sum"))


@query("zonal_mean", f"SELECT tile_id, zone, count(*) AS n_pixels, {fix_sql('avg(ndvi)')} AS ndvi, {fix_sql('avg(evi)')} AS evi FROM fx_vi JOIN fx_zone USING (r, c) GROUP BY tile_id, zone")
def _(fx):
    return rounded(raster.zonal_mean(raster.with_indices(fx.pixel), _zones(fx), ["r", "c"], ["tile_id", "zone"], ["ndvi", "evi"]), ["ndvi", "evi"])


@query("code_lookup_join", f"""SELECT tile_id, count(*) AS n_pixels, count(p_size) AS n_known, {fix_sql('avg(p_size)')} AS mean_p_size FROM fx_pixel
  LEFT JOIN (SELECT p_partkey AS code, p_size FROM part WHERE p_size <= 40) ON fx_pixel.code = code GROUP BY tile_id""".replace("ON fx_pixel.code = code", "USING (code)"))
def _(fx):
    lookup = fx.table("part").where("p_size <= 40").select(F.col("p_partkey").alias("code"), "p_size")
    return rounded(raster.zonal_property(fx.pixel, lookup, "code", ["tile_id"], "p_size"), ["mean_p_size"])


VIEWS["fx_series"] = """SELECT l_suppkey AS tile_id, l_orderkey % 16 AS r, l_partkey % 16 AS c, CAST(l_shipdate AS DATE) AS date, CAST(year(l_shipdate) AS INTEGER) AS year,
  avg(l_discount) * 5 + 0.2 AS ndvi FROM lineitem GROUP BY ALL"""


@query("season_ndvi", f"""SELECT tile_id, year, count(*) AS n_pixels, {rsql([])}{', '.join(f"{fix_sql(f'avg({c})')} AS {c}" for c in ('ndvi_peak', 'ndvi_gs_mean', 'ndvi_gs_integral', 'ndvi_silking_mean', 'ndvi_veg_mean'))} FROM (
  SELECT s.tile_id, s.r, s.c, s.year, max(ndvi) AS ndvi_peak, avg(ndvi) AS ndvi_gs_mean, sum(ndvi) AS ndvi_gs_integral,
    avg(ndvi) FILTER (dayofyear(date) BETWEEN 196 AND 227) AS ndvi_silking_mean, avg(ndvi) FILTER (dayofyear(date) BETWEEN 152 AND 195) AS ndvi_veg_mean
  FROM fx_series s JOIN fx_pixel p ON s.tile_id = p.tile_id AND s.r = p.r AND s.c = p.c AND p.class_code = 1
  WHERE dayofyear(date) BETWEEN 121 AND 273 GROUP BY ALL) GROUP BY tile_id, year""")
def _(fx):
    day = F.col("l_shipdate").cast("date")
    series = fx.table("lineitem").groupBy(F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") % 16).alias("r"), (F.col("l_partkey") % 16).alias("c"),
                                          day.alias("date"), F.year(day).alias("year")).agg((F.avg("l_discount") * 5 + 0.2).alias("ndvi"))
    mask = fx.pixel.select("tile_id", "r", "c", S.class_mask("class_code").alias("masked"))
    out = raster.season_ndvi(series, mask, ["tile_id", "r", "c"], ["tile_id", "year"])
    return rounded(out, ["ndvi_peak", "ndvi_gs_mean", "ndvi_gs_integral", "ndvi_silking_mean", "ndvi_veg_mean"])


_ST = ["ndvi_mean", "ndvi_std", "evi_mean", "evi_std"]


@query("scene_stats_median", f"""SELECT win, count(*) AS n_granules, {', '.join(f"{fix_sql(f'quantile_cont({c}, 0.5)')} AS {c}" for c in _ST)} FROM (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY tile_id) AS rn FROM (
  SELECT tile_id % 15 AS win, tile_id, avg(ndvi) AS ndvi_mean, stddev_pop(ndvi) AS ndvi_std, avg(evi) AS evi_mean, stddev_pop(evi) AS evi_std FROM fx_vi GROUP BY ALL)) WHERE rn <= 5 GROUP BY win""")
def _(fx):
    rows = fx.pixel.withColumn("win", F.col("tile_id") % 15)
    return rounded(raster.scene_stats_median(rows, "tile_id", "win"), _ST)


@query("grid_resample_join", """SELECT t.tile_id, r.r, c.c, coalesce(p.class_code, 0) AS class_code FROM (SELECT DISTINCT tile_id FROM fx_pixel) t
  CROSS JOIN (SELECT CAST(range AS BIGINT) AS r FROM range(6)) r CROSS JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(6)) c
  LEFT JOIN fx_pixel p ON p.tile_id = t.tile_id AND p.r = r.r * 3 + 1 AND p.c = c.c * 3 + 1""")
def _(fx):
    span = F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))
    coarse = fx.pixel.select("tile_id").distinct().withColumn("r", F.explode(span)).withColumn("c", F.explode(span))
    return joins.grid_resample_join(coarse, fx.pixel.select("tile_id", "r", "c", "class_code"), "tile_id")


VIEWS["fx_cell"] = f"SELECT tile_id, r, c, CASE WHEN class_code = 1 THEN 1 ELSE 0 END AS crop, CASE WHEN NOT ({_BAD}) THEN 1 ELSE 0 END AS valid FROM fx_pixel"
VIEWS["fx_best"] = """
SELECT * FROM (SELECT tile_id, r0, c0, best_count, best_valid, row_number() OVER (PARTITION BY tile_id ORDER BY best_count DESC, r0, c0) AS rn FROM (
  SELECT o.tile_id, o.r0, o.c0, CAST(coalesce(sum(crop * valid), 0) AS BIGINT) AS best_count, CAST(coalesce(sum(valid), 0) AS BIGINT) AS best_valid
  FROM (SELECT tile_id, r0, c0 FROM (SELECT tile_id, max(r) AS rmax, max(c) AS cmax FROM fx_cell GROUP BY tile_id)
        CROSS JOIN (SELECT CAST(range AS BIGINT) AS r0 FROM range(16)) CROSS JOIN (SELECT CAST(range AS BIGINT) AS c0 FROM range(16)) WHERE r0 + 3 <= rmax AND c0 + 3 <= cmax) o
  LEFT JOIN fx_cell p ON p.tile_id = o.tile_id AND p.r BETWEEN o.r0 AND o.r0 + 3 AND p.c BETWEEN o.c0 AND o.c0 + 3 GROUP BY ALL)) WHERE rn = 1
"""


@query("best_window_2d", "SELECT tile_id, r0 AS best_r, c0 AS best_c, best_count FROM fx_best")
def _(fx):
    score = S.class_mask("class_code") * (~S.qa_bad("qa")).cast("int")
    return raster.best_window_2d(fx.pixel.select("tile_id", "r", "c", score.alias("score")), "tile_id", 4, "score")


@query("chip_decision", f"""SELECT tile_id, skip_reason, CASE WHEN skip_reason IS NULL THEN r0 END AS best_r, CASE WHEN skip_reason IS NULL THEN c0 END AS best_c,
  CASE WHEN skip_reason IS NULL THEN best_count END AS corn_pixel_count, CASE WHEN skip_reason IS NULL THEN {fix_sql('best_count / 16.0')} END AS corn_pixel_frac,
  CASE WHEN skip_reason IS NULL THEN {fix_sql('best_valid / 16.0')} END AS valid_pixel_frac FROM (
  SELECT w.tile_id, b.r0, b.c0, b.best_count, b.best_valid, CASE WHEN rmax + 1 < 4 OR cmax + 1 < 4 THEN 'county_not_in_granule' WHEN crop = 0 THEN 'no_cdl_overlap'
    WHEN score = 0 THEN 'all_cloud' WHEN best_count / 16.0 < 0.05 THEN 'below_corn_threshold' WHEN best_valid = 0 THEN 'all_cloud' END AS skip_reason
  FROM (SELECT tile_id, max(r) AS rmax, max(c) AS cmax, sum(crop) AS crop, sum(crop * valid) AS score FROM fx_cell GROUP BY tile_id) w LEFT JOIN fx_best b USING (tile_id))""")
def _(fx):
    return rounded(raster.chip_decision(fx.pixel, "tile_id", 4), ["corn_pixel_frac", "valid_pixel_frac"])


_BOX = """(SELECT s_suppkey AS a_id, (s_suppkey % 97)::DOUBLE AS a_xmin, (s_suppkey % 97)::DOUBLE + 1 + s_nationkey % 3 AS a_xmax,
  abs(s_acctbal) / 100 AS a_ymin, abs(s_acctbal) / 100 + 1.5 AS a_ymax FROM supplier)"""
_ZBOX = """(SELECT c_custkey AS b_id, (c_custkey % 101)::DOUBLE AS b_xmin, (c_custkey % 101)::DOUBLE + 0.5 + c_nationkey % 2 AS b_xmax,
  abs(c_acctbal) / 100 AS b_ymin, abs(c_acctbal) / 100 + 1 AS b_ymax FROM customer)"""


@query("bbox_overlap_join", f"SELECT a_id, b_id FROM {_BOX} a JOIN {_ZBOX} b ON a_xmin <= b_xmax AND b_xmin <= a_xmax AND a_ymin <= b_ymax AND b_ymin <= a_ymax")
def _(fx):
    x, y = (F.col("s_suppkey") % 97).cast("double"), F.abs("s_acctbal") / 100
    a = fx.table("supplier").select(F.col("s_suppkey").alias("a_id"), x.alias("a_xmin"), (x + 1 + F.col("s_nationkey") % 3).alias("a_xmax"), y.alias("a_ymin"), (y + 1.5).alias("a_ymax"))
    x, y = (F.col("c_custkey") % 101).cast("double"), F.abs("c_acctbal") / 100
    b = fx.table("customer").select(F.col("c_custkey").alias("b_id"), x.alias("b_xmin"), (x + 0.5 + F.col("c_nationkey") % 2).alias("b_xmax"), y.alias("b_ymin"), (y + 1).alias("b_ymax"))
    return joins.bbox_overlap_join(a, b, 2.0).select("a_id", "b_id")
