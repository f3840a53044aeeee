"""Queries: scene ids, phases, capped lists and chip sequences over fx_scene."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S
from acrescope.operators import chips, joins, quality
from acrescope.plans.catalog import query
from acrescope.plans.oracle_views import VIEWS
from acrescope.plans.rounding import fix_sql, rounded, rsql
from acrescope.session import fresh_path

_MD = "(month(scene_date) * 100 + day(scene_date))"
_PHASE = f"CASE WHEN {_MD} BETWEEN 717 AND 815 THEN 'aug1' WHEN {_MD} BETWEEN 817 AND 915 THEN 'sep1' WHEN {_MD} BETWEEN 917 AND 1015 THEN 'oct1' WHEN {_MD} BETWEEN 1017 AND 1115 THEN 'final' END"
VIEWS["fx_index"] = f"""
SELECT *, 'chips/' || geoid || '/' || year || '/' || phase || '_' || strftime(scene_date, '%Y-%m-%d') || '_' || sensor || '_T' || tile || '_' || strftime(scene_date, '%Y%j') || '.tif' AS chip_path
FROM (SELECT *, {_PHASE} AS phase, substr(granule_id, 5, 3) AS sensor, substr(granule_id, 10, 5) AS tile FROM fx_scene)
"""


def index(fx):
    """Scenes with parsed parts, phase and chip path."""
    good, _bad = chips.parsed_scenes(fx.scene)
    return good.withColumn("chip_path", S.chip_path("geoid", "year", "phase", "scene_date", "sensor", "tile"))


@query("phase_label", f"SELECT granule_id, l_orderkey, l_partkey, {_PHASE} AS phase FROM fx_scene")
def _(fx):
    return fx.scene.select("granule_id", "l_orderkey", "l_partkey", S.scene_phase("scene_date").alias("phase"))


@query("parse_scene_id", """SELECT granule_id, substr(granule_id, 5, 3) AS sensor, substr(granule_id, 10, 5) AS tile, scene_date, '2.0' AS version,
  substr(t, 1, 2) || ':' || substr(t, 3, 2) || ':' || substr(t, 5, 2) AS scene_time FROM (SELECT *, substr(granule_id, 24, 6) AS t FROM fx_scene)""")
def _(fx):
    good, _bad = chips.parsed_scenes(fx.scene.drop("scene_date"))
    return good.select("granule_id", "sensor", "tile", "scene_date", "version", "scene_time")


@query("chip_path", "SELECT granule_id, l_orderkey, l_partkey, chip_path FROM fx_index WHERE phase IS NOT NULL")
def _(fx):
    return index(fx).where("phase IS NOT NULL").select("granule_id", "l_orderkey", "l_partkey", "chip_path")


@query("band_map", """SELECT sensor, role, CASE sensor WHEN 'L30' THEN l ELSE s END AS band, count(*) AS n_scenes FROM fx_index CROSS JOIN (VALUES ('blue', 'B02', 'B02'), ('green', 'B03', 'B03'), ('red', 'B04', 'B04'),
  ('nir_narrow', 'B05', 'B8A'), ('swir1', 'B06', 'B11'), ('swir2', 'B07', 'B12'), ('fmask', 'Fmask', 'Fmask')) AS b(role, l, s) GROUP BY ALL""")
def _(fx):
    per = index(fx).groupBy("sensor").agg(F.count(F.lit(1)).alias("n_scenes"))
    return per.join(chips.band_table(fx.spark), "sensor").where(F.col("band") == F.coalesce(*[F.when(F.col("role") == r, S.band_code("sensor", r)) for r in K.BAND_CODES["L30"]]))


@query("scene_meta", """SELECT granule_id, l_orderkey, l_partkey, CASE WHEN l_orderkey % 3 < 2 THEN cloud_pct END AS cloud_pct FROM fx_scene""")
def _(fx):
    k = F.col("l_orderkey") % 3
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    gid, cloud = q(F.col("granule_id")), F.col("cloud_pct").cast("string")
    doc = F.when(k == 0, F.concat(F.lit('{"umm":{"GranuleUR":'), gid, F.lit(',"AdditionalAttributes":[{"Name":"OTHER","Values":["1"]},{"Name":"CLOUD_COVERAGE","Values":['), q(cloud), F.lit("]}]}}"))) \
        .when(k == 1, F.concat(F.lit('{"id":'), gid, F.lit(',"properties":{"eo:cloud_cover":'), cloud, F.lit("}}"))) \
        .otherwise(F.concat(F.lit('{"properties":{"eo:cloud_cover":"n/a"},"urls":["https://host/path/'), F.col("granule_id"), F.lit('.B04.tif"]}')))
    return chips.scene_meta(fx.scene.select("l_orderkey", "l_partkey", doc.alias("doc")), "doc", ["l_orderkey", "l_partkey"])


@query("topk_per_group", f"""SELECT state, year, phase, granule_id, {fix_sql('min(cloud_pct)')} AS cloud_pct FROM (
  SELECT *, row_number() OVER (PARTITION BY state, year, phase ORDER BY cloud_pct ASC NULLS LAST, granule_id) AS rn FROM fx_index WHERE phase IS NOT NULL) WHERE rn <= 10 GROUP BY state, year, phase, granule_id""")
def _(fx):
    return rounded(chips.topk_per_group(index(fx).where("phase IS NOT NULL"), ["state", "year", "phase"], 10), ["cloud_pct"])


_ORD = "CASE WHEN valid_pixel_frac >= 0.5 AND corn_pixel_frac >= 0.05 THEN 0 ELSE 1 END, scene_date DESC, valid_pixel_frac DESC, corn_pixel_frac DESC, chip_path, granule_id"


@query("best_chip", f"""SELECT geoid, year, phase, granule_id, scene_date, {rsql(['valid_pixel_frac', 'corn_pixel_frac'])} FROM (
  SELECT *, row_number() OVER (PARTITION BY geoid, year, phase ORDER BY {_ORD}) AS rn FROM fx_index WHERE phase IS NOT NULL) WHERE rn = 1""")
def _(fx):
    out = chips.best_chip(index(fx).where("phase IS NOT NULL"), ["geoid", "year", "phase"], ["granule_id", "scene_date", "valid_pixel_frac", "corn_pixel_frac"])
    return rounded(out.drop("chip_path"), ["valid_pixel_frac", "corn_pixel_frac"])


VIEWS["fx_plan"] = """SELECT * FROM (VALUES ('08-01', 'vegetative', 0, 'aug1', 8, 1), ('09-01', 'vegetative', 0, 'aug1', 9, 1), ('09-01', 'silking', 0, 'sep1', 9, 1),
  ('10-01', 'vegetative', 0, 'aug1', 10, 1), ('10-01', 'silking', 0, 'sep1', 10, 1), ('10-01', 'grain_fill', 0, 'oct1', 10, 1),
  ('EOS', 'vegetative', 0, 'aug1', 11, 15), ('EOS', 'silking', 0, 'sep1', 11, 15), ('EOS', 'grain_fill', 0, 'oct1', 11, 15), ('EOS', 'grain_fill', 1, 'final', 11, 15)) AS t(forecast_date, slot, priority, phase, m, d)"""
VIEWS["fx_picks"] = f"""
SELECT * FROM (SELECT i.geoid, i.year, p.forecast_date, p.slot, make_date(i.year, p.m, p.d) AS cutoff, i.granule_id, i.scene_date, i.valid_pixel_frac, i.corn_pixel_frac,
  row_number() OVER (PARTITION BY i.geoid, i.year, p.forecast_date, p.slot ORDER BY p.priority, {_ORD}) AS rn
  FROM fx_index i JOIN fx_plan p ON i.phase = p.phase AND i.scene_date < make_date(i.year, p.m, p.d)) WHERE rn = 1
"""
VIEWS["fx_sequence"] = """
SELECT q.geoid, q.year, q.forecast_date, q.cutoff, s.step, s.slot, p.granule_id IS NULL AS is_padded, coalesce(p.granule_id, q.granule_id) AS granule_id,
  coalesce(p.scene_date, q.scene_date) AS scene_date, coalesce(p.valid_pixel_frac, q.valid_pixel_frac) AS valid_pixel_frac, coalesce(p.corn_pixel_frac, q.corn_pixel_frac) AS corn_pixel_frac
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY geoid, year, forecast_date ORDER BY scene_date DESC) AS newest FROM fx_picks) WHERE newest = 1) q
CROSS JOIN (VALUES (0, 'vegetative'), (1, 'silking'), (2, 'grain_fill')) AS s(step, slot)
LEFT JOIN fx_picks p ON p.geoid = q.geoid AND p.year = q.year AND p.forecast_date = q.forecast_date AND p.slot = s.slot
"""


@query("chip_sequence", f"SELECT geoid, year, forecast_date, step, slot, is_padded, granule_id, scene_date, {rsql(['valid_pixel_frac', 'corn_pixel_frac'])} FROM fx_sequence")
def _(fx):
    out = chips.chip_sequence(index(fx), "geoid").drop("cutoff", "phase", "chip_path")
    return rounded(out, ["valid_pixel_frac", "corn_pixel_frac"])


_QC = """SELECT geoid, year, forecast_date, count(*) FILTER (NOT is_padded) AS chip_count, CAST(max(CASE WHEN NOT is_padded THEN cutoff - scene_date END) AS INTEGER) AS chip_age_days_max,
  100.0 * (1.0 - min(valid_pixel_frac) FILTER (NOT is_padded)) AS cloud_pct_max, min(corn_pixel_frac) FILTER (NOT is_padded) AS corn_pixel_frac_min FROM fx_sequence GROUP BY ALL"""


@query("chip_qc", f"SELECT geoid, year, forecast_date, chip_count, chip_age_days_max, {rsql(['cloud_pct_max', 'corn_pixel_frac_min'])} FROM ({_QC})")
def _(fx):
    return rounded(chips.chip_qc(chips.chip_sequence(index(fx), "geoid"), "geoid"), ["cloud_pct_max", "corn_pixel_frac_min"])


@query("chip_coverage", f"""SELECT p.geoid, p.year, d.forecast_date, coalesce(chip_count, 0) AS chip_count, coalesce(chip_count, 0) = 0 AS fully_padded, chip_age_days_max,
  {rsql(['cloud_pct_max', 'corn_pixel_frac_min'])} FROM fx_panel p CROSS JOIN fx_dates d LEFT JOIN ({_QC}) q ON p.geoid = q.geoid AND p.year = q.year AND d.forecast_date = q.forecast_date""")
def _(fx):
    grid = joins.skeleton_cross(fx.panel.select("geoid", "year")).drop("date_rank")
    return rounded(chips.chip_coverage(grid, chips.chip_sequence(index(fx), "geoid"), "geoid"), ["cloud_pct_max", "corn_pixel_frac_min"])


@query("sequence_inputs", """SELECT geoid, year, forecast_date, CAST(count(*) AS INTEGER) AS n_steps, CAST(sum(dayofyear(scene_date)) AS DOUBLE) AS doy_sum, CAST(sum(year(scene_date)) AS DOUBLE) AS year_sum FROM fx_sequence GROUP BY ALL""")
def _(fx):
    seq = chips.sequence_inputs(chips.chip_sequence(index(fx), "geoid"), "geoid", F.lit(42.0), F.lit(-93.0))
    total = lambda i: F.aggregate("time_coords", F.lit(0.0), lambda s, x: s + x[i])
    return seq.select("geoid", "year", "forecast_date", F.size("chip_paths").alias("n_steps"), total(1).alias("doy_sum"), total(0).alias("year_sum"))


@query("resume_anti", """SELECT geoid, year, forecast_date FROM fx_panel CROSS JOIN fx_dates f WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT geoid, year, forecast_date FROM fx_sequence WHERE year < 1999) s WHERE s.geoid = fx_panel.geoid AND s.year = fx_panel.year AND s.forecast_date = f.forecast_date)""")
def _(fx):
    work = joins.skeleton_cross(fx.panel.select("geoid", "year")).drop("date_rank")
    done = chips.chip_qc(chips.chip_sequence(index(fx).where("year < 1999"), "geoid"), "geoid")
    return joins.resume_anti(work, done, ["geoid", "year", "forecast_date"], redo_empty="chip_count")


@query("unmatched_report", "SELECT DISTINCT chip_path FROM fx_index WHERE phase IS NOT NULL AND chip_path NOT IN (SELECT chip_path FROM fx_index WHERE phase IS NOT NULL AND l_suppkey % 3 > 0)")
def _(fx):
    rows = index(fx).where("phase IS NOT NULL")
    return joins.unmatched(rows, rows.where("l_suppkey % 3 > 0"), ["chip_path"])


@query("expect_unique", "SELECT tile, scene_date, count(*) AS n FROM fx_index WHERE geoid NOT LIKE '00%' GROUP BY ALL HAVING count(*) > 1")
def _(fx):
    return quality.expect_unique(index(fx), ["tile", "scene_date"], exempt=F.col("geoid").startswith("00"))


_IDX = """(SELECT geoid, CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE chip_path END AS chip_path, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 1 END AS corn_pixel_count, corn_pixel_frac, valid_pixel_frac,
  CASE WHEN l_orderkey % 8 = 0 THEN 'all_cloud' WHEN l_orderkey % 20 = 4 THEN 'odd' END AS skip_reason FROM fx_index)"""


def _faulty(fx):
    k = F.col("l_orderkey")
    return index(fx).withColumns({
        "chip_path": F.when(k % 4 != 0, F.col("chip_path")), "corn_pixel_count": F.when(F.col("l_partkey") % 10 != 0, 1),
        "skip_reason": F.when(k % 8 == 0, "all_cloud").when(k % 20 == 4, "odd")})


@query("expect_rules", f"""SELECT 'positive_without_measures' AS rule, count(*) FILTER (chip_path IS NOT NULL AND corn_pixel_count IS NULL) AS n_violations FROM {_IDX}
  UNION ALL SELECT 'negative_without_reason', count(*) FILTER (chip_path IS NULL AND skip_reason IS NULL) FROM {_IDX} UNION ALL SELECT 'bad_entity_key', count(*) FILTER (length(geoid) <> 5) FROM {_IDX}
  UNION ALL SELECT 'unknown_reason', count(*) FILTER (skip_reason = 'odd') FROM {_IDX}""")
def _(fx):
    return quality.expect_rules(_faulty(fx), quality.index_rules())


_RULES = """SELECT *, chip_path IS NOT NULL AND corn_pixel_count IS NULL AS r1, chip_path IS NULL AND skip_reason IS NULL AS r2, length(geoid) <> 5 AS r3, coalesce(skip_reason = 'odd', false) AS r4 FROM """ + _IDX


@query("expect_observed", f"""SELECT unnest(['positive_without_measures', 'negative_without_reason', 'bad_entity_key', 'unknown_reason', 'n_rows', 'n_broken', 'good', 'quarantined']) AS what,
  unnest([count(*) FILTER (r1), count(*) FILTER (r2), count(*) FILTER (r3), count(*) FILTER (r4), count(*), count(*) FILTER (r1 OR r2 OR r3 OR r4), count(*) FILTER (NOT (r1 OR r2 OR r3 OR r4)), count(*) FILTER (r1 OR r2 OR r3 OR r4)]) AS n FROM ({_RULES})""")
def _(fx):
    """One job scans the index, counts every rule as it goes, and writes good and quarantined rows apart."""
    good, bad, counts = quality.split_write(_faulty(fx), quality.index_rules(), fresh_path(fx.spark, "checked"))
    seen = fx.spark.createDataFrame([(k, int(v)) for k, v in counts.items()], "what string, n long")
    sizes = good.agg(F.count("*").alias("n")).select(F.lit("good").alias("what"), "n").unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("quarantined").alias("what"), "n"))
    return seen.unionByName(sizes)


@query("expect_quarantine", f"""SELECT geoid, chip_path IS NULL AS negative, concat_ws(',', CASE WHEN r1 THEN 'positive_without_measures' END, CASE WHEN r2 THEN 'negative_without_reason' END, CASE WHEN r3 THEN 'bad_entity_key' END,
  CASE WHEN r4 THEN 'unknown_reason' END) AS broken, count(*) AS n FROM ({_RULES}) WHERE r1 OR r2 OR r3 OR r4 GROUP BY ALL""")
def _(fx):
    """Quarantined rows by entity and the rules they break."""
    _, bad, _ = quality.split_write(_faulty(fx), quality.index_rules(), fresh_path(fx.spark, "checked"))
    return bad.groupBy("geoid", F.col("chip_path").isNull().alias("negative"), F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


@query("expect_monotone", """SELECT a || '<' || b AS rule, count(*) FILTER (x < y - 1e-9) AS n_violations FROM (
  SELECT unnest(['d0', 'd1', 'd2', 'd3']) AS a, unnest(['d1', 'd2', 'd3', 'd4']) AS b, unnest([d0, d1, d2, d3]) AS x, unnest([d1, d2, d3, d4]) AS y FROM fx_weekly) GROUP BY a, b""")
def _(fx):
    return quality.expect_monotone(fx.weekly, ["d0", "d1", "d2", "d3", "d4"])


@query("expect_values", "SELECT DISTINCT phase FROM fx_index WHERE phase NOT IN ('aug1', 'sep1')")
def _(fx):
    rows = index(fx)
    quality.expect_columns(rows, ["granule_id", "geoid", "year", "phase"])
    return quality.outside_allowed(rows, "phase", ["aug1", "sep1"])


@query("dedupe_sentinels", """SELECT geoid, granule_id, count(*) AS n FROM (SELECT CASE WHEN l_suppkey % 10 = 0 THEN '00000' ELSE geoid END AS geoid, granule_id FROM fx_index) WHERE geoid <> '00000' GROUP BY ALL
  UNION ALL SELECT DISTINCT '00000', granule_id, 1 FROM fx_index WHERE l_suppkey % 10 = 0""")
def _(fx):
    rows = index(fx).withColumn("geoid", F.when(F.col("l_suppkey") % 10 == 0, K.SENTINEL_ENTITY).otherwise(F.col("geoid")))
    return chips.dedupe_sentinels(rows, ["granule_id", "geoid"], "geoid").groupBy("geoid", "granule_id").agg(F.count(F.lit(1)).alias("n"))
