"""DuckDB definitions of the bound tables; inlined as CTEs where mentioned."""

from __future__ import annotations

VIEWS: dict[str, str] = {}

VIEWS["fx_entity"] = """
SELECT c.c_custkey,
       lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0') ||
       CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN '001' WHEN 'BUILDING' THEN '003' WHEN 'FURNITURE' THEN '005'
                           WHEN 'HOUSEHOLD' THEN '007' ELSE '009' END AS geoid,
       r.r_name AS state
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
"""
VIEWS["fx_line"] = """
SELECT e.geoid, e.state, l.*, CAST(l.l_shipdate AS DATE) AS d, CAST(year(l.l_shipdate) AS INTEGER) AS y
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN fx_entity e ON o.o_custkey = e.c_custkey
"""
VIEWS["fx_daily"] = """
SELECT geoid, state, d AS date, y AS year, min(l_quantity) - 10 AS tmin_c, max(l_quantity) - 5 AS tmax_c,
       sum(l_discount) * 50 AS prcp_mm, avg(l_extendedprice) / 4000 AS srad_mjm2, avg(l_tax) * 40 AS vpd_kpa
FROM fx_line GROUP BY ALL
"""
VIEWS["fx_weekly"] = """
SELECT e.state, CAST(date_trunc('week', o.o_orderdate) AS DATE) + 6 AS valid_end,
       100.0 * avg(CASE WHEN o_orderpriority <= '5-LOW' THEN 1 ELSE 0 END) AS d0,
       100.0 * avg(CASE WHEN o_orderpriority < '5' THEN 1 ELSE 0 END) AS d1,
       100.0 * avg(CASE WHEN o_orderpriority < '4' THEN 1 ELSE 0 END) AS d2,
       100.0 * avg(CASE WHEN o_orderpriority < '3' THEN 1 ELSE 0 END) AS d3,
       100.0 * avg(CASE WHEN o_orderpriority < '2' THEN 1 ELSE 0 END) AS d4
FROM orders o JOIN fx_entity e ON o.o_custkey = e.c_custkey GROUP BY ALL
"""
VIEWS["fx_panel"] = """
SELECT geoid, state, y AS year,
       sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) / 10 AS yield_target,
       sum(l_quantity) AS acres_planted_all, sum(l_quantity * (1 - l_tax)) AS acres_harvested_all,
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS acres_harvested_irr
FROM fx_line GROUP BY ALL
"""
VIEWS["fx_scene"] = """
SELECT geoid, state, y AS year, d AS scene_date,
       'HLS.' || CASE WHEN l_linenumber % 2 = 0 THEN 'L30' ELSE 'S30' END || '.T' ||
       lpad(CAST(l_suppkey % 60 AS VARCHAR), 2, '0') || 'TVH.' || CAST(y AS VARCHAR) ||
       lpad(CAST(dayofyear(d) AS VARCHAR), 3, '0') || 'T' || lpad(CAST(l_orderkey % 240000 AS VARCHAR), 6, '0') ||
       '.v2.0' AS granule_id,
       l_extendedprice / 1000 AS cloud_pct, 1 - l_quantity / 50.0 AS valid_pixel_frac, l_tax * 10 AS corn_pixel_frac,
       l_orderkey, l_linenumber, l_partkey, l_suppkey
FROM fx_line WHERE month(d) BETWEEN 5 AND 10 OR (month(d) = 11 AND day(d) <= 15)
"""
VIEWS["fx_pixel"] = """
SELECT l_suppkey AS tile_id, l_orderkey % 16 AS r, l_partkey % 16 AS c,
       min(l_linenumber) AS class_code, min(l_partkey) AS code, CAST(sum(l_quantity) AS INTEGER) % 256 AS qa,
       avg(l_discount) + 0.2 AS nir, avg(l_tax) + 0.05 AS red, avg(l_tax) AS blue
FROM lineitem GROUP BY ALL
"""
VIEWS["fx_classcount"] = """
SELECT l_suppkey AS image_id, l_linenumber AS class_id, CAST(sum(l_quantity) AS BIGINT) AS pixel_count
FROM lineitem GROUP BY ALL
"""
VIEWS["fx_reported"] = """
SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS state_ansi,
       CASE WHEN c_custkey % 17 = 0 THEN '' ELSE CAST(c_custkey % 200 AS VARCHAR) END AS county_ansi,
       CASE WHEN c_custkey % 13 = 0 THEN 'Other (Combined) Counties' ELSE c_name END AS county_name,
       CASE WHEN c_custkey % 11 = 0 THEN ' (D)' WHEN c_custkey % 7 = 0 THEN '1,' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
            ELSE CAST(c_acctbal AS VARCHAR) END AS value,
       CASE c_custkey % 6 WHEN 0 THEN 'YEAR' WHEN 1 THEN 'YEAR - AUG FORECAST' WHEN 2 THEN 'YEAR - SEP FORECAST'
            WHEN 3 THEN 'YEAR - NOV FORECAST' WHEN 4 THEN 'MARKETING YEAR' ELSE 'mid oct report' END AS reference_period_desc
FROM customer
"""
VIEWS["fx_log"] = """
SELECT o_custkey % 4 AS shard, o_orderkey AS seq,
       CASE o_orderkey % 3
            WHEN 0 THEN 'after resume-skip: ' || o_custkey || ' granules to download (' || (o_orderkey % 50) || ' already done)'
            WHEN 1 THEN '[' || (o_orderkey % 90) || '/90] g' || o_orderkey || ' -> ' || (o_custkey % 9) || ' rows (' || (o_custkey % 5) || ' chips written)'
            ELSE 'CELL IA-2018 done in ' || (o_orderkey % 700) || '.5s (' || (o_custkey % 60) || ' granules processed)' END AS line
FROM orders
"""

# --- calendar ----------------------------------------------------------------
VIEWS["fx_full_log"] = """
SELECT o_custkey % 4 AS shard, o_orderkey AS seq, o_orderkey % 16 AS kind, o_custkey AS c, o_orderkey AS k, (['IA', 'CO', 'MO', 'NE', 'WI'])[o_custkey % 5 + 1] || '-' || (2013 + o_orderkey % 12) AS cell FROM orders
"""
VIEWS["fx_dates"] = """
SELECT * FROM (VALUES ('08-01', 0), ('09-01', 1), ('10-01', 2), ('EOS', 3)) AS t(forecast_date, date_rank)
"""
VIEWS["fx_cutoffs"] = """
SELECT p.year, f.forecast_date, f.date_rank,
       CASE f.forecast_date WHEN '08-01' THEN make_date(p.year, 8, 1) WHEN '09-01' THEN make_date(p.year, 9, 1)
            WHEN '10-01' THEN make_date(p.year, 10, 1) ELSE make_date(p.year, 11, 30) END AS cutoff
FROM (SELECT DISTINCT year FROM fx_daily) p CROSS JOIN fx_dates f
"""

# --- season features ---------------------------------------------------------
GDD = """greatest((least(greatest(tmin_c * 9.0 / 5.0 + 32.0, 50.0), 86.0)
        + least(greatest(tmax_c * 9.0 / 5.0 + 32.0, 50.0), 86.0)) / 2.0 - 50.0, 0.0)"""


def degree_hours_sql(t: float) -> str:
    lo, hi = "(tmin_c * 9.0 / 5.0 + 32.0)", "(tmax_c * 9.0 / 5.0 + 32.0)"
    mean, amp = f"(({lo} + {hi}) / 2.0)", f"(({hi} - {lo}) / 2.0)"
    theta = f"asin(least(greatest(({t} - {mean}) / nullif({amp}, 0), -1.0), 1.0))"
    return f"""CASE WHEN {lo} >= {t} THEN 24.0 * ({mean} - {t})
        WHEN {hi} > {t} THEN greatest((24.0 / pi()) * (({mean} - {t}) * (pi() / 2.0 - {theta}) + {amp} * cos({theta})), 0.0)
        ELSE 0.0 END"""


VIEWS["fx_season"] = """
SELECT d.*, c.forecast_date, c.date_rank, CAST(dayofyear(d.date) AS INTEGER) AS doy
FROM fx_daily d JOIN fx_cutoffs c
  ON d.year = c.year AND d.date >= make_date(d.year, 5, 1) AND d.date < c.cutoff
"""
VIEWS["fx_cumulative"] = f"""
SELECT geoid, state, year, forecast_date, coalesce(sum({GDD}), 0) AS gdd_cum_f50_c86,
       coalesce(sum({degree_hours_sql(86.0)}), 0) AS edd_hours_gt86f,
       coalesce(sum({degree_hours_sql(90.0)}), 0) AS edd_hours_gt90f,
       coalesce(sum(prcp_mm), 0) AS prcp_cum_mm
FROM fx_season GROUP BY geoid, state, year, forecast_date
"""
VIEWS["fx_phase"] = """
SELECT geoid, state, year, forecast_date,
       avg(vpd_kpa) FILTER (doy BETWEEN 152 AND 195) AS vpd_kpa_veg,
       avg(vpd_kpa) FILTER (doy BETWEEN 196 AND 227) AS vpd_kpa_silk,
       avg(vpd_kpa) FILTER (doy BETWEEN 228 AND 273) AS vpd_kpa_grain,
       CASE WHEN count(*) FILTER (doy BETWEEN 152 AND 195) > 0
            THEN coalesce(sum(srad_mjm2) FILTER (doy BETWEEN 152 AND 195), 0) END AS srad_total_veg,
       CASE WHEN count(*) FILTER (doy BETWEEN 196 AND 227) > 0
            THEN coalesce(sum(srad_mjm2) FILTER (doy BETWEEN 196 AND 227), 0) END AS srad_total_silk,
       CASE WHEN count(*) FILTER (doy BETWEEN 228 AND 273) > 0
            THEN coalesce(sum(srad_mjm2) FILTER (doy BETWEEN 228 AND 273), 0) END AS srad_total_grain
FROM fx_season GROUP BY geoid, state, year, forecast_date
"""
VIEWS["fx_dry"] = """
SELECT geoid, state, year, forecast_date, CAST(max(run) AS DOUBLE) AS dry_spell_max_days FROM (
  SELECT geoid, state, year, forecast_date, island, count(*) FILTER (dry) AS run FROM (
    SELECT *, coalesce(prcp_mm < 2.0, false) AS dry,
           sum(CASE WHEN coalesce(prcp_mm < 2.0, false) THEN 0 ELSE 1 END)
             OVER (PARTITION BY geoid, state, year, forecast_date ORDER BY date) AS island
    FROM fx_season) GROUP BY ALL) GROUP BY ALL
"""
VIEWS["fx_weather"] = """
SELECT c.*, p.* EXCLUDE (geoid, state, year, forecast_date), r.dry_spell_max_days
FROM fx_cumulative c
JOIN fx_phase p USING (geoid, state, year, forecast_date)
JOIN fx_dry r USING (geoid, state, year, forecast_date)
"""
VIEWS["fx_drought"] = """
SELECT state, year, forecast_date, arg_max(d0, valid_end) AS d0_pct, arg_max(d1, valid_end) AS d1_pct,
       arg_max(d2, valid_end) AS d2_pct, arg_max(d3, valid_end) AS d3_pct, arg_max(d4, valid_end) AS d4_pct,
       arg_max(d2, valid_end) AS d2plus, max(valid_end) AS valid_end
FROM fx_weekly w JOIN fx_cutoffs c ON w.valid_end < c.cutoff
GROUP BY state, year, forecast_date
"""

# --- master panel ------------------------------------------------------------
VIEWS["fx_survey"] = """
SELECT geoid, state, year, yield_target, acres_planted_all, acres_harvested_all, acres_harvested_irr,
       least(greatest(coalesce(acres_harvested_irr / nullif(acres_harvested_all, 0), 0.0), 0.0), 1.0) AS irrigated_share,
       acres_harvested_all - coalesce(acres_harvested_irr, 0.0) AS acres_harvested_noirr_derived,
       CASE WHEN acres_harvested_all / nullif(acres_planted_all, 0) IS NOT NULL
            THEN least(greatest(acres_harvested_all / nullif(acres_planted_all, 0), 0.0), 1.0) END AS harvest_ratio
FROM fx_panel
"""
VIEWS["fx_master"] = """
SELECT s.*, f.forecast_date, f.date_rank, w.gdd_cum_f50_c86, w.edd_hours_gt86f, w.edd_hours_gt90f, w.prcp_cum_mm,
       w.vpd_kpa_veg, w.vpd_kpa_silk, w.vpd_kpa_grain, w.srad_total_veg, w.srad_total_silk, w.srad_total_grain,
       w.dry_spell_max_days, q.d0_pct, q.d1_pct, q.d2_pct, q.d3_pct, q.d4_pct, q.d2plus
FROM fx_survey s CROSS JOIN fx_dates f
LEFT JOIN fx_weather w ON s.geoid = w.geoid AND s.state = w.state AND s.year = w.year AND f.forecast_date = w.forecast_date
LEFT JOIN fx_drought q ON s.state = q.state AND s.year = q.year AND f.forecast_date = q.forecast_date
"""
ALWAYS = ["gdd_cum_f50_c86", "edd_hours_gt86f", "vpd_kpa_veg", "vpd_kpa_silk", "prcp_cum_mm",
          "dry_spell_max_days", "srad_total_veg", "srad_total_silk", "d2plus", "irrigated_share"]
GRAIN = ["vpd_kpa_grain", "srad_total_grain"]
_all = " AND ".join(f"{c} IS NOT NULL" for c in ALWAYS)
_grain = " AND ".join(f"{c} IS NOT NULL" for c in GRAIN)
VIEWS["fx_ready"] = f"""
SELECT *, ({_all} AND (forecast_date = '08-01' OR ({_grain}))) AS complete FROM fx_master
"""

# --- pools, trend, standardisation -------------------------------------------
VIEWS["fx_history"] = """
SELECT geoid, CAST(count(*) FILTER (ok AND year BETWEEN 1995 AND 1999) AS BIGINT) AS n_years FROM (
  SELECT geoid, year, bool_and(complete AND yield_target IS NOT NULL) AS ok FROM fx_ready GROUP BY geoid, year)
GROUP BY geoid
"""
VIEWS["fx_train"] = """
SELECT r.* FROM fx_ready r JOIN fx_history h ON r.geoid = h.geoid AND h.n_years >= 3
WHERE r.year BETWEEN 1995 AND 1999 AND r.complete AND r.yield_target IS NOT NULL
"""
VIEWS["fx_fit"] = """
SELECT geoid, state, regr_slope(y, CAST(year AS DOUBLE)) AS slope, regr_intercept(y, CAST(year AS DOUBLE)) AS intercept, count(*) AS n_years
FROM (SELECT geoid, state, year, min(yield_target) AS y FROM fx_train GROUP BY ALL) GROUP BY geoid, state HAVING count(*) >= 5
"""
VIEWS["fx_fallback"] = """
SELECT state, quantile_cont(slope, 0.5) AS slope, quantile_cont(intercept, 0.5) AS intercept FROM fx_fit GROUP BY state
"""
VIEWS["fx_params"] = """
SELECT t.geoid, t.state, coalesce(f.slope, b.slope) AS slope, coalesce(f.intercept, b.intercept) AS intercept, f.slope IS NOT NULL AS own_fit
FROM (SELECT DISTINCT geoid, state FROM fx_train) t LEFT JOIN fx_fit f ON t.geoid = f.geoid LEFT JOIN fx_fallback b ON t.state = b.state
"""
_pos = ", ".join(f"('{c}', {i})" for i, c in enumerate(ALWAYS + GRAIN))
VIEWS["fx_features"] = f"""
SELECT f.*, d.forecast_date FROM (VALUES {_pos}) AS f(feature, pos) CROSS JOIN fx_dates d
WHERE d.forecast_date <> '08-01' OR f.feature NOT IN ({", ".join(repr(g) for g in GRAIN)})
"""
_cols = ", ".join(ALWAYS + GRAIN)
_long = lambda src: f"""SELECT geoid, state, year, forecast_date, feature, v FROM (
  UNPIVOT (SELECT geoid, state, year, forecast_date, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ALWAYS + GRAIN)} FROM {src})
  ON {_cols} INTO NAME feature VALUE v)"""
VIEWS["fx_std"] = f"""
SELECT l.forecast_date, l.feature, avg(v) AS mean, stddev_pop(v) AS std
FROM ({_long('fx_train')}) l JOIN fx_features USING (forecast_date, feature) GROUP BY ALL
"""
VIEWS["fx_vec"] = f"""
SELECT l.geoid, l.state, l.year, l.forecast_date, list((v - s.mean) / s.std ORDER BY f.pos) AS vec
FROM ({_long('(SELECT * FROM fx_ready WHERE complete)')}) l
JOIN fx_features f USING (forecast_date, feature) JOIN fx_std s USING (forecast_date, feature) GROUP BY ALL
"""
VIEWS["fx_candidates"] = """
SELECT t.geoid, t.state, t.year, t.forecast_date, t.yield_target, t.yield_target - (p.slope * t.year + p.intercept) AS detrended, v.vec
FROM fx_train t JOIN fx_params p ON t.geoid = p.geoid JOIN fx_vec v ON t.geoid = v.geoid AND t.year = v.year AND t.forecast_date = v.forecast_date
"""
_KNN = """
SELECT * FROM (
  SELECT q.geoid AS q_geoid, q.state AS q_state, q.year AS q_year, q.forecast_date, c.geoid, c.state, c.year, c.yield_target, c.detrended,
         round(list_distance(q.vec, c.vec), 9) AS distance,
         row_number() OVER (PARTITION BY q.geoid, q.year, q.forecast_date
                            ORDER BY round(list_distance(q.vec, c.vec), 9), c.geoid, c.year) AS rank
  FROM fx_vec q JOIN fx_candidates c ON q.forecast_date = c.forecast_date AND q.year <> c.year {extra}) WHERE rank <= 5
"""
VIEWS["fx_knn_cross"] = _KNN.format(extra="")
VIEWS["fx_knn_same"] = _KNN.format(extra="AND q.geoid = c.geoid")

# --- cones and backtest ------------------------------------------------------
VIEWS["fx_weights"] = """
SELECT DISTINCT geoid, state, year, acres_planted_all AS acres, yield_target FROM fx_panel
"""
VIEWS["fx_truth"] = """
SELECT state, year, sum(yield_target * acres) / sum(acres) AS truth FROM fx_weights
WHERE yield_target IS NOT NULL AND acres > 0 GROUP BY state, year
"""
_LOOK = """
SELECT geoid, state, year, acres, CASE WHEN max(rn) FILTER (y2 IS NOT NULL) >= 3 THEN avg(y2) FILTER (rn <= {n}) END AS m FROM (
  SELECT a.geoid, a.state, a.year, a.acres, b.yield_target AS y2,
         row_number() OVER (PARTITION BY a.geoid, a.year ORDER BY b.year DESC) AS rn
  FROM fx_weights a LEFT JOIN fx_weights b ON a.geoid = b.geoid AND b.year < a.year AND b.yield_target IS NOT NULL {skip})
GROUP BY geoid, state, year, acres
"""
VIEWS["fx_look5"] = _LOOK.format(n=5, skip="AND b.year <> 2001")
VIEWS["fx_look5_all"] = _LOOK.format(n=5, skip="")
VIEWS["fx_look10_all"] = _LOOK.format(n=10, skip="")
VIEWS["fx_baseline"] = """
SELECT state, year, sum(m * acres) FILTER (m IS NOT NULL AND acres > 0) / sum(acres) FILTER (m IS NOT NULL AND acres > 0) AS baseline,
       count(*) FILTER (m IS NOT NULL AND acres > 0) AS n_baseline FROM fx_look5 GROUP BY state, year
"""
VIEWS["fx_cones"] = """
SELECT a.pool, a.k, a.q_geoid AS geoid, a.q_state AS state, a.q_year AS year, a.forecast_date, count(*) AS n_analogs,
       quantile_cont(detrended, 0.1) + any_value(p.slope * a.q_year + p.intercept) AS p10,
       quantile_cont(detrended, 0.5) + any_value(p.slope * a.q_year + p.intercept) AS p50,
       quantile_cont(detrended, 0.9) + any_value(p.slope * a.q_year + p.intercept) AS p90,
       quantile_cont(detrended, 0.5) + any_value(p.slope * a.q_year + p.intercept) AS point
FROM (SELECT n.*, k.k FROM (SELECT *, 'same_geoid' AS pool FROM fx_knn_same UNION ALL SELECT *, 'cross_county' FROM fx_knn_cross) n
      JOIN (VALUES (3), (5)) AS k(k) ON n.rank <= k.k) a
JOIN fx_params p ON a.q_geoid = p.geoid AND p.slope IS NOT NULL WHERE a.q_year IN (2000, 2001) GROUP BY ALL
"""
VIEWS["fx_state_cones"] = """
SELECT pool, k, c.state, c.year, forecast_date, sum(p10 * acres) / sum(acres) AS p10, sum(p50 * acres) / sum(acres) AS p50,
       sum(p90 * acres) / sum(acres) AS p90, sum(point * acres) / sum(acres) AS point, count(*) AS n_counties, sum(acres) AS total_acres
FROM fx_cones c JOIN fx_weights w ON c.geoid = w.geoid AND c.year = w.year WHERE acres > 0 GROUP BY pool, k, c.state, c.year, forecast_date
"""
VIEWS["fx_backtest"] = """
SELECT g.year AS holdout_year, g.state, g.forecast_date, g.pool, g.k,
       CAST(coalesce(s.n_counties, 0) AS BIGINT) AS n_counties_forecast, CAST(g.n_queries - coalesce(n.n_cones, 0) AS BIGINT) AS n_counties_skipped,
       t.truth, s.point, s.p10, s.p50, s.p90, s.p90 - s.p10 AS cone_width_80, coalesce(s.p10 <= t.truth AND t.truth <= s.p90, false) AS in_cone_80,
       s.point - t.truth AS point_error, b.baseline, b.baseline - t.truth AS baseline_error
FROM (SELECT year, state, forecast_date, pool, k, count(*) AS n_queries FROM fx_ready
      CROSS JOIN (VALUES ('same_geoid'), ('cross_county')) AS p(pool) CROSS JOIN (VALUES (3), (5)) AS k(k)
      WHERE year IN (2000, 2001) GROUP BY ALL) g
LEFT JOIN fx_state_cones s ON g.year = s.year AND g.state = s.state AND g.forecast_date = s.forecast_date AND g.pool = s.pool AND g.k = s.k
LEFT JOIN (SELECT pool, k, state, year, forecast_date, count(*) AS n_cones FROM fx_cones GROUP BY ALL) n
  ON g.year = n.year AND g.state = n.state AND g.forecast_date = n.forecast_date AND g.pool = n.pool AND g.k = n.k
LEFT JOIN fx_truth t ON g.state = t.state AND g.year = t.year
LEFT JOIN fx_baseline b ON g.state = b.state AND g.year = b.year
"""
VIEWS["fx_score"] = """
SELECT pool, k, forecast_date, count(*) AS n, sqrt(avg(point_error ** 2)) AS rmse_point, sqrt(avg(baseline_error ** 2)) AS rmse_baseline,
       sqrt(avg(baseline_error ** 2)) - sqrt(avg(point_error ** 2)) AS rmse_lift, avg(CASE WHEN in_cone_80 THEN 1.0 ELSE 0.0 END) AS coverage_80,
       avg(cone_width_80) AS mean_width
FROM fx_backtest WHERE point_error IS NOT NULL AND baseline_error IS NOT NULL GROUP BY ALL
"""
VIEWS["fx_bias"] = """
SELECT pool, k, state, forecast_date, avg(point_error) AS bias, count(*) AS n FROM fx_backtest
WHERE holdout_year = 2000 AND point_error IS NOT NULL GROUP BY ALL
"""
VIEWS["fx_recal"] = """
SELECT b.holdout_year, b.pool, b.k, b.state, b.forecast_date, b.truth, b.baseline_error, b.point_error, b.cone_width_80,
       point - coalesce(bias, 0) AS point_recal, p50 - coalesce(bias, 0) AS p50_recal, p90 - p10 AS cone_width_80_recal, p10 - coalesce(bias, 0) AS p10_recal, p90 - coalesce(bias, 0) AS p90_recal,
       point - coalesce(bias, 0) - truth AS point_error_recal,
       (p10 - coalesce(bias, 0) <= truth AND truth <= p90 - coalesce(bias, 0)) AS in_cone_80_recal
FROM fx_backtest b LEFT JOIN fx_bias c USING (pool, k, state, forecast_date) WHERE b.holdout_year = 2001
"""
VIEWS["fx_score_recal"] = """
SELECT pool, k, forecast_date, count(*) AS n, sqrt(avg(point_error_recal ** 2)) AS rmse_point, sqrt(avg(baseline_error ** 2)) AS rmse_baseline,
       sqrt(avg(baseline_error ** 2)) - sqrt(avg(point_error_recal ** 2)) AS rmse_lift,
       avg(CASE WHEN in_cone_80_recal THEN 1.0 ELSE 0.0 END) AS coverage_80, avg(cone_width_80) AS mean_width
FROM fx_recal WHERE point_error_recal IS NOT NULL AND baseline_error IS NOT NULL GROUP BY ALL
"""

# --- state grain -------------------------------------------------------------
CLIMATE = ["gdd_cum_f50_c86", "edd_hours_gt86f", "edd_hours_gt90f", "vpd_kpa_veg", "vpd_kpa_silk", "vpd_kpa_grain",
           "prcp_cum_mm", "dry_spell_max_days", "srad_total_veg", "srad_total_silk", "srad_total_grain",
           "d0_pct", "d1_pct", "d2_pct", "d3_pct", "d4_pct", "d2plus"]
_wm = ", ".join(f"sum({c} * w) / nullif(sum(w) FILTER ({c} IS NOT NULL), 0) AS {c}" for c in ["yield_target", *CLIMATE])
VIEWS["fx_state"] = f"""
SELECT state, year, forecast_date, {_wm} FROM (
  SELECT *, coalesce(acres_planted_all, acres_harvested_all, 0.0) AS w FROM fx_master) WHERE w > 0 GROUP BY state, year, forecast_date
"""
_st = ", ".join(f"avg({c}) FILTER (year BETWEEN 1995 AND 1999) AS m_{c}, stddev_pop({c}) FILTER (year BETWEEN 1995 AND 1999) AS s_{c}" for c in CLIMATE)
_zs = ", ".join(f"coalesce(({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END, 0.0)" for c in CLIMATE)
VIEWS["fx_state_vec"] = f"""
SELECT state, year, forecast_date, yield_target, [{_zs}] AS vec FROM fx_state CROSS JOIN (SELECT {_st} FROM fx_state) s
"""
_PAST = """
SELECT * FROM (
  SELECT q.state AS q_state, q.year AS q_year, q.forecast_date, c.state, c.year, c.yield_target, {dist} AS distance,
         row_number() OVER (PARTITION BY q.state, q.year, q.forecast_date ORDER BY {dist}, c.state, c.year) AS rank
  FROM fx_state_vec q JOIN fx_state_vec c ON q.forecast_date = c.forecast_date AND c.year < q.year) WHERE rank <= 10
"""
VIEWS["fx_past"] = _PAST.format(dist="round(list_distance(q.vec, c.vec), 9)")
VIEWS["fx_past_cosine"] = _PAST.format(dist="""round(1.0 - list_dot_product(q.vec, c.vec) / CASE WHEN sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(c.vec, c.vec)) = 0
  THEN 1.0 ELSE sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(c.vec, c.vec)) END, 9)""")
VIEWS["fx_slices"] = """
SELECT q.state, q.year, q.forecast_date, q.yield_target AS actual, c.n_analogs, c.p10, c.p50, c.p90,
       CASE WHEN c.p10 IS NOT NULL THEN CASE WHEN c.p10 <= q.yield_target AND q.yield_target <= c.p90 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS in_80_cone,
       q.yield_target - c.p50 AS error, c.p90 - c.p10 AS width
FROM fx_state q LEFT JOIN (
  SELECT q_state, q_year, forecast_date, count(yield_target) AS n_analogs, quantile_cont(yield_target, 0.1) AS p10,
         quantile_cont(yield_target, 0.5) AS p50, quantile_cont(yield_target, 0.9) AS p90 FROM fx_past GROUP BY ALL) c
  ON q.state = c.q_state AND q.year = c.q_year AND q.forecast_date = c.forecast_date
WHERE q.year IN (2000, 2001) AND q.yield_target IS NOT NULL
"""
