"""Queries: analogs, cones, backtest, scores, recalibration and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope.operators import cone, scoring, trend
from acrescope.plans import fixtures as fxm
from acrescope.plans.catalog import query
from acrescope.plans.forecasting import Forecasting
from acrescope.plans.rounding import fix, fix_sql, rounded, rsql

_Q = ["q_geoid", "q_year", "forecast_date", "geoid", "year", "distance", "rank"]
_QSQL = "q_geoid, q_year, forecast_date, geoid, year, distance, CAST(rank AS INTEGER) AS rank"


@query("knn_join", f"SELECT {_QSQL} FROM fx_knn_cross")
def _(fx):
    f = Forecasting.of(fx)
    return f.cross_entity(f.vectors).select(*_Q)


@query("knn_join_same_entity", f"SELECT {_QSQL} FROM fx_knn_same")
def _(fx):
    f = Forecasting.of(fx)
    return f.same_entity(f.vectors).select(*_Q)


@query("knn_join_past", "SELECT q_state, q_year, forecast_date, state, year, distance, CAST(rank AS INTEGER) AS rank FROM fx_past")
def _(fx):
    return Forecasting.of(fx).past_analogs().select("q_state", "q_year", "forecast_date", "state", "year", "distance", "rank")


@query("knn_join_past_cosine", "SELECT q_state, q_year, forecast_date, state, year, distance, CAST(rank AS INTEGER) AS rank FROM fx_past_cosine")
def _(fx):
    return Forecasting.of(fx).past_analogs("cosine").select("q_state", "q_year", "forecast_date", "state", "year", "distance", "rank")


@query("analog_index_contract", f"""SELECT forecast_date, count(*) AS n_candidates, count(*) FILTER (detrended IS NULL) AS n_null_residuals,
  {fix_sql('avg(detrended)')} AS mean_residual FROM fx_candidates GROUP BY forecast_date""")
def _(fx):
    return Forecasting.of(fx).candidates.groupBy("forecast_date").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("detrended_yield_target").isNull()).alias("n_null_residuals"),
        fix(F.avg("detrended_yield_target")).alias("mean_residual"))


_P = ["p10", "p50", "p90", "point"]


@query("percentile_cone", f"SELECT pool, k, geoid, state, year, forecast_date, n_analogs, {rsql(_P)} FROM fx_cones")
def _(fx):
    return rounded(Forecasting.of(fx).cones.select("pool", "k", "geoid", "state", "year", "forecast_date", "n_analogs", *_P), _P)


@query("cone_rollup", f"SELECT pool, k, state, year, forecast_date, n_counties, {rsql(_P + ['total_acres'])} FROM fx_state_cones")
def _(fx):
    return rounded(Forecasting.of(fx).state_cones, _P + ["total_acres"])


@query("county_forecast", f"""SELECT geoid, year, forecast_date, {rsql(_P)} FROM fx_cones WHERE pool = 'same_geoid' AND k = 5""")
def _(fx):
    rows = Forecasting.of(fx).cones.where((F.col("pool") == "same_geoid") & (F.col("k") == 5))
    return rounded(rows.select("geoid", "year", "forecast_date", *_P), _P)


@query("state_forecast", f"""SELECT state, year, forecast_date, {rsql(_P)} FROM fx_state_cones WHERE pool = 'same_geoid' AND k = 5""")
def _(fx):
    rows = Forecasting.of(fx).state_cones.where((F.col("pool") == "same_geoid") & (F.col("k") == 5))
    return rounded(rows.select("state", "year", "forecast_date", *_P), _P)


_B = ["truth", "point", "p10", "p50", "p90", "cone_width_80", "point_error", "baseline", "baseline_error"]


@query("backtest_sweep", f"""SELECT holdout_year, state, forecast_date, pool, k, n_counties_forecast, n_counties_skipped, in_cone_80, {rsql(_B)} FROM fx_backtest""")
def _(fx):
    return rounded(Forecasting.of(fx).backtest, _B)


_S = ["rmse_point", "rmse_baseline", "rmse_lift", "coverage_80", "mean_width"]


@query("score_summary", f"SELECT pool, k, forecast_date, n, {rsql(_S)} FROM fx_score")
def _(fx):
    return rounded(scoring.score_summary(Forecasting.of(fx).backtest, ["pool", "k", "forecast_date"]), _S)


@query("score_summary_state", f"""SELECT pool, k, state, count(*) AS n, {fix_sql('sqrt(avg(point_error ** 2))')} AS rmse_point,
  {fix_sql('sqrt(avg(baseline_error ** 2))')} AS rmse_baseline, {fix_sql('sqrt(avg(baseline_error ** 2)) - sqrt(avg(point_error ** 2))')} AS rmse_lift,
  {fix_sql('avg(CASE WHEN in_cone_80 THEN 1.0 ELSE 0.0 END)')} AS coverage_80, {fix_sql('avg(cone_width_80)')} AS mean_width
  FROM fx_backtest WHERE point_error IS NOT NULL AND baseline_error IS NOT NULL GROUP BY pool, k, state""")
def _(fx):
    return rounded(scoring.score_summary(Forecasting.of(fx).backtest, ["pool", "k", "state"]), _S)


@query("bias_constants", f"SELECT pool, k, state, forecast_date, n, {fix_sql('bias')} AS bias FROM fx_bias")
def _(fx):
    return rounded(Forecasting.of(fx).bias, ["bias"])


_R = ["point_recal", "p10_recal", "p50_recal", "p90_recal", "cone_width_80_recal", "point_error_recal"]


@query("recalibrate", f"SELECT holdout_year, pool, k, state, forecast_date, in_cone_80_recal, {rsql(_R)} FROM fx_recal")
def _(fx):
    return rounded(Forecasting.of(fx).recalibrated.select("holdout_year", "pool", "k", "state", "forecast_date", "in_cone_80_recal", *_R), _R)


@query("score_summary_recal", f"SELECT pool, k, forecast_date, n, {rsql(_S)} FROM fx_score_recal")
def _(fx):
    out = scoring.score_summary(Forecasting.of(fx).recalibrated, ["pool", "k", "forecast_date"], "point_error_recal", "in_cone_80_recal")
    return rounded(out, _S)


_GATE = """SELECT 'same_geoid' AS pool, coalesce(bool_and(ok), false) AS coverage_in_band, coalesce(bool_and(beats), false) AS beats_baseline FROM (
  SELECT forecast_date, bool_and(coverage_80 BETWEEN 0.7 AND 0.9) AS ok, bool_or(rmse_point < rmse_baseline) AS beats FROM {} WHERE pool = 'same_geoid' GROUP BY forecast_date)"""


@query("gates", _GATE.format("fx_score"))
def _(fx):
    return scoring.gates(scoring.score_summary(Forecasting.of(fx).backtest, ["pool", "k", "forecast_date"]))


@query("gates_recal", _GATE.format("fx_score_recal"))
def _(fx):
    rows = scoring.score_summary(Forecasting.of(fx).recalibrated, ["pool", "k", "forecast_date"], "point_error_recal", "in_cone_80_recal")
    return scoring.gates(rows)


@query("error_decomposition", f"""SELECT state, n, {rsql(['bias', 'std', 'rmse', 'coverage', 'bias_share'])}, CASE WHEN bias > 0 THEN 'over' ELSE 'under' END AS direction,
  CASE WHEN bias_share > 0.5 THEN 'bias' ELSE 'variance' END AS kind FROM (
  SELECT *, bias * bias / greatest(rmse * rmse, 1e-9) AS bias_share FROM (
  SELECT state, count(*) AS n, avg(point_error) AS bias, stddev_pop(point_error) AS std, sqrt(avg(point_error ** 2)) AS rmse,
    avg(CASE WHEN in_cone_80 THEN 1.0 ELSE 0.0 END) AS coverage FROM fx_backtest WHERE pool = 'same_geoid' AND k = 5 AND point_error IS NOT NULL GROUP BY state))""")
def _(fx):
    rows = Forecasting.of(fx).backtest.where((F.col("pool") == "same_geoid") & (F.col("k") == 5))
    return rounded(scoring.error_decomposition(rows), ["bias", "std", "rmse", "coverage", "bias_share"])


@query("score_slices", f"""SELECT CASE grouping(year, forecast_date, state) WHEN 7 THEN 'overall' WHEN 3 THEN 'year' WHEN 5 THEN 'date' WHEN 6 THEN 'state' ELSE 'state_date' END AS slice,
  year, forecast_date, state, count(*) AS n, {fix_sql('avg(in_80_cone)')} AS coverage_80, {fix_sql('sqrt(avg(error ** 2))')} AS rmse_p50,
  {fix_sql('avg(abs(error))')} AS mae_p50, {fix_sql('avg(width)')} AS width_mean, {fix_sql('quantile_cont(width, 0.5)')} AS width_median
  FROM fx_slices GROUP BY GROUPING SETS ((), (year), (forecast_date), (state), (state, forecast_date))""")
def _(fx):
    return rounded(scoring.score_slices(Forecasting.of(fx).slice_rows), ["coverage_80", "rmse_p50", "mae_p50", "width_mean", "width_median"])


@query("raw_cone", f"""SELECT state, year, forecast_date, n_analogs, in_80_cone, {rsql(['actual', 'p10', 'p50', 'p90', 'error', 'width'])} FROM fx_slices""")
def _(fx):
    return rounded(Forecasting.of(fx).slice_rows, ["actual", "p10", "p50", "p90", "error", "width"])


# the county regressor's place is taken by the entity trend in the checked queries;
# the boosted model itself is exercised by gbt_predict
_C = ["rmse_regressor", "bias_regressor", "rmse_analog_median", "bias_analog_median", "rmse_baseline", "lift_vs_analog", "coverage_80_truth", "mean_width"]
_CROWS = """SELECT b.*, r.trend_point - b.truth AS error_regressor, b.point_error AS error_analog FROM fx_backtest b
  LEFT JOIN (SELECT w.state, w.year, sum((p.slope * w.year + p.intercept) * acres) / sum(acres) AS trend_point
             FROM fx_weights w JOIN fx_params p ON w.geoid = p.geoid GROUP BY w.state, w.year) r ON b.state = r.state AND b.holdout_year = r.year
  WHERE b.pool = 'same_geoid' AND b.k = 5"""


def _csql(by):
    return f"""SELECT {by}, n, {rsql(_C)} FROM (SELECT {by}, count(*) AS n, sqrt(avg(error_regressor ** 2)) AS rmse_regressor, avg(error_regressor) AS bias_regressor,
      sqrt(avg(error_analog ** 2)) AS rmse_analog_median, avg(error_analog) AS bias_analog_median, sqrt(avg(baseline_error ** 2)) AS rmse_baseline,
      (sqrt(avg(error_analog ** 2)) - sqrt(avg(error_regressor ** 2))) / sqrt(avg(error_analog ** 2)) AS lift_vs_analog,
      avg(CASE WHEN in_cone_80 THEN 1.0 ELSE 0.0 END) AS coverage_80_truth, avg(cone_width_80) AS mean_width
      FROM ({_CROWS}) WHERE error_regressor IS NOT NULL AND error_analog IS NOT NULL AND baseline_error IS NOT NULL GROUP BY {by})"""


def phase_c_rows(fx):
    f = Forecasting.of(fx)
    lines = f.panel.join(f.params.select("geoid", "slope", "intercept"), "geoid")
    point = lines.groupBy("state", "year").agg(cone.weighted(trend.trend_at(), F.col("acres_planted_all")).alias("trend_point"))
    rows = f.backtest.where((F.col("pool") == "same_geoid") & (F.col("k") == 5))
    out = rows.join(point.withColumnRenamed("year", "holdout_year"), ["state", "holdout_year"], "left")
    return out.withColumn("error_regressor", F.col("trend_point") - F.col("truth")).withColumnRenamed("point_error", "error_analog")


@query("score_summary_c", _csql("holdout_year, forecast_date"))
def _(fx):
    return rounded(scoring.score_summary_c(phase_c_rows(fx), ["holdout_year", "forecast_date"]), _C)


@query("score_summary_c_state", _csql("holdout_year, state"))
def _(fx):
    return rounded(scoring.score_summary_c(phase_c_rows(fx), ["holdout_year", "state"]), _C)


@query("lift_gate", f"""SELECT holdout_year AS year, {rsql(['rmse_regressor', 'rmse_analog_median', 'lift_vs_analog'])}, coalesce(lift_vs_analog >= 0.15, false) AS passed
  FROM ({_csql('holdout_year, forecast_date')}) WHERE forecast_date = 'EOS'""")
def _(fx):
    summary = scoring.score_summary_c(phase_c_rows(fx), ["holdout_year", "forecast_date"]).withColumnRenamed("holdout_year", "year")
    return rounded(scoring.lift_gate(summary, 0.15), ["rmse_regressor", "rmse_analog_median", "lift_vs_analog"])


@query("lift_gate_dates", f"""SELECT 2000 AS year, forecast_date, {rsql(['lift_vs_analog'])}, coalesce(max(lift_vs_analog) FILTER (forecast_date = 'EOS') OVER () >= 0.15, false) AS passed
  FROM ({_csql('holdout_year, forecast_date')}) WHERE holdout_year = 2000""")
def _(fx):
    summary = scoring.score_summary_c(phase_c_rows(fx), ["holdout_year", "forecast_date"]).withColumnRenamed("holdout_year", "year")
    return rounded(scoring.yearly_lift_gate(summary, fxm.VAL_YEAR, 0.15), ["lift_vs_analog"])


@query("coverage_verdict", """SELECT pool, k, forecast_date, CASE WHEN coverage_80 > 0.9 THEN 'too wide' WHEN coverage_80 < 0.7 THEN 'too narrow' ELSE 'in band' END AS verdict FROM fx_score""")
def _(fx):
    out = scoring.score_summary(Forecasting.of(fx).backtest, ["pool", "k", "forecast_date"])
    return out.select("pool", "k", "forecast_date", scoring.coverage_verdict(F.col("coverage_80")).alias("verdict"))


@query("pivots", f"""SELECT state, {', '.join(f"{fix_sql(f'''max(point_error) FILTER (lbl = '{y}_{d}')''')} AS e_{y}_{d[:2]}" for y in (2000, 2001) for d in fxm.CONTRACT)}
  FROM (SELECT *, holdout_year || '_' || forecast_date AS lbl FROM fx_backtest WHERE pool = 'same_geoid' AND k = 5) GROUP BY state""")
def _(fx):
    rows = Forecasting.of(fx).backtest.where((F.col("pool") == "same_geoid") & (F.col("k") == 5))
    rows = rows.withColumn("label", F.concat_ws("_", F.col("holdout_year").cast("string"), "forecast_date"))
    labels = [f"{y}_{d}" for y in (fxm.VAL_YEAR, fxm.HOLDOUT_YEAR) for d in fxm.CONTRACT]
    out = scoring.pivot_count(rows, ["state"], "label", labels, F.max("point_error"))
    return out.select("state", *[fix(F.col(f"`{x}`")).alias("e_" + x[:5] + x[5:7]) for x in labels])


@query("cf_detrend", f"""SELECT q_geoid AS geoid, q_year AS year, forecast_date, {fix_sql('quantile_cont(a.yield_target, 0.5)')} AS cf_raw,
  {fix_sql('quantile_cont(a.detrended, 0.5) + any_value(p.slope * a.q_year + p.intercept)')} AS cf_trend,
  {fix_sql('quantile_cont(a.yield_target - (r.slope * a.year + r.intercept), 0.5) + any_value(r.slope * a.q_year + r.intercept)')} AS cf_recent,
  {fix_sql('quantile_cont(a.detrended + p.slope * least(a.q_year, a.year + 5) + p.intercept, 0.5)')} AS cf_clipped
  FROM fx_knn_same a JOIN fx_params p ON a.q_geoid = p.geoid
  LEFT JOIN (SELECT geoid, regr_slope(y, CAST(year AS DOUBLE)) AS slope, regr_intercept(y, CAST(year AS DOUBLE)) AS intercept FROM (
     SELECT geoid, year, min(yield_target) AS y FROM fx_train WHERE year BETWEEN 1997 AND 1999 GROUP BY ALL) GROUP BY geoid HAVING count(*) >= 3) r ON a.q_geoid = r.geoid
  WHERE q_year IN (2000, 2001) GROUP BY ALL""")
def _(fx):
    from acrescope.operators.analog import counterfactual_points
    f = Forecasting.of(fx)
    near = f.same_entity(f.holdout_queries)
    recent = trend.ols_trend(f.train.where(F.col("year").between(1997, 1999)), "geoid", "state", min_years=3)
    out = counterfactual_points(near, f.params, recent, horizon=5).withColumnsRenamed({"q_geoid": "geoid", "q_year": "year"})
    return rounded(out, ["cf_raw", "cf_trend", "cf_recent", "cf_clipped"])


@query("trend_residuals", f"""SELECT t.state, t.year, {fix_sql('t.truth')} AS truth, {fix_sql('b.slope * t.year + b.intercept')} AS trend_pred,
  {fix_sql('t.truth - (b.slope * t.year + b.intercept)')} AS residual FROM fx_truth t JOIN fx_fallback b ON t.state = b.state""")
def _(fx):
    f = Forecasting.of(fx)
    fall = trend.trend_fallback(f.fits, "state").withColumnsRenamed({"state_slope": "slope", "state_intercept": "intercept"})
    out = f.truth.join(fall, "state").withColumn("trend_pred", trend.trend_at())
    return rounded(out.select("state", "year", "truth", "trend_pred", (F.col("truth") - F.col("trend_pred")).alias("residual")), ["truth", "trend_pred", "residual"])
