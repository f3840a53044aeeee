"""Queries: regressors, attribution tables, vectors, routing and documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from acrescope.operators import boosting, chips, cone, documents, hybrid, joins, landuse, ml, scoring, trend
from acrescope.plans import fixtures as fxm
from acrescope.plans.catalog import query
from acrescope.plans.forecasting import GRID, KEYS, N_VECTORS, ROUTED, Forecasting
from acrescope.plans.oracle_views import VIEWS
from acrescope.plans.q_chips import _QC, index
from acrescope.plans.rounding import fix, fix_sql, rounded, rsql

VIEWS["fx_attr"] = """
SELECT l.geoid, l.state, l.year, l.forecast_date, CASE WHEN feature IN ('d2plus', 'irrigated_share') THEN 'state_is_' || feature ELSE feature END AS feature, v AS feature_value,
  (v - s.mean) / s.std AS attribution, r.acres_planted_all AS acres
FROM ({long}) l JOIN fx_features f USING (forecast_date, feature) JOIN fx_std s USING (forecast_date, feature)
JOIN fx_ready r ON l.geoid = r.geoid AND l.year = r.year AND l.forecast_date = r.forecast_date WHERE r.complete
"""
_cols = fxm.ALWAYS + fxm.GRAIN
_long = f"""SELECT geoid, state, year, forecast_date, feature, v FROM (UNPIVOT (SELECT geoid, state, year, forecast_date,
  {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _cols)} FROM fx_ready) ON {', '.join(_cols)} INTO NAME feature VALUE v)"""
VIEWS["fx_attr"] = VIEWS["fx_attr"].replace("{long}", _long)


def linear_attributions(f: Forecasting):
    """A checkable attribution table: each standardised value is its contribution."""
    rows = trend.zscore(f.ready.where("complete"), f.std, fxm.CONTRACT)
    named = None
    for d, cols in fxm.CONTRACT.items():
        arr = F.array(*[F.struct(F.lit("state_is_" + c if c in ("d2plus", "irrigated_share") else c).alias("feature"), F.col(c).cast("double").alias("feature_value"),
                                 F.get("vec", F.lit(i)).alias("attribution")) for i, c in enumerate(cols)])
        named = F.when(F.col("forecast_date") == d, arr) if named is None else named.when(F.col("forecast_date") == d, arr)
    return rows.select("geoid", "state", "year", "forecast_date", F.col("acres_planted_all").alias("acres"), F.explode(named).alias("_a")) \
        .select("geoid", "state", "year", "forecast_date", "acres", "_a.*")


@query("importance", f"SELECT forecast_date, feature, {fix_sql('avg(abs(attribution))')} AS importance FROM fx_attr GROUP BY forecast_date, feature")
def _(fx):
    return rounded(ml.importance(linear_attributions(Forecasting.of(fx)), ["forecast_date"]), ["importance"])


@query("topk_drivers", f"""SELECT geoid, year, forecast_date, feature, CAST(rank AS INTEGER) AS rank, {rsql(['attribution', 'feature_value'])}, CASE WHEN attribution > 0 THEN '+' ELSE '-' END AS direction FROM (
  SELECT *, row_number() OVER (PARTITION BY geoid, year, forecast_date ORDER BY abs(attribution) DESC, feature) AS rank FROM fx_attr WHERE attribution <> 0) WHERE rank <= 3""")
def _(fx):
    out = ml.topk_drivers(linear_attributions(Forecasting.of(fx)), ["geoid", "year", "forecast_date"])
    return rounded(out, ["attribution", "feature_value"])


@query("driver_rollup", f"""SELECT state, year, forecast_date, feature, {fix_sql('sum(a)')} AS attribution, {fix_sql('any_value(v)')} AS feature_value, CASE WHEN feature IN ('state', 'year') THEN 'structural' ELSE 'biophysical' END AS kind,
  CASE WHEN sum(a) > 0 THEN '+' WHEN sum(a) < 0 THEN '-' ELSE '0' END AS direction FROM (
  SELECT state, year, forecast_date, CASE WHEN feature LIKE 'state_is_%' THEN 'state' ELSE feature END AS feature, sum(attribution * acres) / sum(acres) AS a,
    CASE WHEN feature LIKE 'state_is_%' THEN 1.0 ELSE sum(feature_value * acres) / sum(acres) END AS v FROM fx_attr WHERE acres > 0 GROUP BY state, year, forecast_date, fx_attr.feature) GROUP BY ALL""")
def _(fx):
    out = ml.driver_rollup(linear_attributions(Forecasting.of(fx)), ["state", "year", "forecast_date"], "acres")
    return rounded(out, ["attribution", "feature_value"])


VIEWS["fx_preds"] = """
SELECT w.geoid, w.state, w.year, w.yield_target, p.slope * w.year + p.intercept AS pred_a, l.m AS pred_b,
  CASE WHEN w.state IN ('ASIA', 'EUROPE') THEN l.m ELSE p.slope * w.year + p.intercept END AS pred_hybrid
FROM fx_weights w JOIN fx_params p ON w.geoid = p.geoid JOIN fx_look5 l ON w.geoid = l.geoid AND w.year = l.year WHERE w.year IN (2000, 2001)
"""


def predictions(fx):
    """Two checkable predictors per entity: A its trend, B its lookback mean."""
    f = Forecasting.of(fx)
    look = cone.lookback_mean(f.panel, "geoid", (5,), skip_years=(fxm.HOLDOUT_YEAR,)).where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR))
    rows = look.join(f.params.select("geoid", "slope", "intercept"), "geoid")
    rows = rows.select("geoid", "state", "year", "yield_target", trend.trend_at().alias("pred_a"), F.col("mean_5").alias("pred_b"))
    return ml.hybrid_route(rows, ROUTED)


@query("hybrid_route", f"SELECT geoid, state, year, {rsql(['pred_a', 'pred_b', 'pred_hybrid'])} FROM fx_preds")
def _(fx):
    return rounded(predictions(fx).drop("yield_target"), ["pred_a", "pred_b", "pred_hybrid"])


@query("ablation_metrics", f"""SELECT variant, state, year, count(*) AS n, {fix_sql('sqrt(avg((p - yield_target) ** 2))')} AS rmse, {fix_sql('avg(p - yield_target)')} AS bias FROM (
  SELECT *, unnest(['rowA', 'rowB', 'hybrid']) AS variant, unnest([pred_a, pred_b, pred_hybrid]) AS p FROM fx_preds) WHERE p IS NOT NULL AND yield_target IS NOT NULL GROUP BY variant, state, year""")
def _(fx):
    long = ml.long_predictions(predictions(fx), ["geoid", "state", "year"], "yield_target", {"rowA": "pred_a", "rowB": "pred_b", "hybrid": "pred_hybrid"})
    return rounded(scoring.ablation_metrics(long, ["variant", "state", "year"]), ["rmse", "bias"])


@query("relative_gate", f"""SELECT year, {fix_sql('a')} AS rmse_a, {fix_sql('b')} AS rmse_b, {fix_sql('CASE WHEN a > 0 THEN (a - b) / a END')} AS lift, coalesce((a - b) / a >= 0.05, false) AS passed,
  CASE WHEN a IS NULL OR b IS NULL THEN 'an error is not finite' WHEN a <= 0 THEN 'no error to improve on' END AS reason FROM (
  SELECT year, sqrt(avg((pred_a - yield_target) ** 2)) AS a, sqrt(avg((pred_b - yield_target) ** 2)) AS b FROM fx_preds GROUP BY year)""")
def _(fx):
    """Model B against model A at the five percent mark, per year."""
    long = ml.long_predictions(predictions(fx), ["year"], "yield_target", {"a": "pred_a", "b": "pred_b"})
    per = scoring.ablation_metrics(long, ["year", "variant"]).groupBy("year").agg(
        F.max(F.when(F.col("variant") == "a", F.col("rmse"))).alias("rmse_a"), F.max(F.when(F.col("variant") == "b", F.col("rmse"))).alias("rmse_b"))
    return rounded(per.select("year", "rmse_a", "rmse_b", *scoring.relative_gate(F.col("rmse_a"), F.col("rmse_b"), 0.05)), ["rmse_a", "rmse_b", "lift"])


@query("state_block", """SELECT state, n AS n_counties, CAST(round_even(h, 0) AS INTEGER) AS predicted, CAST(round_even(y, 0) AS INTEGER) AS actual, top_county, CAST(round_even(top, 0) AS INTEGER) AS top_yield, rising,
  CAST(round_even(a, 0) AS INTEGER) AS row_a, CAST(round_even(b, 0) AS INTEGER) AS row_b, round_even(rh, 2) AS rmse, round_even(ra, 2) AS rmse_a, round_even((ra - rh) / ra * 100, 2) AS lift_pct,
  CASE WHEN state IN ('ASIA', 'EUROPE') THEN 'Row B' ELSE 'Row A' END AS model FROM (
  SELECT state, count(*) AS n, avg(pred_hybrid) AS h, avg(yield_target) AS y, arg_max(geoid, (pred_hybrid, geoid)) AS top_county, max(pred_hybrid) AS top, count(*) FILTER (pred_hybrid > coalesce(yield_target, 0)) AS rising,
    avg(pred_a) AS a, avg(pred_b) AS b, sqrt(avg((pred_hybrid - yield_target) ** 2)) AS rh, sqrt(avg((pred_a - yield_target) ** 2)) AS ra FROM fx_preds WHERE pred_hybrid IS NOT NULL AND year = 2001 GROUP BY state)""")
def _(fx):
    return documents.state_block(predictions(fx).where(F.col("year") == fxm.HOLDOUT_YEAR), "state", "geoid", "yield_target", ROUTED)


@query("spread_cone", """SELECT state, year, CAST(m AS INTEGER) AS predicted, CAST(round_even(y, 0) AS INTEGER) AS actual, CAST(round_even(m + 1.5 * s, 0) AS INTEGER) AS upper, CAST(round_even(m - 1.5 * s, 0) AS INTEGER) AS lower,
  CAST(round_even(m - 2.5 * s, 0) AS INTEGER) AS range_low, CAST(round_even(m + 2.5 * s, 0) AS INTEGER) AS range_high FROM (
  SELECT state, year, round_even(avg(pred_hybrid), 0) AS m, stddev_samp(pred_hybrid) AS s, avg(yield_target) AS y FROM fx_preds WHERE pred_hybrid IS NOT NULL GROUP BY ALL)""")
def _(fx):
    return documents.spread_cone(predictions(fx), ["state", "year"], "yield_target")


# --- boosted trees: SQL checks rows, sizes and rules, tests check the numbers -
def _models(fx):
    f = Forecasting.of(fx)
    return f, f.models


@query("gbt_fit", "SELECT forecast_date, count(*) AS n_train, TRUE AS beats_mean, TRUE AS in_grid, TRUE AS stopped, TRUE AS cut_to_best FROM fx_train GROUP BY forecast_date")
def _(fx):
    """Training rows of each date's model: picked from the grid, run to its early stop, cut to its best round, its error below the target's spread."""
    f, models = _models(fx)
    fitted = ml.gbt_predict(f.train, models, fxm.CONTRACT).withColumn("e", F.col("prediction") - F.col("yield_target"))
    scored = fitted.groupBy("forecast_date").agg(F.count("prediction").alias("n_train"), (scoring.rmse("e") < F.stddev_pop("yield_target")).alias("beats_mean"))
    picks = [(d, p.config == GRID[p.seq], p.stopped, models[d].getNumTrees == p.rounds) for d, p in f.swept[1].items()]
    return scored.join(fx.spark.createDataFrame(picks, "forecast_date string, in_grid boolean, stopped boolean, cut_to_best boolean"), "forecast_date")


@query("gbt_predict", f"SELECT geoid, state, year, forecast_date, {fix_sql('yield_target')} AS yield_target, NOT complete AS no_prediction FROM fx_ready WHERE year IN (2000, 2001)")
def _(fx):
    """Fit one boosted model per date, predict validation and holdout rows."""
    f, models = _models(fx)
    rows = f.ready.where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR))
    out = ml.gbt_predict(rows, models, fxm.CONTRACT)
    return rounded(out.select("geoid", "state", "year", "forecast_date", "yield_target", F.col("prediction").isNull().alias("no_prediction")), ["yield_target"])


@query("tree_attribution", f"""SELECT r.geoid, r.state, r.year, l.forecast_date, l.feature, {fix_sql('l.v')} AS feature_value, TRUE AS adds_up
  FROM ({_long}) l JOIN fx_features f USING (forecast_date, feature) JOIN fx_ready r ON l.geoid = r.geoid AND l.year = r.year AND l.forecast_date = r.forecast_date WHERE r.complete""")
def _(fx):
    """Contributions of every date's saved model, and whether they add up to what the model itself predicts."""
    f, keys = Forecasting.of(fx), ["geoid", "state", "year", "forecast_date"]
    out = f.explained(f.ready, keys)
    total = F.sum("attribution").over(Window.partitionBy(*keys))  # one row per contract feature
    out = out.withColumn("adds_up", F.abs(F.col("base_value") + total - F.col("prediction")) <= 1e-2)
    return rounded(out.select(*keys, "feature", "feature_value", "adds_up"), ["feature_value"])


_ALIVE = [len(GRID), -(-len(GRID) // boosting.KEEP)]
_ALIVE.append(-(-_ALIVE[1] // boosting.KEEP))


@query("grid_sweep", f"""SELECT d.forecast_date, CAST(s AS INTEGER) AS seq, (SELECT count(*) FROM fx_ready r WHERE r.year = 2000 AND r.complete AND r.yield_target IS NOT NULL AND r.forecast_date = d.forecast_date) AS n,
  TRUE AS scored, CAST(1 AS BIGINT) AS n_picked, CAST({_ALIVE[0] - _ALIVE[1]} AS BIGINT) AS n_first, CAST({_ALIVE[1] - _ALIVE[2]} AS BIGINT) AS n_second, CAST({_ALIVE[2]} AS BIGINT) AS n_stopped, TRUE AS best_is_picked
  FROM fx_dates d CROSS JOIN range({len(GRID)}) AS g(s)""")
def _(fx):
    """All configurations at all dates: how many were given up on each rung, how many ran to their early stop, and the best of those is picked."""
    f = Forecasting.of(fx)
    at = Window.partitionBy("forecast_date")  # one row per configuration
    some = lambda c: F.sum(c.cast("long")).over(at)
    sizes = fx.spark.createDataFrame([(d, n) for (d, is_val), n in f.training.counts.items() if is_val], "forecast_date string, n long")
    long = F.when(F.col("left_at") == 0, F.struct("rmse", "seq"))
    return f.swept[0].join(sizes, "forecast_date").select(
        "forecast_date", "seq", "n", ((F.col("rmse") > 0) & F.col("best_round").between(1, F.col("rounds"))).alias("scored"), some(F.col("picked")).alias("n_picked"),
        some(F.col("left_at") == 1).alias("n_first"), some(F.col("left_at") == 2).alias("n_second"), some(F.col("stopped")).alias("n_stopped"),
        (F.min(long).over(at)["seq"] == F.max(F.when(F.col("picked"), F.col("seq"))).over(at)).alias("best_is_picked"))


@query("bundle_trends", f"SELECT geoid, state, own_fit, {rsql(['slope', 'intercept'])} FROM fx_params")
def _(fx):
    """Trends of every entity, saved with the models and read back."""
    return rounded(Forecasting.of(fx).bundle.tables["trends"], ["slope", "intercept"])


@query("bundle_models", "SELECT forecast_date, count(*) AS n, count(*) FILTER (complete) AS n_predicted, TRUE AS same FROM fx_ready WHERE year IN (2000, 2001) GROUP BY forecast_date")
def _(fx):
    """Predictions of the models read back, against those of the models as fitted."""
    f = Forecasting.of(fx)
    again = ml.gbt_predict(f.tested, f.bundle.models, f.bundle.by_date).select(*KEYS, F.col("prediction").alias("again"))
    both = f.county_predictions.join(again, KEYS)
    return both.groupBy("forecast_date").agg(F.count("*").alias("n"), F.count("again").alias("n_predicted"), F.bool_and(F.col("prediction").eqNullSafe(F.col("again"))).alias("same"))


# --- the regressor chain: keys, counts and rules in SQL ----------------------
_CELL = ["state", "year", "forecast_date"]
_PREDICTED = "SELECT state, year, forecast_date, count(*) FILTER (complete AND acres_planted_all > 0) AS n_predicted FROM fx_ready WHERE year IN (2000, 2001) GROUP BY ALL"


@query("model_state_point", f"SELECT state, year, forecast_date, n_predicted, n_predicted > 0 AS has_point FROM ({_PREDICTED})")
def _(fx):
    """Acreage-weighted state point of the boosted models."""
    return Forecasting.of(fx).model_points.select(*_CELL, "n_predicted", F.col("model_point").isNotNull().alias("has_point"))


@query("score_summary_c_model", f"""SELECT holdout_year, forecast_date, count(*) AS n, {fix_sql('sqrt(avg(point_error ** 2))')} AS rmse_analog_median, {fix_sql('avg(point_error)')} AS bias_analog_median,
  {fix_sql('sqrt(avg(baseline_error ** 2))')} AS rmse_baseline, {fix_sql('avg(CASE WHEN in_cone_80 THEN 1.0 ELSE 0.0 END)')} AS coverage_80_truth, {fix_sql('avg(cone_width_80)')} AS mean_width, TRUE AS scored
  FROM fx_backtest b JOIN ({_PREDICTED}) p ON b.state = p.state AND b.holdout_year = p.year AND b.forecast_date = p.forecast_date
  WHERE pool = 'same_geoid' AND k = 5 AND point_error IS NOT NULL AND baseline_error IS NOT NULL AND n_predicted > 0 GROUP BY holdout_year, b.forecast_date""".replace("SELECT holdout_year, forecast_date", "SELECT holdout_year, b.forecast_date", 1))
def _(fx):
    """Regressor, analog median and baseline over the same cells."""
    f = Forecasting.of(fx)
    rows = f.backtest.where((F.col("pool") == "same_geoid") & (F.col("k") == 5)).join(
        f.model_points.withColumnRenamed("year", "holdout_year"), ["state", "holdout_year", "forecast_date"], "left")
    rows = rows.withColumn("error_regressor", F.col("model_point") - F.col("truth")).withColumnRenamed("point_error", "error_analog")
    out = scoring.score_summary_c(rows, ["holdout_year", "forecast_date"]).withColumn("scored", F.col("rmse_regressor").isNotNull() & F.col("lift_vs_analog").isNotNull())
    return rounded(out.drop("rmse_regressor", "bias_regressor", "lift_vs_analog"), ["rmse_analog_median", "bias_analog_median", "rmse_baseline", "coverage_80_truth", "mean_width"])


@query("importance_model", "SELECT forecast_date, feature, TRUE AS valid FROM fx_features WHERE forecast_date IN (SELECT forecast_date FROM fx_ready WHERE complete AND year IN (2000, 2001))")
def _(fx):
    """Mean absolute contribution of every contract feature at every date."""
    return ml.importance(Forecasting.of(fx).attributions, ["forecast_date"]).select("forecast_date", "feature", (F.col("importance") >= 0).alias("valid"))


@query("driver_rollup_model", """SELECT r.state, r.year, r.forecast_date, count(DISTINCT f.feature) AS n_features, TRUE AS adds_up FROM fx_ready r JOIN fx_features f ON r.forecast_date = f.forecast_date
  WHERE r.complete AND r.acres_planted_all > 0 AND r.year IN (2000, 2001) GROUP BY ALL""")
def _(fx):
    """State drivers; with the base value they add up to the state point of the model."""
    f = Forecasting.of(fx)
    rolled = ml.driver_rollup(f.attributions, _CELL, "acres").groupBy(*_CELL).agg(F.count("*").alias("n_features"), F.sum("attribution").alias("total"))
    base = f.attributions.groupBy("forecast_date").agg(F.first("base_value").alias("base"))  # one value per date
    gap = F.abs(F.col("base") + F.col("total") - F.col("model_point"))
    return rolled.join(base, "forecast_date").join(f.model_points, _CELL).select(*_CELL, "n_features", (gap <= 1e-2).alias("adds_up"))


@query("topk_drivers_model", "SELECT geoid, state, year, forecast_date, CAST(3 AS BIGINT) AS n, TRUE AS ordered, TRUE AS signed FROM fx_ready WHERE complete AND year IN (2000, 2001)")
def _(fx):
    """The three largest contributions to every prediction, largest first, with their direction."""
    keys = ["geoid", "state", "year", "forecast_date"]
    top = ml.topk_drivers(Forecasting.of(fx).attributions, keys)
    size = F.sort_array(F.collect_list(F.struct("rank", F.abs("attribution").alias("a"))))["a"]  # three entries
    return top.groupBy(*keys).agg(F.count("*").alias("n"), (size == F.reverse(F.array_sort(size))).alias("ordered"),
                                  F.bool_and((F.col("direction") == "+") == (F.col("attribution") > 0)).alias("signed"))


# --- model B and routing ----------------------------------------------------------
_ROUTED = ", ".join(f"'{s}'" for s in ROUTED)
VIEWS["fx_chipvec"] = f"""SELECT p.geoid, p.state, p.year, d.forecast_date, p.yield_target, coalesce(q.chip_count, 0) AS chip_count, coalesce(q.chip_count, 0) > 0 AND e.embedding IS NOT NULL AS has_vector
  FROM fx_panel p CROSS JOIN (SELECT forecast_date, row_number() OVER (ORDER BY forecast_date) - 1 AS r FROM fx_dates) d
  LEFT JOIN ({_QC}) q ON p.geoid = q.geoid AND p.year = q.year AND q.forecast_date = d.forecast_date
  LEFT JOIN embeddings e ON e.vec_id = (CAST(p.geoid AS INTEGER) * 28 + (p.year - 1995) * 4 + d.r) % {N_VECTORS}"""
VIEWS["fx_folds"] = """SELECT forecast_date, CAST(geoid AS INTEGER) % 5 AS fold, count(*) AS n FROM fx_chipvec WHERE has_vector AND year BETWEEN 1995 AND 1999 AND yield_target IS NOT NULL GROUP BY ALL"""
VIEWS["fx_probe"] = """SELECT v.geoid, v.state, v.year, v.forecast_date, v.has_vector, v.has_vector AND coalesce(t.n, 0) - CASE WHEN v.year BETWEEN 1995 AND 1999 AND v.yield_target IS NOT NULL THEN coalesce(f.n, 0) ELSE 0 END >= 100 AS predicted
  FROM fx_chipvec v LEFT JOIN (SELECT forecast_date, sum(n) AS n FROM fx_folds GROUP BY forecast_date) t ON t.forecast_date = v.forecast_date
  LEFT JOIN fx_folds f ON f.forecast_date = v.forecast_date AND f.fold = CAST(v.geoid AS INTEGER) % 5"""


@query("ridge_probe", "SELECT geoid, state, year, forecast_date, has_vector, predicted FROM fx_probe")
def _(fx):
    """Ridge scalar of every panel key with a vector: out of fold in training years, from all training rows elsewhere; too few rows give none."""
    rows = Forecasting.of(fx).probed
    return rows.select("geoid", "state", "year", "forecast_date", (F.col(hybrid.PRESENT) == 1).alias("has_vector"), (F.col(hybrid.PROBE) != hybrid.ABSENT).alias("predicted"))


@query("hybrid_model", f"""SELECT geoid, state, year, forecast_date, complete AS has_a, complete AS has_b, CASE WHEN state IN ({_ROUTED}) THEN 'B' ELSE 'A' END AS model, TRUE AS routed
  FROM fx_ready WHERE year IN (2000, 2001)""")
def _(fx):
    """Both real models and the routed prediction of every validation and holdout row."""
    rows = Forecasting.of(fx).hybrid.withColumn("model", F.when(F.col("state").isin(*ROUTED), "B").otherwise("A"))
    own = F.when(F.col("model") == "B", F.col("pred_b")).otherwise(F.col("pred_a"))
    return rows.select("geoid", "state", "year", "forecast_date", F.col("pred_a").isNotNull().alias("has_a"), F.col("pred_b").isNotNull().alias("has_b"), "model",
                       F.col("pred_hybrid").eqNullSafe(own).alias("routed"))


@query("ablation_metrics_model", """SELECT variant, state, year, forecast_date, count(*) AS n, TRUE AS scored, CASE WHEN variant = 'hybrid' THEN TRUE END AS as_routed FROM fx_ready
  CROSS JOIN (SELECT unnest(['rowA', 'rowB', 'hybrid']) AS variant) WHERE year IN (2000, 2001) AND complete AND yield_target IS NOT NULL GROUP BY ALL""")
def _(fx):
    """n, RMSE and bias of both models and the routed one per state, year and date; the routed error is that of the state's model."""
    out = hybrid.route_scores(Forecasting.of(fx).hybrid, "yield_target", _CELL)
    at = Window.partitionBy(*_CELL)  # three variants
    own = F.when(F.col("state").isin(*ROUTED), "rowB").otherwise("rowA")
    same = F.abs(F.col("rmse") - F.max(F.when(F.col("variant") == own, F.col("rmse"))).over(at)) < 1e-9
    return out.select("variant", *_CELL, "n", ((F.col("rmse") > 0) & (F.abs("bias") <= F.col("rmse") + 1e-9)).alias("scored"), F.when(F.col("variant") == "hybrid", same).alias("as_routed"))


@query("relative_gate_model", "SELECT DISTINCT year, forecast_date, CAST(NULL AS VARCHAR) AS reason, TRUE AS by_lift FROM fx_ready WHERE year IN (2000, 2001) AND complete AND yield_target IS NOT NULL")
def _(fx):
    """Model B against model A at the five percent mark, per year and date."""
    per = hybrid.route_scores(Forecasting.of(fx).hybrid, "yield_target", ["year", "forecast_date"])
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("rmse")))
    wide = per.groupBy("year", "forecast_date").agg(of("rowA").alias("a"), of("rowB").alias("b"))
    out = wide.select("year", "forecast_date", "a", "b", *scoring.relative_gate(F.col("a"), F.col("b"), 0.05))
    return out.select("year", "forecast_date", "reason", (F.col("passed") == ((F.col("a") - F.col("b")) / F.col("a") >= 0.05)).alias("by_lift"))


@query("state_block_model", f"""SELECT state, count(*) AS n_counties, CASE WHEN state IN ({_ROUTED}) THEN 'Row B' ELSE 'Row A' END AS model, CAST(round_even(avg(yield_target), 0) AS INTEGER) AS actual,
  TRUE AS own_row FROM fx_ready WHERE year = 2001 AND complete AND forecast_date = 'EOS' GROUP BY state""")
def _(fx):
    """State report of the holdout year from the routed predictions at the end of season."""
    rows = Forecasting.of(fx).hybrid.where((F.col("year") == fxm.HOLDOUT_YEAR) & (F.col("forecast_date") == "EOS"))
    out = documents.state_block(rows, "state", "geoid", "yield_target", ROUTED)
    own = F.when(F.col("model") == "Row B", F.col("row_b")).otherwise(F.col("row_a"))
    return out.select("state", "n_counties", "model", "actual", ((F.col("predicted") == own) & (F.col("top_yield") >= F.col("predicted"))).alias("own_row"))


@query("spread_cone_model", """SELECT state, year, forecast_date, CAST(round_even(avg(yield_target), 0) AS INTEGER) AS actual, CASE WHEN count(*) > 1 THEN TRUE END AS nested FROM fx_ready
  WHERE year IN (2000, 2001) AND complete GROUP BY state, year, forecast_date""")
def _(fx):
    """Cone from the spread of the routed predictions of a state's entities; the range holds the cone, the cone the point."""
    out = documents.spread_cone(Forecasting.of(fx).hybrid, _CELL, "yield_target")
    nested = (F.col("range_low") <= F.col("lower")) & (F.col("lower") <= F.col("predicted")) & (F.col("predicted") <= F.col("upper")) & (F.col("upper") <= F.col("range_high"))
    return out.select(*_CELL, "actual", nested.alias("nested"))


# --- dense vectors -----------------------------------------------------------
@query("pca_reduce", "SELECT vec_id, label, CASE WHEN embedding IS NULL THEN NULL ELSE 8 END AS dims, 'base+pca8' AS model_version FROM embeddings")
def _(fx):
    """Vectors projected on eight components fitted on the training ids."""
    out, _var = ml.pca_reduce(fx.table("embeddings"), "embedding", F.col("vec_id") % 5 < 3, 8)
    return out.select("vec_id", "label", F.when(F.col("reduced").isNotNull(), F.size("reduced")).alias("dims"), F.lit("base+pca8").alias("model_version"))


@query("embedding_join", """SELECT c_custkey, len(embedding) AS dims, round(embedding[1]::DOUBLE + 3.3e-8, 6) AS first_dim, label FROM customer
  LEFT JOIN (SELECT * FROM embeddings WHERE label < 5) e ON c_custkey = e.vec_id""")
def _(fx):
    emb = fx.table("embeddings").select(F.col("vec_id").alias("c_custkey"), "embedding", "label", F.when(F.col("label") < 5, "v1").otherwise("v2").alias("model_version"))
    out = ml.embedding_join(fx.table("customer").select("c_custkey"), emb, ["c_custkey"], "v1", ["embedding", "label"])
    return out.select("c_custkey", F.when(F.col("embedding").isNotNull(), F.size("embedding").cast("long")).alias("dims"), fix(F.get("embedding", F.lit(0))).alias("first_dim"), "label")


@query("batch_embed", f"""SELECT p.geoid, p.year, d.forecast_date, {fix_sql('e.a')} AS first_dim, {fix_sql('e.b')} AS second_dim, coalesce(q.chip_count, 0) AS chip_count, coalesce(q.chip_count, 0) = 0 AS fully_padded,
  q.chip_age_days_max, {rsql(['q.cloud_pct_max', 'q.corn_pixel_frac_min']).replace('AS q.', 'AS ')} FROM fx_panel p CROSS JOIN fx_dates d
  LEFT JOIN ({_QC}) q ON p.geoid = q.geoid AND p.year = q.year AND q.forecast_date = d.forecast_date
  LEFT JOIN (SELECT geoid, year, forecast_date, avg(dayofyear(scene_date) / 366.0::DOUBLE + length(granule_id)) AS a, avg(year(scene_date) / 2000.0::DOUBLE - 93.0) AS b FROM fx_sequence GROUP BY ALL) e
    ON p.geoid = e.geoid AND p.year = e.year AND e.forecast_date = d.forecast_date""")
def _(fx):
    """Chip sequences through a stand-in model (day, year, location and path), with their QC columns; padded keys have no vector."""
    sequence, keys = chips.chip_sequence(index(fx), "geoid"), ["geoid", "year", "forecast_date"]
    seq = chips.sequence_inputs(sequence.withColumn("chip_path", F.col("granule_id")), "geoid", F.lit(42.0), F.lit(-93.0))

    def model(pdf):
        steps = np.stack([np.stack(t) for t in pdf["time_coords"]])
        place = np.stack(pdf["location"].to_list())
        paths = np.array([[len(p) for p in row] for row in pdf["chip_paths"]], float)
        return np.stack([steps[:, :, 1] / 366 + paths, steps[:, :, 0] / 2000 + place[:, 1:2]], axis=2)

    grid = joins.skeleton_cross(fx.panel.select("geoid", "year")).drop("date_rank")
    quality = chips.chip_coverage(grid, sequence, "geoid")
    out = quality.join(ml.batch_embed(seq, model, keys), keys, "left")
    out = out.withColumns({"first_dim": F.get("embedding", F.lit(0)), "second_dim": F.get("embedding", F.lit(1))}).drop("embedding")
    return rounded(out, ["first_dim", "second_dim", "cloud_pct_max", "corn_pixel_frac_min"])


# --- documents ---------------------------------------------------------------
def forecast_docs(fx, model=False):
    f = Forecasting.of(fx)
    cell = ["state", "year", "forecast_date"]
    cones = f.state_cones.where((F.col("pool") == "same_geoid") & (F.col("k") == 5)).drop("pool", "k")
    holdout = f.ready.where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR))
    coverage = holdout.groupBy(*cell).agg(F.count_if("complete").alias("n_complete"))
    anchors = documents.anchor_entity(holdout, cell, "geoid", "acres_planted_all")
    history = cone.lookback_state(f.panel, "geoid", "state", (5, 10)).select("state", "year", "mean_5", "mean_10")
    analogs = f.same_entity(f.holdout_queries).select("q_geoid", "q_year", "forecast_date", "rank", "geoid", "year", "distance", "yield_target")
    drivers = ml.driver_rollup(f.attributions, cell, "acres") if model else None
    return documents.state_forecast_doc(cones, coverage, anchors, analogs, f.truth, history, cell, f.model_points if model else None, drivers)


_DOC = f"""SELECT g.state, g.year, g.forecast_date, s.point, s.p10, s.p50, s.p90, CASE WHEN s.p50 IS NOT NULL THEN 'ok' WHEN g.n_complete > 0 THEN 'unavailable_no_analogs' ELSE 'unavailable_pending_ndvi' END AS cone_status,
  coalesce(s.n_counties, 0) AS n_counties, CASE WHEN s.p50 IS NOT NULL THEN g.anchor END AS anchor, t.truth FROM (
    SELECT state, year, forecast_date, count(*) FILTER (complete) AS n_complete, arg_max(geoid, (acres_planted_all, geoid)) FILTER (complete AND acres_planted_all IS NOT NULL) AS anchor
    FROM fx_ready WHERE year IN (2000, 2001) GROUP BY ALL) g
  LEFT JOIN (SELECT * FROM fx_state_cones WHERE pool = 'same_geoid' AND k = 5) s ON g.state = s.state AND g.year = s.year AND g.forecast_date = s.forecast_date
  LEFT JOIN fx_truth t ON g.state = t.state AND g.year = t.year"""


@query("state_forecast_doc", f"SELECT state, year, forecast_date, cone_status, n_counties, anchor, {rsql(['point', 'p10', 'p50', 'p90', 'truth'])} FROM ({_DOC})")
def _(fx):
    d = forecast_docs(fx)
    return rounded(d.select("state", "year", "forecast_date", "cone_status", "n_counties", F.when(F.col("anchor").isNotNull(), F.col("anchor.geoid")).alias("anchor"),
                            F.col("point_estimate").alias("point"), "cone.p10", "cone.p50", "cone.p90", "truth"), ["point", "p10", "p50", "p90", "truth"])


@query("state_forecast_doc_model", f"""SELECT d.state, d.year, d.forecast_date, cone_status, {rsql(['analog_point'])}, n_predicted > 0 OR analog_point IS NOT NULL AS has_point, CASE WHEN n_predicted > 0 THEN 5 END AS n_drivers,
  {rsql(['width_80', 'mean_5', 'mean_10'])} FROM (SELECT *, point AS analog_point, p90 - p10 AS width_80 FROM ({_DOC})) d JOIN ({_PREDICTED}) p ON d.state = p.state AND d.year = p.year AND d.forecast_date = p.forecast_date
  LEFT JOIN (SELECT a.state, a.year, sum(a.m * a.acres) FILTER (a.m IS NOT NULL AND a.acres > 0) / sum(a.acres) FILTER (a.m IS NOT NULL AND a.acres > 0) AS mean_5 FROM fx_look5_all a GROUP BY ALL) h5 ON d.state = h5.state AND d.year = h5.year
  LEFT JOIN (SELECT a.state, a.year, sum(a.m * a.acres) FILTER (a.m IS NOT NULL AND a.acres > 0) / sum(a.acres) FILTER (a.m IS NOT NULL AND a.acres > 0) AS mean_10 FROM fx_look10_all a GROUP BY ALL) h10 ON d.state = h10.state AND d.year = h10.year""")
def _(fx):
    """Documents whose point comes from the regressor and whose drivers come from its attributions."""
    d = forecast_docs(fx, model=True)
    out = d.select(*_CELL, "cone_status", "analog_point", F.col("point_estimate").isNotNull().alias("has_point"),
                   F.when(F.col("drivers").isNotNull(), F.size("drivers")).alias("n_drivers"), "cone.width_80", "history.mean_5", "history.mean_10")
    return rounded(out, ["analog_point", "width_80", "mean_5", "mean_10"])


@query("payload_round", f"SELECT state, year, forecast_date, round_even(point, 1) AS point, round_even(p50, 1) AS p50, round_even(truth, 1) AS truth, cone_status FROM ({_DOC})")
def _(fx):
    p = documents.payload_round(forecast_docs(fx))
    get = lambda path: F.get_json_object("payload", path)
    return p.select("state", "year", "forecast_date", get("$.point_estimate").cast("double").alias("point"), get("$.cone.p50").cast("double").alias("p50"),
                    get("$.truth").cast("double").alias("truth"), get("$.cone_status").alias("cone_status"))


def _emission_docs(fx):
    return documents.emissions_doc(landuse.emissions_per_class(fx.classcount, "image_id"), landuse.emissions_agg(fx.classcount, "image_id"), "image_id")


@query("sink_json_doc", f"""SELECT image_id, {fix_sql('coalesce(sum(pixel_count * 0.000009 * annual), 0)')} AS annual_tco2e, CAST(count(*) FILTER (annual IS NOT NULL) AS INTEGER) AS n_classes FROM fx_classcount n LEFT JOIN fx_factor f ON n.class_id = f.class_id GROUP BY image_id""")
def _(fx):
    docs = _emission_docs(fx)
    keys = F.json_object_keys(F.get_json_object("doc", "$.per_class"))
    return docs.select("image_id", fix(F.get_json_object("doc", "$.totals.annual_tco2e").cast("double")).alias("annual_tco2e"), F.size(keys).alias("n_classes"))


@query("doc_roundtrip", f"""SELECT n.image_id, f.class_name, n.pixel_count, {fix_sql('n.pixel_count * 0.000009')} AS area_ha, {fix_sql('n.pixel_count * 0.000009 * annual')} AS annual_tco2e, {fix_sql('n.pixel_count * 0.000009 * embodied')} AS embodied_tco2e,
  {fix_sql('sum(n.pixel_count * 0.000009 * annual) OVER (PARTITION BY n.image_id)')} AS total_annual FROM fx_classcount n JOIN fx_factor f ON n.class_id = f.class_id""")
def _(fx):
    return rounded(documents.doc_roundtrip(_emission_docs(fx), "image_id"), ["area_ha", "annual_tco2e", "embodied_tco2e", "total_annual"])


_PC = ["yield_target", "gdd_cum_f50_c86", "vpd_kpa_grain", "d0_pct"]


@query("profile", f"""SELECT col AS "column", count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null, {fix_sql('avg(v)')} AS mean, {fix_sql('min(v)')} AS min, {fix_sql('max(v)')} AS max, {fix_sql('quantile_cont(v, 0.25)')} AS q1,
  {fix_sql('quantile_cont(v, 0.5)')} AS q2, {fix_sql('quantile_cont(v, 0.75)')} AS q3, {fix_sql('100.0 * count(*) FILTER (v IS NULL) / count(*)')} AS null_pct FROM (
  SELECT unnest([{', '.join(repr(c) for c in _PC)}]) AS col, unnest([{', '.join(f'{c}::DOUBLE' for c in _PC)}]) AS v FROM fx_master) GROUP BY col""")
def _(fx):
    f = Forecasting.of(fx)
    return rounded(documents.profile(f.ready, _PC), ["mean", "min", "max", "q1", "q2", "q3", "null_pct"])


@query("profile_lines", f"""SELECT col AS "column", count(*) AS n_rows, count(*) FILTER (v IS NULL) AS n_null, {fix_sql('avg(v)')} AS mean, {fix_sql('min(v)')} AS min, {fix_sql('max(v)')} AS max, {fix_sql('quantile_cont(v, 0.25)')} AS q1,
  {fix_sql('quantile_cont(v, 0.5)')} AS q2, {fix_sql('quantile_cont(v, 0.75)')} AS q3, {fix_sql('100.0 * count(*) FILTER (v IS NULL) / count(*)')} AS null_pct FROM (
  SELECT unnest(['l_extendedprice', 'l_quantity']) AS col, unnest([l_extendedprice, l_quantity]) AS v FROM lineitem) GROUP BY col""")
def _(fx):
    return rounded(documents.profile(fx.table("lineitem"), ["l_extendedprice", "l_quantity"]), ["mean", "min", "max", "q1", "q2", "q3", "null_pct"])


@query("profile_slices", f"""SELECT CASE grouping(year, forecast_date, state) WHEN 7 THEN 'all' WHEN 3 THEN 'year' WHEN 5 THEN 'date' ELSE 'state' END AS slice, year, forecast_date, state, count(*) AS n_rows,
  count(DISTINCT geoid) AS n_entities, {fix_sql('100.0 * count(yield_target) / count(*)')} AS yield_target_known_pct, {fix_sql('100.0 * count(vpd_kpa_grain) / count(*)')} AS vpd_kpa_grain_known_pct
  FROM fx_ready GROUP BY GROUPING SETS ((), (year), (forecast_date), (state))""")
def _(fx):
    """Rows, entities and known shares of the panel over all and by year, date and state, from one aggregate."""
    sets = {"all": [], "year": ["year"], "date": ["forecast_date"], "state": ["state"]}
    out = documents.profile_slices(Forecasting.of(fx).ready, sets, "geoid", ["yield_target", "vpd_kpa_grain"])
    return rounded(out, ["yield_target_known_pct", "vpd_kpa_grain_known_pct"])


@query("value_counts", """SELECT "column", value, count(*) AS n FROM (SELECT unnest(['phase', 'sensor', 'tile']) AS "column", unnest([phase, sensor, tile]) AS value FROM fx_index) GROUP BY ALL""")
def _(fx):
    """Values of the scene index' closed columns with their counts, missing ones among them."""
    return documents.value_counts(index(fx), ["phase", "sensor", "tile"])
