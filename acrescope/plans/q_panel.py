"""Queries: sources to panel, history, pools, trend and standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S
from acrescope.operators import cone, joins, panel, trend, weather
from acrescope.plans import fixtures as fxm
from acrescope.plans.catalog import query
from acrescope.plans.forecasting import Forecasting
from acrescope.plans.oracle_views import CLIMATE
from acrescope.plans.rounding import fix, fix_sql, rounded, rsql

_W = ["gdd_cum_f50_c86", "edd_hours_gt86f", "edd_hours_gt90f", "prcp_cum_mm", "vpd_kpa_veg", "vpd_kpa_silk", "vpd_kpa_grain",
      "srad_total_veg", "srad_total_silk", "srad_total_grain", "dry_spell_max_days"]
_ALL = ["yield_target", "irrigated_share", "harvest_ratio", *_W, "d0_pct", "d2plus"]


@query("state_season", f"""SELECT state, year, forecast_date, count(*) AS n_counties,
  {fix_sql('sum(yield_target * acres_planted_all) / sum(acres_planted_all)')} AS yield_weighted,
  {fix_sql('sum(gdd_cum_f50_c86 * acres_planted_all) / nullif(sum(acres_planted_all) FILTER (gdd_cum_f50_c86 IS NOT NULL), 0)')} AS gdd_weighted,
  {fix_sql('sum(vpd_kpa_silk * acres_planted_all) / nullif(sum(acres_planted_all) FILTER (vpd_kpa_silk IS NOT NULL), 0)')} AS vpd_silk_weighted,
  {fix_sql('max(dry_spell_max_days)')} AS dry_spell_max_days FROM fx_master GROUP BY state, year, forecast_date""")
def _(fx):
    w = F.col("acres_planted_all")
    shared = Forecasting.of(fx).fx
    features = weather.season_features(shared.entity_day, ["geoid", "state", "year"])
    base = joins.left_join_checked(joins.skeleton_cross(shared.survey_saved), features, ["geoid", "state", "year", "forecast_date"], "weather")
    return base.groupBy("state", "year", "forecast_date").agg(
        F.count(F.lit(1)).alias("n_counties"), fix(cone.weighted(F.col("yield_target"), w)).alias("yield_weighted"),
        fix(cone.weighted(F.col("gdd_cum_f50_c86"), w)).alias("gdd_weighted"),
        fix(cone.weighted(F.col("vpd_kpa_silk"), w)).alias("vpd_silk_weighted"),
        fix(F.max("dry_spell_max_days")).alias("dry_spell_max_days"))


@query("skeleton_cross", "SELECT geoid, state, year, forecast_date, date_rank FROM fx_panel CROSS JOIN fx_dates")
def _(fx):
    return joins.skeleton_cross(fx.panel.select("geoid", "state", "year"))


@query("left_join_checked", f"SELECT geoid, state, year, forecast_date, {rsql(_ALL)} FROM fx_master")
def _(fx):
    return rounded(fx.master.select("geoid", "state", "year", "forecast_date", *_ALL), _ALL)


@query("static_dim_join", """SELECT p.geoid, p.year, d.n_customers FROM fx_panel p
  LEFT JOIN (SELECT geoid, count(*) AS n_customers FROM fx_entity GROUP BY geoid) d ON p.geoid = d.geoid""")
def _(fx):
    static = fx.entity.groupBy("geoid").agg(F.count(F.lit(1)).alias("n_customers"))
    return joins.left_join_checked(fx.panel.select("geoid", "year"), static, ["geoid"], "static")


@query("geoid_single_state", "SELECT geoid, count(DISTINCT state) AS n_states FROM fx_entity GROUP BY geoid HAVING count(DISTINCT state) = 1")
def _(fx):
    from acrescope.operators import quality
    states = fx.entity.groupBy("geoid").agg(F.countDistinct("state").alias("n_states"))
    bad = quality.single_value(fx.entity, "geoid", "state")
    return states.join(bad, "geoid", "left_anti")


@query("derived_flags", """SELECT geoid, year, CASE WHEN acres_harvested_irr IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS is_irrigated_reported,
  CASE WHEN state = 'ASIA' THEN 1.0 ELSE 0.0 END::DOUBLE AS state_is_ASIA, CASE WHEN state = 'EUROPE' THEN 1.0 ELSE 0.0 END::DOUBLE AS state_is_EUROPE FROM fx_panel""")
def _(fx):
    flags = S.derived_flags("state", "acres_harvested_irr", ["ASIA", "EUROPE"])
    return fx.panel.select("geoid", "year", *[c.alias(n) for n, c in flags.items()])


@query("completeness_flag", "SELECT geoid, year, forecast_date, complete FROM fx_ready")
def _(fx):
    flag = S.complete_for_date("forecast_date", fxm.CONTRACT)
    return Forecasting.of(fx).ready.select("geoid", "year", "forecast_date", flag.alias("complete"))


@query("group_coverage", """SELECT year, forecast_date, count(*) AS n_rows, count(*) FILTER (yield_target IS NOT NULL
  AND coalesce(gdd_cum_f50_c86, prcp_cum_mm) IS NOT NULL AND coalesce(d0_pct, d2plus) IS NOT NULL) AS n_covered FROM fx_master GROUP BY ALL""")
def _(fx):
    ok = F.col("yield_target").isNotNull() & S.any_present(["gdd_cum_f50_c86", "prcp_cum_mm"]) & S.any_present(["d0_pct", "d2plus"])
    return Forecasting.of(fx).ready.groupBy("year", "forecast_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_covered"))


@query("reorder_cols", f"SELECT year, geoid, forecast_date, {rsql(['yield_target', 'd0_pct', 'prcp_cum_mm'])} FROM fx_master")
def _(fx):
    some = rounded(Forecasting.of(fx).ready.select("d0_pct", "geoid", "yield_target", "year", "prcp_cum_mm", "forecast_date"), ["yield_target", "d0_pct", "prcp_cum_mm"])
    return panel.reorder(some, ["geoid", "year", "forecast_date", "yield_target"], [["prcp_cum_mm"], ["d0_pct"]])


_WIDTHS = [(d, len(K.retrieval_columns(d)), len(K.model_columns(d)), len(c)) for d, c in fxm.CONTRACT.items()]


@query("embedding_cols", f"""SELECT forecast_date, count(*) FILTER (complete) AS n_complete, n_retrieval, n_model, n_bound FROM fx_ready
  JOIN (VALUES {', '.join(f"('{d}', {a}, {b}, {c})" for d, a, b, c in _WIDTHS)}) AS w(forecast_date, n_retrieval, n_model, n_bound) USING (forecast_date) GROUP BY ALL""")
def _(fx):
    """Per date: width of each column contract and rows complete for the bound one."""
    have = set(Forecasting.of(fx).ready.columns)
    rows = [(d, len(K.retrieval_columns(d)), len(K.model_columns(d)), len([c for c in K.retrieval_columns(d) if c in have and c != "d0_pct"])) for d in K.FORECAST_DATES]
    dim = fx.spark.createDataFrame(rows, "forecast_date string, n_retrieval int, n_model int, n_bound int")
    return Forecasting.of(fx).ready.groupBy("forecast_date").agg(F.count_if("complete").alias("n_complete")).join(dim, "forecast_date")


@query("select_features", f"SELECT forecast_date, {', '.join(f'{fix_sql(f"avg({c})")} AS {c}' for c in CLIMATE)} FROM fx_master GROUP BY forecast_date")
def _(fx):
    """Climate columns present in the state panel, averaged per date."""
    cols = panel.numeric_features(Forecasting.of(fx).ready, {"geoid", "state", "year"}, list(K.CLIMATE_FEATURES))
    return Forecasting.of(fx).ready.groupBy("forecast_date").agg(*[fix(F.avg(c)).alias(c) for c in cols])


_NUMERIC = sorted([*_ALL, "acres_planted_all", "acres_harvested_all", "acres_harvested_irr", "acres_harvested_noirr_derived", "d1_pct", "d2_pct", "d3_pct", "d4_pct"])


@query("select_numeric", f"SELECT forecast_date, {', '.join(f'{fix_sql(f"avg({c})")} AS {c}' for c in _NUMERIC)} FROM fx_master GROUP BY forecast_date")
def _(fx):
    """Every numeric column but keys and ranks, averaged per date; no list of names is given."""
    rows = Forecasting.of(fx).ready
    cols = sorted(panel.numeric_features(rows, {"geoid", "state", "year", "forecast_date", "date_rank"}))
    return rows.groupBy("forecast_date").agg(*[fix(F.avg(c)).alias(c) for c in cols])


@query("sort_enum", "SELECT geoid, year, forecast_date, CAST(date_rank AS INTEGER) AS date_rank FROM fx_panel CROSS JOIN fx_dates ORDER BY geoid, year, date_rank")
def _(fx):
    rows = joins.skeleton_cross(fx.panel.select("geoid", "year")).withColumn("date_rank", S.date_rank("forecast_date"))
    return rows.orderBy("geoid", "year", "date_rank")


@query("limit_n", "SELECT geoid, year, forecast_date FROM fx_panel CROSS JOIN fx_dates ORDER BY geoid, year, date_rank LIMIT 100")
def _(fx):
    return joins.skeleton_cross(fx.panel.select("geoid", "year")).orderBy("geoid", "year", "date_rank").limit(100).drop("date_rank")


@query("query_grid", """SELECT DISTINCT geoid, state, year, forecast_date FROM fx_panel CROSS JOIN fx_dates
  WHERE year BETWEEN 1996 AND 2000 AND state IN ('ASIA', 'EUROPE') AND forecast_date IN ('08-01', 'EOS')""")
def _(fx):
    return panel.query_grid(joins.skeleton_cross(fx.panel), ["geoid", "state", "year", "forecast_date"], (1996, 2000), ["ASIA", "EUROPE"], ["08-01", "EOS"])


@query("set_difference", "SELECT DISTINCT state FROM fx_panel WHERE state NOT IN ('AFRICA', 'AMERICA', 'ASIA')")
def _(fx):
    from acrescope.operators import quality
    return quality.outside_allowed(fx.panel, "state", ["AFRICA", "AMERICA", "ASIA"])


@query("min_history", "SELECT r.geoid, r.year, r.forecast_date, h.n_years FROM fx_ready r JOIN fx_history h ON r.geoid = h.geoid WHERE h.n_years >= 3")
def _(fx):
    counts = panel.qualifying_history(Forecasting.of(fx).ready, "geoid", fxm.TRAIN_YEARS)
    return panel.min_history(Forecasting.of(fx).ready, "geoid", fxm.MIN_YEARS, fxm.TRAIN_YEARS).join(counts, "geoid").select("geoid", "year", "forecast_date", "n_years")


@query("semi_keep", "SELECT geoid, year, forecast_date FROM fx_ready WHERE geoid IN (SELECT geoid FROM fx_history WHERE n_years >= 4)")
def _(fx):
    kept = panel.qualifying_history(Forecasting.of(fx).ready, "geoid", fxm.TRAIN_YEARS).where("n_years >= 4")
    return joins.semi_keep(Forecasting.of(fx).ready, kept, ["geoid"]).select("geoid", "year", "forecast_date")


@query("split_pools", """SELECT 'train' AS pool, geoid, year, forecast_date FROM fx_train
  UNION ALL SELECT 'val', geoid, year, forecast_date FROM fx_ready WHERE year = 2000
  UNION ALL SELECT 'holdout', geoid, year, forecast_date FROM fx_ready WHERE year = 2001""")
def _(fx):
    cols = ["geoid", "year", "forecast_date"]
    tag = lambda df, name: df.select(F.lit(name).alias("pool"), *cols)
    train = panel.train_pool(Forecasting.of(fx).ready, "geoid", fxm.MIN_YEARS, fxm.TRAIN_YEARS)
    return tag(train, "train").unionByName(tag(Forecasting.of(fx).ready.where(F.col("year") == fxm.VAL_YEAR), "val")) \
        .unionByName(tag(Forecasting.of(fx).ready.where(F.col("year") == fxm.HOLDOUT_YEAR), "holdout"))


@query("ols_trend", f"SELECT geoid, state, own_fit, {fix_sql('slope')} AS slope, {fix_sql('intercept', 4)} AS intercept FROM fx_params")
def _(fx):
    out = Forecasting.of(fx).params
    return out.select("geoid", "state", "own_fit", fix("slope").alias("slope"), fix("intercept", 4).alias("intercept"))


@query("detrend_retrend", f"""SELECT m.geoid, m.year, m.forecast_date, {fix_sql('m.yield_target - (p.slope * m.year + p.intercept)')} AS detrended_yield_target,
  CASE WHEN p.slope IS NOT NULL THEN {fix_sql('m.yield_target')} END AS back FROM fx_master m LEFT JOIN fx_params p ON m.geoid = p.geoid""")
def _(fx):
    p = Forecasting.of(fx).params
    d = trend.detrend(joins.skeleton_cross(fx.survey), p, "geoid").withColumn("back", F.col("detrended_yield_target"))
    return rounded(trend.retrend(d, p, "geoid", ["back"]).select("geoid", "year", "forecast_date", "detrended_yield_target", "back"), ["detrended_yield_target", "back"])


@query("standardizer_fit", f"SELECT forecast_date, feature, {rsql(['mean', 'std'])} FROM fx_std")
def _(fx):
    return rounded(Forecasting.of(fx).std, ["mean", "std"])


_VEC = "[round(x + 3.3e-8, 6) for x in vec]"


@query("zscore", f"SELECT geoid, year, forecast_date, {_VEC} AS vec FROM fx_vec")
def _(fx):
    return Forecasting.of(fx).vectors.select("geoid", "year", "forecast_date", F.transform("vec", lambda x: fix(x)).alias("vec"))


@query("vector_assemble", f"""SELECT geoid, year, forecast_date, [round(x + 3.3e-8, 6) for x in CASE WHEN forecast_date = '08-01'
  THEN [{', '.join(fxm.ALWAYS)}] ELSE [{', '.join(fxm.ALWAYS + fxm.GRAIN)}] END] AS features FROM fx_ready WHERE complete""")
def _(fx):
    rows = Forecasting.of(fx).ready.where("complete")
    arr = None
    for d, cols in fxm.CONTRACT.items():
        a = F.array(*[fix(c) for c in cols])
        arr = F.when(F.col("forecast_date") == d, a) if arr is None else arr.when(F.col("forecast_date") == d, a)
    return rows.select("geoid", "year", "forecast_date", arr.alias("features"))


@query("weighted_rollup_all", f"SELECT state, year, forecast_date, {rsql(['yield_target', *CLIMATE])} FROM fx_state")
def _(fx):
    return rounded(Forecasting.of(fx).state_panel, ["yield_target", *CLIMATE])


@query("weighted_mean", f"SELECT state, year, {fix_sql('truth')} AS truth FROM fx_truth")
def _(fx):
    return rounded(cone.weighted_mean(Forecasting.of(fx).ready, "geoid", "state"), ["truth"])


@query("weight_lookup", f"SELECT geoid, state, year, {fix_sql('acres')} AS acres FROM fx_weights")
def _(fx):
    return cone.entity_weights(Forecasting.of(fx).ready, "geoid", "state").select("geoid", "state", "year", fix("acres_planted_all").alias("acres"))


@query("lookback_mean", f"SELECT geoid, year, {fix_sql('m')} AS mean_5 FROM fx_look5")
def _(fx):
    return rounded(cone.lookback_mean(fx.panel, "geoid", (5,), skip_years=(fxm.HOLDOUT_YEAR,)).select("geoid", "year", "mean_5"), ["mean_5"])


@query("lookback_state", f"SELECT state, year, {fix_sql('baseline')} AS mean_5, n_baseline AS n_5 FROM fx_baseline")
def _(fx):
    return rounded(cone.lookback_state(fx.panel, "geoid", "state", (5,), skip_years=(fxm.HOLDOUT_YEAR,)), ["mean_5"])


@query("history_table", f"""SELECT a.state, a.year, {fix_sql('a.m')} AS mean_5, {fix_sql('b.m')} AS mean_10, {fix_sql('t.truth - a.m')} AS delta_5 FROM
  (SELECT state, year, sum(m * acres) FILTER (m IS NOT NULL) / sum(acres) FILTER (m IS NOT NULL) AS m FROM fx_look5_all GROUP BY ALL) a
  JOIN (SELECT state, year, sum(m * acres) FILTER (m IS NOT NULL) / sum(acres) FILTER (m IS NOT NULL) AS m FROM fx_look10_all GROUP BY ALL) b USING (state, year)
  JOIN fx_truth t USING (state, year)""")
def _(fx):
    hist = cone.lookback_state(fx.panel, "geoid", "state", (5, 10))
    truth = fx.panel.groupBy("state", "year").agg(cone.weighted(F.col("yield_target"), F.col("acres_planted_all")).alias("truth"))
    out = hist.join(truth, ["state", "year"]).withColumn("delta_5", F.col("truth") - F.col("mean_5"))
    return rounded(out.select("state", "year", "mean_5", "mean_10", "delta_5"), ["mean_5", "mean_10", "delta_5"])


@query("available_years", """SELECT state, count(DISTINCT geoid) AS n_counties, list_sort(list_distinct(list(year) FILTER (acres_planted_all IS NOT NULL))) AS years,
  max(max(year) FILTER (acres_planted_all IS NOT NULL)) OVER () AS default_year FROM fx_master WHERE forecast_date = 'EOS' GROUP BY state""")
def _(fx):
    from acrescope.operators.documents import available_years
    return available_years(joins.skeleton_cross(fx.survey), "geoid", "state", "acres_planted_all")


@query("anchor_entity", f"""SELECT state, year, forecast_date, arg_max(geoid, (acres_planted_all, geoid)) AS geoid, {fix_sql('max(acres_planted_all)')} AS acres
  FROM fx_ready WHERE complete AND acres_planted_all IS NOT NULL GROUP BY state, year, forecast_date""")
def _(fx):
    from acrescope.operators.documents import anchor_entity
    return rounded(anchor_entity(Forecasting.of(fx).ready, ["state", "year", "forecast_date"], "geoid", "acres_planted_all"), ["acres"])
