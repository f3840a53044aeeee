"""Queries: weather, drought and calendar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope.functions import scalars as S
from acrescope.operators import joins, weather
from acrescope.plans.catalog import query
from acrescope.plans.oracle_views import GDD, degree_hours_sql
from acrescope.plans.rounding import fix, fix_sql, rounded, rsql

KEYS = ["geoid", "state", "year"]


@query("gdd_capped", f"SELECT geoid, date, {fix_sql(GDD)} AS gdd FROM fx_daily")
def _(fx):
    return fx.daily.select("geoid", "date", fix(S.gdd_capped("tmin_c", "tmax_c"), 6).alias("gdd"))


@query("degree_hours", f"SELECT geoid, date, {fix_sql(degree_hours_sql(86.0))} AS dh86, {fix_sql(degree_hours_sql(90.0))} AS dh90 FROM fx_daily")
def _(fx):
    return fx.daily.select("geoid", "date", fix(S.degree_hours("tmin_c", "tmax_c", 86.0), 6).alias("dh86"),
                           fix(S.degree_hours("tmin_c", "tmax_c", 90.0), 6).alias("dh90"))


@query("cutoff_range_join", """SELECT forecast_date, year, count(*) AS n_rows, count(DISTINCT geoid) AS n_entities,
  min(date) AS first_day, max(date) AS last_day FROM fx_season GROUP BY ALL""")
def _(fx):
    return weather.cutoff_range_join(fx.daily, KEYS).groupBy("forecast_date", "year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("geoid").alias("n_entities"),
        F.min("date").alias("first_day"), F.max("date").alias("last_day"))


_CUM = ["gdd_cum_f50_c86", "edd_hours_gt86f", "edd_hours_gt90f", "prcp_cum_mm"]
_PHASE = [f"{m}_{p}" for m in ("vpd_kpa", "srad_total") for p in ("veg", "silk", "grain")]


@query("season_cumulative", f"SELECT geoid, state, year, forecast_date, {rsql(_CUM)} FROM fx_cumulative")
def _(fx):
    return rounded(weather.season_cumulative(fx.daily, KEYS), _CUM)


@query("phase_window_agg", f"SELECT geoid, state, year, forecast_date, {rsql(_PHASE)} FROM fx_phase")
def _(fx):
    return rounded(weather.phase_window_agg(fx.daily, KEYS), _PHASE)


@query("longest_run", "SELECT geoid, state, year, forecast_date, dry_spell_max_days FROM fx_dry")
def _(fx):
    return weather.longest_run(fx.daily, KEYS)


_W11 = [*_CUM, *_PHASE, "dry_spell_max_days"]


@query("season_features", f"SELECT geoid, state, year, forecast_date, {rsql(_W11)} FROM fx_weather")
def _(fx):
    return rounded(weather.season_features(fx.daily, KEYS), _W11)


@query("cutoff_date", """SELECT geoid, year, forecast_date, cutoff,
  CASE WHEN forecast_date = 'EOS' THEN make_date(year, 11, 15) ELSE cutoff END AS chip_cutoff
  FROM fx_panel JOIN fx_cutoffs USING (year)""")
def _(fx):
    from acrescope import constants as K
    return joins.skeleton_cross(fx.panel.select("geoid", "year")).select(
        "geoid", "year", "forecast_date", S.cutoff_date("year", "forecast_date").alias("cutoff"),
        S.cutoff_date("year", "forecast_date", K.CHIP_CUTOFF_MD).alias("chip_cutoff"))


_D = [f"d{i}_pct" for i in range(5)] + ["d2plus"]


@query("asof_strict", f"SELECT state, year, forecast_date, valid_end, {rsql(_D)} FROM fx_drought")
def _(fx):
    return rounded(fx.drought, _D)


@query("broadcast_state", f"""SELECT p.geoid, p.year, d.forecast_date, {rsql(['d.' + c for c in _D])}
  FROM fx_panel p LEFT JOIN fx_drought d ON p.state = d.state AND p.year = d.year""")
def _(fx):
    out = joins.broadcast_state(fx.panel.select("geoid", "state", "year"), fx.drought, ["state", "year"])
    return rounded(out.select("geoid", "year", "forecast_date", *_D), _D)


@query("unit_convert", f"""SELECT geoid, date, {fix_sql("tmin_c + 273.15 - 273.15")} AS tmin_c, {fix_sql("tmax_c * 9.0 / 5.0 + 32.0")} AS tmax_f,
  {fix_sql("srad_mjm2 * 0.0864")} AS srad_mj_day, {fix_sql("vpd_kpa * 1e-4", 8)} AS reflectance FROM fx_daily""")
def _(fx):
    return fx.daily.select("geoid", "date", fix(S.kelvin_to_c(F.col("tmin_c") + 273.15), 6).alias("tmin_c"),
                           fix(S.c_to_f("tmax_c"), 6).alias("tmax_f"),
                           fix(S.watts_to_mj_day("srad_mjm2"), 6).alias("srad_mj_day"),
                           fix(S.reflectance("vpd_kpa"), 8).alias("reflectance"))
