"""Queries: keys, codes, survey cleaning and text parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S
from acrescope.operators import joins, panel, survey
from acrescope.plans.catalog import query
from acrescope.plans.rounding import fix, fix_sql, rounded, rsql


@query("norm_geoid", """SELECT c_custkey, lpad(CAST(c_nationkey * 1000 + c_custkey % 999 AS VARCHAR), 5, '0') AS geoid,
  lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS fips FROM customer""")
def _(fx):
    raw = (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 999).cast("double").cast("string")
    return fx.table("customer").select("c_custkey", S.norm_geoid(raw).alias("geoid"),
                                       S.norm_geoid(F.col("c_nationkey").cast("string"), 2).alias("fips"))


@query("compose_key", """SELECT c_custkey, lpad(state_ansi, 2, '0') || lpad(county_ansi, 3, '0') AS geoid FROM fx_reported""")
def _(fx):
    return fx.reported.select("c_custkey", S.compose_key("state_ansi", "county_ansi").alias("geoid"))


_STATE = "CASE lpad(state_ansi, 2, '0') WHEN '08' THEN 'CO' WHEN '19' THEN 'IA' END"


@query("map_codes", f"""SELECT c_custkey, {_STATE} AS state_alpha, ({_STATE}) IS NULL AS unknown FROM fx_reported""")
def _(fx):
    alpha = S.map_codes(S.zfill("state_ansi", 2), K.STATES)
    return fx.reported.select("c_custkey", alpha.alias("state_alpha"), alpha.isNull().alias("unknown"))


_VALUE = """CASE WHEN upper(trim(replace(value, ',', ''))) IN ('(D)', '(NA)', '(Z)', '(X)') THEN NULL
   ELSE TRY_CAST(trim(replace(value, ',', '')) AS DOUBLE) END"""


@query("parse_reported_number", f"SELECT c_custkey, {_VALUE} AS parsed FROM fx_reported")
def _(fx):
    return fx.reported.select("c_custkey", S.parse_reported_number("value").alias("parsed"))


@query("drop_placeholders", """SELECT c_custkey, county_ansi, county_name FROM fx_reported
  WHERE trim(county_ansi) <> '' AND NOT starts_with(upper(county_name), 'OTHER')""")
def _(fx):
    return fx.reported.where(~S.is_placeholder("county_ansi", "county_name")).select("c_custkey", "county_ansi", "county_name")


_STAGE = """CASE lower(reference_period_desc) WHEN 'year' THEN 'Final' WHEN 'year - aug forecast' THEN 'Aug 1'
  WHEN 'year - sep forecast' THEN 'Sep 1' WHEN 'year - nov forecast' THEN 'Final' WHEN 'marketing year' THEN 'Final'
  WHEN 'mid oct report' THEN 'Oct 1' END"""
_RANK = """CASE lower(reference_period_desc) WHEN 'year' THEN 0 WHEN 'year - aug forecast' THEN 0
  WHEN 'year - sep forecast' THEN 0 WHEN 'year - nov forecast' THEN 3 WHEN 'marketing year' THEN 2
  WHEN 'mid oct report' THEN 9 ELSE 99 END"""


@query("stage_priority", f"SELECT c_custkey, {_STAGE} AS stage, {_RANK} AS priority FROM fx_reported")
def _(fx):
    stage, rank = S.stage_of_report("reference_period_desc")
    return fx.reported.select("c_custkey", stage.alias("stage"), rank.alias("priority"))


@query("priority_pick", f"""SELECT state_ansi, stage, parsed, priority FROM (
  SELECT state_ansi, {_STAGE} AS stage, {_VALUE} AS parsed, {_RANK} AS priority,
    row_number() OVER (PARTITION BY state_ansi, {_STAGE} ORDER BY {_RANK}, c_custkey) AS rn
  FROM fx_reported WHERE ({_VALUE}) IS NOT NULL AND ({_STAGE}) IS NOT NULL) WHERE rn = 1""")
def _(fx):
    return survey.priority_pick(fx.reported, "state_ansi", "value", "reference_period_desc", "c_custkey")


@query("stage_array", f"""SELECT state_ansi, list(stage ORDER BY seq) AS stages, list(round_even(parsed, 1) ORDER BY seq) AS reported FROM (
  SELECT state_ansi, stage, parsed, CASE stage WHEN 'Aug 1' THEN 0 WHEN 'Sep 1' THEN 1 WHEN 'Oct 1' THEN 2 ELSE 3 END AS seq FROM (
  SELECT state_ansi, {_STAGE} AS stage, {_VALUE} AS parsed,
    row_number() OVER (PARTITION BY state_ansi, {_STAGE} ORDER BY {_RANK}, c_custkey) AS rn
  FROM fx_reported WHERE ({_VALUE}) IS NOT NULL AND ({_STAGE}) IS NOT NULL) WHERE rn = 1) GROUP BY state_ansi""")
def _(fx):
    return survey.stage_array(survey.priority_pick(fx.reported, "state_ansi", "value", "reference_period_desc", "c_custkey"), "state_ansi")


@query("county_finals", f"""SELECT state_ansi, count(*) FILTER (parsed IS NOT NULL) AS n_counties, count(*) FILTER (parsed IS NULL) AS n_missing,
  {fix_sql('avg(parsed)')} AS mean_yield, round_even(min(parsed), 1) AS min_yield, round_even(max(parsed), 1) AS max_yield
  FROM (SELECT state_ansi, {_VALUE} AS parsed FROM fx_reported
        WHERE trim(county_ansi) <> '' AND NOT starts_with(upper(county_name), 'OTHER')) GROUP BY state_ansi""")
def _(fx):
    return rounded(survey.county_finals(fx.reported), ["mean_yield"])


@query("label_fallback", """SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN 'FIPS ' || lpad(state_ansi, 2, '0') || lpad(county_ansi, 3, '0') || ', ' || state_ansi
   ELSE county_name END AS label, CASE WHEN c_custkey % 13 = 0 THEN 'Other (combined) Counties' ELSE county_name END AS title FROM fx_reported""")
def _(fx):
    name = F.when(~S.is_placeholder(F.lit("1"), "county_name"), F.col("county_name"))
    key = S.compose_key("state_ansi", "county_ansi")
    return fx.reported.select("c_custkey", S.label_fallback(name, key, "state_ansi").alias("label"),
                              F.initcap("county_name").alias("title"))


@query("shard_assign", """SELECT DISTINCT state, year,
  CAST(CAST(('0x' || substr(md5(state || '-' || year), 1, 16)) AS UBIGINT) % 4 AS INTEGER) + 1 AS shard FROM fx_panel""")
def _(fx):
    return fx.panel.select("state", "year").distinct().withColumn("shard", S.shard_of("state", "year", 4))


_RATIOS = ["irrigated_share", "acres_harvested_noirr_derived", "harvest_ratio"]


@query("ratio_clip", f"SELECT geoid, year, {rsql(_RATIOS)} FROM fx_survey")
def _(fx):
    return rounded(panel.ratio_clip(fx.panel), _RATIOS).select("geoid", "year", *_RATIOS)


@query("irrigation_stats", f"""SELECT state, {fix_sql('avg(irrigated_share)')} AS mean_share, {fix_sql('min(irrigated_share)')} AS min_share,
  {fix_sql('max(irrigated_share)')} AS max_share FROM fx_survey GROUP BY state""")
def _(fx):
    s = F.col("irrigated_share")
    return fx.survey.groupBy("state").agg(fix(F.avg(s)).alias("mean_share"), fix(F.min(s)).alias("min_share"), fix(F.max(s)).alias("max_share"))


@query("union_provenance", f"""SELECT geoid, year, 'reported' AS aux_provenance, {fix_sql('yield_target')} AS yield_target, {fix_sql('harvest_ratio')} AS harvest_ratio FROM fx_survey
  UNION ALL SELECT geoid, 2002, 'prior_year', NULL, {fix_sql('harvest_ratio')} FROM fx_survey WHERE year = 2001""")
def _(fx):
    out = panel.synthesize_year(fx.survey, 2002)
    return rounded(out, ["yield_target", "harvest_ratio"]).select("geoid", "year", "aux_provenance", "yield_target", "harvest_ratio")


@query("outer_metric_merge", f"""SELECT * FROM (SELECT geoid, state, year, {fix_sql("max(v) FILTER (m = 'R')")} AS yield_r, {fix_sql("max(v) FILTER (m = 'A')")} AS yield_a,
    {fix_sql("max(v) FILTER (m = 'N')")} AS yield_n
  FROM (SELECT geoid, state, y AS year, l_returnflag AS m, sum(l_extendedprice) / sum(l_quantity) AS v FROM fx_line GROUP BY ALL)
  GROUP BY geoid, state, year) WHERE yield_r IS NOT NULL OR yield_a IS NOT NULL""")
def _(fx):
    def one(flag):
        return fx.line.where(F.col("l_returnflag") == flag).groupBy("geoid", "state", F.col("y").alias("year")).agg(
            (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("v"))
    tables = {"yield_r": one("R"), "yield_a": one("A"), "yield_n": one("N")}
    return rounded(joins.outer_metric_merge(tables, ["geoid", "state", "year"], "v", ["yield_r", "yield_a"]), list(tables))


@query("first_per_key", """SELECT geoid, year, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (
  SELECT *, row_number() OVER (PARTITION BY geoid, y ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, y AS year FROM fx_line) WHERE rn = 1""")
def _(fx):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = survey.first_per_key(fx.line.withColumnRenamed("y", "year").select("geoid", "year", *order), ["geoid", "year"], order)
    return out.drop("l_extendedprice")
