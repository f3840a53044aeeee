"""Queries: land-use family over class counts (image = supplier)."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S
from acrescope.operators import landuse as L
from acrescope.plans.catalog import query
from acrescope.plans.oracle_views import VIEWS
from acrescope.plans.rounding import fix_sql, rounded, rsql

_NAMES = list(K.LAND_CLASSES.values())
_ids = ", ".join(f"({i}, '{n}')" for i, n in K.LAND_CLASSES.items())
# written out, so that a changed constant shows as a difference
_fac = """('building', 65.0::DOUBLE, 'SRC-3', 600.0::DOUBLE, 'SRC-5', 'high'), ('road', 4.0, 'SRC-1', 220.0, 'SRC-5', 'medium'), ('water', 0.0, 'SRC-1', 0.0, 'SRC-1', 'medium'),
  ('barren', 0.0, 'SRC-4', 50.0, 'SRC-4', 'high'), ('forest', -8.0, 'SRC-1', 800.0, 'SRC-4', 'medium'), ('agriculture', 2.5, 'SRC-6', 150.0, 'SRC-4', 'medium')"""
VIEWS["fx_class"] = f"SELECT * FROM (VALUES {_ids}) AS t(class_id, class_name)"
VIEWS["fx_factor"] = f"SELECT class_id, t.* FROM (VALUES {_fac}) AS t(class_name, annual, annual_source, embodied, embodied_source, uncertainty) JOIN fx_class USING (class_name)"
VIEWS["fx_hist"] = """
SELECT i.image_id, c.class_id, c.class_name, CAST(coalesce(n.pixel_count, 0) AS BIGINT) AS pixel_count, CAST(sum(coalesce(n.pixel_count, 0)) OVER (PARTITION BY i.image_id) AS BIGINT) AS total
FROM (SELECT DISTINCT image_id FROM fx_classcount) i CROSS JOIN fx_class c LEFT JOIN fx_classcount n ON i.image_id = n.image_id AND c.class_id = n.class_id
"""
VIEWS["fx_pct"] = f"""
SELECT image_id, {', '.join(f"sum(100.0::DOUBLE * pixel_count / total) FILTER (class_name = '{n}') AS {n}" for n in _NAMES)}, any_value(total) * 0.000009 AS total_area_ha FROM fx_hist GROUP BY image_id
"""


@query("factor_table", """SELECT f.class_name, f.annual, f.embodied, f.annual_source, f.embodied_source, f.uncertainty, count(n.image_id) AS n_images
  FROM fx_factor f LEFT JOIN fx_classcount n ON f.class_id = n.class_id GROUP BY ALL""")
def _(fx):
    per = fx.classcount.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_images"))
    out = L.factor_table(fx.spark).join(per, "class_id", "left")
    return out.select("class_name", "annual", "embodied", "annual_source", "embodied_source", "uncertainty", F.coalesce("n_images", F.lit(0)).alias("n_images"))


@query("class_histogram", "SELECT image_id, class_id, class_name, pixel_count, round(100.0::DOUBLE * pixel_count / total, 4) AS percent FROM fx_hist")
def _(fx):
    return L.class_histogram(fx.classcount, "image_id", "class_id", "pixel_count").drop("total")


_E = ["area_ha", "annual_tco2e", "embodied_tco2e", "fraction"]


@query("emissions_per_class", f"""SELECT n.image_id, n.class_id, c.class_name, n.pixel_count, {fix_sql('n.pixel_count / sum(n.pixel_count) OVER (PARTITION BY n.image_id)')} AS fraction,
  {fix_sql('n.pixel_count * 0.000009')} AS area_ha, {fix_sql('n.pixel_count * 0.000009 * f.annual')} AS annual_tco2e, {fix_sql('n.pixel_count * 0.000009 * f.embodied')} AS embodied_tco2e
  FROM fx_classcount n JOIN fx_class c ON n.class_id = c.class_id LEFT JOIN fx_factor f ON n.class_id = f.class_id""")
def _(fx):
    return rounded(L.emissions_per_class(fx.classcount, "image_id"), _E)


_T = ["total_area_ha", "assessed_area_ha", "annual_tco2e", "embodied_tco2e", "excluded_fraction", "no_data_fraction", "background_fraction"]


@query("emissions_agg", f"""SELECT n.image_id, {fix_sql('sum(pixel_count) * 0.000009')} AS total_area_ha, {fix_sql('coalesce(sum(pixel_count) FILTER (n.class_id >= 2), 0) * 0.000009')} AS assessed_area_ha,
  {fix_sql('coalesce(sum(pixel_count * 0.000009 * annual), 0)')} AS annual_tco2e, {fix_sql('coalesce(sum(pixel_count * 0.000009 * embodied), 0)')} AS embodied_tco2e,
  {fix_sql('coalesce(sum(pixel_count) FILTER (n.class_id < 2), 0) / sum(pixel_count)')} AS excluded_fraction, {fix_sql('coalesce(sum(pixel_count) FILTER (n.class_id = 0), 0) / sum(pixel_count)')} AS no_data_fraction,
  {fix_sql('coalesce(sum(pixel_count) FILTER (n.class_id = 1), 0) / sum(pixel_count)')} AS background_fraction
  FROM fx_classcount n LEFT JOIN fx_factor f ON n.class_id = f.class_id GROUP BY n.image_id""")
def _(fx):
    return rounded(L.emissions_agg(fx.classcount, "image_id"), _T)


@query("factor_join", """SELECT image_id, list_sort(list_distinct(list(s))) AS sources, CAST(len(list_distinct(list(s))) AS INTEGER) AS n_sources FROM (
  SELECT n.image_id, unnest([f.annual_source, f.embodied_source]) AS s FROM fx_classcount n JOIN fx_factor f ON n.class_id = f.class_id WHERE pixel_count > 0) GROUP BY image_id""")
def _(fx):
    return L.factor_join(fx.classcount, "image_id")


_cit = ", ".join(f"('{k}', '{v}')" for k, v in K.CITATIONS.items())


@query("cited_sources", f"""SELECT source, citation, count(DISTINCT image_id) AS n_images FROM (
  SELECT n.image_id, unnest([f.annual_source, f.embodied_source]) AS source FROM fx_classcount n JOIN fx_factor f ON n.class_id = f.class_id WHERE pixel_count > 0)
  JOIN (VALUES {_cit}) AS c(source, citation) USING (source) GROUP BY ALL""")
def _(fx):
    return L.cited_sources(fx.classcount, "image_id")


_SCEN = [("forest", "agriculture", 0.5), ("agriculture", "forest", 1.0), ("building", "forest", 0.5)]
_q = lambda e: f"round_even(({e}) / 100.0 * 100000000, 0)"


def _sim_total(kind, after):
    parts = []
    for n, v in K.EMISSION_FACTORS.items():
        e = f"CASE WHEN from_class = '{n}' THEN {n} - shift WHEN to_class = '{n}' THEN {n} + shift ELSE {n} END" if after else n
        parts.append(f"{_q(e)} * (total_area_ha / 100000000) * {v[0] if kind == 'annual' else v[2]}")
    return " + ".join(parts)


VIEWS["fx_sim"] = f"""
SELECT image_id, from_class, to_class, fraction, shift / 100.0 * total_area_ha AS converted_ha, {_sim_total('annual', False)} AS before_annual, {_sim_total('annual', True)} AS after_annual,
  {_sim_total('embodied', False)} AS before_embodied, {_sim_total('embodied', True)} AS after_embodied
FROM (SELECT *, CASE from_class WHEN 'forest' THEN forest WHEN 'agriculture' THEN agriculture ELSE building END * fraction AS shift FROM fx_pct
  CROSS JOIN (VALUES {', '.join(f"('{a}', '{b}', {f}::DOUBLE)" for a, b, f in _SCEN)}) AS s(from_class, to_class, fraction))
WHERE CASE from_class WHEN 'forest' THEN forest WHEN 'agriculture' THEN agriculture ELSE building END > 0
"""
_SIM = ["converted_ha", "before_annual", "after_annual", "before_embodied", "after_embodied"]


@query("simulate_intervention", f"""SELECT image_id, from_class, to_class, fraction, {rsql(_SIM)}, {fix_sql('after_annual - before_annual')} AS delta_annual,
  {fix_sql('after_embodied - before_embodied')} AS delta_embodied FROM fx_sim""")
def _(fx):
    return rounded(L.simulate_intervention(L.percentages(fx.classcount, "image_id"), "image_id", _SCEN), [*_SIM, "delta_annual", "delta_embodied"])


@query("sign_label", """SELECT image_id, from_class, to_class, CASE WHEN after_annual - before_annual < -0.05 THEN 'reduction' WHEN after_annual - before_annual > 0.05 THEN 'increase' ELSE 'no change' END AS effect,
  CASE WHEN before_annual < -0.5 THEN 'sink' WHEN before_annual > 0.5 THEN 'source' ELSE 'neutral' END AS sink_or_source,
  CASE WHEN after_annual > before_annual THEN '+' WHEN after_annual < before_annual THEN '-' ELSE '0' END AS direction FROM fx_sim""")
def _(fx):
    sim = L.simulate_intervention(L.percentages(fx.classcount, "image_id"), "image_id", _SCEN)
    return sim.select("image_id", "from_class", "to_class", L.effect_label("delta_annual").alias("effect"), L.sink_label("before_annual").alias("sink_or_source"),
                      S.signed_label("delta_annual", 0.0, "-", "+", "0").alias("direction"))


@query("narrative_text", """SELECT image_id, from_class, to_class, 'If ' || printf('%.2f', round_even(converted_ha, 2)) || ' ha of ' || from_class || ' (' || printf('%.0f', fraction * 100) || ' percent of it) became ' || to_class
  || ', yearly emissions would be ' || printf('%.2f', round_even(abs(after_annual - before_annual), 2)) || ' tCO2e ' || CASE WHEN after_annual - before_annual < 0 THEN 'less' ELSE 'more' END
  || ' and the stored carbon would move by ' || printf('%.2f', round_even(after_embodied - before_embodied, 2)) || ' tCO2e once.' AS narrative FROM fx_sim""")
def _(fx):
    sim = L.narrative(L.simulate_intervention(L.percentages(fx.classcount, "image_id"), "image_id", _SCEN))
    return sim.select("image_id", "from_class", "to_class", "narrative")


def _rank_sql(score):
    pairs = []
    for seq, (a, b) in enumerate((a, b) for a in sorted(K.EMISSION_FACTORS) for b in sorted(K.EMISSION_FACTORS) if a != b):
        ra, rb = K.EMISSION_FACTORS[a], K.EMISSION_FACTORS[b]
        pairs.append(f"""SELECT image_id, {seq} AS seq, '{a}' AS from_class, '{b}' AS to_class, round_even({a} / 100.0 * total_area_ha, 3) AS available_ha,
          round_even({a} / 100.0 * total_area_ha * ({rb[0]} - {ra[0]}), 2) AS annual_delta, round_even({a} / 100.0 * total_area_ha * ({rb[2]} - {ra[2]}), 2) AS embodied_delta FROM fx_pct WHERE {a} > 0""")
    union = " UNION ALL ".join(pairs)
    return f"""SELECT image_id, CAST(rank AS INTEGER) AS rank, from_class, to_class, available_ha, annual_delta, embodied_delta FROM (
      SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {score}, seq) AS rank FROM ({union})) WHERE rank <= 5"""


@query("rank_interventions", _rank_sql("annual_delta * 20.0 + embodied_delta"))
def _(fx):
    return L.rank_interventions(L.percentages(fx.classcount, "image_id"), "image_id", "balanced")


@query("rank_interventions_annual", _rank_sql("annual_delta"))
def _(fx):
    return L.rank_interventions(L.percentages(fx.classcount, "image_id"), "image_id", "annual")


@query("missing_classes", f"""SELECT image_id, list_filter(['agriculture', 'barren', 'building', 'forest', 'road', 'water'],
  lambda x: NOT list_contains(list(class_name) FILTER (pixel_count > 0), x)) AS missing FROM fx_hist GROUP BY image_id""")
def _(fx):
    return L.missing_classes(L.percentages(fx.classcount, "image_id"), "image_id")


@query("land_breakdown", """SELECT image_id, list_sort(list(class_name || '=' || printf('%.2f', round_even(100.0::DOUBLE * pixel_count / total, 2))) FILTER (round_even(100.0::DOUBLE * pixel_count / total, 2) > 0)) AS shares, CAST(count(*) FILTER (round_even(100.0::DOUBLE * pixel_count / total, 2) > 0) AS INTEGER) AS n_classes, arg_max(class_name, (pixel_count, -class_id)) AS dominant_class,
  round_even(any_value(total) * 0.000009::DOUBLE, 3) AS total_area_ha, round_even(sum(pixel_count) FILTER (class_id >= 2) * 0.000009::DOUBLE, 3) AS assessed_area_ha,
  round_even(sum(pixel_count) FILTER (class_id < 2) / any_value(total), 4) AS excluded_fraction FROM fx_hist GROUP BY image_id""")
def _(fx):
    shares = F.transform(F.map_entries("percentages"), lambda e: F.format_string("%s=%.2f", e["key"], e["value"]))
    out = L.land_breakdown(L.percentages(fx.classcount, "image_id"), "image_id")
    return out.withColumn("shares", F.sort_array(shares)).drop("percentages")


@query("caveat_rules", f"""SELECT image_id, list_filter([{', '.join(f"CASE WHEN {n} > {t} THEN '{x}' END" for n, (t, x) in K.MIX_CAVEATS.items())}], lambda x: x IS NOT NULL) AS caveats,
  list_filter([{', '.join(f"CASE WHEN {n} > 0 THEN '{x}' END" for n, x in K.CLASS_ASSUMPTIONS.items())}], lambda x: x IS NOT NULL) AS assumptions FROM fx_pct""")
def _(fx):
    return L.caveat_rules(L.percentages(fx.classcount, "image_id"), "image_id")


@query("pct_sum_check", f"SELECT image_id, {fix_sql(' + '.join(_NAMES))} AS pct_sum, ({' + '.join(_NAMES)}) BETWEEN 95 AND 105 AS sane FROM fx_pct")
def _(fx):
    return rounded(L.pct_sum_check(L.percentages(fx.classcount, "image_id"), "image_id"), ["pct_sum"])


_SPLIT = "SELECT *, CASE WHEN image_id % 5 < 4 THEN 'Train' ELSE 'Val' END AS split, CASE WHEN image_id % 2 = 0 THEN 'Urban' ELSE 'Rural' END AS scene FROM fx_classcount"


def _split(fx):
    return fx.classcount.withColumns({
        "split": F.when(F.col("image_id") % 5 < 4, "Train").otherwise("Val"), "scene": F.when(F.col("image_id") % 2 == 0, "Urban").otherwise("Rural")})


@query("corpus_class_stats", f"""SELECT split, scene, class_id, pixels, n_present, n_images, {fix_sql('share')} AS share, {fix_sql('share / min(share) OVER (PARTITION BY split, scene)')} AS vs_rarest,
  {fix_sql('n_present / n_images')} AS presence FROM (
  SELECT split, scene, class_id, CAST(sum(pixel_count) AS BIGINT) AS pixels, count(*) FILTER (pixel_count > 0) AS n_present,
    sum(pixel_count) / sum(sum(pixel_count)) OVER (PARTITION BY split, scene) AS share FROM ({_SPLIT}) GROUP BY split, scene, class_id)
  JOIN (SELECT split, scene, count(DISTINCT image_id) AS n_images FROM ({_SPLIT}) GROUP BY ALL) USING (split, scene)""")
def _(fx):
    return rounded(L.corpus_class_stats(_split(fx), "image_id", ["split", "scene"]), ["share", "vs_rarest", "presence"])


@query("domain_ratio", f"""SELECT class_id, {fix_sql('a')} AS freq_a, {fix_sql('b')} AS freq_b, {fix_sql('a / b')} AS ratio FROM (
  SELECT class_id, sum(pixel_count) FILTER (scene = 'Urban') / sum(sum(pixel_count) FILTER (scene = 'Urban')) OVER () AS a,
    sum(pixel_count) FILTER (scene = 'Rural') / sum(sum(pixel_count) FILTER (scene = 'Rural')) OVER () AS b FROM ({_SPLIT}) WHERE split = 'Train' GROUP BY class_id)""")
def _(fx):
    return rounded(L.domain_ratio(_split(fx).where("split = 'Train'"), "scene", "Urban", "Rural"), ["freq_a", "freq_b", "ratio"])


@query("class_weights", f"""SELECT class_id, {fix_sql('freq')} AS freq, {fix_sql('(1.0 / freq) / avg(1.0 / freq) OVER ()')} AS inverse_freq,
  {fix_sql('(med / freq) / avg(med / freq) OVER ()')} AS median_freq FROM (SELECT *, quantile_cont(freq, 0.5) OVER () AS med FROM (
  SELECT class_id, sum(pixel_count) / sum(sum(pixel_count)) OVER () AS freq FROM fx_classcount WHERE class_id <> 0 GROUP BY class_id))""")
def _(fx):
    return rounded(L.class_weights(fx.classcount), ["freq", "inverse_freq", "median_freq"])


@query("class_rank", f"""SELECT class_id, CAST(sum(pixel_count) AS BIGINT) AS pixels, CAST(rank() OVER (ORDER BY sum(pixel_count) DESC) AS INTEGER) AS rank,
  {fix_sql('sum(pixel_count) / min(sum(pixel_count)) OVER ()')} AS vs_rarest FROM fx_classcount WHERE class_id <> 0 GROUP BY class_id""")
def _(fx):
    return rounded(L.class_rank(fx.classcount), ["vs_rarest"])


_PAIR = "SELECT l_linenumber AS target, CAST((l_linenumber + l_partkey % 3) % 8 AS INTEGER) AS predicted FROM lineitem"


@query("confusion_iou", f"""WITH p AS ({_PAIR}), i AS (SELECT c.class_id, count(*) FILTER (target = class_id AND predicted = class_id) AS tp,
    count(*) FILTER (target <> class_id AND predicted = class_id) AS fp, count(*) FILTER (target = class_id AND predicted <> class_id) AS fn
    FROM p CROSS JOIN fx_class c WHERE target <> 0 GROUP BY c.class_id),
  u AS (SELECT *, tp / nullif(tp + fp + fn, 0) AS iou FROM i)
  SELECT class_id, tp, fp, fn, {fix_sql('iou')} AS iou, {fix_sql('avg(iou) FILTER (class_id >= 1) OVER ()')} AS miou, {fix_sql('avg(iou) FILTER (class_id >= 2) OVER ()')} AS miou_no_background FROM u""")
def _(fx):
    t = fx.table("lineitem").select(F.col("l_linenumber").alias("target"), ((F.col("l_linenumber") + F.col("l_partkey") % 3) % 8).cast("int").alias("predicted"))
    return rounded(L.confusion_iou(t, "target", "predicted"), ["iou", "miou", "miou_no_background"])


_SC = """SELECT l_suppkey AS image_id, CASE l_partkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'h' ELSE 'v' END AS flip, l_orderkey % 8 AS r, l_partkey % 8 AS c, l_linenumber AS class_id,
  avg(l_discount) AS score FROM lineitem GROUP BY ALL"""


@query("tta_argmax", f"""SELECT image_id, r, c, class_id, {fix_sql('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id, r, c ORDER BY score DESC, class_id) AS rn FROM (
  SELECT image_id, CASE WHEN flip = 'v' THEN 7 - r ELSE r END AS r, CASE WHEN flip = 'h' THEN 7 - c ELSE c END AS c, class_id, round(avg(score), 9) AS score FROM ({_SC}) GROUP BY ALL)) WHERE rn = 1""")
def _(fx):
    flip = F.when(F.col("l_partkey") % 3 == 0, "none").when(F.col("l_partkey") % 3 == 1, "h").otherwise("v")
    s = fx.table("lineitem").groupBy(F.col("l_suppkey").alias("image_id"), flip.alias("flip"), (F.col("l_orderkey") % 8).alias("r"), (F.col("l_partkey") % 8).alias("c"),
                                     F.col("l_linenumber").alias("class_id")).agg(F.avg("l_discount").alias("score"))
    return rounded(L.tta_argmax(s, "image_id", 8, 8), ["score"])
