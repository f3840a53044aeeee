"""Invariants: leakage, as-of rule, exact search and quantiles under skew."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.operators import chips, cone, documents, joins, knn, landuse, panel, quantiles, raster, survey, trend, weather

KEYS = ["geoid", "year"]


def days(spark, rows):
    return spark.createDataFrame([("00001", y, dt.date(y, m, d), lo, hi, rain, 10.0, 1.0) for y, m, d, lo, hi, rain in rows],
                                 "geoid string, year int, date date, tmin_c double, tmax_c double, prcp_mm double, srad_mjm2 double, vpd_kpa double")


def season(y=2018):
    start = dt.date(y, 4, 20)
    return [(y, *(start + dt.timedelta(i)).timetuple()[1:3], 10.0 + i % 7, 25.0 + i % 11, 0.0 if i % 9 else 5.0) for i in range(230)]


def test_no_leakage_past_a_cutoff(spark):
    before = {r.forecast_date: r for r in weather.season_features(days(spark, season()), KEYS).collect()}
    changed = [(y, m, d, lo, hi, rain) if (m, d) < (9, 1) else (y, m, d, lo + 20, hi + 20, 50.0) for y, m, d, lo, hi, rain in season()]
    after = {r.forecast_date: r for r in weather.season_features(days(spark, changed), KEYS).collect()}
    assert before["08-01"] == after["08-01"] and before["09-01"] == after["09-01"]
    assert before["10-01"] != after["10-01"]
    assert before["08-01"].vpd_kpa_grain is None


def test_season_features_agree_with_the_separate_operators(spark):
    df = days(spark, season())
    whole = weather.season_features(df, KEYS).orderBy("forecast_date").collect()
    for part in (weather.season_cumulative, weather.phase_window_agg, weather.longest_run):
        for a, b in zip(part(df, KEYS).orderBy("forecast_date").collect(), whole):
            for name in a.asDict():
                assert a[name] == pytest.approx(b[name]) if isinstance(a[name], float) else a[name] == b[name]


def test_longest_run_ignores_gaps_and_counts_null_as_wet(spark):
    rows = [(2018, 5, 1, 1.0, 2.0, 0.0), (2018, 5, 9, 1.0, 2.0, 0.0), (2018, 5, 10, 1.0, 2.0, None), (2018, 5, 11, 1.0, 2.0, 1.9), (2018, 8, 1, 1.0, 2.0, 0.0)]
    got = {r.forecast_date: r.dry_spell_max_days for r in weather.longest_run(days(spark, rows), KEYS).collect()}
    assert got == {"08-01": 2.0, "09-01": 2.0, "10-01": 2.0, "EOS": 2.0}


def test_asof_is_strict_and_carries_over_years(spark):
    rows = [("IA", dt.date(2017, 12, 30), 1.0), ("IA", dt.date(2018, 7, 31), 2.0), ("IA", dt.date(2018, 8, 1), 3.0), ("NE", dt.date(2018, 12, 1), 9.0)]
    readings = spark.createDataFrame(rows, "state string, valid_end date, d0 double")
    years = spark.createDataFrame([(s, y) for s in ("IA", "NE") for y in (2018, 2019)], "state string, year int")
    got = {(r.state, r.year, r.forecast_date): r.d0 for r in joins.asof_strict(readings, "state", "valid_end", ["d0"], years).collect()}
    assert got[("IA", 2018, "08-01")] == 2.0 and got[("IA", 2018, "09-01")] == 3.0 and got[("IA", 2019, "08-01")] == 3.0
    assert ("NE", 2018, "EOS") not in got and got[("NE", 2019, "08-01")] == 9.0


def test_left_join_checked_fails_on_fan_out(spark):
    left, right = spark.range(3), spark.createDataFrame([(1, "a"), (1, "b")], "id long, v string")
    with pytest.raises(PySparkException, match="duplicate key"):
        joins.left_join_checked(left, right, ["id"]).collect()
    assert joins.left_join_checked(left, right.where("v = 'a'"), ["id"]).count() == 3


def brute_force(q, c, k, rule, metric):
    out = {}
    for qg, qy, qv in q:
        found = []
        for cg, cy, cv in c:
            if (cy == qy) if rule == "other" else (cy >= qy):
                continue
            a, b = np.array(qv), np.array(cv)
            if metric == "cosine":
                n = np.linalg.norm(a) * np.linalg.norm(b)
                d = 1 - a @ b / (n or 1.0)
            else:
                d = np.sqrt(((a - b) ** 2).sum())
            found.append((round(d, 9) + 0.0, cg, cy))
        out[(qg, qy)] = sorted(found)[:k]
    return out


@pytest.mark.parametrize("rule,metric", [("other", "euclidean"), ("past", "euclidean"), ("past", "cosine")])
def test_knn_is_exact_with_hot_copies_and_small_blocks(spark, rule, metric):
    """A third of the candidates are copies of one vector; blocks hold 40 rows."""
    rng = np.random.default_rng(7)
    vecs = rng.integers(-3, 4, size=(240, 3)).astype(float)
    vecs[:80] = [1.0, 1.0, 0.0]
    vecs[80] = 0.0
    rows = [(f"{i:05d}", 2000 + i % 6, v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame([("x", *r) for r in rows], "g string, geoid string, year int, vec array<double>")
    got = knn.knn_join(df, df, ["g"], 4, ["geoid", "year"], ["geoid", "year"], rule=rule, metric=metric, pivots=5, block=40).collect()
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault((r.q_geoid, r.q_year), []).append((r.distance + 0.0, r.geoid, r.year))
    want = {key: v for key, v in brute_force(rows, rows, 4, rule, metric).items() if v}
    assert set(found) == set(want)
    for key, items in want.items():
        assert [x[0] for x in found[key]] == pytest.approx([x[0] for x in items], abs=2e-9)
        if metric == "euclidean":
            assert found[key] == items


@pytest.mark.parametrize("n", [9, 40_000])
def test_quantiles_are_exact_under_skew(spark, n):
    """Half of the big group is one value."""
    rng = np.random.default_rng(3)
    values = np.concatenate([np.full(n // 2, 5.0), rng.normal(size=n - n // 2)])
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": values}))
    got = {r.prob: r["quantile"] for r in quantiles.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9, 0.97]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.percentile(values, p * 100), abs=1e-9)
    assert len(got) == 4


def test_lookback_skips_holdout_and_missing_years(spark):
    rows = [("a", "S", y, 100.0 + y if y != 2003 else None, 1.0) for y in range(2000, 2008)]
    df = spark.createDataFrame(rows, "geoid string, state string, year int, yield_target double, acres_planted_all double")
    got = {r.year: r.mean_5 for r in cone.lookback_mean(df, "geoid", (5,), skip_years=(2006,)).collect()}
    assert got[2002] is None and got[2004] == pytest.approx(100 + (2000 + 2001 + 2002) / 3)
    assert got[2007] == pytest.approx(100 + (2000 + 2001 + 2002 + 2004 + 2005) / 5)


def test_trend_falls_back_to_the_state_median(spark):
    rows = [(g, "S", y, s * y) for g, s in (("a", 1.0), ("b", 2.0), ("c", 9.0)) for y in range(2000, 2006)] + [("d", "S", 2001, 5.0)]
    df = spark.createDataFrame(rows, "geoid string, state string, year int, yield_target double")
    fits = trend.ols_trend(df, "geoid", "state")
    got = {r.geoid: (r.slope, r.own_fit) for r in trend.trend_params(df, fits, "geoid", "state").collect()}
    assert got["d"][0] == pytest.approx(2.0) and got["d"][1] is False and got["c"][0] == pytest.approx(9.0)


def test_strict_standardizer_raises_lenient_does_not(spark):
    df = spark.createDataFrame([("08-01", 1.0, 2.0), ("08-01", 1.0, None)], "forecast_date string, a double, b double")
    with pytest.raises(PySparkException, match="cannot standardise"):
        trend.standardizer_fit(df, {"08-01": ["a", "b"]}).collect()
    params = trend.standardizer_fit(df, {"08-01": ["a", "b"]}, strict=False)
    assert [r.vec for r in trend.zscore(df, params, {"08-01": ["a", "b"]}, lenient=True).collect()][1][0] == 0.0


def test_quantiles_do_not_bring_the_rows_of_a_group_together(spark):
    df = spark.range(40_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 40_000).cast("double").alias("v"))
    out = quantiles.exact_quantiles(df, ["g"], "v", [0.25, 0.5])
    got = {(r.g, r.prob): r.quantile for r in out.collect()}
    want = {(g, p): float(np.quantile(np.arange(g, 40_000, 2), p)) for g in (0, 1) for p in (0.25, 0.5)}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(g#\d+L?, \d+\)", plan)  # rows dealt by their group alone


def test_constant_features_take_no_part_in_vectors(spark):
    from acrescope.plans.fixtures import CONTRACT
    from acrescope.plans.forecasting import Forecasting

    columns = list(dict.fromkeys(c for cols in CONTRACT.values() for c in cols))
    rows = [(d, *[0.1 if c in ("gdd_cum_f50_c86", "dry_spell_max_days") else float(k + i) for i, c in enumerate(columns)]) for d in CONTRACT for k in range(3)]
    f = Forecasting(None)
    f.__dict__["train"] = spark.createDataFrame(rows, ["forecast_date", *columns])  # stands in for the cached pool
    flat = {r.feature for r in f.std.where("std = 0").collect()}
    assert flat == {"gdd_cum_f50_c86", "dry_spell_max_days"} and f.std.count() == sum(map(len, CONTRACT.values()))
    later = f.train.withColumn("dry_spell_max_days", F.lit(40.0))  # a year unlike those of the training pool
    got = trend.zscore(later, f.std, CONTRACT).where("forecast_date = 'EOS'").collect()
    at = [CONTRACT["EOS"].index(c) for c in ("gdd_cum_f50_c86", "dry_spell_max_days")]
    assert {r.vec[i] for r in got for i in at} == {0.0} and len({tuple(r.vec) for r in got}) == 3
    with pytest.raises(PySparkException, match="missing dry_spell_max_days"):
        trend.zscore(f.train.withColumn("dry_spell_max_days", F.lit(None).cast("double")), f.std, CONTRACT).collect()
    with pytest.raises(PySparkException, match="cannot standardise a"):
        trend.standardizer_fit(spark.createDataFrame([("08-01", 1.0)], "forecast_date string, a double"), {"08-01": ["a"]}).collect()


def test_spread_of_rounding_alone_is_no_spread(spark):
    sums = [0.1 + 0.2 + 0.3, 0.3 + 0.2 + 0.1, 0.1 + 0.2 + 0.3]  # equal terms added in other orders
    df = spark.createDataFrame([("08-01", x, 1e-3 * k) for k, x in enumerate(sums)], "forecast_date string, a double, b double")
    params = trend.standardizer_fit(df, {"08-01": ["a", "b"]}, constant=True)
    std = {r.feature: r["std"] for r in params.collect()}
    assert len(set(sums)) == 2 and std["a"] == 0.0 and std["b"] > 0
    assert {r.vec[0] for r in trend.zscore(df, params, {"08-01": ["a", "b"]}).collect()} == {0.0}


def test_synthesized_year_copies_the_prior_one(spark):
    df = spark.createDataFrame([("a", 2023, 1.0, 9.0), ("a", 2024, 2.0, 8.0)], "geoid string, year int, yield_target double, acres double")
    row = panel.synthesize_year(df, 2025).where("year = 2025").first()
    assert row.yield_target is None and row.acres == 8.0 and row.aux_provenance == "prior_year"


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in survey.first_per_key(df, ["k"], ["o"]).collect()} == {"a": "y", "b": "z"}
    assert {r.k: r.v for r in survey.last_per_key(df, ["k"], ["o"]).collect()} == {"a": "x", "b": "z"}


# --- raster and chips --------------------------------------------------------
def test_best_window_equals_brute_force_on_a_sparse_grid(spark):
    rng = np.random.default_rng(1)
    grid = (rng.random((9, 12)) < 0.4).astype(int)
    cells = [("t", r, c, int(grid[r, c])) for r in range(9) for c in range(12) if grid[r, c] or (r, c) == (8, 11)]
    df = spark.createDataFrame(cells, "tile string, r long, c long, score int")
    row = raster.best_window_2d(df, "tile", 4, "score").first()
    sums = {(r, c): grid[r:r + 4, c:c + 4].sum() for r in range(6) for c in range(9)}
    best = max(sums.values())
    assert (row.best_count, (row.best_r, row.best_c)) == (best, min(k for k, v in sums.items() if v == best))
    assert raster.best_window_2d(df, "tile", 10, "score").count() == 0


def scene_rows(spark, rows):
    df = spark.createDataFrame(rows, "geoid string, year int, scene_date string, granule_id string, valid_pixel_frac double, corn_pixel_frac double")
    from acrescope.functions import scalars as S
    df = df.withColumn("scene_date", F.col("scene_date").cast("date"))
    return df.withColumn("phase", S.scene_phase("scene_date")).withColumn("chip_path", F.col("granule_id"))


def test_chip_sequence_pads_from_the_newest_pick_and_prefers_quality(spark):
    rows = scene_rows(spark, [
        ("00001", 2018, "2018-07-20", "old-good", 0.9, 0.5), ("00001", 2018, "2018-07-30", "new-bad", 0.1, 0.5),
        ("00001", 2018, "2018-09-01", "at-cutoff", 0.9, 0.5), ("00001", 2018, "2018-10-20", "final", 0.9, 0.5)])
    seq = chips.chip_sequence(rows, "geoid").orderBy("forecast_date", "step").collect()
    at = lambda d: [(r.granule_id, r.is_padded) for r in seq if r.forecast_date == d]
    assert at("08-01") == [("old-good", False), ("old-good", True), ("old-good", True)]
    assert at("09-01") == at("08-01")  # a scene on the cutoff day is not seen
    assert at("EOS") == [("old-good", False), ("at-cutoff", False), ("final", False)]
    qc = {r.forecast_date: r for r in chips.chip_qc(chips.chip_sequence(rows, "geoid"), "geoid").collect()}
    assert qc["08-01"].chip_count == 1 and qc["08-01"].chip_age_days_max == 12 and qc["08-01"].cloud_pct_max == pytest.approx(10.0)


def test_skip_reasons_in_order(spark):
    cells = [("small", 0, 0, 1, 0)] + [("nocrop", r, c, 2, 0) for r in range(4) for c in range(4)] \
        + [("cloud", r, c, 1, 2) for r in range(4) for c in range(4)] + [("good", r, c, 1, 0) for r in range(4) for c in range(4)]
    df = spark.createDataFrame(cells, "tile string, r long, c long, class_code int, qa int")
    got = {r.tile: r.skip_reason for r in raster.chip_decision(df, "tile", 4).collect()}
    assert got == {"small": "county_not_in_granule", "nocrop": "no_cdl_overlap", "cloud": "all_cloud", "good": None}
    assert {v for v in got.values() if v} <= set(K.SKIP_REASONS)


# --- land use ----------------------------------------------------------------
def composition(spark, area, **pct):
    cols = [F.lit("img").alias("image"), F.lit(area).alias("total_area_ha")] + [F.lit(float(pct.get(n, 0.0))).alias(n) for n in K.LAND_CLASSES.values()]
    return spark.range(1).select(*cols)


def test_known_conversions(spark):
    mix = composition(spark, 9.437, background=21.46, water=1.11, forest=72.24, agriculture=3.73)
    half = landuse.simulate_intervention(mix, "image", [("forest", "agriculture", 0.5)]).first()
    assert half.converted_ha == pytest.approx(3.41, abs=0.02)
    parcel = composition(spark, 0.35158, agriculture=100.0)
    whole = landuse.simulate_intervention(parcel, "image", [("agriculture", "forest", 1.0)]).first()
    assert whole.delta_annual == pytest.approx(-3.69, abs=0.01) and whole.delta_embodied == pytest.approx(228.53, abs=0.01)
    house = landuse.simulate_intervention(composition(spark, 0.0491, building=100.0), "image", [("building", "forest", 0.5)]).first()
    assert house.delta_annual == pytest.approx(-1.79, abs=0.01) and house.delta_embodied == pytest.approx(4.91, abs=0.01)


def test_bad_scenarios_raise_and_absent_classes_are_left_out(spark):
    mix = composition(spark, 1.0, forest=100.0)
    for bad in (("forest", "forest", 0.5), ("background", "forest", 0.5), ("forest", "road", 1.5)):
        with pytest.raises(ValueError):
            landuse.simulate_intervention(mix, "image", [bad])
    assert landuse.simulate_intervention(mix, "image", [("road", "forest", 0.5)]).count() == 0


def test_narrative(spark):
    mix = composition(spark, 10.0, agriculture=100.0)
    text = landuse.narrative(landuse.simulate_intervention(mix, "image", [("agriculture", "forest", 0.5)])).first().narrative
    assert text == ("If 5.00 ha of agriculture (50 percent of it) became forest, yearly emissions would be 52.50 tCO2e less "
                    "and the stored carbon would move by 3250.00 tCO2e once.")


def test_neighbour_blocks_copy_candidates_by_the_queries_of_their_own_cell(spark):
    """Queries crowd in cell 0: only its candidates meet more than one block of queries."""
    from acrescope.operators import knn

    reach = spark.range(400).selectExpr("'d' AS g", "id AS q_id", "array(double(id)) AS _v", "CASE WHEN id < 395 THEN 0 ELSE 1 END AS _cell", "1 AS _salts")
    placed = spark.range(200).selectExpr("'d' AS g", "id", "array(double(id)) AS _v", "int(id % 2) AS _cell", "0.0 AS _r")
    queries, candidates = knn.blocks(reach, placed, ["g"], ["q_id"], ["id"], 50)
    copies = {r["_cell"]: r["n"] for r in candidates.groupBy("_cell").agg(F.count("*").alias("n")).collect()}
    assert copies == {0: 100 * 8, 1: 100}
    assert queries.count() == 400


def test_profile_slices_expand_once(spark):
    rows = [("a", 1, "x", 1.0), ("a", 1, "y", None), ("b", 1, "x", 2.0), ("c", None, "x", None)]
    df = spark.createDataFrame(rows, "geoid string, year int, state string, v double")
    out = documents.profile_slices(df, {"all": [], "year": ["year"], "both": ["state", "year"]}, "geoid", ["v"])
    got = {(r.slice, r.year, r.state): (r.n_rows, r.n_entities, r.v_known_pct) for r in out.collect()}
    assert got == {("all", None, None): (4, 3, 50.0), ("year", 1, None): (3, 2, pytest.approx(200 / 3)), ("year", None, None): (1, 1, 0.0),
                   ("both", 1, "x"): (2, 2, 100.0), ("both", 1, "y"): (1, 1, 0.0), ("both", None, "x"): (1, 1, 0.0)}
    assert sum(line.count("Scan") for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines()) <= 1
    counts = {(r.column, r.value): r.n for r in documents.value_counts(df, ["year", "state"]).collect()}
    assert counts == {("year", "1"): 3, ("year", None): 1, ("state", "x"): 3, ("state", "y"): 1}


def test_a_huge_box_adds_one_grid(spark):
    rng = np.random.default_rng(6)
    box = lambda i, x, y, w, h: (i, float(x), float(x + w), float(y), float(y + h))
    a = [box(i, *rng.uniform(-50, 50, 2), *rng.uniform(0, 3, 2)) for i in range(60)] + [box(60, -1e6, -1e6, 2e6, 2e6), (61, None, None, None, None)]
    b = [box(i, *rng.uniform(-50, 50, 2), *rng.uniform(0, 9, 2)) for i in range(40)] + [box(40, 3e5, 3e5, 1.0, 1.0)]
    frame = lambda rows, p: spark.createDataFrame(rows, f"{p}_id int, {p}_xmin double, {p}_xmax double, {p}_ymin double, {p}_ymax double")
    got = sorted((r.a_id, r.b_id) for r in joins.bbox_overlap_join(frame(a, "a"), frame(b, "b"), 1.0).collect())
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] <= y[2] and y[1] <= x[2] and x[3] <= y[4] and y[3] <= x[4])
    assert got == want and sum(i == 60 for i, _ in got) == 41
    assert joins.bbox_overlap_join(frame(a, "a").limit(0), frame(b, "b").limit(0), 1.0).count() == 0
