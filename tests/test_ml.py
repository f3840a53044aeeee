import shutil
from itertools import combinations
from math import factorial
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrescope.operators import boosting, hybrid, ml
from acrescope.sources import bundles


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    y = 3 * x[:, 0] - 2 * np.maximum(x[:, 1], 0) + rng.normal(scale=0.1, size=300)
    rows = [(i, "EOS", *map(float, x[i]), float(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "id long, forecast_date string, a double, b double, c double, d double, y double")


COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def training(table):
    return boosting.Training.write(table.where("id < 200"), table.where("id >= 200"), {"EOS": COLS}, "y")


@pytest.fixture(scope="module")
def model(spark, training):
    return boosting.fit_rounds(training.rows(spark, "EOS", False), 6, max_depth=4)


@pytest.fixture(scope="module")
def attributions(spark, table, model, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("bundle"))
    bundles.save_bundle(spark, root, {"EOS": model}, {"EOS": COLS}, {})
    saved = bundles.load_bundle(spark, root, {"EOS": COLS})
    return ml.tree_attribution(table, model, bundles.tree_nodes(spark, saved.folder, ["EOS"]), COLS, ["id"]).persist()


def test_attribution_is_additive(table, model, attributions):
    got = {r.id: (r.s, r.p) for r in attributions.groupBy("id").agg((F.sum("attribution") + F.first("base_value")).alias("s"), F.first("prediction").alias("p")).collect()}
    want = {r.id: r.prediction for r in ml.gbt_predict(table, {"EOS": model}, {"EOS": COLS}).collect()}
    assert max(abs(got[i][0] - want[i]) for i in want) < 1e-6
    assert max(abs(got[i][1] - want[i]) for i in want) < 1e-6


def test_importance_is_sorted_by_the_signal(attributions):
    rows = ml.importance(attributions).orderBy(F.desc("importance")).collect()
    assert [r.feature for r in rows][:2] == ["a", "b"]


def test_attribution_against_all_subsets():
    """Shapley values by their definition, on paths of every length and chunks of few leaves."""
    rng = np.random.default_rng(8)
    n_features = 5
    leaves = [(float(rng.normal()), [(int(f), float(lo), float(lo + 1.5), float(z)) for f, lo, z in zip(sorted(rng.choice(n_features, d, replace=False)), rng.normal(size=d) - 0.7, rng.uniform(0.05, 1, d))])
              for d in (0, 1, 2, 3, 5, 5, 4, 3, 2)]
    x = rng.normal(size=(7, n_features))

    def value(row, known):
        return sum(v * np.prod([(lo < row[f] <= hi) if f in known else z for f, lo, hi, z in path]) for v, path in leaves)

    want = np.zeros(x.shape)
    for r, row in enumerate(x):
        for f in range(n_features):
            others = [g for g in range(n_features) if g != f]
            for size in range(n_features):
                for known in combinations(others, size):
                    share = factorial(size) * factorial(n_features - size - 1) / factorial(n_features)
                    want[r, f] += share * (value(row, {*known, f}) - value(row, set(known)))
    for cells in (1 << 20, 8):
        assert np.allclose(ml.attribute(x, leaves, cells), want, atol=1e-12)


def test_attribution_of_one_split_by_hand():
    leaves = [(1.0, [(0, -np.inf, 0.0, 0.25)]), (3.0, [(0, 0.0, np.inf, 0.75)])]
    phi = ml.attribute(np.array([[-1.0], [1.0]]), leaves)
    assert phi.ravel() == pytest.approx([1.0 - 2.5, 3.0 - 2.5])


def test_top_drivers_drop_zeros(spark):
    df = spark.createDataFrame([(1, "p", 0.5, 1.0), (1, "q", -2.0, 1.0), (1, "r", 0.0, 1.0)], "id int, feature string, attribution double, feature_value double")
    assert [(r.feature, r.direction) for r in ml.topk_drivers(df, ["id"], 3).orderBy("rank").collect()] == [("q", "-"), ("p", "+")]


def test_incomplete_rows_come_back_without_a_prediction(table, model):
    holes = table.withColumn("c", F.when(F.col("id") % 10 != 0, F.col("c")))
    rows = ml.gbt_predict(holes, {"EOS": model}, {"EOS": COLS}).collect()
    assert len(rows) == 300 and sum(r.prediction is None for r in rows) == 30
    with pytest.raises(KeyError):
        ml.gbt_predict(table, {}, {"EOS": COLS})


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(250, 5)), np.array([1.0, -2.0, 0.5, 0.0, 3.0])
    y = x @ w + 4.0 + rng.normal(scale=0.2, size=250)
    df = spark.createDataFrame([(i, x[i].tolist() if i != 249 else None, float(y[i])) for i in range(250)], "id long, vec array<double>, y double").withColumn("g", F.lit(0))
    got = {r.id: r.ridge_pred for r in ml.ridge_probe(df, "vec", "y", F.col("id") < 200, "g", [0], alpha=10.0).collect()}
    xt, yt = x[:200] - x[:200].mean(0), y[:200] - y[:200].mean()
    coef = np.linalg.solve(xt.T @ xt + 10.0 * np.eye(5), xt.T @ yt)
    want = (x - x[:200].mean(0)) @ coef + y[:200].mean()
    assert max(abs(got[i] - want[i]) for i in range(249)) < 1e-6
    assert got[249] is None
    few = ml.ridge_probe(df, "vec", "y", F.col("id") < 50, "g", [0]).where("ridge_pred is not null")
    assert few.count() == 0


def test_pca_is_centred(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6)) + 50.0
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(200)] + [(200, None)], "id long, vec array<double>")
    out, variance = ml.pca_reduce(df, "vec", F.col("id") < 150, 3)
    got = {r.id: r.reduced for r in out.collect()}
    mean = x[:150].mean(0)
    _, s, vt = np.linalg.svd(x[:150] - mean, full_matrices=False)
    want = (x - mean) @ vt[:3].T
    assert max(abs(abs(got[i][j]) - abs(want[i, j])) for i in range(200) for j in range(3)) < 1e-6
    assert got[200] is None and variance[0] == pytest.approx(s[0] ** 2 / (s ** 2).sum())


# --- curves, sweep, bundles ----------------------------------------------------
def test_early_stop_by_patience():
    assert boosting.early_stop([5, 4, 3, 4, 4, 2], 3) == (6, False)
    assert boosting.early_stop([5, 4, 3, 4, 4, 4, 1], 3) == (3, True)  # what follows the stop does not count
    assert boosting.early_stop([2, 2, 2], 2) == (1, True) and boosting.early_stop([1.0], 1) == (1, False)


def test_a_shorter_fit_is_the_start_of_a_longer_one(spark, training):
    rows, val = training.rows(spark, "EOS", False), training.rows(spark, "EOS", True)
    long, short = (boosting.curve(boosting.fit_rounds(rows, n, max_depth=3, step=0.3), val) for n in (9, 4))
    assert short == long[:4]
    errors, best, stopped = boosting.fit_to_stop(rows, val, {"max_depth": 1, "step": 1.0}, first=2, patience=3, max_rounds=40)
    assert (best, stopped) == boosting.early_stop(errors, 3) and (stopped or len(errors) == 40) and len(errors) >= min(best + 3, 40)


def test_sweep_halves_and_keeps_the_first_best(spark, training):
    grid = [{"max_depth": 1, "step": 0.01}, {"max_depth": 4, "step": 0.3}, {"max_depth": 4, "step": 0.3}, {"max_depth": 1, "step": 0.02}]
    table, picks = boosting.sweep(spark, training, ["EOS"], grid, rungs=(2,), keep=2, first=6, patience=3, max_rounds=12)
    rows = {r.seq: r for r in table.collect()}
    assert picks["EOS"].seq == 1 and [s for s, r in rows.items() if r.picked] == [1]  # 2 is its equal
    assert {s: r.left_at for s, r in rows.items()} == {0: 1, 1: 0, 2: 0, 3: 1} and rows[0].rounds == 2
    model = boosting.fit_picks(spark, training, picks)["EOS"]
    assert model.getNumTrees == picks["EOS"].rounds == rows[1].best_round
    assert boosting.curve(model, training.rows(spark, "EOS", True))[-1] == pytest.approx(rows[1].rmse, abs=1e-12)


def test_dates_are_fitted_without_repeating_the_best_rounds(spark, training, monkeypatch):
    asked, fit = [], boosting.fit_rounds
    monkeypatch.setattr(boosting, "fit_rounds", lambda rows, rounds, **kw: asked.append(rounds) or fit(rows, rounds, **kw))
    models, picks = boosting.fit_dates(spark, training, {"EOS": {"max_depth": 3, "step": 0.3}}, first=4, patience=2, max_rounds=9)
    best, val = picks["EOS"].rounds, training.rows(spark, "EOS", True)
    want = fit(training.rows(spark, "EOS", False), best, max_depth=3, step=0.3)
    assert asked == sorted(set(asked)) and models["EOS"].getNumTrees == best and models["EOS"].numFeatures == want.numFeatures
    assert [t.toDebugString.split("\n", 1)[1] for t in models["EOS"].trees] == [t.toDebugString.split("\n", 1)[1] for t in want.trees]
    at = lambda m: [r.prediction for r in m.transform(val).collect()]
    assert at(models["EOS"]) == at(want) and models["EOS"].treeWeights == want.treeWeights
    assert boosting.curve(models["EOS"], val)[-1] == pytest.approx(picks["EOS"].rmse, abs=1e-12)


def test_rounds_grow_only_as_far_as_the_stop_asks(monkeypatch):
    asked = []
    monkeypatch.setattr(boosting, "fit_rounds", lambda rows, rounds: asked.append(rounds) or rounds)
    for bottom, rounds, stopped in ((16, [64, 80], True), (100, [64, 128, 200], True), (5000, [64, 128, 256, 512, 1000], False)):
        monkeypatch.setattr(boosting, "curve", lambda n, val, bottom=bottom: [abs(bottom - k) for k in range(1, n + 1)])
        asked.clear()
        assert boosting.fit_to_stop(None, None, {}, max_rounds=1000)[1:] == (min(bottom, 1000), stopped) and asked == rounds


def test_training_rows_are_complete(spark, table):
    holes = table.withColumn("c", F.when(F.col("id") % 10 != 0, F.col("c")))
    written = boosting.Training.write(holes.where("id < 200"), holes.where("id >= 200"), {"EOS": COLS}, "y")
    assert written.counts == {("EOS", False): 180, ("EOS", True): 90}
    with pytest.raises(ValueError, match="no training rows"):
        written.rows(spark, "08-01", False)
    with pytest.raises(Exception, match="NULL y"):
        boosting.Training.write(table.withColumn("y", F.when(F.col("id") != 3, F.col("y"))), table, {"EOS": COLS}, "y")


def test_bundles_come_back_whole_or_not_at_all(spark, table, model, tmp_path):
    root, contract = str(tmp_path / "b"), {"EOS": COLS}
    trends = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "geoid string, slope double")
    assert bundles.save_bundle(spark, root, {"EOS": model}, contract, {"trends": trends}, {"EOS": {"depth": 4}}) == 1
    got = bundles.load_bundle(spark, root, contract)
    assert got.notes == {"EOS": {"depth": 4}} and sorted(map(tuple, got.tables["trends"].collect())) == [("x", 1.0), ("y", 2.0)]
    one, two = (sorted((r.id, r.prediction) for r in ml.gbt_predict(table, m, contract).collect()) for m in ({"EOS": model}, got.models))
    assert one == two
    with pytest.raises(KeyError, match="08-01"):
        bundles.load_bundle(spark, root, {**contract, "08-01": COLS})
    with pytest.raises(ValueError, match="other features"):
        bundles.load_bundle(spark, root, {"EOS": COLS[::-1]})
    with pytest.raises(ValueError, match="differ at dates"):
        bundles.save_bundle(spark, root, {}, contract, {})
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, str(tmp_path / "none"), contract)
    # a second version is damaged piece by piece; the first stays readable
    assert bundles.save_bundle(spark, root, {"EOS": model}, contract, {"trends": trends}) == 2
    folder = Path(bundles.load_bundle(spark, root, contract).folder)
    trends.limit(1).write.mode("overwrite").parquet(str(folder / "tables" / "trends"))
    with pytest.raises(ValueError, match="rows"):
        bundles.load_bundle(spark, root, contract)
    shutil.rmtree(folder / "models" / "EOS" / "treesMetadata")
    with pytest.raises(ValueError, match="cannot be read"):
        bundles.load_bundle(spark, root, contract)
    assert bundles.load_bundle(spark, root, contract, version=1).version == 1


# --- second model ------------------------------------------------------------------
@pytest.fixture(scope="module")
def probe_rows():
    rng = np.random.default_rng(12)
    x, fold = rng.normal(size=(120, 4)), np.arange(120) % 3
    y = x @ np.array([1.0, -2.0, 0.5, 3.0]) + rng.normal(size=120)
    return x, fold, y


def probed(spark, x, fold, y, min_rows=20):
    rows = [(i, "EOS", int(fold[i]), x[i].tolist() if i % 17 else None, float(y[i])) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, forecast_date string, f int, vec array<double>, y double").repartition(5)
    train, kw = F.col("id") < 90, {"fold": F.col("f")}
    probe = hybrid.probe_fit(df, "vec", "y", train, folds=3, alpha=2.0, min_rows=min_rows, **kw)
    return {r.id: r.ridge_pred for r in hybrid.probe_apply(df, probe, "vec", train, **kw).collect()}


def test_probe_is_the_ridge_without_the_rows_own_fold(spark, probe_rows):
    x, fold, y = probe_rows
    got = probed(spark, x, fold, y)
    assert len(got) == 120 and all((got[i] is None) == (i % 17 == 0) for i in got)
    for i in (i for i in got if i % 17):
        use = [k for k in range(90) if k % 17 and (i >= 90 or fold[k] != fold[i])]
        xt, mean, ym = x[use] - x[use].mean(0), x[use].mean(0), y[use].mean()
        coef = np.linalg.solve(xt.T @ xt + 2.0 * np.eye(4), xt.T @ (y[use] - ym))
        assert got[i] == pytest.approx((x[i] - mean) @ coef + ym, abs=1e-9)


def test_no_training_row_sees_its_own_target(spark, probe_rows):
    x, fold, y = probe_rows
    before, other = probed(spark, x, fold, y), y.copy()
    other[4] += 1000.0
    after = probed(spark, x, fold, other)
    assert after[4] == pytest.approx(before[4], abs=1e-9)  # nor do the others of its fold
    assert all(after[i] == pytest.approx(before[i], abs=1e-9) for i in range(90) if i % 17 and fold[i] == fold[4])
    assert sum(abs(after[i] - before[i]) > 1.0 for i in range(120) if i % 17 and (i >= 90 or fold[i] != fold[4])) > 40


def test_too_few_rows_give_no_probe(spark, probe_rows):
    assert all(v is None for v in probed(spark, *probe_rows, min_rows=500).values())
    x, fold, y = probe_rows
    got = probed(spark, x, fold, y, min_rows=70)  # all training rows are enough, two folds are not
    assert all((got[i] is None) == (i < 90 or i % 17 == 0) for i in got)


def test_routed_errors_are_those_of_the_states_model(spark):
    rows = [("A", "u", 10.0, 11.0, 20.0), ("B", "u", 10.0, 13.0, 14.0), ("B", "v", 10.0, 10.0, 8.0), ("B", "w", None, 10.0, 8.0)]
    df = ml.hybrid_route(spark.createDataFrame(rows, "state string, geoid string, y double, pred_a double, pred_b double"), ["B"])
    got = {(r.variant, r.state): (r.n, r.rmse) for r in hybrid.route_scores(df, "y", ["state"]).collect()}
    assert got["hybrid", "A"] == got["rowA", "A"] == (1, 1.0) and got["hybrid", "B"] == got["rowB", "B"] == (2, pytest.approx(np.sqrt(10.0)))


def test_batch_embed_pools_tokens(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0]), (2, [5.0, 7.0])], "id long, t array<double>")
    out = ml.batch_embed(df, lambda pdf: np.stack([np.stack(pdf["t"])[:, :, None]]).squeeze(0), ["id"])
    assert {r.id: r.embedding for r in out.collect()} == {1: [2.0], 2: [6.0]}
