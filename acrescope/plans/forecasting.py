"""The forecasting chain over the bound tables: pools, trend, vectors, analogs, cones."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.operators import boosting, chips, cone, hybrid, joins, knn, ml, panel, scoring, trend
from acrescope.plans import fixtures as fxm
from acrescope.plans.fixtures import CLIMATE
from acrescope.session import cut_lineage, fingerprint, fresh_path
from acrescope.sources import bundles

KS = (3, 5)
# fixed values, the published sweep: depths x step sizes x least rows of a leaf
GRID = [{"max_depth": d, "step": s, "min_rows": m} for d in (4, 6, 8) for s in (0.05, 0.1) for m in (1, 5)]
QC = ["chip_count", "chip_age_days_max", "cloud_pct_max", "corn_pixel_frac_min"]
ROUTED = ["ASIA", "EUROPE"]
KEYS = ["geoid", "year", "forecast_date"]
N_VECTORS = 600  # panel keys share the given vectors with ids below; ids that a small table lacks leave keys without one
CELL = ["state", "year", "forecast_date", "pool", "k"]


class Forecasting:
    """Each step is a lazy DataFrame; tables used by several steps are written once.

    ``of`` shares the written tables between queries of one session over the
    same input folder, as the hand-off files of a batch run would be; once an
    input table changes, the next query starts from the sources. ``forget``
    drops what is shared, ``session.drop_intermediates`` the written tables.
    """

    _shared: dict = {}

    def __init__(self, fx):
        self.fx = fx

    @classmethod
    def of(cls, fx) -> Forecasting:
        state = tuple(fingerprint(fx.spark, fx.path(t)) for t in fxm.SCHEMAS)
        key = (fx.spark.sparkContext.applicationId, fx.dir, state)
        if key not in cls._shared:
            cls._shared[key] = cls(fx)
        return cls._shared[key]

    @classmethod
    def forget(cls) -> None:
        """Drop the shared tables, so that the next query starts from the sources."""
        cls._shared.clear()

    @cached_property
    def ready(self) -> DataFrame:
        """The master panel, written once: every later step reads it several times."""
        return cut_lineage(self.fx.ready, "panel")

    @cached_property
    def panel(self) -> DataFrame:
        """One row per entity and year (survey columns are equal on all dates)."""
        return self.ready.where(F.col("date_rank") == 0)

    @cached_property
    def train(self) -> DataFrame:
        return panel.train_pool(self.ready, "geoid", fxm.MIN_YEARS, fxm.TRAIN_YEARS)

    @cached_property
    def fits(self) -> DataFrame:
        return cut_lineage(trend.ols_trend(self.train, "geoid", "state"), "fits")

    @cached_property
    def params(self) -> DataFrame:
        return trend.trend_params(self.train, self.fits, "geoid", "state")

    @cached_property
    def std(self) -> DataFrame:
        """On large tables every entity has every weather, so that columns of the contract are constant there."""
        return trend.standardizer_fit(self.train, fxm.CONTRACT, constant=True)

    @cached_property
    def vectors(self) -> DataFrame:
        rows = self.ready.where("complete")
        out = trend.zscore(rows, self.std, fxm.CONTRACT).select("geoid", "state", "year", "forecast_date", "vec")
        return cut_lineage(out, "vectors")

    @cached_property
    def candidates(self) -> DataFrame:
        rows = trend.zscore(trend.detrend(self.train, self.params, "geoid"), self.std, fxm.CONTRACT)
        rows = rows.select("geoid", "state", "year", "forecast_date", "yield_target", "detrended_yield_target", "vec")
        return cut_lineage(rows, "candidates")

    def same_entity(self, queries: DataFrame, k: int = 5) -> DataFrame:
        q = queries.select("geoid", "year", "forecast_date", "vec")
        near = knn.knn_within(q, self.candidates, ["geoid", "forecast_date"], k, ["geoid", "year", "forecast_date"], ["year"])
        return near.withColumn("q_geoid", F.col("geoid"))

    def cross_entity(self, queries: DataFrame, k: int = 5) -> DataFrame:
        q = queries.select("geoid", "year", "forecast_date", "vec")
        return knn.knn_join(q, self.candidates, ["forecast_date"], k, ["geoid", "year"], ["geoid", "year"])

    @cached_property
    def holdout_queries(self) -> DataFrame:
        return self.vectors.where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR))

    @cached_property
    def analogs(self) -> DataFrame:
        """Both pools at the largest k; smaller k reuse the ranks."""
        cols = ["q_geoid", "q_year", "forecast_date", "geoid", "year", "yield_target", "detrended_yield_target", "distance", "rank"]
        same = self.same_entity(self.holdout_queries, max(KS)).select(F.lit("same_geoid").alias("pool"), *cols)
        cross = self.cross_entity(self.holdout_queries, max(KS)).select(F.lit("cross_county").alias("pool"), *cols)
        return same.unionByName(cross)

    @cached_property
    def cones(self) -> DataFrame:
        ranked = scoring.by_k(self.analogs, KS)
        out = cone.percentile_cone(ranked, self.params, ["pool", "k", "q_geoid", "q_year", "forecast_date"], "q_geoid", "q_year")
        out = out.withColumnsRenamed({"q_geoid": "geoid", "q_year": "year"})
        out = out.join(self.panel.select("geoid", "state", "year", "acres_planted_all"), ["geoid", "year"])
        return cut_lineage(out, "cones")

    @cached_property
    def state_cones(self) -> DataFrame:
        return cone.cone_rollup(self.cones, CELL)

    @cached_property
    def truth(self) -> DataFrame:
        return self.panel.groupBy("state", "year").agg(
            cone.weighted(F.col("yield_target"), F.col("acres_planted_all")).alias("truth"))

    @cached_property
    def baseline(self) -> DataFrame:
        rows = cone.lookback_state(self.panel, "geoid", "state", (5,), skip_years=(fxm.HOLDOUT_YEAR,))
        return rows.select("state", "year", F.col("mean_5").alias("baseline"))

    @cached_property
    def backtest(self) -> DataFrame:
        combos = F.array(*[F.struct(F.lit(p).alias("pool"), F.lit(k).alias("k")) for p in ("same_geoid", "cross_county") for k in KS])
        grid = (
            self.panel.where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR))
            .groupBy("state", "year").agg(F.count(F.lit(1)).alias("n_queries"))
            .withColumn("forecast_date", F.explode(F.array(*[F.lit(d) for d in fxm.CONTRACT])))
            .withColumn("_c", F.explode(combos)).select("state", "year", "forecast_date", "_c.*", "n_queries")
        )
        return scoring.backtest_rows(grid, self.cones, self.state_cones, self.truth, self.baseline, CELL)

    @cached_property
    def bias(self) -> DataFrame:
        return scoring.bias_constants(self.backtest, fxm.VAL_YEAR, ["pool", "k", "state", "forecast_date"])

    @cached_property
    def recalibrated(self) -> DataFrame:
        return scoring.recalibrate(self.backtest, self.bias, ["pool", "k", "state", "forecast_date"], fxm.HOLDOUT_YEAR)

    # --- regressor chain --------------------------------------------------------
    @cached_property
    def validation(self) -> DataFrame:
        return self.ready.where((F.col("year") == fxm.VAL_YEAR) & F.col("yield_target").isNotNull())

    @cached_property
    def training(self) -> boosting.Training:
        return boosting.Training.write(self.train, self.validation, fxm.CONTRACT, "yield_target")

    @cached_property
    def swept(self) -> tuple[DataFrame, dict[str, boosting.Pick]]:
        """The sweep's table and each date's pick, both from validation curves."""
        return boosting.sweep(self.fx.spark, self.training, list(fxm.CONTRACT), GRID)

    @cached_property
    def models(self) -> dict:
        """One boosted model per date: the picked configuration at its best round."""
        return boosting.fit_picks(self.fx.spark, self.training, self.swept[1])

    @cached_property
    def bundle(self) -> bundles.Bundle:
        """Models, trends and standardizer, saved and read back."""
        root = fresh_path(self.fx.spark, "bundle")
        notes = {d: {**p.config, "rounds": p.rounds, "rmse": p.rmse} for d, p in self.swept[1].items()}
        bundles.save_bundle(self.fx.spark, root, self.models, fxm.CONTRACT, {bundles.TRENDS: self.params, bundles.STANDARDIZER: self.std}, notes)
        return bundles.load_bundle(self.fx.spark, root, fxm.CONTRACT)

    def explained(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Contributions of every date's model to its predictions of complete rows."""
        nodes, out = bundles.tree_nodes(self.fx.spark, self.bundle.folder, list(fxm.CONTRACT)), None
        for d, cols in fxm.CONTRACT.items():
            at = F.col("forecast_date") == d
            part = ml.tree_attribution(rows.where(at & F.col("complete")), self.models[d], nodes.where(at), cols, keys)
            out = part if out is None else out.unionByName(part)
        return out

    @cached_property
    def tested(self) -> DataFrame:
        return self.ready.where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR))

    @cached_property
    def county_predictions(self) -> DataFrame:
        rows = ml.gbt_predict(self.tested, self.models, fxm.CONTRACT)
        return cut_lineage(rows.select("geoid", "state", "year", "forecast_date", "acres_planted_all", "yield_target", "prediction"), "predictions")

    @cached_property
    def model_points(self) -> DataFrame:
        """Acreage-weighted state point of the county predictions."""
        ok = F.col("prediction").isNotNull() & (F.col("acres_planted_all") > 0)
        return self.county_predictions.groupBy("state", "year", "forecast_date").agg(
            cone.weighted(F.col("prediction"), F.col("acres_planted_all")).alias("model_point"), F.count_if(ok).alias("n_predicted"))

    @cached_property
    def attributions(self) -> DataFrame:
        """Contributions of every date's model to its predictions, with the base value and acreage."""
        out = self.explained(self.tested, ["geoid", "state", "year", "forecast_date", "acres_planted_all"])
        return cut_lineage(out.withColumnRenamed("acres_planted_all", "acres"), "attributions")

    # --- second model and routing ---------------------------------------------------
    @cached_property
    def chip_vectors(self) -> DataFrame:
        """Per panel key its chip columns and, where it has a chip, one of the given vectors."""
        from acrescope.plans.q_chips import index

        grid = joins.skeleton_cross(self.panel.select("geoid", "year"))
        coverage = chips.chip_coverage(grid, chips.chip_sequence(index(self.fx), "geoid"), "geoid")
        number = (F.col("geoid").cast("int") * 28 + (F.col("year") - fxm.TRAIN_YEARS[0]) * 4 + F.col("date_rank")) % N_VECTORS
        given = self.fx.table("embeddings").select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_vec"))
        out = coverage.withColumn("_id", number.cast("long")).join(given, "_id", "left")
        return cut_lineage(out.select(*KEYS, *QC, F.when(~F.col("fully_padded"), F.col("_vec")).alias("vector")), "chip-vectors")

    @cached_property
    def probed(self) -> DataFrame:
        """The panel with the chip columns and the out-of-fold probe; five folds of entities."""
        train = F.col("year").between(*fxm.TRAIN_YEARS) & F.col("yield_target").isNotNull()
        fold = F.pmod(F.col("geoid").cast("int"), F.lit(hybrid.FOLDS))
        rows, _ = hybrid.with_probe(self.ready, self.chip_vectors, KEYS, QC, "vector", "yield_target", train, fold)
        return cut_lineage(rows, "probed")

    @cached_property
    def second_models(self) -> dict:
        """Model B per date: the pick of model A's sweep, run to its own early stop on the wider contract."""
        by_date = hybrid.second_features(fxm.CONTRACT, QC)
        train = panel.train_pool(self.probed, "geoid", fxm.MIN_YEARS, fxm.TRAIN_YEARS)
        val = self.probed.where((F.col("year") == fxm.VAL_YEAR) & F.col("yield_target").isNotNull())
        training = boosting.Training.write(train, val, by_date, "yield_target")
        return boosting.fit_dates(self.fx.spark, training, {d: p.config for d, p in self.swept[1].items()})[0]

    @cached_property
    def hybrid(self) -> DataFrame:
        """Both models' predictions of validation and holdout rows, and the routed one."""
        by_date, rows = hybrid.second_features(fxm.CONTRACT, QC), self.probed.where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR))
        b = ml.gbt_predict(rows, self.second_models, by_date).select(*KEYS, F.col("prediction").alias("pred_b"))
        both = self.county_predictions.withColumnRenamed("prediction", "pred_a").join(b, KEYS)
        return cut_lineage(ml.hybrid_route(both, ROUTED), "hybrid")

    # --- state grain ----------------------------------------------------------
    @cached_property
    def state_panel(self) -> DataFrame:
        return cone.weighted_rollup_all(self.ready, ["state", "year", "forecast_date"], ["yield_target", *CLIMATE])

    @cached_property
    def state_vectors(self) -> DataFrame:
        train = self.state_panel.where(F.col("year").between(*fxm.TRAIN_YEARS))
        out = trend.zscore_global(self.state_panel, train, CLIMATE).select("state", "year", "forecast_date", "yield_target", "vec")
        return cut_lineage(out, "state_vectors")

    def past_analogs(self, metric: str = "euclidean", k: int = 10) -> DataFrame:
        return knn.knn_join(self.state_vectors, self.state_vectors, ["forecast_date"], k, ["state", "year"], ["state", "year"],
                            rule="past", metric=metric)

    @cached_property
    def slice_rows(self) -> DataFrame:
        cones = cone.raw_cone(self.past_analogs(), ["q_state", "q_year", "forecast_date"]).withColumnsRenamed({"q_state": "state", "q_year": "year"})
        rows = self.state_panel.where(F.col("year").isin(fxm.VAL_YEAR, fxm.HOLDOUT_YEAR) & F.col("yield_target").isNotNull()) \
            .select("state", "year", "forecast_date", F.col("yield_target").alias("actual"))
        out = rows.join(cones, ["state", "year", "forecast_date"], "left")
        inside = F.when(F.col("p10").isNotNull(), F.col("actual").between(F.col("p10"), F.col("p90")).cast("double"))
        return cut_lineage(out.withColumns({"in_80_cone": inside, "error": F.col("actual") - F.col("p50"), "width": F.col("p90") - F.col("p10")}), "slice-rows")
