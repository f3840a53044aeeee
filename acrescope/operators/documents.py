"""Nested result documents and their small report operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def available_years(panel: DataFrame, entity: str, state: str, weight: str) -> DataFrame:
    """Entities and years with any acreage at EOS per state; default is the newest."""
    rows = panel.where(F.col("forecast_date") == "EOS")
    has = F.when(F.col(weight).isNotNull(), F.col("year"))
    per = rows.groupBy(state).agg(F.countDistinct(entity).alias("n_counties"), F.array_sort(F.collect_set(has)).alias("years"))
    return per.withColumn("default_year", F.max(F.array_max("years")).over(Window.partitionBy()))


def anchor_entity(rows: DataFrame, cell: list[str], entity: str, weight: str, complete: str = "complete") -> DataFrame:
    """Largest complete entity per cell (a combined aggregate, no sort)."""
    ok = rows.where(F.col(complete) & F.col(weight).isNotNull())
    best = F.max_by(entity, F.struct(weight, entity))
    return ok.groupBy(*cell).agg(best.alias(entity), F.max(weight).alias("acres"))


def state_block(predictions: DataFrame, state: str, entity: str, target: str, routed: list[str]) -> DataFrame:
    """Unweighted state report: means, top entity, rising count, errors and lift."""
    from acrescope.operators.scoring import rmse

    rows = predictions.where(F.col("pred_hybrid").isNotNull()).withColumns({
        "_eh": F.col("pred_hybrid") - F.col(target), "_ea": F.col("pred_a") - F.col(target)})
    whole = lambda c: F.bround(c, 0).cast("int")
    out = rows.groupBy(state).agg(
        whole(F.avg("pred_hybrid")).alias("predicted"), whole(F.avg(target)).alias("actual"), F.count(F.lit(1)).alias("n_counties"),
        F.max_by(entity, F.struct("pred_hybrid", entity)).alias("top_county"), whole(F.max("pred_hybrid")).alias("top_yield"),
        F.count_if(F.col("pred_hybrid") > F.coalesce(F.col(target), F.lit(0.0))).alias("rising"),
        whole(F.avg("pred_a")).alias("row_a"), whole(F.avg("pred_b")).alias("row_b"),
        rmse("_eh").alias("rmse"), rmse("_ea").alias("rmse_a"))
    return out.withColumns({
        "model": F.when(F.col(state).isin(*routed), "Row B").otherwise("Row A"),
        "lift_pct": F.bround(F.try_divide(F.col("rmse_a") - F.col("rmse"), F.col("rmse_a")) * 100, 2),
        "rmse": F.bround("rmse", 2), "rmse_a": F.bround("rmse_a", 2)})


def spread_cone(predictions: DataFrame, by: list[str], target: str) -> DataFrame:
    """Cone from the spread of entity predictions: mean +- 1.5 sd, range +- 2.5 sd."""
    rows = predictions.where(F.col("pred_hybrid").isNotNull())
    mean, sd = F.col("predicted"), F.col("_sd")
    whole = lambda c: F.bround(c, 0).cast("int")
    out = rows.groupBy(*by).agg(whole(F.avg("pred_hybrid")).alias("predicted"), F.stddev_samp("pred_hybrid").alias("_sd"), whole(F.avg(target)).alias("actual"))
    return out.withColumns({
        "upper": whole(mean + 1.5 * sd), "lower": whole(mean - 1.5 * sd), "range_low": whole(mean - 2.5 * sd), "range_high": whole(mean + 2.5 * sd)}).drop("_sd")


def state_forecast_doc(state_cones: DataFrame, coverage: DataFrame, anchors: DataFrame, analogs: DataFrame, truth: DataFrame,
                       history: DataFrame, cell: list[str], points: DataFrame | None = None, drivers: DataFrame | None = None,
                       n_drivers: int = 5) -> DataFrame:
    """One nested document per (state, year, date), all of them in one job.

    ``coverage`` has every cell with n_complete; the status tells a cone from
    missing features and from missing analogs. With ``points`` (model_point) the
    point estimate is the regressor's, and the analogs' stays beside it; with
    ``drivers`` (driver_rollup) the largest contributions are listed.
    """
    status = F.when(F.col("p50").isNotNull(), "ok").when(F.col("n_complete") > 0, "unavailable_no_analogs").otherwise("unavailable_pending_ndvi")
    listed = F.array_sort(F.collect_list(F.struct("rank", "geoid", "year", "distance", "yield_target")))  # k entries
    near = (
        analogs.withColumnsRenamed({"q_geoid": "_geoid", "q_year": "_year"})
        .join(anchors.select(*cell, F.col("geoid").alias("_geoid"), "acres").withColumnRenamed("year", "_year"), ["_geoid", "_year", "forecast_date"])
        .groupBy("state", "_year", "forecast_date").agg(F.first("_geoid").alias("anchor"), F.first("acres").alias("anchor_acres"), listed.alias("analogs"))
        .withColumnRenamed("_year", "year"))
    rows = coverage.join(state_cones, cell, "left").join(near, cell, "left").join(truth, ["state", "year"], "left").join(history, ["state", "year"], "left")
    cone = F.when(F.col("p50").isNotNull(), F.struct("p10", "p50", "p90", (F.col("p90") - F.col("p10")).alias("width_80")))
    with_cone = F.col("p50").isNotNull()
    extra = [F.lit(None).cast("array<string>").alias("drivers")] if drivers is None else [F.col("drivers")]
    point = F.col("point")
    if points is not None:
        rows, point = rows.join(points.select(*cell, "model_point"), cell, "left"), F.coalesce("model_point", "point")
    if drivers is not None:
        entry = F.struct((-F.abs("attribution")).alias("neg"), "feature", "attribution", "feature_value", "kind", "direction")
        top = drivers.groupBy(*cell).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, n_drivers).alias("drivers"))  # one entry per feature
        rows = rows.join(top.withColumn("drivers", F.transform("drivers", lambda d: d.dropFields("neg"))), cell, "left")
    return rows.select(
        *cell, point.alias("point_estimate"), F.col("point").alias("analog_point"), *extra, cone.alias("cone"), status.alias("cone_status"), F.coalesce("n_counties", F.lit(0)).alias("n_counties"),
        F.when(with_cone, F.struct(F.col("anchor").alias("geoid"), F.col("anchor_acres").alias("acres"))).alias("anchor"),
        F.when(with_cone, F.col("analogs")).alias("analogs"), "truth", F.struct("mean_5", "mean_10").alias("history"))


def payload_round(docs: DataFrame) -> DataFrame:
    """The document at fixed precision as JSON text."""
    r = lambda c, n=1: F.bround(c, n)
    cone = F.when(F.col("cone").isNotNull(), F.struct(*[r(f"cone.{p}").alias(p) for p in ("p10", "p50", "p90", "width_80")]))
    near = F.transform("analogs", lambda a: F.struct(a["year"].alias("year"), a["geoid"].alias("geoid"), F.bround(a["distance"], 3).alias("distance"),
                                                     F.bround(a["yield_target"], 1).alias("observed")))
    body = F.struct("state", "year", "forecast_date", r("point_estimate").alias("point_estimate"), cone.alias("cone"), "cone_status", "n_counties",
                    near.alias("analog_years"), r("truth").alias("truth"),
                    F.struct(r("history.mean_5").alias("mean_5"), r("history.mean_10").alias("mean_10")).alias("history"))
    return docs.select("state", "year", "forecast_date", F.to_json(body).alias("payload"))


def emissions_doc(per_class: DataFrame, totals: DataFrame, image: str) -> DataFrame:
    """Per-class map and totals of an image as one JSON text (<= 8 classes)."""
    entry = F.struct("class_name", F.struct("pixel_count", "area_ha", "annual_tco2e", "embodied_tco2e"))
    costed = per_class.where(F.col("annual_tco2e").isNotNull()).groupBy(image).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("per_class"))
    out = totals.join(costed, image, "left")
    body = F.struct("per_class", F.struct("annual_tco2e", "embodied_tco2e", "assessed_area_ha").alias("totals"),
                    F.create_map(F.lit("no_data"), F.col("no_data_fraction"), F.lit("background"), F.col("background_fraction")).alias("excluded"))
    return out.select(image, F.to_json(body).alias("doc"))


DOC_SCHEMA = """per_class map<string, struct<pixel_count: bigint, area_ha: double, annual_tco2e: double, embodied_tco2e: double>>,
  totals struct<annual_tco2e: double, embodied_tco2e: double, assessed_area_ha: double>, excluded map<string, double>"""


def doc_roundtrip(docs: DataFrame, image: str, doc: str = "doc") -> DataFrame:
    """A nested emissions document back to one row per class."""
    parsed = docs.select(image, F.from_json(doc, DOC_SCHEMA).alias("_d"))
    rows = parsed.select(image, F.col("_d.totals").alias("_t"), F.explode("_d.per_class").alias("class_name", "_c"))
    return rows.select(image, "class_name", "_c.*", F.col("_t.annual_tco2e").alias("total_annual"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null counts, shares and the five-number summary of each column.

    Counts come from one aggregate; quantiles are exact and never gather a
    column in one task.
    """
    from acrescope.operators.quantiles import exact_quantiles

    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(F.explode(entries).alias("_e")).select("_e.*")
    counts = long.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("v").isNull()).alias("n_null"),
                                        F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75])
    pick = lambda p, n: F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
    wide = q.groupBy("column").agg(pick(0.25, "q1"), pick(0.5, "q2"), pick(0.75, "q3"))
    return counts.join(wide, "column", "left").withColumn("null_pct", 100.0 * F.col("n_null") / F.col("n_rows"))


def profile_slices(df: DataFrame, sets: dict[str, list[str]], entity: str, known: list[str]) -> DataFrame:
    """Rows, entities and the share of known values of columns, for several groupings from one pass.

    ``sets`` names the groupings (an empty one is the whole table). They are GROUPING SETS
    of one aggregate: a row is expanded once per grouping and combined before the shuffle. ``slice``
    names the grouping a row belongs to; columns it does not group by are NULL, as is a value that is NULL itself.
    """
    columns = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    place = {c: len(columns) - 1 - i for i, c in enumerate(columns)}
    code = {n: sum(1 << place[c] for c in columns if c not in cols) for n, cols in sets.items()}  # what grouping_id says of it
    share = [(100.0 * F.count(c) / F.count(F.lit(1))).alias(f"{c}_known_pct") for c in known]
    out = df.groupingSets([[F.col(c) for c in cols] for cols in sets.values()], *columns).agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("n_entities"), *share)
    name = F.coalesce(*[F.when(F.col("_g") == g, F.lit(n)) for n, g in code.items()])
    return out.select(name.alias("slice"), *columns, "n_rows", "n_entities", *[f"{c}_known_pct" for c in known])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of every value of the columns as text, NULL among them; one pass, combined before the shuffle."""
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(entries).alias("_e")).groupBy("_e.column", "_e.value").agg(F.count(F.lit(1)).alias("n"))
