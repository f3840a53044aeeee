"""Per-entity linear trends with a state fallback, and standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acrescope.operators.quantiles import exact_quantiles

ROUNDING = 1e-10  # spread over mean that double sums of equal terms can have


def one_per_year(train: DataFrame, entity: str, state: str, target: str) -> DataFrame:
    """The target is equal on all dates of a year: one row per (entity, year)."""
    return train.where(F.col(target).isNotNull()).groupBy(entity, state, "year").agg(F.min(target).alias(target))


def ols_trend(train: DataFrame, entity: str, state: str, target: str = "yield_target", min_years: int = 5) -> DataFrame:
    """Slope and intercept per entity with enough distinct years."""
    rows = one_per_year(train, entity, state, target)
    fit = rows.groupBy(entity, state).agg(
        F.regr_slope(F.col(target), F.col("year").cast("double")).alias("slope"),
        F.regr_intercept(F.col(target), F.col("year").cast("double")).alias("intercept"),
        F.count(F.lit(1)).alias("n_years"),
    )
    return fit.where(F.col("n_years") >= min_years)


def trend_fallback(fits: DataFrame, state: str) -> DataFrame:
    """Median slope and intercept of the entity fits of each state."""
    slope = exact_quantiles(fits, [state], "slope", [0.5]).select(state, F.col("quantile").alias("state_slope"))
    cut = exact_quantiles(fits, [state], "intercept", [0.5]).select(state, F.col("quantile").alias("state_intercept"))
    return slope.join(cut, state)


def trend_params(train: DataFrame, fits: DataFrame, entity: str, state: str) -> DataFrame:
    """One trend per training entity: its own fit, else its state's median."""
    known = train.select(entity, state).distinct()
    joined = known.join(fits.select(entity, "slope", "intercept"), entity, "left").join(trend_fallback(fits, state), state, "left")
    return joined.select(entity, state, F.coalesce("slope", "state_slope").alias("slope"),
                         F.coalesce("intercept", "state_intercept").alias("intercept"),
                         F.col("slope").isNotNull().alias("own_fit"))


def trend_at(year: str | Column = "year") -> Column:
    y = F.col(year) if isinstance(year, str) else year
    return F.col("slope") * y.cast("double") + F.col("intercept")


def detrend(df: DataFrame, params: DataFrame, entity: str, target: str = "yield_target") -> DataFrame:
    """Adds detrended_<target>; NULL where an entity has no trend at all."""
    out = df.join(params.select(entity, "slope", "intercept"), entity, "left")
    return out.withColumn(f"detrended_{target}", F.col(target) - trend_at()).drop("slope", "intercept")


def retrend(df: DataFrame, params: DataFrame, entity: str, values: list[str], year: str = "year") -> DataFrame:
    """Adds the entity's trend at a year back to each value."""
    out = df.join(params.select(entity, "slope", "intercept"), entity, "left")
    return out.withColumns({v: F.col(v) + trend_at(year) for v in values}).drop("slope", "intercept")


def standardizer_fit(train: DataFrame, by_date: dict[str, list[str]], strict: bool = True, constant: bool = False) -> DataFrame:
    """(forecast_date, feature, mean, std): population std per date and feature.

    One aggregation for all dates and features; the result has one row per
    contract column, whatever the data volume. Strict: a NULL value or a zero
    spread is an error; with ``constant`` a zero spread stays in the table and
    ``zscore`` leaves the feature out, and a spread that is only the rounding of
    sums made in different orders is zero. Lenient: NULLs are skipped and a zero
    spread becomes one.
    """
    features = list(dict.fromkeys(c for cols in by_date.values() for c in cols))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"), F.count(f).alias(f"n_{f}")]
    wide = train.groupBy("forecast_date").agg(*aggs)
    long = wide.select("forecast_date", "_n", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.col(f"s_{f}").alias("std"), F.col(f"n_{f}").alias("n"))
        for f in features])).alias("_p")).select("forecast_date", "_n", "_p.*")
    in_contract = F.lit(False)
    for d, cols in by_date.items():
        in_contract = in_contract | ((F.col("forecast_date") == d) & F.col("feature").isin(*cols))
    long = long.where(in_contract)
    if strict:
        bad = (F.col("n") < F.col("_n")) | F.col("std").isNull()
        if constant:
            long = long.withColumn("std", F.when(F.col("std") <= ROUNDING * F.abs("mean"), 0.0).otherwise(F.col("std")))
        else:
            bad = bad | (F.col("std") == 0)
        fail = F.raise_error(F.concat(F.lit("cannot standardise "), "feature", F.lit(" at "), "forecast_date"))
        long = long.withColumn("std", F.when(bad, fail.cast("double")).otherwise(F.col("std")))
    else:
        long = long.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))
    return long.select("forecast_date", "feature", "mean", "std")


def zscore(df: DataFrame, params: DataFrame, by_date: dict[str, list[str]], lenient: bool = False, out: str = "vec") -> DataFrame:
    """Ordered standardised vector per row, under the contract of its own date.

    Strict rows with a NULL feature raise; lenient ones take the mean (zero). A
    feature without spread in the training rows is zero in every row: it takes
    no part in any distance.
    """
    entries = F.collect_list(F.struct("feature", F.struct("mean", "std")))
    table = params.groupBy("forecast_date").agg(F.map_from_entries(entries).alias("_p"))
    joined = df.join(table, "forecast_date")

    def z(f):
        p = F.element_at("_p", F.lit(f))
        value = F.when(p["std"] == 0, F.when(F.col(f).isNotNull(), 0.0)).otherwise((F.col(f) - p["mean"]) / p["std"])
        if lenient:
            return F.coalesce(value, F.lit(0.0))
        return F.coalesce(value, F.raise_error(F.lit(f"missing {f} in a vector")).cast("double"))

    vec = None
    for d, cols in by_date.items():
        arr = F.array(*[z(c) for c in cols])
        vec = F.when(F.col("forecast_date") == d, arr) if vec is None else vec.when(F.col("forecast_date") == d, arr)
    return joined.withColumn(out, vec).drop("_p")


def zscore_global(df: DataFrame, train: DataFrame, features: list[str], out: str = "vec") -> DataFrame:
    """Lenient scaler with one mean and std over all dates; NULL becomes zero."""
    stats = train.agg(*[a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    joined = df.crossJoin(F.broadcast(stats))  # one row of fixed width
    spread = lambda f: F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}"))
    vec = F.array(*[F.coalesce((F.col(f) - F.col(f"m_{f}")) / spread(f), F.lit(0.0)) for f in features])
    return joined.withColumn(out, vec).select(*df.columns, out)
