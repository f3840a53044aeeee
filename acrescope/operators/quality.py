"""Data-quality rules. Each returns a small frame of violations; ``require`` raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from acrescope import constants as K


def expect_columns(df: DataFrame, required) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise KeyError(f"missing required columns: {missing}")


def outside_allowed(df: DataFrame, column: str, allowed) -> DataFrame:
    """Distinct values outside a closed set of fixed size."""
    return df.where(~F.col(column).isin(*allowed)).select(column).distinct()


def expect_unique(df: DataFrame, keys: list[str], exempt: Column | None = None) -> DataFrame:
    """Keys that occur more than once; rows under ``exempt`` do not count."""
    rows = df if exempt is None else df.where(~exempt)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def single_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value (min and max differ: no distinct set is held)."""
    g = df.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    return g.where(F.col("low") != F.col("high"))


def expect_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) for row predicates that must never hold; one pass."""
    counts = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in rules])).alias("_r")).select("_r.*")


def index_rules() -> dict[str, Column]:
    """Rules of a scene index: positive rows carry measures, negative ones a reason."""
    positive = F.col("chip_path").isNotNull()
    measures = F.col("corn_pixel_count").isNull() | F.col("corn_pixel_frac").isNull() | F.col("valid_pixel_frac").isNull()
    return {
        "positive_without_measures": positive & measures,
        "negative_without_reason": ~positive & F.col("skip_reason").isNull(),
        "bad_entity_key": F.length("geoid") != 5,
        "unknown_reason": ~F.col("skip_reason").isin(*K.SKIP_REASONS),
    }


def expect_monotone(df: DataFrame, columns: list[str], slack: float = 1e-9) -> DataFrame:
    """Violations of c0 >= c1 >= ..., per adjacent pair."""
    rules = {f"{a}<{b}": F.col(a) < F.col(b) - slack for a, b in zip(columns, columns[1:])}
    return expect_rules(df, rules)


def mark_broken(df: DataFrame, rules: dict[str, Column], into: str = "broken") -> tuple[DataFrame, Observation]:
    """The rows with the names of the rules each breaks, and an observation of the counts.

    The counts (``n_rows``, ``n_broken`` and one per rule) come with whatever job runs over the
    rows; they cost no job of their own. A rule that is NULL for a row is not broken.
    """
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    out, seen = df.withColumn(into, names), Observation()
    broken = lambda n: F.array_contains(into, n)
    return out.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(into) > 0).alias("n_broken"), *[F.count_if(broken(n)).alias(n) for n in rules]), seen


def split_write(df: DataFrame, rules: dict[str, Column], path: str, at_most: float = 1.0) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(good rows, quarantined rows with the rules they break, counts): one job that scans the input once and writes both.

    More than the share ``at_most`` of broken rows is an error; the files then stay for inspection.
    """
    marked, seen = mark_broken(df, rules)
    marked.withColumn("quarantined", F.size("broken") > 0).write.mode("errorifexists").partitionBy("quarantined").parquet(path)
    counts = {"n_rows": 0, "n_broken": 0, **{n: 0 for n in rules}, **{k: v for k, v in seen.get.items() if v is not None}}
    if counts["n_broken"] > at_most * counts["n_rows"]:
        raise ValueError(f"{counts['n_broken']} of {counts['n_rows']} rows break rules: { {n: counts[n] for n in rules if counts[n]} }")
    both = df.sparkSession.read.schema(marked.withColumn("quarantined", F.lit(True)).schema).parquet(path)
    return both.where(~F.col("quarantined")).select(*df.columns), both.where("quarantined").drop("quarantined"), counts


def require(violations: DataFrame, what: str) -> None:
    """Strict mode: fail when a frame of violations has a row."""
    sample = violations.take(3)
    if sample:
        raise ValueError(f"{what}: {[r.asDict() for r in sample]}")
