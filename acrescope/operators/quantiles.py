"""Exact interpolated quantiles that never hold a group in one task.

A bounded sketch brackets each wanted rank; the rows below a bracket are counted
before the shuffle, those inside are cut into value ranges, and only the ranges
that hold the wanted ranks are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrescope.session import cut_lineage

_ACCURACY = 10_000
_MARGIN = 3.0 / _ACCURACY
_RANGES = 256


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float]) -> DataFrame:
    """(groups, prob, quantile), linear interpolation, NULLs skipped.

    A bracket holds a few ten-thousandths of a group, or all of a group too
    small for the sketch to be inexact; a range is one part of it in 256. Equal
    values are one row before anything is ordered. The brackets are written
    first: a table of known size meets the rows where they lie, while a join to
    the aggregate itself would bring all rows of a group to the task that made it.
    """
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("v"))
    lows = [max(0.0, p - _MARGIN) for p in probs]
    highs = [min(1.0, p + _MARGIN) for p in probs]
    sketch = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"), F.min("v").alias("least"), F.max("v").alias("most"),
        F.percentile_approx("v", [*lows, *highs], _ACCURACY).alias("cut"),
    )
    m = len(probs)
    small = F.col("total") <= _ACCURACY  # below that a rank's neighbours may lie outside the sketch's bracket
    brackets = F.array(*[
        F.struct(
            F.lit(float(p)).alias("prob"),
            ((F.col("total") - 1) * F.lit(float(p))).alias("rank"),
            F.when(small, F.col("least")).otherwise(F.get("cut", F.lit(i))).alias("low"),
            F.when(small, F.col("most")).otherwise(F.get("cut", F.lit(m + i))).alias("high"),
        ) for i, p in enumerate(probs)])
    sketch = cut_lineage(sketch.select(*groups, brackets.alias("_b")), "brackets")
    joined = rows.join(sketch, groups) if groups else rows.crossJoin(F.broadcast(sketch))  # one row
    each = joined.select(*groups, "v", F.explode("_b").alias("_b")).select(*groups, "v", "_b.*")
    key = [*groups, "prob"]
    below = each.groupBy(*key).agg(F.count_if(F.col("v") < F.col("low")).alias("before"))
    part = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * _RANGES)).otherwise(F.lit(0))
    inside = each.where(F.col("v").between(F.col("low"), F.col("high"))).groupBy(*key, "rank", part.alias("part"), "v").agg(F.count(F.lit(1)).alias("n"))
    lead = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most 257 rows
    parts = inside.groupBy(*key, "rank", "part").agg(F.sum("n").alias("size")).join(below, key)
    parts = parts.withColumn("first", F.col("before") + F.coalesce(F.sum("size").over(lead), F.lit(0)))
    wanted = parts.where((F.col("first") <= F.ceil("rank")) & (F.col("first") + F.col("size") > F.floor("rank"))).select(*key, "part", "first")
    w = Window.partitionBy(*key, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    held = inside.join(wanted, [*key, "part"]).withColumn("upto", F.col("first") + F.sum("n").over(w))
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    out = held.groupBy(*key).agg(at(F.floor("rank")).alias("lo"), at(F.ceil("rank")).alias("hi"), F.first("rank").alias("rank"))
    frac = F.col("rank") - F.floor("rank")
    return out.select(*key, (F.col("lo") + (F.col("hi") - F.col("lo")) * frac).alias("quantile"))
