"""Exact k-nearest-neighbour joins without materialising pairs.

Two forms:

* ``knn_within``: candidates share an equi-key with the query whose group is
  bounded by the calendar (one row per entity and year), so a plain join does.
* ``knn_join``: any candidate of the same group (forecast date). Candidates are
  cut into cells around pivots; the triangle inequality gives each query an
  upper bound on its k-th distance and rules cells out. What is left meets in
  blocks of bounded size and each block emits only the k best per query: a cell
  is cut by its own candidates and by the queries that open it, so a candidate
  is copied once per block of queries that really come near it. Nothing is
  capped: the result is the exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acrescope.functions import scalars as S
from acrescope.session import cut_lineage

BLOCK_ROWS = 20_000
BROADCAST_BYTES = 8 << 20
DISTANCE_DIGITS = 9
_SLACK = 1e-6  # keeps float noise from ruling out a cell that ties the bound


def _allowed(candidate_year, query_year, rule: str):
    """Year rule: 'other' skips the query's own year, 'past' wants earlier ones."""
    if rule == "other":
        return candidate_year != query_year
    if rule == "past":
        return candidate_year < query_year
    raise ValueError(f"unknown year rule {rule!r}")


def top_k(pairs: DataFrame, query: list[str], ties: list[str], k: int) -> DataFrame:
    """The k nearest per query. The rank filter is pushed below the shuffle."""
    w = Window.partitionBy(*query).orderBy("distance", *ties)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_within(queries: DataFrame, candidates: DataFrame, on: list[str], k: int, query_id: list[str],
               ties: list[str], rule: str = "other", vec: str = "vec") -> DataFrame:
    """k nearest rows sharing the keys ``on``; groups are at most one row per year."""
    q = queries.select(*on, *[F.col(c).alias(f"q_{c}") for c in query_id if c not in on], F.col(vec).alias("_qv"))
    c = candidates.withColumnRenamed(vec, "_cv")
    pairs = q.join(c, on).where(_allowed(F.col("year"), F.col("q_year"), rule))
    pairs = pairs.withColumn("distance", F.round(S.euclidean("_qv", "_cv"), DISTANCE_DIGITS)).drop("_qv", "_cv")
    ids = [*on, *[f"q_{x}" for x in query_id if x not in on]]
    return top_k(pairs, ids, ties, k)


def _unit(vec, is_query: bool):
    """Map vectors so that squared distance / 2 is the cosine distance.

    A zero vector is at cosine distance one from everything, itself included;
    two extra axes, one for zero queries and one for zero candidates, say that.
    """
    v = F.col(vec)
    norm = F.sqrt(S.dot(v, v))
    zero = F.when(norm == 0, 1.0).otherwise(0.0)
    unit = F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))
    axes = F.array(zero, F.lit(0.0)) if is_query else F.array(F.lit(0.0), zero)
    return F.concat(unit, axes)


def _pivots(candidates: DataFrame, group: list[str], ids: list[str], n: int) -> DataFrame:
    """n pseudo-random candidates per group as one array; the pick is stable."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(*ids), *ids)
    picked = candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return picked.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_rn", "_v")))["_v"].alias("_pivots"))


def _cells(placed: DataFrame, q: DataFrame, group: list[str], k: int, block: int, rule: str) -> DataFrame:
    """Per (group, query year) one array with a summary of every cell.

    A summary holds the radius range, the number of salts and the radius within
    which k members allowed for that year lie. Its size is the number of
    pivots, whatever the data volume: only the k nearest members per cell and
    year enter it.
    """
    w = Window.partitionBy(*group, "_cell", "year").orderBy("_r")
    near = placed.select(*group, "_cell", "year", "_r").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    years = q.select(*group, "q_year").distinct()
    kth = (
        years.join(near, group).where(_allowed(F.col("year"), F.col("q_year"), rule))
        .groupBy(*group, "q_year", "_cell").agg(F.get(F.sort_array(F.collect_list("_r")), F.lit(k - 1)).alias("rk"))
    )
    size = placed.groupBy(*group, "_cell").agg(F.min("_r").alias("rmin"), F.max("_r").alias("rmax"), F.count(F.lit(1)).alias("n"))
    rows = years.join(size, group).join(kth, [*group, "q_year", "_cell"], "left").withColumn("salts", F.ceil(F.col("n") / block).cast("int"))
    return rows.groupBy(*group, "q_year").agg(F.collect_list(F.struct("_cell", "rmin", "rmax", "salts", "rk")).alias("_cells"))


def _measure(queries: DataFrame, candidates: DataFrame, group: list[str], vec: str) -> tuple[int, int, int, int]:
    """(candidates, groups, (group, query year) pairs, dimensions), one pass over each side."""
    rows, groups, dims = candidates.agg(F.count(F.lit(1)), F.count_distinct(*group), F.max(F.array_size(vec))).first()
    return rows, groups, queries.agg(F.count_distinct(*group, "year")).first()[0], dims or 0


def _checked_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only where measured rows times their width stay small."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def knn_join(queries: DataFrame, candidates: DataFrame, group: list[str], k: int, query_id: list[str],
             ties: list[str], rule: str = "other", metric: str = "euclidean", vec: str = "vec",
             pivots: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest candidates of the same group for every query.

    Returns the group, ``q_<id>`` columns, all candidate columns but the
    vector, ``distance`` and ``rank`` (ties by ``ties``).
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    q_names = [f"q_{c}" for c in query_id if c not in group]
    as_vec = (lambda side: F.col(vec).cast("array<double>")) if metric == "euclidean" else (lambda side: _unit(vec, side == "q"))
    q = queries.select(*group, *[F.col(c).alias(f"q_{c}") for c in query_id if c not in group], as_vec("q").alias("_v"))
    keep = [c for c in candidates.columns if c != vec]
    c = candidates.select(*keep, as_vec("c").alias("_v"))

    n_rows, n_groups, n_years, dims = _measure(queries, candidates, group, vec)
    if pivots is None:  # about an eighth of the root of the candidates
        pivots = int(max(4, n_rows ** 0.5 / 8))
    piv = _checked_broadcast(_pivots(c, group, ties, pivots), n_groups, 8 * (dims + 4) * pivots)
    # array of (distance, pivot number); the smallest struct is the nearest pivot
    to_pivots = F.transform("_pivots", lambda p, i: F.struct(S.euclidean(F.col("_v"), p).alias("d"), i.alias("i")))
    placed = (
        c.join(piv, group).withColumn("_near", F.array_min(to_pivots))
        .withColumn("_cell", F.col("_near.i")).withColumn("_r", F.col("_near.d")).drop("_near", "_pivots")
    )
    placed = cut_lineage(placed, "placed")  # distances to the pivots are computed once
    cells = _checked_broadcast(_cells(placed, q, group, k, block, rule), n_years, 64 * pivots)

    reach = q.join(piv, group).join(cells, [*group, "q_year"])
    measured = F.transform("_cells", lambda s: F.struct(
        s["_cell"].alias("cell"), s["rmin"].alias("rmin"), s["rmax"].alias("rmax"), s["salts"].alias("salts"), s["rk"].alias("rk"),
        S.euclidean(F.col("_v"), F.get(F.col("_pivots"), s["_cell"])).alias("d")))
    kth = lambda s: F.coalesce(s["d"] + s["rk"], F.lit(float("inf")))
    # the explode keeps the distances from being computed once per later use
    reach = reach.select(*group, *q_names, "_v", F.explode(F.array(measured)).alias("_m"))
    reach = reach.withColumn("_bound", F.array_min(F.transform("_m", kth)))
    open_cells = F.filter("_m", lambda s: F.greatest(s["d"] - s["rmax"], s["rmin"] - s["d"]) <= F.col("_bound") + _SLACK)
    reach = reach.withColumn("_s", F.explode(open_cells)).select(*group, *q_names, "_v", F.col("_s.cell").alias("_cell"), F.col("_s.salts").alias("_salts"))
    q_side, c_side = blocks(cut_lineage(reach, "reach"), placed, group, q_names, ties, block)
    c_side = c_side.select(*keep, "_v", "_cell", "_salt", "_qb")

    out_names = [*group, *q_names, *[x for x in keep if x not in group], "distance"]
    fields = {f.name: f for df in (q_side, c_side) for f in df.schema.fields}
    schema = T.StructType([fields[n] if n != "distance" else T.StructField("distance", T.DoubleType()) for n in out_names])
    compare = _block_compare(out_names, group, q_names, [x for x in keep if x not in group], ties, k, rule, metric)
    block_key = [*group, "_cell", "_salt", "_qb"]
    # fresh attributes: both sides may descend from one table
    q_side, c_side = q_side.toDF(*q_side.columns), c_side.toDF(*c_side.columns)
    # blocks are small in bytes and heavy in work: a stated number of partitions
    # keeps them from being packed into a few tasks
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_side, c_side = q_side.repartition(n, *block_key), c_side.repartition(n, *block_key)
    best = q_side.groupBy(*block_key).cogroup(c_side.groupBy(*block_key)).applyInPandas(compare, schema)
    return top_k(best, [*group, *q_names], ties, k)


def blocks(reach: DataFrame, placed: DataFrame, group: list[str], q_names: list[str], ties: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Queries and candidates of each opened cell, dealt out so that a block has about ``block`` of either.

    A query goes to every salt of the cells it opens, a candidate to as many
    query blocks as the queries that open its own cell fill. Both sides carry
    the cell's sizes, so neither needs the other's groups.
    """
    cell = [*group, "_cell"]
    load = reach.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_qblocks"), F.first("_salts").alias("_salts"))
    q_side = reach.drop("_salts").join(load, cell).withColumn("_qb", F.pmod(F.xxhash64(*q_names), F.col("_qblocks")).cast("int")) \
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts", "_qblocks")
    c_side = placed.join(load, cell).withColumn("_salt", F.pmod(F.xxhash64(*ties), F.col("_salts")).cast("int")) \
        .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_qblocks") - 1)))
    return q_side.select(*group, *q_names, "_v", "_cell", "_salt", "_qb"), c_side.drop("_salts", "_qblocks")


def _block_compare(out_names, group, q_names, c_names, ties, k, rule, metric):
    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({n: [] for n in out_names})
        right = right.sort_values(ties, kind="stable").reset_index(drop=True)
        cv = np.stack(right["_v"].to_numpy())
        cy, parts = right["year"].to_numpy(), []
        step = max(1, 4_000_000 // (len(right) * cv.shape[1] or 1))
        for at in range(0, len(left), step):
            rows = left.iloc[at:at + step]
            qv = np.stack(rows["_v"].to_numpy())
            sq = ((qv[:, None, :] - cv[None, :, :]) ** 2).sum(axis=2)
            dist = np.round(sq / 2.0 if metric == "cosine" else np.sqrt(sq), DISTANCE_DIGITS)
            qy = rows["q_year"].to_numpy()[:, None]
            dist = np.where(cy[None, :] != qy if rule == "other" else cy[None, :] < qy, dist, np.inf)
            order = np.argsort(dist, axis=1, kind="stable")[:, :k]
            qi = np.repeat(np.arange(len(rows)), order.shape[1])
            ci = order.ravel()
            d = dist[qi, ci]
            ok = np.isfinite(d)
            out = rows.iloc[qi[ok]][[*group, *q_names]].reset_index(drop=True)
            out = pd.concat([out, right.iloc[ci[ok]][c_names].reset_index(drop=True)], axis=1)
            parts.append(out.assign(distance=d[ok])[out_names])
        return pd.concat(parts, ignore_index=True)

    return compare
