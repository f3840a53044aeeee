"""Approximate nearest neighbours by collision counting on single projections with query-centred windows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acrescope.llm.common import sorted_groups

BLOCK = 8192  # vectors whose projections are sorted together
QUERIES = 512  # queries that search a block together
PROJECTIONS = 32


@dataclass(frozen=True)
class Plan:
    """Windows and collision threshold that find a vector at distance s with probability ``recall``.

    A projection of the difference is normal with deviation s. With half width
    reach * s a vector at s collides with probability ``p``, so it reaches
    ``threshold`` of the projections with at least the wanted probability; one
    nearer does so more often.
    """

    projections: int = PROJECTIONS
    reach: float = 0.7
    recall: float = 0.95

    @property
    def threshold(self) -> int:
        p = math.erf(self.reach / math.sqrt(2))
        tail, level = 0.0, 0
        for k in range(self.projections + 1):
            tail += math.comb(self.projections, k) * p ** k * (1 - p) ** (self.projections - k)
            if tail > 1 - self.recall:
                return max(level, 1)
            level = k + 1
        return level


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.array(flat.to_pylist(), dtype=np.float64)


def search_block(ids: np.ndarray, keys: np.ndarray, base: np.ndarray, extra: np.ndarray, query_keys: np.ndarray, queries: np.ndarray, k: int, plan: Plan,
                 seed: int = 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, vector ids, inner products) of the best k found in a block for each query, the row with the query's own key left out.

    ``extra`` is the coordinate that gives all vectors one length, so that the
    nearest vector is the one with the largest inner product; queries have 0
    there. The first, narrow windows bound the kth distance by verifying the
    vectors with most collisions; then the windows of all projections grow, by
    virtual rehashing, to what that distance asks for, and each vector that
    reaches the collision threshold is verified. The distance only shrinks, so
    one growth is enough.
    """
    n, dim = base.shape
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(plan.projections, dim + 1))
    spots = base @ a[:, :dim].T + extra[:, None] * a[:, dim]
    order = np.argsort(spots, axis=0, kind="stable")
    arrays = [np.ascontiguousarray(spots[order[:, j], j]) for j in range(plan.projections)]
    rows = [order[:, j].astype(np.int32) for j in range(plan.projections)]
    at = queries @ a[:, :dim].T
    own = {v: r for r, v in enumerate(keys.tolist())}
    length2, y2, need = float(((base ** 2).sum(1) + extra ** 2).max()), (queries ** 2).sum(1), plan.threshold
    sample = np.linspace(0, n - 1, min(n, 4 * k)).astype(int)

    def windows(radius):
        low = np.stack([np.searchsorted(arrays[j], at[:, j] - radius, "left") for j in range(plan.projections)], axis=1)
        high = np.stack([np.searchsorted(arrays[j], at[:, j] + radius, "right") for j in range(plan.projections)], axis=1)
        return low, high

    def goal(q, score):
        if len(score) < k:
            return math.inf
        kth = np.partition(score, len(score) - k)[len(score) - k]
        return plan.reach * math.sqrt(max(length2 + y2[q] - 2 * kth, 0.0))

    first = np.array([goal(q, base[sample] @ queries[q]) for q in range(len(queries))])
    low, high = windows(np.where(np.isinf(first), math.inf, first / 3))
    counts, goals, state = [], np.zeros(len(queries)), []
    for q in range(len(queries)):
        count = np.bincount(np.concatenate([rows[j][x:y] for j, (x, y) in enumerate(zip(low[q].tolist(), high[q].tolist()))]), minlength=n).astype(np.int16)
        skip = own.get(int(query_keys[q]), -1)
        top = np.argpartition(count, n - min(n, 4 * k))[n - min(n, 4 * k):]
        top = np.union1d(top, np.flatnonzero(count >= need))
        top = top[top != skip]
        score = base[top] @ queries[q]
        goals[q] = goal(q, score)
        counts.append(count)
        state.append((skip, top, score))
    wider = goals > np.where(np.isinf(first), math.inf, first / 3)
    new_low, new_high = windows(np.where(wider, goals, 0.0))
    for q in range(len(queries)):
        skip, found, score = state[q]
        if wider[q]:
            sides = [rows[j][x:y] for j, (x, y) in enumerate(zip(new_low[q].tolist(), low[q].tolist()))]
            sides += [rows[j][x:y] for j, (x, y) in enumerate(zip(high[q].tolist(), new_high[q].tolist()))]
            count = counts[q] + np.bincount(np.concatenate(sides), minlength=n)
            hit = count >= need
            hit[found] = False
            if skip >= 0:
                hit[skip] = False
            fresh = np.flatnonzero(hit)
            found, score = np.concatenate([found, fresh]), np.concatenate([score, base[fresh] @ queries[q]])
        counts[q] = None
        if len(found) > k:
            keep = score >= np.partition(score, len(score) - k)[len(score) - k]
            found, score = found[keep], score[keep]
        yield q, ids[found], score


def _search(k: int, plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["block", "part"]):
            asks = group.column("asks").to_numpy()
            base, query = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
            if not base.num_rows or not query.num_rows:
                continue
            ids, query_ids, query_keys = base.column("vec_id").to_numpy(), query.column("vec_id").to_numpy(), query.column("key").to_numpy()
            out = []
            for q, found, score in search_block(ids, base.column("key").to_numpy(), _matrix(base.column("vector")), base.column("extra").to_numpy(), query_keys,
                                                _matrix(query.column("vector")), k, plan):
                best = np.lexsort((found, -score))[:k]
                out.append((np.full(len(best), query_ids[q]), np.full(len(best), query_keys[q]), found[best], score[best]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "query_key", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, plan: Plan = Plan(), block: int = BLOCK,
           queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k other vectors with the largest inner product found.

    All vectors are indexed, in blocks of about ``block``; every query block
    meets every index block, and k rows per query and block go on. Scores are
    inner products of the original vectors in double precision; ties go to the
    smaller id. No number of candidates is capped.

    Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do null ids; lengths must agree. Rows equal in id and vector are one
    row; rows that share only the id are vectors of their own, each found and each
    asking for its own neighbours, the others of its id among them.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector")).distinct()
    rows = rows.withColumn("key", F.xxhash64("vec_id", "vector"))
    norm2 = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, longest = rows.agg(F.count("*"), F.max(norm2)).first()
    blocks, parts = max(1, -(-n // block)), max(1, -(-rows.where(is_query).count() // queries))
    base = rows.withColumns({"extra": F.sqrt(F.greatest(F.lit(longest or 0.0) - norm2, F.lit(0.0))), "asks": F.lit(False),
                             "block": F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    asks = rows.where(is_query).withColumns({"extra": F.lit(0.0), "asks": F.lit(True), "part": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)).cast("int"),
                                             "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    met = base.unionByName(asks).repartition("block", "part").sortWithinPartitions("block", "part")
    found = met.mapInArrow(_search(k, plan), "query_id long, query_key long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
