"""Hard negatives: scores packed into sort keys, a secondary-sort shuffle and one pass that opens a window at each positive."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrescope.llm.common import cut_lineage, sorted_groups

BLOCK_VALUES = 1 << 19  # vector components of one side of a block
CHUNK = 1 << 21  # scores a task holds at once
_SIGN = np.uint64(1 << 63)
_EXACT = float(1 << 53)  # sums of whole numbers below are exact in double precision
# one pair: anchor, content hash of the anchor, score from high to low, 0 for a positive and 1 for a negative, id; all order as bytes do
_KEY = np.dtype([("anchor", ">u8"), ("content", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
_POSITIVE, _NEGATIVE = 0, 1


@dataclass(frozen=True)
class Rule:
    """What to mine: positives per anchor, negatives per positive, and the share of the positive's score (in percent) negatives lie in."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


# --- keys -----------------------------------------------------------------------
def _bits(x) -> np.ndarray:
    return np.asarray(x, np.int64).view(np.uint64) ^ _SIGN


def _whole(x) -> np.ndarray:
    return (np.ascontiguousarray(x).astype(np.uint64) ^ _SIGN).view(np.int64)


def pack(anchor, content, score, kind: int, ids) -> pa.Array:
    """Sort keys of pairs: by anchor, then by score from high to low, then by id."""
    out = np.empty(len(anchor), _KEY)
    out["anchor"], out["content"], out["score"], out["kind"], out["id"] = _bits(anchor), _bits(content), ~_bits(score), kind, _bits(ids)
    offsets = np.arange(len(out) + 1, dtype=np.int64) * _KEY.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(out), [None, pa.py_buffer(offsets), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpack(keys: pa.Array) -> dict[str, np.ndarray]:
    """The parts of sort keys."""
    got = np.frombuffer(b"".join(keys.to_pylist()), _KEY)
    return {"anchor": _whole(got["anchor"]), "content": _whole(got["content"]), "score": _whole(~got["score"].astype(np.uint64)), "kind": got["kind"], "id": _whole(got["id"])}


# --- scores ---------------------------------------------------------------------
def whole_vectors(vectors: pa.ChunkedArray, scale: int) -> np.ndarray:
    """floor(scale * x) of all components as doubles that are whole numbers; shorter vectors end in zeros."""
    vectors = vectors.combine_chunks()
    size = np.array(pc.list_value_length(vectors), np.int64)
    out = np.zeros((len(size), int(size.max()) if len(size) else 0))
    values = np.floor(scale * np.asarray(pc.list_flatten(vectors), np.float64))
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole inner products: in doubles while every sum is surely exact, else in unbounded integers that end at 64 bits."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width < _EXACT:
        return (a @ b.T).astype(np.int64)
    ints = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(ints(a) @ ints(b).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k of each row, highest score first, ties to the smaller id."""
    order = np.lexsort((ids, ~score, row))
    sorted_row = row[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_row[1:] != sorted_row[:-1]])) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return order[place < k]


def window_of(score: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score of a negative for positive scores, in whole numbers; empty for negative ones."""
    whole, rest = np.divmod(score, 100)
    return whole * rule.low - (-(rest * rule.low) // 100), whole * rule.high + rest * rule.high // 100


def _chunks(group: pa.Table, scale: int):
    """(anchor rows, candidates, scores) of one block, a bounded number of scores at a time."""
    asks = group.column("asks").to_numpy()
    anchors, others = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
    if not anchors.num_rows or not others.num_rows:
        return
    a, b = whole_vectors(anchors.column("vector"), scale), whole_vectors(others.column("vector"), scale)
    step = max(1, CHUNK // others.num_rows)
    for k in range(0, anchors.num_rows, step):
        yield anchors.slice(k, step), others, inner_products(a[k:k + step], b)


def _positives(rule: Rule, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["label_part", "anchor_part", "row_part"]):
            for anchors, others, score in _chunks(group, scale):
                ids, content = others.column("vec_id").to_numpy(), others.column("content").to_numpy()
                anchor, own = anchors.column("vec_id").to_numpy(), anchors.column("content").to_numpy()
                score = np.where((ids == anchor[:, None]) & (content == own[:, None]), np.iinfo(np.int64).min, score)
                k = min(rule.positives + 1, score.shape[1])
                least = -np.partition(~score, k - 1, axis=1)[:, k - 1] - 1  # the anchor itself is there at most once
                row, col = np.nonzero((score >= least[:, None]) & ((ids != anchor[:, None]) | (content != own[:, None])))
                at = _best(row, score[row, col], ids[col], rule.positives)
                row, col = row[at], col[at]
                yield pa.RecordBatch.from_arrays(
                    [pack(anchor[row], own[row], score[row, col], _POSITIVE, ids[col]), pa.array(anchor[row]), pa.array(own[row]), pa.array(score[row, col])],
                    names=["key", "vec_id", "content", "score"])

    return run


def _negatives(rule: Rule, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["anchor_part", "row_part"]):
            kinds = group.column("label").combine_chunks().dictionary_encode().indices
            group = group.set_column(group.schema.get_field_index("label"), "label", kinds)
            for anchors, others, score in _chunks(group, scale):
                anchor, own, ids = anchors.column("vec_id").to_numpy(), anchors.column("content").to_numpy(), others.column("vec_id").to_numpy()
                goals = anchors.column("goals").to_pylist()
                size = np.array([len(g) for g in goals])
                whose, (low, high) = np.repeat(np.arange(len(goals)), size), window_of(np.array([s for g in goals for s in g], np.int64), rule)
                # scores in reach of any window of the anchor, of another label
                first = np.cumsum(size) - size
                floor, roof = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
                fits = (score >= floor[:, None]) & (score <= roof[:, None])
                fits &= others.column("label").to_numpy() != anchors.column("label").to_numpy()[:, None]
                row, col = np.nonzero(fits)
                value = score[row, col]
                taken = []
                for k in range(int(size.max())):  # the k-th window of every anchor that has one
                    has = size > k
                    at_low, at_high = np.ones(len(size), np.int64), np.zeros(len(size), np.int64)
                    at_low[has], at_high[has] = low[first[has] + k], high[first[has] + k]
                    inside = np.flatnonzero((value >= at_low[row]) & (value <= at_high[row]))
                    taken.append(inside[_best(row[inside], value[inside], ids[col[inside]], rule.negatives)])
                at = np.unique(np.concatenate(taken))
                row, col = row[at], col[at]
                yield pa.RecordBatch.from_arrays([pack(anchor[row], own[row], value[at], _NEGATIVE, ids[col])], names=["key"])

    return run


# --- the sorted stream ------------------------------------------------------------
def _stream(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened, windows = None, 0, []
        for batch in batches:
            if not batch.num_rows:
                continue
            got, out = unpack(batch.column("key")), []
            for anchor, content, score, kind, i in zip(*(got[c].tolist() for c in ("anchor", "content", "score", "kind", "id"))):
                if (anchor, content) != now:
                    now, opened, windows = (anchor, content), 0, []
                if kind == _POSITIVE:
                    opened += 1
                    if opened <= rule.positives:
                        windows.append([i, score, 0])
                    continue
                windows = [w for w in windows if w[2] < rule.negatives and rule.low * w[1] <= 100 * score]  # scores only fall from here
                for w in windows:
                    if 100 * score <= rule.high * w[1]:
                        w[2] += 1
                        out.append((anchor, w[0], w[2], i, w[1], score))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def _parts(rows: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / F.lit(size))).cast("int")


def _spread(rows: DataFrame, n: str, own: str, other: str, salt: int, times: str) -> DataFrame:
    """Each row in one of ``n`` parts of its own side, once for each part of the other side."""
    return rows.withColumns({own: F.pmod(F.xxhash64("vec_id", "content", F.lit(salt)), F.col(n)).cast("int"),
                             other: F.explode(F.sequence(F.lit(0), F.col(times) - 1))})


def mine(vectors: DataFrame, is_anchor: Column, *, rule: Rule = Rule(), scale: int = 256, vec_id: str = "vec_id", label: str = "label",
         vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the whole inner product with the anchor, higher first, ties to
    the smaller id. An anchor's positives are the first other rows of its label; for each the first rows of other
    labels follow whose score lies in ``rule``'s share of the positive's. A positive below zero has no such row.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows equal in id, label and vector
    are one row; rows that share only the id are different ones, each an anchor of its own. Missing components of
    shorter vectors count as zero. Scores beyond 64 bits end at the last of them. An empty table gives an empty one; columns of other names take no part.

    Scores are made in blocks of bounded size, anchors against their own label for the positives (a large label has
    many blocks), then, with the windows known, against all rows. A block sends on what it could contribute at most:
    its first positives of an anchor, and its first negatives of each window. Their keys are partitioned by anchor and
    sorted, and one iterator opens a window at each positive and closes it when it is full or passed.
    """
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(is_anchor.isNotNull() & F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("vector"), is_anchor.alias("anchor")).distinct()
    rows = cut_lineage(rows.withColumn("content", F.xxhash64("label", "vector")), "vectors")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("n_anchors"), F.max(F.size("vector")).alias("width"))
    total, n_anchors, width = sizes.agg(F.sum("n"), F.sum("n_anchors"), F.max("width")).first()
    block = max(1, BLOCK_VALUES // max(width or 1, 1))

    split = rows.join(sizes.where("n_anchors > 0").select(
        "label", _parts(F.col("n_anchors"), block).alias("anchor_parts"), _parts(F.col("n"), block).alias("row_parts")), "label")
    split = split.withColumn("label_part", F.xxhash64("label"))
    asks = _spread(split.where("anchor"), "anchor_parts", "anchor_part", "row_part", 1, "row_parts").withColumn("asks", F.lit(True))
    given = _spread(split, "row_parts", "row_part", "anchor_part", 2, "anchor_parts").withColumn("asks", F.lit(False))
    keys = ["label_part", "anchor_part", "row_part"]
    met = asks.unionByName(given).select(*keys, "asks", "vec_id", "content", "vector").repartition(*keys).sortWithinPartitions(*keys)
    found = met.mapInArrow(_positives(rule, scale), "key binary, vec_id long, content long, score long")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("vec_id", "content").orderBy("key")))
    positives = cut_lineage(ranked.where(F.col("place") <= rule.positives), "positives")

    goals = positives.groupBy("vec_id", "content").agg(F.collect_list("score").alias("goals"))
    parts = rows.withColumns({"anchor_parts": _parts(F.lit(n_anchors or 0), block), "row_parts": _parts(F.lit(total or 0), block)})
    asks = _spread(parts.where("anchor").join(goals, ["vec_id", "content"]), "anchor_parts", "anchor_part", "row_part", 1, "row_parts").withColumn("asks", F.lit(True))
    given = _spread(parts, "row_parts", "row_part", "anchor_part", 2, "anchor_parts").withColumns({"asks": F.lit(False), "goals": F.lit(None).cast("array<long>")})
    keys = ["anchor_part", "row_part"]
    met = asks.unionByName(given).select(*keys, "asks", "vec_id", "content", "label", "vector", "goals").repartition(*keys).sortWithinPartitions(*keys)
    negatives = met.mapInArrow(_negatives(rule, scale), "key binary")

    pairs = positives.select("key").unionByName(negatives)
    ordered = pairs.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")
    return ordered.mapInArrow(_stream(rule), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
