"""Hard negatives against brute force, over several blocks, with ties, repeated ids and odd vectors."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acrescope.llm import hard_negatives as H
from acrescope.llm import queries

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor, rule=H.Rule(), scale=256):
    """rows: (id, label, vector)"""
    fine = []
    for r in rows:
        if None not in r and all(x is not None and math.isfinite(x) for x in r[2]) and r not in fine:
            fine.append(r)
    whole = [[math.floor(scale * float(x)) for x in r[2]] for r in fine]
    out = []
    for a, (i, label, _) in enumerate(fine):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(x * y for x, y in zip(whole[a], whole[b])), fine[b][0], fine[b][1]) for b in range(len(fine)) if b != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:rule.positives]:
            negatives = [(n, nid) for n, nid, other in scored if other != label and rule.low * -p <= 100 * -n <= rule.high * -p]
            out += [(i, pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(negatives[:rule.negatives])]
    return sorted(out)


def mined(df, is_anchor, **more):
    return sorted(tuple(r[c] for c in COLUMNS) for r in H.mine(df, is_anchor, **more).collect())


def frame(spark, rows, vector="float"):
    return spark.createDataFrame([(*r, "k", "s") for r in rows], f"vec_id long, label int, embedding array<{vector}>, key string, score string").repartition(3)


@pytest.mark.parametrize("block", [1 << 19, 40])
def test_against_brute_force_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK_VALUES", block)  # 40: ten vectors of four components a block
    monkeypatch.setattr(H, "CHUNK", block)
    rng = random.Random(1)
    rows = [(k, rng.choice([0, 0, 0, 0, 1, 2]), [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0, 1.5]) for _ in range(4)]) for k in range(-20, 130)]
    want = brute(rows, lambda i: i % 5 == 0)
    assert len(want) > 100 and mined(frame(spark, rows), F.col("vec_id") % 5 == 0) == want
    small = H.Rule(positives=2, negatives=1, low=10, high=100)
    assert mined(frame(spark, rows), F.col("vec_id") % 5 == 0, rule=small, scale=3) == brute(rows, lambda i: i % 5 == 0, small, 3)


def test_odd_rows(spark):
    nan, inf, big = float("nan"), float("inf"), 2.0 ** 22
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (0, 1, [1.0, 0.5]), (0, 2, [0.5, 0.5]), (1, 1, [1.0]), (2, 1, []), (3, 2, [0.0, 0.0]), (4, None, [1.0, 1.0]),
            (5, 2, None), (None, 2, [0.6, 0.6]), (6, 2, [nan, 1.0]), (7, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (9, 2, [0.7, 0.7]), (10, 3, [-1.0, -1.0]), (11, 3, [-0.5, 1.0]),
            (12, 4, [big, 1.0]), (13, 4, [big, -1.0]), (14, 5, [0.9 * big, 3.0])]
    is_anchor = lambda i: i in (0, 2, 10, 12)
    want = brute(rows, is_anchor)
    got = mined(frame(spark, rows, "double"), F.col("vec_id").isin(0, 2, 10, 12))
    assert got == want and any(r[0] == 12 for r in want)
    df = frame(spark, rows)
    assert H.mine(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0 and H.mine(df, F.lit(False)).count() == 0
    assert H.mine(df.where("label = 1"), F.col("vec_id") == 0).count() == 0  # no other label


def test_one_label_and_one_id_hold_most_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_VALUES", 600)
    rng = np.random.default_rng(2)
    rows = [(7 if k % 3 else k, 0 if k % 5 else 1, [float(x) for x in rng.integers(-3, 9, 6) / 4]) for k in range(1500)]
    want = brute(rows, lambda i: i % 50 == 0)
    assert mined(frame(spark, rows), F.col("vec_id") % 50 == 0) == want


def test_blocks_send_on_a_bounded_number_of_pairs(monkeypatch):
    """A block of many rows within reach gives at most three negatives for each window."""
    n, rng = 2000, np.random.default_rng(3)
    table = pa.table({"anchor_part": [0] * (n + 1), "row_part": [0] * (n + 1), "asks": [True] + [False] * n, "vec_id": np.arange(n + 1), "content": np.arange(n + 1),
                      "label": [0] + [1] * n, "vector": [[1.0]] + [[float(x)] for x in rng.random(n)], "goals": [[256 * 256, 200 * 256]] + [None] * n})
    (out,) = H._negatives(H.Rule(), 256)(iter(table.combine_chunks().to_batches()))
    assert out.num_rows <= 6


def test_keys_order_as_their_parts_do():
    rng = random.Random(4)
    edge = [-(1 << 63), -5, -1, 0, 1, 7, (1 << 63) - 1]
    parts = [(rng.choice(edge), rng.choice(edge), rng.choice(edge), rng.choice(edge)) for _ in range(300)]
    keys = []
    for kind in (0, 1):
        keys += list(zip(H.pack(*([p[c] for p in parts] for c in range(3)), kind, [p[3] for p in parts]).to_pylist(), [(a, c, -s, kind, i) for a, c, s, i in parts]))
    assert [k for _, k in sorted(keys)] == sorted(k for _, k in keys)
    got = H.unpack(pa.array([k for k, _ in keys[:300]]))
    assert list(zip(*(got[c].tolist() for c in ("anchor", "content", "score", "id")))) == parts


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    rows = [(i, None if c is None else (c + 1) % 10 if i % 7 == 0 else c, v) for i, c, v in rows]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.op13_hard_negatives(spark, sf_dir).collect())
    assert got == brute(rows, lambda i: i % 50 == 0) and got
