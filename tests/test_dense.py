"""Queries on tables with so many lines per county and day that every day has the same degree days.

On such tables (60 times sf0.1 and more) contract columns are constant in the
training pool, which the standardizer once refused.
"""

import math
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from oracle_compare import compare

import __spark_entry__ as entry_module
from acrescope.operators import boosting
from acrescope.plans.fixtures import CONTRACT, SCHEMAS, Fixtures
from acrescope.plans.forecasting import GRID, Forecasting

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
Z_SQL = "(v - s.mean) / s.std"
N_ROWS = {  # rows of each query over 8 counties, 2 states, 7 years and 4 dates
    "state_forecast_doc_model": 16,
    "analog_index_contract": 4,
    "backtest_sweep": 64,
    "bias_constants": 32,
    "cf_detrend": 64,
    "cone_rollup": 64,
    "county_forecast": 64,
    "bundle_trends": 8,
    "coverage_verdict": 16,
    "driver_rollup": 588,
    "gates": 1,
    "error_decomposition": 2,
    "gates_recal": 1,
    "importance": 46,
    "knn_join": 1120,
    "lift_gate": 2,
    "knn_join_same_entity": 960,
    "lift_gate_dates": 4,
    "percentile_cone": 256,
    "importance_model": 46,
}
READS_Z = {  # whether the SQL of the query divides by the spread
    "state_forecast_doc_model": True,
    "analog_index_contract": True,
    "backtest_sweep": True,
    "bias_constants": True,
    "cf_detrend": True,
    "cone_rollup": True,
    "county_forecast": True,
    "bundle_trends": False,
    "coverage_verdict": True,
    "driver_rollup": True,
    "gates": True,
    "error_decomposition": True,
    "gates_recal": True,
    "importance": True,
    "knn_join": True,
    "lift_gate": True,
    "knn_join_same_entity": True,
    "lift_gate_dates": True,
    "percentile_cone": True,
    "importance_model": False,
}
FLAT = ["gdd_cum_f50_c86", "edd_hours_gt86f", "dry_spell_max_days"]


def _tables():
    rng = np.random.default_rng(3)
    segments, priorities = ("AUTOMOBILE", "BUILDING"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    customers = [(2 * n + s, f"c{n}{s}", n, 0.0, segments[s]) for n in range(4) for s in range(2)]
    orders, lines = [], []
    for year in range(1995, 2002):
        for step in range(38):
            day = datetime(year, 4, 20) + timedelta(days=6 * step)
            for c, *_ in customers:
                key = len(orders)
                orders.append((key, c, "O", 0.0, day, priorities[rng.integers(5)]))
                for number, quantity in enumerate((1.0, 50.0, float(rng.integers(2, 50)))):  # coldest, hottest, any
                    lines.append((key, key, key % 7, number + 1, quantity, float(rng.uniform(900, 90_000)), float(rng.uniform(0.05, 0.1)),
                                  float(rng.uniform(0, 0.08)), "RNA"[rng.integers(3)], "O", day))
    return {"region": [(0, "EAST"), (1, "WEST")], "nation": [(n, f"N{n}", n % 2) for n in range(4)], "customer": customers,
            "supplier": [(s, f"s{s}", 0, 0.0) for s in range(7)], "part": [(0, "p", "b", "t", 1, 1.0)], "orders": orders, "lineitem": lines,
            "embeddings": [(v, [float(x) for x in rng.normal(size=8)], v % 10) for v in range(40)]}


@pytest.fixture(scope="module")
def dense(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("dense"))
    for name, rows in _tables().items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(dense):
    con = duckdb.connect()
    for t in SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{dense}/{t}.parquet/*.parquet')")
    return con


@pytest.fixture(scope="module")
def chain(spark, dense):
    """The chain that the queries share, with small picks in the sweep's place."""
    f = Forecasting.of(Fixtures(spark, dense))
    f.__dict__["swept"] = (None, {d: boosting.Pick(0, GRID[0], 2, 1.0, True) for d in CONTRACT})
    return f


def test_nearest_years_by_the_columns_with_spread(spark, dense, chain):
    columns = CONTRACT["EOS"]
    rows = chain.ready.where("forecast_date = 'EOS' AND complete").select("geoid", "year", *columns).toPandas()
    pool = rows[rows.year <= 1999]
    assert (pool[FLAT].nunique() == 1).all()
    used = [c for c in columns if c not in FLAT]
    z = lambda df: ((df[used] - pool[used].mean()) / pool[used].std(ddof=0)).to_numpy()
    distance = np.round(np.sqrt(((z(rows)[:, None, :] - z(pool)[None, :, :]) ** 2).sum(axis=2)), 9)
    want = {(q.geoid, q.year): sorted(d for d, y in zip(distance[i], pool.year) if y != q.year)[:5] for i, q in enumerate(rows.itertuples())}
    got = {}
    for r in QUERIES["knn_join"](spark, dense).where("forecast_date = 'EOS'").orderBy("rank").collect():
        got.setdefault((r.q_geoid, r.q_year), []).append(r.distance)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


@pytest.mark.parametrize("name", N_ROWS)
def test_query_on_dense_tables(name, spark, dense, chain):
    rows = QUERIES[name](spark, dense).collect()
    assert len(rows) == N_ROWS[name]
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


@pytest.mark.parametrize("name", READS_Z)
def test_query_equals_sql_without_the_constant_columns(name, spark, dense, chain, duck):
    sql = ORACLES[name].replace(Z_SQL, f"CASE WHEN s.std <= 1e-10 * abs(s.mean) THEN 0.0 ELSE {Z_SQL} END")
    assert (sql != ORACLES[name]) == READS_Z[name]
    message = compare(spark, duck, name, QUERIES[name], sql, dense)
    assert message is None, message
