"""Compare registered queries with their DuckDB equivalents.

    python tests/oracle_compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
DATA = "/root/testdata"

_SPARK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
                "date": "DATE", "float": "FLOAT"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if got_rows else "no rows"
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want_types = {d[0]: str(d[1]) for d in cur.description}
    want_rows = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    types = {c: _SPARK_TYPES.get(t, t) for c, t in df.dtypes}
    bad = {c: (types[c], want_types[c]) for c in types if c in want_types and types[c] != want_types[c] and types[c] in _SPARK_TYPES.values()}
    if len(got_rows) != len(want_rows):
        return f"rows {len(got_rows)} != {len(want_rows)}"
    if not got_rows:
        return "no rows on either side"
    a, b = _table(df.columns, got_rows), _table(want_cols, want_rows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diffs)} rows differ of {len(a)}, columns {sorted(df.columns)}: {diffs[:2]}"
    return f"types {bad}" if bad else None


def main(argv):
    from acrescope.plans import load_catalog
    from acrescope.session import get_session

    sf = "0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    sf_dir = f"{DATA}/sf{sf}"
    queries, oracles = load_catalog()
    names = argv or list(queries)
    spark = get_session(cpus=8, **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            msg = compare(spark, con, name, queries[name], oracles.get(name), sf_dir)
        except Exception as e:  # report and go on to the next query
            msg = f"{type(e).__name__}: {str(e)[:1500]}"
        note = "" if name in oracles else " (rows only)"
        print(f"{'ok  ' if msg is None else 'FAIL'} {name}{note} {time.time() - start:.1f}s" + (f"\n     {msg}" if msg else ""), flush=True)
        if msg:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
