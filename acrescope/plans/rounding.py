"""Fixed-precision output, so that summation order does not show.

Many given values have short decimals and land exactly on a rounding edge; a
small fixed offset, far above float noise and far below the last digit kept,
puts both engines on the same side of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OFFSET = {d: f"3.3e-{d + 2}" for d in range(10)}


def fix(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + float(_OFFSET[digits]), digits)


def fix_sql(expr: str, digits: int = 6) -> str:
    return f"round(CAST(({expr}) AS DOUBLE) + {_OFFSET[digits]}, {digits})"


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: fix(c, digits) for c in columns})


def rsql(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"{fix_sql(c, digits)} AS {c.split('.')[-1]}" for c in columns)
