import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_zfill_keeps_long_strings(spark):
    row = one(spark, a=S.zfill(F.lit("123456"), 5), b=S.norm_geoid(F.lit("1001.0")), c=S.compose_key(F.lit("8"), F.lit("1")))
    assert (row.a, row.b, row.c) == ("123456", "01001", "08001")


@pytest.mark.parametrize("text,want", [("1,234.5", 1234.5), (" (D)", None), ("(na)", None), ("", None), ("abc", None), ("  7 ", 7.0), ("NaN", None)])
def test_reported_numbers(spark, text, want):
    assert one(spark, v=S.parse_reported_number(F.lit(text))).v == want


def test_clip_keeps_null(spark):
    row = one(spark, n=S.clip(F.lit(None).cast("double"), 0.0, 1.0), hi=S.clip(F.lit(3.0), 0.0, 1.0), nan=S.null_if_nan(F.lit(float("nan"))))
    assert row.n is None and row.hi == 1.0 and row.nan is None


def test_missing_rain_is_wet(spark):
    assert one(spark, v=S.is_dry(F.lit(None).cast("double"))).v is False


@pytest.mark.parametrize("low,high", [(10.0, 35.0), (32.0, 40.0), (5.0, 20.0), (29.0, 31.0)])
def test_degree_hours_equals_the_integral(spark, low, high):
    got = one(spark, v=S.degree_hours(F.lit(low), F.lit(high), 86.0)).v
    hours = np.linspace(0, 24, 200_001)
    f = lambda c: c * 9 / 5 + 32
    temp = (f(low) + f(high)) / 2 + (f(high) - f(low)) / 2 * np.sin(2 * math.pi * hours / 24)
    want = np.trapezoid(np.maximum(temp - 86.0, 0), hours)
    assert got == pytest.approx(want, abs=1e-3)


def test_degree_hours_nulls(spark):
    none = F.lit(None).cast("double")
    row = one(spark, a=S.degree_hours(none, F.lit(10.0), 86.0), b=S.degree_hours(none, F.lit(40.0), 86.0), c=S.gdd_capped(none, F.lit(30.0)))
    assert row.a == 0.0 and row.b is None and row.c is None


@pytest.mark.parametrize("day,want", [("2018-07-16", None), ("2018-07-17", "aug1"), ("2018-08-16", None), ("2018-09-15", "sep1"), ("2018-10-16", None), ("2018-11-15", "final"), ("2018-11-16", None)])
def test_scene_phases_have_gaps(spark, day, want):
    assert one(spark, v=S.scene_phase(F.lit(day).cast("date"))).v == want


def test_scene_id(spark):
    parts = S.parse_scene_id(S.valid_scene_id(F.lit("HLS.S30.T14TPP.2020134T170851.v2.0")))
    row = one(spark, **parts)
    assert (row.sensor, row.tile, str(row.scene_date), row.scene_time, row.version) == ("S30", "14TPP", "2020-05-13", "17:08:51", "2.0")
    assert one(spark, v=S.parse_scene_id(S.valid_scene_id(F.lit("HLS.X30.T14TPP.2020134T170851.v2.0")))["sensor"]).v is None


@pytest.mark.parametrize("state,year", [("IA", 2018), ("NE", 2020), ("WI", 2013)])
def test_shard_is_the_md5_one(spark, state, year):
    want = int.from_bytes(hashlib.md5(f"{state}-{year}".encode()).digest()[:8], "big") % 4 + 1
    assert one(spark, v=S.shard_of(F.lit(state), F.lit(year), 4)).v == want


@pytest.mark.parametrize("qa,bad", [(0, False), (1, False), (2, True), (32, True), (64, False), (None, True)])
def test_quality_bits(spark, qa, bad):
    assert one(spark, v=S.qa_bad(F.lit(qa).cast("int"))).v is bad


def test_stage_text(spark):
    for text, want in [("YEAR", ("Final", 0)), (" Year - Nov Forecast ", ("Final", 3)), ("mid oct report", ("Oct 1", 9)), ("octane", (None, 99))]:
        stage, rank = S.stage_of_report(F.lit(text))
        row = one(spark, s=stage, r=rank)
        assert (row.s, row.r) == want


def test_contract_widths():
    assert [len(K.retrieval_columns(d)) for d in K.FORECAST_DATES] == [16, 18, 18, 18]
    assert [len(K.model_columns(d)) for d in K.FORECAST_DATES] == [35, 37, 37, 37]


def test_cosine_with_zero_vector(spark):
    zero, unit = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))
    row = one(spark, a=S.cosine_distance(zero, unit), b=S.cosine_distance(unit, unit))
    assert row.a == 1.0 and row.b == pytest.approx(0.0)
