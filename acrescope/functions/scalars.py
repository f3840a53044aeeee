"""Column functions. Built-ins only, so they stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from acrescope import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_if_nan(c) -> Column:
    """NaN means missing; the engine only knows NULL."""
    return F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))


def clip(c, low=None, high=None) -> Column:
    """Bound a value, keeping NULL (greatest/least would skip it)."""
    c = _col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


# --- keys and codes ----------------------------------------------------------
def zfill(c, width: int) -> Column:
    """Left-pad with zeros; unlike lpad, longer strings are kept whole."""
    c = _col(c).cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def norm_geoid(c, width: int = 5) -> Column:
    return zfill(F.regexp_replace(_col(c).cast("string"), r"\.0$", ""), width)


def compose_key(state_code, county_code) -> Column:
    return F.concat(zfill(F.trim(_col(state_code)), 2), zfill(F.trim(_col(county_code)), 3))


def map_codes(c, mapping: dict) -> Column:
    """Closed code map of fixed size as one literal map lookup; unknown -> NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(c))


def parse_reported_number(c) -> Column:
    """Thousands separators dropped; suppressed, blank or bad text -> NULL."""
    text = F.trim(F.replace(_col(c).cast("string"), F.lit(","), F.lit("")))
    return F.when(~F.upper(text).isin(*K.SUPPRESSED) & (text != ""), null_if_nan(text.try_cast("double")))


def is_placeholder(county_code, county_name) -> Column:
    blank = F.coalesce(F.trim(_col(county_code)), F.lit("")) == ""
    other = F.upper(F.trim(F.coalesce(_col(county_name), F.lit("")))).startswith("OTHER")
    return blank | other


def stage_of_report(period) -> tuple[Column, Column]:
    """(stage, priority) of a report period: exact text, else a month token."""
    text = F.lower(F.trim(F.coalesce(_col(period), F.lit(""))))
    token = F.regexp_extract(text, r"\b(aug|sep|oct|nov|jan)\b", 1)
    exact_stage = map_codes(text, {k: v[0] for k, v in K.REPORT_STAGES.items()})
    exact_rank = map_codes(text, {k: v[1] for k, v in K.REPORT_STAGES.items()})
    stage = F.coalesce(exact_stage, map_codes(token, K.MONTH_STAGE))
    rank = F.coalesce(exact_rank, F.when(token != "", F.lit(9)), F.lit(99))
    return stage, rank


def label_fallback(label, key, state) -> Column:
    return F.coalesce(_col(label), F.concat(F.lit("FIPS "), zfill(key, 5), F.lit(", "), _col(state)))


def shard_of(state, year, shards: int) -> Column:
    """Stable shard 1..n of a (state, year) cell from the first 8 md5 bytes."""
    digest = F.md5(F.concat_ws("-", _col(state), _col(year).cast("string")))
    head = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(shards).cast("decimal(20,0)")).cast("int") + 1


# --- survey ratios -----------------------------------------------------------
def irrigated_share(irrigated, total) -> Column:
    return clip(F.coalesce(F.try_divide(_col(irrigated), _col(total)), F.lit(0.0)), 0.0, 1.0)


def rainfed_area(total, irrigated) -> Column:
    return _col(total) - F.coalesce(_col(irrigated), F.lit(0.0))


def harvest_ratio(harvested, planted) -> Column:
    return clip(F.try_divide(_col(harvested), _col(planted)), 0.0, 1.0)


# --- units and weather -------------------------------------------------------
def kelvin_to_c(c) -> Column:
    return _col(c) - 273.15


def watts_to_mj_day(c) -> Column:
    return _col(c) * 0.0864


def c_to_f(c) -> Column:
    return _col(c) * 9.0 / 5.0 + 32.0


def reflectance(c) -> Column:
    return _col(c) * K.REFLECTANCE_SCALE


def gdd_capped(tmin_c, tmax_c) -> Column:
    """Growing degree days; both ends are clamped before they are averaged."""
    low = clip(c_to_f(tmin_c), K.GDD_BASE_F, K.GDD_CAP_F)
    high = clip(c_to_f(tmax_c), K.GDD_BASE_F, K.GDD_CAP_F)
    return clip((low + high) / 2.0 - K.GDD_BASE_F, 0.0)


def degree_hours(tmin_c, tmax_c, threshold_f: float) -> Column:
    """Degree hours above a threshold under a single sine day."""
    low, high, t = c_to_f(tmin_c), c_to_f(tmax_c), F.lit(float(threshold_f))
    mean, amp = (low + high) / 2.0, (high - low) / 2.0
    theta = F.asin(clip(F.try_divide(t - mean, amp), -1.0, 1.0))
    crossing = (24.0 / F.pi()) * ((mean - t) * (F.pi() / 2.0 - theta) + amp * F.cos(theta))
    return F.when(low >= t, 24.0 * (mean - t)).when(high > t, clip(crossing, 0.0)).otherwise(0.0)


def is_dry(prcp_mm, threshold: float = K.DRY_DAY_MM) -> Column:
    """A missing reading counts as wet."""
    return F.coalesce(_col(prcp_mm) < threshold, F.lit(False))


# --- calendar ----------------------------------------------------------------
def month_day(c) -> Column:
    c = _col(c)
    return F.month(c) * 100 + F.dayofmonth(c)


def cutoff_date(year, label, table: dict = K.WEATHER_CUTOFF_MD) -> Column:
    """As-of date of a (year, label); unknown label -> NULL."""
    y, lab = _col(year), _col(label)
    month = map_codes(lab, {k: v[0] for k, v in table.items()})
    day = map_codes(lab, {k: v[1] for k, v in table.items()})
    return F.make_date(y.cast("int"), month, day)


def date_rank(label) -> Column:
    return map_codes(label, {d: i for i, d in enumerate(K.FORECAST_DATES)})


def season_interval(day, table: dict = K.WEATHER_CUTOFF_MD) -> Column:
    """Index of the first cutoff after a day of the season, NULL outside it.

    Cutoffs are cumulative, so a row belongs to the interval of the first
    cutoff that may see it; later cutoffs add the earlier intervals up.
    """
    md = month_day(day)
    start = K.SEASON_START_MD[0] * 100 + K.SEASON_START_MD[1]
    out = F.when(md < start, F.lit(None).cast("int"))
    for i, label in enumerate(K.FORECAST_DATES):
        month, dom = table[label]
        out = out.when(md < month * 100 + dom, F.lit(i))
    return out


def scene_phase(day) -> Column:
    """Satellite phase of a date; the days between windows have none."""
    md = month_day(day)
    out = None
    for name, (low, high) in K.SCENE_PHASES.items():
        hit = md.between(low, high)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


# --- scenes ------------------------------------------------------------------
def valid_scene_id(scene_id) -> Column:
    """The id itself where it has the fixed layout, else NULL."""
    return F.when(_col(scene_id).rlike(K.SCENE_ID_PATTERN), _col(scene_id))


def parse_scene_id(valid_id) -> dict[str, Column]:
    """Parts of a valid id. Its layout is fixed-width, so substrings do."""
    text = _col(valid_id)
    year, doy = F.substring(text, 16, 4).cast("int"), F.substring(text, 20, 3).cast("int")
    return {
        "sensor": F.substring(text, 5, 3),
        "tile": F.substring(text, 10, 5),
        "scene_date": F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy - 1),
        "scene_time": F.concat(F.substring(text, 24, 2), F.lit(":"), F.substring(text, 26, 2), F.lit(":"), F.substring(text, 28, 2)),
        "version": F.substring(text, 32, 20),
    }


def chip_path(entity, year, phase, scene_date, sensor, tile, root: str = "chips") -> Column:
    day = _col(scene_date)
    return F.concat(
        F.lit(root + "/"), zfill(entity, 5), F.lit("/"), _col(year).cast("string"), F.lit("/"),
        _col(phase), F.lit("_"), day.cast("string"), F.lit("_"), _col(sensor), F.lit("_T"), _col(tile),
        F.lit("_"), F.year(day).cast("string"), F.lpad(F.dayofyear(day).cast("string"), 3, "0"), F.lit(".tif"),
    )


def band_code(sensor, role: str) -> Column:
    return map_codes(sensor, {s: codes[role] for s, codes in K.BAND_CODES.items()})


# --- raster ------------------------------------------------------------------
def ndvi(nir, red) -> Column:
    n, r = _col(nir), _col(red)
    return clip((n - r) / (n + r + 1e-8), -1.0, 1.0)


def evi(nir, red, blue) -> Column:
    n, r, b = _col(nir), _col(red), _col(blue)
    raw = F.try_divide(2.5 * (n - r), n + 6.0 * r - 7.5 * b + 1.0 + 1e-8)
    finite = F.when(F.abs(raw) < float("inf"), raw)
    return clip(finite, -1.0, 1.0)


def qa_bad(qa, bits=K.QA_BAD_BITS) -> Column:
    mask = reduce(lambda acc, b: acc | (1 << b), bits, 0)
    return F.coalesce(_col(qa), F.lit(K.QA_MISSING)).cast("int").bitwiseAND(F.lit(mask)) > 0


def band_valid(*bands) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(_col(c) != K.BAND_NODATA, F.lit(False)) for c in bands])


def band_clean(band) -> Column:
    return F.when(_col(band) == K.BAND_NODATA, F.lit(0)).otherwise(_col(band))


def class_mask(code, wanted: int = 1) -> Column:
    return F.coalesce(_col(code) == wanted, F.lit(False)).cast("int")


# --- labels ------------------------------------------------------------------
def signed_label(c, band: float, below: str, above: str, between: str) -> Column:
    c = _col(c)
    return F.when(c < -band, below).when(c > band, above).when(c.isNotNull(), between)


def complete_for_date(label, columns_by_date: dict[str, list[str]]) -> Column:
    """Is a row complete for the column contract of its own date?"""
    lab = _col(label)
    out = None
    for date, cols in columns_by_date.items():
        whole = reduce(lambda a, b: a & b, [_col(c).isNotNull() for c in cols])
        out = F.when(lab == date, whole) if out is None else out.when(lab == date, whole)
    return F.coalesce(out, F.lit(False))


def any_present(columns) -> Column:
    return F.coalesce(*[_col(c).cast("string") for c in columns]).isNotNull()


def derived_flags(state, reported, states) -> dict[str, Column]:
    flags = {"is_irrigated_reported": _col(reported).isNotNull().cast("double")}
    for s in states:
        flags[f"state_is_{s}"] = F.coalesce(_col(state) == s, F.lit(False)).cast("double")
    return flags


# --- vectors -----------------------------------------------------------------
def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a, b) -> Column:
    sq = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a, b) -> Column:
    """1 - cosine; a zero vector has denominator one."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return 1.0 - dot(a, b) / F.when(norm == 0, F.lit(1.0)).otherwise(norm)
