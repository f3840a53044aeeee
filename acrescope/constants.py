"""Calendars, column contracts, code maps and emission factors.

Everything here is bounded by the domain (four forecast dates, eight land
classes, ...) and never grows with the data, so it may be inlined into
expressions or shipped as a local relation.
"""

from __future__ import annotations

# --- fixed values: forecast dates, in calendar order -------------------------
FORECAST_DATES = ("08-01", "09-01", "10-01", "EOS")

# fixed values: (month, day) a forecast is issued; data strictly before it counts
WEATHER_CUTOFF_MD = {"08-01": (8, 1), "09-01": (9, 1), "10-01": (10, 1), "EOS": (11, 30)}
# fixed values: the satellite path closes its season two weeks earlier
CHIP_CUTOFF_MD = {"08-01": (8, 1), "09-01": (9, 1), "10-01": (10, 1), "EOS": (11, 15)}
SEASON_START_MD = (5, 1)

# fixed values: crop phases by day of year, inclusive
PHASE_DOY = {"veg": (152, 195), "silk": (196, 227), "grain": (228, 273)}
SEASON_DOY = (121, 273)

# fixed values: degree-day base/cap and heat thresholds (Fahrenheit), dry day (mm)
GDD_BASE_F, GDD_CAP_F = 50.0, 86.0
HEAT_THRESHOLDS_F = (86.0, 90.0)
DRY_DAY_MM = 2.0

# fixed values: calendar windows of satellite phases, inclusive (month*100+day)
SCENE_PHASES = {
    "aug1": (717, 815),
    "sep1": (817, 915),
    "oct1": (917, 1015),
    "final": (1017, 1115),
}
# fixed values: which scene phases may fill which crop slot at which date
PHENO_SLOTS = ("vegetative", "silking", "grain_fill")
SLOT_PLAN = {
    "08-01": {"vegetative": ("aug1",)},
    "09-01": {"vegetative": ("aug1",), "silking": ("sep1",)},
    "10-01": {"vegetative": ("aug1",), "silking": ("sep1",), "grain_fill": ("oct1",)},
    "EOS": {"vegetative": ("aug1",), "silking": ("sep1",), "grain_fill": ("oct1", "final")},
}
MIN_VALID_FRAC = 0.5
MIN_CROP_FRAC = 0.05
SENTINEL_ENTITY = "00000"
# fixed values: the closed set of reasons a scene produced no chip
SKIP_REASONS = ("county_not_in_granule", "below_corn_threshold", "all_cloud", "no_cdl_overlap")

# fixed values: sensor -> role -> band code
BAND_CODES = {
    "L30": {"blue": "B02", "green": "B03", "red": "B04", "nir_narrow": "B05",
            "swir1": "B06", "swir2": "B07", "fmask": "Fmask"},
    "S30": {"blue": "B02", "green": "B03", "red": "B04", "nir_narrow": "B8A",
            "swir1": "B11", "swir2": "B12", "fmask": "Fmask"},
}
QA_BAD_BITS = (1, 2, 3, 4, 5)
QA_MISSING = 255
BAND_NODATA = -9999
REFLECTANCE_SCALE = 1e-4

# fixed values: scene id pattern (sensor, tile, year, day of year, time, version)
SCENE_ID_PATTERN = (
    r"^HLS\.(L30|S30)\.T([0-9]{2}[A-Z]{3})\.([0-9]{4})([0-9]{3})T([0-9]{6})\.v([0-9.]+)$"
)

# --- fixed values: feature contracts -----------------------------------------
RETRIEVAL_ALWAYS = (
    "gdd_cum_f50_c86", "edd_hours_gt86f", "vpd_kpa_veg", "vpd_kpa_silk",
    "prcp_cum_mm", "dry_spell_max_days", "srad_total_veg", "srad_total_silk",
)
GRAIN_FEATURES = ("vpd_kpa_grain", "srad_total_grain")
RETRIEVAL_STATIC = (
    "d0_pct", "d2plus", "ndvi_gs_mean", "ndvi_peak",
    "nccpi3corn", "aws0_100", "rootznaws", "irrigated_share",
)
MODEL_WEATHER = (
    "gdd_cum_f50_c86", "edd_hours_gt86f", "edd_hours_gt90f", "vpd_kpa_veg", "vpd_kpa_silk",
    "prcp_cum_mm", "dry_spell_max_days", "srad_total_veg", "srad_total_silk",
)
DROUGHT_LEVELS = ("d0_pct", "d1_pct", "d2_pct", "d3_pct", "d4_pct")
SOIL_FEATURES = (
    "nccpi3corn", "nccpi3all", "aws0_100", "aws0_150", "soc0_30", "soc0_100",
    "rootznemc", "rootznaws", "droughty", "pctearthmc", "pwsl1pomu",
)
MANAGEMENT = ("irrigated_share", "is_irrigated_reported", "harvest_ratio", "acres_planted_all")
# fixed values: the five modelled states
STATES = {"08": "CO", "19": "IA", "29": "MO", "31": "NE", "55": "WI"}
STATE_NAMES = {"CO": "Colorado", "IA": "Iowa", "MO": "Missouri", "NE": "Nebraska", "WI": "Wisconsin"}
# fixed values: climate-only retrieval columns at state grain
CLIMATE_FEATURES = (
    "gdd_cum_f50_c86", "edd_hours_gt86f", "edd_hours_gt90f", "vpd_kpa_veg", "vpd_kpa_silk",
    "vpd_kpa_grain", "prcp_cum_mm", "dry_spell_max_days", "srad_total_veg", "srad_total_silk",
    "srad_total_grain", "d0_pct", "d1_pct", "d2_pct", "d3_pct", "d4_pct", "d2plus",
    "ndvi_silking_mean", "ndvi_gs_integral",
)
STRUCTURAL_FEATURES = ("year", "acres_planted_all", "state")


def retrieval_columns(forecast_date: str) -> list[str]:
    """Ordered retrieval contract: 16 columns at 08-01, 18 afterwards."""
    grain = () if forecast_date == FORECAST_DATES[0] else GRAIN_FEATURES
    return [*RETRIEVAL_ALWAYS, *grain, *RETRIEVAL_STATIC]


def model_columns(forecast_date: str, states=tuple(STATE_NAMES)) -> list[str]:
    """Ordered regressor contract: 35 columns at 08-01, 37 afterwards."""
    grain = () if forecast_date == FORECAST_DATES[0] else GRAIN_FEATURES
    onehot = [f"state_is_{s}" for s in states]
    return [*MODEL_WEATHER, *grain, *DROUGHT_LEVELS, *SOIL_FEATURES, *MANAGEMENT, "year", *onehot]


# --- fixed values: survey report periods -> (stage, priority) ----------------
REPORT_STAGES = {
    "year - aug forecast": ("Aug 1", 0),
    "year - sep forecast": ("Sep 1", 0),
    "year - oct forecast": ("Oct 1", 0),
    "year": ("Final", 0),
    "year - jan estimate": ("Final", 1),
    "marketing year": ("Final", 2),
    "year - nov forecast": ("Final", 3),
}
MONTH_STAGE = {"aug": "Aug 1", "sep": "Sep 1", "oct": "Oct 1", "nov": "Final", "jan": "Final"}
STAGE_ORDER = ("Aug 1", "Sep 1", "Oct 1", "Final")
SUPPRESSED = ("(D)", "(NA)", "(Z)", "(X)")

# --- fixed values: land classes and emission factors -------------------------
LAND_CLASSES = {0: "no_data", 1: "background", 2: "building", 3: "road",
                4: "water", 5: "barren", 6: "forest", 7: "agriculture"}
COSTED_CLASSES = (2, 3, 4, 5, 6, 7)
M2_PER_HA = 10_000.0
PIXEL_AREA_M2 = 0.09
# class -> (annual tCO2e/ha/yr, source, embodied tCO2e/ha, source, uncertainty, note on the annual rate, note on the embodied one)
EMISSION_FACTORS = {
    "building": (65.0, "SRC-3", 600.0, "SRC-5", "high", "operational energy, single storey", "materials of the whole structure"),
    "road": (4.0, "SRC-1", 220.0, "SRC-5", "medium", "maintenance and repaving", "pavement and base course"),
    "water": (0.0, "SRC-1", 0.0, "SRC-1", "medium", "open fresh water", "nothing is built"),
    "barren": (0.0, "SRC-4", 50.0, "SRC-4", "high", "steady state bare ground", "soil carbon that is left"),
    "forest": (-8.0, "SRC-1", 800.0, "SRC-4", "medium", "mature growth uptake", "standing stock, lost when cleared"),
    "agriculture": (2.5, "SRC-6", 150.0, "SRC-4", "medium", "global mean of crop types", "soil carbon under crops"),
}
CITATIONS = {
    "SRC-1": "IPCC (2022). AR6 WGIII, Chapter 7: Agriculture, Forestry and Other Land Uses.",
    "SRC-2": "EPA (2024). Inventory of U.S. Greenhouse Gas Emissions and Sinks: 1990-2022.",
    "SRC-3": "U.S. EIA (2022). 2018 Commercial Buildings Energy Consumption Survey.",
    "SRC-4": "IPCC (2019). 2019 Refinement to the 2006 Guidelines, Volume 4.",
    "SRC-5": "JRC EFIResources (2018). Environmental benchmarks for buildings.",
    "SRC-6": "Crippa, M. et al. (2023). EDGAR v7.0 Global Greenhouse Gas Emissions Database.",
}
# class -> percent threshold above which a caveat is raised, and the caveat
MIX_CAVEATS = {
    "forest": (20.0, "forest share is approximate: often confused with background"),
    "background": (40.0, "background is not costed and may hide sources or sinks"),
    "barren": (10.0, "barren is the weakest class: may be sparse forest or fallow land"),
    "water": (5.0, "water is taken as neutral open fresh water, wetlands would be a sink"),
}
CLASS_ASSUMPTIONS = {
    "building": "building rate is operational energy of a single storey",
    "water": "water rate assumes open fresh water",
    "forest": "forest rate is that of mature growth",
    "agriculture": "agriculture rate is a global mean of crop types",
}
PERCENT_STEPS = 100_000_000  # percentages are quantised to this many parts
RANK_HORIZON_YEARS = 20.0
