"""Scene metadata, capped scene lists and three-step chip sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S

META_SCHEMA = """umm struct<GranuleUR: string, AdditionalAttributes: array<struct<Name: string, Values: array<string>>>>,
  id string, name string, properties struct<`eo:cloud_cover`: string>, urls array<string>"""


def scene_meta(raw: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """(id, cloud %) of nested scene JSON: attribute, then property, then file name."""
    m = raw.withColumn("_m", F.from_json(json, META_SCHEMA))
    named = F.get(F.filter("_m.umm.AdditionalAttributes", lambda a: a["Name"] == "CLOUD_COVERAGE"), F.lit(0))["Values"]
    cloud = F.coalesce(F.get(named, F.lit(0)).try_cast("double"), F.col("_m.properties.`eo:cloud_cover`").try_cast("double"))
    from_url = F.regexp_extract(F.get("_m.urls", F.lit(0)), r"([^/]+\.v2\.0[^./]*)\.[^/]*$", 1)
    gid = F.coalesce("_m.umm.GranuleUR", "_m.id", "_m.name", F.when(from_url != "", from_url))
    return m.select(*keep, gid.alias("granule_id"), S.null_if_nan(cloud).alias("cloud_pct"))


def parsed_scenes(scenes: DataFrame, scene_id: str = "granule_id") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined) rows; good ones carry sensor, tile, date and phase.

    Validity and parts go through one-element explodes: a generator keeps the
    optimizer from copying their expressions into every later use.
    """
    rest = [c for c in scenes.columns if c not in S.parse_scene_id("_ok")]
    checked = scenes.select(*rest, F.explode(F.array(S.valid_scene_id(scene_id))).alias("_ok"))
    packed = F.explode(F.array(F.struct(*[c.alias(n) for n, c in S.parse_scene_id("_ok").items()])))
    rows = checked.select(*rest, packed.alias("_s")).select(*rest, "_s.*")
    rows = rows.withColumn("phase", F.explode(F.array(S.scene_phase("scene_date"))))
    return rows.where(F.col("sensor").isNotNull()), rows.where(F.col("sensor").isNull())


def topk_per_group(scenes: DataFrame, group: list[str], limit: int, scene_id: str = "granule_id", cloud: str = "cloud_pct") -> DataFrame:
    """Per group the clearest scenes (unknown cloud last), then each id once.

    The rank filter is pushed below the shuffle, so a hot group sends at most
    ``limit`` rows per task.
    """
    w = Window.partitionBy(*group).orderBy(F.col(cloud).asc_nulls_last(), scene_id)
    kept = scenes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    return kept.groupBy(*group, scene_id).agg(F.min(cloud).alias(cloud))


def _preference(columns: list[str]) -> list[Column]:
    """Ascending order of preference: passes the quality gate, newest, clearest, most crop, path."""
    passed = (F.col("valid_pixel_frac") >= K.MIN_VALID_FRAC) & (F.col("corn_pixel_frac") >= K.MIN_CROP_FRAC)
    lead = [
        F.when(passed, 0).otherwise(1).alias("_fail"), (-F.unix_date("scene_date")).alias("_age"),
        (-F.col("valid_pixel_frac")).alias("_v"), (-F.col("corn_pixel_frac")).alias("_c"), F.col("chip_path").alias("chip_path")]
    return lead + [F.col(c).alias(c) for c in columns if c != "chip_path"]


def best_chip(index: DataFrame, group: list[str], payload: list[str], lead: list[str] = ()) -> DataFrame:
    """Best chip per group as a combined aggregate (no sort of a hot group)."""
    first = [F.col(c).alias(c) for c in lead]
    best = index.groupBy(*group).agg(F.min(F.struct(*first, *_preference(payload))).alias("_b"))
    return best.select(*group, *[F.col(f"_b.{c}").alias(c) for c in [*payload, *(["chip_path"] if "chip_path" not in payload else [])]])


def slot_candidates(index: DataFrame, cutoffs: dict = K.CHIP_CUTOFF_MD) -> DataFrame:
    """Each scene copied to the (date, slot) places its phase may fill as of the cutoff."""
    plan = [(d, slot, i, phase) for d in K.FORECAST_DATES for slot, phases in K.SLOT_PLAN[d].items() for i, phase in enumerate(phases)]
    places = F.array(*[F.struct(
        F.lit(d).alias("forecast_date"), F.lit(slot).alias("slot"), F.lit(i).alias("priority"), F.lit(phase).alias("_phase"),
        F.make_date(F.col("year"), F.lit(cutoffs[d][0]), F.lit(cutoffs[d][1])).alias("cutoff")) for d, slot, i, phase in plan])
    open_places = F.filter(places, lambda p: (p["_phase"] == F.col("phase")) & (F.col("scene_date") < p["cutoff"]))
    rows = index.where(F.col("chip_path").isNotNull() & F.col("phase").isNotNull())
    return rows.withColumn("_p", F.explode(open_places)).select(*index.columns, "_p.forecast_date", "_p.slot", "_p.priority", "_p.cutoff")


_PICK = ["granule_id", "scene_date", "phase", "valid_pixel_frac", "corn_pixel_frac"]


def chip_sequence(index: DataFrame, entity: str) -> DataFrame:
    """Three slots per (entity, year, date): best chip of the first phase that has one.

    Empty slots repeat the newest real pick; a query without any pick has no row.
    """
    key = [entity, "year", "forecast_date"]
    picks = best_chip(slot_candidates(index), [*key, "slot", "cutoff"], _PICK, lead=["priority"])
    pick = F.struct("scene_date", *[c for c in _PICK if c != "scene_date"], "chip_path")
    per = picks.groupBy(*key, "cutoff").agg(*[F.max(F.when(F.col("slot") == s, pick)).alias(s) for s in K.PHENO_SLOTS])
    newest = F.array_max(F.array(*[F.col(s) for s in K.PHENO_SLOTS]))
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).isNull().alias("is_padded"), F.coalesce(F.col(s), newest).alias("pick")) for s in K.PHENO_SLOTS])
    return per.select(*key, "cutoff", F.posexplode(slots).alias("step", "_s")).select(
        *key, "cutoff", "step", "_s.slot", "_s.is_padded", *[f"_s.pick.{c}" for c in [*_PICK, "chip_path"]])


def chip_qc(sequence: DataFrame, entity: str) -> DataFrame:
    """Real picks, oldest age, worst cloud and least crop share per query."""
    real = ~F.col("is_padded")
    return sequence.groupBy(entity, "year", "forecast_date").agg(
        F.count_if(real).alias("chip_count"), F.max(F.when(real, F.date_diff("cutoff", "scene_date"))).alias("chip_age_days_max"),
        (100.0 * (1.0 - F.min(F.when(real, F.col("valid_pixel_frac"))))).alias("cloud_pct_max"),
        F.min(F.when(real, F.col("corn_pixel_frac"))).alias("corn_pixel_frac_min"))


def chip_coverage(queries: DataFrame, sequence: DataFrame, entity: str) -> DataFrame:
    """Every query with its chip summary; none at all is fully padded."""
    qc = chip_qc(sequence, entity)
    out = queries.join(qc, [entity, "year", "forecast_date"], "left")
    return out.withColumn("chip_count", F.coalesce("chip_count", F.lit(0))).withColumn("fully_padded", F.col("chip_count") == 0)


def sequence_inputs(sequence: DataFrame, entity: str, lat: Column, lon: Column) -> DataFrame:
    """Model input per query: ordered paths, (year, day of year) pairs and a location."""
    step = F.struct("step", "chip_path", F.year("scene_date").cast("double").alias("y"), F.dayofyear("scene_date").cast("double").alias("doy"))
    per = sequence.groupBy(entity, "year", "forecast_date").agg(F.array_sort(F.collect_list(step)).alias("_s"))  # three rows per query
    return per.select(entity, "year", "forecast_date", F.col("_s.chip_path").alias("chip_paths"),
                      F.transform("_s", lambda s: F.array(s["y"], s["doy"])).alias("time_coords"), F.array(lat, lon).alias("location"))


def dedupe_sentinels(index: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """One row per sentinel key; real rows are not touched."""
    sentinel = F.col(entity) == K.SENTINEL_ENTITY
    return index.where(~sentinel).unionByName(index.where(sentinel).dropDuplicates(keys))


def band_table(spark) -> DataFrame:
    rows = [(s, role, code) for s, roles in K.BAND_CODES.items() for role, code in roles.items()]
    return spark.createDataFrame(rows, "sensor string, role string, band string")


