"""Bindings of the engine's input shapes to the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.functions import scalars as S
from acrescope.operators import joins, panel, weather
from acrescope.session import cut_lineage

TRAIN_YEARS, VAL_YEAR, HOLDOUT_YEAR = (1995, 1999), 2000, 2001
MIN_YEARS = 3
# the retrieval contract without the vegetation and soil columns the given tables lack,
# and without d0_pct, which is constant here and cannot be standardised
ALWAYS = ["gdd_cum_f50_c86", "edd_hours_gt86f", "vpd_kpa_veg", "vpd_kpa_silk", "prcp_cum_mm",
          "dry_spell_max_days", "srad_total_veg", "srad_total_silk", "d2plus", "irrigated_share"]
GRAIN = ["vpd_kpa_grain", "srad_total_grain"]
# climate columns of the state panel; the given tables lack the vegetation ones
CLIMATE = [c for c in K.CLIMATE_FEATURES if not c.startswith("ndvi_")]
CONTRACT = {"08-01": ALWAYS, "09-01": ALWAYS + GRAIN, "10-01": ALWAYS + GRAIN, "EOS": ALWAYS + GRAIN}


# explicit schemas: no footer is read to plan a query
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


class Fixtures:
    """Lazily built inputs for one folder of parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.dir}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(self.path(name))

    @cached_property
    def entity(self) -> DataFrame:
        segment = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "001").when(F.col("c_mktsegment") == "BUILDING", "003") \
            .when(F.col("c_mktsegment") == "FURNITURE", "005").when(F.col("c_mktsegment") == "HOUSEHOLD", "007").otherwise("009")
        return (
            self.table("customer")
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", F.concat(F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), segment).alias("geoid"),
                    F.col("r_name").alias("state"))
        )

    @cached_property
    def line(self) -> DataFrame:
        owner = self.table("orders").join(self.entity, F.col("o_custkey") == F.col("c_custkey")) \
            .select("o_orderkey", "geoid", "state")
        day = F.col("l_shipdate").cast("date")
        return self.table("lineitem").join(owner, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey") \
            .withColumn("d", day).withColumn("y", F.year(day))

    @cached_property
    def daily(self) -> DataFrame:
        return self.line.groupBy("geoid", "state", F.col("d").alias("date"), F.col("y").alias("year")).agg(
            (F.min("l_quantity") - 10).alias("tmin_c"), (F.max("l_quantity") - 5).alias("tmax_c"),
            (F.sum("l_discount") * 50).alias("prcp_mm"), (F.avg("l_extendedprice") / 4000).alias("srad_mjm2"),
            (F.avg("l_tax") * 40).alias("vpd_kpa"))

    @cached_property
    def weekly(self) -> DataFrame:
        p = F.col("o_orderpriority")
        share = lambda cond: 100.0 * F.avg(F.when(cond, 1.0).otherwise(0.0))
        week_end = F.date_add(F.date_trunc("week", F.col("o_orderdate")).cast("date"), 6)
        return self.table("orders").join(self.entity, F.col("o_custkey") == F.col("c_custkey")) \
            .groupBy("state", week_end.alias("valid_end")).agg(
                share(p <= "5-LOW").alias("d0"), share(p < "5").alias("d1"), share(p < "4").alias("d2"),
                share(p < "3").alias("d3"), share(p < "2").alias("d4"))

    @cached_property
    def panel(self) -> DataFrame:
        q = F.col("l_quantity")
        return self.line.groupBy("geoid", "state", F.col("y").alias("year")).agg(
            (F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / F.sum(q) / 10).alias("yield_target"),
            F.sum(q).alias("acres_planted_all"), F.sum(q * (1 - F.col("l_tax"))).alias("acres_harvested_all"),
            F.sum(F.when(F.col("l_returnflag") == "R", q)).alias("acres_harvested_irr"))

    @cached_property
    def scene(self) -> DataFrame:
        txt = lambda c: c.cast("string")
        gid = F.concat(
            F.lit("HLS."), F.when(F.col("l_linenumber") % 2 == 0, "L30").otherwise("S30"), F.lit(".T"),
            F.lpad(txt(F.col("l_suppkey") % 60), 2, "0"), F.lit("TVH."), txt(F.col("y")),
            F.lpad(txt(F.dayofyear("d")), 3, "0"), F.lit("T"), F.lpad(txt(F.col("l_orderkey") % 240000), 6, "0"), F.lit(".v2.0"))
        # a season's scenes end on 15 November
        rows = self.line.where(F.date_format("d", "MMdd").between("0501", "1115"))
        return rows.select(
            "geoid", "state", F.col("y").alias("year"), F.col("d").alias("scene_date"), gid.alias("granule_id"),
            (F.col("l_extendedprice") / 1000).alias("cloud_pct"), (1 - F.col("l_quantity") / 50.0).alias("valid_pixel_frac"),
            (F.col("l_tax") * 10).alias("corn_pixel_frac"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")

    @cached_property
    def pixel(self) -> DataFrame:
        return self.table("lineitem").groupBy(
            F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") % 16).alias("r"), (F.col("l_partkey") % 16).alias("c")
        ).agg(F.min("l_linenumber").alias("class_code"), F.min("l_partkey").alias("code"),
              (F.sum("l_quantity").cast("int") % 256).alias("qa"), (F.avg("l_discount") + 0.2).alias("nir"),
              (F.avg("l_tax") + 0.05).alias("red"), F.avg("l_tax").alias("blue"))

    @cached_property
    def classcount(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_linenumber").alias("class_id")) \
            .agg(F.sum("l_quantity").cast("long").alias("pixel_count"))

    @cached_property
    def reported(self) -> DataFrame:
        k = F.col("c_custkey")
        txt = lambda c: c.cast("string")
        period = F.element_at(F.array(*[F.lit(x) for x in (
            "YEAR", "YEAR - AUG FORECAST", "YEAR - SEP FORECAST", "YEAR - NOV FORECAST", "MARKETING YEAR", "mid oct report")]),
            (k % 6 + 1).cast("int"))
        return self.table("customer").select(
            "c_custkey", txt(F.col("c_nationkey")).alias("state_ansi"),
            F.when(k % 17 == 0, "").otherwise(txt(k % 200)).alias("county_ansi"),
            F.when(k % 13 == 0, "Other (Combined) Counties").otherwise(F.col("c_name")).alias("county_name"),
            F.when(k % 11 == 0, " (D)").when(k % 7 == 0, F.concat(F.lit("1,"), F.lpad(txt(k % 1000), 3, "0")))
            .otherwise(txt(F.col("c_acctbal"))).alias("value"), period.alias("reference_period_desc"))

    @cached_property
    def log(self) -> DataFrame:
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        txt = lambda x: x.cast("string")
        line = F.when(k % 3 == 0, F.concat(F.lit("after resume-skip: "), txt(c), F.lit(" granules to download ("), txt(k % 50), F.lit(" already done)"))) \
            .when(k % 3 == 1, F.concat(F.lit("["), txt(k % 90), F.lit("/90] g"), txt(k), F.lit(" -> "), txt(c % 9), F.lit(" rows ("), txt(c % 5), F.lit(" chips written)"))) \
            .otherwise(F.concat(F.lit("CELL IA-2018 done in "), txt(k % 700), F.lit(".5s ("), txt(c % 60), F.lit(" granules processed)")))
        return self.table("orders").select((c % 4).alias("shard"), k.alias("seq"), line.alias("line"))

    @cached_property
    def full_log(self) -> DataFrame:
        """Log lines of every kind, cells that open, sizes and end marks among them; ``seq`` is the line's number."""
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        txt = lambda x: x.cast("string")
        said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else txt(p) for p in parts])
        state = F.element_at(F.array(*[F.lit(s) for s in ("IA", "CO", "MO", "NE", "WI")]), (c % 5 + 1).cast("int"))
        kind = k % 16
        line = F.when(kind == 0, said("=== CELL ", state, "-", 2013 + k % 12)) \
            .when(kind < 3, said("after resume-skip: ", c, " granules to download (", k % 50, " already done)")) \
            .when(kind < 5, said("approx download size: ", k % 90, ".5 GB")) \
            .when(kind < 9, said("[", k % 90, "/90] downloaded g", k, " (", c % 20, " files, ", k % 60, ".5s)")) \
            .when(kind < 13, said("[", k % 90, "/90] g", k, " -> ", c % 9, " rows (", c % 5, " chips written)")) \
            .when(kind < 15, said("CELL IA-2018 done in ", k % 700, ".5s (", c % 60, " granules processed)")) \
            .otherwise(F.when(c % 8 == 3, "ALL CELLS DONE in 12.5 minutes").otherwise("==="))
        return self.table("orders").select((c % 4).alias("shard"), k.alias("seq"), line.alias("line"))

    # --- derived by the engine ------------------------------------------------
    @cached_property
    def entity_day(self) -> DataFrame:
        """Weather and survey sums per entity and day, written once.

        The join of lines, orders and customers is the only step that touches
        every line; the panel's weather and survey halves both start from here.
        """
        q = F.col("l_quantity")
        rows = self.line.groupBy("geoid", "state", F.col("d").alias("date"), F.col("y").alias("year")).agg(
            (F.min("l_quantity") - 10).alias("tmin_c"), (F.max("l_quantity") - 5).alias("tmax_c"),
            (F.sum("l_discount") * 50).alias("prcp_mm"), (F.avg("l_extendedprice") / 4000).alias("srad_mjm2"),
            (F.avg("l_tax") * 40).alias("vpd_kpa"),
            F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.sum(q).alias("quantity"),
            F.sum(q * (1 - F.col("l_tax"))).alias("harvested"), F.sum(F.when(F.col("l_returnflag") == "R", q)).alias("irrigated"))
        return cut_lineage(rows, "entity-day")

    @cached_property
    def survey_saved(self) -> DataFrame:
        rows = self.entity_day.groupBy("geoid", "state", "year").agg(
            (F.sum("revenue") / F.sum("quantity") / 10).alias("yield_target"), F.sum("quantity").alias("acres_planted_all"),
            F.sum("harvested").alias("acres_harvested_all"), F.sum("irrigated").alias("acres_harvested_irr"))
        return panel.ratio_clip(rows)

    @cached_property
    def survey(self) -> DataFrame:
        return panel.ratio_clip(self.panel)

    @cached_property
    def weather(self) -> DataFrame:
        return weather.season_features(self.daily, ["geoid", "state", "year"])

    @cached_property
    def drought(self) -> DataFrame:
        return self.drought_for(self.years)

    def drought_for(self, years: DataFrame) -> DataFrame:
        out = joins.asof_strict(self.weekly, "state", "valid_end", ["d0", "d1", "d2", "d3", "d4"], years)
        return out.select("state", "year", "forecast_date", *[F.col(f"d{i}").alias(f"d{i}_pct") for i in range(5)],
                          F.col("d2").alias("d2plus"), "valid_end")

    @cached_property
    def years(self) -> DataFrame:
        """(state, year) pairs with weather."""
        return self.line.select("state", F.col("y").alias("year")).distinct()

    @cached_property
    def master(self) -> DataFrame:
        features = weather.season_features(self.entity_day, ["geoid", "state", "year"])
        years = self.entity_day.select("state", "year").distinct()
        return panel.assemble_panel(self.survey_saved, features, self.drought_for(years).drop("valid_end"), ["geoid", "state"], "state")

    @cached_property
    def ready(self) -> DataFrame:
        return self.master.withColumn("complete", S.complete_for_date("forecast_date", CONTRACT))
