"""Queries: sources, sinks, incremental work and progress, through real files."""

from __future__ import annotations

from pyspark.sql import functions as F

from acrescope import constants as K
from acrescope.operators import joins, quality
from acrescope.plans.catalog import query
from acrescope.plans.forecasting import Forecasting
from acrescope.plans.rounding import fix, fix_sql, rounded, rsql
from acrescope.session import fresh_path
from acrescope.sources import bucketed, readers, writers
from acrescope.streaming import ingest, progress


def fresh(fx, name: str) -> str:
    return fresh_path(fx.spark, name)


_STATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("src_panel", f"SELECT geoid, state, year, forecast_date, {fix_sql('yield_target')} AS yield_target FROM fx_panel CROSS JOIN fx_dates")
def _(fx):
    path = fresh(fx, "panel")
    rows = joins.skeleton_cross(fx.panel.select("geoid", "state", "year", "yield_target"))
    writers.write_parquet(rows.withColumn("geoid", F.regexp_replace("geoid", "^0+", "")), path, ["year"], ["geoid"])
    df = readers.read_panel(fx.spark, path, ["geoid", "year", "forecast_date", "state", "yield_target"], _STATES)
    return rounded(df.select("geoid", "state", "year", "forecast_date", "yield_target"), ["yield_target"])


@query("src_min_year", f"SELECT geoid, year, {fix_sql('yield_target')} AS yield_target FROM fx_panel WHERE year >= 1998")
def _(fx):
    path = fresh(fx, "survey")
    writers.write_csv(fx.panel.select("geoid", "year", "yield_target"), path)
    return rounded(readers.read_min_year(fx.spark, path, "geoid string, year int, yield_target double", 1998), ["yield_target"])


@query("src_drop_authority", "SELECT geoid, count(*) AS n_customers FROM fx_entity GROUP BY geoid")
def _(fx):
    path = fresh(fx, "static")
    writers.write_csv(fx.entity.groupBy("geoid", "state").agg(F.count(F.lit(1)).alias("n_customers")), path)
    return readers.read_static(fx.spark, path, "geoid string, state string, n_customers long", ["state"])


@query("src_dated_features", f"SELECT state, year, forecast_date, {rsql(['d1_pct', 'd2_pct'])} FROM fx_drought")
def _(fx):
    path = fresh(fx, "dated")
    writers.write_csv(fx.drought.select("state", "year", "forecast_date", "d1_pct", "d2_pct"), path)
    return rounded(readers.read_dated(fx.spark, path, "state string, year int, forecast_date string, d1_pct double, d2_pct double"), ["d1_pct", "d2_pct"])


@query("src_glob_union", f"""SELECT geoid, CAST(year AS INTEGER) AS year, {fix_sql('yield_target')} AS yield_target, CASE WHEN year >= 1998 THEN {fix_sql('acres_planted_all')} END AS acres_planted_all FROM fx_panel""")
def _(fx):
    path = fresh(fx, "years")
    old, new = fx.panel.where("year < 1998"), fx.panel.where("year >= 1998")
    writers.write_csv(old.select("geoid", "year", "yield_target", F.lit("x").alias("name")), f"{path}/old")
    writers.write_csv(new.select("year", "geoid", "acres_planted_all", "yield_target"), f"{path}/new")
    df = readers.glob_union(fx.spark, f"{path}/*", "geoid", "geoid string, year int, yield_target double, acres_planted_all double")
    return rounded(df, ["yield_target", "acres_planted_all"])


@query("src_slices_reconciled", f"SELECT state, year, forecast_date, {rsql(['d1_pct', 'd2_pct'])} FROM fx_drought")
def _(fx):
    short = {"08-01": "aug1", "09-01": "sep1", "10-01": "oct1", "EOS": "final"}
    back = {v: k for k, v in short.items()}
    from acrescope.functions.scalars import map_codes
    rows = fx.drought.select("state", "year", map_codes("forecast_date", short).alias("forecast_date"), fix("d1_pct").alias("d1_pct"), fix("d2_pct").alias("d2_pct"))
    slices = [rows.where("year <= 1998"), rows.where("year >= 1997")]
    return readers.reconcile_slices(slices, ["state", "year", "forecast_date"], ["d1_pct", "d2_pct"], "forecast_date", back)


@query("src_shards", "SELECT state, count(*) AS n_rows FROM fx_scene GROUP BY state")
def _(fx):
    path = fresh(fx, "shards")
    fx.scene.write.partitionBy("state").parquet(path)
    df = readers.read_shards(fx.spark, path)
    return df.where(F.col("shard_source").endswith(".parquet")).groupBy("state").agg(F.count(F.lit(1)).alias("n_rows"))


@query("src_combine_years", f"SELECT geoid, date, {rsql(['tmin_c', 'tmax_c', 'prcp_mm'])} FROM fx_daily")
def _(fx):
    path = fresh(fx, "daily")
    writers.write_parquet(fx.daily, path, ["year"], ["geoid", "date"])
    df = readers.combine_years(fx.spark, path, ["geoid", "date"])
    return rounded(df.select("geoid", "date", "tmin_c", "tmax_c", "prcp_mm"), ["tmin_c", "tmax_c", "prcp_mm"])


@query("src_json_records", "SELECT c_custkey, state_ansi, county_ansi, value FROM fx_reported WHERE c_custkey % 50 <> 7")
def _(fx):
    body = F.to_json(F.struct("state_ansi", "county_ansi", F.col("value").alias("Value")))
    text = F.when(F.col("c_custkey") % 50 == 7, F.lit('{"error":["bad request"]}')).otherwise(F.concat(F.lit('{"data":['), body, F.lit("]}")))
    payloads = fx.reported.select("c_custkey", text.alias("payload"))
    out = readers.json_records(payloads, "payload", "state_ansi: string, county_ansi: string, Value: string", ["c_custkey"])
    return out.withColumnRenamed("Value", "value")


@query("sink_parquet", f"SELECT geoid, state, year, {rsql(['yield_target'])} FROM fx_panel")
def _(fx):
    path = fresh(fx, "sink")
    writers.write_parquet(fx.panel, path, ["year"], ["geoid"])
    return rounded(fx.spark.read.parquet(path).select("geoid", "state", "year", "yield_target"), ["yield_target"])


@query("sink_csv", f"SELECT geoid, state, year, {rsql(['yield_target'])} FROM fx_panel")
def _(fx):
    path = fresh(fx, "sink")
    rows = fx.panel.select("geoid", "state", "year", "yield_target")
    writers.write_csv(rows, path)
    return rounded(fx.spark.read.schema(rows.schema).csv(path, header=True), ["yield_target"])


@query("sink_atomic_upsert", f"""SELECT geoid, year, 'v1' AS model_version, {fix_sql('yield_target + CASE WHEN year >= 1998 THEN 1 ELSE 0 END')} AS value FROM fx_panel""")
def _(fx):
    path = fresh(fx, "upsert")
    row = lambda df, shift: df.select("geoid", "year", F.lit("v1").alias("model_version"), (F.col("yield_target") + shift).alias("value"))
    bucketed.upsert(row(fx.panel, 0.0), path, ["geoid", "year", "model_version"], ["value"], buckets=16)
    bucketed.upsert(row(fx.panel.where("year >= 1998"), 1.0), path, ["geoid", "year", "model_version"], ["value"])
    return rounded(bucketed.read(fx.spark, path), ["value"])


@query("params_save_load", f"SELECT forecast_date, feature, {rsql(['mean', 'std'])} FROM fx_std")
def _(fx):
    """The standardizer, saved in one bundle with the models and trends (bundle_models, bundle_trends) and read back."""
    return rounded(Forecasting.of(fx).bundle.tables["standardizer"], ["mean", "std"])


@query("latest_run", "SELECT state, 'run-' || max(CAST(year AS VARCHAR)) AS latest FROM fx_panel GROUP BY state")
def _(fx):
    """Newest run folder per state, by name."""
    path = fresh(fx, "runs")
    fx.panel.withColumn("run", F.concat(F.lit("run-"), F.col("year").cast("string"))).write.partitionBy("state", "run").parquet(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"run=([^/]+)/[^/]*$", 1)
    return readers.latest_file(fx.spark.read.parquet(path), ["state"], folder)


@query("shard_summary", """SELECT year, count(*) AS n_rows, count(*) FILTER (cloud_pct < 30) AS n_positive FROM fx_scene GROUP BY year""")
def _(fx):
    path = fresh(fx, "shards")
    fx.scene.select("year", F.when(F.col("cloud_pct") < 30, F.col("granule_id")).alias("chip_path")).write.partitionBy("year").parquet(path)
    df = fx.spark.read.parquet(path)
    per_file = df.groupBy(F.col("_metadata.file_path").alias("file"), "year").agg(F.count(F.lit(1)).alias("rows"), F.count("chip_path").alias("positive"))
    return per_file.groupBy("year").agg(F.sum("rows").alias("n_rows"), F.sum("positive").alias("n_positive"))


@query("incremental_ingest", "SELECT o_orderkey, o_custkey FROM orders")
def _(fx):
    sink, landing = fresh(fx, "ingested"), fresh(fx, "landing")
    rows = fx.table("orders").select("o_orderkey", "o_custkey")
    ingest.ingest_batch(rows.where("o_orderkey % 3 = 0"), sink, ["o_orderkey"], "first load", 0)
    rows.write.parquet(landing)
    ingest.ingest_available(fx.spark, landing, rows.schema, sink, fresh(fx, "ckpt"), ["o_orderkey"])
    return bucketed.read(fx.spark, sink)


_PROG = """SELECT *, greatest(planned - granules, 0) AS remaining FROM (SELECT shard, count(*) AS n_lines, count(*) FILTER (seq % 3 = 0) AS cells_seen, CAST(coalesce(sum(c) FILTER (seq % 3 = 0), 0) AS BIGINT) AS planned,
  CAST(coalesce(sum(seq % 50) FILTER (seq % 3 = 0), 0) AS BIGINT) AS skipped, CAST(coalesce(sum(c % 5) FILTER (seq % 3 = 1), 0) AS BIGINT) AS chips, count(*) FILTER (seq % 3 = 2) AS cells_done,
  CAST(coalesce(sum(c % 60) FILTER (seq % 3 = 2), 0) AS BIGINT) AS granules, CAST(coalesce(sum(seq % 700 + 0.5) FILTER (seq % 3 = 2), 0) AS DOUBLE) AS seconds, 0.0::DOUBLE AS gb, 0::BIGINT AS n_sizes, FALSE AS all_done
  FROM (SELECT o_custkey % 4 AS shard, o_orderkey AS seq, o_custkey AS c FROM orders) GROUP BY shard)"""


@query("progress_metrics", _PROG)
def _(fx):
    return progress.progress_metrics(fx.log, ["shard"])


@query("progress_stream", _PROG)
def _(fx):
    path = fresh(fx, "logs")
    name = f"progress_{path[-8:]}"
    fx.log.select(F.col("shard").alias("s"), "line").write.partitionBy("s").text(path)
    lines = fx.spark.readStream.schema("value string, s long").text(path).select(F.col("value").alias("line"), F.col("s").alias("shard"))
    run = progress.progress_metrics(lines, ["shard"]).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True) \
        .option("checkpointLocation", fresh(fx, "ckpt")).start()
    run.awaitTermination()
    return fx.spark.table(name)


@query("progress_totals", f"""SELECT CAST(sum(cells_seen) AS BIGINT) AS cells_seen, CAST(sum(planned) AS BIGINT) AS planned, CAST(sum(granules) AS BIGINT) AS granules, CAST(sum(chips) AS BIGINT) AS chips,
  {fix_sql('sum(planned) / sum(cells_seen)')} AS avg_per_cell, {fix_sql('sum(planned) + greatest(0, 60 - sum(cells_seen)) * sum(planned) / sum(cells_seen)')} AS estimated_granules FROM ({_PROG})""")
def _(fx):
    out = progress.extrapolate(progress.progress_metrics(fx.log, ["shard"]))
    return rounded(out.drop("gb", "n_sizes", "estimated_gb"), ["avg_per_cell", "estimated_granules"])


_SUMS = """SELECT *, greatest(planned - granules, 0) AS remaining FROM (SELECT shard, count(*) AS n_lines, count(*) FILTER (kind IN (1, 2)) AS cells_seen, CAST(coalesce(sum(c) FILTER (kind IN (1, 2)), 0) AS BIGINT) AS planned,
  CAST(coalesce(sum(k % 50) FILTER (kind IN (1, 2)), 0) AS BIGINT) AS skipped, CAST(coalesce(sum(c % 5) FILTER (kind BETWEEN 9 AND 12), 0) AS BIGINT) AS chips, count(*) FILTER (kind IN (13, 14)) AS cells_done,
  CAST(coalesce(sum(c % 60) FILTER (kind IN (13, 14)), 0) AS BIGINT) AS granules, CAST(coalesce(sum(k % 700 + 0.5) FILTER (kind IN (13, 14)), 0) AS DOUBLE) AS seconds,
  CAST(coalesce(sum(k % 90 + 0.5) FILTER (kind IN (3, 4)), 0) AS DOUBLE) AS gb, count(*) FILTER (kind IN (3, 4)) AS n_sizes, bool_or(kind = 15 AND c % 8 = 3) AS all_done FROM fx_full_log GROUP BY shard)"""


@query("progress_sizes", _SUMS)
def _(fx):
    """Sums over a log with lines of every kind: sizes and end marks count."""
    return progress.progress_metrics(fx.full_log, ["shard"])


@query("progress_estimate", f"""SELECT n AS cells_seen, p AS planned, g AS granules, {fix_sql('gb')} AS gb, {fix_sql('p / n')} AS avg_per_cell, {fix_sql('(p + greatest(0, 60 - n) * p / n)')} AS estimated_granules,
  {fix_sql('(p + greatest(0, 60 - n) * p / n) * gb / s')} AS estimated_gb FROM (SELECT CAST(sum(cells_seen) AS BIGINT) AS n, CAST(sum(planned) AS BIGINT) AS p, CAST(sum(granules) AS BIGINT) AS g, sum(gb) AS gb, sum(n_sizes) AS s FROM ({_SUMS}))""")
def _(fx):
    """Granules and gigabytes of the whole grid, from the cells and sizes seen."""
    out = progress.extrapolate(progress.progress_metrics(fx.full_log, ["shard"]))
    return rounded(out.drop("chips", "n_sizes"), ["gb", "avg_per_cell", "estimated_granules", "estimated_gb"])


_OPEN = """WITH h AS (SELECT shard, max(seq) AS h FROM fx_full_log WHERE kind = 0 GROUP BY shard),
l AS (SELECT f.*, h.h, h.h IS NULL OR f.seq > h.h AS after FROM fx_full_log f LEFT JOIN h USING (shard))
SELECT *, CASE WHEN current_cell IS NULL THEN 0 ELSE greatest(coalesce(todo, 0) - downloaded, 0) END AS "left" FROM (
SELECT shard, max(seq) FILTER (kind < 3 OR kind BETWEEN 5 AND 12 OR kind = 15 AND c % 8 = 3) AS seq, max(cell) FILTER (seq = h) AS current_cell, arg_max(c, seq) FILTER (after AND kind IN (1, 2)) AS todo,
  arg_max(k % 50, seq) FILTER (after AND kind IN (1, 2)) AS skipped, coalesce(arg_max(k % 90, seq) FILTER (after AND kind BETWEEN 5 AND 8), 0) AS downloaded,
  CAST(coalesce(sum(c % 5) FILTER (after AND kind BETWEEN 9 AND 12), 0) AS BIGINT) AS chips, CAST(arg_max(k % 60 + 0.5, seq) FILTER (kind BETWEEN 5 AND 8) AS DOUBLE) AS last_download_seconds,
  arg_max(c % 5, seq) FILTER (kind BETWEEN 9 AND 12) AS last_extract_chips, bool_or(kind = 15 AND c % 8 = 3) AS all_done FROM l GROUP BY shard)"""


@query("progress_open", _OPEN)
def _(fx):
    """The open cell of every shard by line number: granules left, chips since it opened, last download."""
    return progress.open_cells(fx.full_log, ["shard"])


@query("progress_open_stream", _OPEN)
def _(fx):
    """The same from state kept on a stream that gets the log in four triggers."""
    path, ckpt = fresh(fx, "logs"), fresh(fx, "ckpt")
    name, top = f"open_{path[-8:]}", fx.full_log.agg(F.max("seq")).first()[0]
    for k in range(4):
        fx.full_log.where(F.floor(F.col("seq") * 4 / (top + 1)) == k).coalesce(1).write.mode("append").parquet(path)
    lines = fx.spark.readStream.schema(fx.full_log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with progress.keyed_state(fx.spark):
        run = progress.stream_open_cells(lines, ["shard"]).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True) \
            .option("checkpointLocation", ckpt).start()
        run.awaitTermination()
    out = fx.spark.table(name)  # a row per shard and trigger
    return out.groupBy("shard").agg(F.max_by(F.struct(*[c for c in out.columns if c != "shard"]), "seq").alias("_s")).select("shard", "_s.*")


@query("expect_columns", "SELECT state, year, count(*) AS n FROM fx_panel GROUP BY ALL")
def _(fx):
    quality.expect_columns(fx.panel, ["geoid", "state", "year", "yield_target"])
    return readers.guard(fx.panel, F.col("state").isin(*_STATES), "unknown state").groupBy("state", "year").agg(F.count(F.lit(1)).alias("n"))
