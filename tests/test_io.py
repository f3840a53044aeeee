import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from acrescope.operators import quality
from acrescope.plans.fixtures import Fixtures
from acrescope.sources import bucketed, readers
from acrescope.streaming import ingest, progress


def test_panel_reader_rejects_unknown_dates_and_states(spark, tmp_path):
    rows = [("1001", 2018, "08-01", "CO", float("nan"))]
    schema = "geoid string, year int, forecast_date string, state string, yield_target double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/ok")
    row = readers.read_panel(spark, f"{tmp_path}/ok", ["geoid"], ["CO"]).first()
    assert row.geoid == "01001" and row.yield_target is None
    spark.createDataFrame([("1001", 2018, "07-01", "CO", 1.0)], schema).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(PySparkException, match="unknown forecast date"):
        readers.read_panel(spark, f"{tmp_path}/bad", ["geoid"], ["CO"]).collect()
    with pytest.raises(PySparkException, match="unknown state"):
        readers.read_panel(spark, f"{tmp_path}/ok", ["geoid"], ["IA"]).collect()
    with pytest.raises(KeyError):
        readers.read_panel(spark, f"{tmp_path}/ok", ["acres"], ["CO"])


def test_glob_union_reads_headers_by_name_and_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('geoid,x,"odd, name"\n01001,1,"q, r"\n')
    (tmp_path / "b.csv").write_text('y,geoid\n2.5,"00002"\n')
    (tmp_path / "empty.csv").write_text("")
    df = readers.glob_union(spark, f"{tmp_path}/*.csv", "geoid", "geoid string, x int, y double, `odd, name` string")
    assert df.dtypes == [("geoid", "string"), ("x", "int"), ("y", "double"), ("odd, name", "string")]
    assert {tuple(r) for r in df.collect()} == {("01001", 1, None, "q, r"), ("00002", None, 2.5, None)}
    assert len({f for f in df.inputFiles()}) == 2 and "Scan text" not in plan_of(df)  # one scan a layout, no pass over lines
    with pytest.raises(KeyError, match="z"):
        readers.glob_union(spark, f"{tmp_path}/*.csv", "geoid", "geoid string, z int")
    (tmp_path / "c.csv").write_text("geoid,x\n3,many\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        readers.glob_union(spark, f"{tmp_path}/c.csv", "geoid", "geoid string, x int").collect()


def test_slices_with_two_values_fail(spark):
    a = spark.createDataFrame([("IA", "aug1", 1.0)], "state string, d string, v double")
    assert readers.reconcile_slices([a, a], ["state", "d"], ["v"], "d", {"aug1": "08-01"}).collect()[0].d == "08-01"
    with pytest.raises(PySparkException, match="two values"):
        readers.reconcile_slices([a, a.withColumn("v", F.col("v") + 1)], ["state", "d"], ["v"], "d", {"aug1": "08-01"}).collect()


def test_json_error_payload_has_no_rows(spark):
    df = spark.createDataFrame([('{"data":[{"Value":"1"},{"Value":"2"}]}',), ('{"error":["no"]}',)], "p string")
    assert sorted(r.Value for r in readers.json_records(df, "p", "Value: string").collect()) == ["1", "2"]


def test_a_file_without_the_key_column_fails_the_union(spark, tmp_path):
    (tmp_path / "a.csv").write_text("geoid,x\n1,2\n")
    (tmp_path / "b.csv").write_text("GEOID,x\n3,4\n")
    with pytest.raises(ValueError, match="b.csv"):
        readers.glob_union(spark, f"{tmp_path}/*.csv", "geoid", "geoid string, x int")


def test_unreadable_shards_are_named(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/s")
    (tmp_path / "s" / "broken.parquet").write_text("no parquet")
    shards = readers.read_shards(spark, f"{tmp_path}/s", "id long")
    assert shards.count() == 5
    assert [r.shard_source for r in readers.silent_shards(spark, f"{tmp_path}/s", shards).collect()] == ["broken.parquet"]


def test_ingest_is_safe_to_rerun(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.col("id") * 2)
    rows.write.parquet(f"{tmp_path}/in")
    for run in ("c1", "c1", "c2"):  # a new checkpoint replays every file
        ingest.ingest_available(spark, f"{tmp_path}/in", rows.schema, f"{tmp_path}/out", f"{tmp_path}/{run}", ["id"])
    assert bucketed.read(spark, f"{tmp_path}/out").count() == 10


def test_progress_reads_every_line_kind(spark):
    lines = ["after resume-skip: 40 granules to download (2 already done)", "approx download size: 1.5 GB",
             "[1/40] X.Y -> 9 rows (3 chips written)", "CELL IA-2018 done in 12.5s (40 granules processed)", "noise"]
    df = spark.createDataFrame([("s", x) for x in lines], "shard string, line string")
    row = progress.progress_metrics(df, ["shard"]).first()
    assert (row.planned, row.skipped, row.chips, row.granules, row.gb, row.cells_done) == (40, 2, 3, 40, 1.5, 1)
    total = progress.extrapolate(progress.progress_metrics(df, ["shard"])).first()
    assert total.estimated_granules == 40 + 59 * 40 and total.estimated_gb == pytest.approx(2400 * 1.5)


LOG = ["=== CELL IA-2018", "after resume-skip: 40 granules to download (2 already done)", "[7/40] downloaded g7 (18 files, 3.5s)", "[7/40] g7 -> 9 rows (3 chips written)",
       "CELL IA-2018 done in 12.5s (40 granules processed)", "=== CELL NE-2019", "[1/9] g1 -> 9 rows (4 chips written)", "after resume-skip: 9 granules to download (1 already done)",
       "[2/9] downloaded g2 (18 files, 4.0s)", "noise", "[2/9] g2 -> 1 rows (5 chips written)"]


def follow(lines):
    """The open cell of one log, line by line."""
    s = {"current_cell": None, "todo": None, "skipped": None, "downloaded": 0, "chips": 0, "last_download_seconds": None, "last_extract_chips": None, "all_done": False}
    for line in lines:
        words = line.split()
        if line.startswith("=== CELL"):
            s.update(current_cell=words[2], todo=None, skipped=None, downloaded=0, chips=0)
        elif "to download" in line:
            s.update(todo=int(words[2]), skipped=int(words[6][1:]))
        elif "] downloaded" in line:
            s.update(downloaded=int(words[0][1:].split("/")[0]), last_download_seconds=float(words[5][:-2]))
        elif "chips written" in line:
            s.update(chips=s["chips"] + int(words[5][1:]), last_extract_chips=int(words[5][1:]))
        elif "ALL CELLS DONE" in line:
            s["all_done"] = True
    return {**s, "left": max(0, (s["todo"] or 0) - s["downloaded"]) if s["current_cell"] else 0}


def test_open_cells_follow_the_lines(spark):
    logs = {"a": LOG, "b": LOG[:5], "c": LOG[1:4], "d": [*LOG[:6], "ALL CELLS DONE in 3.0 minutes"], "e": ["noise"]}
    df = spark.createDataFrame([(k, i, x) for k, lines in logs.items() for i, x in enumerate(lines)], "shard string, seq int, line string").repartition(4)
    got = {r.shard: {c: v for c, v in r.asDict().items() if c not in ("shard", "seq")} for r in progress.open_cells(df, ["shard"]).collect()}
    assert got == {k: follow(v) for k, v in logs.items() if k != "e"}


def test_state_of_a_stream_follows_the_lines(spark, tmp_path):
    rows = [("a", i, x) for i, x in enumerate(LOG)] + [("b", i, x) for i, x in enumerate(LOG[:5])]
    for part in (rows[:3] + rows[13:14], rows[3:8][::-1] + rows[11:13], rows[8:11] + rows[14:], rows[2:4]):  # shuffled inside a trigger; the last repeats
        spark.createDataFrame(part, "shard string, seq int, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    lines = spark.readStream.schema("shard string, seq int, line string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    with progress.keyed_state(spark):
        run = progress.stream_open_cells(lines, ["shard"]).writeStream.outputMode("update").format("memory").queryName("open_cells_test").trigger(availableNow=True) \
            .option("checkpointLocation", f"{tmp_path}/ckpt").start()
        run.awaitTermination()
    out = [r for r in spark.table("open_cells_test").collect() if r.shard == "a"]
    assert len(out) >= 3
    last = max(out, key=lambda r: r.seq)
    assert {c: v for c, v in last.asDict().items() if c not in ("shard", "seq")} == follow(LOG)


def test_broken_rows_are_counted_and_split_in_one_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (-3, "b"), (-4, None), (None, "c")], "n int, s string")
    df.write.parquet(f"{tmp_path}/in")
    rules = {"negative": F.col("n") < 0, "nameless": F.col("s").isNull()}
    source = spark.read.schema(df.schema).parquet(f"{tmp_path}/in")
    marked, _ = quality.mark_broken(source, rules)
    physical = plan_of(marked).split("== Physical Plan ==")[1]
    assert physical.count("FileScan") == 1 and "Exchange" not in physical and "CollectMetrics" in physical
    good, bad, counts = quality.split_write(source, rules, f"{tmp_path}/out")
    assert counts == {"n_rows": 5, "n_broken": 3, "negative": 2, "nameless": 2}
    assert {r.s for r in good.collect()} == {"a", "c"} and good.columns == df.columns
    assert {r.n: r.broken for r in bad.collect()} == {2: ["nameless"], -3: ["negative"], -4: ["negative", "nameless"]}
    with pytest.raises(ValueError, match="3 of 5"):
        quality.split_write(source, rules, f"{tmp_path}/strict", at_most=0.5)
    none, quarantined, counts = quality.split_write(source.limit(0), rules, f"{tmp_path}/none")
    assert none.count() == quarantined.count() == counts["n_rows"] == 0


def test_progress_runs_on_a_stream_of_log_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "s1.log").write_text("after resume-skip: 40 granules to download (2 already done)\n[1/40] X -> 9 rows (3 chips written)\n")
    run = progress.stream_progress(spark, str(tmp_path / "logs"), "progress_from_files")
    run.awaitTermination()
    row = spark.table("progress_from_files").first()
    assert (row.shard, row.planned, row.chips) == ("s1.log", 40, 3)


# --- plans -------------------------------------------------------------------
def plan_of(df):
    return df._jdf.queryExecution().toString()


CLEAN = ["state_season", "season_features", "asof_strict", "backtest_sweep", "knn_join_same_entity", "chip_sequence", "emissions_agg",
         "best_window_2d", "topk_per_group", "bbox_overlap_join", "state_forecast_doc", "score_summary"]


@pytest.mark.parametrize("name", CLEAN)
def test_no_cross_joins_in_plans(name, spark, sf_dir):
    from acrescope.plans import load_catalog

    text = plan_of(load_catalog()[0][name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_rank_filters_are_pushed_below_the_shuffle(spark, sf_dir):
    from acrescope.plans import load_catalog

    assert "WindowGroupLimit" in plan_of(load_catalog()[0]["topk_per_group"](spark, sf_dir))


def test_scans_read_only_the_columns_they_need(spark, sf_dir):
    text = plan_of(Fixtures(spark, sf_dir).classcount)
    scan = next(x for x in text.splitlines() if "FileScan parquet" in x)
    assert "l_suppkey" in scan and "l_shipdate" not in scan and "l_extendedprice" not in scan


def test_season_features_shuffle_once(spark):
    from acrescope.operators import weather
    df = spark.createDataFrame([], "geoid string, year int, date date, tmin_c double, tmax_c double, prcp_mm double, srad_mjm2 double, vpd_kpa double")
    physical = plan_of(weather.season_features(df, ["geoid", "year"])).split("== Physical Plan ==")[1]
    assert physical.count("Exchange hashpartitioning") <= 1
