"""The corpus pipeline stage by stage on the small tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from acrescope.llm import mixing, piece_codec, queries


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_columns_stay_but_in_the_last(spark, stages, sf_dir):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(s.columns == columns for s in stages[:-1]) and {"doc_id", "ids", "n_tokens"} <= set(stages[-1].columns)


def test_each_stage_works_on_what_the_one_before_kept(stages):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert ids[1] < ids[0] and ids[1] == ids[2] == ids[3] == ids[4]
    assert stages[2].agg(F.sum("n_chars")).first()[0] < stages[1].agg(F.sum("n_chars")).first()[0]


def test_one_of_each_group_stays(spark, stages):
    from acrescope.llm import jaccard_join

    links = jaccard_join.jaccard_join(stages[1]).where("n_links > 0")
    assert links.count() == 0


def test_ids_give_the_texts_back(stages):
    decoded = piece_codec.decode_pieces(stages[4].select("doc_id", "ids"), queries.tokenizer_file(queries.PIECE_MODEL))
    both = decoded.join(stages[3].select("doc_id", F.col("text").alias("t")), "doc_id")
    assert both.where(~F.col("text").eqNullSafe(F.col("t"))).count() == 0


def test_run_gives_the_rows_of_the_last_stage(spark, stages, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").exceptAll(stages[4].select("doc_id", "n_tokens")).count() == 0


def test_run_follows_the_schedule_after_files_are_read_again(spark, stages, sf_dir, tmp_path):
    want = [(r._slot, r._source_index, r.doc_id) for r in mixing.mix(stages[2]).orderBy("_slot", "_source_index").collect()]
    assert len({slot for slot, _, _ in want}) > 5
    out = corpus_pipeline.run(spark, sf_dir)
    assert [(r._slot, r._source_index, r.doc_id) for r in out.collect()] == want
    out.write.parquet(f"{tmp_path}/out")
    again = spark.read.parquet(f"{tmp_path}/out")
    assert len(again.inputFiles()) > 1
    assert [(r._slot, r._source_index, r.doc_id) for r in again.orderBy("_slot", "_source_index").collect()] == want


CLASH = ["_toxicity", "_key", "_id", "_text_key", "_class_key", "_mix_source", "_mix_hash", "_mix_salt", "_mix_row", "_mix_before"]


def through_all(spark, docs, sf_dir, tmp_path):
    """Rows after each stage, written and read again as the pipeline does."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/s{k}")
        docs = spark.read.parquet(f"{tmp_path}/s{k}")
        out.append(docs)
    return out


def test_null_ids_repeated_rows_and_clashing_names_go_through_all_stages(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    words = [" ".join(f"w{i}x{k}" for k in range(40)) for i in range(6)]
    rows = [(1, words[0], "en", "a", 1), (1, words[0], "en", "a", 1), (1, words[1], "en", "a", 1), (None, words[2], None, None, None), (None, None, None, None, None),
            (2, "", "en", "b", 0), (3, words[3], "en", "b", 1), (4, words[3], "en", "b", 1), (5, words[4] + " " + words[5], "en", "c", 1)]
    docs = spark.createDataFrame([(*r, *(f"{c}{k}" for c in CLASH)) for k, r in enumerate(rows)], schema).repartition(3)
    stages = through_all(spark, docs, sf_dir, tmp_path)
    assert all(s.columns == docs.columns for s in stages[:4]) and {*CLASH, "doc_id", "ids"} <= set(stages[4].columns)
    given = {tuple(r) for r in docs.collect()}
    assert {tuple(r) for r in stages[1].collect()} <= given
    kept = sorted((r.doc_id or 0, r.text or "") for r in stages[1].collect())
    assert kept == sorted([(1, words[0]), (1, words[1]), (0, words[2]), (2, ""), (3, words[3]), (5, words[4] + " " + words[5])])
    assert [s.count() for s in stages[1:]] == [6] * 4 and {r._mix_row for r in stages[4].collect()} <= {r[-2] for r in given}


def test_an_empty_table_goes_through_all_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    stages = through_all(spark, docs, sf_dir, tmp_path)
    assert [s.count() for s in stages] == [0] * 5 and all(s.columns == docs.columns for s in stages[:4])
