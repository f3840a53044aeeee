"""From raw documents to token ids: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acrescope.llm import jaccard_join, mixing, piece_codec, queries, substring_dedup, toxicity_fm
from acrescope.session import cut_lineage


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a factorization machine, fitted on the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_fm.drop_toxic(docs, toxicity_fm.fit(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of similar ones."""
    return jaccard_join.keep_one_per_class(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 13 words that start in an earlier one."""
    return substring_dedup.cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of a mixture by the square roots of the sources' sizes."""
    return mixing.in_mixed_order(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the documents in the order of the mixture, with their _source_index, _block and _slot.

    Files are not read in the order they were written in, so the places are made
    again from sources and ids, which are those that the mixture had.
    """
    return piece_codec.encode_pieces(mixing.in_mixed_order(docs, places=True), queries.tokenizer_file(queries.PIECE_MODEL))


STAGES = [("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("substring dedup", substrings), ("mixing sources to target weights", mixture),
          ("SentencePiece encoding and decoding", pieces)]
ORACLE_SQL = None  # models, components and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
