"""The registered queries of the training-data operators, and DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrescope.llm import (ann_collision, conversation_repair, hard_negatives, jaccard_join, language_id, mixing, piece_codec, quality_rules, substring_dedup, token_count,
                           token_rans, toxicity_fm, url_filter)
from acrescope.llm.common import crc_mod
from acrescope.session import fresh_path

WORD_MODEL, PIECE_MODEL, BYTE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"
BLOCK_RULES, ALLOW_RULES = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as coded blocks and read back."""
    path = fresh_path(spark, "token-ids")
    token_rans.write_ids(_table(spark, sf_dir, "documents"), path, tokenizer_file(WORD_MODEL), end_id=1)
    return token_rans.digest_ids(spark, path)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and back."""
    return piece_codec.round_trip_digests(_table(spark, sf_dir, "documents"), tokenizer_file(PIECE_MODEL))


def op3_ann_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest vectors of every twentieth vector."""
    return ann_collision.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for all documents."""
    out = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from three of four parts by id."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    model = language_id.fit(docs.where(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of all documents at similarity 0.8 of five-word sets."""
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents without passages of 13 words that start in an earlier document."""
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"), window=13)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the url rules for all pages."""
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), BLOCK_RULES, ALLOW_RULES)


def op9_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of four of five parts by id."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity_fm.fit(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = toxicity_fm.score(docs.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot of all documents in a mixture by the square roots of the sources' sizes."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", F.col("_source_index").alias("source_index"), F.col("_block").alias("block"), F.col("_slot").alias("slot"))


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of all documents, and whether they have more than 512 tokens."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file(BYTE_MODEL), limit=512)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after damage by the hash of id and turn."""
    damaged, times = conversation_repair.damage(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, times=times)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, after every seventh row's label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_rans, op2_sentencepiece, op3_ann_collision, op4_quality_rules, op5_language_id, op6_jaccard_join, op7_substring_dedup,
    op8_url_filter, op9_toxicity_fm, op10_source_mixing, op11_token_count, op12_conversation_repair,
    op13_hard_negatives, pipeline)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
ORACLES = {
    "op4_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS p, ws FROM w WHERE len(ws) >= 3),
keyed AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k FROM win),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p + d) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
  len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 100000 AND word_chars >= 2 * n_words AND word_chars <= 12 * n_words AND n_symbols <= 0.1 * n_words
  AND n_stop >= 2 AND n_stop >= 0.02 * n_words AND n_dup_lines <= 0.6 * greatest(n_lines, 1) AS kept
FROM b""",
    "op6_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws, coalesce(text, '') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c.n >= 0.8 * (x.n + y.n - c.n) - 1e-9
  UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.t = y.t AND x.doc_id < y.doc_id),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS class_id, (SELECT count(*) FROM e WHERE e.a = r.a) AS n_links FROM r GROUP BY a""",
    "op7_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13)),
gone AS (SELECT DISTINCT doc_id, p + d AS p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS low FROM win), (SELECT unnest(range(0, 13)) AS d) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
    "op8_url_filter": r"""
WITH a AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, h, p, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
f AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM a LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
}
