"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from acrescope.llm import (ann_collision, jaccard_join, language_id, mixing, piece_codec, quality_rules, queries, substring_dedup, token_rans,
                           toxicity_fm, url_filter)
from acrescope.session import fresh_path

LONG = " ".join(f"word{i % 997} of{i}" for i in range(30_000))
WORDS = " ".join(f"w{i}" for i in range(40))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, grp int, score double, ids string, part string, "
          "block string, rank int, n_words string, label string")
EXTRA = ("k", 1, 0.5, "i", "p", "b", 7, "n", "l")
ROWS = [
    (1, WORDS, "en", "a", 200, *EXTRA), (1, WORDS, "en", "a", 200, *EXTRA), (1, "another text of one id", "en", "a", 3, *EXTRA),
    (2, WORDS, "en", None, 200, *EXTRA), (None, WORDS, "en", "a", None, *EXTRA), (None, None, None, None, None, *[None] * 9),
    (3, None, "en", "b", None, *EXTRA), (4, "", "en", "b", 0, *EXTRA), (5, " \n\t ", None, "b", 4, *EXTRA), (6, LONG, "en", "c", len(LONG), *EXTRA),
    (7, "12 34 !!", "en", "c", 8, *EXTRA), (8, WORDS + " tail", "en", "c", 205, *EXTRA), (9, "four words are short", "en", "c", 20, *EXTRA),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(rows, value):
    return {(r["doc_id"], r["text"]): r[value] for r in rows}


def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path, model = fresh_path(spark, "t"), queries.tokenizer_file(queries.WORD_MODEL)
    token_rans.write_ids(odd, path, model)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in token_rans.digest_ids(spark, path).collect()))
    library = Tokenizer.from_file(model)
    ids = [[*library.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ROWS]
    want = sorted((r[0] is not None, r[0] or 0, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, i in zip(ROWS, ids))
    assert got == want
    starts = sorted((r.start, r.n_tokens) for r in token_rans.digest_ids(spark, path).collect())
    assert [s for s, _ in starts] == np.cumsum([0, *[n for _, n in starts]])[:-1].tolist()
    empty = fresh_path(spark, "t")
    token_rans.write_ids(none, empty, model)
    assert token_rans.digest_ids(spark, empty).count() == 0 and token_rans.read_ids(spark, empty).count() == 0


def test_pieces(spark, odd, none):
    model = queries.tokenizer_file(queries.PIECE_MODEL)
    coded = piece_codec.encode_pieces(odd, model)  # the string column ``ids`` gives way
    assert "text" not in coded.columns and dict(coded.dtypes)["ids"] == "array<int>"
    rows = piece_codec.decode_pieces(coded, model).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == sorted((r[0] or 0, r[1] or "") for r in ROWS)
    assert all(r.ids == [2] and r.n_tokens == 1 for r in rows if r.text == "")
    assert piece_codec.round_trip_digests(odd, model).count() == len(ROWS) and piece_codec.encode_pieces(none, model).count() == 0


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (20, [1.0, 0.0], "x"), (3, [2.0, 0.0], "x"), (4, [2.0, 0.0], "x"), (5, [0.0, 0.0], "x"), (6, None, "x"), (7, [nan, 1.0], "x"),
            (8, [inf, 1.0], "x"), (9, [None, 1.0], "x"), (None, [9.0, 9.0], "x"), (3, [2.0, 0.0], "x"), (40, [0.0, 0.0], "x"), (10, [0.0, -1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    got = ann_collision.search(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(0, 1, 3, 2.0), (0, 2, 4, 2.0), (0, 3, 20, 1.0), (20, 1, 3, 2.0), (20, 2, 4, 2.0), (20, 3, 0, 1.0)]
    assert ann_collision.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    # vectors that share an id are found and ask on their own; equal ones are one
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 0.5]), (0, [0.5, 0.5]), (3, [5.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 7.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann_collision.search(two, F.col("vec_id") == 0, k=3).collect())
    assert got == sorted([(0, 1, 3, 5.0), (0, 2, 3, 2.0), (0, 3, 0, 0.5), (0, 1, 4, 3.5), (0, 2, 3, 2.5), (0, 3, 3, 1.0)])


def test_quality(odd, none):
    got = quality_rules.judge(odd.select("doc_id", "text", "source")).collect()
    assert len(got) == len(ROWS)
    blank = [r for r in got if not (r.text or "").strip()]
    assert len(blank) == 4 and all(r.base_failed and not r.kept and (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (0, 0, 0, 0) for r in blank)
    assert quality_rules.judge(none).count() == 0


def test_language(odd, none):
    model = language_id.fit(odd)
    got = {(r.doc_id, r.lang_pred, r.part) for r in language_id.identify(odd, model).collect()}
    assert {(3, "und", "p"), (4, "und", "p"), (7, "und", "p"), (9, "en", "p")} <= got
    untaught = language_id.fit(none)
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd, untaught).collect()} == {("und", 0.0)}
    assert language_id.identify(none, model).count() == 0


def test_near_duplicates(odd, none):
    got = jaccard_join.jaccard_join(odd).groupBy("doc_id", "class_id").agg(F.count("*").alias("n"), F.max("n_links").alias("links")).collect()
    found = {(r.doc_id, r.class_id): (r.n, r.links) for r in got}
    assert found[(1, 1)] == (3, 4) and found[(8, 1)] == (1, 4) and found[(None, 1)] == (1, 4)  # the text twice under 1, under 2, without id, and with a tail
    assert found[(3, 3)] == (1, 2) and found[(4, 3)] == (1, 2) and found[(5, 5)] == (1, 0)  # null reads as empty
    kept = jaccard_join.keep_one_per_class(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3, 5, 6, 7, 9]  # two different texts have the id 1
    assert jaccard_join.jaccard_join(none).count() == 0 and jaccard_join.keep_one_per_class(none).count() == 0


def test_passages(odd, none):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(odd, group_bytes=500).collect()}
    assert got == {(1, 40, 0), (1, 5, 0), (2, 40, 40), (None, 40, 40), (None, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 0), (6, 60_000, 0), (7, 3, 0), (8, 41, 40), (9, 4, 0)}
    cut = substring_dedup.cut_repeats(odd, group_bytes=500)
    assert cut.columns == odd.columns and cut.count() == len(ROWS)
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.where("doc_id IN (2, 8, 9)").collect()} == {2: ("", 0), 8: ("tail", 4), 9: ("four words are short", 20)}
    assert substring_dedup.remove_repeats(none).count() == 0 and substring_dedup.cut_repeats(none).count() == 0


def test_urls(spark):
    urls = [None, "", "no scheme", "HTTP://A.Example.NET/en/x?q", "http://example.net/de/", "http://net", "http://net/", "http://notnet.org/fr/1", "x://a.org/en/",
            "http://www.example.com/de/a#b", "http://example.com/de", "://", "http:///x", "http://a.net?x/en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://b.net/", "h")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, queries.BLOCK_RULES, queries.ALLOW_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/x", "example.net/en/", "allow"),
        4: ("example.net", "/de/", "net/", "block"), 5: ("net", "", None, "allow"), 6: ("net", "/", "net/", "block"), 7: ("notnet.org", "/fr/1", "org/fr/", "allow"),
        8: ("a.org", "/en/", None, "allow"), 9: ("www.example.com", "/de/a", "example.com/de/", "block"), 10: ("example.com", "/de", None, "allow"),
        11: ("", "", None, "allow"), 12: ("", "/x", None, "allow"), 13: ("a.net", "", None, "allow"), None: ("b.net", "/", "net/", "block")}
    assert url_filter.judge_urls(df.limit(0), ["net/"], []).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(df, [], []).collect()} == {"allow"}


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (2, 0), (77, 1)], "doc_id long, toxic int")
    model = toxicity_fm.fit(odd, labels)
    got = toxicity_fm.score(odd, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got) and got[0].part in ("p", None)
    assert len({r.score for r in got if not (r.text or "").strip()}) == 1
    untaught = toxicity_fm.fit(none, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity_fm.score(odd, untaught).collect()} == {0.5}
    assert toxicity_fm.drop_toxic(none, model).columns == none.columns


def test_mixing(odd, none):
    got = mixing.mix(odd, block=2).collect()
    assert len(got) == len(ROWS)
    assert sorted((r.source or "", r._source_index) for r in got) == sorted((s, i) for s, n in (("", 2), ("a", 4), ("b", 3), ("c", 4)) for i in range(n))
    assert {r._slot for r in got} == set(range(7))
    assert mixing.mix(none).count() == 0
    ordered = mixing.in_mixed_order(odd)
    assert ordered.columns == odd.columns and ordered.count() == len(ROWS)


def test_digest_of_whole_text(odd):
    whole = substring_dedup.remove_repeats(odd.where("doc_id = 6")).first()
    assert whole.kept_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
