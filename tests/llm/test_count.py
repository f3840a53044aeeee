"""Token counts against the library: any text, added tokens, long texts cut in parts, odd tables."""

import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from acrescope.llm import queries, token_count

PATH = queries.tokenizer_file(queries.BYTE_MODEL)
LIBRARY = Tokenizer.from_file(PATH)
PIECES = ["a", "s", "t", "'", "'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", "\x1c", "\xa0", " ", "é", "1", "٣", "!", "<|endoftext|>", "<|endof", "text|>", "漢", "😀",
          "́", "don't", "hello", " world", "ⅷ", "²", "﻿", "aaaaaaaa"]
TEXT = st.lists(st.sampled_from(PIECES) | st.characters(blacklist_categories=("Cs",)), max_size=40).map("".join)


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=250, deadline=None)
@given(st.lists(TEXT | st.none(), max_size=6), st.sampled_from([1, 7, 1 << 20]), st.sampled_from([16, 1 << 20]))
def test_counts_are_the_librarys(texts, part, piece):
    model = token_count.load_model(PATH)
    old = token_count.PART, token_count.TEXT_SLICE
    try:
        token_count.PART, token_count.TEXT_SLICE = part, piece
        assert model.counts(pa.array(texts, pa.string())).tolist() == library(texts)
    finally:
        token_count.PART, token_count.TEXT_SLICE = old


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcdeth nr'"), min_size=1, max_size=300))
def test_merges_pop_the_lowest_rank_first(word):
    """Initial symbols minus merges, against merging by repeated search of the best pair."""
    model = token_count.load_model(PATH)
    sym, merges = [model.symbol[b] for b in word.encode()], 0
    while True:
        found = [(model.pairs[k][0], i) for i in range(len(sym) - 1) if (k := sym[i] * model.base + sym[i + 1]) in model.pairs]
        if not found:
            break
        _, i = min(found)
        sym[i:i + 2] = [model.pairs[sym[i] * model.base + sym[i + 1]][1]]
        merges += 1
    assert model.merges(word.encode()) == merges


def test_a_small_store_gives_the_same_counts(monkeypatch):
    model = token_count.CountModel(PATH)
    monkeypatch.setattr(token_count, "STORE", 20)
    texts = [f"word{k} and{k % 7} some{k % 50} more" for k in range(400)]
    for k in range(0, 400, 40):
        assert model.counts(pa.array(texts[k:k + 40])).tolist() == library(texts[k:k + 40])
    assert len(model.key) <= 400


def test_spans_without_end():
    texts = ["ab" * 60_000, "é" * 50_000, "'" * 30_000, " " * 40_000, "x " * 60_000 + "<|endoftext|>" * 500, "漢字" * 20_000]
    assert token_count.load_model(PATH).counts(pa.array(texts)).tolist() == library(texts)


def test_other_vocabularies_are_refused(tmp_path):
    spec = json.load(open(PATH))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}, {"model": {**spec["model"], "ignore_merges": True}},
                   {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        path = tmp_path / "v.json"
        path.write_text(json.dumps({**spec, **change}))
        with pytest.raises(ValueError):
            token_count.CountModel(str(path))
    with pytest.raises(ValueError):
        token_count.CountModel(queries.tokenizer_file(queries.WORD_MODEL))


def test_odd_rows(spark):
    schema = "doc_id long, text string, n_tokens string, n_bytes string, key string, over_limit int"
    rows = [(1, "Hello world", "a", "b", "c", 1), (1, "Hello world", "a", "b", "c", 1), (None, None, None, None, None, None), (None, "é", None, None, "k", 2), (2, "", "", "", "", 0),
            (3, "word " * 512, "", "", "", 0), (3, "word " * 513, "", "", "", 0), (4, "long text, " * 100_000, "", "", "", 0)]
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = token_count.count_tokens(df, PATH, 512)
    assert got.columns == ["doc_id", "key", "n_bytes", "n_tokens", "over_limit"]
    want = library([r[1] for r in rows])
    key = lambda r: (r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got.collect()), key=key) == sorted(
        ((r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows, want)), key=key)
    assert token_count.count_tokens(df.limit(0), PATH, 512).count() == 0


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op11_token_count(spark, sf_dir).collect()}
    want = dict(zip(docs, library(docs.values())))
    assert {k: r.n_tokens for k, r in got.items()} == want and all(r.over_limit == (want[k] > 512) for k, r in got.items())
    assert all(r.n_bytes == len((docs[k] or "").encode()) for k, r in got.items()) and np.mean(list(want.values())) > 50
