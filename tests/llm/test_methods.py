"""The methods themselves: exactness against brute force, round trips, recall, bounds."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acrescope.llm import ann_collision, common, jaccard_join, language_id, mixing, piece_codec, queries, substring_dedup, token_rans, toxicity_fm, url_filter

TEXT = st.text(st.characters(blacklist_categories=("Cs",)) | st.sampled_from(" \n\t.,'<|>▁aAbé"), max_size=60)


# --- words ---------------------------------------------------------------------
@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT | st.none(), max_size=6), st.integers(1, 40))
def test_word_table_counts_what_bytes_split_finds(texts, limit):
    (hashes,), bounds = common.word_table(pa.array(texts, pa.string()), limit=limit)
    words = [(t or "").encode().split() for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in words]
    flat = [w for row in words for w in row]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


# --- token files ------------------------------------------------------------------
def test_ids_are_counted_in_runs_and_spans_read_once(monkeypatch):
    monkeypatch.setattr(token_rans, "COUNT_IDS", 5)
    docs = [[1], [70_000, 3, 1], [3, 3, 3, 3, 3, 3, 1], [], [9, 1]]
    width = [4 if max(d, default=0) > 65_535 else 2 for d in docs]
    body = [np.array(d, np.uint16 if w == 2 else np.uint32).tobytes() for w, d in zip(width, docs)]
    batch = pa.RecordBatch.from_arrays([pa.array(width, pa.int32()), pa.array(body, pa.binary())], names=["width", "ids"])
    (got,) = token_rans._count(iter([batch.slice(0, 2), batch.slice(2)]))
    assert dict(zip(*(got.column(c).to_pylist() for c in ("symbol", "n")))) == Counter(i for d in docs for i in d)
    (none,) = token_rans._count(iter([]))
    assert none.num_rows == 0
    data, starts, ends = np.frombuffer(b"one two two", np.uint8), np.array([0, 4, 8]), np.array([3, 7, 11])
    both = common.span_hashes(data, starts, ends, (0, 1))
    assert [b.tolist() for b in both] == [common.span_hash(data, starts, ends, seed).tolist() for seed in (0, 1)]
    assert both[0][1] == both[0][2] != both[0][0] and both[0][1] != both[1][1]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file(queries.WORD_MODEL)
    library = Tokenizer.from_file(path)
    got = [i.tolist() for i in token_rans.encode_texts(path, pa.array(texts, pa.string()), 1)]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(1, 16), st.integers(1, 5), st.data())
def test_blocks_decode_from_any_checkpoint(ids, lanes, stride, data):
    ids = np.array(ids)
    table = token_rans.scale_counts(*np.unique(ids, return_counts=True))
    body = token_rans.encode_block(table.place[ids], table, lanes, stride)
    first = data.draw(st.integers(0, len(ids)))
    last = data.draw(st.integers(first, len(ids)))
    assert table.symbols[token_rans.decode_block(body, table, stride, first, last)].tolist() == ids[first:last].tolist()


def test_a_skewed_source_is_coded_near_its_entropy():
    rng = np.random.default_rng(1)
    ids = rng.geometric(0.2, 1 << 18) % 1000
    table = token_rans.scale_counts(*np.unique(ids, return_counts=True))
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    entropy = -(share * np.log2(share)).sum() * len(ids) / 8
    assert entropy < len(token_rans.encode_block(table.place[ids], table)) < 1.02 * entropy + 20_000  # two checkpoints of 1,024 states


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    token_rans.write_ids(docs, f"{tmp_path}/t", queries.tokenizer_file(queries.WORD_MODEL))
    blocks = spark.read.parquet(f"{tmp_path}/t/blocks").withColumn("crc32", F.col("crc32") + 1)
    blocks.write.parquet(f"{tmp_path}/u/blocks")
    spark.read.parquet(f"{tmp_path}/t/table").write.parquet(f"{tmp_path}/u/table")
    with pytest.raises(Exception, match="damaged"):
        token_rans.digest_ids(spark, f"{tmp_path}/u").collect()


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_checksums_join(a, b):
    import zlib

    assert token_rans.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_documents_over_many_blocks(spark, tmp_path):
    import zlib

    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i * 50))) for i in range(12)], "doc_id long, text string")
    model = queries.tokenizer_file(queries.WORD_MODEL)
    token_rans.write_ids(docs, f"{tmp_path}/t", model, block=64)
    parts = token_rans.read_ids(spark, f"{tmp_path}/t").orderBy("doc_id", "piece").collect()
    whole = {i: b"".join(bytes(p.ids) for p in parts if p.doc_id == i) for i in range(12)}
    got = {r.doc_id: r for r in token_rans.digest_ids(spark, f"{tmp_path}/t").collect()}
    assert all(zlib.crc32(whole[i]) == got[i].ids_crc32 and len(whole[i]) == 4 * got[i].n_tokens for i in range(12))


# --- pieces -----------------------------------------------------------------------
@pytest.fixture(scope="module")
def coder():
    return piece_codec.load_model(queries.tokenizer_file(queries.PIECE_MODEL))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT | st.text("ab ▁", max_size=300), min_size=1, max_size=4))
def test_pieces_are_the_librarys(coder, texts):
    got = list(coder.encode(pa.array(texts, pa.string())))
    assert got == [[*coder.library.encode(t), 2] for t in texts]
    assert [coder.decode(i).decode() for i in got] == [coder.library.decode(i) for i in got]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 260), max_size=8))
def test_any_ids_decode_as_in_the_library(coder, ids):
    assert coder.decode(ids).decode() == coder.library.decode(ids)


# --- neighbours -------------------------------------------------------------------
def test_recall_and_scores(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = table.toPandas()
    x, ids = np.array(rows.embedding.tolist(), float), rows.vec_id.to_numpy()
    x[::7] *= 3  # lengths that differ
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = ann_collision.search(df, F.col("vec_id") % 20 == 0, k=20, block=100, queries=10).collect()
    asks = ids[ids % 20 == 0]
    score = x[np.isin(ids, asks)] @ x.T
    hits = 0
    for a, s in zip(asks, score):
        mine = sorted((r for r in got if r.query_id == a), key=lambda r: r.rank)
        assert len(mine) == 20 and a not in [r.vec_id for r in mine]
        assert [r.score for r in mine] == pytest.approx([s[np.flatnonzero(ids == r.vec_id)[0]] for r in mine], abs=1e-12)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        s = np.where(ids == a, -np.inf, s)
        hits += len(set(ids[np.argsort(-s)[:20]]) & {r.vec_id for r in mine})
    assert hits >= 0.9 * 20 * len(asks)


def test_the_collision_threshold_keeps_the_wanted_recall():
    plan, rng = ann_collision.Plan(), np.random.default_rng(0)
    near = np.abs(rng.normal(size=(4000, plan.projections))) <= plan.reach
    assert (near.sum(1) >= plan.threshold).mean() >= plan.recall - 0.02


# --- language, toxicity ------------------------------------------------------------
def plain_language(rows, texts, alpha=0.5):
    """(language, posterior) by counting every gram on its own; rows are (text, language)."""
    def buckets(text):
        import unicodedata

        chars = [0, *(ord(c) if unicodedata.category(c)[0] in "LM" else 0 for c in text.lower()), 0]
        out, cut = [], 0xFFFFFFFF
        for a, b, d in zip(chars, chars[1:], chars[2:]):
            if b:
                one = b * 0x9E3779B1 & cut
                two = (a * 0x85EBCA77 & cut) ^ one
                three = (two * 0xC2B2AE3D & cut) ^ (d * 0x27D4EB2F & cut)
                out += [((h ^ h >> 15) * 0x165667B1 & cut) >> 17 for h in ((one + 1) & cut, (two + 2) & cut, (three + 3) & cut)]
        return out

    langs = sorted({lang for _, lang in rows})
    counts = {lang: Counter(g for text, own in rows if own == lang for g in buckets(text)) for lang in langs}
    total = {lang: sum(c.values()) + alpha * language_id.BUCKETS for lang, c in counts.items()}
    out = []
    for text in texts:
        logs = [np.log(sum(own == lang for _, own in rows) / len(rows)) + sum(np.log((counts[lang][g] + alpha) / total[lang]) for g in buckets(text)) for lang in langs]
        best = int(np.argmax(logs))
        out.append((langs[best], 1 / np.exp(np.array(logs) - logs[best]).sum()) if any(c.isalpha() for c in text) else ("und", 0.0))
    return out


@pytest.mark.parametrize("cells", [1 << 21, 7])
def test_language_against_counting_gram_by_gram(spark, monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    rows = [("The cat sat on the mat", "en"), ("Le chat était là, ça va", "fr"), ("Der Hund und die Katze", "de"), ("another one of the same", "en"), ("\u0301x\u0301", "fr")]
    texts = ["the hat", "où est le chat", "die Straße", "x", "\u0301 \u0301", "\u0903", "12!", "", "a\u0301", "ça\nund the", "Ω"]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    names, share = model.predict(pa.array(texts))
    want = plain_language(rows, texts)
    assert [n for n, _ in want] == names and np.allclose(share, [p for _, p in want], rtol=1e-4)
    assert names[4:8] == ["und"] * 4 and share[4] == 0


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(
        queries.op5_language_id(spark, "/root/testdata/sf0.01"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = docs.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right >= 0.97 * n


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op9_toxicity_fm(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = (rows.predicted == 1) & (rows.toxic == 1)
    assert hit.sum() >= 0.9 * (rows.toxic == 1).sum() and hit.sum() >= 0.93 * (rows.predicted == 1).sum()


def test_pairs_that_a_sum_of_weights_cannot_tell():
    """Label 1 only where both terms meet or both are absent."""
    rng = np.random.default_rng(4)
    terms, bounds, label = [], [0], []
    for _ in range(2000):
        a, b = rng.random(2) < 0.5
        row = sorted({*(([1] if a else []) + ([2] if b else [])), 3 + int(rng.integers(3))})
        terms += row
        bounds.append(len(terms))
        label.append(float(a == b))
    terms, bounds, label = np.array(terms, np.int32), np.array(bounds), np.array(label)
    keep = toxicity_fm.select_terms
    try:
        toxicity_fm.select_terms = lambda t, b, y, n: np.array([1, 2, 3, 4, 5])
        model = toxicity_fm.train(terms, bounds, label)
    finally:
        toxicity_fm.select_terms = keep
    assert ((model.logits(terms, bounds) > 0) == (label == 1)).mean() > 0.97


def test_a_pair_of_words_that_tell_nothing_alone_is_learned_by_the_fit(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append((i, " ".join(["aa"] * int(a) + ["bb"] * int(b) + [f"f{k}" for k in rng.integers(40, size=6)]), int(a == b)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity_fm.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    score = model.score(pa.array([t for _, t, _ in rows]))
    assert ((score >= 0.5) == np.array([y for *_, y in rows])).mean() > 0.97


def test_more_telling_terms_than_any_fixed_number_are_learned():
    """600 terms in three rows of label 1 each; the first 512 are 85 of 100 of these rows."""
    rng, terms, bounds = np.random.default_rng(3), [], [0]
    for i in range(12_000):
        terms += sorted({*([1000 + i % 600] if i < 1800 else []), *(5000 + rng.integers(50, size=5)).tolist()})
        bounds.append(len(terms))
    terms, bounds, label = np.array(terms, np.int32), np.array(bounds), (np.arange(12_000) < 1800).astype(float)
    found = toxicity_fm.train(terms, bounds, label).logits(terms, bounds) > 0
    assert found[:1800].mean() > 0.9 and not found[1800:].any()


def test_copies_of_one_id_leave_the_others_in_the_fit(spark):
    docs = spark.createDataFrame([(1, f"copy w{i}") for i in range(300)] + [(i, f"word{i}") for i in range(2, 21)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 21)], "doc_id long, toxic int")
    rows = toxicity_fm.sampled(docs.repartition(4), labels, doc_id="doc_id", text="text", label="toxic", sample=20).collect()
    assert sorted((r.doc_id, r.label) for r in rows) == [(i, i % 2) for i in range(1, 21)]


def test_the_fit_in_a_task_is_that_of_the_driver(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(40, size=12)) + (" bad" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(5)
    got = toxicity_fm.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    terms, bounds = toxicity_fm.term_rows(pa.array([r[1] for r in rows]))
    want = toxicity_fm.train(terms, bounds, np.array([r[2] for r in rows], float))
    assert got.bias == want.bias and all((getattr(got, k) == getattr(want, k)).all() for k in ("place", "w", "v")) and len(got.w)


def test_grams_stay_in_their_row():
    rows = pa.array(["ab c", "", None, "é"])
    alone = [np.sort(np.concatenate([g.ravel() for _, _, g, _, _ in language_id.gram_slices(rows.slice(k, 1))])) for k in range(4)]
    for _, _, grams, row, _ in language_id.gram_slices(rows):
        assert all(np.array_equal(np.sort(grams[:, row == k].ravel()), alone[k]) for k in range(4))


# --- near duplicates, passages --------------------------------------------------------
def test_bands_reach_the_recall():
    bands, rows = jaccard_join.choose_bands(0.8, 0.99999, 96)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.99999 and bands * rows <= 96


def test_links_in_large_buckets_are_those_of_brute_force(spark):
    """700 near copies of one text: several blocks, every pair counted once; copies of one of them collapse."""
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(700):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            words[at] = f"x{rng.integers(50)}"
        texts.append(" ".join(words))
    texts += [texts[5]] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    links = Counter()
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
    missed = sum(links[i] - got[i][1] for i in range(len(texts)))
    assert all(got[i][1] <= links[i] for i in range(len(texts))) and missed <= 1e-5 * sum(links.values()) + 2  # one pair at the edge
    assert {got[i][0] for i in range(len(texts)) if links[i]} == {min(i for i in links if links[i])}


def test_components_of_long_chains(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1) if i != 100], "u long, v long")
    got = {r.key: r.component for r in jaccard_join.components(edges).collect()}
    one, two = set(order[:101].tolist()), set(order[101:].tolist())
    assert all(got.get(x, x) == min(one) for x in one) and all(got.get(x, x) == min(two) for x in two)


@pytest.mark.parametrize("period", substring_dedup.COVERS)
def test_covers_meet_at_every_distance(period):
    cover = substring_dedup.COVERS[period]
    for i in range(period):
        for j in range(period):
            assert any((i + k) % period in cover and (j + k) % period in cover for k in range(period))


@pytest.mark.parametrize("window", [2, 5, 13, 30])
def test_anchors_fit_their_window(window):
    period, _, width = substring_dedup.choose_cover(window)
    assert width >= 1 and period - 1 + width <= window


def test_passages_against_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = [[f"p{k}_{i}" for i in range(rng.integers(10, 40))] for k in range(12)]
    rows = []
    for d in range(150):
        words = []
        for _ in range(rng.integers(0, 6)):
            words += pool[rng.integers(12)][rng.integers(8):] if rng.random() < 0.5 else [f"u{rng.integers(400)}" for _ in range(rng.integers(12))]
        rows.append((int(rng.integers(120)), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs, group_bytes=2000).collect())
    first = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 12):
            key = tuple(w[i:i + 13])
            first[key] = min(first.get(key, d), d)
    want = Counter()
    for d, t in rows:
        w = t.split()
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i:i + 13])] < d for k in range(13)}
        want[(d, len(w), len(gone))] += 1
    assert got == want


# --- urls ------------------------------------------------------------------------------
def test_a_cascade_is_exact_over_its_universe(spark):
    keys = [f"host{i}.example/" for i in range(6000)]
    listed = keys[::15]
    universe = spark.createDataFrame([(k,) for k in keys + keys[:50]], "key string")
    cascade = url_filter.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    got = {r.key for r in universe.where(cascade.lists(F.col("key"))).collect()}
    assert got == set(listed)
    bits = sum(64 * len(level.words) for level in cascade.levels)
    assert bits < 64 * len(listed) * 0.5  # far below the listed keys themselves


# --- mixing ------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_no_source_strays_a_block_from_its_share(weights):
    order, q = mixing.pfair_period(weights), sum(weights)
    done = np.zeros(len(weights))
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert (np.abs(done - np.array(weights) * t / q) < 1).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1))
def test_schedules_hand_out_each_slot_once_and_keep_to_the_weights(spec):
    blocks, weights = {s: n for s, (n, _) in spec.items()}, {s: w for s, (_, w) in spec.items()}
    schedule = mixing.plan(blocks, weights)
    slots = {s: schedule.slots(s, np.arange(n)).tolist() for s, n in blocks.items() if n}
    assert sorted(x for v in slots.values() for x in v) == list(range(sum(blocks.values())))
    assert all(v == sorted(v) for v in slots.values())
    left, at = {s: n for s, n in blocks.items() if n}, {x: s for s, v in slots.items() for x in v}
    active, begin, done = set(left), 0, Counter()
    for t in range(sum(blocks.values())):
        done[at[t]] += 1
        total = sum(weights[s] for s in active)
        assert all(abs(done[s] - weights[s] / total * (t + 1 - begin)) < 1 for s in active)
        left[at[t]] -= 1
        if not left[at[t]]:  # the rest share from here on
            active.discard(at[t])
            begin, done = t + 1, Counter()
