"""Similarity self-join on word n-gram sets: MinHash banding, then exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.llm.common import free_prefix, cut_lineage, mix64, ragged, small_batches, sorted_groups, unique_in_docs, window_hashes, word_table

BLOCK = 256  # members of a bucket that meet in one block


def choose_bands(threshold: float, recall: float, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds a pair at the threshold with at least this probability."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"no banding of {max_hashes} hashes reaches recall {recall} at {threshold}")
    return best


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, flat, and their bounds.

    A text of fewer than n words has its whole word sequence as one n-gram; a
    text without words, or null, has none.
    """
    (words,), bounds = word_table(texts)
    rows = len(bounds) - 1
    starts, hashes = window_hashes(words, bounds, n)
    at = np.searchsorted(bounds, starts, "right") - 1
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            value = np.uint64(count[r])
            for w in words[bounds[r]:bounds[r + 1]]:
                value = mix64(np.array([value ^ w]))[0]
            whole[k] = value
        hashes, at = np.concatenate([hashes, whole]), np.concatenate([at, short])
    return unique_in_docs(hashes, at, rows)


def band_hashes(sets: np.ndarray, bounds: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """[rows of the table, bands] 64-bit hash of each band's minima; only for rows with a set."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64)
    out = np.zeros((len(bounds) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if not len(full):
        return out
    first = bounds[:-1][full]
    for b in range(bands):
        value = np.full(len(full), np.uint64(b + 1))
        for r in range(b * rows, (b + 1) * rows):
            low = np.minimum.reduceat((sets * mult[r] + plus[r]) >> np.uint64(24), first)
            value = mix64(value ^ low) + low
        out[full, b] = value
    return out


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets, bounds = shingle_sets(batch.column("text"), n)
            found = band_hashes(sets, bounds, bands, rows).view(np.int64)
            some = pa.array(np.diff(bounds) > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, bands, dtype=np.int32)), pa.array(found.ravel()))
            out = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), lists], names=["key", "doc_id", "bands"])
            lists = pa.compute.if_else(some, lists, pa.nulls(len(lists), lists.type))
            yield out.set_column(2, "bands", lists)

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets, bounds = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("weight"), batch.column("bands"), pa.array(ragged(sets, bounds), pa.binary())],
                names=["key", "weight", "bands", "set"])

    return run


def _overlaps(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of sets [:left] with all sets, by products of 0/1 columns in bounded chunks."""
    size = np.array([len(s) for s in sets])
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = row[keep], column[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = np.zeros((left, len(sets)), np.float32)
    for a in range(0, int(shared.sum()), 4096):
        i, j = np.searchsorted(col, [a, a + 4096])
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[row[i:j], col[i:j] - a] = 1
        total += dense[:left] @ dense.T
    return total


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, by pointer jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def _verify(threshold: float):
    """Links inside a block, or between two blocks, of one bucket.

    A pair is counted in the first band in which its two texts meet, so each
    pair counts once over all bands. Only per-text sums and a forest leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["bucket", "one", "two"]):
            keys = group.column("key").to_pylist()
            side = group.column("side").to_numpy()
            order = np.lexsort((np.arange(len(keys)), side))
            left = int((side == 0).sum())
            inner = group.column("one")[0].as_py() == group.column("two")[0].as_py()
            if inner:
                left = len(keys)
            raw = group.column("set").to_pylist()
            sets = [np.frombuffer(raw[k], np.uint64) for k in order]
            weight = group.column("weight").to_numpy()[order]
            bands = np.array(group.column("bands").to_pylist(), dtype=np.int64)[order]
            band = group.column("band")[0].as_py()
            n = len(sets)
            if not left or (not inner and left == n):
                continue
            size = np.array([len(s) for s in sets], np.float64)
            both = _overlaps(sets, left)
            # |a & b| / |a or b| >= t, rounded so that an exact tie counts
            union = size[:left, None] + size[None, :] - both
            close = both >= threshold * union - 1e-9
            if inner:
                close &= np.triu(np.ones((n, n), bool), 1)
            else:
                close[:, :left] = False
            i, j = np.nonzero(close)
            first = np.argmax(bands[i] == bands[j], axis=1) if len(i) else np.zeros(0, int)
            same = first == band
            i, j = i[same], j[same]
            if not len(i):
                continue
            links = np.bincount(i, weight[j], n) + np.bincount(j, weight[i], n)
            root = _forest(n, i, j)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[order[k]] for k in some], pa.binary()), pa.array(links[some].astype(np.int64)),
                 pa.array([keys[order[root[k]]] for k in some], pa.binary())], names=["key", "links", "root"])

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(key, component) of the nodes of undirected edges (u, v); a component is named by its smallest key.

    Alternating large-star and small-star steps, written after each round. The
    driver sees one row per round: edge count and checksum.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    edges = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    seen = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut_lineage(small, name)
        now = state(edges)
        if now == seen:
            return edges.select(F.col("u").alias("key"), F.col("v").alias("component"))
        seen = now


def text_key(text: str = "text"):
    """16-byte identity of a text; null reads as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), 1, 32))


def jaccard_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.99999,
                    max_hashes: int = 96) -> DataFrame:
    """One row per text class: key, rep (smallest doc_id with the text), weight (documents), links, class_id, component.

    ``links`` counts the documents with another text whose n-gram set has
    Jaccard similarity ``threshold`` or more, ``class_id`` is the smallest
    doc_id of the connected component of such links, ``component`` that
    component's smallest key (two components share a class_id only if two
    different texts share that doc_id).

    Equal texts collapse first. The others meet in buckets of equal MinHash
    bands; a bucket whose members are those of an earlier band's bucket is
    dropped, larger ones are dealt out in block pairs of bounded size, and each
    pair that meets is verified on the full sets. Pairs never leave a task.

    Nulls: a null text is an empty one; texts without words link to nothing but
    their own copies. Null ids take part and never name a class unless all ids
    of it are null. Repeated rows count as documents.
    """
    bands, rows = choose_bands(threshold, recall, max_hashes)
    base = docs.select(text_key(text).alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = base.mapInArrow(_signatures(n, bands, rows), "key binary, doc_id long, bands array<long>")
    classes = cut_lineage(signed.groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("weight"), F.first("bands").alias("bands")), "text-classes")

    placed = classes.where("bands IS NOT NULL").select("key", F.posexplode("bands").alias("band", "hash"))
    buckets = placed.groupBy("band", "hash").agg(
        F.count("*").alias("n"), F.min("key").alias("low"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64("key") % 1000003).alias("s")).where("n > 1")
    kept = cut_lineage(buckets.groupBy("n", "low", "x", "s").agg(F.min_by(F.struct("band", "hash"), "band").alias("b"))
                       .select("b.band", "b.hash", "n"), "buckets")
    members = placed.join(kept, ["band", "hash"]).select("key", "band", "hash", "n")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(7)), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(
        F.least(own, o).alias("one"), F.greatest(own, o).alias("two"), (own > o).cast("int").alias("side")))
    members = cut_lineage(members.select("key", "band", "hash", F.explode(pairs).alias("p"))
                          .select("key", "band", F.xxhash64("band", "hash").alias("bucket"), "p.*"), "members")

    wanted = members.select("key").distinct()
    texts = base.join(classes.select("key", "rep", "weight", "bands").join(wanted, "key", "left_semi"),
                      (base["key"] == classes["key"]) & base["doc_id"].eqNullSafe(F.col("rep")))
    texts = texts.select(classes["key"], "weight", "bands", "text")
    sets = texts.mapInArrow(_sets(n), "key binary, weight long, bands array<long>, set binary").dropDuplicates(["key"])
    met = members.join(sets, "key").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    found = cut_lineage(met.mapInArrow(_verify(threshold), "key binary, links long, root binary"), "links")

    part = components(found.select(F.col("key").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    out = classes.select("key", "rep", "weight").join(links, "key", "left").join(part, "key", "left") \
        .withColumn("component", F.coalesce("component", "key"))
    names = out.groupBy("component").agg(F.min("rep").alias("class_id"))
    return out.join(names, "component").select("key", "rep", "weight", F.coalesce("links", F.lit(0)).alias("links"), "class_id", "component")


def jaccard_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links (documents with an equal or similar text, itself left out).

    See ``jaccard_classes`` for the meaning of the columns and of nulls.
    """
    classes = jaccard_classes(docs, doc_id=doc_id, text=text, **options)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("key"))
    return keyed.join(classes, "key").select("doc_id", "class_id", (F.col("links") + F.col("weight") - 1).alias("n_links"))


def keep_one_per_class(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The document with the smallest id of each class, with all its columns.

    Of rows that share that id and text one stays; where all ids of a class are
    null, one row with its smallest text key stays.
    """
    classes = cut_lineage(jaccard_classes(docs, doc_id=doc_id, text=text, **options), "classes")
    own = free_prefix(docs.columns, "_class_")  # names that no column of the documents has
    first = classes.groupBy("component").agg(F.min(F.when(F.col("rep").eqNullSafe(F.col("class_id")), F.col("key"))).alias(f"{own}key"),
                                             F.min("class_id").alias(f"{own}id"))
    keep = first.select(f"{own}key", f"{own}id")
    rows = docs.withColumn(f"{own}text", text_key(text))
    met = rows.join(keep, (F.col(f"{own}text") == F.col(f"{own}key")) & F.col(doc_id).eqNullSafe(F.col(f"{own}id")), "left_semi")
    return met.dropDuplicates([f"{own}text", doc_id]).select(*docs.columns)
