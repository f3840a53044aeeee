"""Removal of word passages that occur in an earlier document, found through difference-cover anchors."""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.llm.common import mix64, table_bytes, text_slices, window_hashes, word_spans, word_table

# perfect difference covers: every distance modulo the period occurs between two members
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
GROUP_BYTES = 4 << 20  # text of the documents that are handled together
_GRP = "_group_of_documents"
LAST = np.iinfo(np.int64).max


def choose_cover(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor words): the longest period that leaves anchors at least half a window of words.

    Two equal windows at any positions share an anchor at cover positions of
    both after at most period - 1 words, so the anchor may have
    window - period + 1 words.
    """
    fit = [p for p in COVERS if window - p + 1 >= max(1, (window + 1) // 2)]
    if not fit:
        return 1, (0,), window
    period = max(fit)
    return period, COVERS[period], window - period + 1


def _planes(values: np.ndarray) -> bytes:
    """Sorted values as differences, bytes of equal weight together, which general compression shrinks."""
    step = np.diff(values, prepend=values.dtype.type(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, step.dtype.itemsize).T).tobytes()


def _unplanes(body: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    step = np.ascontiguousarray(np.frombuffer(body, np.uint8).reshape(size, -1).T).view(dtype).ravel()
    return np.cumsum(step, dtype=dtype)


def _cut(bucket: np.ndarray, parts: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(parts + 1))


class _Group:
    """Word hashes of one group of documents, the same in each pass whatever the order of its rows."""

    def __init__(self, table: pa.Table, window: int, parts: int, seeds: int, doc_id: str, text: str):
        self.window, self.parts = window, parts
        self.text = table.column(text)
        self.ids = table.column(doc_id).cast(pa.int64()).fill_null(LAST).to_numpy()
        self.words, self.bounds = word_table(self.text, seeds)

    def anchors(self):
        """(position, row, bucket, id) of each anchor: ids are 32 bits, told apart further by the bucket."""
        period, cover, width = choose_cover(self.window)
        start, value = window_hashes(self.words[0], self.bounds, width)
        row = np.searchsorted(self.bounds, start, "right") - 1
        at = np.isin((start - self.bounds[row]) % period, cover)
        start, row, value = start[at], row[at], value[at]
        return start, row, ((value >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64), value.astype(np.uint32)

    @staticmethod
    def distinct(bucket, value, row):
        """Distinct (bucket, value), each with its first and last row of input, and the index of each input in them."""
        packed = bucket.astype(np.uint64) << np.uint64(32) | value
        unique, inverse = np.unique(packed, return_inverse=True)
        low, high = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), -1)
        np.minimum.at(low, inverse, row)
        np.maximum.at(high, inverse, row)
        return unique, inverse, low, high

    def candidates(self, reply: pa.Table):
        """(start, row, hash, hash) of the windows that hold an anchor seen in two documents."""
        start, row, bucket, value = self.anchors()
        unique, inverse, low, high = self.distinct(bucket, value, row)
        shared = low != high
        cut = _cut((unique >> np.uint64(32)).astype(np.int64), self.parts)
        for p, bits in zip(reply.column("part").to_pylist(), reply.column("body").to_pylist()):
            a, b = cut[p], cut[p + 1]
            shared[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        start, row = start[shared[inverse]], row[shared[inverse]]
        period = choose_cover(self.window)[0]
        ok = np.zeros(len(self.words[0]) + self.window, bool)
        for k in range(period):
            at = start - k
            at = at[at >= self.bounds[row]]
            ok[at] = True
        starts, one = window_hashes(self.words[0], self.bounds, self.window)
        _, two = window_hashes(self.words[1], self.bounds, self.window, 1)
        pick = ok[starts]
        starts = starts[pick]
        return starts, np.searchsorted(self.bounds, starts, "right") - 1, one[pick], two[pick]

    def windows(self, reply: pa.Table):
        """Distinct candidate windows sorted by (bucket, hash), the smallest id that has each, and the inputs' index."""
        starts, row, one, two = self.candidates(reply)
        bucket = (mix64(one) % np.uint64(self.parts)).astype(np.int64)
        order = np.lexsort((two, one, bucket))
        b, x, y = bucket[order], one[order], two[order]
        new = np.ones(len(order), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        group = np.cumsum(new) - 1
        inverse = np.empty(len(order), np.int64)
        inverse[order] = group
        low = np.full(int(new.sum()), LAST)
        np.minimum.at(low, inverse, self.ids[row])
        return starts, row, b[new], x[new], y[new], low, inverse


_BLOB = "part int, grp int, body binary, more binary, ids binary"
_NAMES = ["part", "grp", "body", "more", "ids"]


def _blobs(grp, rows) -> pa.Table:
    part, body, more, ids = (list(c) for c in zip(*rows)) if rows else ([], [], [], [])
    return pa.table([pa.array(part, pa.int32()), pa.array([grp] * len(part), pa.int32()), pa.array(body, pa.binary()),
                     pa.array(more, pa.binary()), pa.array(ids, pa.binary())], names=_NAMES)


def _send_anchors(window: int, parts: int, doc_id: str, text: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g = _Group(table, window, parts, 1, doc_id, text)
        _, row, bucket, value = g.anchors()
        unique = g.distinct(bucket, value, row)[0]
        cut = _cut((unique >> np.uint64(32)).astype(np.int64), parts)
        value = unique.astype(np.uint32)
        return _blobs(key[0].as_py(), [(p, _planes(value[cut[p]:cut[p + 1]]), None, None) for p in range(parts) if cut[p] < cut[p + 1]])

    return run


def _match_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """Per sending group a bit for each of its anchors: another group has it too."""
    groups = table.column("grp").to_pylist()
    values = [_unplanes(b, np.uint32) for b in table.column("body").to_pylist()]
    flat = np.concatenate(values)
    order = np.argsort(flat, kind="stable")
    s = flat[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:]
    shared = np.empty(len(s), bool)
    shared[order] = twin
    out, at = [], 0
    for grp, v in zip(groups, values):
        bits = shared[at:at + len(v)]
        at += len(v)
        if bits.any():
            out.append((key[0].as_py(), grp, np.packbits(bits).tobytes()))
    part, grp, body = (list(c) for c in zip(*out)) if out else ([], [], [])
    return pa.table([pa.array(part, pa.int32()), pa.array(grp, pa.int32()), pa.array(body, pa.binary())], names=["part", "grp", "body"])


def _send_windows(window: int, parts: int, doc_id: str, text: str):
    def run(key: tuple, table: pa.Table, reply: pa.Table) -> pa.Table:
        g = _Group(table, window, parts, 2, doc_id, text)
        _, _, bucket, one, two, low, _ = g.windows(reply)
        cut = _cut(bucket, parts)
        return _blobs(key[0].as_py(), [
            (p, _planes(one[cut[p]:cut[p + 1]]), two[cut[p]:cut[p + 1]].astype(np.uint32).tobytes(), low[cut[p]:cut[p + 1]].tobytes())
            for p in range(parts) if cut[p] < cut[p + 1]])

    return run


def _match_windows(key: tuple, table: pa.Table) -> pa.Table:
    """Per sending group the windows that another group has in a document with a smaller id, and that id."""
    groups = table.column("grp").to_pylist()
    one = [_unplanes(b, np.uint64) for b in table.column("body").to_pylist()]
    x = np.concatenate(one)
    y = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("more").to_pylist()])
    ids = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("ids").to_pylist()])
    order = np.lexsort((y, x))
    new = np.ones(len(order), bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    low = np.minimum.reduceat(ids[order], np.flatnonzero(new))
    best = np.empty(len(order), np.int64)
    best[order] = low[np.cumsum(new) - 1]
    out, at = [], 0
    for grp, v in zip(groups, one):
        mine, found = ids[at:at + len(v)], best[at:at + len(v)]
        at += len(v)
        less = np.flatnonzero(found < mine)
        if len(less):
            out.append((key[0].as_py(), grp, less.astype(np.uint32).tobytes(), found[less].tobytes()))
    part, grp, body, more = (list(c) for c in zip(*out)) if out else ([], [], [], [])
    return pa.table([pa.array(part, pa.int32()), pa.array(grp, pa.int32()), pa.array(body, pa.binary()), pa.array(more, pa.binary())],
                    names=["part", "grp", "body", "more"])


def _cover(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def _remove(window: int, parts: int, g: _Group, shared: pa.Table, lower: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Words removed from each row, and each row's kept words joined by one space."""
    starts, row, bucket, _, _, low, inverse = g.windows(shared)
    cut = _cut(bucket, parts)
    for p, index, ids in zip(*(lower.column(c).to_pylist() for c in ("part", "body", "more"))):
        low[cut[p] + np.frombuffer(index, np.uint32).astype(np.int64)] = np.frombuffer(ids, np.int64)
    gone = _cover(starts[low[inverse] < g.ids[row]], window, len(g.words[0]))
    kept, removed = [], np.zeros(len(g.bounds) - 1, np.int64)
    for first, last, data, offsets in text_slices(g.text):
        begin, end, before = word_spans(data, offsets)
        raw = data.tobytes()
        for r in range(first, last):
            out = gone[g.bounds[r]:g.bounds[r + 1]]
            removed[r] = out.sum()
            if removed[r]:
                kept.append(b" ".join([raw[begin[k]:end[k]] for k in np.flatnonzero(~out) + before[r - first]]))
            else:
                kept.append(b" ".join(raw[offsets[r - first]:offsets[r - first + 1]].split()))
    return removed, kept


def _removal(window: int, parts: int, doc_id: str, text: str, finish):
    def run(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        g = _Group(table, window, parts, 2, doc_id, text)
        flag = replies.column("kind").to_numpy()
        pick = lambda k: replies.filter(pa.array(flag == k, pa.bool_()))
        return finish(table, g, *_remove(window, parts, g, pick(0), pick(1)))

    return run


def _passes(docs: DataFrame, doc_id: str, text: str, window: int, group_bytes: int, finish, schema) -> DataFrame:
    """Group, match anchors, match windows, and give each group and its removals to ``finish``."""
    spark = docs.sparkSession
    groups = max(1, -(-table_bytes(docs, text) // group_bytes))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rows without an id spread by their text
    home = F.pmod(F.when(F.col(doc_id).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(groups)).cast("int")
    by_group = docs.withColumn(_GRP, home).groupBy(_GRP)
    anchors = by_group.applyInArrow(_send_anchors(window, parts, doc_id, text), _BLOB)
    shared = anchors.groupBy("part").applyInArrow(_match_anchors, "part int, grp int, body binary")
    windows = by_group.cogroup(shared.groupBy("grp")).applyInArrow(_send_windows(window, parts, doc_id, text), _BLOB)
    lower = windows.groupBy("part").applyInArrow(_match_windows, "part int, grp int, body binary, more binary")
    replies = shared.select("part", "grp", "body", F.lit(None).cast("binary").alias("more"), F.lit(0).alias("kind")) \
        .unionByName(lower.withColumn("kind", F.lit(1)))
    return by_group.cogroup(replies.groupBy("grp")).applyInArrow(_removal(window, parts, doc_id, text, finish), schema)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = 13,
                   group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: words under a repeated window are removed.

    A word goes if a window of ``window`` words that covers it also starts in a
    document with a smaller doc_id; all windows are judged on the input. The
    digest is that of the kept words joined by one space.

    Documents are dealt into groups of about ``group_bytes`` of text. Each group
    sends its distinct anchors (``choose_cover``), cut by hash, and learns which
    of them another group has; it then extends shared anchors to all windows
    that hold them and sends those, once each with its smallest id, as 96-bit
    hashes; the answer is the smallest id over all groups. A passage of a
    million documents is one entry per group, so no key gathers all its rows.

    Nulls: a null text has no words; a null doc_id counts as larger than any
    other, so such rows remove nothing from others or from each other. Rows
    with the same doc_id never remove words of each other, and all come back.
    """
    def finish(table, g, removed, kept):
        digest = [hashlib.sha256(k).hexdigest() for k in kept]
        return pa.table([table.column(doc_id), pa.array(np.diff(g.bounds)), pa.array(removed), pa.array(digest, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _passes(docs.select(doc_id, text), doc_id, text, window, group_bytes, finish,
                   "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", chars: str | None = "n_chars", window: int = 13,
                group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents with repeated passages cut out of their texts; all rows and columns stay.

    A document that loses words gets its kept words joined by one space, which
    may be none, and their length in ``chars``; the others stay as they are.
    Nulls and repeated ids: see ``remove_repeats``.
    """
    names = docs.columns

    def finish(table, g, removed, kept):
        lost = pa.array(removed > 0)
        new = pa.array(kept, pa.binary()).cast(pa.string())
        out = table.select(names)
        at = names.index(text)
        out = out.set_column(at, text, pc.if_else(lost, new, out.column(text)))
        if chars in names:
            at, old = names.index(chars), out.column(chars)
            out = out.set_column(at, chars, pc.if_else(lost, pc.utf8_length(new).cast(old.type), old))
        return out

    return _passes(docs, doc_id, text, window, group_bytes, finish, docs.schema)
