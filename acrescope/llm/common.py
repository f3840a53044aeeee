"""Helpers shared by the operators: text slices, word hashes, packed groups, written intermediates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrescope.session import cut_lineage, shared_folder

__all__ = ["cut_lineage", "shared_folder", "text_slices", "small_batches", "word_table", "window_hashes", "unique_in_docs", "ragged", "table_bytes",
           "sorted_groups", "mix64", "crc_mod", "free_prefix", "SpanIds"]

SLICE_BYTES = 1 << 20

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_STEP = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)]
_WSTEP = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
# words end at space, tab, line feed, vertical tab, form feed and carriage return
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def crc_mod(column: str, n: int):
    """crc32 of an id written as text, modulo n; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def free_prefix(columns: list[str], prefix: str) -> str:
    """The prefix, with as many underscores before it as no column name starts with, whatever its case."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets) of runs of whole texts of about ``limit`` bytes; null reads as empty.

    A text longer than the limit comes alone, so memory follows the longest text.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        end = min(end, n)
        yield start, end, data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start]
        start = end


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what a worker makes of one stays small."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def word_spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, words before each row) of the words in a slice; words do not cross rows."""
    inside = ~space[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = False
    before[1:] = inside
    first = inside & ~before[:-1]
    bounds = offsets[:-1][(offsets[:-1] < len(data))]
    first[bounds] |= inside[bounds]  # a row start opens a word
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seeds: tuple[int, ...], longest: int | None = None) -> list[np.ndarray]:
    """64-bit polynomial hashes of each span, or of its first ``longest`` bytes, one array per seed."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in seeds]
    size = ends - starts
    if longest is not None:
        size = np.minimum(size, longest)
    begin = np.cumsum(size) - size
    at = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(begin, size)
    body, out = data[at + np.repeat(starts, size)], []
    for seed in seeds:
        power = np.cumprod(np.concatenate(([_U(1)], np.full(int(size.max()), _STEP[seed]))), dtype=np.uint64)
        values = _BYTE[seed][body]
        values *= power[at]
        out.append(mix64(np.add.reduceat(values, begin) + _U(len(_STEP)) * size.astype(np.uint64)))
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, longest: int | None = None) -> np.ndarray:
    """64-bit polynomial hash of each span, or of its first ``longest`` bytes."""
    return span_hashes(data, starts, ends, (seed,), longest)[0]


def word_table(texts: pa.Array, seeds: int = 1, limit: int = SLICE_BYTES) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words of all rows, one array per seed, and the words before each row (rows + 1)."""
    parts, bounds, total = [[] for _ in range(seeds)], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in text_slices(texts, limit):
        starts, ends, before = word_spans(data, offsets)
        for seed in range(seeds):
            parts[seed].append(span_hash(data, starts, ends, seed))
        bounds.append(before[1:] + total)
        total += len(starts)
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.uint64)
    return [join(p) for p in parts], np.concatenate(bounds)


def window_hashes(words: np.ndarray, bounds: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window start, 64-bit hash) of every run of ``width`` words that lies in one row."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total, step = np.zeros(n, np.uint64), 1
    for k in range(width):
        total += words[k:k + n] * _U(step)
        step = step * _WSTEP[seed] % (1 << 64)
    # a window start must leave width words to its row's end
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    room = row_end[:n] - np.arange(n)
    ok = np.flatnonzero(room >= width)
    return ok, mix64(total[ok])


def unique_in_docs(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Values without repeats inside a row, sorted by row then value, and the values before each row."""
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))


def ragged(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """One bytes object per row of a flat array."""
    return [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def table_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes of text in a table: one scan with a map-side sum, one row to the driver."""
    total = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in columns), F.lit(0))
    return int(df.agg(F.sum(total.cast("long"))).first()[0] or 0)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by them; a group may lie across batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class SpanIds:
    """Ids of byte spans, made once for each distinct span a worker has met lately.

    ``make`` gives the flat int32 ids of a list of spans and each span's count. A span is known by two 64-bit hashes. When more than ``limit`` are held, the
    half not met for longest leaves.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000):
        self.make, self.limit, self.clock = make, limit, 0
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids of all spans in order, ids before each span)."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        raw = data.tobytes()
        one, two = span_hashes(data, starts, ends, (0, 1))
        key, first, inverse = np.unique(one, return_index=True, return_inverse=True)
        check = two[first]
        if (check[inverse] != two).any():  # two spans share a hash: this slice goes without the store
            words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            flat, size = self.make(words)
            return flat, np.concatenate([[0], np.cumsum(size)])
        self.clock += 1
        place = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = (self.key[place] == key) & (self.check[place] == check) if len(self.key) else np.zeros(len(key), bool)
        self.seen[place[known]] = self.clock
        fresh = np.flatnonzero(~known)
        flat, size = self.make([raw[a:b] for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist())])
        at_u, size_u = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        at_u[known], size_u[known] = self.at[place[known]], self.size[place[known]]
        at_u[fresh], size_u[fresh] = len(self.pool) + np.cumsum(size) - size, size
        self.pool = np.concatenate([self.pool, flat])
        count = size_u[inverse]
        before = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.repeat(at_u[inverse] - before[:-1], count) + np.arange(before[-1])]
        self._keep(key[fresh], check[fresh], at_u[fresh], size)
        return out, before

    def _keep(self, key, check, at, size) -> None:
        place = np.searchsorted(self.key, key)  # both sides are sorted
        for name, new in (("key", key), ("check", check), ("at", at), ("size", size), ("seen", np.full(len(key), self.clock))):
            setattr(self, name, np.insert(getattr(self, name), place, new))
        if len(self.key) > self.limit:
            stay = np.sort(np.argsort(-self.seen, kind="stable")[:self.limit // 2])
            self.key, self.check, self.at, self.size, self.seen = (x[stay] for x in (self.key, self.check, self.at, self.size, self.seen))
            begin = np.cumsum(self.size) - self.size
            self.pool = self.pool[np.repeat(self.at - begin, self.size) + np.arange(int(self.size.sum()))]
            self.at = begin
